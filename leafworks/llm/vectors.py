"""Vectors as blocks of numbers: reading them from a table, and dealing them out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(table: DataFrame, nonzero: bool) -> DataFrame:
    """``(vec_id, v)``: vectors of doubles that aren't null or empty and hold finite components only.
    ``nonzero``: without vectors of zeros."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(fine & F.exists("v", lambda x: x != 0)) if nonzero else rows.filter(fine)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are of one length, as rows."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


def same_length(table: DataFrame) -> tuple[DataFrame, int]:
    """Vectors of the commonest length (ties: the longest), which are the ones that can be compared, and that length."""
    top = table.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = top["n"] if top else 0
    return table.filter(F.size("v") == n), n


def stacked(batches: Iterator[pa.RecordBatch], *columns: str) -> dict[str, np.ndarray] | None:
    """All rows of a task's partition: the named columns as arrays, ``v`` as a matrix."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    out = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns if c != "v"}
    if "v" in columns:
        out["v"] = np.concatenate([matrix(b.column("v")) for b in held])
    return out
