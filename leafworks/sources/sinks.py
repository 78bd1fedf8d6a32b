"""Results as tables and sidecars. Tables are replaced through Spark's commit protocol; small files that one
document owns are written whole and then renamed."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def keep_first(df: DataFrame, path: str) -> None:
    """Write only if nothing is there: the earliest backup is the one worth keeping."""
    df.write.mode("ignore").parquet(path)


def restore(spark: SparkSession, backup: str, path: str, purge: bool = False) -> int:
    """The table at ``path`` is made what its backup holds, which goes after that if ``purge``; gives the rows restored."""
    replace_table(spark.read.parquet(backup), path)
    if purge:
        place = spark._jvm.org.apache.hadoop.fs.Path(backup)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return spark.read.parquet(path).count()


def replace_file(path: str | Path, text: str) -> None:
    """A file written beside its place, flushed, and moved there."""
    path = Path(path)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, delete=False) as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def nested_regions(regions: DataFrame) -> DataFrame:
    """Regions as one row for each document, pages as a map: the sidecar's form."""
    b = F.col("bbox")
    item = F.struct("ord", F.array(b["x0"], b["y0"], b["x1"], b["y1"]).alias("bbox_pt"), "text", "class", "source")
    pages = regions.groupBy("doc", "page").agg(F.array_sort(F.collect_list(item)).alias("r"))  # a page's regions
    return pages.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), "r"))).alias("pages"))


def write_sidecars(rows: DataFrame, path: str) -> None:
    """JSON lines, one for each document."""
    rows.write.mode("overwrite").json(path)


def sidecar_path(pdf: Column, suffix: str = ".regions.json") -> Column:
    """``book.pdf`` -> ``book.regions.json``; ``.faudit.json`` and ``.toc.bak.json`` likewise."""
    return F.concat(F.regexp_replace(pdf, r"\.[^./]*$", ""), F.lit(suffix))


def emit(value, wanted: bool) -> None:
    if wanted:
        print(json.dumps(value, ensure_ascii=False))
