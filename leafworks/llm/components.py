"""Connected components of an edge table, by rounds of hooking to the smallest neighbour, pointer
doubling and contraction. Edges, labels and components stay in tables; the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import settle


def connected(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(v, root)`` for every vertex on an edge; root: the smallest vertex reachable.

    Self-loops count for nothing, repeated edges as one; an empty table gives an empty table.
    """
    tidy = lambda e: e.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = settle(tidy(edges), "cc-edges")
    found = None
    while found is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settle(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "cc-up")
        moved = True
        while moved:
            step = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.v")).select("x.v", F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved"))
            step = settle(step, "cc-jump")
            moved, up = not step.filter("moved").isEmpty(), step.drop("moved")
        if found is None:
            found = up
        else:
            found = settle(
                found.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.v"), "left").select("x.v", F.coalesce("y.p", "x.p").alias("p")), "cc-found"
            )
        edges = settle(
            tidy(
                edges.alias("e")
                .join(up.alias("x"), F.col("e.a") == F.col("x.v"))
                .join(up.alias("y"), F.col("e.b") == F.col("y.v"))
                .select(F.col("x.p").alias("a"), F.col("y.p").alias("b"))
            ),
            "cc-edges",
        )
    return found.select("v", F.col("p").alias("root"))
