"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources are clamped at ``max_epochs`` times their size; what they cannot take is shared among the
others by weight until no target is above its cap. Each document is then taken a whole number of times
(the whole part of target / source size), and a seeded hash order decides which documents are taken
once more: those below a cut in the hash space, the cut placed so that the words come to the target.
The one document at the cut is taken in part (a fractional repetition: its first words).

The cut is found without gathering a source in one task: sizes are summed by source and slice of the
hash space first, then only the slice that holds the cut is ordered.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of its own, last
in the order; repeated rows are taken alike or one after the other in an order of their own hashes; an
empty table gives an empty table; columns of the input with clashing names are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafworks.llm._base import settle

#: Slices of the hash space in which sizes are summed.
SLICES = 4096
#: A table of sources up to this many rows may be broadcast.
BROADCAST_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight)``: shares of ``total`` by weight, none above
    ``max_epochs * source_size``; the excess is shared again by weight until none is above."""
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    level = None
    while True:
        open_ = F.lit(True) if level is None else cap > F.col("weight") * F.lit(level)
        free, weight = sources.agg(
            F.lit(float(total)) - F.sum(F.when(open_, 0.0).otherwise(cap)), F.sum(F.when(open_, F.col("weight")).otherwise(0.0))
        ).first()
        if not weight:
            return sources.withColumn("target", cap)
        new = free / weight
        if level is not None and new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns (doc_id), source, size, source_size, target and taken.

    ``docs`` needs doc_id, source and text. ``weights`` repeat over the sources in code-point order.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    order = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.lit(1 << 40))
    sized = settle(
        docs.select(*keep, "source", word_count(F.col("text")).alias("size"))
        .withColumn("_at", order)
        .withColumn("_slice", (F.col("_at") / F.lit((1 << 40) // SLICES)).cast("int")),
        "mix-sizes",
    )
    slices = settle(sized.groupBy("source", "_slice").agg(F.sum("size").alias("words")), "mix-slices")
    sources = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    # UTF-8 bytes and code points sort alike; the table has one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    sources = settle(sources.withColumn("_place", place).withColumn("weight", weight).drop("_place"), "mix-sources")
    n, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    sources = water_fill(sources, share * (total or 0), max_epochs)
    # whole repetitions, and the words that the documents taken once more should have
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_whole", F.floor(ratio).cast("long")).withColumn(
        "_more", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    )
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    # the slice of each source in which the cut lies: a source has SLICES rows at most here
    before = F.sum("words").over(Window.partitionBy("s.source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    cuts = (
        slices.alias("s")
        .join(sources.alias("t"), same("s", "t"))
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .filter((F.col("_before") <= F.col("_more")) & (F.col("_more") < F.col("_before") + F.col("words")))
        .select(F.col("s.source").alias("source"), F.col("_slice").alias("_cut"), (F.col("_more") - F.col("_before")).alias("_rest"))
    )
    plan = (
        sources.alias("t")
        .join(cuts.alias("c"), same("t", "c"), "left")
        .select("t.*", F.coalesce("_cut", F.when(F.col("_more") > 0, SLICES).otherwise(-1)).alias("_cut"), "_rest")
    )
    plan = settle(plan, "mix-plan")
    if n <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = sized.alias("d").join(plan.alias("p"), same("d", "p")).select("d.*", "p.source_size", "p.target", "p._whole", "p._cut", "p._rest")
    inside = joined.filter(F.col("_slice") == F.col("_cut"))
    sums = F.sum("size").over(Window.partitionBy("source").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("_once", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.coalesce(sums, F.lit(0)))))
    others = joined.filter(F.col("_slice") != F.col("_cut")).withColumn("_once", F.when(F.col("_slice") < F.col("_cut"), F.col("size")).otherwise(0))
    return others.unionByName(inside).select(
        *keep, "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_once")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents as often as the mix takes them, with the input's columns: whole copies, and for the
    one document of a source at its cut the first words that are still due. What it doesn't take goes."""
    rows = mix(docs, keep=["doc_id", "text", "lang", "n_chars"], **how)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(rest, F.lit(1))), " ")
    copies = F.when(whole > 0, F.array_repeat(F.col("text"), whole)).otherwise(F.array().cast("array<string>"))
    texts = F.when(rest > 0, F.concat(copies, F.array(first))).otherwise(copies)
    out = rows.select("*", F.explode(texts).alias("_text")).drop("text")
    return out.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.char_length("_text").cast("long").alias("n_chars"))
