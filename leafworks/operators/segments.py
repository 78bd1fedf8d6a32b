"""Printed page numbers against physical pages: votes, runs, segments, and lookups either way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafworks.functions import numbers as N
from leafworks.functions import text as X
from leafworks.functions.once import once

RUN = 4


def page_offsets(pages: DataFrame, text: str = "text") -> DataFrame:
    """``(doc, page, total, offset)``: the offset most of a page's printed numbers vote for; ties go to the
    vote that comes first. Null where nothing votes."""
    # at most six numbers of each page are kept before pages meet, so no text goes into the window
    rows = once(pages.select("doc", "page", F.col(text).alias("_t")), _n=N.candidates(X.solid_lines(F.col("_t")))).select("doc", "page", "_n")
    rows = rows.withColumn("total", F.max("page").over(Window.partitionBy("doc")))
    votes = F.filter(F.transform("_n", lambda n: F.when(n.between(1, F.col("total") + 5), F.col("page") - n)), lambda o: o.isNotNull() & (o >= 0) & (o <= F.col("page") - 1))
    rows = once(rows, _v=votes)
    # the first of the distinct votes with the most voters
    counted = F.transform(F.array_distinct("_v"), lambda o: F.struct(F.size(F.filter("_v", lambda x: x == o)).alias("n"), (-F.array_position("_v", o)).alias("first"), o.alias("o")))
    return rows.select("doc", "page", "total", F.array_max(counted)["o"].cast("int").alias("offset"))


def runs(offsets: DataFrame, least: int = RUN) -> DataFrame:
    """``(doc, total, start, end, offset)``: stretches of ``least`` pages or more with one offset."""
    by_offset = Window.partitionBy("doc", "offset").orderBy("page")
    known = offsets.filter(F.col("offset").isNotNull())
    island = known.withColumn("_g", F.col("page") - F.row_number().over(by_offset))
    found = island.groupBy("doc", "total", "offset", "_g").agg(F.min("page").alias("start"), F.max("page").alias("end"))
    return found.filter(F.col("end") - F.col("start") + 1 >= least).select("doc", "total", "start", "end", "offset")


def segments(pages: DataFrame, text: str = "text", least: int = RUN) -> DataFrame:
    """``(doc, start, end, offset)``: all pages of a document in stretches of one offset.

    A gap before the first run takes that run's offset; one between runs is halved, the smaller half to the
    run before; one behind the last takes its offset. Without runs there is one segment with offset 0.
    """
    found = runs(page_offsets(pages, text), least)
    w = Window.partitionBy("doc").orderBy("start")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    spread = found.withColumns({"_before": before, "_after": after})
    # the half of a gap that belongs to the run before it ends at this page
    half = lambda a, b: a + F.floor((b - a - 1) / 2)
    low = F.when(F.col("_before").isNull(), 1).otherwise(half(F.col("_before"), F.col("start")) + 1)
    high = F.when(F.col("_after").isNull(), F.col("total")).otherwise(half(F.col("end"), F.col("_after")))
    wide = spread.select("doc", low.cast("int").alias("start"), high.cast("int").alias("end"), "offset")
    new = F.when(F.lag("offset").over(w) == F.col("offset"), 0).otherwise(1)
    joined = wide.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w)).groupBy("doc", "_g", "offset").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    made = joined.select("doc", "start", "end", "offset")
    docs = pages.groupBy("doc").agg(F.max("page").cast("int").alias("_last"))
    # a left join, not a union: joins on the document follow, and they should not depend on a union's partitions
    rows = docs.join(made, "doc", "left")
    return rows.select("doc", F.coalesce("start", F.lit(1)).alias("start"), F.coalesce("end", "_last").alias("end"), F.coalesce("offset", F.lit(0)).alias("offset"))


def resolve(printed: DataFrame, found: DataFrame, number: str = "printed") -> DataFrame:
    """``printed`` rows with ``physical``: by the first segment that holds the number, else by the last
    segment's offset, kept between 1 and its end. The join is on the document; segments are few."""
    seg = found.select("doc", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("offset").alias("_o"))
    lists = seg.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_s", "_e", "_o"))).alias("_segs"))
    rows = printed.join(lists, "doc", "left")
    hit = F.get(F.filter("_segs", lambda s: F.col(number).between(s["_s"] - s["_o"], s["_e"] - s["_o"])), F.lit(0))
    last = F.element_at("_segs", -1)
    value = F.coalesce(F.col(number) + hit["_o"], F.greatest(F.lit(1), F.least(F.col(number) + last["_o"], last["_e"])))
    return rows.withColumn("physical", F.when(F.col(number).isNotNull(), value)).drop("_segs")


def own_printed(pages: DataFrame, found: DataFrame, page: str = "page") -> DataFrame:
    """``pages`` rows with the number that is printed on them, by the segment they lie in."""
    seg = found.select(F.col("doc").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("offset").alias("_o"))
    joined = pages.join(seg, (F.col("doc") == F.col("_d")) & F.col(page).between(F.col("_s"), F.col("_e")), "left")
    return joined.withColumn("own_printed", F.col(page) - F.col("_o")).drop("_d", "_s", "_e", "_o")


def degenerate(found: DataFrame) -> DataFrame:
    """Documents of which nothing is known: one segment, offset 0."""
    return found.groupBy("doc").agg(((F.count("*") == 1) & (F.max("offset") == 0) & (F.min("start") == 1)).alias("degenerate"))
