"""Signals laid over the synthetic tables, which have none of their own: damaged, spaced and short pages,
printed numbers, second readings, regions, entries and status logs. One SQL text serves both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafworks.functions.geometry import rect

NL, BAD, PRIVATE = "\n", "�", ""

NUMBERED = """
p as (
  select source as doc, cast(substr(source, 4) as int) as b, doc_id, text,
         cast(row_number() over (partition by source order by doc_id) as int) as page
  from documents),"""
PAGE_TEXT = f"""{NUMBERED}
q as (
  select *, (page + b) % 8 as r, b % 3 + 1 + case when page > 6 + b then 1 else 0 end as off from p),
o as (
  select *, case r
    when 1 then translate(text, 'aeiounrst', '{BAD * 9}')
    when 2 then replace(text, 'e', '中 文')
    when 3 then translate(text, 'aeiounrstlh', '{PRIVATE * 11}')
    when 4 then substr(text, 1, 5)
    when 5 then '- 12 -'
    when 6 then concat(text, '{NL}so e^x^2 = y', '{NL}term x_n^2 here', '{NL}half 1/2x of',
                       '{NL}sin x + 1', '{NL}root √x', '{NL}price $5 e^x^2', '{NL}ok $e^x^2$ done')
    else text end as t2 from q),
pages_ as (
  select doc, page, doc_id, r, off,
    case when page <= off or r in (4, 5) then t2
         else concat(t2, '{NL}', cast(page - off as varchar(10))) end as text,
    case (page + doc_id) % 3 when 0 then text
         when 1 then translate(text, 'aeioulm', 'zzzzzzz')
         else translate(text, 'aeiourstlnmdc', 'zzzzzzzzzzzzz') end as ref_text
  from o)"""

ENTRIES = """
entries_ as (
  select doc, cast(row_number() over (partition by doc order by page) as bigint) as ord,
         cast(page % 3 + 1 as int) as level, concat(cast(page as varchar(10)), '.', cast(page % 7 as varchar(10)), ' ', substr(ref_text, 1, 12)) as title,
         cast(case when page % 4 = 0 then null else greatest(page - off, 1) - (case when page % 11 = 0 then 5 else 0 end) end as int) as printed
  from pages_ where page % 2 = 0)"""

#: What entries have of a text: their SQL changes characters one by one, then cuts, and so the cut may come first.
HEAD = "substr(text, 1, 12)"

STATUS = f"""
status_ as (
  select cast(user_id % 20 as bigint) as log, event_id as line_no,
    case event_id % 7
      when 0 then 'noise'
      when 1 then concat('RESULT {{"status":"ok","phase":"', event_type, '","done":', cast(event_id % 50 as varchar(20)), ',"total":50,"failed":0,"elapsed_s":3}}')
      when 2 then concat('RESULT {{"status":"ok","phase":"', event_type, '","done":-1,"total":50,"failed":0,"elapsed_s":3}}')
      when 3 then concat('PROGRESS phase=', event_type, ' done=', cast(event_id % 50 as varchar(20)), ' total=50 failed=1 done=2 elapsed_s=3')
      when 4 then concat('ERROR {{"status":"error","phase":"x","done":1,"total":2,"failed":1,"elapsed_s":', cast(event_id % 9 as varchar(20)), ',"command":"c","code":"e","message":""}}')
      else concat('PROGRESS phase=', event_type, ' done=', cast(event_id % 50 as varchar(20)), ' total=50 failed=', cast(event_id % 3 as varchar(20)), ' elapsed_s=3') end as line
  from events)"""


def numbered(docs: DataFrame) -> DataFrame:
    """``p`` of the SQL, ``(doc, b, doc_id, text, page)``, from ``docs(source, doc_id, text)``.

    Only keys are put in order: a source may hold most documents there are, and whatever is done with texts behind
    a window over them would be done by one task. Texts meet their numbers by key, evenly spread."""
    own = Window.partitionBy("_key").orderBy(F.lit(0))
    before = Window.partitionBy("_key.source").orderBy("_key.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # equal as a struct if both are null, as rows of one partition are
    keyed = docs.withColumn("_key", F.struct("source", "doc_id"))
    first = keyed.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = keyed.withColumn("_nth", F.row_number().over(own)).join(first, "_key")
    return rows.select(F.col("source").alias("doc"), F.expr("cast(substr(source, 4) as int)").alias("b"), "doc_id", "text", (F.col("_first") + F.col("_nth")).cast("int").alias("page"))


def sql(spark: SparkSession, sf_dir: str, ctes: list[str], query: str, text: str = "text") -> DataFrame:
    """``text``: what is read of a document's text, if it isn't all needed."""
    if PAGE_TEXT in ctes:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.expr(text).alias("text"))
        numbered(docs).createOrReplaceTempView("numbered_documents")
        ctes = [c.replace(NUMBERED, "p as (select * from numbered_documents),") for c in ctes]
    names = [t for t in ("documents", "events", "lineitem", "orders", "nation", "embeddings", "benchmark", "pages") if any(re.search(rf"\b(?:from|join) {t}\b", x) for x in [*ctes, query])]
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"with {','.join(ctes)} {query}")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, page, doc_id, r, off, text, ref_text)``."""
    return sql(spark, sf_dir, [PAGE_TEXT], "select * from pages_")


def set_out(rows: DataFrame, *keep: str) -> DataFrame:
    """``(doc, page, *keep, line_no, text, bbox, height)`` of the lines of pages, as on paper."""
    each = rows.select("doc", "page", *keep, F.posexplode(F.split("text", NL)).alias("line_no", "text"))
    x0, y0 = 72.0 + 12 * (F.col("line_no") % 3), 72.0 + 14 * F.col("line_no")
    return each.select("*", rect(x0, y0, x0 + 6.0 * F.char_length("text"), y0 + 12).alias("bbox"), F.lit(842.0).alias("height"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, page, line_no, text, bbox, height)`` of the pages' lines, set out as on paper."""
    return set_out(pages(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, ord, level, title, printed)``. Titles have twelve characters of their pages, and no more is read."""
    return sql(spark, sf_dir, [PAGE_TEXT, ENTRIES], "select * from entries_", HEAD)


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log, line_no, line)``."""
    return sql(spark, sf_dir, [STATUS], "select * from status_")
