"""Queries on what surrounds the pages: Markdown files and their frontmatter, sections, kept state, regions' boxes, rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.functions import geometry as G
from leafworks.operators import formula, layout, markdown, quality, regions, state
from leafworks.plans import overlays as O
from leafworks.plans.queries import query, table

NL = O.NL
MD5 = lambda c: F.md5(c).alias("text")

# ---- files

FILES = f"""files_ as (select doc_id,
  concat('b', cast(doc_id % 5 as varchar(20)), '/', case cast(doc_id % 7 as int) when 0 then '00_x' when 1 then '_x' else concat('s', cast(doc_id as varchar(20))) end, case when doc_id % 4 = 3 then '.txt' else '.md' end) as path,
  case cast(doc_id % 3 as int) when 0 then concat('---{NL}title: "T', cast(doc_id as varchar(20)), '"{NL}PDF物理页码: "', cast(doc_id % 50 as varchar(20)), ' - ', cast(doc_id % 50 + doc_id % 6 as varchar(20)), '"{NL}done: ', case when doc_id % 2 = 0 then 'yes' else 'no' end, '{NL}---{NL}', coalesce(text, ''))
    when 1 then concat('---{NL}title: "T"{NL}---{NL}', coalesce(text, '')) else concat('x', coalesce(text, '')) end as text from documents)"""


def _files(spark, sf_dir):
    return O.sql(spark, sf_dir, [FILES], "select * from files_")


@query("select path, concat('T', doc_id) as title, (doc_id % 50)::int as first, (doc_id % 6 + 1)::int as n from files_ where doc_id % 3 = 0 and doc_id % 7 > 1 and doc_id % 4 <> 3", (FILES,))
def section_files(spark, sf_dir):
    found = markdown.sections(_files(spark, sf_dir).select("path", "text"))
    return found.select("path", "title", F.get("pages", F.lit(0)).alias("first"), F.size("pages").alias("n"))


@query(
    f"""select doc_id, doc_id % 6 = 0 as done, md5(case when doc_id % 3 = 0 then replace(text[1:60], '{NL}done: ' || case when doc_id % 2 = 0 then 'yes' else 'no' end, '{NL}done: 3') || text[61:]
          when doc_id % 3 = 1 then concat('---{NL}title: "T"{NL}done: 3', text[15:]) else text end) as text from files_""",
    (FILES,),
)
def frontmatter_keys(spark, sf_dir):
    """A flag read from frontmatter, and texts with the key set: replaced, added, or as they are without frontmatter."""
    c = F.col("text")
    return _files(spark, sf_dir).select("doc_id", markdown.flag(c, "done").alias("done"), MD5(markdown.with_key(c, "done", F.lit("3"))))


AUDITED = f"""audited_ as (select doc_id, coalesce(text, '') as text, concat(coalesce(text, ''), '{NL}<!-- BEGIN AUDIT -->{NL}old{NL}<!-- END AUDIT -->{NL}tail') as held from documents)"""


@query(
    f"""select doc_id, md5(case when doc_id % 2 = 0 then concat(text, '{NL}<!-- BEGIN AUDIT -->{NL}new{NL}<!-- END AUDIT -->{NL}tail') else concat(rtrim(text), '{NL}{NL}<!-- BEGIN AUDIT -->{NL}new{NL}<!-- END AUDIT -->{NL}') end) as text from audited_""",
    (AUDITED,),
)
def report_blocks(spark, sf_dir):
    """Blocks between markers, replaced where they are and added where they aren't; a second time changes nothing."""
    rows = O.sql(spark, sf_dir, [AUDITED], "select doc_id, case when doc_id % 2 = 0 then held else text end as text from audited_")
    once = rows.withColumn("text", markdown.report_block(F.col("text"), F.lit("new")))
    return once.select("doc_id", MD5(markdown.report_block(F.col("text"), F.lit("new"))))


SECTION = "case when n_nationkey >= 12 then concat('_s', cast(n_nationkey - 12 as varchar(10))) else concat('s', cast(n_nationkey as varchar(10))) end"


@query(
    f"""select pdf, arg_max(section, length(section)) as section, 'out/e/c/' || arg_max(section, length(section)) || '/text.md' as path from stems_ left join (select {SECTION} as section from nation) on ends_with(stem, section) group by pdf""",
    ("stems_ as (select concat('in/vol', doc_id, case when doc_id % 2 = 0 then '_s' else '-s' end, doc_id % 15, '.pdf') as pdf, concat('vol', doc_id, case when doc_id % 2 = 0 then '_s' else '-s' end, doc_id % 15) as stem from documents)",),
)
def section_dirs(spark, sf_dir):
    """The section directory that a file's stem ends with, the longest."""
    pdfs = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/vol"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "_s").otherwise("-s"), F.col("doc_id") % 15, F.lit(".pdf")).alias("pdf"))
    name = F.expr(SECTION)
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("out/e/c/"), name, F.lit("/text.md")).alias("path"), F.lit("---").alias("text"))
    return markdown.section_of(pdfs, files)


@query(
    """select path, count(pdf) as candidates, case when count(pdf) = 1 then min(pdf) end as pdf from (select concat('bk', o_orderkey % 10, '/extraction/c', o_orderkey, '/s', o_orderkey % 30, '/text.md') as path, concat('bk', o_orderkey % 10) as book, concat('s', o_orderkey % 30) as section from orders) t
       left join (select concat('bk', n_nationkey % 10, '/pdf/', stem, '.pdf') as pdf, concat('bk', n_nationkey % 10) as book, stem from (select *, case when n_nationkey % 3 = 0 then concat('s', n_nationkey) else concat('x', n_nationkey, '_s', n_nationkey % 10) end as stem from nation)) p
       on p.book = t.book and (p.stem = t.section or ends_with(p.stem, '_' || t.section)) group by path"""
)
def section_sources(spark, sf_dir):
    """The one PDF of its book that a section may come from; others than one are a problem."""
    k, n = F.col("o_orderkey"), F.col("n_nationkey")
    texts = table(spark, sf_dir, "orders").select(F.concat(F.lit("bk"), k % 10, F.lit("/extraction/c"), k, F.lit("/s"), k % 30, F.lit("/text.md")).alias("path"))
    stem = F.when(n % 3 == 0, F.concat(F.lit("s"), n)).otherwise(F.concat(F.lit("x"), n, F.lit("_s"), n % 10))
    pdfs = table(spark, sf_dir, "nation").select(F.concat(F.lit("bk"), n % 10, F.lit("/pdf/"), stem, F.lit(".pdf")).alias("pdf"))
    return markdown.source_pdf(texts, pdfs).withColumn("candidates", F.col("candidates").cast("long"))


# ---- kept state

KEPT = """stored_ as (select distinct user_id as doc, cast(event_id % 3 as varchar(10)) as fingerprint from events),
current_ as (select user_id as doc, cast(max(event_id) % 4 as varchar(10)) as fingerprint from events group by user_id)"""


@query("select doc, fingerprint, not exists (select 1 from stored_ s where s.doc = c.doc and s.fingerprint = c.fingerprint) as stale from current_ c", (KEPT,))
def stale_documents(spark, sf_dir):
    """Documents to do again, and those whose stored rows still hold."""
    stored, current = (O.sql(spark, sf_dir, [KEPT], f"select * from {t}") for t in ("stored_", "current_"))
    return state.stale_documents(stored, current).withColumn("stale", F.lit(True)).unionByName(state.fresh(stored, current).withColumn("stale", F.lit(False)))


@query(
    """select o_custkey as doc, o_orderkey as page, case when o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 then 'new' else 'old' end as verdict from orders where o_orderkey % 2 = 0 or (o_orderkey % 3 = 0 and o_orderkey % 5 <> 0)"""
)
def flushed_pages(spark, sf_dir):
    """State after a batch, whose pages in arbitration aren't kept."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"))
    batch = rows.filter("page % 3 = 0").withColumn("verdict", F.when(F.col("page") % 5 == 0, "arbitrating").otherwise("new"))
    return state.flushed(rows.filter("page % 2 = 0").withColumn("verdict", F.lit("old")), batch, ["doc", "page"])


@query(
    """select path, case when len(m) > 0 then 'missing ' || array_to_string(m, ',') else 'unknown verdict' end as problem from (select doc_id as path, doc_id % 5 as v,
         list_filter([case when doc_id % 4 = 0 then 'fingerprint' end, case when doc_id % 10 = 5 then 'verdict' end, case when doc_id % 6 = 0 then 'pdf' end], lambda x: x is not null) as m from documents) where len(m) > 0 or v = 0"""
)
def cache_problems(spark, sf_dir):
    k = F.col("doc_id")
    verdict = F.when(k % 10 == 5, "").when(k % 5 == 0, "odd").otherwise("ok")
    rows = table(spark, sf_dir, "documents").select(k.alias("path"), F.when(k % 4 == 0, "").otherwise("f").alias("fingerprint"), verdict.alias("verdict"), F.when(k % 6 != 0, "p").alias("pdf"), k.alias("checked_at"))
    return state.entry_problems(rows).select("path", "problem")


JUDGED = """judged_ as (select l_orderkey as doc, l_linenumber as page, concat('f', cast(l_partkey as varchar(20))) as fingerprint,
  case cast(l_suppkey % 5 as int) when 0 then 'ok' when 1 then 'empty' when 2 then 'pending_l3' when 3 then 'unverified' else 'suspect' end as verdict, cast(l_suppkey % 5 as int) as s from lineitem)"""


@query(
    """select doc, ['ok', 'empty', 'pending_l3', 'unverified', 'suspect'][coalesce(sections, pages) + 1] as verdict from (
         select doc, max(s) filter (doc % 2 = 0 and page % 2 = 0) as sections, max(s) filter (doc % 3 <> 0) as pages from judged_ group by doc) where sections is not null or pages is not null""",
    (JUDGED,),
)
def resolved_verdicts(spark, sf_dir):
    """The worst of a document's sections, else of its pages."""
    rows = O.sql(spark, sf_dir, [JUDGED], "select * from judged_")
    return formula.resolve(rows.filter("doc % 2 = 0 and page % 2 = 0"), rows.filter("doc % 3 <> 0").withColumnRenamed("verdict", "page_verdict"))


@query(
    """select doc, page, case when verdict <> 'pending_l3' then verdict when k % 3 = 0 then 'ok' when k % 3 = 1 then 'suspect' else verdict end as verdict from (select *, substr(fingerprint, 2)::int as k from judged_)""",
    (JUDGED,),
)
def cached_decisions(spark, sf_dir):
    """Open regions take the decision that is kept for their fingerprint."""
    part = F.col("p_partkey")
    cache = table(spark, sf_dir, "part").filter(part % 3 != 2).select(F.concat(F.lit("f"), part).alias("fingerprint"), F.when(part % 3 == 0, "passed").otherwise("escalated").alias("status"))
    return formula.with_cached(O.sql(spark, sf_dir, [JUDGED], "select * from judged_"), cache).select("doc", "page", "verdict")


@query("select doc, page, case when verdict = 'ok' then 'ok' else concat(verdict, '(', page, ' 区)') end as value from judged_", (JUDGED,))
def projected_verdicts(spark, sf_dir):
    rows = O.sql(spark, sf_dir, [JUDGED], "select * from judged_")
    return rows.select("doc", "page", formula.projection(F.col("verdict"), F.col("page").cast("int")).alias("value"))


@query("select doc_id, sha256(text) as fingerprint from documents")
def source_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formula.source_fingerprint(F.col("text").cast("binary")).alias("fingerprint"))


# ---- regions


@query("select l_orderkey as doc, l_linenumber as page, l_partkey as ord, 'new' as source from lineitem where l_orderkey % 3 = 0 and l_linenumber % 2 = 0 union all select l_orderkey, l_linenumber, l_partkey, 'old' from lineitem where l_orderkey % 3 <> 0")
def merged_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("ord"))
    done = rows.filter("doc % 3 = 0")
    return regions.merged(rows.withColumn("source", F.lit("old")), done.filter("page % 2 = 0").withColumn("source", F.lit("new")), done.select("doc", "page").distinct())


SIDES = "sides_ as (select l_orderkey as doc, l_linenumber % 2 as page, l_linenumber as ord, case when l_partkey % 3 = 0 then 'layout' else 'span' end as source from lineitem)"


@query("select doc, page, ord, source from sides_ qualify source = case when bool_or(source = 'layout') over (partition by doc, page) then 'layout' else 'span' end", (SIDES,))
def ruling_regions(spark, sf_dir):
    """Layout regions where a page has any, else span regions."""
    return regions.ruling(O.sql(spark, sf_dir, [SIDES], "select * from sides_"))


@query(
    """select o_orderkey as doc, n.p as page, coalesce(array_to_string(list(s.ord || s.source order by s.ord, s.source) filter (s.ord is not null), ','), '') as regions from orders cross join (select unnest([0, 1, 2]) as p) n
       left join sides_ s on s.doc = o_orderkey and s.page = n.p group by all""",
    (SIDES,),
)
def regions_on_pages(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(*map(F.lit, range(3)))).alias("page"))
    found = regions.on_pages(wanted, O.sql(spark, sf_dir, [SIDES], "select * from sides_"))
    return found.select("doc", "page", F.array_join(F.transform("regions", lambda r: F.concat(r["ord"], r["source"])), ",").alias("regions"))


BOXES = """rows_ as (select l_orderkey as doc, l_partkey as p, l_suppkey as s, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as int) as ord from lineitem),
boxes_ as (select doc, 1 as page, ord, case cast(p % 6 as int) when 0 then 'Formula' when 1 then 'table' when 2 then 'text' when 3 then 'formula_number' when 4 then 'inline_formula' else 'equation' end as label,
  cast(s % 50 as double) as x0, cast(ord * 20 + p % 15 as double) as y0, cast(s % 50 + 100 + s % 7 as double) as x1, cast(ord * 20 + p % 15 + 30 as double) as y1 from rows_)"""


@query(
    """select r.doc, r.ord, r.class, r.x0 / 2 as x0, least(r.y0, coalesce(g.y0, r.y0)) / 2 as y0, greatest(r.x1, coalesce(g.x1, r.x1)) / 2 as x1, greatest(r.y1, coalesce(g.y1, r.y1)) / 2 as y1 from c_ r left join (
         select doc, ord, min(ny0) as y0, max(nx1) as x1, max(ny1) as y1 from (select n.doc, n.ord as n, n.y0 as ny0, n.x1 as nx1, n.y1 as ny1, min(f.ord) as ord from boxes_ n join c_ f on f.doc = n.doc and f.class = 'isolated_formula' and f.y0 <= n.y1 and n.y0 <= f.y1
           where n.label = 'formula_number' group by all) group by doc, ord) g on g.doc = r.doc and g.ord = r.ord and r.class = 'isolated_formula'""",
    (BOXES, "c_ as (select *, case label when 'table' then 'table' when 'inline_formula' then 'formula' else 'isolated_formula' end as class from boxes_ where label not in ('text', 'formula_number'))"),
)
def layout_boxes(spark, sf_dir):
    """Boxes at half size: listed labels only, formulas widened by the numbers beside them."""
    rows = O.sql(spark, sf_dir, [BOXES], "select * from boxes_").withColumn("bbox", F.array("x0", "y0", "x1", "y1"))
    sized = rows.withColumns({"width": F.lit(500.0), "height": F.lit(800.0), "page_width": F.lit(250.0), "page_height": F.lit(400.0)})
    return regions.layout_regions(sized).select("doc", "ord", "class", "bbox.*")


@query("select doc, page, source, ord, cast(row_number() over (partition by doc, page order by y, x, source) - 1 as int) as place from (select doc, page, case when ord % 2 = 0 then 'layout' else 'span' end as source, ord, y1 - ord * 20 as y, x0 + ord / 100 as x from boxes_)", (BOXES,))
def reading_order(spark, sf_dir):
    """Regions of both kinds in one reading order."""
    y = F.col("y1") - F.col("ord") * 20
    rows = O.sql(spark, sf_dir, [BOXES], "select * from boxes_").select("doc", "page", "ord", F.col("ord").alias("id"), G.rect(F.col("x0") + F.col("ord") / 100, y, F.col("x1"), y + 1).alias("bbox"), F.when(F.col("ord") % 2 == 0, "layout").otherwise("span").alias("source"))
    found = regions.all_regions(rows.filter("source = 'span'"), rows.filter("source = 'layout'"))
    return found.select("doc", "page", "source", F.col("id").alias("ord"), F.col("ord").alias("place"))


# ---- rasters


@query("select o_orderkey::varchar as doc, case when o_orderkey % 13 = 0 then 1.0 else (o_orderkey % 101) / 100 end as ink from orders")
def page_ink(spark, sf_dir):
    """The share of dark pixels; an image that is cut short counts as all ink."""
    k = F.col("o_orderkey")
    dark = (k % 101).cast("int")
    grey = F.concat(F.repeat(F.lit("00"), dark), F.repeat(F.lit("ff"), F.when(k % 13 == 0, F.lit(0)).otherwise(F.greatest(100 - dark, F.lit(0)))))
    grey = F.when(k % 13 == 0, F.lit("00")).otherwise(grey)
    images = table(spark, sf_dir, "orders").select(k.cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.unhex(grey).alias("grey"))
    return layout.page_ink(images).select("doc", "ink")


@query(
    """select doc, cast(row_number() over (partition by doc order by y0) - 1 as int) as ord, y0::int as y0, y1::int as y1, x from (
         select doc, (k % 2)::double as x, unnest(case when c > 3 then [[a, a + b - 1], [a + b + c, a + b + c + d - 1]] else [[a, a + b + c + d - 1]] end) as band, band[1] as y0, band[2] as y1 from bands_) where y1 - y0 + 1 >= 7""",
    ("bands_ as (select o_orderkey::varchar as doc, o_orderkey as k, o_orderkey % 5 as a, o_orderkey % 12 + 1 as b, o_orderkey % 7 + 1 as c, o_orderkey % 10 + 1 as d from orders)",),
)
def raster_rows(spark, sf_dir):
    """Text lines on images of two dark bands, which are one where the gap is small."""
    k = F.col("o_orderkey")
    inked = F.when(k % 2 == 1, "ff" + "00" * 7).otherwise("00" * 8)
    part = lambda row, n: F.repeat(row, n.cast("int"))
    a, b, c, d = k % 5, k % 12 + 1, k % 7 + 1, k % 10 + 1
    blank = F.lit("ff" * 8)
    grey = F.concat(part(blank, a), part(inked, b), part(blank, c), part(inked, d))
    images = table(spark, sf_dir, "orders").select(k.cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(8).alias("width"), (a + b + c + d).cast("int").alias("height"), F.unhex(grey).alias("grey"))
    return layout.raster_rows(images).drop("page")


@query("select l_orderkey as doc, round(avg(case when l_linenumber % 3 > 0 then l_quantity end), 6) as confidence from lineitem group by all")
def mean_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("confidence"))
    return quality.mean_confidence(rows, "doc").withColumn("confidence", F.round("confidence", 6))
