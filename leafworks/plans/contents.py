"""Queries on tables of contents: gates, claims, recovered numbers, anchors, shifts. Customers stand for books and
their orders for entries; places that need texts run on the pages of the overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.functions import numbers as N
from leafworks.operators import outline, quality
from leafworks.plans import overlays as O
from leafworks.plans.queries import ORACLE_SQL, SCORED, SHAPES, kinds, query, table

BOOKS = """
books_ as (
  select o_custkey as doc, o_orderkey as k, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as ord,
         concat('t', cast(o_orderkey % 7 as varchar(10))) as title, cast(o_orderkey % 3 + 1 as int) as level,
         cast(case when o_orderkey % 5 = 0 then null else o_orderkey % 30 + 9 * row_number() over (partition by o_custkey order by o_orderkey) end as int) as printed
  from orders)"""


def _books(spark, sf_dir):
    return O.sql(spark, sf_dir, [BOOKS], "select * from books_")


@query(
    """select doc, entries, numbered, inversions, case when entries < 4 then 'too few entries' when numbered < 0.5 * entries then 'few printed pages' when inversions > 0.2 * greatest(1, numbered - 1) then 'noisy sequence' end as reason
       from (select doc, count(*) as entries, count(printed) as numbered, count(*) filter (printed < before)::bigint as inversions
             from (select *, lag(printed ignore nulls) over (partition by doc order by ord) as before from books_) group by doc)""",
    (BOOKS,),
)
def contents_gate(spark, sf_dir):
    return outline.chunk_gate(_books(spark, sf_dir))


@query(
    """select doc, page, ord, parser from (select *, min(r) over (partition by doc, page) as own, min(r) over (partition by doc) as top from c_) where r = own and (top > 0 or r = 0)""",
    ("c_ as (select l_orderkey as doc, l_linenumber % 3 as page, l_linenumber as ord, l_suppkey % 3 as r, ['llm', 'layout', 'transcript'][l_suppkey % 3 + 1] as parser from lineitem)",),
)
def parser_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in ("llm", "layout", "transcript")])
    entries = rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_linenumber").alias("ord"), F.element_at(names, (F.col("l_suppkey") % 3 + 1).cast("int")).alias("parser"))
    return outline.claims(entries, {"llm": 0, "layout": 1, "transcript": 2})


# the longest non-falling subsequence by its definition: lengths one after the other, then the way back from the first longest
RISING = """
lis_ as (select doc, i, [n] as ns, [1::bigint] as ls from strip_ where i = 1 union all
  select c.doc, c.i, list_append(r.ns, c.n), list_append(r.ls, 1 + coalesce(list_max(list_transform(list_filter(range(1, c.i), lambda j: r.ns[j] <= c.n), lambda j: r.ls[j])), 0))
  from lis_ r join strip_ c on c.doc = r.doc and c.i = r.i + 1),
whole_ as (select doc, arg_max(ns, i) as ns, arg_max(ls, i) as ls from lis_ group by doc),
back_ as (select doc, ns, ls, list_position(ls, list_max(ls))::bigint as pos from whole_ union all
  select doc, ns, ls, below[1] from (select doc, ns, ls, list_filter(range(1, pos), lambda j: ls[j] = ls[pos] - 1 and ns[j] <= ns[pos]) as below, pos from back_ where ls[pos] > 1)),
kept_ as (select s.doc, s.ord, s.n from back_ b join strip_ s on s.doc = b.doc and s.i = b.pos)"""


@query("select doc, ord, n from kept_", (BOOKS, "strip_ as (select doc, ord, printed as n, row_number() over (partition by doc order by ord) as i from books_ where printed is not null)", RISING))
def rising_numbers(spark, sf_dir):
    return outline.longest_rising(_books(spark, sf_dir).filter("printed is not null").select("doc", "ord", F.col("printed").alias("n")))


STRIP = "select doc, ord, cast(case when ord % 11 = 0 then 3 else ord * 2 end as int) as n from entries_ where ord % 9 <> 0 and (ord % 2 = 0 or doc not like '%3')"


@query(
    """select e.doc, e.ord, coalesce(f.n, e.printed) as printed from entries_ e left join (
         select k.doc, row_number() over (partition by k.doc order by k.ord) + g.short as ord, k.n from kept_ k join (
           select doc, e.n - k.n as short from (select doc, count(*) as n, bool_and(n between 1 and 999) as fine from kept_ group by doc) k join (select doc, count(*) as n from strip_ group by doc) s using (doc)
             join (select doc, count(*) as n from entries_ group by doc) e using (doc) where k.n >= 3 and k.n >= 0.7 * s.n and e.n - k.n between 0 and 8 and k.fine) g using (doc)) f on f.doc = e.doc and f.ord = e.ord""",
    (O.PAGE_TEXT, O.ENTRIES, f"strip_ as (select *, row_number() over (partition by doc order by ord) as i from ({STRIP}))", RISING),
)
def recovered_numbers(spark, sf_dir):
    entries = O.entries(spark, sf_dir)
    strip = O.sql(spark, sf_dir, [O.PAGE_TEXT, O.ENTRIES], STRIP, O.HEAD)
    return outline.recovered_numbers(entries, strip).select("doc", "ord", "printed")


@query(
    """select doc, ord, physical, kind as anchor_kind from (select doc, page, pos, unnest(case when hit is null then [] else [hit] end) as h from scan_) s, lateral (select s.h.ord as ord, s.page as physical, s.h.kind as kind)""",
    (
        O.PAGE_TEXT,
        O.ENTRIES,
        "all_ as (select e.doc, e.ord, p.page, e.title, p.text from entries_ e join pages_ p on p.doc = e.doc)",
        kinds("all_", False),
        "found_ as materialized (select doc, page, list({'ord': ord, 'kind': kind} order by ord) as f from kind_ where kind is not null group by all)",
        """turns_ as materialized (select p.doc, p.page, f.f, row_number() over (partition by p.doc order by p.page) as i from pages_ p left join found_ f using (doc, page))""",
        """scan_ as (select doc, 0::bigint as i, 0::int as page, 0::bigint as pos, null::struct(ord bigint, kind varchar) as hit from (select distinct doc from entries_) union all
             select doc, i, page, coalesce(hit.ord, pos), hit from (select t.doc, t.i, t.page, s.pos, list_filter(t.f, lambda x: x.ord > s.pos and x.ord <= s.pos + 8)[1] as hit
               from scan_ s join turns_ t on t.doc = s.doc and t.i = s.i + 1))""",
    ),
)
def anchor_places(spark, sf_dir):
    """Entries found by one pass over the pages: each page may take one of the next eight."""
    return outline.anchor_scan(O.entries(spark, sf_dir), O.pages(spark, sf_dir))


PLACES = "places_ as (select *, cast(case when k % 7 = 0 then null else ord * 4 - case when k % 23 = 0 then 9 else 0 end end as int) as physical from books_)"


@query(
    """select doc, case when chapters = 0 and n < 5 then 'too few entries' when chapters > 0 and hit < greatest(1, floor(chapters * 0.6 + 0.999)) then 'coverage' when back > 0 then 'non-monotonic' end as reason
       from (select doc, count(*) as n, count(*) filter (level = 1) as chapters, count(physical) filter (level = 1) as hit, count(*) filter (physical < before) as back
             from (select *, lag(physical ignore nulls) over (partition by doc order by ord) as before from places_) group by doc)""",
    (BOOKS, PLACES),
)
def anchor_gates(spark, sf_dir):
    return outline.anchor_gate(O.sql(spark, sf_dir, [BOOKS, PLACES], "select * from places_")).select("doc", "reason")


@query(
    """select doc, total, accepted, written, greatest(4, total // 60, floor(accepted * 0.5))::bigint as floor, written >= greatest(4, total // 60, floor(accepted * 0.5)) as kept
       from (select doc, max(k) as total, count(*) as accepted, count(physical) as written from places_ group by doc)""",
    (BOOKS, PLACES),
)
def structure_gates(spark, sf_dir):
    counts = O.sql(spark, sf_dir, [BOOKS, PLACES], "select doc, max(k) as total, count(*) as accepted, count(physical) as written from places_ group by doc")
    out = outline.structure_gate(counts)
    return out.withColumn("floor", F.col("floor").cast("long"))


@query("select doc, ord, cast(row_number() over (partition by doc order by physical, ord) as int) as position from places_ where physical is not null", (BOOKS, PLACES))
def outline_order(spark, sf_dir):
    return outline.reading_order(O.sql(spark, sf_dir, [BOOKS, PLACES], "select * from places_")).select("doc", "ord", "position")


@query(
    """select doc, ord, case when fine then page + shift else page end as page, fine as applied from (select p.doc, p.ord, p.physical as page, s.shift,
         bool_and(s.shift <> 0 and p.physical + s.shift between 1 and s.total) over (partition by p.doc) as fine from places_ p join shifts_ s using (doc) where p.physical is not null)""",
    (BOOKS, PLACES, "shifts_ as (select doc, cast(doc % 5 - 2 as int) as shift, max(ord) * 4 as total from books_ where doc % 6 <> 0 group by doc)"),
)
def outline_shifts(spark, sf_dir):
    rows = O.sql(spark, sf_dir, [BOOKS, PLACES], "select doc, ord, physical as page from places_ where physical is not null")
    books = O.sql(spark, sf_dir, [BOOKS], "select doc, cast(doc % 5 - 2 as int) as shift, max(ord) * 4 as total from books_ group by doc")
    return outline.shifted(rows, books.filter("doc % 6 <> 0").select("doc", "shift"), books.select("doc", "total")).select("doc", "ord", "page", "applied")


@query(
    """select doc, ord, case when not (physical between 1 and total) then 'page out of range' when not (lv between 1 and 8) then 'level invalid' end as problem
       from (select *, max(ord) over (partition by doc) * 4 - 2 as total, cast(k % 10 as int) as lv from places_) where physical is not null""",
    (BOOKS, PLACES),
)
def outline_problems(spark, sf_dir):
    rows = O.sql(spark, sf_dir, [BOOKS, PLACES], "select doc, ord, physical as page, cast(k % 10 as int) as level from places_ where physical is not null")
    totals = _books(spark, sf_dir).groupBy("doc").agg((F.max("ord") * 4 - 2).alias("total"))
    return outline.valid_outline(rows, totals).select("doc", "ord", "problem")


@query("select doc, ord from (select doc, ord, ord - 1 as i, count(*) over (partition by doc) as n from books_) b where n <= 5 or i in (select round_even(j * (b.n - 1) / 4, 0) from (select unnest(range(5)) as j))", (BOOKS,))
def even_entries(spark, sf_dir):
    return outline.even_sample(_books(spark, sf_dir)).select("doc", "ord")


@query("select doc, ord from books_ qualify row_number() over (partition by doc order by md5(concat_ws(':', 's', doc, ord)), ord) <= 4", (BOOKS,))
def sampled_entries(spark, sf_dir):
    return outline.sampled_entries(_books(spark, sf_dir), 4, "s").select("doc", "ord")


@query("select doc, 'level' as counter, level::varchar as value, count(*) as n from books_ group by all union all select doc, 'method', title, count(*) from books_ group by all", (BOOKS,))
def outline_counters(spark, sf_dir):
    return outline.counters(_books(spark, sf_dir).withColumnRenamed("title", "method"), "level", "method")


LISTED = f"listed_ as (select doc, page, replace(text, 'a ', ' 12{O.NL}') as text from pages_)"


@query(
    "select doc, page, case when c.garble < 0.05 and s.trails >= 5 then 'textlayer' else 'doc-parser' end as route from scored_ c join shaped_ s using (doc, page)",
    (O.PAGE_TEXT, LISTED, SCORED.replace("from pages_", "from listed_"), SHAPES.replace("from pages_", "from listed_")),
)
def transcription_routes(spark, sf_dir):
    pages = O.sql(spark, sf_dir, [O.PAGE_TEXT, LISTED], "select * from listed_")
    return outline.transcription_route(quality.score_pages(pages), outline.page_shapes(pages))


ANSWERS = f"""answers_ as (select o_custkey as doc, cast(o_orderkey % 9 as int) as page, o_orderkey as k, 100 as total,
  concat('```json{O.NL}[{{"title": "Part ', cast(o_orderkey as varchar(20)), ' .... ', cast(o_orderkey % 90 as varchar(20)), '", "level": "', cast(o_orderkey % 5 as varchar(20)), '", "printed_page": "', cast(o_orderkey % 400 as varchar(20)), '"}}, {{"title": "--", "level": "x"}}, {{"title": "Nr ', cast(o_orderkey as varchar(20)), 'x", "printed_page": " iv"}}]{O.NL}```') as answer from orders)"""


@query(
    """select doc, page, 0 as ord, greatest(1, least(3, k % 5))::int as level, concat('Part ', k) as title, case when k % 400 between 1 and 300 then (k % 400)::int end as printed from answers_
       union all select doc, page, 2, 2, concat('Nr ', k, 'x'), null from answers_""",
    (ANSWERS,),
)
def model_entries(spark, sf_dir):
    """Entries out of fenced JSON answers, without leaders, page numbers in titles and entries that say nothing."""
    return outline.normalised(O.sql(spark, sf_dir, [ANSWERS], "select * from answers_"))


SPEC = "concat(cast(l_linenumber as varchar(10)), ', ', cast(l_suppkey % 9 as varchar(10)), '-', cast(l_suppkey % 9 + l_partkey % 4 as varchar(10)))"


@query("select l_orderkey, l_linenumber, list_sort(list_distinct(list_concat([l_linenumber::bigint], range(l_suppkey % 9, l_suppkey % 9 + l_partkey % 4 + 1))))::varchar as pages from lineitem")
def page_specs(spark, sf_dir):
    pages = N.page_spec(F.expr(SPEC.replace("varchar(10)", "string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join(pages, ", "), F.lit("]")).alias("pages"))


TWENTY = "'一,二,三,四,五,六,七,八,九,十,十一,十二,十三,十四,十五,十六,十七,十八,十九,二十'"
HEADINGS = f"heads_ as (select o_orderkey as k, case cast(o_orderkey % 5 as int) when 0 then concat('第 ', cast(o_orderkey % 31 as varchar(10)), ' 章 x') when 1 then concat('第', split_part({TWENTY}, ',', cast(o_orderkey % 20 + 1 as int)), '章') when 2 then concat('Chapter ', cast(o_orderkey % 31 as varchar(10))) when 3 then concat(cast(o_orderkey % 40 as varchar(10)), '章') else 'other' end as title from orders)"


@query("select k, case when k % 5 in (0, 2) then (k % 31)::int when k % 5 = 1 then (k % 20 + 1)::int end as number, k % 5 <> 4 as chapter from heads_", (HEADINGS,))
def chapter_numbers(spark, sf_dir):
    return O.sql(spark, sf_dir, [HEADINGS], "select * from heads_").select("k", N.chapter_number(F.col("title")).alias("number"), N.is_chapter(F.col("title")).alias("chapter"))


for _name in ("rising_numbers", "recovered_numbers", "anchor_places"):
    ORACLE_SQL[_name] = "with recursive " + ORACLE_SQL[_name].removeprefix("with ")
