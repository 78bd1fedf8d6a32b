"""Tables with one large source: results against DuckDB beyond a thousand pages, and work that is spread whatever the sources are."""

import time

import pytest
from pyspark.sql import functions as F

from leafworks.functions import matching as M
from leafworks.functions import text as X
from leafworks.operators import outline
from leafworks.plans import overlays as O
from leafworks.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def one_source(spark, tmp_path_factory):
    import pandas as pd

    # a line that is cut at a space, and equal formulas on lines of one indent
    text = "the quick brown fox jumps over the lazy dog\nx = b^2\n" + "x = " + "w" * 115 + " " + "tail\nplain\nx = b^2\n\nplain\nx = b^2"
    path = tmp_path_factory.mktemp("one_source")
    pd.DataFrame({"doc_id": range(11000), "text": [text if i < 2500 else f"{text[:40]} {i}" for i in range(11000)], "lang": "en", "source": "src3", "n_chars": 1}).to_parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["corruption_rate", "section_repair", "repair_plan", "decision_plan", "parsed_entries", "applied_decisions", "extraction_route", "resolved_pages"])
def test_one_large_source_against_duckdb(spark, one_source, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{one_source}/documents.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, one_source)
    columns = sorted(want.columns)
    key = lambda rs: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rs)
    names = ", ".join(f'"{c}"' for c in columns)
    assert key(con.sql(f"select {names} from want").fetchall()) == key(got.select(*columns).collect())


def test_pages_of_one_source_are_spread(spark, one_source):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in O.pages(spark, one_source).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 11000 and max(parts) < 0.5 * sum(parts)


def test_numbers_of_pages_with_equal_and_missing_keys(spark):
    docs = [("src1", 4, "c"), ("src1", 1, "a"), ("src1", 1, "b"), (None, None, "d"), (None, None, "e"), (None, 5, "f"), ("src2", None, "g"), ("src2", 2, "h")]
    got = sorted((str(r.doc), r.page, r.text) for r in O.numbered(spark.createDataFrame(docs, "source string, doc_id long, text string")).collect())
    assert [(d, p) for d, p, _ in got] == [("None", 1), ("None", 2), ("None", 3), ("src1", 1), ("src1", 2), ("src1", 3), ("src2", 1), ("src2", 2)]
    at = {t: p for _, p, t in got}
    assert (at["c"], at["f"], at["g"], at["h"]) == (3, 3, 1, 2)


TITLES = ["1.2 Open seas", "12 Numbers of it", "第3章 Wide seas here", "Chapter 4 Long rivers", "Without a number", "7", "", "3.1.4 Pie charts", "ab", "5.5 (x) y z w"]
PAGES = ["1.2 Open seas", "see (1.2) there", "1..2 opn seas", "12", "x12 Numbers of", "第 3 章\nwide seas", "第3章 nothing", "chapter 4\nlong chapter 4 rivers", "numbr without a", "", " \n ", "31.4 pie chart", "5.5", "abc", "第3章 wide seas here", "Without  a\tnumber"]


def test_titles_match_alike_in_both_engines(spark):
    titles = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "i int, title string")
    pages = spark.createDataFrame([(j, p) for j, p in enumerate(PAGES)], "j int, text string")
    want = {(r.i, r.j): r.kind for r in titles.crossJoin(pages).select("i", "j", M.match_kind("title", "text").alias("kind")).collect()}
    assert {k for k in want.values()} >= {"strict", "chapter", "numtok", "fuzzy", None}
    made = {r.i: M.Title(*(r[c] for c in M.TITLE)) for r in M.parts(titles, "title").collect()}
    flat = {r.j: M.Page(r.lines) for r in pages.select("j", F.array_join(F.transform(X.solid_lines(F.col("text")), X.for_match), "\n").alias("lines")).collect()}
    assert {(i, j): made[i].kind(flat[j]) for i, j in want} == want


def test_anchor_scan_holds_no_book_in_a_row(spark):
    pages = spark.createDataFrame([("a", p, f"1.{p} Title number {p}") for p in range(1, 40)] + [("b", 1, "9.9 else")], "doc string, page int, text string")
    entries = spark.createDataFrame([("a", i, f"1.{3 * i} Title number {3 * i}") for i in range(1, 12)] + [("c", 1, "9.9 else")], "doc string, ord long, title string")
    found = outline.anchor_scan(entries, pages)
    assert sorted((r.doc, r.ord, r.physical) for r in found.collect())[:3] == [("a", 1, 3), ("a", 2, 6), ("a", 3, 9)]
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_offsets_are_looked_for_only_where_nothing_is_printed(spark, monkeypatch):
    seen = []
    probe = outline.offset_probe
    monkeypatch.setattr(outline, "offset_probe", lambda e, *a: seen.append(e) or probe(e, *a))
    pages = spark.createDataFrame([("a", p, f"text here\n{p - 2}") for p in range(3, 12)] + [("b", p, "Alpha beta" if p == 3 else "-") for p in range(1, 5)], "doc string, page int, text string")
    entries = spark.createDataFrame([("a", 1, 1, "Text here", 2), ("b", 1, 1, "Alpha beta", 1)], "doc string, ord bigint, level int, title string, printed int")
    got = {r.doc: r.page for r in outline.outline(entries, pages).collect()}
    assert got["b"] == 3 and [r.doc for r in seen[0].collect()] == ["b"]


def test_repetition_in_a_long_text_is_linear(spark):
    lines = [f"line {i}" for i in range(40000)]
    rows = spark.createDataFrame([("\n".join(lines),), ("\n".join([*lines[:200], "line 7", *lines]),)], "text string")
    began = time.time()
    assert [r.n for r in rows.select(F.size(F.split(X.trim_repetition(F.col("text")), "\n")).alias("n")).collect()] == [250, 200]
    assert time.time() - began < 30


def test_claims_are_sorted_once(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("doc"), (F.col("id") % 3).alias("page"), F.col("id").alias("ord"), F.lit("llm").alias("parser"))
    plan = outline.claims(rows, {"llm": 0, "layout": 1})._jdf.queryExecution().sparkPlan().toString()
    prepared = outline.claims(rows, {"llm": 0, "layout": 1})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 2 and prepared.count("Exchange hashpartitioning") == 1


def test_titles_of_answers_are_made_once(spark):
    answers = spark.createDataFrame([("d", 1, 100, '[{"title": "A .... 9", "level": "7", "printed_page": " 12 "}, {"title": "--"}]')], "doc string, page int, total int, answer string")
    found = outline.normalised(answers)
    assert [(r.ord, r.level, r.title, r.printed) for r in found.collect()] == [(0, 3, "A", 12)]
    assert [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line and "regexp_replace" in line] == []
