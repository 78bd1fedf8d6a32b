"""Operators against small tables: the cases that the specification gives, and corner cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafworks.functions import geometry as G
from leafworks.operators import agreement, formula, layout, markdown, outline, quality, regions, segments, state
from leafworks.streaming import status


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tiers(spark):
    texts = [("t", "A readable page of text."), ("u", "�" * 30), ("w", "中 文 中 文 中 文 中 文 中 文 中 文"), ("e", "short"), ("s", "- 12 -"), ("n", None), ("b", " \n ")]
    pages = spark.createDataFrame(texts, "doc string, text string")
    got = dict(rows(quality.score_pages(pages), "doc", "tier"))
    assert got == {"t": "trusted", "u": "untrusted", "w": "washable", "e": "empty", "s": "empty", "n": "empty", "b": "empty"}
    stub = quality.score_pages(pages).filter("doc = 's'").first()
    assert (stub.chars, stub.reason) == (0, "page-number stub")


def test_sparse_section(spark):
    mapped = spark.createDataFrame([("d", "t", "p", [40, 41, 42])], "doc string, title string, path string, pages array<int>")
    audited = spark.createDataFrame([("d", 41, "suspect"), ("d", 42, "trusted")], "doc string, page int, verdict string")
    got = agreement.sections(mapped, audited).first()
    assert (got.audited, got.suspect_pages, got.suspect_ratio, got.auto_repair) == (2, [41], 0.5, True)
    assert agreement.repair_plan(agreement.sections(mapped, audited)).first().estimate_s == 30


def test_page_marker(spark):
    routed = spark.createDataFrame([("d", 1, "page one"), ("d", 2, "")], "doc string, page int, out_text string")
    text = quality.assembled(routed).first().text
    assert text.split("\n")[:3] == ["<!-- PDF_PAGE: 1 -->", "", "page one"]
    assert text.endswith("[No text extracted from page 2]")
    back = markdown.line_pages(spark.createDataFrame([("f", "---\ntitle: x\n---\n" + text)], "path string, text string"))
    assert {r.page for r in back.collect()} == {1, 2} and back.first()["mode"] == "explicit"


def _book(offsets):
    return [("d", i + 1, f"text of a page\n{i + 1 - o}" if o is not None else "nothing here") for i, o in enumerate(offsets)]


def reference_segments(per_page):
    """Runs and gaps by a plain loop."""
    total, runs, i = len(per_page), [], 0
    while i < total:
        j = i
        while j + 1 < total and per_page[j + 1] == per_page[i]:
            j += 1
        if per_page[i] is not None and j - i + 1 >= 4:
            runs.append([i + 1, j + 1, per_page[i]])
        i = j + 1
    if not runs:
        return [(1, total, 0)]
    owner = [None] * total
    for k, (a, b, o) in enumerate(runs):
        low = 1 if k == 0 else runs[k - 1][1] + (a - runs[k - 1][1] - 1) // 2 + 1
        high = total if k + 1 == len(runs) else b + (runs[k + 1][0] - b - 1) // 2
        owner[low - 1 : high] = [o] * (high - low + 1)
    out = []
    for p, o in enumerate(owner, 1):
        if out and out[-1][2] == o:
            out[-1][1] = p
        else:
            out.append([p, p, o])
    return [tuple(x) for x in out]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 0, 2, 3]), st.integers(1, 7)), min_size=1, max_size=6))
def test_segments_partition_the_pages(spark, parts):
    offsets = [o for o, n in parts for _ in range(n)]
    offsets = [o if o is None or i + 1 - o >= 1 else None for i, o in enumerate(offsets)]
    pages = spark.createDataFrame(_book(offsets), "doc string, page int, text string")
    got = rows(segments.segments(pages), "start", "end", "offset")
    assert got == reference_segments(offsets)
    assert [p for a, b, _ in got for p in range(a, b + 1)] == list(range(1, len(offsets) + 1))


def test_resolve_clamps(spark):
    found = spark.createDataFrame([("d", 1, 10, 2), ("d", 11, 20, 3)], "doc string, start int, end int, offset int")
    asked = spark.createDataFrame([("d", 5), ("d", 10), ("d", 99), ("d", None)], "doc string, printed int")
    assert {r.printed: r.physical for r in segments.resolve(asked, found).collect()} == {5: 7, 10: 13, 99: 20, None: None}


def test_repaired_flag_and_order_of_verdicts(spark):
    got = formula.judge(
        spark.createDataFrame(
            [("a", "e^x^2 + 中文）", "span", "trusted", True), ("b", "e^x^2 + 中文）", "span", "trusted", False), ("c", "x=y", "span", "trusted", False), ("d", "", "layout", "empty", False), ("e", "", "span", "empty", False), ("f", None, "span", "trusted", False)],
            "k string, text string, source string, tier string, repaired boolean",
        )
    )
    assert dict(rows(got, "k", "verdict")) == {"a": "ok", "b": "suspect", "c": "pending_l3", "d": "unverified", "e": "empty", "f": "empty"}


def test_decisions(spark):
    schema = "doc string, page int, ord int, fingerprint string, text string, verdict string"
    judged = spark.createDataFrame([("d", 1, i, f"f{i}", "x^i/2", "pending_l3") for i in range(5)], schema)
    plan = formula.decision_plan(judged)
    assert rows(plan.groupBy("action").count(), "action", "count") == [("hold", 2), ("sample", 3)]
    checks = spark.createDataFrame([("d", 1, f"f{i}", "escalated", None, 1) for i in range(5)] + [("d", 1, "gone", "passed", None, 1)], "doc string, page int, region_fingerprint string, status string, method string, seq int")
    after, stale = formula.apply_decisions(judged, checks)
    assert {r.verdict for r in after.collect()} == {"suspect"} and stale.count() == 1
    assert formula.page_verdicts(after, "doc", "page").first().page_verdict == "suspect"


def test_unknown_status_is_an_error(spark):
    judged = spark.createDataFrame([("d", 1, 0, "f", "x", "pending_l3")], "doc string, page int, ord int, fingerprint string, text string, verdict string")
    checks = spark.createDataFrame([("d", 1, "f", "maybe", "m", 1)], "doc string, page int, region_fingerprint string, status string, method string, seq int")
    with pytest.raises(Exception, match="unsupported"):
        formula.apply_decisions(judged, checks)[0].collect()


def test_clusters_keep_columns_apart(spark):
    box = lambda x, y: (x, y, x + 100.0, y + 10.0)
    data = [("d", 1, 800.0, box(50.0, 100.0), "x = 1"), ("d", 1, 800.0, box(50.0, 112.0), "y"), ("d", 1, 800.0, box(300.0, 101.0), "plain"), ("d", 1, 800.0, box(50.0, 200.0), "far"), ("d", 1, 800.0, box(50.0, 1.0), "head")]
    lines = spark.createDataFrame(data, f"doc string, page int, height double, bbox {regions.BOX}, text string")
    got = rows(regions.span_regions(lines), "text", "class")
    assert got == [("far", "suspect_nonprose"), ("plain", "suspect_nonprose"), ("x = 1 / y", "formula")]


def test_ruling_prefers_layout(spark):
    found = spark.createDataFrame([("d", 1, 0, "span"), ("d", 1, 1, "layout"), ("d", 2, 0, "span")], "doc string, page int, ord int, source string")
    assert rows(regions.ruling(found), "page", "source") == [(1, "layout"), (2, "span")]


def test_layout_number_joins_first_formula(spark):
    data = [("d", 1, 0, "formula", [0.0, 0.0, 10.0, 10.0]), ("d", 1, 1, "formula_number", [90.0, 5.0, 99.0, 12.0]), ("d", 1, 2, "nonsense", [0.0, 0.0, 1.0, 1.0])]
    boxes = spark.createDataFrame([(*r, 100.0, 100.0, 100.0, 100.0) for r in data], "doc string, page int, ord int, label string, bbox array<double>, width double, height double, page_width double, page_height double")
    got = regions.layout_regions(boxes).collect()
    assert [tuple(r.bbox) for r in got] == [(0.0, 0.0, 99.0, 12.0)]


def test_outline_order_and_clamp(spark):
    entries = spark.createDataFrame([("d", 1, 3, "a", 2), ("d", 2, 3, "b", 2), ("d", 3, 1, "c", 3), ("d", 4, 4, "e", 3)], "doc string, ord bigint, level int, title string, physical int")
    ordered = outline.reading_order(entries)
    assert [r.title for r in ordered.orderBy("position").collect()] == ["a", "b", "c", "e"]
    got = rows(outline.clamped(entries), "ord", "outline_level")
    assert got == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_book_outline(spark):
    pages = spark.createDataFrame([("b", 1, "目录\n第1章 入门 2\n1.1 观察 2\n第2章 方法 3\n2.1 比较 3"), ("b", 2, "第1章 入门\n1.1 观察"), ("b", 3, "第2章 方法\n2.1 比较")], "doc string, page int, text string")
    entries = spark.createDataFrame([("b", 1, 1, "第1章 入门", 2), ("b", 2, 2, "1.1 观察", 2), ("b", 3, 1, "第2章 方法", 3), ("b", 4, 2, "2.1 比较", 3)], "doc string, ord bigint, level int, title string, printed int")
    got = outline.outline(entries, pages).orderBy("position").collect()
    assert [(r.level, r.title, r.page) for r in got] == [(1, "第1章 入门", 2), (2, "1.1 观察", 2), (1, "第2章 方法", 3), (2, "2.1 比较", 3)]
    scanned = outline.anchor_scan(entries, pages.filter("page > 1")).collect()
    assert {r.physical for r in scanned} <= {2, 3} and scanned


def test_source_resolution(spark):
    texts = spark.createDataFrame([("book/extraction/chapter/section/text.md",)], "path string")
    pdfs = spark.createDataFrame([("book/split_pdfs/book_section.pdf",), ("book/split_pdfs/book_other.pdf",)], "pdf string")
    assert markdown.source_pdf(texts, pdfs).first().pdf == "book/split_pdfs/book_section.pdf"


def test_frontmatter(spark):
    files = spark.createDataFrame([("x/a.md", '---\ntitle: "T"\nPDF物理页码: "3-5"\ndone: yes\n---\nbody'), ("x/00_b.md", "---\n---\n"), ("x/c.md", "no")], "path string, text string")
    assert [(r.title, r.pages) for r in markdown.sections(files).collect()] == [("T", [3, 4, 5])]
    out = files.select(markdown.with_key(F.col("text"), "audit", F.lit("ok")).alias("t"), markdown.flag(F.col("text"), "done").alias("f")).collect()
    assert "audit: ok\n---\nbody" in out[0].t and out[0].f and out[2].t == "no" and not out[2].f


def test_status_lines(spark):
    lines = [
        "noise", "PROGRESS phase=read done=1 total=9 failed=0 elapsed_s=4", "PROGRESS phase=x done=1 done=2 total=3 failed=0 elapsed_s=0", "PROGRESS phase=x done=-1 total=3 failed=0 elapsed_s=0",
        'RESULT {"phase":"p","status":"ok","done":true,"total":1,"failed":0,"elapsed_s":1}', 'RESULT {"phase":"p","status":"ok","done":1,"total":1,"failed":0,"elapsed_s":1}', "RESULT {bad",
        'ERROR {"status":"error","phase":"p","done":1,"total":1,"failed":1,"elapsed_s":1,"command":"c","code":"e","message":""}', 'ERROR {"status":"error","phase":"p","done":1,"total":1,"failed":1,"elapsed_s":1}',
    ]
    log = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    kinds = [r.kind for r in status.parsed(log).orderBy("line_no").collect()]
    assert kinds == [None, "PROGRESS", None, None, None, "RESULT", None, "ERROR", None]
    assert status.last_valid(log).first().line == lines[7]
    made = spark.range(1).select(status.progress_line(F.lit(" a  b "), F.lit(-3), F.lit(3), F.lit(0), F.lit(0)).alias("x")).first().x
    assert made == "PROGRESS phase=a_b done=0 total=3 failed=0 elapsed_s=0"


def test_status_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("PROGRESS phase=p done=1 total=3 failed=0 elapsed_s=0\nnoise\n")
    status.watch(spark, f"{tmp_path}/logs", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert [(r.phase, r.done) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("p", 1)]


def test_state(spark):
    entry = "path string, fingerprint string, verdict string, checked_at int"
    old, new = spark.createDataFrame([("a", "1", "ok", 1), ("b", "1", "suspect", 5)], entry), spark.createDataFrame([("a", "2", "suspect", 2), ("b", "1", "ok", 4)], entry)
    latest = state.upsert(old, new)
    assert rows(latest, "path", "verdict") == [("a", "suspect"), ("b", "suspect")]
    asked = spark.createDataFrame([("a", "2"), ("b", "9"), ("c", "1")], "path string, fingerprint string")
    assert {r.path: (r.verdict, r.stale) for r in state.lookup(asked, latest).collect()} == {"a": ("suspect", False), "b": (None, True), "c": (None, False)}
    with pytest.raises(Exception, match="blocked"):
        state.require_ok(state.lookup(asked, latest)).collect()


def test_batch_is_partial(spark):
    runs = spark.createDataFrame([("x", "failed"), ("y", "ok"), ("z", "skipped")], "book string, status string")
    assert tuple(state.batch_summary(runs).first()) == ("partial", 1, 3, 1, 1)


def test_ink():
    import numpy as np

    grey = np.full((60, 50), 255, np.uint8)
    grey[10:20, 5:30] = 0
    grey[22:30, 8:30] = 0
    grey[45:47, 8:30] = 0
    assert layout.line_bands(grey) == [(10, 29)]
    assert layout.left_edge(grey, (10, 19)) == 5
    assert layout.ink_ratio(np.zeros(0)) == 1.0


def test_geometry(spark):
    r = G.rect(*[F.lit(float(x)) for x in (0, 0, 10, 10)])
    s = G.rect(*[F.lit(float(x)) for x in (5, 5, 20, 20)])
    assert tuple(spark.range(1).select(G.area(r), G.overlap(r, s), G.covered(r, s), G.area(G.union(r, s)), G.intersects(r, s)).first()) == (100.0, 25.0, 0.25, 400.0, True)


def test_longest_rising_against_all_subsequences():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        values = [rng.randint(0, 6) for _ in range(rng.randint(0, 9))]
        fine = [c for n in range(len(values) + 1) for c in itertools.combinations(range(len(values)), n) if all(values[a] <= values[b] for a, b in zip(c, c[1:]))]
        most = max(map(len, fine))
        # the end comes first, and seen from it each member comes first
        want = min((c for c in fine if len(c) == most), key=lambda c: c[::-1])
        assert outline.rising(values) == list(want), values


def test_recovered_numbers(spark):
    entries = spark.createDataFrame([("b", i, None) for i in range(6)], "doc string, ord long, printed int")
    strip = spark.createDataFrame([("b", i, n) for i, n in enumerate([3, 9, 90, 12, 20])], "doc string, ord long, n int")
    got = {r.ord: r.printed for r in outline.recovered_numbers(entries, strip).collect()}
    assert got == {0: None, 1: None, 2: 3, 3: 9, 4: 12, 5: 20}


def test_anchor_scan_takes_one_entry_a_page(spark):
    entries = spark.createDataFrame([("b", i, t) for i, t in enumerate(["qwrt", "plkj", "zxcv", "mnbs"])], "doc string, ord long, title string")
    texts = ["", "qwrt plkj", "zxcv", "plkj", "mnbs"]
    pages = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(texts)], "doc string, page int, text string")
    got = sorted((r.ord, r.physical, r.anchor_kind) for r in outline.anchor_scan(entries, pages).collect())
    assert got == [(0, 2, "strict"), (2, 3, "strict"), (3, 5, "strict")]


def test_unnumbered_entries_between_placed_ones(spark):
    rows = [(0, "One thing", 2), (1, "第2章 Wide seas", None), (2, "Lost words", None), (3, "Three things", 9), (4, "Tail part", None), (5, "Far tail", None)]
    entries = spark.createDataFrame([("b", *r) for r in rows], "doc string, ord long, title string, physical int")
    texts = {2: "One thing", 4: "Wide seas", 5: "第2章", 6: "Wide seas again", 9: "Three things, lost words", 11: "Tail part", 15: "Far tail", 18: "Far tail"}
    pages = spark.createDataFrame([("b", p, texts.get(p, "-")) for p in range(1, 19)], "doc string, page int, text string")
    shapes = spark.createDataFrame([("b", 3, 9.0)], "doc string, page int, score double")
    got = sorted((r.ord, r.physical, r.anchor_kind) for r in outline.attach_unnumbered(entries, pages, shapes).collect())
    assert got == [(1, 6, "strict-alt"), (2, 9, "same-page"), (4, 11, "strict"), (5, 15, "strict")]


def test_cache_entries_and_section_table(spark):
    rows = [("f", "degraded", "p", "t"), ("f", "unknown", "p", "t"), ("", "ok", "p", "t")]
    found = state.entry_problems(spark.createDataFrame(rows, "fingerprint string, verdict string, pdf string, checked_at string")).collect()
    assert sorted(r.problem for r in found) == ["missing fingerprint", "unknown verdict"]
    parts = [("b", "s1", 3, [4, 5], False), ("b", "s2", 2, [], True), ("b", "s3", 0, [], False)]
    table = markdown.section_table(spark.createDataFrame(parts, "doc string, title string, audited long, suspect_pages array<int>, unjudgeable boolean"), "doc").first().table
    assert table.split("\n") == ["| Section | Audited | Suspect pages | Verdict |", "|---|---|---|---|", "| s1 | 3 | 4,5 | suspect(2/3) |", "| s2 | 2 | - | unaudited |", "| s3 | 0 | - | unaudited |"]


def test_files_as_tables(spark, tmp_path):
    import json

    from leafworks.sources import readers, sinks

    (tmp_path / "a").mkdir()
    (tmp_path / "split_pdfs").mkdir()
    for p in ("x.pdf", "a/y.PDF", "split_pdfs/z.pdf", "a/n.txt"):
        (tmp_path / p).write_bytes(b"%PDF")
    names = sorted(r.path.rsplit("/", 1)[1] for r in readers.pdf_files(spark, str(tmp_path)).collect())
    assert names == ["x.pdf", "y.PDF"]
    regions_ = {"fingerprint": "f", "dpi": 1, "pages": {"3": [{"bbox_pt": [1.0, 2.0, 3.0, 4.0], "text": "x=1", "class": "formula", "source": "span"}]}}
    (tmp_path / "b.regions.json").write_text(json.dumps(regions_))
    (tmp_path / "c.regions.json").write_text("{ damaged")
    row = readers.regions(spark, str(tmp_path)).collect()
    assert [(r.page, r.ord, r.bbox.y1, r["class"]) for r in row] == [(3, 0, 4.0, "formula")]
    audit = {"fingerprint": "f", "pages": {"1": {"page_verdict": "ok", "verdicts": [{"text": "t", "verdict": "suspect", "signals": ["L1:x"]}]}, "2": {"page_verdict": "empty", "verdicts": []}}}
    (tmp_path / "b.faudit.json").write_text(json.dumps(audit))
    got = sorted((r.page, r.page_verdict, r.verdict) for r in readers.verdicts(spark, str(tmp_path)).collect())
    assert got == [(1, "ok", "suspect"), (2, "empty", None)]
    for name, text in (("list", '[{"page":1,"region_fingerprint":"r","status":"passed"}]'), ("object", '{"checks":[{"page":2,"region_fingerprint":"r","status":"escalated"}]}'), ("bad", '{"x":1}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text(text)
    assert readers.decisions(spark, str(tmp_path / "list")).first().status == "passed" and readers.decisions(spark, str(tmp_path / "object")).first().page == 2
    with pytest.raises(Exception, match="not a list of decisions"):
        readers.decisions(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "c.json").write_text('{"entries":{"p":{"fingerprint":"f","verdict":"ok","pdf":"p","checked_at":"t"}}}')
    assert readers.check_cache(spark, str(tmp_path / "cache")).first().verdict == "ok"
    (tmp_path / "cache" / "c.json").write_text("{ damaged")
    with pytest.raises(Exception):  # noqa: B017
        readers.check_cache(spark, str(tmp_path / "cache")).collect()
    sinks.replace_file(tmp_path / "out.txt", "one")
    sinks.replace_file(tmp_path / "out.txt", "two")
    assert (tmp_path / "out.txt").read_text() == "two"
    first, second = (spark.createDataFrame([(n,)], "n int") for n in (1, 2))
    sinks.keep_first(first, str(tmp_path / "kept"))
    sinks.keep_first(second, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).first().n == 1


def test_routes_counters_lookup_and_confidence(spark):
    pages = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 0.05), ("d", 3, None), ("d", 4, 0.0), ("d", 5, 0.0)], "doc string, page int, garble double")
    shapes = spark.createDataFrame([("d", 1, 5), ("d", 2, 9), ("d", 3, 9), ("d", 4, 4)], "doc string, page int, trails int")
    assert rows(outline.transcription_route(pages, shapes), "page", "route") == [(1, "textlayer"), *[(p, "doc-parser") for p in (2, 3, 4, 5)]]
    entries = spark.createDataFrame([("d", 1, 1, "a"), ("d", 2, 1, None), ("d", 3, 2, "a")], "doc string, ord long, level int, method string")
    assert rows(outline.counters(entries, "level", "method"), "counter", "value", "n") == [("level", "1", 2), ("level", "2", 1), ("method", "a", 2)]
    assert outline.counters(entries.limit(0), "level").count() == 0
    assert outline.sampled_entries(entries, 2, "s").collect() == outline.sampled_entries(entries.orderBy(F.desc("ord")), 2, "s").collect()
    found = spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a")], "doc string, page int, ord int, text string")
    got = {r.page: [x.text for x in r.regions] for r in regions.on_pages(pages.select("doc", "page"), found).collect()}
    assert got == {1: ["a", "b"], 2: [], 3: [], 4: [], 5: []}
    lines = spark.createDataFrame([("d", 1.0), ("d", 0.5), ("d", None), ("e", None)], "doc string, confidence double")
    assert rows(quality.mean_confidence(lines, "doc"), "doc", "confidence") == [("d", 0.75), ("e", None)]


def test_rising_numbers_of_each_document(spark):
    given_ = [("a", i, n) for i, n in enumerate([5, 1, 9, 2, 2, 8, 3])] + [("b", 0, 4)]
    got = outline.longest_rising(spark.createDataFrame(given_, "doc string, ord int, n int"))
    assert rows(got, "doc", "ord", "n") == [("a", 1, 1), ("a", 3, 2), ("a", 4, 2), ("a", 5, 8), ("b", 0, 4)]
    assert outline.longest_rising(spark.createDataFrame([], "doc string, ord int, n int")).count() == 0


def test_outline_restored_from_its_backup(spark, tmp_path):
    from leafworks.sources import sinks

    first, later = (spark.createDataFrame([(t, 1)], "title string, page int") for t in ("first", "later"))
    backup, path = f"{tmp_path}/toc.bak", f"{tmp_path}/toc"
    for rows_ in (first, later):
        sinks.keep_first(rows_, backup)
        sinks.replace_table(rows_, path)
    assert sinks.restore(spark, backup, path) == 1 and spark.read.parquet(path).first().title == "first"
    assert sinks.restore(spark, backup, path, purge=True) == 1 and not (tmp_path / "toc.bak").exists()
