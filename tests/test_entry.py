"""The registry imports without a session, and queries agree with DuckDB on small tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).parent.parent


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", ["quality_tiers", "joined_lines", "page_segments", "ambiguity_lines", "formula_pages", "outline_levels", "best_toc_windows", "span_regions", "prose_paragraphs", "repetition_cuts", "status_latest", "weighted_agreement", "rising_numbers", "recovered_numbers", "anchor_places", "anchor_gates", "model_entries", "section_dirs", "layout_boxes", "regions_on_pages", "raster_rows", "cache_problems"])
def test_against_duckdb(spark, name):
    import duckdb

    from leafworks.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "events", "lineitem", "orders", "nation"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda rs: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rs)
    names = ", ".join(f'"{c}"' for c in columns)
    assert key(con.sql(f"select {names} from want").fetchall()) == key(got.select(*columns).collect())
