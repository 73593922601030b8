"""The catalogue against SQL on the smallest tables; tools/check.py does all of it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ("clean_line", "paragraphs_by_speaker", "speaker_turns", "asr_issues", "quality_report", "near_misses", "candidate_signals",
        "anchor_claims", "pair_segments", "search_passages", "merge_with_next", "render_srt", "compile_master", "status_changes")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_flagship_has_every_severity(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["haute"] for r in rows) and sum(r["moyenne"] for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == want


def test_result_does_not_depend_on_partitions(spark):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(map(tuple, entry.queries()["paragraphs"](spark, SF).collect()))

    try:
        assert rows(1) == rows(16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
