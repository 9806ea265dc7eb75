"""The entry module: names, schemas and SQL twins; a sample of queries against DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "documents users tweets graph topics lost_profiles places reading_labels lang_samples".split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    out = entry.entry(spark)
    assert out.columns == ["name", "in_w", "out_w", "total_w"]
    assert 0 < out.count() <= 20


@pytest.mark.parametrize("name", ["gr_edges", "rel_without_lost", "str_without_punctuation", "sc_topic_hits", "p2_found", "p3_keys", "p5_kept", "api_search", "smp_causal", "smp_cascade", "smp_breadth_first", "src_timelines_json", "src_tsv", "str_normalized", "gr_degree", "gr_edges_first_repost", "flt_media"])
def test_against_sql(spark, name):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(map(tuple, want), key=repr) or sorted(map(key, want)) == sorted(key(tuple(r)) for r in got.select(*columns).collect())
