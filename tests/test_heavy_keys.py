"""Tree aggregation against plain sums, whatever the number of chunks and the fan-in."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rookery import schema
from rookery.operators.heavy_keys import edge_keys, heavy_keys, rounds_for, tree_aggregate


def test_rounds():
    assert [rounds_for(n, 8) for n in (0, 1, 8, 9, 64, 65)] == [0, 0, 1, 2, 2, 3]


@pytest.mark.parametrize(("chunks", "fan_in", "chunk_rows"), [(1, 2, 5_000), (7, 2, 700), (30, 3, 160), (12, 8, 100_000)])
def test_same_as_group_by(spark, chunks, fan_in, chunk_rows):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id", (F.col("id") % chunks).cast("int").alias("c"))
    got = tree_aggregate(rows, ["k"], "c", {"n": (F.lit(1).cast("long"), "sum"), "lo": (F.col("id"), "min"), "hi": (F.col("id"), "max")}, chunks, fan_in, chunk_rows)
    want = rows.groupBy("k").agg(F.count(F.lit(1)), F.min("id"), F.max("id"))
    assert sorted(map(tuple, got.select("k", "n", "lo", "hi").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("shuffles", [4, 8, 200])
@pytest.mark.parametrize("first", [64, 1_000])
@pytest.mark.parametrize("coalesce", [True, False])
def test_no_setting_changes_the_result(spark, rows, shuffles, first, coalesce):
    edges = [(i % 900, 1, 7 if i % 3 == 0 else i % 900 + 100, 1, -1, "Hot" if i % 5 == 0 else None) for i in range(0, 1_800, 3)]
    settings = {
        "spark.sql.shuffle.partitions": shuffles, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": first if coalesce else 64,
        "spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1kb",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v).lower())
        got = rows(edge_keys(graph(spark, edges), chunk_rows=40), "field_name", "key_text", "n_edges")
        heavy = rows(heavy_keys(graph(spark, edges)), "key_text")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    ids = dict.fromkeys((e[0], e[2], e[5]) for e in edges)
    want = Counter(("to_id", str(e[1])) for e in ids) + Counter(("hashtag", "hot") for e in ids if e[2]) + Counter(("all", "-") for e in ids)
    assert got == sorted(((*k, n) for k, n in want.items()), key=repr)
    assert heavy == [("7",), ("hot",)]


def graph(spark, rows):
    return spark.createDataFrame(rows, schema.GRAPH).withColumn("kind", F.lit("clash")).withColumn("key_text", F.lit(1))


def test_edge_keys(spark):
    rows = [(1, 5, 9, 7, -1, "Tag"), (1, 5, 9, 7, -1, "Tag"), (2, 5, 9, 7, -1, "tAG"), (3, 5, 8, 1, -1, ""), (4, 5, None, None, None, None), (None, 1, 9, 1, 1, "tag")]
    got = {(r["field_name"], r["key_text"]): (r["n_edges"], r["types"], r["first_edge"], r["last_edge"]) for r in edge_keys(graph(spark, rows)).collect()}
    assert got == {("hashtag", "tag"): (2, 128, 1, 2), ("to_id", "9"): (2, 128, 1, 2), ("to_id", "8"): (1, 2, 3, 3), ("all", "-"): (4, 131, 1, 4)}


def test_heavy(spark):
    rows = [(i, 1, 7 if i % 3 == 0 else i + 100, 1, -1, "Hot" if i % 10 == 0 else f"t{i}") for i in range(1, 301)]
    rows += [rows[0]] * 500  # loaded again and again
    got = {(r["field_name"], r["key_text"], r["n_edges"]) for r in heavy_keys(graph(spark, rows)).collect()}
    c = Counter(r[2] for r in dict.fromkeys(rows))
    assert got == {("to_id", "7", c[7]), ("hashtag", "hot", 30)}


def test_share_is_inclusive(spark):
    rows = [(i, 1, i if i > 2 else 1, 1, -1, None) for i in range(1, 101)]
    assert [r["key_text"] for r in heavy_keys(graph(spark, rows)).collect()] == ["1"]


def test_empty(spark):
    assert edge_keys(graph(spark, [])).count() == 0
    assert heavy_keys(graph(spark, [])).count() == 0
