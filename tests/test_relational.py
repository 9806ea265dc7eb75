"""Edges of seven types, keyed loading and surrogate ids."""

import pytest
from pyspark.sql import functions as F

from rookery import schema
from rookery.operators import relational as rel


@pytest.fixture
def tables(spark):
    users = spark.createDataFrame([(1, [2, 3], [3]), (2, None, []), (3, [None], None)], "user_id long, friends_list array<long>, followers_list array<long>")
    tweets = spark.createDataFrame([(10, 1, [2, 2, 3], 9, 2), (11, 1, None, None, None)], "tweet_id long, user_id long, user_mentions array<long>, in_reply_to_status_id long, in_reply_to_user_id long")
    return users, tweets


def pairs(df):
    return sorted((r["from_id"], r["to_id"]) for r in df.collect())


@pytest.mark.parametrize(
    ("kind", "all_", "lost"),
    [(1, [(1, 2), (1, 3)], [(1, 2)]), (2, [(1, 3)], []), (3, [(1, 2), (1, 2), (1, 3)], [(1, 2), (1, 2)]), (4, [(1, 2)], [(1, 2)]), (5, [(2, 3)], []), (6, [(2, 2), (2, 2), (2, 3)], [(2, 2), (2, 2)])],
)
def test_types(spark, tables, kind, all_, lost):
    gone = spark.createDataFrame([(1, "x", 3), (2, None, None)], schema.LOST_PROFILES)
    assert pairs(rel.build_edges(*tables, kind)) == all_
    assert pairs(rel.build_edges(*tables, kind, gone)) == lost
    assert pairs(rel.build_edges(*tables, kind, add_missing=False)) == all_


def test_unknown_type(tables):
    with pytest.raises(ValueError, match="no edge types"):
        rel.build_edges(*tables, 9)


def test_shared_hashtag(spark):
    t = spark.createDataFrame([(1, ["A", None]), (2, ["a"]), (3, None), (4, ["b"]), (2, ["a", "A"]), (None, ["a"])], "user_id long, hashtag_entities array<string>")
    assert pairs(rel.shared_hashtag_edges(t, "A")) == [(1, 2)]
    assert pairs(rel.shared_hashtag_edges(t, "b")) == []
    many = spark.range(60).select(F.col("id").alias("user_id"), F.array(F.lit("q")).alias("hashtag_entities"))
    assert len(pairs(rel.shared_hashtag_edges(many, "q", block=7))) == 60 * 59 // 2


def test_pairs_of_a_hashtag_are_spread_over_tasks(spark):
    many = spark.range(0, 3_000, 10).select((F.col("id") * 7_919 % 3_001).alias("user_id"), F.array(F.lit("Q")).alias("hashtag_entities"))
    ids = sorted(r["user_id"] for r in many.collect())
    edges = rel.shared_hashtag_edges(many, "q", block=40)
    assert pairs(edges) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    tasks = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 8 * 9 // 2 and max(tasks) <= 40 * 40


def test_pairs_of_a_user_leave_before_the_next_are_made(spark):
    edges = rel.shared_hashtag_edges(spark.range(9).select(F.col("id").alias("user_id"), F.array(F.lit("q")).alias("hashtag_entities")), "q", block=4)
    edges.collect()
    generators = [x.strip(" :+-") for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in x]
    assert generators[0].startswith("*(") and "CASE WHEN" in generators[0]  # compiled
    assert generators[1].startswith("Generate explode(transform(")  # not compiled, so a loop of its own


def test_first_write_wins(spark):
    there = spark.createDataFrame([(1, "old")], "k long, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (None, "x")], "k long, v string")
    assert sorted(map(tuple, rel.insert_absent(there, new, "k", F.col("v")).collect())) == [(1, "old"), (2, "a")]


def test_last_row_wins(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (None, 1, "d")], "k long, at int, v string")
    assert [tuple(r) for r in rel.last_by_key(rows, "k", F.col("at")).collect()] == [(1, 7, "b")]


def test_edge_ids(spark, tables):
    e = rel.build_edges(*tables, (1, 4))
    assert [(r["edge_id"], r["edge_type"], r["to_id"]) for r in rel.edge_ids(e, 100).orderBy("edge_id").collect()] == [(101, 1, 2), (102, 1, 3), (103, 4, 2)]
    assert rel.last_edge_id(spark.createDataFrame([], schema.GRAPH)) == 0


def test_replacing_by_type(spark, tables, tmp_path):
    path = str(tmp_path / "edges")
    rel.write_replacing(rel.build_edges(*tables, (1, 3)), path)
    rel.write_replacing(rel.build_edges(*tables, 1).limit(1), path)
    assert {r["edge_type"]: r["count"] for r in spark.read.parquet(path).groupBy("edge_type").count().collect()} == {1: 1, 3: 3}


def test_timelines_bring_their_authors(spark):
    at = "2024-01-0{} 00:00:00".format
    users = spark.createDataFrame([(1, "old", at(1))], "user_id long, user_name string, d string").select("user_id", "user_name", F.col("d").cast("timestamp").alias("date_of_collection"))
    authors = spark.createDataFrame([(1, "new", at(2)), (2, "b", at(3)), (2, "a", at(2)), (None, "x", at(1))], "user_id long, user_name string, d string").select("user_id", "user_name", F.col("d").cast("timestamp").alias("date_of_collection"))
    tweets = spark.createDataFrame([(10, "stored", at(1))], "tweet_id long, tweet string, d string").select("tweet_id", "tweet", F.col("d").cast("timestamp").alias("date_of_collection"))
    new = spark.createDataFrame([(10, "again", at(2)), (11, "first", at(2)), (11, "second", at(3))], "tweet_id long, tweet string, d string").select("tweet_id", "tweet", F.col("d").cast("timestamp").alias("date_of_collection"))
    u, t = rel.load_timelines(users, tweets, authors, new)
    assert sorted((r["user_id"], r["user_name"]) for r in u.collect()) == [(1, "old"), (2, "a")]
    assert sorted((r["tweet_id"], r["tweet"]) for r in t.collect()) == [(10, "stored"), (11, "first")]


def test_tables(spark, tmp_path):
    folder = str(tmp_path)
    assert rel.prepare_tables(spark, folder, schema.TABLES) == [*schema.TABLES]
    spark.createDataFrame([(5, "x", None, None)], schema.TOPICS).write.mode("append").parquet(f"{folder}/topics")
    assert rel.prepare_tables(spark, folder, schema.TABLES) == []
    assert spark.read.parquet(f"{folder}/topics").count() == 1
    rel.clear_tables(spark, folder, schema.TABLES)
    t = {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in schema.TABLES.items()}
    assert t["topics"].count() == 0
    wide = rel.add_columns(t["users"], schema.SAMPLING)
    assert {"expand_user", "timeline_document"} <= set(wide.columns)
    assert rel.add_columns(wide, schema.SAMPLING).columns == wide.columns
    assert rel.build_edges(t["users"], t["tweets"]).count() == 0
    assert rel.shared_hashtag_edges(t["tweets"], "x").count() == 0
