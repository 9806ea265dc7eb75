"""Queries of the core package over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.heavy_keys import edge_keys, heavy_keys
from rookery.operators.nearby import near_counts, near_points
from rookery.session import table
from rookery.streaming.redelivery import Deliveries, delivery_stream, keep_one


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_points(table(spark, d, "tweets"), "tweet_id", "latitude", "longitude", 150.0)
    return pairs.select(F.col("point_a").alias("tweet_id_a"), F.col("point_b").alias("tweet_id_b"))


def p2_degree(spark: SparkSession, d: str) -> DataFrame:
    """Number of other tweets within 150 m of each that has any."""
    return p2_places(spark, d).where("n_near > 0").select("tweet_id", "n_near")


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    """Every tweet with a position: its place (the smallest tweet_id at the spot) and its number of neighbours."""
    counts = near_counts(table(spark, d, "tweets"), "tweet_id", "latitude", "longitude", 150.0)
    return counts.select(F.col("point").alias("tweet_id"), F.col("place").alias("place_id"), "n_near")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "graph"), 50).select("field_name", "key_text")


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    """Results of every key, heavy or not."""
    return edge_keys(table(spark, d, "graph"))


def _deliveries(spark: SparkSession, d: str, columns: list[str]) -> Deliveries:
    return keep_one(delivery_stream(spark, f"{d}/tweets.parquet", columns, "date_of_collection"), "tweet_id", "created_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _deliveries(spark, d, ["tweet_id", "created_at", "date_of_collection"]).repeats.select("tweet_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """One row for each tweet_id, with the columns in which all its deliveries agree."""
    columns = ["tweet_id", "created_at", "user_id", "tweet", "latitude", "longitude", "favorite_count", "date_of_collection"]
    place = (F.nanvl(c, F.lit(None)).alias(c) for c in ("latitude", "longitude"))
    return _deliveries(spark, d, columns).kept.select("tweet_id", "user_id", "tweet", *place)


_POSITIONS = """
SELECT tweet_id, min(latitude) AS la, min(longitude) AS lo FROM tweets
WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)
  AND NOT isnan(latitude) AND NOT isnan(longitude) GROUP BY tweet_id"""
_NEAR = f"""
WITH p AS ({_POSITIONS}),
pairs AS (SELECT a.tweet_id AS tweet_id_a, b.tweet_id AS tweet_id_b FROM p a JOIN p b
  ON a.tweet_id < b.tweet_id AND b.la BETWEEN a.la - 0.002 AND a.la + 0.002
  WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.la - a.la) / 2), 2)
    + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 150)"""
_KEYS = """
WITH e AS (SELECT DISTINCT edge_id, to_id, lower(hashtag) AS tag, edge_type FROM graph WHERE edge_id IS NOT NULL),
k AS (SELECT edge_id, edge_type, 'hashtag' AS field_name, tag AS key_text FROM e WHERE tag <> ''
  UNION ALL SELECT edge_id, edge_type, 'to_id', CAST(to_id AS VARCHAR) FROM e WHERE to_id IS NOT NULL
  UNION ALL SELECT edge_id, edge_type, 'all', '-' FROM e)"""

QUERIES = {
    "p2_found": (p2_found, _NEAR + " SELECT tweet_id_a, tweet_id_b FROM pairs"),
    "p2_degree": (p2_degree, _NEAR + " SELECT tweet_id, count(*) AS n_near FROM (SELECT tweet_id_a AS tweet_id FROM pairs UNION ALL SELECT tweet_id_b FROM pairs) GROUP BY 1"),
    "p2_places": (p2_places, _NEAR + ", c AS (SELECT tweet_id, count(*) AS n FROM (SELECT tweet_id_a AS tweet_id FROM pairs UNION ALL SELECT tweet_id_b FROM pairs) GROUP BY 1) SELECT p.tweet_id, min(p.tweet_id) OVER (PARTITION BY la, lo) AS place_id, coalesce(c.n, 0) AS n_near FROM p LEFT JOIN c USING (tweet_id)"),
    "p3_found": (p3_found, _KEYS + " SELECT field_name, key_text FROM k WHERE field_name <> 'all' GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM e)"),
    "p3_keys": (p3_keys, _KEYS + " SELECT field_name, key_text, count(*) AS n_edges, CAST(bit_or(1 << CAST(coalesce(edge_type, 0) AS INTEGER)) AS INTEGER) AS types, min(edge_id) AS first_edge, max(edge_id) AS last_edge FROM k GROUP BY 1, 2"),
    "p5_found": (p5_found, "SELECT tweet_id FROM tweets WHERE tweet_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "p5_kept": (p5_kept, "SELECT DISTINCT tweet_id, user_id, tweet, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude FROM tweets WHERE tweet_id IS NOT NULL"),
}
