"""Queries of this subpackage, with their SQL twins where SQL can say it."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.bpe import token_counts, token_ids
from rookery.llm.language import language_segments, text_languages, train, unnamed_languages
from rookery.llm.packing import fill_report, pack
from rookery.llm.reading import labelled, reading_levels
from rookery.llm.reading import train as train_levels
from rookery.llm.skeleton import look_classes, look_same
from rookery.llm.together import appear_together, clean_items, collapse, pair_scores
from rookery.session import materialise, table


def _kinds() -> dict:
    return {"hashtag": clean_items(F.col("hashtag_entities"), lower=True), "mention": clean_items(F.col("user_mentions"))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return appear_together(table(spark, d, "tweets"), "tweet_id", _kinds(), 4, 18.7).select("kind", "item_a", "item_b")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Counts, lift and conviction of every pair in at least four tweets."""
    baskets = materialise(collapse(table(spark, d, "tweets"), "tweet_id", _kinds()), "baskets")
    scores = pair_scores(baskets, 4)
    return scores.select("kind", "item_a", "item_b", "n_together", "n_a", "n_b", *(F.round(c, 6).alias(c) for c in ("lift", "conviction_ab", "conviction_ba")))


def _looks(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("user_name").alias("text"))
    tweets = table(spark, d, "tweets").select(F.lit("tweet").alias("kind"), F.col("tweet_id").alias("id"), F.col("tweet").alias("text"))
    return users.unionByName(tweets)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return look_same(_looks(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Members of every class of unlike texts that look the same."""
    return look_classes(_looks(spark, d))


def language_model(spark: SparkSession, d: str, max_samples: int = 5_000):
    """Fit on at most ``max_samples`` labelled sentences (the table has 360)."""
    rows = table(spark, d, "lang_samples").orderBy("sample_id").limit(max_samples).select("lang", "text").collect()
    return _trained(tuple((r["lang"], r["text"]) for r in rows), max_samples)


@lru_cache(maxsize=2)
def _trained(samples: tuple[tuple[str, str], ...], max_samples: int):
    return train(list(samples), max_samples)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tweets, users = table(spark, d, "tweets"), table(spark, d, "users")
    return unnamed_languages(tweets, "tweet_id", "user_id", "tweet", users, "profile_language", language_model(spark, d), 4)


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language in each tweet, with its confidence."""
    return language_segments(table(spark, d, "tweets").dropDuplicates(["tweet_id"]), ["tweet_id"], "tweet", language_model(spark, d))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Main language of each document, with a confidence and its share of the words."""
    segments = language_segments(table(spark, d, "documents"), ["doc_id"], "text", language_model(spark, d))
    return text_languages(segments, "doc_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"), "doc_id", "text")


def p8_assigned(spark: SparkSession, d: str) -> DataFrame:
    """A place in a container of 2,048 tokens for every document or piece of one."""
    return pack(p7_counts(spark, d), "doc_id", "n_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_assigned(spark, d))


def _levels(spark: SparkSession, d: str, max_labels: int = 6_000) -> DataFrame:
    documents = table(spark, d, "documents")
    model = train_levels(*labelled(documents, "doc_id", "text", table(spark, d, "reading_labels"), "reading_level", max_labels))
    return reading_levels(documents, "doc_id", "text", model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("reading_level >= 4").select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document with words, and the expected level behind it."""
    return _levels(spark, d)


_PAIRS = """
WITH r AS (SELECT DISTINCT tweet_id, 'hashtag' AS kind, lower(u.h) AS item FROM tweets, unnest(hashtag_entities) AS u(h)
  WHERE tweet_id IS NOT NULL AND u.h <> ''
  UNION ALL SELECT DISTINCT tweet_id, 'mention', CAST(u.m AS VARCHAR) FROM tweets, unnest(user_mentions) AS u(m)
  WHERE tweet_id IS NOT NULL AND u.m IS NOT NULL),
n AS (SELECT kind, count(DISTINCT tweet_id) AS n_records FROM r GROUP BY 1),
s AS (SELECT kind, item, count(*) AS n FROM r GROUP BY 1, 2),
p AS (SELECT a.kind, a.item AS item_a, b.item AS item_b, count(*) AS c FROM r a JOIN r b
  ON a.kind = b.kind AND a.tweet_id = b.tweet_id AND a.item < b.item GROUP BY 1, 2, 3 HAVING count(*) >= 4),
j AS (SELECT p.*, x.n AS n_a, y.n AS n_b, CAST(n_records AS DOUBLE) AS nr FROM p JOIN s x ON x.kind = p.kind AND x.item = item_a
  JOIN s y ON y.kind = p.kind AND y.item = item_b JOIN n ON n.kind = p.kind)"""

QUERIES = {
    "p1_found": (p1_found, _PAIRS + " SELECT kind, item_a, item_b FROM j WHERE c * nr / (CAST(n_a AS DOUBLE) * n_b) >= 18.7"),
    "p1_scores": (p1_scores, _PAIRS + """ SELECT kind, item_a, item_b, c AS n_together, n_a, n_b, round(c * nr / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift,
      round(CASE WHEN n_a > c THEN (n_a * (nr - n_b)) / (nr * (n_a - c)) END, 6) AS conviction_ab,
      round(CASE WHEN n_b > c THEN (n_b * (nr - n_a)) / (nr * (n_b - c)) END, 6) AS conviction_ba FROM j"""),
    "p4_found": (p4_found, None),
    "p4_classes": (p4_classes, None),
    "p6_found": (p6_found, None),
    "p6_segments": (p6_segments, None),
    "p6_texts": (p6_texts, None),
    "p7_ids": (p7_ids, None),
    "p7_counts": (p7_counts, None),
    "p8_assigned": (p8_assigned, None),
    "p8_fill": (p8_fill, None),
    "p9_found": (p9_found, None),
    "p9_levels": (p9_levels, None),
}
