"""Links, hashtags, mentions and repost marks of a message with their offsets, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an entity; links are plain http only.
LINK, HASHTAG, MENTION, REPOST, DIRECT = r"http://\S+", r"#[a-zA-Z0-9_]+", r"@[a-zA-Z0-9_]+", "RT @", r"^\s?@"


def found(text: Column, pattern: str, skip: int = 0) -> Column:
    """Array of ``pos, value`` of all matches in order; ``skip`` characters at the front belong to neither.

    ``pos`` counts code points from 0. It is the length of everything before the match: the pieces
    between matches, and the matches themselves.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    empty = F.array().cast("array<struct<pos:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        hit = F.struct((at + skip).cast("int").alias("pos"), F.substr(s["value"], F.lit(skip + 1)).alias("value"))
        return F.struct((at + F.length(s["value"])).cast("int").alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.when(F.size(values) == 0, empty).otherwise(F.aggregate(steps, start, step, lambda acc: acc["out"]))


def links(text: Column) -> Column:
    return found(text, LINK)


def hashtags(text: Column) -> Column:
    return found(text, HASHTAG, 1)


def mentions(text: Column) -> Column:
    return found(text, MENTION, 1)


def reposts(text: Column) -> Column:
    """Offsets of every ``RT @``."""
    return F.transform(found(text, REPOST), lambda m: m["pos"])


def is_direct(text: Column) -> Column:
    return text.rlike(DIRECT)


def with_entities(records: DataFrame, text: str = "msg") -> DataFrame:
    """Adds ``http_links, hashtags, mentions, retweet, user_msg``; null where the message has none."""
    t = F.col(text)
    some = lambda c: F.when(F.size(c) > 0, c)
    return records.withColumns(
        {
            "http_links": some(links(t)), "hashtags": some(hashtags(t)), "mentions": some(mentions(t)),
            "retweet": some(reposts(t)), "user_msg": F.when(is_direct(t), F.lit(True)),
        }
    )
