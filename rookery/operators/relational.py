"""Edges of seven types from profile and post tables, and keyed loading of such tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.operators.ranking import with_ids
from rookery.session import materialise

FRIEND, FOLLOWER, MENTION, REPLY, CO_MENTION, CO_REPLY, SHARED_TAG = range(1, 8)
ALL_TYPES = (FRIEND, FOLLOWER, MENTION, REPLY, CO_MENTION, CO_REPLY)


def _edges(rows: DataFrame, start: Column, end: Column, kind: int, post: Column | None = None) -> DataFrame:
    none = F.lit(-1).cast("long")
    return rows.select(
        start.cast("long").alias("from_id"), end.cast("long").alias("to_id"), F.lit(kind).cast("short").alias("edge_type"), (none if post is None else post).alias("tweet_id")
    ).where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())


def friend_edges(users: DataFrame) -> DataFrame:
    """Type 1: from the user to everyone on the friends list; null ids on the list are none."""
    return _edges(users.select("user_id", F.explode("friends_list").alias("x")), F.col("user_id"), F.col("x"), FRIEND)


def follower_edges(users: DataFrame) -> DataFrame:
    """Type 2: from the followed user to the follower."""
    return _edges(users.select("user_id", F.explode("followers_list").alias("x")), F.col("user_id"), F.col("x"), FOLLOWER)


def mention_edges(tweets: DataFrame) -> DataFrame:
    """Type 3: from the author to each mentioned id; repeated mentions stay repeated."""
    return _edges(tweets.select("user_id", "tweet_id", F.explode("user_mentions").alias("x")), F.col("user_id"), F.col("x"), MENTION, F.col("tweet_id"))


def reply_edges(tweets: DataFrame) -> DataFrame:
    """Type 4: from the author to the author replied to; only where post and author are both named."""
    named = tweets.where("in_reply_to_status_id IS NOT NULL AND in_reply_to_user_id IS NOT NULL")
    return _edges(named, F.col("user_id"), F.col("in_reply_to_user_id"), REPLY, F.col("tweet_id"))


def co_mention_edges(tweets: DataFrame) -> DataFrame:
    """Type 5: each pair of different ids mentioned in one post with two mentions or more, smaller id first."""
    ids = F.array_sort(F.array_distinct(F.filter("user_mentions", lambda x: x.isNotNull())))
    rows = tweets.where(F.size("user_mentions") > 1).select("tweet_id", ids.alias("ids"))
    first = rows.select("tweet_id", "ids", F.posexplode("ids").alias("i", "a"))
    pairs = first.where(F.col("i") + 1 < F.size("ids")).select("tweet_id", "a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    return _edges(pairs, F.col("a"), F.col("b"), CO_MENTION, F.col("tweet_id"))


def co_reply_edges(tweets: DataFrame) -> DataFrame:
    """Type 6: from the author replied to, to each mentioned id; self-loops stay."""
    rows = tweets.where("in_reply_to_user_id IS NOT NULL").select("tweet_id", "in_reply_to_user_id", F.explode("user_mentions").alias("x"))
    return _edges(rows, F.col("in_reply_to_user_id"), F.col("x"), CO_REPLY, F.col("tweet_id"))


def hashtag_users(tweets: DataFrame, hashtag: str) -> DataFrame:
    """``user_id`` of everyone who used the hashtag, in any case."""
    used = F.exists(F.transform("hashtag_entities", F.lower), lambda h: h == hashtag.lower())
    return tweets.where(used & F.col("user_id").isNotNull()).select("user_id").distinct()


def hashtag_uses(tweets: DataFrame) -> DataFrame:
    """``hashtag, user_id``: every user of every hashtag once, hashtags in lower case."""
    used = tweets.where("user_id IS NOT NULL").select(F.explode(F.transform("hashtag_entities", F.lower)).alias("hashtag"), F.col("user_id").cast("long").alias("user_id"))
    return used.where("hashtag IS NOT NULL").distinct()


def shared_hashtag_edges(tweets: DataFrame, hashtag: str, block: int = 2_000) -> DataFrame:
    """Type 7: each unordered pair of users who used ``hashtag`` (case aside), smaller id first; none below two users."""
    return user_pairs(hashtag_users(tweets, hashtag), hashtag.lower(), block)


def user_pairs(users: DataFrame, hashtag: str, block: int = 2_000) -> DataFrame:
    """Type 7: every pair of the ``user_id`` in ``users`` (each there once), smaller id first.

    The pairs are the result, so there are as many as there are. Users are cut into blocks in the
    order of their ids, so only pairs that count are made, and a task has the pairs of two blocks:
    ``block`` squared at most (of several twos of blocks where there are more than 2,000 tasks).
    """
    numbered = with_ids(users.select(F.col("user_id").cast("long").alias("user_id")).where("user_id IS NOT NULL"), "user_id")
    own = numbered.groupBy(F.floor(F.col("node_id") / block).alias("k")).agg(F.array_sort(F.collect_list("user_id")).alias("ids"))
    own = materialise(own, "blocks")
    blocks = own.count()
    tasks = max(1, min(blocks * (blocks + 1) // 2, 2_000))
    low = own.select(F.col("k").alias("x"), F.explode(F.sequence(F.col("k"), F.lit(blocks - 1).cast("long"))).alias("y"), F.col("ids").alias("a"))
    high = own.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("x"), F.col("k").alias("y"), F.col("ids").alias("b"))
    # by number, as adaptive execution would join these few rows to one partition
    twos = low.join(high, ["x", "y"]).repartitionById(tasks, F.expr(f"CAST(pmod(y * (y + 1) div 2 + x, {tasks}) AS INT)"))
    # one user's row at a time: lambdas aren't compiled, else both loops were one and all its pairs were held before the first is passed on
    users_of_a = F.explode(F.transform("a", lambda a, i: F.struct(a.alias("a"), i.alias("i"))))
    each = twos.select(users_of_a.alias("u"), (F.col("x") == F.col("y")).alias("same"), "b")
    after = F.expr("CASE WHEN same THEN slice(b, u.i + 2, size(b)) ELSE b END")
    return _edges(each.select(F.col("u.a").alias("a"), F.explode(after).alias("b")), F.col("a"), F.col("b"), SHARED_TAG).withColumn("hashtag", F.lit(hashtag))


def shared_hashtag_classes(tweets: DataFrame) -> DataFrame:
    """``hashtag, user_id, links``: type 7 over all hashtags, folded: users of a hashtag are a class, and every two of them are linked.

    ``links`` is the number of edges of the user in the class, so half their sum is the number of
    edges. Hashtags are in lower case; those of one user link nobody and are left out. Nothing here
    grows with the square of a class: the pairs of one are :func:`shared_hashtag_edges`.
    """
    used = hashtag_uses(tweets)
    sizes = used.groupBy("hashtag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return used.join(sizes, "hashtag").select("hashtag", "user_id", (F.col("n") - 1).alias("links"))


def without_lost(edges: DataFrame, lost: DataFrame | None) -> DataFrame:
    """Only edges whose far end isn't a lost profile; all of them where there is no such table."""
    return edges if lost is None else edges.join(lost.select(F.col("user_id").alias("to_id")).where("to_id IS NOT NULL").distinct(), "to_id", "left_anti").select(*edges.columns)


def to_known(edges: DataFrame, users: DataFrame, end: str = "to_id") -> DataFrame:
    """Only edges whose end is a stored profile."""
    return edges.join(users.select(F.col("user_id").alias(end)).distinct(), end, "left_semi").select(*edges.columns)


def missing_profiles(edges: DataFrame, users: DataFrame, end: str = "to_id") -> DataFrame:
    """Stubs (``user_id`` only) for ends that aren't stored profiles yet."""
    return edges.select(F.col(end).alias("user_id")).distinct().join(users.select("user_id"), "user_id", "left_anti")


def build_edges(
    users: DataFrame, tweets: DataFrame, types: int | tuple[int, ...] = ALL_TYPES, lost: DataFrame | None = None, add_missing: bool = True
) -> DataFrame:
    """Edges of one type or several. Lost profiles are no far ends; without ``add_missing`` far ends must be stored."""
    wanted = (types,) if isinstance(types, int) else tuple(types)
    makers = {
        FRIEND: lambda: friend_edges(users), FOLLOWER: lambda: follower_edges(users), MENTION: lambda: mention_edges(tweets),
        REPLY: lambda: reply_edges(tweets), CO_MENTION: lambda: co_mention_edges(tweets), CO_REPLY: lambda: co_reply_edges(tweets),
    }
    unknown = [t for t in wanted if t not in makers]
    if unknown or not wanted:
        raise ValueError(f"no edge types {unknown}")
    out = None
    for t in wanted:
        own = without_lost(makers[t](), lost)
        if t in (CO_MENTION, CO_REPLY) and lost is not None:
            gone = lost.select(F.col("user_id").alias("from_id")).where("from_id IS NOT NULL").distinct()
            own = own.join(gone, "from_id", "left_anti").select(*own.columns)
        if not add_missing:
            own = to_known(own, users)
            if t in (CO_MENTION, CO_REPLY):
                own = to_known(own, users, "from_id")
        out = own if out is None else out.unionByName(own)
    return out


def edge_ids(edges: DataFrame, after: int = 0) -> DataFrame:
    """Adds ``edge_id`` from ``after + 1``, in order of (edge_type, from_id, to_id, tweet_id)."""
    key = F.struct("edge_type", "from_id", "to_id", "tweet_id")
    return with_ids(edges.withColumn("_key", key), "_key").withColumn("edge_id", F.col("node_id") + after + 1).drop("node_id", "_key")


def last_edge_id(graph: DataFrame) -> int:
    """Largest edge_id, 0 for an empty graph."""
    return graph.agg(F.coalesce(F.max("edge_id"), F.lit(0)).alias("m")).first()["m"]


def replace_types(graph: DataFrame, new: DataFrame) -> DataFrame:
    """``graph`` with all edges of the types in ``new`` replaced by those."""
    new = materialise(new, "replacement")
    types = new.select("edge_type").distinct()  # at most seven rows
    return graph.join(F.broadcast(types), "edge_type", "left_anti").select(*graph.columns).unionByName(new, allowMissingColumns=True)


def write_replacing(edges: DataFrame, path: str) -> None:
    """Write edges partitioned by type; types that occur replace what is there, others stay."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edge_type").parquet(path)


def insert_absent(target: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """``target`` and those rows of ``new`` whose key it lacks; of several new rows of a key the first in ``order``.

    The first write wins: rows that are there never change. Rows without a key are not inserted.
    """
    fresh = new.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti").select(*new.columns)
    return target.unionByName(first_by_key(fresh, key, order), allowMissingColumns=True)


def load_timelines(users: DataFrame, tweets: DataFrame, authors: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and tweets after a load of timelines: first the authors that aren't stored, then the posts that aren't.

    What is stored never changes; columns that one side lacks are null. Of several new rows of one
    key the one that was collected first counts.
    """
    first = F.struct(F.col("date_of_collection").isNull(), "date_of_collection")
    return insert_absent(users, authors, "user_id", first), insert_absent(tweets, posts, "tweet_id", first)


def first_by_key(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row for each key, the first in ``order`` (ties and no order: the least row hash)."""
    tie = F.xxhash64(*rows.columns)
    rank = tie if order is None else F.struct(order.isNull(), order, tie)
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*others), rank).alias("_b"))
    return best.select(*(F.col(key) if c == key else F.col(f"_b.`{c}`").alias(c) for c in rows.columns))


def last_by_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the last in ``order``: keyed loading, where a later row replaces an earlier one."""
    others = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order.isNotNull(), order, F.xxhash64(*rows.columns))).alias("_b"))
    return best.select(*(F.col(key) if c == key else F.col(f"_b.`{c}`").alias(c) for c in rows.columns))


def user_totals(graph: DataFrame) -> DataFrame:
    """Edges in and out of each user by type, as one row with a column for each type."""
    ends = graph.select("edge_type", F.explode(F.array("from_id", "to_id")).alias("user_id"))
    return ends.groupBy("user_id").agg(*(F.count_if(F.col("edge_type") == t).alias(f"type_{t}") for t in range(1, 8)))


def prepare_tables(spark: SparkSession, folder: str, schemas: dict) -> list[str]:
    """Write an empty table below ``folder`` for each schema that has none; the names of those made. Others stay as they are."""
    made = []
    for name, kind in schemas.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made


def clear_tables(spark: SparkSession, folder: str, schemas: dict) -> None:
    """Every table of ``schemas`` without its rows."""
    for name, kind in schemas.items():
        spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{folder}/{name}")


def add_columns(rows: DataFrame, columns) -> DataFrame:
    """``rows`` with the fields of a schema that it lacks, all null: undecided."""
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in columns if f.name not in rows.columns))


def numbered(rows: DataFrame, partition: str, order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of each ``partition`` in the given order (a prefix limit, where the limit is the feature)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col("_r") <= limit).drop("_r")
