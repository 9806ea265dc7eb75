"""Hop-by-hop sampling of a stored network: breadth first, causal and cascade.

The driver keeps the hop number only; frontiers, visited users and decisions are tables. Each hop
is written to the shared folder, which cuts the lineage and survives lost executors; with a folder
named by the caller, a crawl that was stopped goes on from its last whole hop. ``expand_user`` is
three-valued: null is undecided, and a decision is never overwritten by a rule for the undecided.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.ranking import with_ranks
from rookery.operators.scoring import (
    TopicFacts,
    document_frequency,
    in_window,
    keep_top,
    most_similar,
    scores_by_parent,
    tfdf_scores,
    top_by_parent,
    topic_facts,
    topic_hits,
    word_counts,
)
from rookery.session import materialise, work_path
from rookery.sources.sinks import load_states, save_state, saved_hops

MAX_DEGREE = 1_000
# As a limit of ids: no limit.
EVERY = 2**31 - 1


@dataclass
class HopLimits:
    """How many ids of each kind a user may add to the next hop; 0 switches a source off."""

    friends: int = 0
    followers: int = 0
    mentions: int = 0
    replies: int = 0
    max_hops: int = 6
    max_bytes: int = 2 << 30


@dataclass
class Growth:
    """Sets of users by hop, as one table ``hop, set_name, user_id``."""

    parts: list[DataFrame] = field(default_factory=list)

    def add(self, hop: int, name: str, users: DataFrame) -> None:
        self.parts.append(users.select(F.lit(hop).alias("hop"), F.lit(name).alias("set_name"), "user_id"))

    def table(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


def _listed(users: DataFrame, column: str, limit: int) -> DataFrame:
    """The first ``limit`` ids of a list column; the list's order counts."""
    return users.select(F.explode(F.slice(column, 1, limit)).alias("user_id"))


def _named(tweets: DataFrame, frontier: DataFrame, ids: Column, limit: int) -> DataFrame:
    """The ``limit`` smallest distinct ids that the posts of each frontier user name."""
    own = tweets.join(frontier, "user_id", "left_semi").select(F.col("user_id").alias("_by"), ids.alias("user_id")).where("user_id IS NOT NULL").distinct()
    if limit < EVERY:
        own = with_ranks(own, "_by", "user_id").where(F.col("_rank") < limit)
    return own.select("user_id")


def next_frontier(users: DataFrame, tweets: DataFrame, frontier: DataFrame, limits: HopLimits) -> DataFrame:
    """Distinct users that the frontier leads to, by all sources that are switched on."""
    own = users.join(frontier, "user_id", "left_semi")
    parts = []
    if limits.friends:
        parts.append(_listed(own, "friends_list", limits.friends))
    if limits.followers:
        parts.append(_listed(own, "followers_list", limits.followers))
    if limits.mentions:
        parts.append(_named(tweets, frontier, F.explode("user_mentions"), limits.mentions))
    if limits.replies:
        parts.append(_named(tweets, frontier, F.col("in_reply_to_user_id"), limits.replies))
    if not parts:
        return frontier.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("user_id IS NOT NULL").distinct()


#: One user met by a crawl: whether it leads on, and the bytes of its stored profile.
MET = "user_id bigint, expand boolean, size bigint"


def _crawl(spark, seeds: DataFrame, hops: int, step: Callable[[DataFrame, int], DataFrame], state: str | None, max_bytes: int | None = None) -> DataFrame:
    """``user_id, khop`` of everyone who leads on, with the hop at which it was met first.

    ``step`` gives the users (``MET``) that a frontier meets; users met at an earlier hop are met no
    more. Every hop is one table below ``state``; hops that are there already aren't walked again.
    """
    root = state or work_path(spark, "crawl")
    if not saved_hops(spark, root):
        save_state(seeds, root, 0)
    for hop in range(len(saved_hops(spark, root)), hops + 1):
        seen = load_states(spark, root, MET)
        frontier = seen.where((F.col("hop") == hop - 1) & F.col("expand")).select("user_id")
        if frontier.isEmpty():
            break
        if max_bytes is not None and (volume := seen.where("expand").agg(F.sum("size")).first()[0] or 0) > max_bytes:
            warnings.warn(f"crawl incomplete: {volume} bytes of profiles were collected before hop {hop}", stacklevel=3)
            break
        met = step(frontier, hop - 1).where("user_id IS NOT NULL").groupBy("user_id").agg(F.max("expand").alias("expand"), F.max("size").alias("size"))
        save_state(met.join(seen.select("user_id"), "user_id", "left_anti").select("user_id", "expand", "size"), root, hop)
    return load_states(spark, root, MET).where("expand").select("user_id", F.col("hop").alias("khop"))


def breadth_first(users: DataFrame, tweets: DataFrame, seeds: DataFrame, limits: HopLimits, lost: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """``user_id, khop``: every user reached, with the hop at which it was first reached; seeds have 0.

    Users that aren't stored end a path, and so do lost profiles. The crawl stops after
    ``max_hops``, when nobody new is reached, or, with a warning that it is incomplete, once the
    profiles collected exceed ``max_bytes`` as JSON text. ``state`` names the folder of its hops.
    """
    size = F.octet_length(F.to_json(F.struct(*users.columns))).cast("long")
    n = F.coalesce(F.size("friends_list"), F.lit(0)) + F.coalesce(F.size("followers_list"), F.lit(0))
    stored = users.where("user_id IS NOT NULL").select("user_id", "friends_list", "followers_list", size.alias("size"), n.alias("_n"))
    stored = stored.groupBy("user_id").agg(F.max_by(F.struct("friends_list", "followers_list", "size"), F.struct("_n", "friends_list", "followers_list")).alias("x")).select("user_id", "x.*")
    if lost is not None:
        stored = stored.join(lost.select("user_id").where("user_id IS NOT NULL").distinct(), "user_id", "left_anti")
    stored = materialise(stored, "stored")
    sizes = stored.select("user_id", F.lit(True).alias("expand"), "size")

    def step(frontier: DataFrame, _: int) -> DataFrame:
        return sizes.join(next_frontier(stored, tweets, frontier, limits), "user_id", "left_semi")

    first = sizes.join(seeds.select("user_id").where("user_id IS NOT NULL").distinct(), "user_id", "left_semi")
    return _crawl(users.sparkSession, first, limits.max_hops, step, state, limits.max_bytes)


def decide(users: DataFrame, rule: Column, value: bool) -> DataFrame:
    """``expand_user`` becomes ``value`` where it is undecided and the rule holds (a null rule doesn't)."""
    return users.withColumn("expand_user", F.when(F.col("expand_user").isNull() & F.coalesce(rule, F.lit(False)), F.lit(value)).otherwise(F.col("expand_user")))


def has_high_degree(most: int = MAX_DEGREE) -> Column:
    """More than ``most`` friends and followers; where either count is unknown, nobody can say so."""
    return F.coalesce(F.col("friends_count") + F.col("followers_count") > most, F.lit(False))


def degree_rule(users: DataFrame, most: int = MAX_DEGREE) -> DataFrame:
    """Undecided users with more than ``most`` friends and followers aren't expanded."""
    return decide(users, has_high_degree(most), False)


def filter_by_timeline(users: DataFrame, tweets: DataFrame, topics: DataFrame, start: str, end: str) -> DataFrame:
    """Undecided users with posts in the window, but none about a topic, aren't expanded.

    ``has_timeline_filter`` becomes true for those who were tested; users without a post in the
    window aren't, and stay undecided.
    """
    window = in_window(tweets, start, end)
    posted = window.select("user_id").where("user_id IS NOT NULL").distinct().withColumn("_posted", F.lit(True))
    topical = topic_hits(window, topics).select("user_id").distinct().withColumn("_hit", F.lit(True))
    joined = users.join(posted, "user_id", "left").join(topical, "user_id", "left")
    tested = F.col("_posted").isNotNull() & F.col("expand_user").isNull()
    marked = joined.withColumn("has_timeline_filter", F.when(tested, F.lit(True)))
    return decide(marked, F.col("_posted").isNotNull() & F.col("_hit").isNull(), False).drop("_posted", "_hit")


def timeline_state(users: DataFrame, tweets: DataFrame) -> DataFrame:
    """``has_timeline``: whether any post is stored; ``timeline_is_relevant`` becomes false without one."""
    posts = tweets.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = users.join(posts, "user_id", "left")
    has = F.coalesce(F.col("_n") > 0, F.lit(False))
    relevant = F.when(~has, F.lit(False)).otherwise(F.col("timeline_is_relevant"))
    return joined.withColumn("has_timeline", has).withColumn("timeline_is_relevant", relevant).drop("_n")


def lost_profiles(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Ids that were asked for and didn't come."""
    return requested.select("user_id").where("user_id IS NOT NULL").distinct().join(returned.select("user_id"), "user_id", "left_anti")


def state_partition(asked: DataFrame, users: DataFrame) -> DataFrame:
    """``user_id, state``: missing, expand, reject or undecided, for each distinct id asked for."""
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("expand_user"), "expand").when(~F.col("expand_user"), "reject").otherwise("undecided")
    known = users.select("user_id", "expand_user", F.lit(True).alias("_there"))
    return asked.select("user_id").where("user_id IS NOT NULL").distinct().join(known, "user_id", "left").select("user_id", state.alias("state"))


def harvest_hashtags(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """``topic``: lower-case hashtags of the users' posts."""
    own = tweets.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return own.select(F.explode(F.transform("hashtag_entities", F.lower)).alias("topic")).where("topic <> ''").distinct()


def harvest_topics(tweets: DataFrame, topics: DataFrame, hop: int) -> DataFrame:
    """``topic, khop``: hashtags and links of posts about a topic that aren't topics yet."""
    own = tweets.join(topic_hits(tweets, topics).select("tweet_id").distinct(), "tweet_id", "left_semi")
    both = F.concat(F.transform(F.coalesce("hashtag_entities", F.array()), F.lower), F.coalesce("url_entities", F.array()))
    found = own.select(F.explode(both).alias("topic")).where("topic <> ''").distinct()
    return found.join(topics.select("topic"), "topic", "left_anti").select("topic", F.lit(hop).alias("khop"))


def hashtag_overlap(tweets: DataFrame, users: DataFrame, topics: DataFrame) -> DataFrame:
    """Users of whose hashtags at least one is a topic, in any case."""
    own = tweets.join(users.select("user_id").distinct(), "user_id", "left_semi")
    tags = own.select("user_id", F.explode(F.transform("hashtag_entities", F.lower)).alias("topic"))
    return tags.join(topics.select(F.lower("topic").alias("topic")).distinct(), "topic", "left_semi").select("user_id").distinct()


def friends_and_followers(users: DataFrame) -> DataFrame:
    """``parent_id, user_id``: both lists one after the other, duplicates kept; null lists are empty."""
    none = F.array().cast("array<bigint>")
    both = F.concat(F.coalesce("friends_list", none), F.coalesce("followers_list", none))
    return users.select(F.col("user_id").alias("parent_id"), F.explode(both).alias("user_id")).where("user_id IS NOT NULL")


def candid_scores(users: DataFrame, tweets: DataFrame, topics: DataFrame, parent: int, start: str, end: str, share: float = 0.5, kind: str = "raw") -> DataFrame:
    """``user_id, score, expand``: scores of a parent's friends and followers, and who is at or above the percentile."""
    window = in_window(tweets, start, end)
    candidates = friends_and_followers(users.where(F.col("user_id") == parent))
    own = window.join(candidates.select("user_id").distinct(), "user_id", "left_semi")
    df = document_frequency(own, topics)
    scores = materialise(tfdf_scores(candidates, word_counts(own), df, kind), "scores")
    top = keep_top(scores, share).select("user_id", F.lit(True).alias("expand"))
    return scores.join(top, "user_id", "left").select("user_id", "score", F.coalesce("expand", F.lit(False)).alias("expand"))


def _state_of(users: DataFrame) -> Column:
    return F.col("expand_user") if "expand_user" in users.columns else F.lit(None).cast("boolean")


@dataclass(frozen=True)
class CausalTables:
    """What causal hops read, made once for all of them.

    ``stored``: ``user_id, expand``, false for users who were decided against, by their profile or by
    their timeline. ``named``: ``user_id, x``, whom a user's posts in the window mention. ``listed``:
    ``parent_id, user_id``, friends and followers up to the limit.
    """

    stored: DataFrame
    named: DataFrame
    listed: DataFrame
    facts: TopicFacts


def causal_tables(users: DataFrame, tweets: DataFrame, topics: DataFrame, start: str, end: str, limit: int = 100) -> CausalTables:
    window = materialise(in_window(tweets, start, end).where("user_id IS NOT NULL"), "window")
    facts = topic_facts(window, topics)
    topical = facts.about.where("hit").select("user_id").distinct().withColumn("_hit", F.lit(True))
    posted = facts.documents.select("user_id", F.lit(True).alias("_posted"))
    own = users.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(_state_of(users)).alias("state"))
    against = (F.col("state") == False) | (F.col("state").isNull() & F.col("_posted").isNotNull() & F.col("_hit").isNull())  # noqa: E712
    stored = own.join(posted, "user_id", "left").join(topical, "user_id", "left").select("user_id", (~F.coalesce(against, F.lit(False))).alias("expand"))
    named = window.select("user_id", F.explode("user_mentions").alias("x")).where("x IS NOT NULL").distinct()
    parents = users.withColumns({c: F.slice(c, 1, limit) for c in ("friends_list", "followers_list")})
    return CausalTables(*(materialise(t, n) for t, n in ((stored, "stored"), (named, "named"), (friends_and_followers(parents), "listed"))), facts)


def _causal_met(tables: CausalTables, frontier: DataFrame, share: float) -> DataFrame:
    """``user_id, source, expand``: everyone stored whom the frontier meets; ``source`` is null for those below the percentile."""
    active = frontier.select("user_id").distinct().join(tables.stored.where("expand"), "user_id", "left_semi")
    mentioned = tables.named.join(active, "user_id", "left_semi").select(F.col("x").alias("user_id"), F.lit("mention").alias("source"))
    candidates = tables.listed.join(active.select(F.col("user_id").alias("parent_id")), "parent_id", "left_semi")
    scores = materialise(scores_by_parent(candidates, tables.facts), "scores")
    top = top_by_parent(scores, share).select("user_id", F.lit("score").alias("source"))
    both = mentioned.unionByName(top).unionByName(scores.select("user_id", F.lit(None).cast("string").alias("source")))
    met = both.groupBy("user_id").agg(F.min("source").alias("source"))
    return met.join(tables.stored, "user_id").select("user_id", "source", (F.col("source").isNotNull() & F.col("expand")).alias("expand"))


def causal_hop(users: DataFrame, tweets: DataFrame, topics: DataFrame, frontier: DataFrame, start: str, end: str, share: float = 0.05, limit: int = 100) -> DataFrame:
    """``user_id, source``: users whom one causal hop decides to expand.

    Frontier users who weren't decided against lead on: to everyone their posts in the window mention
    (source ``mention``), and, each by itself, to those of its friends and followers (``limit`` of
    each) whose scores are at or above the percentile among them (source ``score``). Only stored
    users are expanded, and nobody whose posts in the window are about no topic.
    """
    return _causal_met(causal_tables(users, tweets, topics, start, end, limit), frontier, share).where("expand").select("user_id", "source")


def causal_search(
    users: DataFrame, tweets: DataFrame, topics: DataFrame, seeds: DataFrame, start: str, end: str, hops: int = 5, share: float = 0.05, limit: int = 100, state: str | None = None
) -> DataFrame:
    """``user_id, khop``: users that causal hops reach; seeds have 0.

    Each user is decided at the hop that meets it first. ``state`` names the folder of the hops.
    """
    tables = causal_tables(users, tweets, topics, start, end, limit)
    size = F.lit(0).cast("long").alias("size")
    first = tables.stored.join(seeds.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "expand", size)
    return _crawl(users.sparkSession, first, hops, lambda frontier, _: _causal_met(tables, frontier, share).select("user_id", "expand", size), state)


def _cascade_met(stored: DataFrame, listed: DataFrame, window: DataFrame, frontier: DataFrame, hop: int, topics: DataFrame | None) -> DataFrame:
    """``user_id, source, expand`` like :func:`_causal_met`; ``stored`` has ``user_id, expand``."""
    active = frontier.select("user_id").distinct().join(stored.where("expand"), "user_id", "left_semi")
    own = window.join(active, "user_id", "left_semi")
    open_ = stored.where("expand").select("user_id")
    mentioned = own.select(F.explode("user_mentions").alias("user_id")).where("user_id IS NOT NULL").distinct().join(open_, "user_id", "left_semi")
    candidates = materialise(listed.join(active.select(F.col("user_id").alias("parent_id")), "parent_id", "left_semi").select("user_id").distinct().join(open_, "user_id", "left_semi"), "candidates")
    similar = materialise(most_similar(window.join(candidates, "user_id", "left_semi"), own, "user_id", "tweet", 0.8).select("user_id"), "similar")
    out = mentioned.select("user_id", F.lit("mention").alias("source")).unionByName(similar.select("user_id", F.lit("similar").alias("source")))
    if hop >= 1 and topics is not None:
        rest = candidates.join(similar, "user_id", "left_anti")
        out = out.unionByName(hashtag_overlap(window, rest, topics).select("user_id", F.lit("hashtag").alias("source")))
    both = out.unionByName(candidates.select("user_id", F.lit(None).cast("string").alias("source")))
    return both.groupBy("user_id").agg(F.min("source").alias("source")).select("user_id", "source", F.col("source").isNotNull().alias("expand"))


def _cascade_tables(users: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    state = _state_of(users)
    against = F.coalesce(state == False, has_high_degree())  # noqa: E712
    stored = users.where("user_id IS NOT NULL").groupBy("user_id").agg((~F.bool_or(against)).alias("expand"))
    parents = users.withColumns({c: F.slice(c, 1, limit) for c in ("friends_list", "followers_list")})
    return materialise(stored, "stored"), materialise(friends_and_followers(parents), "listed")


def cascade_hop(users: DataFrame, tweets: DataFrame, frontier: DataFrame, start: str, end: str, hop: int, topics: DataFrame | None = None, limit: int = 1_000) -> DataFrame:
    """``user_id, source``: users whom one cascade hop decides to expand.

    Everyone stored whom the frontier mentions in the window (``mention``) but those of too high a
    degree; of its friends and followers those most similar in text to the frontier's posts
    (``similar``); and from hop 1 on those among the rest who share a hashtag with the topics
    (``hashtag``).
    """
    stored, listed = _cascade_tables(users, limit)
    window = in_window(tweets, start, end)
    return _cascade_met(stored, listed, window, frontier, hop, topics).where("expand").select("user_id", "source")


def cascade_search(users: DataFrame, tweets: DataFrame, seeds: DataFrame, start: str, end: str, hops: int = 5, limit: int = 1_000, state: str | None = None) -> DataFrame:
    """``user_id, khop``: users that cascade hops reach; the hashtags of seeds that lead on are the topics.

    Each user is decided at the hop that meets it first. ``state`` names the folder of the hops.
    """
    window = materialise(in_window(tweets, start, end), "window")
    stored, listed = _cascade_tables(users, limit)
    size = F.lit(0).cast("long").alias("size")
    first = stored.join(seeds.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "expand", size)
    topics = materialise(harvest_hashtags(window, first.where("expand")), "topics")
    return _crawl(users.sparkSession, first, hops, lambda frontier, hop: _cascade_met(stored, listed, window, frontier, hop, topics).select("user_id", "expand", size), state)
