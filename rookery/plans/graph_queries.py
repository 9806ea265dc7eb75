"""Queries over the interaction graph and the relational edges, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery import schema
from rookery.functions.entities import HASHTAG, MENTION, REPOST
from rookery.operators import interaction_graph as g
from rookery.operators import relational as rel
from rookery.operators.ranking import with_ids
from rookery.plans.text_queries import RECORDS_SQL, records, sql_found
from rookery.session import materialise, table, work_path
from rookery.sources import messages, sinks

THRESHOLDS = (1, 5, 10, 50, 100)


def _some_edges(*only: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: g.graph_edges(records(spark, d).where("userid IS NOT NULL"), only=only)


def gr_edges_first_repost(spark: SparkSession, d: str) -> DataFrame:
    """Edges where only the first repost mark of a message counts."""
    return g.graph_edges(records(spark, d), recount=False)


def gr_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_nodes(records(spark, d))


def gr_node_ids(spark: SparkSession, d: str) -> DataFrame:
    return with_ids(gr_nodes(spark, d)).select("node_id", "name")


def gr_merged(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of two halves of the posts, merged: the same as the graph of all."""
    own = records(spark, d)
    halves = [g.graph_edges(own.where(F.col("tweet_id") % 2 == k)) for k in (0, 1)]
    return g.merge_edges(halves[0].unionByName(halves[1]))


def _degree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = g.graph_tables(records(spark, d))
    return g.weighted_degree(nodes, edges), edges


def gr_degree(spark: SparkSession, d: str) -> DataFrame:
    return _degree(spark, d)[0]


def gr_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Edges left at each threshold, with their number of nodes at the ends."""
    degree, edges = _degree(spark, d)
    return g.prune(degree, edges, THRESHOLDS).select("threshold", "src", "dst", "kind")


def gr_pruned_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.kept_nodes(_degree(spark, d)[0], THRESHOLDS)


def gr_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nodes of largest total weight, a report."""
    degree = _degree(spark, d)[0]
    return degree.select("name", "in_w", "out_w", (F.col("in_w") + F.col("out_w")).alias("total_w")).orderBy(F.desc("total_w"), "name").limit(20)


def _written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    nodes, edges = g.graph_tables(records(spark, d))
    nodes, folder = with_ids(nodes), work_path(spark, "graph-files")
    sinks.write_graph(nodes, edges, folder)
    return nodes, edges, folder


def snk_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as compressed text by node id, and read again."""
    return messages.parse_edges(spark.read.text(f"{_written(spark, d)[2]}/edges"))


def src_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as compressed text, and read again."""
    return messages.parse_nodes(spark.read.text(f"{_written(spark, d)[2]}/nodes"))


def src_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees by node id written as text, and read again."""
    nodes, edges, folder = _written(spark, d)
    degree = g.weighted_degree(nodes, edges).join(nodes.select("name", "node_id"), "name")
    degree.select(F.concat_ws(" ", "node_id", "in_w", "out_w").alias("value")).write.text(f"{folder}/degrees")
    return messages.parse_degrees(spark.read.text(f"{folder}/degrees"))


_LISTS = f"""
{RECORDS_SQL},
e AS (SELECT tweet_id, '@' || lower(userid) AS me, {sql_found('msg', MENTION, 1)} AS m, {sql_found('msg', HASHTAG, 1)} AS h,
  list_transform({sql_found('msg', REPOST)}, lambda z: z.pos) AS rt, regexp_matches(msg, '^\\s?@') AS is_direct FROM r WHERE userid IS NOT NULL),
n AS (SELECT *, list_transform(rt, lambda p: list_filter(m, lambda x: x.pos = p + 4)[1]) AS named FROM e),
c AS (SELECT *, named[1:len(list_filter(range(1, len(rt) + 1), lambda i: len(list_filter(named[1:i], lambda x: x IS NULL)) = 0))] AS chain FROM n),
f AS (SELECT *, list_filter(m, lambda x: NOT list_contains(list_transform(chain, lambda y: y.pos), x.pos)) AS lft FROM c),
k AS (SELECT *, CASE WHEN is_direct THEN len(list_filter(range(1, len(lft) + 1), lambda i: len(list_filter(range(1, i + 1),
  lambda j: lft[j].pos <> 1 + coalesce(list_sum(list_transform(lft[1:j-1], lambda q: length(q.value) + 2)), 0))) = 0)) ELSE 0 END AS lead FROM f),
rep AS (SELECT CASE WHEN u.i = 1 THEN me ELSE '@' || lower(chain[u.i - 1].value) END AS src, '@' || lower(chain[u.i].value) AS dst FROM k, unnest(range(1, len(chain) + 1)) AS u(i)),
dir AS (SELECT me AS src, '@' || lower(lft[u.i].value) AS dst FROM k, unnest(range(1, lead + 1)) AS u(i) WHERE me <> '@' || lower(lft[u.i].value)),
rest AS (SELECT tweet_id, '@' || lower(lft[u.i].value) AS x, count(*) AS n FROM k, unnest(range(lead + 1, len(lft) + 1)) AS u(i) GROUP BY 1, 2),
tag AS (SELECT tweet_id, me, '#' || lower(u.t.value) AS x, u.t.pos AS pos FROM k, unnest(h) AS u(t)),
tags AS (SELECT tweet_id, x, count(*) AS n FROM tag GROUP BY 1, 2),
again AS (SELECT '@' || lower(named[u.i].value) AS src, tag.x AS dst, k.tweet_id FROM k, unnest(range(1, len(rt) + 1)) AS u(i) JOIN tag ON tag.tweet_id = k.tweet_id AND tag.pos > rt[u.i] WHERE named[u.i] IS NOT NULL),
one AS (
  SELECT src, dst, 'uu' AS kind, 'repost' AS origin, 0 AS coc, 0 AS comm, 1 AS rt, 0 AS ht FROM rep
  UNION ALL SELECT src, dst, 'uu', 'direct', 0, 1, 0, 0 FROM dir
  UNION ALL SELECT a.x, b.x, 'uu', 'mention', 2 * a.n * b.n, 0, 0, 0 FROM rest a JOIN rest b ON a.tweet_id = b.tweet_id AND a.x <> b.x
  UNION ALL SELECT a.x, b.x, 'hh', 'hashtag', 2 * a.n * b.n, 0, 0, 0 FROM tags a JOIN tags b ON a.tweet_id = b.tweet_id AND a.x <> b.x
  UNION ALL SELECT me, x, 'uh', 'use', 0, 0, 0, 1 FROM tag
  UNION ALL SELECT src, dst, 'uh', 'use', 0, 0, 0, 1 FROM again),
nodes AS (SELECT me AS name FROM k UNION SELECT dst FROM rep UNION SELECT dst FROM dir UNION SELECT x FROM rest UNION SELECT x FROM tag UNION SELECT src FROM again)"""
_SUMS = "CAST(sum(coc) AS BIGINT) AS count_coc, CAST(sum(comm) AS BIGINT) AS count_comm, CAST(sum(rt) AS BIGINT) AS count_rt, CAST(sum(ht) AS BIGINT) AS count_ht"


def _edges_sql(*only: str) -> str:
    where = f" WHERE origin IN ({', '.join(repr(o) for o in only)})" if only else ""
    return f"WITH {_LISTS} SELECT src, dst, kind, {_SUMS} FROM one{where} GROUP BY 1, 2, 3"


_DEG = f"""WITH {_LISTS}, w AS (SELECT src, dst, kind, sum(coc + comm + rt + ht) AS t FROM one GROUP BY 1, 2, 3),
deg AS (SELECT name, coalesce((SELECT sum(t) FROM w WHERE w.dst = nodes.name), 0) AS in_w, coalesce((SELECT sum(t) FROM w WHERE w.src = nodes.name), 0) AS out_w FROM nodes),
lim AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold)"""
_FIRST = (
    _LISTS.replace("AS chain FROM n)", "AS chain_ FROM n), c1 AS (SELECT * EXCLUDE (chain_), chain_[1:1] AS chain FROM c)").replace(
        "list_filter(m, lambda x: NOT list_contains(list_transform(chain, lambda y: y.pos), x.pos)) AS lft FROM c)", "CASE WHEN len(chain) > 0 THEN list_filter(m, lambda x: x.pos < chain[1].pos) ELSE m END AS lft FROM c1)")
    .replace("\n  UNION ALL SELECT src, dst, 'uh', 'use', 0, 0, 0, 1 FROM again", "")
)
_IDS = f"WITH {_LISTS}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS node_id FROM nodes)"


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each profile as it was collected last."""
    rows = table(spark, d, "users")
    return rel.last_by_key(rows, "user_id", F.struct("date_of_collection", "friends_count", "followers_count"))


PROFILES_SQL = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_of_collection DESC NULLS LAST, friends_count DESC NULLS LAST, followers_count DESC NULLS LAST) AS k FROM users WHERE user_id IS NOT NULL) WHERE k = 1)"
POSTS_SQL = "t AS (SELECT DISTINCT ON (tweet_id) * FROM tweets WHERE tweet_id IS NOT NULL)"


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tweets").where("tweet_id IS NOT NULL").dropDuplicates(["tweet_id"])


def _type(kind: int, lost: bool = False, add_missing: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        gone = table(spark, d, "lost_profiles") if lost else None
        return rel.build_edges(profiles(spark, d), posts(spark, d), kind, gone, add_missing)

    return run


_E = {
    1: "SELECT user_id AS from_id, u.x AS to_id, CAST(1 AS SMALLINT) AS edge_type, CAST(-1 AS BIGINT) AS tweet_id FROM v, unnest(friends_list) AS u(x) WHERE u.x IS NOT NULL",
    2: "SELECT user_id AS from_id, u.x AS to_id, CAST(2 AS SMALLINT) AS edge_type, CAST(-1 AS BIGINT) AS tweet_id FROM v, unnest(followers_list) AS u(x) WHERE u.x IS NOT NULL",
    3: "SELECT user_id AS from_id, u.x AS to_id, CAST(3 AS SMALLINT) AS edge_type, tweet_id FROM t, unnest(user_mentions) AS u(x) WHERE u.x IS NOT NULL AND user_id IS NOT NULL",
    4: "SELECT user_id AS from_id, in_reply_to_user_id AS to_id, CAST(4 AS SMALLINT) AS edge_type, tweet_id FROM t WHERE in_reply_to_status_id IS NOT NULL AND in_reply_to_user_id IS NOT NULL AND user_id IS NOT NULL",
    5: "SELECT DISTINCT a.x AS from_id, b.x AS to_id, CAST(5 AS SMALLINT) AS edge_type, a.tweet_id FROM (SELECT tweet_id, u.x FROM t, unnest(user_mentions) AS u(x)) a JOIN (SELECT tweet_id, u.x FROM t, unnest(user_mentions) AS u(x)) b ON a.tweet_id = b.tweet_id AND a.x < b.x",
    6: "SELECT in_reply_to_user_id AS from_id, u.x AS to_id, CAST(6 AS SMALLINT) AS edge_type, tweet_id FROM t, unnest(user_mentions) AS u(x) WHERE in_reply_to_user_id IS NOT NULL AND u.x IS NOT NULL",
}
_BASE = f"WITH {PROFILES_SQL}, {POSTS_SQL}"
_ALL = " UNION ALL ".join(f"({_E[k]})" for k in _E)
_LOST = "(SELECT user_id FROM lost_profiles WHERE user_id IS NOT NULL)"


def rel_all(spark: SparkSession, d: str) -> DataFrame:
    return rel.build_edges(profiles(spark, d), posts(spark, d))


def rel_without_lost(spark: SparkSession, d: str) -> DataFrame:
    return rel.build_edges(profiles(spark, d), posts(spark, d), lost=table(spark, d, "lost_profiles"))


def rel_known_only(spark: SparkSession, d: str) -> DataFrame:
    return rel.build_edges(profiles(spark, d), posts(spark, d), add_missing=False)


def rel_missing_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rel.missing_profiles(rel_all(spark, d), profiles(spark, d))


def rel_shared_hashtag(spark: SparkSession, d: str) -> DataFrame:
    return rel.shared_hashtag_edges(posts(spark, d), "FakiNobiFest")


def rel_shared_hashtags(spark: SparkSession, d: str) -> DataFrame:
    """The relation over all hashtags, as classes of users."""
    return rel.shared_hashtag_classes(posts(spark, d))


def rel_shared_hashtag_heaviest(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of users of the hashtag that most users share."""
    uses = materialise(rel.hashtag_uses(posts(spark, d)), "hashtag-uses")
    top = uses.groupBy("hashtag").count().orderBy(F.desc("count"), "hashtag").first()
    hashtag = top["hashtag"] if top else ""
    return rel.user_pairs(uses.where(F.col("hashtag") == hashtag), hashtag)


def rel_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    """Replies numbered after the last stored edge."""
    last = rel.last_edge_id(table(spark, d, "graph"))
    return rel.edge_ids(rel.build_edges(profiles(spark, d), posts(spark, d), 4), last)


def rel_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The stored graph with its replies replaced by fresh ones; edges by type."""
    new = rel.build_edges(profiles(spark, d), posts(spark, d), 4)
    return rel.replace_types(table(spark, d, "graph"), new).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def rel_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """Stored profiles of even hops, then all others inserted if absent: the first write wins."""
    users = table(spark, d, "users").select("user_id", "khop", "friends_count", "date_of_collection")
    stored = rel.last_by_key(users.where("khop % 2 = 0"), "user_id", F.struct("date_of_collection", "friends_count"))
    return rel.insert_absent(stored, users, "user_id", F.struct(F.col("date_of_collection").isNull(), "date_of_collection", "friends_count")).select("user_id", "friends_count")


def rel_load_timelines(spark: SparkSession, d: str) -> DataFrame:
    """Timelines loaded into tables that hold the users of even hops and their posts: all users with their hop and number of posts."""
    users = rel.add_columns(profiles(spark, d).where("khop % 2 = 0"), schema.SAMPLING)
    tweets = posts(spark, d)
    stored = tweets.join(users.select("user_id"), "user_id", "left_semi").select(*tweets.columns)
    authors = tweets.where("user_id IS NOT NULL").select("user_id", "date_of_collection")
    users, tweets = rel.load_timelines(users, stored, authors, tweets)
    n = tweets.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"))
    return users.join(n, "user_id", "left").select("user_id", "khop", F.coalesce("n_posts", F.lit(0)).alias("n_posts"), "expand_user")


def rel_user_totals(spark: SparkSession, d: str) -> DataFrame:
    return rel.user_totals(table(spark, d, "graph").dropDuplicates(["edge_id"]))


def tab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scalar sums over the graph."""
    return table(spark, d, "graph").agg(F.count(F.lit(1)).alias("n"), F.count("hashtag").alias("n_tagged"), F.count_distinct("from_id").alias("n_from"), F.coalesce(F.max("edge_id"), F.lit(0)).alias("last_id"))


QUERIES = {
    "gr_edges": (_some_edges(), _edges_sql()),
    "gr_reposts": (_some_edges("repost"), _edges_sql("repost")),
    "gr_direct": (_some_edges("direct"), _edges_sql("direct")),
    "gr_mentions_together": (_some_edges("mention"), _edges_sql("mention")),
    "gr_hashtags_together": (_some_edges("hashtag"), _edges_sql("hashtag")),
    "gr_hashtag_use": (_some_edges("use"), _edges_sql("use")),
    "gr_edges_first_repost": (gr_edges_first_repost, f"WITH {_FIRST} SELECT src, dst, kind, {_SUMS} FROM one GROUP BY 1, 2, 3"),
    "gr_nodes": (gr_nodes, f"WITH {_LISTS} SELECT name, CASE WHEN name[1] = '#' THEN 'ht' ELSE 'user' END AS type FROM nodes"),
    "gr_node_ids": (gr_node_ids, f"{_IDS} SELECT node_id, name FROM ids"),
    "gr_merged": (gr_merged, _edges_sql()),
    "gr_degree": (gr_degree, f"{_DEG} SELECT name, CAST(in_w AS BIGINT) AS in_w, CAST(out_w AS BIGINT) AS out_w FROM deg"),
    "gr_pruned": (gr_pruned, f"{_DEG} SELECT threshold, src, dst, kind FROM w JOIN deg a ON a.name = src JOIN deg b ON b.name = dst JOIN lim ON a.in_w + a.out_w > threshold AND b.in_w + b.out_w > threshold"),
    "gr_pruned_nodes": (gr_pruned_nodes, f"{_DEG} SELECT threshold, name FROM deg JOIN lim ON in_w + out_w > threshold"),
    "gr_top_nodes": (gr_top_nodes, f"{_DEG} SELECT name, CAST(in_w AS BIGINT) AS in_w, CAST(out_w AS BIGINT) AS out_w, CAST(in_w + out_w AS BIGINT) AS total_w FROM deg ORDER BY total_w DESC, name LIMIT 20"),
    "snk_edge_lines": (snk_edge_lines, f"{_IDS}, s AS (SELECT src, dst, kind, {_SUMS} FROM one GROUP BY 1, 2, 3) SELECT a.node_id AS src, b.node_id AS dst, CASE WHEN kind = 'uu' THEN count_coc END AS count_coc, CASE WHEN kind = 'uu' THEN count_comm END AS count_comm, CASE WHEN kind = 'uu' THEN count_rt END AS count_rt, CASE kind WHEN 'uh' THEN count_ht WHEN 'hh' THEN count_coc END AS count_ht FROM s JOIN ids a ON a.name = src JOIN ids b ON b.name = dst"),
    **{f"rel_{n}": (_type(k), f"{_BASE} {_E[k]}") for k, n in enumerate(("friend", "follower", "mention", "reply", "co_mention", "co_reply"), 1)},
    "rel_shared_hashtag": (rel_shared_hashtag, f"WITH {POSTS_SQL}, s AS (SELECT DISTINCT user_id FROM t, unnest(hashtag_entities) AS u(h) WHERE lower(u.h) = 'fakinobifest' AND user_id IS NOT NULL) SELECT a.user_id AS from_id, b.user_id AS to_id, CAST(7 AS SMALLINT) AS edge_type, CAST(-1 AS BIGINT) AS tweet_id, 'fakinobifest' AS hashtag FROM s a JOIN s b ON a.user_id < b.user_id"),
    "rel_shared_hashtags": (rel_shared_hashtags, f"WITH {POSTS_SQL}, s AS (SELECT DISTINCT lower(u.h) AS hashtag, user_id FROM t, unnest(hashtag_entities) AS u(h) WHERE u.h IS NOT NULL AND user_id IS NOT NULL) SELECT hashtag, user_id, links FROM (SELECT hashtag, user_id, count(*) OVER (PARTITION BY hashtag) - 1 AS links FROM s) WHERE links > 0"),
    "rel_shared_hashtag_heaviest": (rel_shared_hashtag_heaviest, f"WITH {POSTS_SQL}, s AS (SELECT DISTINCT lower(u.h) AS hashtag, user_id FROM t, unnest(hashtag_entities) AS u(h) WHERE u.h IS NOT NULL AND user_id IS NOT NULL), x AS (SELECT hashtag FROM s GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, hashtag LIMIT 1) SELECT a.user_id AS from_id, b.user_id AS to_id, CAST(7 AS SMALLINT) AS edge_type, CAST(-1 AS BIGINT) AS tweet_id, hashtag FROM s a JOIN s b USING (hashtag) JOIN x USING (hashtag) WHERE a.user_id < b.user_id"),
    "rel_all": (rel_all, f"{_BASE} {_ALL}"),
    "rel_without_lost": (rel_without_lost, f"{_BASE} SELECT * FROM ({_ALL}) WHERE to_id NOT IN {_LOST} AND NOT (edge_type IN (5, 6) AND from_id IN {_LOST})"),
    "rel_known_only": (rel_known_only, f"{_BASE} SELECT * FROM ({_ALL}) WHERE to_id IN (SELECT user_id FROM v) AND (edge_type NOT IN (5, 6) OR from_id IN (SELECT user_id FROM v))"),
    "rel_missing_profiles": (rel_missing_profiles, f"{_BASE} SELECT DISTINCT to_id AS user_id FROM ({_ALL}) WHERE to_id NOT IN (SELECT user_id FROM v)"),
    "rel_edge_ids": (rel_edge_ids, f"{_BASE} SELECT from_id, to_id, edge_type, tweet_id, (SELECT coalesce(max(edge_id), 0) FROM graph) + row_number() OVER (ORDER BY edge_type, from_id, to_id, tweet_id) AS edge_id FROM ({_E[4]})"),
    "rel_replaced": (rel_replaced, f"{_BASE} SELECT edge_type, count(*) AS n FROM (SELECT edge_type FROM graph WHERE edge_type <> 4 UNION ALL SELECT edge_type FROM ({_E[4]})) GROUP BY 1"),
    "rel_insert_absent": (rel_insert_absent, "WITH a AS (SELECT user_id, friends_count, row_number() OVER (PARTITION BY user_id ORDER BY date_of_collection DESC NULLS LAST, friends_count DESC NULLS LAST) AS k FROM users WHERE khop % 2 = 0 AND user_id IS NOT NULL), b AS (SELECT user_id, friends_count, row_number() OVER (PARTITION BY user_id ORDER BY date_of_collection ASC NULLS LAST, friends_count ASC NULLS FIRST) AS k FROM users WHERE user_id IS NOT NULL) SELECT user_id, friends_count FROM a WHERE k = 1 UNION ALL SELECT user_id, friends_count FROM b WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM a)"),
    "src_nodes": (src_nodes, f"{_IDS} SELECT node_id, name FROM ids"),
    "src_degrees": (src_degrees, f"{_DEG}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS node_id FROM nodes) SELECT node_id, CAST(in_w AS BIGINT) AS in_w, CAST(out_w AS BIGINT) AS out_w FROM deg JOIN ids USING (name)"),
    "rel_load_timelines": (rel_load_timelines, f"{_BASE}, u AS (SELECT user_id, khop FROM v WHERE khop % 2 = 0), w AS (SELECT * FROM u UNION ALL SELECT DISTINCT user_id, CAST(NULL AS INTEGER) FROM t WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM u)) SELECT w.user_id, khop, coalesce(n, 0) AS n_posts, CAST(NULL AS BOOLEAN) AS expand_user FROM w LEFT JOIN (SELECT user_id, count(*) AS n FROM t GROUP BY 1) USING (user_id)"),
    "rel_user_totals": (rel_user_totals, "WITH e AS (SELECT DISTINCT ON (edge_id) * FROM graph), x AS (SELECT from_id AS user_id, edge_type FROM e UNION ALL SELECT to_id, edge_type FROM e) SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE edge_type = {t}) AS type_{t}" for t in range(1, 8)) + " FROM x GROUP BY 1"),
    "tab_counts": (tab_counts, "SELECT count(*) AS n, count(hashtag) AS n_tagged, count(DISTINCT from_id) AS n_from, coalesce(max(edge_id), 0) AS last_id FROM graph"),
}
