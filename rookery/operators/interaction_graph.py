"""The weighted graph of users and hashtags that messages imply; merging, degree and pruning.

All edges of one message are made inside its row, as one array of edge instances, so building the
graph takes one scan and one shuffle on the edge key, with partial sums before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.entities import hashtags, is_direct, mentions, reposts
from rookery.session import materialise

WEIGHTS = ("count_coc", "count_comm", "count_rt", "count_ht")


def _edge(src: Column, dst: Column, kind: str, weight: str, amount: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), *((amount.cast("long") if w == weight else zero).alias(w) for w in WEIGHTS))


def _empty() -> Column:
    return F.array().cast("array<struct<src:string,dst:string,kind:string,count_coc:bigint,count_comm:bigint,count_rt:bigint,count_ht:bigint>>")


def _together(names: Column, kind: str) -> Column:
    """Each ordered pair of different names, 2 * n_a * n_b times: every visit of the pair counts in both directions."""
    tallies = F.transform(F.array_distinct(names), lambda x: F.struct(x.alias("x"), F.size(F.filter(names, lambda y: y == x)).alias("n")))
    rows = F.transform(
        tallies,
        lambda a: F.transform(F.filter(tallies, lambda b: b["x"] != a["x"]), lambda b: _edge(a["x"], b["x"], kind, "count_coc", 2 * a["n"] * b["n"])),
    )
    return F.coalesce(F.flatten(rows), _empty())


def message_parts(records: DataFrame, author: str, text: str, recount: bool = True) -> DataFrame:
    """One row for each message with the pieces its edges are made of.

    ``targets``: whom the chain of repost marks names, up to the first mark that names nobody;
    ``direct``: the mentions a direct message opens with, without gaps; ``rest``: mentions that
    neither takes. With ``recount`` off only the first mark counts, and the mentions behind its
    target belong to nobody. Messages without an author or a text are left out.
    """
    t = F.col(text)
    rows = records.where(F.col(author).isNotNull() & t.isNotNull()).select(
        F.concat(F.lit("@"), F.lower(F.col(author).cast("string"))).alias("me"),
        mentions(t).alias("m"), hashtags(t).alias("h"), reposts(t).alias("rt"), is_direct(t).alias("is_direct"),
    )
    at = lambda r: F.filter(F.col("m"), lambda m: m["pos"] == r + 4)
    rows = rows.withColumn("named", F.transform("rt", lambda r: F.get(at(r), 0)))
    first_none = F.array_position(F.transform("named", lambda m: m.isNull()), True)
    rows = rows.withColumn("n_named", F.when(first_none == 0, F.size("named")).otherwise(first_none - 1).cast("int"))
    if not recount:
        rows = rows.withColumn("n_named", F.least("n_named", F.lit(1)))
    rows = rows.withColumn("chain", F.slice("named", F.lit(1), F.col("n_named")))
    if recount:
        left = F.filter("m", lambda m: ~F.array_contains(F.transform("chain", lambda c: c["pos"]), m["pos"]))
    else:
        left = F.when(F.size("chain") > 0, F.filter("m", lambda m: m["pos"] < F.get(F.col("chain"), 0)["pos"])).otherwise(F.col("m"))
    rows = rows.withColumn("left", left)
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def walk(acc: Column, m: Column) -> Column:
        on = acc["open"] & (m["pos"] == acc["next"])
        return F.struct(
            F.when(on, acc["next"] + F.length(m["value"]) + 2).otherwise(acc["next"]).alias("next"),
            (acc["n"] + on.cast("int")).alias("n"),
            on.alias("open"),
        )

    lead = F.when(F.col("is_direct"), F.aggregate("left", start, walk, lambda acc: acc["n"])).otherwise(F.lit(0))
    name = lambda mark: lambda m: F.concat(F.lit(mark), F.lower(m["value"]))
    rows = rows.withColumn("lead", lead)
    return rows.select(
        "me", "rt", "named",
        F.transform("chain", name("@")).alias("targets"),
        F.transform(F.slice("left", F.lit(1), F.col("lead")), name("@")).alias("direct"),
        F.transform(F.slice("left", F.col("lead") + 1, F.greatest(F.size("left") - F.col("lead"), F.lit(0))), name("@")).alias("rest"),
        F.transform("h", lambda h: F.struct(h["pos"].alias("pos"), name("#")(h).alias("tag"))).alias("tags"),
    )


def edge_arrays(parts: DataFrame, recount: bool = True) -> dict[str, Column]:
    """The edges of one message, by their origin."""
    me, targets, tags = F.col("me"), F.col("targets"), F.col("tags")
    sources = F.concat(F.array(me), F.slice(targets, F.lit(1), F.greatest(F.size(targets) - 1, F.lit(0))))
    reposts_ = F.zip_with(sources, targets, lambda s, d: _edge(s, d, "uu", "count_rt", F.lit(1)))
    direct = F.transform(F.filter("direct", lambda d: d != me), lambda d: _edge(me, d, "uu", "count_comm", F.lit(1)))
    names = F.transform(tags, lambda h: h["tag"])
    used = F.transform(names, lambda n: _edge(me, n, "uh", "count_ht", F.lit(1)))
    if recount:
        pairs = F.zip_with("rt", "named", lambda r, m: F.struct(r.alias("r"), m.alias("m")))
        again = F.transform(
            F.filter(pairs, lambda p: p["m"].isNotNull()),
            lambda p: F.transform(
                F.filter(tags, lambda h: h["pos"] > p["r"]),
                lambda h: _edge(F.concat(F.lit("@"), F.lower(p["m"]["value"])), h["tag"], "uh", "count_ht", F.lit(1)),
            ),
        )
        used = F.concat(used, F.coalesce(F.flatten(again), _empty()))
    return {
        "repost": F.when(F.size(targets) > 0, reposts_).otherwise(_empty()), "direct": direct,
        "mention": _together(F.col("rest"), "uu"), "hashtag": F.when(F.size(tags) > 1, _together(names, "hh")).otherwise(_empty()), "use": used,
    }


def _instances(parts: DataFrame, recount: bool, only: tuple[str, ...]) -> Column:
    return F.concat(*(c for k, c in edge_arrays(parts, recount).items() if not only or k in only))


def graph_edges(records: DataFrame, author: str = "userid", text: str = "msg", recount: bool = True, only: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, kind, count_coc, count_comm, count_rt, count_ht``: one row for each edge.

    ``kind`` is ``uu`` (user to user), ``uh`` (user to hashtag) or ``hh``. ``only`` restricts to
    some of ``repost, direct, mention, hashtag, use``. An empty input gives no edges.
    """
    parts = message_parts(records, author, text, recount)
    return merge_edges(parts.select(F.explode(_instances(parts, recount, only)).alias("e")).select("e.*"))


def graph_tables(records: DataFrame, author: str = "userid", text: str = "msg", recount: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (``name, type``) and edges of one scan and one shuffle: a node is an instance without an end and a weight."""
    parts = message_parts(records, author, text, recount)
    nobody = F.lit(None).cast("string")
    named = F.transform(_names(recount), lambda n: _edge(n, nobody, "node", "", F.lit(0)))
    both = materialise(merge_edges(parts.select(F.explode(F.concat(_instances(parts, recount, ()), named)).alias("e")).select("e.*")), "graph")
    return _typed(both.where("kind = 'node'").select(F.col("src").alias("name"))), both.where("kind <> 'node'")


def merge_edges(edges: DataFrame) -> DataFrame:
    """Sum of the weights of each (src, dst, kind): merging graphs is a union followed by this."""
    return edges.groupBy("src", "dst", "kind").agg(*(F.sum(w).alias(w) for w in WEIGHTS))


def _names(recount: bool) -> Column:
    names = F.concat(F.array(F.col("me")), F.col("targets"), F.col("direct"), F.col("rest"), F.transform("tags", lambda h: h["tag"]))
    if not recount:
        return names
    after = F.filter(F.zip_with("rt", "named", lambda r, m: F.when(F.exists("tags", lambda h: h["pos"] > r), F.concat(F.lit("@"), F.lower(m["value"])))), lambda x: x.isNotNull())
    return F.concat(names, after)


def _typed(names: DataFrame) -> DataFrame:
    return names.select("name", F.when(F.col("name").startswith("#"), "ht").otherwise("user").alias("type"))


def graph_nodes(records: DataFrame, author: str = "userid", text: str = "msg", recount: bool = True) -> DataFrame:
    """``name, type``: every author, and every user and hashtag that an edge or a remaining mention names."""
    return _typed(message_parts(records, author, text, recount).select(F.explode(_names(recount)).alias("name")).distinct())


def weighted_degree(nodes: DataFrame, edges: DataFrame, node: str = "name", src: str = "src", dst: str = "dst", weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """``node, in_w, out_w``: sums of all weights in and out; self-loops count on both sides, isolated nodes have 0."""
    total = sum((F.coalesce(F.col(w), F.lit(0)) for w in weights), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    ends = edges.select(F.explode(F.array(
        F.struct(F.col(src).alias(node), zero.alias("i"), total.alias("o")), F.struct(F.col(dst).alias(node), total.alias("i"), zero.alias("o"))
    )).alias("e")).select("e.*")
    sums = ends.unionByName(nodes.select(F.col(node), zero.alias("i"), zero.alias("o")))
    return sums.groupBy(node).agg(F.sum("i").alias("in_w"), F.sum("o").alias("out_w"))


def prune(degree: DataFrame, edges: DataFrame, thresholds: tuple[int, ...], node: str = "name", src: str = "src", dst: str = "dst") -> DataFrame:
    """``threshold`` and the edges both of whose ends have a total weight above it; degrees aren't counted again.

    An edge survives as long as the smaller total of its ends is above the threshold, so one pass
    over the edges serves all thresholds.
    """
    total = degree.select(F.col(node).alias("_n"), (F.col("in_w") + F.col("out_w")).alias("_t"))
    both = edges.join(total.select(F.col("_n").alias(src), F.col("_t").alias("_a")), src).join(total.select(F.col("_n").alias(dst), F.col("_t").alias("_b")), dst)
    least = F.least("_a", "_b")
    kept = F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t < least)
    return both.select(F.explode(kept).alias("threshold"), *edges.columns)


def kept_nodes(degree: DataFrame, thresholds: tuple[int, ...], node: str = "name") -> DataFrame:
    """``threshold, node`` of the nodes whose total weight is above it."""
    return degree.select(F.explode(F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t < F.col("in_w") + F.col("out_w"))).alias("threshold"), node)
