"""Scores, percentiles, three-valued decisions and hop expansion."""

import math

import pytest
from pyspark.sql import functions as F

from rookery.operators import scoring as sc
from rookery.plans import sampling as smp

POSTS = "tweet_id long, user_id long, tweet string, hashtag_entities array<string>, url_entities array<string>, user_mentions array<long>, in_reply_to_user_id long, created_at timestamp"


def posts(spark, rows):
    full = [(i, u, t, h, l, m, r) for i, u, t, h, l, m, r in rows]
    return spark.createDataFrame(full, POSTS.rsplit(",", 1)[0]).withColumn("created_at", F.lit("2024-03-01").cast("timestamp"))


def test_term_frequency(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "user_id long, word string, n long")
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    tf = lambda k: {r["term"]: r["tf"] for r in sc.term_frequency(counts, terms, k).collect()}
    assert tf("raw") == {"a": 2.0, "b": 1.0}
    assert tf("boolean") == {"a": 1.0, "b": 1.0}
    assert tf("augmented") == {"a": 1.0, "b": 0.75, "c": 0.5}
    with pytest.raises(ValueError, match="unknown kind"):
        tf("other")


def test_topics(spark):
    t = posts(spark, [(1, 1, "I love Cats!", None, None, None, None), (2, 1, "concatenate", ["CATS"], None, None, None), (3, 2, "see http://a.b/c/d", None, None, None, None), (4, 3, None, None, ["http://a.b/c"], None, None), (5, 4, "new york city", None, None, None, None), (6, 4, "newyork", None, None, None, None)])
    topics = spark.createDataFrame([("cats",), ("http://a.b/c",), ("New York",), ("",), (None,)], "topic string")
    assert sorted((r["tweet_id"], r["topic"]) for r in sc.topic_hits(t, topics).collect()) == [(1, "cats"), (2, "cats"), (3, "http://a.b/c"), (4, "http://a.b/c"), (5, "New York")]
    other = posts(spark, [(1, 1, "Привет мир", None, None, None, None), (2, 1, "cafeé", None, None, None, None), (3, 1, "un cafe", None, None, None, None), (4, 1, "cost: c++ (new)", None, None, None, None), (5, 1, "xc++", None, None, None, None), (6, 1, "приветмир", None, None, None, None)])
    words = spark.createDataFrame([("привет",), ("cafe",), ("c++ (new",)], "topic string")
    assert sorted((r["tweet_id"], r["topic"]) for r in sc.topic_hits(other, words).collect()) == [(1, "привет"), (3, "cafe"), (4, "c++ (new")]
    df = {r["topic"]: r["document_frequency"] for r in sc.document_frequency(t, topics.where("topic <> ''")).collect()}
    assert df["cats"] == pytest.approx(math.log10(1 / 4))
    assert sc.document_frequency(t.limit(0), topics.where("topic = 'cats'")).first()["document_frequency"] == 0.0


def test_percentile(spark):
    scores = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4, 5)], "score double")
    assert [r["score"] for r in sc.keep_top(scores, 0.8).collect()] == [5.0]
    assert sc.keep_top(scores, 0.0).count() == 5
    assert sc.keep_top(scores.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError, match="percentile"):
        sc.keep_top(scores, 1.5)


def test_cosine(spark):
    d = spark.createDataFrame([(1, "red fish"), (2, "blue bird"), (3, " "), (4, None)], "k long, t string")
    q = spark.createDataFrame([(0, "red fish")], "k long, t string")
    got = {r["k"]: r["cosine"] for r in sc.cosine_to_query(d, q, "k", "t").collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}


def test_documents_come_in_parts(spark):
    t = posts(spark, [(i, 1 if i % 10 else 2, f"word{i} the", None, None, None, None) for i in range(100)] + [(200, None, "x", None, None, None, None), (201, 3, None, None, None, None, None)])
    got = {(r["user_id"], r["part"]): r["words"] for r in sc.word_documents(t, part_posts=40).collect()}
    ones = [f"word{i}" for i in range(100) if i % 10]
    assert got == {(1, 0): ones[:40], (1, 1): ones[40:80], (1, 2): ones[80:], (2, 0): [f"word{i}" for i in range(0, 100, 10)]}


def test_scores_by_parent_are_those_of_each_alone(spark):
    t = posts(spark, [(1, 1, "cats cats dogs", None, None, None, None), (2, 2, "cats", None, None, None, None), (3, 3, "birds", None, None, None, None), (4, 4, "Dogs!", ["cats"], None, None, None)])
    topics = spark.createDataFrame([("cats",), ("dogs",)], "topic string")
    lists = {10: [1, 2, 3, 9], 11: [1, 1, 4], 12: [3, 9]}
    pairs = spark.createDataFrame([(p, u) for p, us in lists.items() for u in us], "parent_id long, user_id long")
    for kind in ("raw", "boolean", "augmented"):
        scores = sc.scores_by_parent(pairs, sc.topic_facts(t, topics), kind)
        got = {(r["parent_id"], r["user_id"]): r["score"] for r in scores.collect()}
        for parent, us in lists.items():
            own = spark.createDataFrame([(u,) for u in us], "user_id long")
            mine = t.join(own.distinct(), "user_id", "left_semi")
            alone = sc.tfdf_scores(own, sc.word_counts(mine), sc.document_frequency(mine, topics), kind)
            assert {u: pytest.approx(got[parent, u]) for u in us} == {r["user_id"]: r["score"] for r in alone.collect()}
    top = sc.top_by_parent(sc.scores_by_parent(pairs, sc.topic_facts(t, topics)), 0.5)
    assert {(10, 3), (10, 9), (12, 3), (12, 9)} <= {(r["parent_id"], r["user_id"]) for r in top.collect()}


def test_windows(spark):
    with pytest.raises(ValueError, match="window ends"):
        sc.in_window(posts(spark, []), "2024-03-01", "2024-03-01")
    t = posts(spark, [(1, 1, "x", None, None, None, None)])
    assert t.select(sc.days_since("2024-02-01", F.col("created_at")).alias("d")).first()["d"] == 29


def users(spark):
    rows = [(1, [2, 3], None, None, 5, 5), (2, [4], [5], None, 900, 200), (3, None, None, True, 5000, 1), (4, [1], None, False, None, None), (5, [], [6], None, None, 2000)]
    return spark.createDataFrame(rows, "user_id long, friends_list array<long>, followers_list array<long>, expand_user boolean, friends_count long, followers_count long")


def test_breadth_first(spark):
    t = posts(spark, [])
    seeds = spark.createDataFrame([(1,), (1,), (None,), (99,)], "user_id long")
    run = lambda **k: sorted((r["user_id"], r["khop"]) for r in smp.breadth_first(users(spark), t, seeds, smp.HopLimits(**k)).collect())
    assert run(friends=9, followers=9) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert run(friends=1, max_hops=1) == [(1, 0), (2, 1)]
    assert run() == [(1, 0)]
    lost = spark.createDataFrame([(2,)], "user_id long")
    assert sorted(r["user_id"] for r in smp.breadth_first(users(spark), t, seeds, smp.HopLimits(friends=9), lost).collect()) == [1, 3]


def test_decisions(spark):
    assert {r["user_id"]: r["expand_user"] for r in smp.degree_rule(users(spark)).collect()} == {1: None, 2: False, 3: True, 4: False, 5: None}
    asked = spark.createDataFrame([(1,), (3,), (4,), (7,), (7,), (None,)], "user_id long")
    assert {r["user_id"]: r["state"] for r in smp.state_partition(asked, users(spark)).collect()} == {1: "undecided", 3: "expand", 4: "reject", 7: "missing"}
    assert [r["user_id"] for r in smp.lost_profiles(asked, users(spark)).collect()] == [7]
    t = posts(spark, [(1, 1, "cats", None, None, None, None), (2, 2, "dogs", None, None, None, None), (3, 3, "dogs", None, None, None, None)])
    topics = spark.createDataFrame([("cats",)], "topic string")
    filtered = smp.filter_by_timeline(users(spark), t, topics, "2024-01-01", "2024-12-31")
    assert {r["user_id"]: (r["expand_user"], r["has_timeline_filter"]) for r in filtered.collect()} == {1: (None, True), 2: (False, True), 3: (True, None), 4: (False, None), 5: (None, None)}


def test_hops(spark):
    t = posts(spark, [(1, 1, "cats cats", ["Cats"], None, [2, 3], None), (2, 2, "cats are nice", ["x"], None, None, None), (3, 3, "dogs", ["cats"], None, None, None)])
    topics = spark.createDataFrame([("cats",)], "topic string")
    seed = spark.createDataFrame([(1,)], "user_id long")
    got = {r["user_id"]: r["source"] for r in smp.causal_hop(users(spark), t, topics, seed, "2024-01-01", "2024-12-31").collect()}
    assert got == {2: "mention", 3: "mention"}
    got = {r["user_id"]: r["source"] for r in smp.cascade_hop(users(spark), t, seed, "2024-01-01", "2024-12-31", 1, topics).collect()}
    assert got == {3: "mention"}  # 2 has too many friends and followers, 3 was decided for
    assert {r["topic"] for r in smp.harvest_hashtags(t, seed).collect()} == {"cats"}
    assert sorted(map(tuple, smp.harvest_topics(t, topics, 2).collect())) == [("x", 2)]
    assert sorted((r["user_id"], r["khop"]) for r in smp.causal_search(users(spark), t, topics, seed, "2024-01-01", "2024-12-31", 2).collect()) == [(1, 0), (2, 1), (3, 1), (5, 2)]  # 4 was decided against


def test_causal_rules(spark):
    """Posts about no topic don't hide mentions; rejected and unstored users aren't expanded; each parent has its own percentile."""
    u = spark.createDataFrame([(1, [4, 5], None), (2, [6], [7]), (3, None, None), (4, None, None), (5, None, None), (6, None, None), (7, None, None), (8, None, None)], "user_id long, friends_list array<long>, followers_list array<long>")
    t = posts(spark, [(1, 1, "cats", None, None, None, None), (2, 1, "weather", None, None, [3, 8, 99], None), (3, 8, "weather", None, None, None, None), (4, 4, "cats cats", None, None, None, None), (5, 5, "a cats day", None, None, None, None), (6, 2, "cats", None, None, None, None), (7, 6, "cats", None, None, None, None)])
    topics, frontier = spark.createDataFrame([("cats",)], "topic string"), spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {r["user_id"]: r["source"] for r in smp.causal_hop(u, t, topics, frontier, "2024-01-01", "2024-12-31", 1.0).collect()}
    assert got == {3: "mention", 4: "score", 5: "score", 6: "score", 7: "score"}  # all candidates mention cats: every score is 0
    few = smp.causal_hop(u, t, topics, frontier, "2024-01-01", "2024-12-31", 1.0, limit=1)
    assert {r["user_id"] for r in few.collect()} == {3, 4, 6, 7}


def test_cascade_expands_stored_users_only(spark):
    u = spark.createDataFrame([(1, [2], None, 1, 1), (2, None, None, 1, None)], "user_id long, friends_list array<long>, followers_list array<long>, friends_count long, followers_count long")
    t = posts(spark, [(1, 1, "cats", None, None, [2, 77], None)])
    got = smp.cascade_hop(u, t, spark.createDataFrame([(1,)], "user_id long"), "2024-01-01", "2024-12-31", 0)
    assert [tuple(r) for r in got.collect()] == [(2, "mention")]


def test_crawls_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    t, seeds = posts(spark, []), spark.createDataFrame([(1,)], "user_id long")
    u = spark.createDataFrame([(i, [i + 1], None) for i in range(1, 9)], "user_id long, friends_list array<long>, followers_list array<long>")
    state = str(tmp_path / "crawl")
    run = lambda hops: sorted((r["user_id"], r["khop"]) for r in smp.breadth_first(u, t, seeds, smp.HopLimits(friends=9, max_hops=hops), state=state).collect())
    assert run(1) == [(1, 0), (2, 1)]
    walked = []
    own = smp.next_frontier
    monkeypatch.setattr(smp, "next_frontier", lambda *a: walked.append(1) or own(*a))
    assert run(3) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert len(walked) == 2  # hop 1 wasn't walked again
    (tmp_path / "crawl" / "hop=3" / "_SUCCESS").unlink()  # as if the third hop had been cut short
    assert run(3) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert len(walked) == 3
    with pytest.warns(UserWarning, match="incomplete"):
        few = smp.breadth_first(u, t, seeds, smp.HopLimits(friends=9, max_bytes=100))
    assert few.count() < 8
