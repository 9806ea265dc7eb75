"""Queries run at the operators' own sizes, over whole tables."""

import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from rookery.operators import language_id as lid
from rookery.operators import relational as rel
from rookery.plans import model_queries as mq

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def from_sql(sql, columns):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "users", "tweets", "topics"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


@pytest.mark.parametrize(("name", "least"), [("lid_top_terms", 10_000), ("lid_selected", 1_800), ("lid_probabilities", 6 * 301)])
def test_language_features(spark, rows, name, least):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = rows(got, *columns)
    assert len(found) >= least
    assert found == from_sql(entry.oracle_sql()[name], columns)


def test_stream_has_the_default_model(spark, monkeypatch):
    models = []
    monkeypatch.setattr(mq, "run_stream", lambda spark, folder, model, *rest: models.append(model))
    mq.sm_labelled(spark, DATA)
    assert models[0].features == lid.train(mq._corpus(spark, DATA)).features


@pytest.fixture
def chain(spark, tmp_path):
    """Tables where user 3 leads to 4, 4 to 5 and so on up to 12, by the given sources in turn; users 1 and 2 lead nowhere."""

    def write(*sources):
        users, tweets = [], []
        for u in range(1, 13):
            by = sources[u % len(sources)] if 3 <= u < 12 else ""
            lists = {x: [u + 1] if x == by else None for x in ("friends_list", "followers_list")}
            users.append({"user_id": u, "khop": 1 if u == 3 else 2, "friends_count": 1, "followers_count": 1, **lists})
            tweets.append({"tweet_id": 100 + u, "user_id": u, "tweet": "cats", "user_mentions": [u + 1] if by == "mention" else None, "in_reply_to_user_id": u + 1 if by == "reply" else None, "created_at": datetime(2024, 3, 1)})
        for name, data in {"users": users, "tweets": tweets, "topics": [{"topic": "cats"}]}.items():
            schema = spark.read.parquet(f"{DATA}/{name}.parquet").schema
            spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in data], schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_breadth_first_goes_six_hops_by_all_sources(spark, rows, chain):
    got = entry.queries()["smp_breadth_first"](spark, chain("friends_list", "mention", "followers_list", "reply"))
    assert rows(got, "user_id", "khop") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5), (9, 6)]


def test_searches_go_five_hops(spark, rows, chain):
    folder = chain("mention")
    assert rows(entry.queries()["smp_causal"](spark, folder), "user_id", "khop") == [(3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5)]
    assert rows(entry.queries()["smp_cascade"](spark, folder), "user_id", "khop") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5)]


def test_breadth_first_against_brute_force(spark):
    want, at, hop = {}, {}, 0
    con = duckdb.connect()
    leads = f"""WITH {mq.PROFILES_SQL.replace('FROM users', f"FROM '{DATA}/users.parquet'")} SELECT user_id, unnest(list_concat(coalesce(friends_list, []), coalesce(followers_list, []))) FROM v
      UNION SELECT user_id, unnest(user_mentions) FROM '{DATA}/tweets.parquet' UNION SELECT user_id, in_reply_to_user_id FROM '{DATA}/tweets.parquet'"""
    for a, b in con.execute(leads).fetchall():
        at.setdefault(a, set()).add(b)
    stored = {r[0] for r in con.execute(f"SELECT DISTINCT user_id FROM '{DATA}/users.parquet' WHERE user_id IS NOT NULL").fetchall()}
    frontier = set(sorted(stored)[:3])
    while frontier and hop <= 6:
        want |= dict.fromkeys(frontier, hop)
        frontier = ({b for a in frontier for b in at.get(a, ())} & stored) - set(want)
        hop += 1
    got = entry.queries()["smp_breadth_first"](spark, DATA)
    assert {r["user_id"]: r["khop"] for r in got.collect()} == want
    assert max(want.values()) > 2


@pytest.mark.parametrize("name", ["rel_shared_hashtags", "rel_shared_hashtag_heaviest"])
def test_shared_hashtags(spark, rows, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = rows(got, *columns)
    assert found == from_sql(entry.oracle_sql()[name], columns)
    assert found


def test_classes_fold_the_pairs_of_every_hashtag(spark):
    posts = spark.createDataFrame([(1, ["A", "a", "b"]), (2, ["a", None]), (3, ["A"]), (3, ["c"]), (None, ["c"]), (4, None)], "user_id long, hashtag_entities array<string>")
    classes = rel.shared_hashtag_classes(posts)
    assert sorted(map(tuple, classes.collect())) == [("a", 1, 2), ("a", 2, 2), ("a", 3, 2)]
    assert rel.shared_hashtag_edges(posts, "a").count() * 2 == sum(r["links"] for r in classes.collect())
