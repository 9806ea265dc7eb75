"""Readers, writers, connectors, rate limits and the live stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from rookery import schema
from rookery.operators import interaction_graph as g
from rookery.operators import language_id as lid
from rookery.operators.ranking import with_ids
from rookery.sources import connectors as api
from rookery.sources import messages, sinks
from rookery.streaming.live_language import label_statuses, run_stream


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_tsv(spark, tmp_path):
    rows = ["1\td\ten\t(40.5,-74)\tu\tfirst\textra", "1\td\ten\t(40.5,-74)\tu\tlast  ", "2\td\ten\t(40)\tu", "3\td\tfr\tnowhere\tv\té"]
    with gzip.open(tmp_path / "a.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\n")
    got = {r["id"]: (r["lid_gnip"], r["geo"] and tuple(r["geo"]), r["userid"], r["msg"]) for r in messages.read_tsv(spark, str(tmp_path / "a.tsv.gz")).collect()}
    assert got == {"1": ("en", (40.5, -74.0), "u", "last"), "3": ("fr", None, "v", "é")}


def test_records(spark, tmp_path):
    assert messages.read_records(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([("1", "d", "u", "m", None, "en", None, [(4, "x")], None, [0], True, None, None)], schema.RECORD)
    sinks.save_records(df, str(tmp_path / "r"))
    assert messages.read_records(spark, str(tmp_path / "r")).first()["hashtags"][0]["value"] == "x"


def test_json_folders(spark, tmp_path):
    user = {"id": 7, "name": "N", "screen_name": "s", "friends_list": [1], "utc_offset": -3600, "DOC": "04-22-2015 03:39:06"}
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text(json.dumps(user))
    (tmp_path / "u" / "empty.json").write_text("")
    (tmp_path / "u" / "bad.json").write_text("{no")
    (tmp_path / "u" / "noid.json").write_text('{"name": "x"}')
    (tmp_path / "u" / "other.txt").write_text(json.dumps(user))
    got = messages.read_profiles(spark, str(tmp_path / "u")).collect()
    assert [(r["user_id"], r["geo_enabled"], r["utc_offset"], r["date_of_collection"].year) for r in got] == [(7, False, "-3600", 2015)]
    post = {"id": 1, "created_at": "Wed Apr 22 03:39:06 +0000 2015", "text": "t", "user": user, "geo": {"coordinates": [1.0, 2.0]}, "entities": {"hashtags": [{"text": "H"}], "user_mentions": [{"id": 5}]}}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "many.json").write_text(json.dumps([post, {**post, "id": 2, "geo": None}]))
    (tmp_path / "t" / "one.json").write_text(json.dumps({**post, "id": 3}))
    tweets, authors = messages.read_timelines(spark, str(tmp_path / "t"))
    assert sorted((r["tweet_id"], r["latitude"], r["longitude"]) for r in tweets.collect() if r["latitude"]) == [(1, 2.0, 1.0), (3, 2.0, 1.0)]
    assert tweets.where("tweet_id = 2").first()["hashtag_entities"] == ["H"]
    assert {r["user_id"] for r in authors.collect()} == {7}


def test_dates(spark):
    df = lines(spark, "Wed Apr 22 03:39:06 EDT 2015", "Wed Apr 22 23:39:06 +0000 2015", "04-22-2015 03:39:06", "junk", None)
    got = df.select(messages.day_key(F.col("value")).alias("k"), messages.created_date(F.col("value")).cast("string").alias("d"), messages.collected_at(F.col("value")).cast("string").alias("c")).collect()
    assert [r["k"] for r in got] == ["20150422", None, None, None, None]
    assert [r["d"] for r in got][1] == "2015-04-22"
    assert [r["c"] for r in got][2:] == ["2015-04-22 03:39:06", None, None]


def test_graph_files(spark, tmp_path):
    df = spark.createDataFrame([("z", "@b #x #y RT @c: hi"), ("z", "RT @c: @d @e")], "userid string, msg string")
    nodes, e = with_ids(g.graph_nodes(df)), g.graph_edges(df)
    sinks.write_graph(nodes, e, str(tmp_path))
    back = messages.parse_edges(spark.read.text(str(tmp_path / "edges")))
    assert back.count() == e.count()
    assert back.agg(F.sum("count_rt")).first()[0] == 2
    assert messages.parse_nodes(spark.read.text(str(tmp_path / "nodes"))).count() == nodes.count()
    assert messages.parse_degrees(lines(spark, "1 2 3", "", "  ")).collect()[0]["out_w"] == 3
    with pytest.raises(Exception, match="line with 2 fields"):
        messages.parse_edges(lines(spark, "1 2")).collect()
    with pytest.raises(Exception, match="edge without node"):
        sinks.edge_lines(e, nodes.limit(0)).collect()


def test_corpus_and_weights(spark, tmp_path):
    (tmp_path / "c" / "web" / "de").mkdir(parents=True)
    (tmp_path / "c" / "web" / "de" / "x").write_bytes(b"abc")
    assert [(r["domain"], r["lang"], bytes(r["bytes"])) for r in messages.read_corpus(spark, str(tmp_path / "c")).collect()] == [("web", "de", b"abc")]
    w = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", float("nan"))], "t string, w double")
    sinks.write_weights(w, str(tmp_path / "w"), "t", "w")
    assert {r["term"]: r["weights"] for r in messages.read_weights(spark, str(tmp_path / "w")).collect()} == {"a": [1.0], "b": [1.0], "c": [0.0]}
    v = spark.createDataFrame([("it's, \\ so", [1.0, 2.5]), ("a", [0.5, float("nan")])], "t string, w array<double>")
    sinks.write_weights(v, str(tmp_path / "v"), "t", "w")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()][0] == "'a',0.5,NaN"
    assert {r["term"]: r["weights"] for r in messages.read_weights(spark, str(tmp_path / "v")).collect()} == {"a": [0.5, 0.0], "it's, \\ so": [1.0, 2.5]}
    (tmp_path / "plain").write_text("x,1.5\ny,nan\n")
    assert {r["term"]: r["weights"] for r in messages.read_weights(spark, str(tmp_path / "plain")).collect()} == {"x": [1.5], "y": [0.0]}
    assert sinks.data_volume(spark, str(tmp_path / "c")) == pytest.approx(3 / 2**30)


def test_split_list():
    assert messages.split_list(list("abcdefg"), 3) == [["a", "b", "c"], ["d", "e"], ["f", "g"]]
    assert messages.split_list(["a"], 5) == [["a"]]
    assert messages.split_list([], 2) == [[]]


def test_lines_and_state(spark, tmp_path):
    counts = spark.createDataFrame([(1, "U", "b", 1.0), (1, "U", "aé", 2.0)], "doc_id long, user_id string, word string, cnt double")
    assert sinks.count_lines(counts).first()["line"] == "1 u a|2.0 b|1.0"
    assert sinks.display_lines(counts, "word", "b").first()["text"] == "cnt: 1.0\ndoc_id: 1\nuser_id: U\nword: b"
    for hop in (0, 1, 1):
        sinks.save_state(spark.createDataFrame([(hop,)], "user_id long"), str(tmp_path), hop)
    sinks.save_state(spark.createDataFrame([(3,)], "user_id long"), str(tmp_path), 3)  # hop 2 is missing
    assert sinks.saved_hops(spark, str(tmp_path)) == [0, 1]
    assert [r["user_id"] for r in sinks.load_state(spark, str(tmp_path), "user_id long").collect()] == [1]
    assert sinks.load_states(spark, str(tmp_path / "none"), "user_id long").count() == 0
    own = spark.createDataFrame([(1, "Größe 5", "20240203"), (2, None, None), (None, "x", "20240203")], "id long, m string, day string")
    assert [r["line"] for r in sinks.message_lines(own, "id", "m").collect()] == ["1\tGre 5"]
    assert [r["line"] for r in sinks.date_lines(own, "id", "day").collect()] == ["1.counts 20240203"]
    sinks.write_lines(sinks.date_lines(own, "id", "day"), str(tmp_path / "dates"))
    assert spark.read.text(str(tmp_path / "dates")).first()["value"] == "1.counts 20240203"
    kept = sinks.keep_percentage(counts.limit(0), F.lit(True)).first()
    assert (kept["n_lines"], kept["percentage"]) == (0, None)


def test_searches(spark):
    t = spark.createDataFrame([(1, 1, "Red fish", ["A"], 0.0, 0.0, 5, 0, None), (2, 1, "blue fish", None, 0.0, 1.0, 9, 0, 4), (3, 2, "RT @bob: red bird", ["a"], None, None, 0, 0, None)], "tweet_id long, user_id long, tweet string, hashtag_entities array<string>, latitude double, longitude double, retweet_count int, favorite_count long, in_reply_to_status_id long").withColumn("created_at", F.timestamp_seconds("tweet_id"))
    ids = lambda df: [r["tweet_id"] for r in df.collect()]
    assert ids(api.search_tweets(t, "red fish")) == [1]
    assert ids(api.search_tweets(t, "red fish", exclusive=True, kind="recent")) == [3, 2, 1]
    assert ids(api.search_tweets(t, "fish", around=(0.0, 0.0, 10.0), kind="popular")) == [1]
    assert ids(api.search_tweets(t, until="1970-01-01 00:00:02")) == [1]
    assert sorted(ids(api.search_hashtag(t, "#A"))) == [1, 3]
    u = spark.createDataFrame([(1, "Bob"), (1, None), (2, "al")], "user_id long, screen_name string")
    again = [(4, 2, "RT @BOB: Red fi…", None, None, None, 0, 0, None), (5, 2, "RT @bob: Red fish", None, None, None, 0, 0, None), (0, 2, "RT @bob: Red fish", None, None, None, 0, 0, None)]
    more = t.unionByName(spark.createDataFrame(again, t.drop("created_at").schema).withColumn("created_at", F.timestamp_seconds("tweet_id")))
    assert ids(api.reposts_of(more, u, 1)) == [5, 4]
    assert ids(api.reposts_of(more, u, 1, limit=0)) == [5]
    assert ids(api.reposts_of(more, u, 1, same_text=False)) == [5, 4, 3]
    assert ids(api.reposts_of(more, u, 99)) == []
    spoken = t.withColumn("lang", F.when(F.col("tweet_id") == 2, "EN_us"))
    assert ids(api.search_tweets(spoken, "fish", lang="en")) == [2]
    links = lines(spark, "http://a.b/c.jfif", "http://a.b/c.PNG", "http://a.b/c.svg", "http://a.b/jpg", "x.mp4", None)
    assert sorted(r["value"] for r in links.where(api.is_media(F.col("value"))).collect()) == ["http://a.b/c.jfif", "x.mp4"]
    assert ids(api.timeline(t, 1, replies=False)) == [1]
    asked = spark.createDataFrame([(1,), (9,)], "tweet_id long")
    assert sorted(ids(api.get_tweets(t, asked, True))) == [1, 9]
    assert [(r["name"], r["n"]) for r in api.trends(t.withColumn("country", F.lit("x"))).collect()] == [("#a", 2)]
    assert api.query_string(["a", "b"], True) == "a OR b"


def test_places(spark):
    p = spark.createDataFrame([(1, "Isle", "X", "city", 9.0, 179.0, 10.0, -179.0), (2, "Port", "Y", "city", 9.0, 0.0, 10.0, 1.0), (3, "Nook", "Y", "poi", 9.0, 0.0, 10.0, 1.0)], "place_id int, place_full_name string, country string, place_type string, south double, west double, north double, east double")
    ids = lambda df: [r["place_id"] for r in df.collect()]
    assert ids(api.search_places(p, position=(9.5, -179.5))) == [1]
    assert ids(api.search_places(p, q="po", country="Y")) == [2]
    assert ids(api.reverse_geocode(p, 9.5, 180.0, "city")) == [1, 2]
    assert ids(api.reverse_geocode(p, 9.5, 180.0, "city", 0)) == []
    with pytest.raises(ValueError, match="no position"):
        api.reverse_geocode(p, 91.0, 0.0)
    with pytest.raises(ValueError, match="granularity"):
        api.reverse_geocode(p, 9.0, 0.0, "room")


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = api.RateLimiter(2, {"x": 2}, clock=lambda: now[0], sleep=sleep)
    assert [limiter.take("x") for _ in range(4)] == [0, 0, 1, 1]
    assert not slept
    assert limiter.take("x") == 0
    assert slept == [900.0]


def test_credentials(tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        api.Credentials([{"API_KEY": "k"}])
    good = api.Credentials([{k: "secret" for k in api.Credentials.__dataclass_fields__["needed"].default}])
    assert "secret" not in repr(good)
    (tmp_path / "good.json").write_text(json.dumps(good.keys[0]))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "part.json").write_text('{"API_KEY": "k"}')
    with pytest.warns(UserWarning, match="no key set"):
        loaded = api.Credentials.load(str(tmp_path))
    assert loaded.keys == good.keys
    assert loaded.pick(1) == good.keys[0]
    assert loaded.working(lambda k: True).keys == good.keys
    with pytest.raises(ValueError, match="no keys"):
        loaded.working(lambda k: False)


def test_shares_never_overdraw_a_key():
    for answers, keys, calls in ((1, 1, 180), (7, 2, 180), (1_000, 1, 180), (3, 5, 1)):
        own, window = api.shares(answers, keys, calls, 900.0)
        assert answers * own / window <= keys * calls / 900.0 + 1e-9


def test_paged_source(spark, tmp_path):
    pages = [{"rows": [{"user_id": 1, "screen_name": "a"}], "next": 1}, {"rows": [{"user_id": 2}, {"user_id": 3}], "next": 0}]
    (tmp_path / "x.json").write_text(json.dumps({"pages": pages}))
    api.register(spark)
    rows = spark.read.format("rookery_pages").option("path", str(tmp_path)).load().collect()
    assert [(r["user_id"], r["screen_name"]) for r in rows] == [(1, "a"), (2, None), (3, None)]
    assert spark.read.format("rookery_pages").option("path", str(tmp_path)).option("limit", 2).load().count() == 2


def test_live_stream(spark, tmp_path):
    docs = [("de", "der hund und die katze sind nicht hier"), ("en", "the dog and the cat are not here today")] * 3
    own = spark.createDataFrame([(i, lang, "d", t) for i, (lang, t) in enumerate(docs)], "doc long, lang string, domain string, t string").withColumn("bytes", F.encode("t", "utf-8"))
    model = lid.train(own, per_order=200, per_language=40, domain_gain=False)
    (tmp_path / "in").mkdir()
    status = lambda t, n=0: json.dumps({"text": t, "retweet_count": n})
    (tmp_path / "in" / "a.txt").write_text("\n".join([status("und die katze nicht"), status("and the cat not here"), status("again", 1), status(""), "{broken"]))
    out = run_stream(spark, str(tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["lang"] for r in out.collect()) == ["de", "en"]
    (tmp_path / "in" / "b.txt").write_text(status("the dog today"))
    assert run_stream(spark, str(tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "ck")).count() == 3
    assert [r["lang"] for r in label_statuses(spark.read.text(str(tmp_path / "in")), model, ("de",)).collect()] == ["de"]
