"""Byte n-grams, information gain, naive Bayes and the message rule."""

import math

import pytest
from pyspark.sql import functions as F

from rookery.operators import language_id as lid


def rows(spark, *docs):
    data = [(i, lang, dom, t) for i, (lang, dom, t) in enumerate(docs)]
    return spark.createDataFrame(data, "doc long, lang string, domain string, t string").withColumn("bytes", F.encode("t", "utf-8"))


def terms(df):
    return {bytes.fromhex(r["term"]).decode("latin-1"): r["n"] for r in df.groupBy("term").agg(F.sum("n").alias("n")).collect()}


@pytest.mark.parametrize(("text", "wanted"), [("abc", "a ab abc b bc c"), ("abcd", "a ab abc abcd b bc bcd c cd d"), ("ab", ""), ("aaaa", "a aa aaa aaaa")])
def test_ngrams(spark, text, wanted):
    assert sorted(terms(lid.document_frequencies(rows(spark, ("x", "d", text))))) == sorted(wanted.split())


def test_no_ngram_crosses_documents(spark):
    got = terms(lid.document_frequencies(rows(spark, ("x", "d", "abc"), ("x", "d", "def"), ("y", "d", "abc"))))
    assert "cd" not in got
    assert got["abc"] == 2


def test_gain(spark):
    df = spark.createDataFrame([("01", "A", 2), ("02", "A", 2), ("02", "B", 2)], "term string, lang string, n long")
    multi = {r["term"]: r["ig"] for r in lid.information_gain(df, {"A": 2, "B": 2}, "lang", False).collect()}
    assert multi["01"] == pytest.approx(math.log(2))
    assert multi["02"] == pytest.approx(0)
    each = {(r["term"], r["event"]): r["ig"] for r in lid.information_gain(df, {"A": 2, "B": 2}, "lang", True).collect()}
    assert each["01", "B"] == pytest.approx(math.log(2))


def test_naive_bayes(spark):
    counts = spark.createDataFrame([("f1", "A", 3), ("f2", "A", 1)], "feature string, lang string, n long")
    features = spark.createDataFrame([("f1",), ("f2",)], "feature string")
    got = {(r["feature"], r["lang"]): r["ptc"] for r in lid.naive_bayes(counts, features, ["A", "B"]).collect()}
    assert got["f1", "A"] == pytest.approx(-0.405465, abs=1e-6)
    assert got["f2", "A"] == pytest.approx(-1.098612, abs=1e-6)
    assert got["f1", "B"] == pytest.approx(-math.log(2))
    weights = {r["feature"]: r["weight"] for r in lid.pair_weights(lid.naive_bayes(counts, features, ["A", "B"]), "A", "B").collect()}
    assert weights["f1"] == pytest.approx(abs(2 / 3 - 1 / 2) / (2 / 3 + 1 / 2))


def test_scan_agrees_with_counts(spark):
    own = rows(spark, ("x", "d", "ababa"), ("y", "d", "bab"), ("y", "d", ""))
    features = [x.encode().hex().upper() for x in ("ab", "aba", "b")]
    a = {(r["feature"], r["lang"]): r["n"] for r in lid.feature_counts(own, features).collect()}
    b = {(r["feature"], r["lang"]): r["n"] for r in lid.scan(own, "lang", features).groupBy("feature", "lang").agg(F.sum("n").alias("n")).collect()}
    assert a == b == {("6162", "x"): 2, ("616261", "x"): 2, ("62", "x"): 2, ("6162", "y"): 1, ("62", "y"): 2}


def test_train_and_classify(spark):
    texts = [("de", "der hund und die katze sind nicht hier"), ("en", "the dog and the cat are not here today"), ("de", "das ist nicht schlecht und auch nicht gut"), ("en", "this is not bad and it is not good")]
    own = rows(spark, *[(lang, dom, t) for dom in ("p", "q") for lang, t in texts])
    model = lid.train(own, per_order=500, per_language=50)
    ranked = lid.classify(rows(spark, ("?", "", "und nicht die katze"), ("?", "", "and not the cat at all"), ("?", "", "")), ["doc", "t"], model)
    best = {r["doc"]: r["lang"] for r in ranked.where("rank = 1").collect()}
    assert best[0] == "de"
    assert best[1] == "en"
    labels = lid.message_language(ranked, rows(spark, ("?", "", "und nicht die katze"), ("?", "", "and not the cat at all"), ("?", "", "")), "doc", "t", ("en",))
    assert {r["doc"]: r["lid_lui"] for r in labels.collect()} == {0: "--", 1: "en", 2: "--"}
    assert lid.train(own, words=True, per_order=500, per_language=5).features


def test_selection(spark):
    df = spark.createDataFrame([("01", "A", "d", 5), ("02", "A", "d", 5), ("03", "A", "d", 1), ("0102", "A", "d", 1)], "term string, lang string, domain string, n long")
    assert sorted(r["term"] for r in lid.top_terms(df, 1).collect()) == ["01", "0102"]
    assert sorted(r["term"] for r in lid.top_terms(df, total=2).collect()) == ["01", "02"]
    assert lid.min_domain(rows(spark, ("x", "d", "a"), ("x", "e", "b"), ("y", "d", "c")), 2).count() == 2


def test_empty(spark):
    own = rows(spark, ("x", "d", "abc")).limit(0)
    assert lid.document_frequencies(own).count() == 0
    assert lid.scan(own, "lang", ["61"]).count() == 0
