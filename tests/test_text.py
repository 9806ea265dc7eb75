"""Entities and normalizer stages on hand-derived fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from rookery.functions import entities, text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_entities(spark):
    msg = "RT @Ann: see #Big #big http://t.co/x https://t.co/y me@site"
    pairs = lambda x: [(e["pos"], e["value"]) for e in x]
    assert pairs(one(spark, entities.mentions, msg)) == [(4, "Ann"), (55, "site")]
    assert pairs(one(spark, entities.hashtags, msg)) == [(14, "Big"), (19, "big")]
    assert pairs(one(spark, entities.links, msg)) == [(23, "http://t.co/x")]
    assert one(spark, entities.reposts, msg) == [0]
    assert one(spark, entities.is_direct, msg) is False
    assert one(spark, entities.is_direct, " @x") is True


@pytest.mark.parametrize("msg", ["", "@a", "x@b@c", "é 🐟 @d #e @f", "@@g #", "@a" * 500, "#x @y\n#z"])
def test_offsets_agree_with_finditer(spark, msg):
    got = [(e["pos"], e["value"]) for e in one(spark, entities.mentions, msg)]
    assert got == [(m.start() + 1, m.group()[1:]) for m in re.finditer(r"@[a-zA-Z0-9_]+", msg)]


def test_entities_of_null(spark):
    assert one(spark, entities.mentions, None) is None
    row = entities.with_entities(spark.createDataFrame([("plain",), (None,)], "msg string")).collect()
    assert all(r[c] is None for r in row for c in ("http_links", "hashtags", "mentions", "retweet", "user_msg"))


@pytest.mark.parametrize(
    ("stage", "given", "wanted"),
    [
        (text.transliterate, "Œuvre œ café ½", "oeuvre R cafe 1/2"), (text.transliterate, "I am a", "I am."), (text.transliterate, "日本 ok", "ok"), (text.transliterate, "", ""),
        (text.cap_repeats, "heyyyyy hahahaha jajajaj", "heyyy haha jaja"), (text.remove_word_ends, "hi. there! ok?", "hi there ok"),
        (text.remove_meta, "RT @a: go RT now", ": go now"), (text.remove_markup, "a <b> http://x.y/z c &quot;", "a c"), (text.remove_punctuation, 'say "yes", (or) no -- ok ;)', "say yes or no ok ;)"),
    ],
)
def test_stages(spark, stage, given, wanted):
    assert one(spark, stage, given) == wanted


def test_sentences(spark):
    assert one(spark, text.sentences, 'He left. "Go." ok? yes') == ["He left.", '"Go."', "ok?", "yes"]
    assert one(spark, text.sentences, "") == []
    assert one(spark, text.sentences, None) is None


def test_normalize_and_counts(spark):
    assert one(spark, text.normalize, "@bob Heyyyyy! see http://t.co/x. ok") == "Heyyy! see ok"
    assert one(spark, text.normalize, "@bob") == ""
    assert one(spark, text.normalize, None) is None
    assert one(spark, text.count_words, "") == [""]
    assert sorted(one(spark, text.count_words, "A b. a")) == ["a", "a", "b"]


def test_clean_words(spark):
    words = lambda c: text.clean_words(F.split(c, " "))
    assert one(spark, words, "RT The cat's http://a.b/C! ok, \"\"") == ["cats", "http://a.b/C!", "ok"]


def test_long_text(spark):
    msg = "@abc #def " * 3_000
    assert len(one(spark, entities.mentions, msg)) == 3_000
    assert one(spark, text.normalize, "word " * 5_000).count("word") == 5_000
