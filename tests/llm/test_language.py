"""Language model on held-out sentences, segments, and labels in whatever spelling."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm.language import best_path, language_segments, named_language, plain_word, text_languages, train, unnamed_languages, words_of

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(SAMPLES), reason="no test data")
SCHEMA = "id long, author long, text string, lang string, confidence int"


@pytest.fixture(scope="module")
def model():
    return train(duckdb.connect().execute(f"SELECT lang, text FROM '{SAMPLES}' ORDER BY sample_id").fetchall())


def test_held_out(model):
    assert model.held_out_accuracy > 0.93  # of stretches of one, three and eight words
    assert np.allclose(np.exp(model.log_probabilities(model.word("hello")[None])).sum(), 1)


def test_words():
    assert words_of("@bob") is None
    assert words_of("＃tag") is None
    assert words_of("https://a.b") is None
    assert words_of("RT") is None
    assert words_of("6:42") == []
    assert words_of("(l'école)") == ["l'école"]
    assert plain_word("Dіɑrrrrry") == "diary"
    assert plain_word("СОСНА") == "сосна"


def segments(spark, model, *texts, **kw):
    df = spark.createDataFrame([(i, 0, t, "clash", 0) for i, t in enumerate(texts)], SCHEMA)
    return sorted((r["id"], r["first_word"], r["n_words"], r["lang"]) for r in language_segments(df, ["id"], "text", model, **kw).collect())


EN, DE, FR = "The night nurse borrowed a bowl of soup before dinner.", "Der kleine Hund putzte die grüne Tür unten am Hafen.", "Le vieux boulanger a compté une tranche de melon."


def test_segments(spark, model):
    assert segments(spark, model, EN) == [(0, 0, 10, "en")]
    assert segments(spark, model, f"{EN} {DE}") == [(0, 0, 10, "en"), (0, 10, 10, "de")]
    assert segments(spark, model, f"RT @x: {EN} #tag http://a.b/c 🐟 {FR}") == [(0, 0, 10, "en"), (0, 10, 9, "fr")]
    assert segments(spark, model, "", None, "🐟 12", "@a #b") == []
    assert segments(spark, model, "lol", least_words=4) == []
    assert segments(spark, model, " ".join([EN] * 400)) == [(0, 0, 4_000, "en")]
    assert segments(spark, model, EN.replace("o", "ο").replace("e", "е")) == [(0, 0, 10, "en")]


def test_text_language(spark, model):
    df = spark.createDataFrame([(1, 0, f"{EN} {EN} {DE}", "", 0), (2, 0, None, "", 0)], SCHEMA)
    r = text_languages(language_segments(df, ["id"], "text", model), "id").collect()
    assert [(x["id"], x["lang"], round(x["share"], 2)) for x in r] == [(1, "en", 0.67)]
    assert r[0]["confidence"] > 0.9


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN_us", "en"), (" eng", "en"), ("English", "en"), ("español", "es"), ("es-419", "es"), ("pt_BR", "pt"), ("deu", "de"), ("fr-CA", "fr"), ("RU", "ru"), ("xx", None), ("", None), (None, None), ("n/a", None), ("id", None), ("end", None)])
def test_named(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(named_language(F.col("x")).alias("c")).first()["c"] == code


def test_unnamed(spark, model):
    texts = spark.createDataFrame([(1, 1, f"{EN} {DE}", "", 0), (2, 2, EN, "", 0), (2, 2, EN, "", 0), (3, None, FR, "", 0), (4, 9, FR, "", 0), (None, 1, DE, "", 0)], SCHEMA)
    authors = spark.createDataFrame([(1, "en-GB", "x"), (1, "en-GB", "y"), (2, "xx", "z"), (3, None, "w")], "author long, label string, lang string")
    got = unnamed_languages(texts, "id", "author", "text", authors, "label", model)
    assert sorted(map(tuple, got.collect())) == [(1, "de"), (2, "en"), (3, "fr"), (4, "fr")]
    assert unnamed_languages(texts.limit(0), "id", "author", "text", authors, "label", model).count() == 0


def test_best_path_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 6)
        s, c = rng.normal(size=(n, 3)), rng.uniform(0, 1, n)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - sum(c[i] for i in range(1, n) if p[i] != p[i - 1])  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(best_path(s, c, np.array([0, n, 0])).tolist()) == pytest.approx(value(best))


def test_bounds():
    with pytest.raises(ValueError, match="no labelled"):
        train([])
