"""Isotonic regression, level models on held-out documents, and odd texts."""

import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rookery.llm.reading import isotonic, labelled, reading_levels, symbols, train

DATA = "/root/testdata/sf0.1"


@given(st.lists(st.tuples(st.integers(0, 20), st.floats(-5, 5)), min_size=1, max_size=40))
def test_isotonic(points):
    x, y = np.array([float(a) for a, _ in points]), np.array([b for _, b in points])
    bx, by = isotonic(x, y)
    assert (np.diff(by) >= -1e-12).all()
    assert (np.diff(bx) >= -1e-12).all()


def test_isotonic_known():
    bx, by = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert by.tolist() == [1, 2.5, 4]
    assert bx.tolist() == [1, 2.5, 4]


def test_symbols():
    assert symbols("Fish,") == ["fish", ","]
    assert symbols('end."') == ["end", "."]
    assert symbols("|") == ["."]
    assert symbols("@bob") == symbols("12") == symbols("...") == []


@pytest.fixture(scope="module")
def split(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/reading_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = train(*labelled(docs, "doc_id", "text", labels.where(~held), "reading_level"))
    return docs, labels.where(held).select("doc_id", F.col("reading_level").alias("truth")).distinct(), model


def test_held_out(split):
    docs, truth, model = split
    rows = reading_levels(docs.join(truth, "doc_id", "left_semi"), "doc_id", "text", model).join(truth, "doc_id").collect()
    hit = [(r["reading_level"] >= 4, r["truth"] >= 4) for r in rows]
    assert np.mean([r["reading_level"] == r["truth"] for r in rows]) > 0.75
    assert sum(a and b for a, b in hit) / max(1, sum(b for _, b in hit)) > 0.85
    assert sum(a and b for a, b in hit) / max(1, sum(a for a, _ in hit)) > 0.85


def test_levels_rise_with_the_score(split):
    docs, _, model = split
    rows = reading_levels(docs.limit(500), "doc_id", "text", model).orderBy("score").collect()
    assert (np.diff([r["expected_level"] for r in rows]) >= -1e-9).all()
    assert {r["reading_level"] for r in rows} <= {1, 2, 3, 4, 5}


def test_odd_texts(spark, split):
    _, _, model = split
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "123 🐟 ..."), (5, "@a #b http://c.d"), (6, "word"), (7, "word " * 20_000), (8, "x" * 50_000), (8, "one more."), (None, "no key here.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("reading_level", F.lit("clash")).withColumn("_level", F.lit(1))
    assert sorted((r["doc_id"] or 0) for r in reading_levels(df, "doc_id", "text", model).collect()) == [0, 6, 7, 8, 8]
    assert reading_levels(df.limit(0), "doc_id", "text", model).count() == 0


def test_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "c d", 2), (3, "e", 3)], "doc_id long, text string, _level int")
    labels = spark.createDataFrame([(1, 2), (1, 2), (2, None), (3, 9), (7, 1)], "doc_id long, reading_level int")
    assert labelled(docs, "doc_id", "text", labels, "reading_level") == ([["a", "b"]], [2])
