"""Pair counts over collapsed baskets against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import together
from rookery.llm.together import appear_together, clean_items, collapse, pair_scores

SCHEMA = "id long, tags array<string>, ids array<long>, kind string, items int, weight int"


def kinds():
    return {"tag": clean_items(F.col("tags"), lower=True), "id": clean_items(F.col("ids"))}


def brute(rows, least, lift):
    out = set()
    for kind, take in (("tag", lambda r: {t.lower() for t in r[1] or [] if t}), ("id", lambda r: {str(i) for i in r[2] or [] if i is not None})):
        baskets = {}
        for r in rows:
            if r[0] is not None and take(r):
                baskets.setdefault(r[0], set()).update(take(r))
        single = Counter(x for b in baskets.values() for x in b)
        pairs = Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
        out |= {(kind, a, b) for (a, b), c in pairs.items() if c >= least and c * len(baskets) / (single[a] * single[b]) >= lift}
    return out


@pytest.mark.parametrize(("least", "lift"), [(4, 2.0), (1, 0.0), (2, 1.3)])
def test_against_brute_force(spark, least, lift):
    rng = np.random.default_rng(least)
    rows = []
    for i in range(400):
        hot = ["Hot", "hoT"] if rng.random() < 0.4 else []
        tags = hot + [f"T{x}" for x in rng.zipf(1.6, rng.integers(0, 5)) % 12]
        rows.append((i, tags, [int(x) for x in rng.integers(0, 9, rng.integers(0, 4))], "k", 0, 0))
    rows += rows[:50] + [(900, None, None, None, None, None), (901, [None, ""], [None], "", 1, 1), (None, ["a", "b"], None, "", 1, 1)]
    got = appear_together(spark.createDataFrame(rows, SCHEMA), "id", kinds(), least, lift)
    assert {(r["kind"], r["item_a"], r["item_b"]) for r in got.collect()} == brute(rows, least, lift)


def test_weights_and_scores(spark):
    rows = [(i, ["a", "B", "b"], None, "", 0, 0) for i in range(6)] + [(i, ["c"], None, "", 0, 0) for i in range(6, 10)] + [(10, ["A"], None, "", 0, 0)]
    baskets = collapse(spark.createDataFrame(rows, SCHEMA), "id", kinds())
    assert {(r["kind"], tuple(r["items"]), r["weight"]) for r in baskets.collect()} == {("tag", ("a", "b"), 6), ("tag", ("c",), 4), ("tag", ("a",), 1)}
    r = pair_scores(baskets).first()
    assert (r["n_together"], r["n_a"], r["n_b"], r["n_records"]) == (6, 7, 6, 11)
    assert r["lift"] == pytest.approx(6 * 11 / 42)
    assert r["conviction_ab"] == pytest.approx(7 * 5 / (11 * 1))
    assert r["conviction_ba"] is None


@pytest.mark.parametrize("block", [3, 50, 1_000])
def test_blocks_of_a_large_basket(spark, monkeypatch, block):
    monkeypatch.setattr(together, "BLOCK_ITEMS", block)
    baskets = spark.createDataFrame([("k", [f"t{i:03}" for i in range(n)], 2) for n in (1, 2, 3, 4, 7, 50)], "kind string, items array<string>, weight long")
    got = Counter((r["item_a"], r["item_b"]) for r in together.item_pairs(baskets).collect())
    assert got == Counter(p for n in (1, 2, 3, 4, 7, 50) for p in itertools.combinations([f"t{i:03}" for i in range(n)], 2))


def test_rare_items_leave_first(spark):
    baskets = spark.createDataFrame([("k", ["a", "b", "x1"], 3), ("k", ["a", "b", "x2"], 2), ("k", ["b", "x3"], 9)], "kind string, items array<string>, weight long")
    frequent = spark.createDataFrame([("k", "a"), ("k", "b")], "kind string, item string")
    assert [tuple(r) for r in together.frequent_baskets(baskets, frequent).collect()] == [("k", ["a", "b"], 5)]


def test_long_basket(spark):
    row = [(1, [f"t{i}" for i in range(300)], None, "", 0, 0)]
    assert pair_scores(collapse(spark.createDataFrame(row, SCHEMA), "id", kinds())).count() == 300 * 299 // 2


def test_empty(spark):
    assert appear_together(spark.createDataFrame([], SCHEMA), "id", kinds()).count() == 0
