"""Every item has one place, no container overflows, and little room is left."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm.packing import fill_report, pack, pieces, plan

SCHEMA = "id long, n long, part int, container_id int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan(counts):
    patterns = plan(counts, 64, (8, 16, 32))
    used = Counter()
    for p in patterns:
        assert sum(s * n for s, n, *_ in p.places) <= 64
        spans = sorted((at + i * apart, at + i * apart + s, window) for s, n, at, apart, window in p.places for i in range(n))
        assert spans[0][0] == 0
        assert all(b == c for (_, b, _), (c, _, _) in zip(spans, spans[1:], strict=False))  # no gap, no overlap
        assert all(a // w == (b - 1) // w for a, b, w in spans)  # no item crosses the end of its window
        for s, n, *_ in p.places:
            used[s] += n * p.times
    assert dict(used) == counts
    total, containers = sum(s * n for s, n in counts.items()), sum(p.times for p in patterns)
    assert containers >= -(-total // 64)
    assert containers <= sum(n for s, n in counts.items() if s > 32) + 2 * total // 64 + 1


def test_tiers_change_the_plan():
    counts = {900: 4, 124: 4, 300: 8, 212: 8, 200: 8, 56: 8, 1_500: 3, 548: 3}
    tiered, other, plain = (plan(counts, 2_048, t) for t in ((256, 512, 1_024), (512,), ()))
    windows = {s: w for p in tiered for s, _, _, _, w in p.places}
    assert windows == {1_500: 2_048, 548: 2_048, 900: 1_024, 124: 1_024, 300: 512, 212: 512, 200: 256, 56: 256}
    assert {w for p in plain for *_, w in p.places} == {2_048}
    assert tiered != other != plain
    assert sum(p.times for p in tiered) == 3 + 2 + 2 + 1
    with pytest.raises(ValueError, match="tiers must rise"):
        plan(counts, 2_048, (512, 256))


def test_tiers_cost_no_room():
    counts = {s: 1 + (s * 7_919) % 23 for s in range(1, 1_500, 3)}
    assert sum(p.times for p in plan(counts)) <= sum(p.times for p in plan(counts, tiers=()))


def check(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        assert (r["container_id"] is None) == (r["n_tokens"] == 0)
        if r["n_tokens"]:
            places[r["container_id"]].append((r["position"], r["n_tokens"]))
    for own in places.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= capacity
    assert sorted(places) == list(range(len(places)))
    return places


@pytest.mark.parametrize("bucket_rows", [200_000, 50])
def test_places(spark, bucket_rows):
    sizes = [(i, (i * 7_919) % 900) for i in range(1, 800)] + [(i, 300) for i in range(1_000, 1_400)] + [(5, 0), (6, None), (None, 10), (9_007, 5_000), (9_007, 5_000)]
    df = spark.createDataFrame([(*s, 9, 9) for s in sizes], SCHEMA)
    placed = pack(df, "id", "n", 2_048, bucket_rows=bucket_rows)
    rows = placed.collect()
    places = check(rows, 2_048)
    total = sum(n or 0 for _, n in sizes)
    assert sum(r["n_tokens"] for r in rows) == total
    assert len(places) <= -(-total // 2_048) + 1
    assert Counter(r["id"] for r in rows)[9_007] == 6  # two items of 5,000, cut into 2,048 + 2,048 + 904 each
    report = fill_report(placed).first()
    assert report["containers"] == len(places)
    cost = defaultdict(int)
    for r in rows:
        if r["n_tokens"]:
            cost[r["step_group"]] += r["n_tokens"] ** 2
    assert max(Counter(c for c, _ in {(r["step_group"], r["container_id"]) for r in rows if r["n_tokens"]}).values()) <= 8
    assert max(cost.values()) < 2 * (sum(cost.values()) / len(cost))


def test_cuts(spark):
    df = spark.createDataFrame([(1, 10, 0, 0), (2, 25, 0, 0), (3, 20, 0, 0), (4, None, 0, 0)], SCHEMA)
    assert sorted((r["id"], r["part"], r["n_tokens"]) for r in pieces(df, "id", "n", 10).collect()) == [(1, 0, 10), (2, 0, 10), (2, 1, 10), (2, 2, 5), (3, 0, 10), (3, 1, 10), (4, 0, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pack(df, "id", "n").count() == 0
    assert fill_report(pack(df, "id", "n")).first()["containers"] == 0
