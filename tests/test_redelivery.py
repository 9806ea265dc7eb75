"""Exactly one copy of each message, over batches, late arrivals, restarts and a failed commit."""

import datetime as dt
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rookery.streaming.redelivery import BatchLog, delivery_stream, keep_one

SCHEMA = "tweet_id long, created_at timestamp, tweet string, key string, fresh int"
DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 2, 1)


def write(spark, folder, number, rows):
    rows = [(i, None if d is None else T0 + d * DAY, f"text {i}", "clash", 7) for i, d in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={number}")
    for name in os.listdir(f"{folder}/part={number}"):
        if name.endswith(".parquet"):
            os.rename(f"{folder}/part={number}/{name}", f"{folder}/{number:03}.parquet")
            os.utime(f"{folder}/{number:03}.parquet", (1_000_000 + number, 1_000_000 + number))
    for name in os.listdir(f"{folder}/part={number}"):
        os.remove(f"{folder}/part={number}/{name}")
    os.rmdir(f"{folder}/part={number}")


BATCHES = [
    [(1, 0), (1, 0), (2, 1), (3, None)],
    [(2, 1), (4, 40)],
    [(1, 0), (5, 2), (4, 40), (3, None)],  # 1 and 5 are late by now
    [(5, 2), (6, 80), (None, 80), (6, 80), (6, 80)],
]
KEPT, AGAIN = [1, 2, 3, 4, 5, 6], {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}


def check(out):
    assert sorted(r["tweet_id"] for r in out.kept.collect()) == KEPT
    assert {r["tweet_id"]: r["copies"] for r in out.repeats.collect()} == AGAIN


def stream(spark, folder, columns=("tweet_id", "created_at"), files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder).select(*columns)


def delivered(spark, tmp_path, batches=BATCHES):
    folder = str(tmp_path / "in")
    os.makedirs(folder, exist_ok=True)
    for i, b in enumerate(batches):
        write(spark, folder, i, b)
    return folder, str(tmp_path / "state")


@pytest.mark.parametrize("columns", [["tweet_id", "created_at"], ["created_at", "tweet", "tweet_id", "key", "fresh"]])
@pytest.mark.parametrize("files", [1, 4])
def test_batches(spark, tmp_path, columns, files):
    folder, root = delivered(spark, tmp_path)
    out = keep_one(stream(spark, folder, columns, files), "tweet_id", "created_at", delay_s=7 * 86_400, root=root)
    check(out)
    assert out.kept.columns == columns
    if "tweet" in columns:
        assert all(r["tweet"] == f"text {r['tweet_id']}" for r in out.kept.collect())


def test_restart(spark, tmp_path):
    for i in range(len(BATCHES)):
        folder, root = delivered(spark, tmp_path, BATCHES[: i + 1])
        out = keep_one(stream(spark, folder), "tweet_id", "created_at", delay_s=7 * 86_400, root=root)
    check(out)


def test_commit_that_never_happened(spark, tmp_path):
    """A batch whose table was written but not committed is done again, and its first try leaves no trace."""
    folder, root = delivered(spark, tmp_path, BATCHES[:1])
    keep_one(stream(spark, folder), "tweet_id", "created_at", delay_s=7 * 86_400, root=root)
    for folder_ in ("commits", "checkpoint/commits", "checkpoint/offsets"):
        for name in os.listdir(f"{root}/{folder_}"):
            if folder_ != "checkpoint/offsets" and name != "metadata" or "1" in name:
                os.remove(f"{root}/{folder_}/{name}")
    delivered(spark, tmp_path)
    check(keep_one(stream(spark, folder), "tweet_id", "created_at", delay_s=7 * 86_400, root=root))


def test_failed_rename_is_an_error(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "state"), spark.createDataFrame([], "key long").schema)
    log.commit({"name": "batch-0", "kind": "batch", "batch": 0, "newest": None, "late": 0, "fresh": 0})
    with open(tmp_path / "state/commits/batch-0") as f:
        assert json.load(f)["batch"] == 0
    os.makedirs(tmp_path / "state/commits/batch-1/in the way")
    with pytest.raises(Exception, match="batch-1"):
        log.commit({"name": "batch-1", "kind": "batch", "batch": 1, "newest": None, "late": 0, "fresh": 0})


def test_undated_rows_are_looked_up(spark, tmp_path):
    batches = [[(1, None), (2, 0)], [(2, 0), (7, 50)], [(1, None), (3, None)], [(8, 200)], [(3, None), (2, 0), (1, None)]]
    folder, root = delivered(spark, tmp_path, batches)
    out = keep_one(stream(spark, folder), "tweet_id", "created_at", delay_s=7 * 86_400, root=root)
    assert sorted(r["tweet_id"] for r in out.kept.collect()) == [1, 2, 3, 7, 8]
    assert {r["tweet_id"]: r["copies"] for r in out.repeats.collect()} == {1: 2, 2: 2, 3: 1}


def test_against_brute_force(spark, tmp_path):
    """Deliveries at random, many of them late or undated, over many batches."""
    rng = random.Random(5)
    when = {i: None if i % 7 == 0 else rng.randrange(120) for i in range(150)}
    batches = [[] for _ in range(14)]
    for i, d in when.items():
        first = rng.randrange(14) if d is None else min(13, d // 9 + rng.choice([0, 0, 0, 3]))
        for b in [first, *(rng.randrange(first, 14) for _ in range(rng.choice([0, 0, 1, 3])))]:
            batches[b].append((i, d))
    folder, root = delivered(spark, tmp_path, batches)
    out = keep_one(stream(spark, folder), "tweet_id", "created_at", delay_s=5 * 86_400, root=root)
    n = Counter(i for b in batches for i, _ in b)
    assert sorted(r["tweet_id"] for r in out.kept.collect()) == sorted(n)
    assert {r["tweet_id"]: r["copies"] for r in out.repeats.collect()} == {i: c - 1 for i, c in n.items() if c > 1}


def test_look_ups_are_in_proportion_to_late_rows(spark, tmp_path):
    """Twenty batches with late rows in each: few look-ups, and every identifier once."""
    batches = [[(100 * b + k, b * 10) for k in range(20)] + [(100 * (b - 5) + k % 20, (b - 5) * 10) for k in range(3) if b > 4] for b in range(20)]
    folder, root = delivered(spark, tmp_path, batches)
    out = keep_one(stream(spark, folder), "tweet_id", "created_at", delay_s=7 * 86_400, root=root)
    n = Counter(i for b in batches for i, _ in b)
    assert sorted(r["tweet_id"] for r in out.kept.collect()) == sorted(n)
    assert {r["tweet_id"]: r["copies"] for r in out.repeats.collect()} == {i: c - 1 for i, c in n.items() if c > 1}
    assert 1 <= len([x for x in os.listdir(f"{root}/commits") if x.startswith("lookup")]) <= 6


def test_a_table_comes_in_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i % 40, T0 + (i % 40) * DAY, f"text {i % 40}", "x", i) for i in range(100)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    out = keep_one(delivery_stream(spark, path, ["tweet_id", "created_at", "fresh"], "fresh"), "tweet_id", "created_at", root=str(tmp_path / "state"))
    assert len([x for x in os.listdir(tmp_path / "state/commits") if x.startswith("batch")]) >= 8
    assert out.kept.count() == 40
    assert out.repeats.agg(F.sum("copies")).first()[0] == 60


def test_empty(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    out = keep_one(delivery_stream(spark, path, ["tweet_id", "created_at"], "created_at"), "tweet_id", "created_at", root=str(tmp_path / "state"))
    assert out.kept.count() == out.repeats.count() == 0
