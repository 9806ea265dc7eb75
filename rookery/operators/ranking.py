"""Positions and percentiles of whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.session import materialise


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` sorted by range and written, with ``_p``: the number of the range."""
    return materialise(rows.orderBy(*by).withColumn("_p", F.spark_partition_id()), "in-order")


def with_ids(rows: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``node_id``: position by ``name`` from 0. Each range numbers its own and starts where the ones before end."""
    parts = in_order(rows, name)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(name))
    return parts.withColumn("_r", own).join(before, "_p").select((F.col("_start") + F.col("_r") - 1).alias("node_id"), *rows.columns)


def with_ranks(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``_rank``: position from 0 of each row among those of its ``key`` by ``order``, however many one key has.

    Rows are sorted by range over both columns, so only the first key of a range can go on from the
    ranges before; how far it had come there is known from one row for each range.
    """
    parts = in_order(rows, key, order)
    ends = parts.groupBy("_p").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    tallies = parts.groupBy("_p", key).agg(F.count(F.lit(1)).alias("n")).join(ends, "_p").where((F.col(key) == F.col("lo")) | (F.col(key) == F.col("hi")))
    offsets, held = [], (None, 0)
    by_part: dict[int, dict] = {}
    for r in tallies.select("_p", F.col(key).alias("k"), "lo", "hi", "n").collect():  # two rows for each range at most
        by_part.setdefault(r["_p"], {"lo": r["lo"], "hi": r["hi"]})[("n", r["k"])] = r["n"]
    for p in sorted(by_part):
        own = by_part[p]
        carried = held[1] if held[0] == own["lo"] else 0
        offsets.append((p, own["lo"], carried))
        n = own[("n", own["hi"])]
        held = (own["hi"], n + (carried if own["hi"] == own["lo"] else 0))
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    start = spark.createDataFrame(offsets, f"_p int, _lo {kind}, _from long")
    inside = F.row_number().over(Window.partitionBy("_p", key).orderBy(order)) - 1
    return parts.withColumn("_i", inside).join(F.broadcast(start), "_p").select(
        *rows.columns, (F.col("_i") + F.when(F.col(key) == F.col("_lo"), F.col("_from")).otherwise(0)).cast("long").alias("_rank")
    )


def percentile_of(rows: DataFrame, value: str, share: float) -> float | None:
    """Exact ``share`` percentile with linear interpolation; nulls don't count, and no rows have none."""
    if not 0 <= share <= 1:
        raise ValueError("the percentile must lie within 0..1")
    parts = in_order(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "v")
    sizes = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())  # one row for each range
    n = sum(c for _, c in sizes)
    if not n:
        return None

    def at(rank: int) -> float:
        for p, c in sizes:
            if rank < c:
                own = parts.where(F.col("_p") == p).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("v")))
                return own.where(F.col("_r") == rank + 1).first()["v"]
            rank -= c
        raise IndexError(rank)

    place = (n - 1) * share
    low = int(place)
    least = at(low)
    return least if place == low else least + (at(low + 1) - least) * (place - low)
