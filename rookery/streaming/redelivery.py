"""Exactly one copy of messages that were delivered at least once.

A Structured Streaming query keeps the identifiers it has seen in a keyed state store, so a
micro-batch costs what it holds and not what came before it. An identifier leaves the state once
the watermark has passed its event time. The built-in operator drops rows behind the watermark;
here every batch is grouped from its raw rows beside the operator's output, so these late rows are
known, and they are looked up among all identifiers kept so far. Look-ups wait until they are worth
a scan: all that is read for them is in proportion to the late rows. The groups of a batch are one
written table, which becomes valid with one commit file: a batch that is run again after a failure
starts from the same state version, replaces what it wrote before, and no reader sees half of it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.session import work_path

#: Late rows are looked up once there is one for every so many identifiers kept, and at the end.
LOOKUP_SHARE = 8
#: Settings of the state store: on local disk with a bound on its memory, and copied to the checkpoint.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}


@dataclass(frozen=True)
class Deliveries:
    """``kept``: one row for each identifier. ``repeats``: identifier and its number of further rows."""

    kept: DataFrame
    repeats: DataFrame


class BatchLog:
    """Tables of committed batches and look-ups below one folder; a table counts from its commit file on."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.records = {r["name"]: r for r in self._stored()}

    def _stored(self) -> list[dict]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        found = []
        for status in self._fs.listStatus(folder):
            stream = self._fs.open(status.getPath())
            found.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        return found

    def commit(self, record: dict) -> None:
        """Written whole beside its place and renamed into it; a rename that doesn't happen is an error."""
        name = record["name"]
        there, draft = self._path(f"{self.root}/commits/{name}"), self._path(f"{self.root}/drafts/{name}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        self._fs.mkdirs(there.getParent())
        if self._fs.exists(there) and not self._fs.delete(there, False):
            raise OSError(f"can't replace {there}")
        if not self._fs.rename(draft, there):
            raise OSError(f"can't commit {there}")
        self.records[name] = record

    def of(self, kind: str, before: int = 1 << 62) -> list[dict]:
        """Records of ``batch`` or ``lookup`` up to a batch number, in order."""
        return sorted((r for r in self.records.values() if r["kind"] == kind and r["batch"] < before), key=lambda r: r["batch"])

    def read(self, records: list[dict]) -> DataFrame:
        if not records:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/tables/{r['name']}" for r in records))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/tables/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def waiting(self, before: int) -> list[dict]:
        """Batches with late rows that no look-up has covered."""
        done = max((r["batch"] for r in self.of("lookup", before)), default=-1)
        return [r for r in self.of("batch", before) if r["batch"] > done and r["late"]]

    def look_up(self, batch: int, values: list[str]) -> None:
        """Decide the late rows of all batches up to ``batch``: known identifiers are copies, others are kept now."""
        waiting = self.waiting(batch + 1)
        if not waiting:
            return
        best = F.min_by(F.struct("t", *values), F.struct(F.col("event_s").isNull(), "event_s", F.xxhash64("t", *values))).alias("b")
        late = self.read(waiting).where("late").groupBy("key").agg(F.min("event_s").alias("event_s"), F.sum("copies").alias("n"), best)
        tables = self.of("batch", batch + 1) + self.of("lookup", batch)
        known = self.read(tables).where("fresh").select("key").join(late.select("key"), "key", "left_semi").select("key", F.lit(True).alias("known"))
        fresh = F.col("known").isNull()
        rows = late.join(known, "key", "left").select(
            "key", "event_s", F.lit(False).alias("late"), fresh.alias("fresh"), (F.col("n") - fresh.cast("long")).alias("copies"), "b.t", *(f"b.{v}" for v in values)
        )
        kept = self.write(f"lookup-{batch}", rows).where("fresh").count()
        self.commit({"name": f"lookup-{batch}", "kind": "lookup", "batch": batch, "fresh": kept})


def keep_one(
    stream: DataFrame, key: str, event_time: str, delay_s: int = 14 * 86_400, root: str | None = None, available_now: bool = True
) -> Deliveries:
    """Run ``stream`` to its end and return what was kept and what came again.

    ``stream`` is a streaming DataFrame; ``event_time`` belongs to the message, so its copies agree
    in it: all have the same one, or none has any. Of the copies in one batch the one with the least
    row hash is kept; an identifier kept in an earlier batch is not kept again. Rows without an
    identifier are left out. An identifier leaves the state once the newest event time is more than
    twice ``delay_s`` past its own; a row more than ``delay_s`` behind the newest is late: it isn't
    dropped but looked up among all identifiers kept. Rows without an event time never enter the
    state and are always looked up. ``root`` names the folder of checkpoint, state and output;
    started again on the same one, the query goes on where it was. An empty stream keeps nothing.
    """
    spark = stream.sparkSession
    root = root or work_path(spark, "deliveries")
    others = [c for c in stream.columns if c not in (key, event_time)]
    values = [f"v{i}" for i in range(len(others))]
    kind = {f.name: f.dataType for f in stream.schema}
    schema = T.StructType(
        [T.StructField("key", kind[key]), T.StructField("event_s", T.LongType()), T.StructField("late", T.BooleanType()), T.StructField("fresh", T.BooleanType()), T.StructField("copies", T.LongType()), T.StructField("t", kind[event_time])]
        + [T.StructField(v, kind[c]) for v, c in zip(values, others, strict=True)]
    )
    log = BatchLog(spark, root, schema)

    rows = stream.where(F.col(key).isNotNull())
    at = F.col(event_time).cast("timestamp")
    dated = rows.where(F.col(event_time).isNotNull()).select(F.col(key).alias("key"), at.alias("_at"))
    seen = dated.withWatermark("_at", f"{delay_s} seconds").dropDuplicatesWithinWatermark(["key"])
    raw = rows.select(F.col(key).alias("key"), F.col(event_time).alias("t"), F.unix_seconds(at).alias("at_s"), *(F.col(c).alias(v) for v, c in zip(values, others, strict=True)), F.lit(False).alias("first"))
    both = raw.unionByName(seen.select("key", F.lit(True).alias("first")), allowMissingColumns=True)

    def run(batch: DataFrame, number: int) -> None:
        event_s = F.unix_seconds(F.col("t").cast("timestamp"))
        is_raw = ~F.col("first")
        rank = F.when(is_raw, F.struct(event_s.isNull(), event_s, F.xxhash64("t", *values)))
        earlier = log.of("batch", number)
        mark = max([r["newest"] + 1 - delay_s for r in earlier if r["newest"] is not None] + [0])
        fresh = F.max("first")
        groups = batch.groupBy("key").agg(
            fresh.alias("fresh"), F.count_if(is_raw).alias("n"), F.min(event_s).alias("event_s"), F.min("at_s").alias("low"), F.max("at_s").alias("newest"), F.min_by(F.struct("t", *values), rank).alias("b")
        )
        late = ~F.col("fresh") & (F.col("low").isNull() | (F.col("low") <= mark))
        copies = F.when(late, F.col("n")).otherwise(F.col("n") - F.col("fresh").cast("long"))
        name = f"batch-{number}"
        newest = F.max("newest")
        facts = groups.select("key", "event_s", late.alias("late"), "fresh", copies.alias("copies"), "b.t", *(f"b.{v}" for v in values), "newest")
        facts.write.mode("overwrite").parquet(f"{log.root}/tables/{name}")
        sums = spark.read.parquet(f"{log.root}/tables/{name}").agg(newest.alias("newest"), F.count_if("late").alias("late"), F.count_if("fresh").alias("fresh")).first()
        log.commit({"name": name, "kind": "batch", "batch": number, "newest": sums["newest"], "late": sums["late"], "fresh": sums["fresh"]})
        waiting = sum(r["late"] for r in log.waiting(number + 1))
        if waiting * LOOKUP_SHARE >= sum(r["fresh"] for r in log.of("batch", number + 1) + log.of("lookup", number)) > 0:
            log.look_up(number, values)

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        writer = both.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint")
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if done := log.of("batch"):
        log.look_up(done[-1]["batch"], values)

    found = log.read(log.of("batch") + log.of("lookup")).where("NOT late")
    names = {key: "key", event_time: "t"} | dict(zip(others, values, strict=True))
    kept = found.where("fresh").select(*(F.col(names[c]).alias(c) for c in stream.columns))
    repeats = found.where("copies > 0").groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias("copies"))
    return Deliveries(kept, repeats)


def delivery_stream(spark: SparkSession, path: str, columns: list[str], arrival: str, batch_rows: int = 5_000_000, least_batches: int = 8, file_rows: int = 50_000) -> DataFrame:
    """The table at ``path`` as the stream it once was: deliveries in order of ``arrival``, a batch of ``batch_rows`` at a time.

    A small table comes in ``least_batches``. The deliveries are written once below the shared
    folder, in ranges of ``arrival`` (rows without one come first), as a collector leaves them.
    """
    rows = spark.read.parquet(path).select(*columns)
    n = rows.count()  # from the files' own row counts
    batches = max(least_batches, -(-n // batch_rows))
    files = max(1, min(spark.sparkContext.defaultParallelism, n // (batches * file_rows)))
    folder = work_path(spark, "collected")
    rows.repartitionByRange(batches * files, arrival).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
