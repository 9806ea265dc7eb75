"""Language of live status lines: parse, filter, classify, all stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.language_id import Model, classify
from rookery.sources.messages import STATUS


def parse_statuses(lines: DataFrame) -> DataFrame:
    """``text`` of JSON lines that are no reposts (``retweet_count`` 0) and not empty; broken lines are dropped."""
    s = F.from_json("value", STATUS).alias("s")
    return lines.select(s).where("s.retweet_count = 0 AND s.text <> ''").select("s.text")


def label_statuses(lines: DataFrame, model: Model, langs: tuple[str, ...] = ()) -> DataFrame:
    """``lang, text`` of each status, of the given languages or all; works on streams and tables alike."""
    rows = parse_statuses(lines).withColumn("bytes", F.encode("text", "utf-8"))
    best = classify(rows, ["text"], model).where("rank = 1")
    return (best.where(F.col("lang").isin(*langs)) if langs else best).select("lang", "text")


def run_stream(spark: SparkSession, folder: str, model: Model, out: str, checkpoint: str, langs: tuple[str, ...] = ()) -> DataFrame:
    """Label all lines of the text files in ``folder`` and return what was written; goes on from its checkpoint."""
    labelled = label_statuses(spark.readStream.text(folder), model, langs)
    query = labelled.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(labelled.schema).parquet(out)
