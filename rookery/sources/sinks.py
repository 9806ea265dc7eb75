"""Writers: records, graph files, counts, weights, crawl state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(path)


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``line`` of each edge by node ids: five fields between users (coc, comm, rt), three for the other kinds.

    An edge whose end has no node is an error, as is one of an unknown kind.
    """
    a = nodes.select(F.col("name").alias("src"), F.col("node_id").alias("a"))
    b = nodes.select(F.col("name").alias("dst"), F.col("node_id").alias("b"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left")
    ends = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.concat(F.lit("edge without node: "), "src", F.lit(" "), "dst")))
    line = (
        F.when(ends.isNotNull(), F.lit(""))
        .when(F.col("kind") == "uu", F.concat_ws(" ", "a", "b", "count_coc", "count_comm", "count_rt"))
        .when(F.col("kind") == "uh", F.concat_ws(" ", "a", "b", "count_ht"))
        .when(F.col("kind") == "hh", F.concat_ws(" ", "a", "b", "count_coc"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of edge: "), "kind")))
    )
    return rows.select("a", "b", line.alias("line"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Gzip text files of nodes (``id name``) and of edges in order of their ends."""
    nodes.orderBy("node_id").select(F.concat_ws(" ", "node_id", "name").alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/nodes")
    edge_lines(edges, nodes).orderBy("a", "b").select(F.col("line").alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/edges")


def count_lines(counts: DataFrame, key: str = "doc_id", user: str = "user_id") -> DataFrame:
    """One line for each document: ``id user w1|c1 w2|c2``, words in order, counts with one decimal, ASCII only."""
    words = F.array_sort(F.collect_list(F.struct("word", F.concat(F.col("cnt").cast("long").cast("string"), F.lit(".0")).alias("c"))))
    rows = counts.groupBy(key, user).agg(words.alias("w"))
    text = F.array_join(F.transform("w", lambda x: F.concat(x["word"], F.lit("|"), x["c"])), " ")
    ascii_ = F.regexp_replace(F.concat_ws(" ", F.col(key).cast("string"), F.lower(F.col(user).cast("string")), text), r"[^\x00-\x7F]", "")
    return rows.select(key, ascii_.alias("line"))


def display_lines(records: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Records as indented ``name: value`` text in order of names; with ``key`` only those where it equals ``value``."""
    own = records if key is None else records.where(F.col(key).cast("string") == value)
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(records.columns)]
    return own.select(F.concat_ws("\n", *parts).alias("text"))


def message_lines(messages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line``: ``id<tab>message`` of each normalized message, ASCII only; null messages have none."""
    line = F.concat_ws("\t", F.col(key).cast("string"), F.col(text))
    return messages.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.regexp_replace(line, r"[^\x00-\x7F]", "").alias("line"))


def date_lines(messages: DataFrame, key: str, day: str) -> DataFrame:
    """``key, line``: ``id.counts YYYYMMDD`` of each message with a day."""
    return messages.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, F.concat(F.col(key).cast("string"), F.lit(".counts "), F.col(day)).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def weight_lines(weights: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of CSV lines: the quoted key and its weight, or all of them where ``value`` is an array."""
    quoted = F.concat(F.lit("'"), F.regexp_replace(F.col(key), r"(['\\\\])", r"\\$1"), F.lit("'"))
    numbers = F.col(value) if weights.schema[value].dataType.simpleString().startswith("array") else F.array(value)
    return weights.select(key, value, F.concat_ws(",", quoted, numbers.cast("array<string>")).alias("value_"))


def write_weights(weights: DataFrame, path: str, key: str, value: str) -> None:
    """CSV: single weights by falling weight (ties by key), vectors by key."""
    is_vector = weights.schema[value].dataType.simpleString().startswith("array")
    order = [F.col(key)] if is_vector else [F.desc(value), F.col(key)]
    weight_lines(weights, key, value).orderBy(*order).select(F.col("value_").alias("value")).write.mode("overwrite").text(path)


def save_state(state: DataFrame, path: str, hop: int) -> None:
    """Crawl state of one hop; written again it replaces only itself."""
    state.write.mode("overwrite").parquet(f"{path}/hop={hop}")


def saved_hops(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the hops that were written whole, from 0 on without a gap."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    hop = 0
    while files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hop={hop}/_SUCCESS")):
        hop += 1
    return list(range(hop))


def load_states(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """State of all hops that were written whole, with ``hop``; ``kind`` is the schema of one."""
    hops = saved_hops(spark, path)
    if not hops:
        return spark.createDataFrame([], f"{kind}, hop int")
    return spark.read.schema(f"{kind}, hop int").option("basePath", path).parquet(*(f"{path}/hop={h}" for h in hops))


def load_state(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """State of the last hop that was written whole."""
    rows = load_states(spark, path, kind)
    return rows.where(F.col("hop") == max(saved_hops(spark, path), default=-1))


def data_volume(spark: SparkSession, folder: str) -> float:
    """GiB of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("length")
    return (files.agg(F.sum("length").alias("b")).first()["b"] or 0) / 2**30


def keep_percentage(rows: DataFrame, kept: Column) -> DataFrame:
    """``n_lines, n_kept, percentage`` of rows that pass; null percentage of no rows."""
    return rows.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(kept).alias("n_kept"), (100.0 * F.count_if(kept) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("percentage"))
