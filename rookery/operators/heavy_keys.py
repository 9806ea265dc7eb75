"""Per-key results where a few keys hold most rows: tree aggregation in logarithmic rounds.

Rows are dealt into chunks of a fixed size and combined inside their chunk first. A state that
holds a fair share of its chunk is heavy: heavy states are merged ``fan_in`` chunks at a time, round
by round, so no task ever receives more than ``fan_in`` of them for one key. A chunk has a bounded
number of heavy states, so the rounds move little; the many light states skip them and meet the
top of the tree in one last merge on the keys alone. Chunks are numbered by the data, never by
partitions, so no session setting can change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.session import materialise

#: Rows of a chunk, and the share of a chunk (one in so many rows) from which on a state is heavy.
CHUNK_ROWS, HEAVY_SHARE = 50_000, 1_000


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds after which one group of chunks is left."""
    n, rounds = max(1, chunks), 0
    while n > 1:
        n, rounds = -(-n // fan_in), rounds + 1
    return rounds


def tree_aggregate(
    rows: DataFrame, keys: list[str], chunk: str, states: dict[str, tuple[Column, str]], chunks: int, fan_in: int = 8, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Aggregate ``rows`` by ``keys``; ``states`` maps a result name to (input column, merge).

    A merge is one of ``sum``, ``min``, ``max``, ``bit_or``: associative and commutative, so the
    shape of the tree doesn't change the result. ``chunk`` numbers the chunks from 0 to
    ``chunks - 1``; rows partitioned by it aren't moved again for the first step. Null keys form a
    group of their own, as in ``groupBy``. No rows give no groups.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or}
    combined = [merge[m](F.col(n)).alias(n) for n, (_, m) in states.items()]
    part = rows.select(F.col(chunk).alias("_chunk"), *keys, F.lit(1).cast("long").alias("_rows"), *(c.alias(n) for n, (c, _) in states.items()))
    total = F.sum("_rows").alias("_rows")
    local = materialise(part.groupBy("_chunk", *keys).agg(total, *combined), "chunk-states")
    is_heavy = F.col("_rows") * HEAVY_SHARE >= chunk_rows
    heavy = local.where(is_heavy).drop("_rows")
    for _ in range(rounds_for(chunks, fan_in)):
        heavy = heavy.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int")).groupBy("_chunk", *keys).agg(*combined)
    return local.where(~is_heavy).drop("_rows").unionByName(heavy).groupBy(*keys).agg(*combined)


def edge_keys(graph: DataFrame, fan_in: int = 8, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``field_name, key_text, n_edges, types, first_edge, last_edge``: results of every key.

    Each edge_id counts once, also where it was loaded more than once (copies agree in all columns;
    unlike rows of one id are different edges). ``field_name`` is ``hashtag`` (lower case), ``to_id``
    (decimal text) or ``all`` (one row for the whole graph). ``types`` has bit t set for each edge
    type t. Null and empty keys are none; edges without an edge_id are left out; an empty graph gives
    no rows. The chunk of an edge comes from its id, so equal edges meet in their chunk and one
    shuffle serves both the removal of copies and the first combination.
    """
    chunks = max(1, -(-graph.count() // chunk_rows))  # from the files' own row counts
    edges = (
        graph.where(F.col("edge_id").isNotNull())
        .select(
            F.pmod(F.xxhash64("edge_id"), F.lit(chunks)).cast("int").alias("_c"), "edge_id", F.col("to_id").cast("long").alias("to_id"),
            F.lower("hashtag").alias("tag"), F.coalesce("edge_type", F.lit(0)).cast("int").alias("kind"),
        )
    )
    key = F.explode(
        F.array(
            F.struct(F.lit("hashtag").alias("field_name"), F.col("tag").alias("key_text")),
            F.struct(F.lit("to_id").alias("field_name"), F.col("to_id").cast("string").alias("key_text")),
            F.struct(F.lit("all").alias("field_name"), F.lit("-").alias("key_text")),
        )
    )
    rows = edges.repartition("_c").distinct().select("_c", "edge_id", "kind", key.alias("_k")).select("_c", "edge_id", "kind", "_k.*").where("key_text <> ''")
    return tree_aggregate(
        rows,
        ["field_name", "key_text"],
        "_c",
        {
            "n_edges": (F.lit(1).cast("long"), "sum"),
            "types": (F.expr("shiftleft(1, kind)"), "bit_or"),
            "first_edge": (F.col("edge_id"), "min"),
            "last_edge": (F.col("edge_id"), "max"),
        },
        chunks,
        fan_in,
        chunk_rows,
    )


def heavy_keys(graph: DataFrame, share: int = 50) -> DataFrame:
    """``field_name, key_text, n_edges``: keys that hold at least ``1/share`` of all distinct edges."""
    keys = materialise(edge_keys(graph), "edge-keys")
    total = keys.where("field_name = 'all'").agg(F.sum("n_edges").alias("n_all"))  # one row
    return keys.where((F.col("field_name") != "all") & (F.col("n_edges") * share >= total.scalar())).select("field_name", "key_text", "n_edges")
