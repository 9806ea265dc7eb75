"""Items that appear together: pair counts over collapsed baskets, scored by lift and conviction.

Many records carry the same few items, so records are first collapsed: equal de-duplicated,
sorted item arrays become one basket with a weight. Items too rare for any pair leave their baskets,
which are collapsed again. Pairs are enumerated once for each distinct basket and weights are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.session import materialise


#: Baskets of more items are cut into blocks of so many, and blocks meet blocks.
BLOCK_ITEMS = 200
#: Copies of the table of frequent items, so that no task gets all baskets of one item.
SALTS = 16


def clean_items(items: Column, lower: bool = False) -> Column:
    """Array of text items without null and empty ones (a null array counts as empty)."""
    text = F.coalesce(items, F.array()).cast("array<string>")
    if lower:
        text = F.transform(text, F.lower)
    return F.filter(text, lambda x: x.isNotNull() & (x != ""))


def collapse(records: DataFrame, record: str, kinds: dict[str, Column]) -> DataFrame:
    """``kind, items, weight``: distinct baskets and the number of records that have each.

    A record that was delivered several times counts once, with the union of its items; each
    item counts once per record. Records without an id or without any item of a kind make no
    basket of that kind. An empty input gives an empty result.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("items")) for k, c in kinds.items())))
    rows = (
        records.where(F.col(record).isNotNull())
        .select(F.col(record).alias("_record"), each.alias("_b"))
        .select("_record", "_b.kind", "_b.items")
        .where(F.size("items") > 0)
    )
    once = rows.groupBy("_record", "kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return once.groupBy("kind", "items").agg(F.count(F.lit(1)).alias("weight"))


def frequent_baskets(baskets: DataFrame, frequent: DataFrame) -> DataFrame:
    """``kind, items, weight``: baskets with only the items of ``frequent`` (``kind, item``), at least two; equal ones become one."""
    own = materialise(baskets.where(F.size("items") > 1).withColumn("basket", F.monotonically_increasing_id()), "numbered-baskets")
    each = own.select("kind", "basket", "weight", F.explode("items").alias("item")).withColumn("_s", F.pmod(F.xxhash64("basket"), F.lit(SALTS)))
    known = frequent.select("kind", "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    left = each.join(known, ["kind", "item", "_s"], "left_semi").groupBy("kind", "basket").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("weight").alias("weight"))
    return left.where(F.size("items") > 1).groupBy("kind", "items").agg(F.sum("weight").alias("weight"))


def item_pairs(baskets: DataFrame) -> DataFrame:
    """``kind, weight, item_a, item_b``: every pair of each basket once, ``item_a < item_b``.

    A basket becomes rows of two blocks of items each, so a row carries a bounded number of items
    however large the basket is.
    """
    n_blocks = F.ceil(F.size("items") / BLOCK_ITEMS).cast("int")
    block = lambda i: F.slice("items", i * BLOCK_ITEMS + 1, F.lit(BLOCK_ITEMS))
    left = baskets.select("kind", "weight", "items", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("i"))
    both = left.select("kind", "weight", "items", "i", F.explode(F.sequence(F.col("i"), n_blocks - 1)).alias("j"))
    cut = both.select("kind", "weight", block(F.col("i")).alias("x"), F.when(F.col("i") != F.col("j"), block(F.col("j"))).alias("y"))
    first = cut.select("kind", "weight", "x", "y", F.posexplode("x").alias("at", "item_a"))
    rest = F.coalesce("y", F.expr("slice(x, at + 2, size(x))"))
    return first.select("kind", "weight", "item_a", F.explode(rest).alias("item_b"))


def pair_scores(baskets: DataFrame, min_together: int = 1) -> DataFrame:
    """``kind, item_a, item_b, n_together, n_a, n_b, n_records, lift, conviction_ab, conviction_ba``.

    ``item_a < item_b`` by character code. Pairs below ``min_together`` records are left out;
    nothing else is. An item in fewer than ``min_together`` records is in no such pair, so
    baskets lose those items before pairs are enumerated. Conviction is null where the rule has
    no counterexample. Baskets of one item make no pair.
    """
    sums = baskets.groupBy("kind").agg(F.sum("weight").alias("n_records"))  # one row for each kind
    item = baskets.select("kind", F.explode("items").alias("item"), "weight")
    counts = materialise(item.groupBy("kind", "item").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_together), "item-counts")
    pairs = item_pairs(frequent_baskets(baskets, counts)).groupBy("kind", "item_a", "item_b").agg(F.sum("weight").alias("n_together")).where(F.col("n_together") >= min_together)
    a = counts.select("kind", F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = counts.select("kind", F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    joined = pairs.join(a, ["kind", "item_a"]).join(b, ["kind", "item_b"]).join(F.broadcast(sums), "kind")
    c, na, nb, n = (F.col(x).cast("double") for x in ("n_together", "n_a", "n_b", "n_records"))

    def conviction(x: Column, y: Column) -> Column:
        return F.when(x > c, (x * (n - y)) / (n * (x - c)))

    return joined.select(
        "kind", "item_a", "item_b", "n_together", "n_a", "n_b", "n_records",
        (c * n / (na * nb)).alias("lift"),
        conviction(na, nb).alias("conviction_ab"),
        conviction(nb, na).alias("conviction_ba"),
    )


def appear_together(
    records: DataFrame, record: str, kinds: dict[str, Column], min_together: int = 4, min_lift: float = 18.7
) -> DataFrame:
    """Scored pairs that occur in at least ``min_together`` records and ``min_lift`` times as often as by chance."""
    baskets = materialise(collapse(records, record, kinds), "baskets")
    return pair_scores(baskets, min_together).where(F.col("lift") >= min_lift)
