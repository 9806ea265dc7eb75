"""Filling fixed-capacity containers: hierarchical packing over context-size tiers, planned on a histogram.

Sizes are whole numbers up to the capacity, so a corpus of any length has a histogram of at most
``capacity`` counts, and that is all the planner sees. Documents are routed to the shortest tier that
holds them. Each tier is packed on its own, from the longest down, into windows of its length: an
item of the tier, and its gap filled exactly with items of shorter tiers. Full windows of one tier
are laid side by side in containers. What fills no window exactly is packed last, by length alone,
into windows as long as a container. A plan is a list of patterns with the number of containers of
each; items then find their container by arithmetic from their rank among the items of their size.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.session import materialise

CAPACITY = 2_048
TIERS = (256, 512, 1_024)
#: Shares of the windows that a plan may keep.
KEPT_SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)


@dataclass
class Pattern:
    """``places``: (size, how many, where the first starts, how far apart, length of their window); ``times``: containers of this kind."""

    places: list[tuple[int, int, int, int, int]]
    times: int

    @property
    def cost(self) -> int:
        return sum(n * s * s for s, n, *_ in self.places)


class _Sizes:
    """Counts by size with the sizes that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def largest(self, limit: int) -> int | None:
        at = bisect_right(self.order, limit)
        return self.order[at - 1] if at else None

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.order.remove(size)

    def give_back(self, size: int, n: int) -> None:
        if size not in self.left:
            insort(self.order, size)
        self.left[size] = self.left.get(size, 0) + n

    def pair(self, total: int, limit: int) -> tuple[int, int] | None:
        """Two sizes up to ``limit`` that are left and make exactly ``total``."""
        for a in self.order[bisect_right(self.order, (total - 1) // 2) : bisect_right(self.order, min(total - 1, limit))]:
            b = total - a
            if b in self.left and (a != b or self.left[a] > 1):
                return a, b
        return None

    def exact(self, gap: int, limit: int, tries: int = 4) -> dict[int, int] | None:
        """One, two or three items up to ``limit`` that fill ``gap``; for three, the largest of them is one of a few."""
        if gap == 0:
            return {}
        if gap <= limit and gap in self.left:
            return {gap: 1}
        if two := self.pair(gap, limit):
            return dict(Counter(two))
        end = bisect_right(self.order, min(gap - 2, limit))
        for size in reversed(self.order[max(0, end - tries) : end]):
            if two := self.pair(gap - size, limit):
                three = Counter((size, *two))
                if all(self.left[s] >= n for s, n in three.items()):
                    return dict(three)
        return None


def _windows(sizes: _Sizes, lower: int, length: int, is_shortest: bool) -> list[tuple[dict[int, int], int]]:
    """Windows that a tier's items and shorter ones fill exactly, with how many of each there are."""
    out = []
    limit = length if is_shortest else lower
    for head in reversed(sizes.order[bisect_right(sizes.order, lower) : bisect_right(sizes.order, length)]):
        while sizes.left.get(head):
            sizes.take(head, 1)
            fill = sizes.exact(length - head, limit)
            sizes.give_back(head, 1)
            if fill is None:
                break
            items = Counter(fill)
            items[head] += 1
            times = min(sizes.left[s] // n for s, n in items.items())
            for s, n in items.items():
                sizes.take(s, n * times)
            out.append((dict(items), times))
    return out


def _side_by_side(windows: list[tuple[dict[int, int], int]], length: int, capacity: int, sizes: _Sizes) -> list[Pattern]:
    """Containers of as many windows of one tier as fit; windows that make no whole container go back."""
    each, patterns, waiting = capacity // length, [], []

    def laid(items: dict[int, int], first: int, count: int) -> list[tuple[int, int, int, int, int]]:
        places, at = [], first * length
        for s, n in sorted(items.items(), reverse=True):
            for _ in range(n):
                places.append((s, count, at, length, length))
                at += s
        return places

    for items, times in windows:
        if times // each:
            patterns.append(Pattern(laid(items, 0, each), times // each))
        for _ in range(times % each):
            waiting.append(items)
            if len(waiting) == each:
                patterns.append(Pattern([p for i, w in enumerate(waiting) for p in laid(w, i, 1)], 1))
                waiting = []
    for items in waiting:
        for s, n in items.items():
            sizes.give_back(s, n)
    return patterns


def _by_length(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Largest first, each gap filled with the largest that fits or with two that fill it."""
    patterns = []
    while (head := sizes.largest(capacity)) is not None:
        sizes.take(head, 1)
        items, gap = {head: 1}, capacity - head
        while gap and (size := sizes.largest(gap)) is not None:
            two = None if size == gap or sizes.order[0] * 2 > gap else sizes.pair(gap, capacity)
            n = 1 if two or size > gap // 2 else max(1, min(gap // size - 1, sizes.left[size]))
            for s, k in ((two[0], 1), (two[1], 1)) if two else ((size, n),):
                sizes.take(s, k)
                items[s] = items.get(s, 0) + k
                gap -= s * k
        more = min(sizes.left.get(s, 0) // n for s, n in items.items())
        places, at = [], 0
        for s, n in sorted(items.items(), reverse=True):
            if more:
                sizes.take(s, n * more)
            places.append((s, n, at, s, capacity))
            at += s * n
        patterns.append(Pattern(places, more + 1))
    return patterns


def _kept(windows: list[tuple[dict[int, int], int]], share: float, sizes: _Sizes) -> list[tuple[dict[int, int], int]]:
    """The first ``share`` of the windows; the items of the others go back."""
    room, out = int(share * sum(times for _, times in windows)), []
    for items, times in windows:
        own = min(times, room)
        room -= own
        if own:
            out.append((items, own))
        if own < times:
            for s, n in items.items():
                sizes.give_back(s, n * (times - own))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Patterns that hold every item of the histogram exactly once; their number is bounded by the capacity, not by the items.

    ``tiers`` are window lengths in ascending order below the capacity; the capacity is the last tier.
    Where windows take so many small items that the rest fills its containers badly, some are opened
    again: of several shares of windows that are kept, the largest with the fewest containers counts.
    """
    lengths = (*tiers, capacity)
    if any(a >= b for a, b in zip(lengths, lengths[1:], strict=False)) or lengths[0] < 1:
        raise ValueError(f"tiers must rise up to the capacity: {lengths}")
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    best, fewest = [], None
    for share in KEPT_SHARES:
        sizes, patterns = _Sizes(counts), []
        for i in range(len(lengths) - 1, -1, -1):
            windows = _kept(_windows(sizes, lengths[i - 1] if i else 0, lengths[i], i == 0), share, sizes)
            patterns += _side_by_side(windows, lengths[i], capacity, sizes)
        patterns += _by_length(sizes, capacity)
        n = sum(p.times for p in patterns)
        if fewest is None or n < fewest:
            best, fewest = patterns, n
        if fewest == least:
            break
    return best


def _runs(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """By size and rank: where the items of each pattern go. Containers are numbered by falling cost."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for p in sorted(patterns, key=lambda p: (-p.cost, p.places)):
        for size, n, offset, apart, window in p.places:
            rows.append((size, used.get(size, 0), base, n, offset, apart, window))
            used[size] = used.get(size, 0) + n * p.times
        base += p.times
    rows.sort()
    names = ("size", "rank", "base", "each", "offset", "apart", "window")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)} | {"containers": np.array([base])}


def pieces(sizes: DataFrame, key: str, n_tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, part, n_tokens``: one row for each item; only items above the capacity are cut, into full pieces and a rest."""
    each = sizes.select(key, F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("_n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / capacity).cast("int"))
    cut = each.select(key, "_n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return cut.select(key, "part", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("part") * capacity).alias("n_tokens"))


def pack(sizes: DataFrame, key: str, n_tokens: str, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = 8, bucket_rows: int = 200_000) -> DataFrame:
    """``key, part, n_tokens, tier, container_id, position, step_group``: a place for every item.

    ``tier`` is the length of the window that the item shares with others, ``position`` the token at
    which it starts in its container; no item crosses the end of its window. Step groups hold about
    ``group`` containers each and are dealt back and forth over the containers in order of cost
    (the sum of squared lengths), so that groups cost about the same. Items of no tokens, and of a
    null size, take no room: they have no container. Repeated keys are separate items. An empty
    input gives an empty result.
    """
    items = materialise(pieces(sizes, key, n_tokens, capacity), "items")
    counts = {r["n_tokens"]: r["n"] for r in items.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = _runs(plan(counts, capacity, tiers))
    groups = max(1, -(-int(runs["containers"][0]) // group))
    # items of one size are ranked in buckets, as one size may hold a third of all
    buckets = max(1, min(4_096, -(-max(counts.values(), default=1) // bucket_rows)))
    marked = items.withColumn("_bucket", F.pmod(F.xxhash64(key, "part"), F.lit(buckets)))
    sums = marked.where("n_tokens > 0").groupBy("n_tokens", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("n_tokens", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("n_tokens", "_bucket").orderBy(key, "part")
    ranked = marked.where("n_tokens > 0").withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["n_tokens", "_bucket"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_key = runs["size"] << 44 | runs["rank"]
        for b in batches:
            size, rank = b["n_tokens"].to_numpy(), b["_at"].to_numpy()
            run = np.searchsorted(run_key, size << 44 | rank, side="right") - 1
            turn, slot = np.divmod(rank - runs["rank"][run], runs["each"][run])
            container = runs["base"][run] + turn
            lap, seat = np.divmod(container, groups)
            yield b[[key, "part", "n_tokens"]].assign(
                tier=runs["window"][run],
                container_id=container,
                position=runs["offset"][run] + slot * runs["apart"][run],
                step_group=np.where(lap % 2 == 0, seat, groups - 1 - seat),
            )

    kind = items.schema[key].dataType.simpleString()
    placed = ranked.select(key, "part", "n_tokens", (F.col("_start") + F.col("_rank")).alias("_at")).mapInPandas(
        place, f"`{key}` {kind}, part int, n_tokens long, tier long, container_id long, position long, step_group long"
    )
    none = F.lit(None).cast("long")
    return placed.unionByName(items.where("n_tokens = 0").select(key, "part", "n_tokens", none.alias("tier"), none.alias("container_id"), none.alias("position"), none.alias("step_group")))


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, n_tokens, least_containers, unused_share``: one row."""
    sums = placed.where("container_id IS NOT NULL").agg((F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    return sums.select(
        F.coalesce("containers", F.lit(0)).alias("containers"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.ceil(F.coalesce("n_tokens", F.lit(0)) / capacity).alias("least_containers"),
        (1 - F.col("n_tokens") / (F.col("containers") * capacity)).alias("unused_share"),
    )
