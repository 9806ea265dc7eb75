"""Reading level of documents from n-gram surprisal.

One interpolated n-gram model is trained for each level on labelled documents. The surprisal of
every token of a document under these models gives distributions over its tokens and over its
sentences. Their means, spreads and quantiles, and nothing else, make one score by ridge
regression, and isotonic regression maps the score monotonically to the graded levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.language import tokens_of, words_of
from rookery.session import spread

UNKNOWN, END, COMMA, START = 0, 1, 2, 3
FIXED = 4
#: Weights of trigram, bigram, unigram and uniform estimates.
MIX = (0.35, 0.35, 0.29, 0.01)
LEVELS = (1, 2, 3, 4, 5)
#: Quantiles of the distributions, and how many nats of a sentence count as one when levels are weighed.
QUANTILES, SHARPNESS = (0.1, 0.25, 0.5, 0.75, 0.9), (1.0, 4.0, 12.0)


def reading_tokens(text: Column) -> Column:
    """Tokens between white space; a line break counts as the end of a sentence."""
    return tokens_of(F.regexp_replace(text, r"[\r\n]+", " | "))


def symbols(token: str) -> list[str]:
    """Words of a token and the marks ``.`` (end of a sentence) and ``,`` after them."""
    words = words_of(token)
    if words is None:
        return []
    tail = token.rstrip("\"'”»)]*_")[-1:]
    if tail in ".!?…|;．！？；｜":
        return [*words, "."] if words or token == "|" else []
    return [*words, ","] if tail in ",，" and words else words


class Ragged:
    """Flat symbol ids of a batch, with the owner of each and the number of its sentence."""

    def __init__(self, column: pa.Array, ids: dict[str, int], cache: dict[str, list[int]]):
        tokens = column.flatten().dictionary_encode()
        codes = tokens.indices.to_numpy(zero_copy_only=False)
        each = []
        for token in tokens.dictionary.to_pylist():
            own = cache.get(token)
            if own is None:
                own = [ids.get(s, UNKNOWN) for s in symbols(token)]
                if len(token) <= 40:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[token] = own
            each.append(own)
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for own in each for i in own), np.int64, int(lengths.sum()))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        at = np.repeat(starts[codes] - np.concatenate(([0], ends[:-1])), n) + np.arange(ends[-1]) if len(ends) and ends[-1] else np.empty(0, np.int64)
        owner = np.repeat(np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), n)
        symbol = flat[at]
        # an end after nothing, or after another end, ends no sentence
        new = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool)
        after_end = new | np.concatenate(([True], symbol[:-1] == END)) if len(owner) else new
        keep = ~((symbol == END) & after_end)
        self.symbol, self.owner = symbol[keep], owner[keep]
        first = np.concatenate(([True], (self.owner[1:] != self.owner[:-1]) | (self.symbol[:-1] == END))) if len(self.owner) else np.empty(0, bool)
        self.sentence = np.cumsum(first) - 1
        self.before = np.where(first, START, np.concatenate(([START], self.symbol[:-1]))) if len(first) else self.symbol
        second = first | np.concatenate(([True], first[:-1])) if len(first) else first
        self.before2 = np.where(second, START, np.concatenate(([START, START], self.symbol[:-2]))[: len(first)]) if len(first) else self.symbol


def distribution(x: np.ndarray, owner: np.ndarray, n: int, quantiles: tuple[float, ...] = QUANTILES) -> list[np.ndarray]:
    """Mean, spread and quantiles of the values of each owner 0 .. n - 1; zeros where it has none."""
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    mean = np.bincount(owner, weights=x, minlength=n) / some
    spread_ = np.sqrt(np.maximum(np.bincount(owner, weights=x * x, minlength=n) / some - mean * mean, 0))
    if not len(x):
        return [mean, spread_, *(np.zeros(n) for _ in quantiles)]
    # one sort for all owners: values scaled into 0..0.5 behind the owner's number
    low = x.min()
    width = 2 * max(x.max() - low, 1e-9)
    ordered = np.sort(owner + (x - low) / width)
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    picked = []
    for q in quantiles:
        at = np.minimum(start + np.floor(np.maximum(count - 1, 0) * q + 0.5).astype(np.int64), len(x) - 1)
        picked.append(np.where(count > 0, (ordered[at] - np.arange(n)) * width + low, 0.0))
    return [mean, spread_, *picked]


@dataclass
class LevelModel:
    """Joint table of n-grams with their log-probability under each level's interpolated model."""

    ids: dict[str, int]
    uni: np.ndarray
    bi_keys: np.ndarray
    bi: np.ndarray
    tri_keys: np.ndarray
    tri: np.ndarray
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    steps: list | None = None
    #: Of documents that no step has seen: share of right levels, and precision and recall of the two upper ones.
    held_out_accuracy: float = float("nan")
    held_out_precision: float = float("nan")
    held_out_recall: float = float("nan")

    def surprisal(self, r: Ragged) -> np.ndarray:
        size = len(self.uni)
        bi_key = r.before * size + r.symbol
        out = self.uni[r.symbol]
        if len(self.bi_keys):
            at = np.minimum(np.searchsorted(self.bi_keys, bi_key), len(self.bi_keys) - 1)
            hit = np.flatnonzero(self.bi_keys[at] == bi_key)
            out[hit] = self.bi[at[hit]]
            tri_key = r.before2[hit] * (size * size) + bi_key[hit]
            at = np.minimum(np.searchsorted(self.tri_keys, tri_key), len(self.tri_keys) - 1)
            ok = self.tri_keys[at] == tri_key
            out[hit[ok]] = self.tri[at[ok]]
        return -out

    def features(self, r: Ragged, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of surprisal in the documents 0 .. n - 1, and which of them have any word."""
        s = self.surprisal(r)
        words = np.bincount(r.owner[(r.symbol != END) & (r.symbol != COMMA)], minlength=n)
        sentences = int(r.sentence[-1]) + 1 if len(r.sentence) else 0
        of = np.zeros(sentences, np.int64)
        of[r.sentence] = r.owner
        whole = np.stack([np.bincount(r.sentence, weights=s[:, k], minlength=sentences) for k in range(s.shape[1])], axis=1)
        least = whole.min(axis=1)
        columns = []
        # the level that a sentence speaks for, weighed by its surprisal under each level's model
        for sharp in SHARPNESS:
            p = np.exp((least[:, None] - whole) / sharp)
            columns += distribution(p @ np.array(LEVELS) / np.maximum(p.sum(axis=1), 1e-300), of, n)
        # surprisal under each model, compared to the mean of all; then the least, as it is
        for k in range(s.shape[1]):
            columns += distribution(whole[:, k] - whole.mean(axis=1), of, n, QUANTILES[1:-1])
            columns += distribution(s[:, k] - s.mean(axis=1), r.owner, n, QUANTILES[:: len(QUANTILES) - 1])
        columns += distribution(np.log1p(least), of, n) + distribution(s.min(axis=1), r.owner, n)
        return np.stack(columns, axis=1), words > 0

    def spread(self, features: np.ndarray) -> np.ndarray:
        """Standardised features, their squares, and a constant."""
        z = np.clip((features - self.center) / self.scale, -4, 4)
        return np.column_stack([z, z * z, np.ones(len(z))])

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.spread(features) @ self.weights

    def grade(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level of each score and the expected level, both non-decreasing in the score."""
        reach = np.stack([np.interp(score, x, y) for x, y in self.steps], axis=1)
        return 1 + (np.minimum.accumulate(reach, axis=1) >= 0.5).sum(axis=1), 1 + reach.sum(axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators; block means at block means of ``x``."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(a), float(b), 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a1, b1, n1 = blocks.pop()
            a0, b0, n0 = blocks[-1]
            blocks[-1] = [(a0 * n0 + a1 * n1) / (n0 + n1), (b0 * n0 + b1 * n1) / (n0 + n1), n0 + n1]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def _count(rows: Ragged, level: np.ndarray, ids: dict[str, int], pseudo: float = 0.5) -> LevelModel:
    size, k = max(ids.values(), default=FIXED - 1) + 1, len(LEVELS)
    of = level[rows.owner]

    def table(keys):
        distinct, at = np.unique(keys, return_inverse=True)
        out = np.zeros((len(distinct), k))
        np.add.at(out, (at, of), 1)
        return distinct, out

    uni = np.zeros((size, k))
    np.add.at(uni, (rows.symbol, of), 1)
    # a little of the pooled counts goes into each level's, as some levels have few documents
    pooled = lambda c: c + pseudo * c.sum(axis=1, keepdims=True) / k
    uni = pooled(uni)
    p1 = MIX[2] * uni / np.maximum(uni.sum(axis=0), 1e-9) + MIX[3] / size
    bi_keys, bi = table(rows.before * size + rows.symbol)
    bi = pooled(bi)
    context, at = np.unique(bi_keys // size, return_inverse=True)
    sums = np.zeros((len(context), k))
    np.add.at(sums, at, bi)
    p2 = MIX[1] * bi / np.maximum(sums[at], 1e-9) + p1[bi_keys % size]
    tri_keys, tri = table(rows.before2 * size * size + rows.before * size + rows.symbol)
    tri = pooled(tri)
    context, at = np.unique(tri_keys // size, return_inverse=True)
    sums = np.zeros((len(context), k))
    np.add.at(sums, at, tri)
    p3 = MIX[0] * tri / np.maximum(sums[at], 1e-9) + p2[np.searchsorted(bi_keys, tri_keys % (size * size))]
    return LevelModel(ids, np.log(p1), bi_keys, np.log(p2), tri_keys, np.log(p3))


def train(tokens: list[list[str]], levels: list[int], folds: int = 4, least_count: int = 3, ridge: float = 20.0, held_out: int = 8) -> LevelModel:
    """Fit on token lists of labelled documents and their levels.

    Every ``held_out``-th document is kept out of all steps, and the accuracy is measured on these.
    Of the others, scores for the ridge and the isotonic step come from n-gram models that haven't
    seen the document (``folds`` parts).
    """
    apart = np.arange(len(tokens)) % held_out == held_out - 1
    if apart.all() or not apart.any():
        apart[:] = False
    inner = [t for t, out in zip(tokens, apart, strict=True) if not out]
    column, target = pa.array(inner, pa.list_(pa.string())), np.asarray(levels)[~apart]
    seen: dict[str, int] = {}
    for own in inner:
        for token in own:
            for s in symbols(token):
                seen[s] = seen.get(s, 0) + 1
    words = sorted(s for s, n in seen.items() if n >= least_count and s not in ".,")
    ids = {".": END, ",": COMMA, **{w: FIXED + i for i, w in enumerate(words)}}
    cache: dict[str, list[int]] = {}
    fold = np.arange(len(inner)) % max(2, min(folds, len(inner)))
    x, ok = None, np.zeros(len(inner), bool)
    for f in np.unique(fold):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        part = _count(Ragged(column.take(pa.array(inside)), ids, cache), target[inside] - 1, ids)
        own, has = part.features(Ragged(column.take(pa.array(outside)), ids, cache), len(outside))
        x = np.zeros((len(inner), own.shape[1])) if x is None else x
        x[outside], ok[outside] = own, has
    model = _count(Ragged(column, ids, cache), target - 1, ids)
    x, y = x[ok], target[ok].astype(float)
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = model.spread(x)
    # each level weighs the same, however many documents have it
    w = 1.0 / np.bincount(target, minlength=6)[target[ok]]
    a = z.T @ (z * w[:, None]) + ridge * w.mean() * np.diag([*np.ones(z.shape[1] - 1), 0.0])
    model.weights = np.linalg.solve(a, z.T @ (w * y))
    score = model.score(x)
    model.steps = [isotonic(score, (y >= k).astype(float)) for k in LEVELS[1:]]
    if apart.any():
        outer = pa.array([t for t, out in zip(tokens, apart, strict=True) if out], pa.list_(pa.string()))
        x, has = model.features(Ragged(outer, ids, cache), len(outer))
        found, true = model.grade(model.score(x[has]))[0], np.asarray(levels)[apart][has]
        both = ((found >= 4) & (true >= 4)).sum()
        model.held_out_accuracy = float((found == true).mean()) if len(true) else float("nan")
        model.held_out_precision, model.held_out_recall = (float(both / n) if n else float("nan") for n in ((found >= 4).sum(), (true >= 4).sum()))
    return model


def labelled(documents: DataFrame, key: str, text: str, labels: DataFrame, level: str, max_labels: int = 6_000) -> tuple[list[list[str]], list[int]]:
    """Token lists and levels of at most ``max_labels`` labelled documents (in order of a hash of the key).

    The keys are chosen from the labels alone, so no text but the chosen ones is moved. Repeated
    labels count once; labels without a level from 1 to 5 or without a document are ignored.
    """
    own = labels.where(F.col(level).isin(*LEVELS) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(level).alias("_level"))
    order = F.xxhash64("_key")
    share = min(1.0, 2 * max_labels / max(1, own.count()))
    few = own.where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)  # about twice as many as are taken
    chosen = few.orderBy(order, "_key").limit(max_labels)
    texts = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_key").select("_key", "_level", reading_tokens(F.col("_text")).alias("_tokens"))
    taken = rows.orderBy(order, "_key").limit(max_labels).toArrow()
    return taken.column("_tokens").to_pylist(), taken.column("_level").to_pylist()


def reading_levels(documents: DataFrame, key: str, text: str, model: LevelModel) -> DataFrame:
    """``key, reading_level, expected_level, score``: one row for each document with words."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            column = batch.column("_tokens")
            for at in range(0, len(column), 1000):
                part = column.slice(at, 1000)
                x, has = model.features(Ragged(part, model.ids, cache), len(part))
                x = x[has]
                score = model.score(x)
                level, expected = model.grade(score)
                keys = batch.column(key).slice(at, 1000).take(pa.array(np.flatnonzero(has)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(level.astype(np.int32)), pa.array(expected), pa.array(score)], [key, "reading_level", "expected_level", "score"])

    return spread(documents.select(key, text)).select(key, reading_tokens(F.col(text)).alias("_tokens")).mapInArrow(
        run, f"`{key}` {kind}, reading_level int, expected_level double, score double"
    )
