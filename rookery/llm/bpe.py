"""Byte-level BPE over whole corpora, for rank files of public tokenizers.

Texts are cut into pre-tokens inside the JVM; an Arrow batch then holds each distinct pre-token
once, and only those go through the merges. The merges of one pre-token run over a rank queue:
each merge rank has a bucket of positions in a linked list of symbols, a hierarchy of bitmaps
over the ranks finds the least occupied one by find-first-set, and entries whose pair has gone
meanwhile are skipped. That is O(n log n) in the length of the pre-token, however long it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.session import spread

TOKENIZERS = os.environ.get("ROOKERY_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern of the public byte-level vocabularies; (?U) makes \s the Unicode property.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BITS = 64


class RankQueue:
    """Positions by rank. Three levels of 64-way bitmaps say which ranks have any."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank with its positions in ascending order, taken out."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = b << 6 | (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = a << 6 | (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class BytePairEncoder:
    """Merges of one rank file: token bytes and their ranks, which are also the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair(self, a: int, b: int) -> int:
        """Rank of the token that ``a`` and ``b`` make together, -1 if there is none."""
        rank = self.joined.get((a, b))
        if rank is None:
            self.joined[a, b] = rank = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def merge(self, data: bytes) -> list[int]:
        n = len(data)
        ids = [self.byte_ids[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            if (rank := self.pair(ids[i], ids[i + 1])) >= 0:
                queue.push(rank, i)
        while (least := queue.pop()) is not None:
            rank, positions = least
            for i in positions:
                j = after[i]
                # stale: the symbol is gone, is last by now, or its pair has another rank
                if ids[i] < 0 or j >= n or self.pair(ids[i], ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (right := self.pair(rank, ids[k])) >= 0:
                        queue.push(right, i)
                if (h := before[i]) >= 0 and (left := self.pair(ids[h], rank)) >= 0:
                    queue.push(left, h)
        return [t for t in ids if t >= 0]

    def encode(self, pre_token: str) -> tuple[int, ...]:
        ids = self.cache.get(pre_token)
        if ids is None:
            ids = tuple(self.merge(pre_token.encode()))
            if len(pre_token) <= 64:
                if len(self.cache) >= 200_000:
                    self.cache.clear()
                self.cache[pre_token] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def shipped(path: str) -> str:
    """Where a worker finds the rank file: among the files that came with the job, else at its own place."""
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else path


def vocabulary_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[c] : starts[c] + lengths[c]]`` of all codes, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.repeat(starts[codes] - np.concatenate(([0], ends[:-1])), n) + np.arange(ends[-1])
    return flat[at]


def _batches(path: str, key: str, only_counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shipped(path))
        for batch in batches:
            tokens = batch.column("_pre")
            words = tokens.flatten().dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            each = [own.encode(w) for w in words.dictionary.to_pylist()]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            # token ends of each text, from the ends of its pre-tokens
            ends = np.concatenate(([0], np.cumsum(lengths[codes]))) if len(codes) else np.zeros(1, np.int64)
            cuts = np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            bounds = ends[cuts]
            if only_counts:
                out = pa.array(np.diff(bounds).astype(np.int64))
            else:
                flat = np.fromiter((i for ids in each for i in ids), np.int32, int(lengths.sum()))
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
                ids = _ragged_take(flat, starts, lengths, codes)
                out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(key), out], [key, "n_tokens" if only_counts else "ids"])

    return run


def _encode(texts: DataFrame, key: str, text: str, path: str, only_counts: bool) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    texts.sparkSession.sparkContext.addFile(path)
    out = "n_tokens long" if only_counts else "ids array<int>"
    return spread(texts.select(key, text)).select(key, pre_tokens(F.col(text)).alias("_pre")).mapInArrow(_batches(path, key, only_counts), f"`{key}` {kind}, {out}")


def token_ids(texts: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key, ids``: ids of each text, without special tokens; an empty list for empty and null text.

    One row for each row of ``texts``, repeated keys included; no shuffle unless the input has fewer partitions than there are cores. Strings that spell a
    special token are ordinary text.
    """
    return _encode(texts, key, text, vocabulary_path(vocabulary, folder), False)


def token_counts(texts: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key, n_tokens``: the number of ids of each text, 0 for empty and null text."""
    return _encode(texts, key, text, vocabulary_path(vocabulary, folder), True)
