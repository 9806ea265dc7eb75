"""Language of texts and of their parts: sparse multinomial logistic regression over character n-grams.

The classifier is fit on labelled sentences: TF-IDF of character n-grams inside words, trained by
follow-the-regularised-leader with L1 and L2 penalties, then calibrated by one temperature. N-grams
never cross words, so the score of a stretch of text is a sum over its words. That makes segments
cheap: each word is scored once, and the best path of languages over the words (a change costs,
less so after a stop) cuts the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.labels import named_language
from rookery.llm.skeleton import LOOK_ALIKES
from rookery.session import spread

MARK = "▁"
ORDERS = (1, 2, 3, 4)
WORD = re.compile(r"[^\W\d_]+(?:['’‐-][^\W\d_]+)*")
LONG_RUN = re.compile(r"(.)\1{2,}")
STOPS = tuple(".!?…|;:)»”\"")
UNSEEN = "­​‌‍‎‏⁠﻿"
SPACES = r"[\s\u0085   -     　]+"


def plain_word(word: str) -> str:
    """Lower case, without runs of three or more equal letters, and in one script.

    A word with any letter that is only Latin has its look-alikes from other scripts replaced.
    """
    word = LONG_RUN.sub(r"\1", word.lower())
    if not word.isascii() and any("a" <= c <= "z" or "À" <= c <= "ɏ" for c in word):
        word = "".join(LOOK_ALIKES.get(c, c).lower() for c in word)
    return word


def words_of(token: str) -> list[str] | None:
    """Words of one token between white space; None for mentions, hashtags, links and repost marks."""
    token = unicodedata.normalize("NFKC", token)
    bare = token.lstrip("([{\"'“«.,:;!?-")
    if bare[:1] in ("@", "#") or "://" in bare or bare[:4].lower() == "www." or bare.rstrip(":") == "RT":
        return None
    return [plain_word(w) for w in WORD.findall(token)]


def ngrams(word: str) -> Counter:
    text = MARK + word + MARK
    return Counter(text[i : i + n] for n in ORDERS for i in range(len(text) - n + 1) if text[i : i + n] != MARK)


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: dict[str, int]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    held_out_accuracy: float = float("nan")
    _words: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_words": {}}

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        known = [(self.vocabulary[g], c) for g, c in counts.items() if g in self.vocabulary]
        at = np.fromiter((i for i, _ in known), np.int64, len(known))
        return at, np.fromiter((c for _, c in known), float, len(known)) * self.idf[at]

    def word(self, word: str) -> np.ndarray:
        """Raw score of each language and, last, the squared length of the word's vector."""
        row = self._words.get(word)
        if row is None:
            at, x = self.vector(ngrams(word))
            row = np.append(x @ self.weights[at], x @ x)
            if len(word) <= 40:
                if len(self._words) > 100_000:
                    self._words.clear()
                self._words[word] = row
        return row

    def log_probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated log-probabilities of stretches, from summed rows of :meth:`word`."""
        z = (sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-12)) + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _ftrl(rows, truth, n_features, n_classes, epochs, alpha, beta, l1, l2, seed):
    """FTRL-proximal, one example at a time, with per-coordinate rates and elastic-net penalties."""
    z, n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))

    def weights(at):
        zz = z[at]
        w = (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[truth[i]] -= 1
            g = x[:, None] * p
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / alpha * w
    return weights(np.arange(n_features + 1))


def train(
    samples: list[tuple[str, str]], max_samples: int = 5_000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 0.002, l2: float = 0.002, held_out: int = 8, seed: int = 7,
) -> LanguageModel:
    """Fit on ``(language, sentence)`` pairs, at most ``max_samples`` of them (the first in order).

    Every ``held_out``-th sentence is kept out; on its stretches of one, three and eight words the
    temperature is chosen by least log-loss and the accuracy measured, which no temperature changes, as
    it leaves the order of the languages as it is. Each training sentence also
    counts without accents, as careless writers leave them out. Null or blank samples are ignored.
    """
    samples = [(lang, text) for lang, text in samples if lang and text and text.strip()][:max_samples]
    if not samples:
        raise ValueError("no labelled sentences")
    languages = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)

    def stretches(text: str) -> Iterator[Counter]:
        words = [w for token in text.split() for w in words_of(token) or []]
        grams = [ngrams(w) for w in words]
        for size in (1, 3, 8):
            for i in range(0, max(1, len(grams) - size + 1), max(1, size // 2)):
                if grams[i : i + size]:
                    yield sum(grams[i : i + size], Counter())

    kept, out = [], []
    for i, (lang, text) in enumerate(samples):
        (out if len(samples) > held_out and i % held_out == held_out - 1 else kept).append((languages.index(lang), text))
    df = Counter()
    for _, text in kept:
        for variant in {text, _without_accents(text)}:
            df.update({g for token in variant.split() for w in words_of(token) or [] for g in ngrams(w)})
    vocabulary = {g: i for i, g in enumerate(sorted(df))}
    idf = np.array([np.log((1 + len(kept)) / (1 + df[g])) + 1 for g in vocabulary])
    model = LanguageModel(languages, vocabulary, idf, np.zeros((len(idf), len(languages))), np.zeros(len(languages)))

    def examples(part, accents):
        rows, truth = [], []
        for y, text in part:
            for variant in sorted({text, _without_accents(text)}) if accents else [text]:
                for counts in stretches(variant):
                    at, x = model.vector(counts)
                    if len(at):
                        rows.append((np.append(at, len(idf)), np.append(x / np.sqrt(x @ x), 1.0)))
                        truth.append(y)
        return rows, truth

    rows, truth = examples(kept, True)
    w = _ftrl(rows, truth, len(idf), len(languages), epochs, alpha, beta, l1, l2, seed)
    model.bias = w[-1]
    used = np.flatnonzero(np.abs(w[:-1]).sum(axis=1))  # the L1 penalty leaves most n-grams without a weight
    names = [*vocabulary]
    model.vocabulary, model.idf, model.weights = {names[i]: j for j, i in enumerate(used)}, idf[used], w[used]

    logits, truth = [], []
    for y, text in out or kept:
        for counts in stretches(text):
            at, x = model.vector(counts)
            logits.append(x @ model.weights[at] / np.sqrt(max(x @ x, 1e-12)) + model.bias)
            truth.append(y)
    logits, truth = np.array(logits), np.array(truth)
    least = None
    for t in np.geomspace(0.1, 3.0, 60):
        z = logits / t
        loss = (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), truth]).mean()
        if least is None or loss < least[0]:
            least = (loss, float(t))
    model.temperature = least[1]
    model.held_out_accuracy = float((logits.argmax(1) == truth).mean())
    return model


def best_path(scores: np.ndarray, change: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best state of each word. ``scores`` and ``change`` (what entering another state costs) are flat over texts."""
    states = np.zeros(len(scores), np.int16)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    order = np.argsort(lengths, kind="stable")
    at = int((lengths == 0).sum())
    while at < len(order):
        # texts of like lengths together, in blocks of bounded size
        end = at + 1
        while end < len(order) and (end - at + 1) * lengths[order[end]] <= 150_000:
            end += 1
        rows = order[at:end]
        at, longest = end, int(lengths[rows[-1]])
        if not longest:
            continue
        steps = np.arange(longest)
        real = steps < lengths[rows][:, None]
        flat = starts[rows][:, None] + np.minimum(steps, lengths[rows][:, None] - 1)
        e = np.where(real[:, :, None], scores[flat], 0.0)
        c = change[flat]
        b = np.arange(len(rows))
        v = e[:, 0].copy()
        back = np.empty((longest, *v.shape), np.int8)
        every = np.arange(v.shape[1], dtype=np.int8)
        for t in range(1, longest):
            top = v.argmax(axis=1)
            switch = v[b, top] - c[:, t]
            stay = v >= switch[:, None]
            back[t] = np.where(stay, every, top[:, None])
            v = e[:, t] + np.where(stay, v, switch[:, None])
        k = v.argmax(axis=1)
        path = np.empty((len(rows), longest), np.int16)
        for t in range(longest - 1, -1, -1):
            path[:, t] = k
            if t:
                k = back[t][b, k]
        states[flat[real]] = path[real]
    return states


def _segmenter(model: LanguageModel, keys: list[str], least_words: int, change: float, after_stop: float):
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_tokens")
            tokens = column.flatten().dictionary_encode()
            codes = tokens.indices.to_numpy(zero_copy_only=False)
            distinct = tokens.dictionary.to_pylist()
            rows, stop, mark = np.zeros((len(distinct), k + 1)), np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
            number = np.zeros(len(distinct), np.int64)
            for i, token in enumerate(distinct):
                words = words_of(token)
                mark[i] = words == []  # a bar, a dash, a number, a picture
                if words:
                    number[i] = len(words)
                    rows[i] = sum((model.word(w) for w in words), np.zeros(k + 1))
                    stop[i] = token.endswith(STOPS)
            is_word = number[codes] > 0
            ends = (stop[codes] | np.append(mark[codes][1:], True))[is_word]
            owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))[is_word]
            kept = codes[is_word]
            if not len(kept):
                continue
            lengths = np.bincount(owner, minlength=len(column))
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            cost = np.where(np.concatenate(([False], ends[:-1])), after_stop, change)
            path = best_path(model.log_probabilities(rows)[kept], cost, lengths)
            new = first | np.concatenate(([True], path[1:] != path[:-1]))
            begin = np.flatnonzero(new)
            sums = np.add.reduceat(rows[kept], begin, axis=0)
            count = np.add.reduceat(number[kept], begin)
            lang = path[begin].astype(np.int64)
            sure = np.exp(model.log_probabilities(sums))[np.arange(len(begin)), lang]
            text_start = np.concatenate(([0], np.cumsum(np.bincount(owner, weights=number[kept], minlength=len(column)))[:-1]))
            before = np.concatenate(([0], np.cumsum(number[kept])[:-1]))[begin] - text_start[owner[begin]]
            take = count >= least_words
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(key).take(pa.array(owner[begin][take])) for key in keys),
                    pa.array(before[take].astype(np.int32)),
                    pa.array(count[take].astype(np.int32)),
                    pa.array(np.array(model.languages, object)[lang[take]], pa.string()),
                    pa.array(sure[take]),
                ],
                [*keys, "first_word", "n_words", "lang", "confidence"],
            )

    return run


def tokens_of(text: Column) -> Column:
    seen = F.translate(F.coalesce(text, F.lit("")), UNSEEN, "")
    return F.split(F.trim(F.regexp_replace(seen, SPACES, " ")), " ")


def language_segments(
    texts: DataFrame, keys: list[str], text: str, model: LanguageModel, least_words: int = 1, change: float = 24.0, after_stop: float = 8.0
) -> DataFrame:
    """``keys, first_word, n_words, lang, confidence``: stretches of one language in each text.

    Words are counted from 0 over the running text: mentions, hashtags, links and repost marks are
    passed over and interrupt nothing. Segments of fewer than ``least_words`` words are left out;
    null, empty and wordless texts have none. Repeated keys are kept. ``change`` and ``after_stop`` are
    what another language costs inside a sentence and after a stop, in units of log-probability. No shuffle unless the input has
    fewer partitions than there are cores.
    """
    kinds = ", ".join(f"`{key}` {texts.schema[key].dataType.simpleString()}" for key in keys)
    cut = _segmenter(model, keys, least_words, change, after_stop)
    return spread(texts.select(*keys, text)).select(*keys, tokens_of(F.col(text)).alias("_tokens")).mapInArrow(
        cut, f"{kinds}, first_word int, n_words int, lang string, confidence double"
    )


def text_languages(segments: DataFrame, key: str) -> DataFrame:
    """``key, lang, confidence, share``: the language with most words of each text (ties: by name)."""
    per = segments.groupBy(key, "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.col("n_words")).alias("w"))
    best = per.groupBy(key).agg(F.min_by(F.struct("lang", "n", "w"), F.struct(-F.col("n"), F.col("lang"))).alias("b"), F.sum("n").alias("all"))
    return best.select(key, "b.lang", (F.col("b.w") / F.col("b.n")).alias("confidence"), (F.col("b.n") / F.col("all")).alias("share"))


def unnamed_languages(texts: DataFrame, key: str, author: str, text: str, authors: DataFrame, label: str, model: LanguageModel, least_words: int = 4) -> DataFrame:
    """``key, lang``: languages with ``least_words`` words together in a text, but for the one its author's label names.

    ``authors`` has ``author`` and ``label``; repeated rows of one author count once (of differing
    labels the one that sorts last). Texts of unknown or null authors, or of authors whose label is
    missing or names no known language, keep all their languages. A heavy author is on the large
    side of the join only, where adaptive execution splits it.
    """
    found = language_segments(texts, [key, author], text, model, least_words).where(F.col(key).isNotNull()).select(key, author, "lang").distinct()
    named = authors.select(author, named_language(F.col(label)).alias("lang")).where("lang IS NOT NULL").groupBy(author).agg(F.max("lang").alias("_named"))
    joined = found.join(named, author, "left")
    return joined.where(F.col("_named").isNull() | (F.col("_named") != F.col("lang"))).select(key, "lang").distinct()
