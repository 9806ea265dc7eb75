"""Language identification by byte n-grams: feature selection by information gain, naive Bayes.

N-grams are cut and counted per Arrow batch in numpy, so that a batch leaves as partial counts and
never as one row for each n-gram; the rest is grouping and closed-form columns. Terms are upper-case
hex text of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.session import materialise, spread

# Highest order, n-grams kept for each order, features kept for each language.
MAX_ORDER, PER_ORDER, PER_LANGUAGE = 4, 15_000, 300


def corpus(documents: DataFrame, key: str, text: str, lang: str, domain: str, langs: list[str] | None = None, domains: list[str] | None = None, share: float = 1.0, seed: int = 0) -> DataFrame:
    """``doc, lang, domain, bytes`` of documents with a text and both labels; optional whitelists and Bernoulli sample."""
    rows = documents.where(F.col(lang).isNotNull() & F.col(domain).isNotNull() & (F.col(text) != ""))
    if langs:
        rows = rows.where(F.col(lang).isin(langs))
    if domains:
        rows = rows.where(F.col(domain).isin(domains))
    if share < 1:
        rows = rows.sample(share, seed)
    return rows.select(F.col(key).alias("doc"), F.col(lang).alias("lang"), F.col(domain).alias("domain"), F.encode(F.col(text), "utf-8").alias("bytes"))


def min_domain(rows: DataFrame, least: int) -> DataFrame:
    """Only languages that occur in at least ``least`` domains."""
    kept = rows.groupBy("lang").agg(F.count_distinct("domain").alias("_n")).where(F.col("_n") >= least)
    return rows.join(kept.select("lang"), "lang", "left_semi").select(*rows.columns)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value ends; nulls have none."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or data is None or not len(column):
        return np.empty(0, np.int64), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.int64), at[1:] - at[0]


def _codes(data: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of every n-gram of one order, and the value it is from; none crosses two values."""
    if len(data) < order:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(data) - order + 1
    code = np.full(n, order, np.int64)
    for j in range(order):
        code = code << 8 | data[j : n + j]
    owner = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + order <= ends[owner]
    return code[inside], owner[inside]


def _term(code: int) -> str:
    return f"{code:X}"[1:]  # the first digit is the order


def code_of(term: str) -> int:
    return int(f"{len(term) // 2:X}{term}", 16)


def document_frequencies(rows: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """``term, lang, domain, n``: documents of each language and domain that contain the n-gram.

    Orders 1 to ``max_order``. Documents of fewer than ``max_order - 1`` bytes have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 2_000):
                batch = whole.slice(start, 2_000)
                pairs = list(zip(batch.column("lang").to_pylist(), batch.column("domain").to_pylist(), strict=True))
                names = sorted(set(pairs))
                at = {p: i for i, p in enumerate(names)}
                group = np.fromiter((at[p] for p in pairs), np.int64, len(pairs))
                data, ends = _bytes_of(batch.column("bytes"))
                long_enough = np.diff(np.concatenate(([0], ends))) >= max_order - 1
                codes, groups, counts = [], [], []
                for order in range(1, max_order + 1):
                    code, owner = _codes(data, ends, order)
                    kept = long_enough[owner]
                    once = np.unique(code[kept] * len(batch) + owner[kept])  # each n-gram once for each document
                    cell, n = np.unique(once // len(batch) * len(names) + group[once % len(batch)], return_counts=True)
                    codes.append(cell // len(names))
                    groups.append(cell % len(names))
                    counts.append(n)
                by = np.concatenate(groups)
                label = [pa.array([x[i] for x in names], pa.string()).take(pa.array(by)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), *label, pa.array(np.concatenate(counts))], ["code", "lang", "domain", "n"])

    part = spread(rows.select(F.col("lang").cast("string"), F.col("domain").cast("string"), "bytes")).mapInArrow(run, "code long, lang string, domain string, n long")
    sums = part.groupBy("code", "lang", "domain").agg(F.sum("n").alias("n"))
    # the first hex digit of a code is the order
    return sums.select(F.substr(F.hex("code"), F.lit(2)).alias("term"), "lang", "domain", "n")


def word_frequencies(rows: DataFrame) -> DataFrame:
    """The same for words between white space, each as the hex text of its bytes."""
    words = rows.select("doc", "lang", "domain", F.explode(F.array_distinct(F.split(F.decode("bytes", "utf-8"), r"\s+"))).alias("w")).where("w <> ''")
    return words.groupBy(F.hex(F.encode("w", "utf-8")).alias("term"), "lang", "domain").agg(F.count(F.lit(1)).alias("n"))


def top_terms(df: DataFrame, per_order: int | None = PER_ORDER, total: int | None = None) -> DataFrame:
    """``term, n``: the most frequent terms of each length, or with ``total`` overall; ties by term.

    A length above the highest order has few terms, so a window for each length spreads badly only
    for very few lengths; terms are pre-ranked by a hash bucket first.
    """
    sums = df.groupBy("term").agg(F.sum("n").alias("n"))
    if total is not None:
        return sums.orderBy(F.desc("n"), "term").limit(total)
    best = [F.desc("n"), F.col("term")]
    local = F.row_number().over(Window.partitionBy(F.length("term"), F.pmod(F.xxhash64("term"), F.lit(64))).orderBy(*best))
    final = F.row_number().over(Window.partitionBy(F.length("term")).orderBy(*best))
    return sums.withColumn("_r", local).where(F.col("_r") <= per_order).withColumn("_r", final).where(F.col("_r") <= per_order).select("term", "n")


def _entropy(counts: list[Column]) -> Column:
    """Natural-log entropy of counts; 0 of no counts."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def information_gain(df: DataFrame, sizes: dict[str, int], by: str, one_against_rest: bool) -> DataFrame:
    """``term, ig`` or, one against the rest, ``term, event, ig``.

    ``sizes``: documents of each event (language or domain; a bounded list of labels). ``df`` has
    the documents with the term by event. Against all events at once only sums of x ln x are kept,
    so the plan doesn't grow with the number of labels.
    """
    events, total = sorted(sizes), float(sum(sizes.values()))
    if not one_against_rest:
        size = df.sparkSession.createDataFrame([(e, float(sizes[e])) for e in events], f"`{by}` string, _size double")
        each = df.groupBy("term", by).agg(F.sum("n").cast("double").alias("c")).join(F.broadcast(size), by)
        # documents without the term: those of events that lack it are the same for every term
        other = _x_log_x(F.col("_size") - F.col("c")) - _x_log_x(F.col("_size"))
        sums = each.groupBy("term").agg(F.sum("c").alias("n"), F.sum(_x_log_x(F.col("c"))).alias("have"), F.sum(other).alias("lack"))
        whole = sum(x * math.log(x) for x in map(float, sizes.values()) if x > 0)
        n, rest = F.col("n"), F.lit(total) - F.col("n")
        inside, outside = _x_log_x(n) - F.col("have"), _x_log_x(rest) - (F.col("lack") + whole)
        return sums.select("term", (F.lit(math.log(total) - whole / total if total else 0.0) - (inside + outside) / total).alias("ig"))
    counts = df.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col(by) == e, F.col("n"))), F.lit(0)).cast("double").alias(f"c{i}") for i, e in enumerate(events)))
    with_term = [F.col(f"c{i}") for i in range(len(events))]
    n = sum(with_term[1:], with_term[0])

    def gain(have: list[Column], all_: list[float]) -> Column:
        base = -sum(x / total * math.log(x / total) for x in all_ if x > 0)
        rest = [F.lit(float(a)) - h for a, h in zip(all_, have, strict=True)]
        return F.lit(base) - n / total * _entropy(have) - (total - n) / total * _entropy(rest)

    each = [
        F.struct(F.lit(e).alias("event"), gain([with_term[i], n - with_term[i]], [float(sizes[e]), total - sizes[e]]).alias("ig")) for i, e in enumerate(events)
    ]
    return counts.select("term", F.explode(F.array(*each)).alias("x")).select("term", "x.event", "x.ig")


def ld_weights(ig_lang: DataFrame, ig_domain: DataFrame | None) -> DataFrame:
    """``term, lang, ld``: gain for the language less gain for the domain (or without the latter)."""
    if ig_domain is None:
        return ig_lang.select("term", F.col("event").alias("lang"), F.col("ig").alias("ld"))
    return ig_lang.join(ig_domain.withColumnRenamed("ig", "_d"), "term").select("term", F.col("event").alias("lang"), (F.col("ig") - F.col("_d")).alias("ld"))


def select_features(ld: DataFrame, per_language: int = PER_LANGUAGE, digits: int = 9) -> DataFrame:
    """``lang, term, ld``: the best terms of each language by weight (equal to ``digits`` places: by term)."""
    w = Window.partitionBy("lang").orderBy(F.desc(F.round("ld", digits)), "term")
    return ld.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_language).select("lang", "term", "ld")


def feature_counts(rows: DataFrame, features: list[str]) -> DataFrame:
    """``feature, lang, n``: occurrences of each feature, overlapping ones too, in all documents of a language.

    Features are at most orders 1 to 4 here, a list bounded by the selection; longer ones: :func:`scan`.
    """
    code = np.array(sorted(code_of(f) for f in features), np.int64)
    orders = sorted({len(f) // 2 for f in features})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            at = {x: i for i, x in enumerate(names)}
            group = np.fromiter((at[x] for x in langs), np.int64, len(langs))
            data, ends = _bytes_of(batch.column("bytes"))
            counts = np.zeros((len(code), len(names)), np.int64)
            for order in orders:
                found, owner = _codes(data, ends, order)
                i = np.minimum(np.searchsorted(code, found), len(code) - 1)
                hit = code[i] == found
                counts += np.bincount(i[hit] * len(names) + group[owner[hit]], minlength=counts.size).reshape(counts.shape)
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_term(c) for c in code[i].tolist()], pa.string()), pa.array([names[x] for x in j], pa.string()), pa.array(counts[i, j])], ["feature", "lang", "n"]
            )

    return spread(rows.select(F.col("lang").cast("string"), "bytes")).mapInArrow(run, "feature string, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))


def scan(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``key, feature, n``: occurrences of features of any length, overlapping ones too, by an automaton over the bytes of each row.

    The automaton is that of the package pyahocorasick, which only this function needs.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for f in features:
        automaton.add_word(bytes.fromhex(f).decode("latin-1"), f)
    automaton.make_automaton()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, counts = [], [], []
            for i, data in enumerate(batch.column("bytes").to_pylist()):
                own: dict[str, int] = {}
                for _, f in automaton.iter((data or b"").decode("latin-1")) if features else ():
                    own[f] = own.get(f, 0) + 1
                keys += [i] * len(own)
                names += own
                counts += own.values()
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(keys, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], [key, "feature", "n"])

    return rows.select(key, "bytes").mapInArrow(run, f"`{key}` {kind}, feature string, n long")


def naive_bayes(counts: DataFrame, features: DataFrame, langs: list[str]) -> DataFrame:
    """``feature, lang, ptc``: ln(1 + n) - ln(F + sum of n in the language), for every feature and language."""
    full = features.select("feature").distinct().select("feature", F.explode(F.array(*(F.lit(x) for x in langs))).alias("lang"))
    dense = full.join(counts, ["feature", "lang"], "left").select("feature", "lang", F.coalesce("n", F.lit(0)).alias("n"))
    sums = dense.groupBy("lang").agg((F.sum("n") + F.count(F.lit(1))).alias("_all"))
    return dense.join(F.broadcast(sums), "lang").select("feature", "lang", (F.log(1.0 + F.col("n")) - F.log(F.col("_all").cast("double"))).alias("ptc"))


@dataclass
class Model:
    """Small enough for the driver: features are bounded by the selection, languages by the labels."""

    langs: list[str]
    features: list[str]
    ptc: np.ndarray
    pc: np.ndarray


def train(rows: DataFrame, max_order: int = MAX_ORDER, per_order: int = PER_ORDER, per_language: int = PER_LANGUAGE, domain_gain: bool = True, least_domains: int = 1, words: bool = False) -> Model:
    """All steps: document frequencies, selection by frequency, gains, selection by weight, counts, probabilities."""
    rows = materialise(min_domain(rows, least_domains) if least_domains > 1 else rows, "corpus")
    df = materialise(word_frequencies(rows) if words else document_frequencies(rows, max_order), "df")
    kept = df.join(top_terms(df, per_order), "term", "left_semi")
    size = {by: {r[by]: r["count"] for r in rows.groupBy(by).count().collect()} for by in ("lang", "domain")}
    gain = information_gain(kept, size["lang"], "lang", True)
    ld = ld_weights(gain, information_gain(kept, size["domain"], "domain", False) if domain_gain else None)
    features = [r["term"] for r in select_features(ld, per_language).select("term").distinct().orderBy("term").collect()]
    langs = sorted(size["lang"])
    if words or any(len(f) > 8 for f in features):
        counts = scan(rows, "lang", features).groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    else:
        counts = feature_counts(rows, features)
    n = np.zeros((len(features), len(langs)))
    at = {f: i for i, f in enumerate(features)}
    for r in counts.collect():
        n[at[r["feature"]], langs.index(r["lang"])] = r["n"]
    ptc = np.log(1 + n) - np.log(len(features) + n.sum(axis=0))
    return Model(langs, features, ptc, np.log([size["lang"][x] for x in langs]))


def classify(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``keys, lang, score, rank``: every language of each row by falling score (ties: by name). ``rows`` has ``bytes``."""
    code = np.array([code_of(f) for f in model.features], np.int64)
    order_ = np.argsort(code)
    code, ptc = code[order_], model.ptc[order_]
    orders = sorted({len(f) // 2 for f in model.features})
    k = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                data, ends = _bytes_of(batch.column("bytes"))
                score = np.tile(model.pc, (len(batch), 1))
                for order in orders:
                    found, owner = _codes(data, ends, order)
                    i = np.minimum(np.searchsorted(code, found), len(code) - 1)
                    hit = code[i] == found
                    i, owner = i[hit], owner[hit]
                    for j in range(k):
                        score[:, j] += np.bincount(owner, weights=ptc[i, j], minlength=len(batch))
                by = np.argsort(-score, axis=1, kind="stable")
                row = np.repeat(np.arange(len(batch)), k)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).take(pa.array(row)) for x in keys), pa.array(np.array(model.langs, object)[by.ravel()], pa.string()),
                     pa.array(np.take_along_axis(score, by, axis=1).ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)))],
                    [*keys, "lang", "score", "rank"],
                )

    kinds = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in keys)
    return spread(rows.select(*keys, "bytes")).mapInArrow(run, f"{kinds}, lang string, score double, rank int")


def message_language(ranked: DataFrame, messages: DataFrame, key: str, text: str, known: tuple[str, ...] = ("en", "es", "pt")) -> DataFrame:
    """``key, lid_lui``: ``--`` for fewer than five words, else the best known language (else the last-ranked one)."""
    best = ranked.groupBy(key).agg(F.min_by("lang", F.when(F.col("lang").isin(*known), F.col("rank"))).alias("_k"), F.max_by("lang", "rank").alias("_last"))
    short = F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")) < 5
    return messages.select(key, text).join(best, key, "left").select(key, F.when(F.col(text).isNull() | short, "--").otherwise(F.coalesce("_k", "_last")).alias("lid_lui"))


def pair_weights(ptc: DataFrame, lang_a: str, lang_b: str, normalise: bool = True) -> DataFrame:
    """``feature, weight``: |p(a) - p(b)| / sum of p over all languages, with p the softmax of ptc over the features."""
    top = ptc.groupBy("lang").agg(F.max("ptc").alias("_m"))
    shifted = ptc.join(F.broadcast(top), "lang").withColumn("_e", F.exp(F.col("ptc") - F.col("_m")))
    sums = shifted.groupBy("lang").agg(F.sum("_e").alias("_s"))
    p = shifted.join(F.broadcast(sums), "lang").select("feature", "lang", (F.col("_e") / F.col("_s")).alias("p"))
    a, b = (F.sum(F.when(F.col("lang") == x, F.col("p"))) for x in (lang_a, lang_b))
    return p.groupBy("feature").agg((F.abs(a - b) / (F.sum("p") if normalise else F.lit(1.0))).alias("weight"))


def feature_table(features: DataFrame, df: DataFrame, ig_lang: DataFrame, ig_domain: DataFrame, ptc: DataFrame, langs: list[str]) -> DataFrame:
    """One row for each feature: length, document frequency, gains, and a column for each language's gain and ptc."""
    total = df.groupBy("term").agg(F.sum("n").alias("df"))
    bins = ig_lang.groupBy("term").pivot("event", langs).agg(F.first("ig")).select("term", *(F.col(x).alias(f"ig_{x}") for x in langs))
    probs = ptc.groupBy("feature").pivot("lang", langs).agg(F.first("ptc")).select(F.col("feature").alias("term"), *(F.col(x).alias(f"ptc_{x}") for x in langs))
    own = features.select(F.col("feature").alias("term")).distinct()
    return own.join(total, "term", "left").join(ig_domain.withColumnRenamed("ig", "ig_domain"), "term", "left").join(bins, "term", "left").join(probs, "term", "left").withColumn("len", (F.length("term") / 2).cast("int"))
