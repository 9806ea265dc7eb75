"""Term and document frequency scores, TF-IDF cosine and percentile cut-offs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.text import clean_words
from rookery.operators.ranking import percentile_of, with_ranks
from rookery.session import materialise

URL_MARK = "http"
# Fixed value: what is no part of a word, in any script.
GAP = r"[^\p{L}\p{N}_]"


def check_window(start: str, end: str) -> None:
    """A window has to end after its start."""
    if not datetime.fromisoformat(end) > datetime.fromisoformat(start):
        raise ValueError(f"the window ends at {end}, not after {start}")


def days_since(start: str, created: Column) -> Column:
    """Whole days from the start of a window to a post; negative before it, null for undated posts."""
    return F.datediff(created, F.lit(start).cast("timestamp"))


def in_window(tweets: DataFrame, start: str, end: str) -> DataFrame:
    """Posts created from ``start`` to ``end``, both included; undated ones are in no window."""
    check_window(start, end)
    return tweets.where(F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def word_documents(tweets: DataFrame, key: str = "user_id", part_posts: int = 5_000) -> DataFrame:
    """``key, part, words``: the cleaned words of all posts of each user, in order of post id.

    A document comes in parts of ``part_posts`` posts, numbered from 0, so that the words of a user
    who wrote a third of all posts need not fit one row; most users have one part. Users or posts
    without an id, and posts without a text, are left out.
    """
    own = tweets.where(F.col(key).isNotNull() & F.col("tweet_id").isNotNull() & F.col("tweet").isNotNull()).select(key, "tweet_id", clean_words(F.split("tweet", " ", -1)).alias("w"))
    part = F.floor(F.col("_rank") / part_posts).cast("int").alias("part")
    posts = with_ranks(own, key, "tweet_id").groupBy(key, part).agg(F.array_sort(F.collect_list(F.struct("tweet_id", "w"))).alias("p"))
    return posts.select(key, "part", F.flatten(F.transform("p", lambda x: x["w"])).alias("words"))


def word_counts(tweets: DataFrame, key: str = "user_id") -> DataFrame:
    """``key, word, n``: how often each cleaned word occurs in a user's posts; no document is ever put together."""
    words = tweets.where(F.col(key).isNotNull()).select(key, F.explode(clean_words(F.split("tweet", " ", -1))).alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(counts: DataFrame, terms: DataFrame, kind: str = "raw", key: str = "user_id") -> DataFrame:
    """``key, term, tf`` of every (document, term) pair whose tf isn't 0 by absence.

    ``raw``: the count; ``boolean``: 1; ``augmented``: 0.5 + 0.5 * count / largest count, which is
    0.5 for absent terms, so it alone has a row for every document and term (terms are few).
    """
    if kind not in ("raw", "boolean", "augmented"):
        raise ValueError(f"unknown kind of term frequency: {kind}")
    term = terms.select(F.col("term")).distinct()
    hits = counts.join(term.withColumnRenamed("term", "word"), "word").select(key, F.col("word").alias("term"), "n")
    if kind == "raw":
        return hits.select(key, "term", F.col("n").cast("double").alias("tf"))
    if kind == "boolean":
        return hits.select(key, "term", F.lit(1.0).alias("tf"))
    most = counts.groupBy(key).agg(F.max("n").alias("most"))
    listed = term.agg(F.collect_set("term").alias("t"))  # one row, as long as the list of topics
    every = most.select(key, "most", F.explode(listed.scalar()).alias("term"))
    return every.join(hits, [key, "term"], "left").select(key, "term", (0.5 + 0.5 * F.coalesce("n", F.lit(0)) / F.col("most")).alias("tf"))


def topic_hits(tweets: DataFrame, topics: DataFrame) -> DataFrame:
    """``tweet_id, user_id, topic``: posts about a topic, each once.

    A topic with ``http`` in it matches as a substring of the text or as a linked address; any other
    as a whole word of the text, in any script, or as a hashtag, both in any case. Everything is an
    equi-join: word topics on words, topics of several words on their first word (their text is
    compared only where that occurs), links on the stretch of equal length that starts at ``http``.
    """
    own = topics.where("topic <> ''").select("topic").distinct()
    rows = tweets.where("tweet_id IS NOT NULL").select("tweet_id", "user_id", F.coalesce("tweet", F.lit("")).alias("text"), F.coalesce("hashtag_entities", F.array()).alias("tags"), F.coalesce("url_entities", F.array()).alias("urls"))
    is_link, is_word = F.col("topic").contains(URL_MARK), ~F.col("topic").rlike(GAP)
    words = F.split(F.lower("text"), GAP + "+")
    plain = own.where(~is_link & is_word).select("topic", F.lower("topic").alias("k"))
    by_word = rows.select("tweet_id", "user_id", F.explode(F.array_distinct(F.concat(words, F.transform("tags", F.lower)))).alias("k")).join(plain, "k")
    odd = own.where(~is_link & ~is_word).select("topic", F.lower("topic").alias("k"))
    first = F.get(F.filter(F.split("k", GAP + "+"), lambda w: w != ""), 0)
    maybe = rows.select("tweet_id", F.explode(F.array_distinct(words)).alias("w")).join(odd.select("topic", "k", first.alias("w")), "w").select("tweet_id", "topic", "k").distinct()
    quoted = F.regexp_replace("k", r"([^\p{L}\p{N}_\s])", r"\\$1")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])"))
    by_phrase = rows.select("tweet_id", "user_id", "text").join(maybe.select("tweet_id", "topic", whole.alias("pattern")), "tweet_id").where(F.expr("lower(text) RLIKE pattern"))
    by_tag = rows.select("tweet_id", "user_id", F.explode(F.transform("tags", F.lower)).alias("k")).join(odd, "k")
    links = own.where(is_link).select("topic", F.substr("topic", F.instr("topic", URL_MARK)).alias("k"))
    sizes = [r["n"] for r in links.select(F.length("k").alias("n")).distinct().collect()]  # lengths of addresses, a few hundred at most
    out = [by_word, by_phrase, by_tag]
    if sizes:
        tails = F.expr("transform(filter(sequence(1, greatest(length(text), 1)), i -> substr(text, i, 4) = 'http'), i -> substr(text, i))")
        starts = rows.where(F.col("text").contains(URL_MARK)).select("tweet_id", "user_id", "text", F.explode(tails).alias("s"))
        cut = starts.select("tweet_id", "user_id", "text", F.explode(F.array(*(F.substr("s", F.lit(1), F.lit(n)) for n in sizes))).alias("k"))
        out.append(cut.join(links, "k").where("contains(text, topic)"))
        out.append(rows.select("tweet_id", "user_id", F.explode("urls").alias("topic")).join(links, "topic"))
    hits = out[0].select("tweet_id", "user_id", "topic")
    for more in out[1:]:
        hits = hits.unionByName(more.select("tweet_id", "user_id", "topic"))
    return hits.distinct()


def document_frequency(tweets: DataFrame, topics: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``topic, document_frequency``: log10 of the share of users with a post about the topic; 0 where there is none.

    ``users`` restricts the users counted. With no posts at all every frequency is 0.
    """
    own = tweets if users is None else tweets.join(users.select("user_id").distinct(), "user_id", "left_semi")
    n = own.agg(F.count_distinct("user_id").alias("_n"))  # one row
    hits = topic_hits(own, topics).groupBy("topic").agg(F.count_distinct("user_id").alias("_t"))
    joined = topics.select("topic").distinct().join(hits, "topic", "left")
    return joined.select("topic", F.when(F.col("_t") > 0, F.log10(F.col("_t") / n.scalar())).otherwise(0.0).alias("document_frequency"))


def tfdf_scores(candidates: DataFrame, counts: DataFrame, df: DataFrame, kind: str = "raw") -> DataFrame:
    """``user_id, score``: sum over topics of tf * document frequency, divided by the number of candidates.

    ``candidates`` may name a user several times, which counts in the divisor; each user has one
    row. Users without words, and all where no topic occurs, score 0.
    """
    own = candidates.select("user_id").where("user_id IS NOT NULL")
    n = own.agg(F.count(F.lit(1)).alias("_n"))
    distinct = own.distinct()
    tf = term_frequency(counts.join(distinct, "user_id", "left_semi"), df.select(F.col("topic").alias("term")), kind)
    sums = tf.join(df.withColumnRenamed("topic", "term"), "term").groupBy("user_id").agg(F.sum(F.col("tf") * F.col("document_frequency")).alias("_s"))
    return distinct.join(sums, "user_id", "left").select("user_id", (F.coalesce("_s", F.lit(0.0)) / n.scalar()).alias("score"))


def keep_top(scores: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Rows at or above the exact ``share`` percentile of the scores (linear interpolation); null scores are below it."""
    cut = percentile_of(scores, score, share)
    return scores.limit(0) if cut is None else scores.where(F.col(score) >= cut)


@dataclass(frozen=True)
class TopicFacts:
    """What scores need to know about posts: ``about`` (``user_id, topic, n, hit``) and ``documents`` (``user_id, most``).

    ``n`` counts the topic among a user's cleaned words, ``hit`` says whether any post is about it;
    ``most`` is the count of the user's most frequent word, null without words.
    """

    about: DataFrame
    documents: DataFrame


def topic_facts(tweets: DataFrame, topics: DataFrame) -> TopicFacts:
    """Facts of all posts of known authors, made once for any number of parents."""
    own = tweets.where("user_id IS NOT NULL")
    counts = materialise(word_counts(own), "word-counts")
    hits = topic_hits(own, topics).select("user_id", "topic").distinct().withColumn("hit", F.lit(True))
    named = counts.join(topics.where("topic <> ''").select(F.col("topic").alias("word")).distinct(), "word").select("user_id", F.col("word").alias("topic"), "n")
    about = named.join(hits, ["user_id", "topic"], "full").select("user_id", "topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit", F.lit(False)).alias("hit"))
    documents = own.select("user_id").distinct().join(counts.groupBy("user_id").agg(F.max("n").alias("most")), "user_id", "left")
    return TopicFacts(materialise(about, "topic-facts"), materialise(documents, "documents"))


def scores_by_parent(candidates: DataFrame, facts: TopicFacts, kind: str = "raw", salts: int = 4) -> DataFrame:
    """``parent_id, user_id, times, score``: each parent's candidates scored among themselves.

    ``candidates`` (``parent_id, user_id``) may name a user several times for one parent, which
    counts in the divisor. The document frequency of a topic is log10 of its share of the
    candidates with posts; a score is the sum of tf * document frequency over topics, divided by the
    number of candidates, to twelve places. Users without words score 0. A user on very many lists
    is met by salted copies of the facts.
    """
    if kind not in ("raw", "boolean", "augmented"):
        raise ValueError(f"unknown kind of term frequency: {kind}")
    own = candidates.where("parent_id IS NOT NULL AND user_id IS NOT NULL").groupBy("parent_id", "user_id").agg(F.count(F.lit(1)).alias("times"))
    own = materialise(own.withColumn("_s", F.pmod(F.xxhash64("parent_id"), F.lit(salts))), "candidates")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s")
    known = materialise(own.join(facts.documents.select("*", F.lit(True).alias("posted"), every), ["user_id", "_s"], "left").select("parent_id", "user_id", "times", "most", "posted"), "known-candidates")
    posted = known.where("posted").groupBy("parent_id").agg(F.count(F.lit(1)).alias("posters"))
    met = materialise(own.join(facts.about.select("*", every), ["user_id", "_s"]).select("parent_id", "user_id", "topic", "n", "hit"), "candidate-topics")
    df = met.where("hit").groupBy("parent_id", "topic").agg(F.count(F.lit(1)).alias("t")).join(posted, "parent_id")
    df = df.select("parent_id", "topic", F.log10(F.col("t") / F.col("posters")).alias("f"))
    tf = F.col("n").cast("double") if kind != "boolean" else F.lit(1.0)
    sums = met.where("n > 0").join(df, ["parent_id", "topic"]).groupBy("parent_id", "user_id").agg(F.sum(tf * F.col("f")).alias("s"))
    totals = known.groupBy("parent_id").agg(F.sum("times").alias("n_all"))
    out = known.join(totals, "parent_id").join(sums, ["parent_id", "user_id"], "left")
    s = F.coalesce("s", F.lit(0.0))
    if kind == "augmented":
        out = out.join(df.groupBy("parent_id").agg(F.sum("f").alias("every_f")), "parent_id", "left")
        s = F.when(F.col("most").isNotNull(), 0.5 * F.coalesce("every_f", F.lit(0.0)) + 0.5 * s / F.col("most")).otherwise(0.0)
    return out.select("parent_id", "user_id", "times", F.round(s / F.col("n_all"), 12).alias("score"))


def top_by_parent(scores: DataFrame, share: float) -> DataFrame:
    """``parent_id, user_id``: candidates at or above the percentile of their parent's scores, each as often as it was named."""
    cuts = scores.groupBy("parent_id").agg(F.percentile("score", share, F.col("times")).alias("cut"))
    return scores.join(cuts, "parent_id").where("score >= cut").select("parent_id", "user_id")


def tfidf_terms(text: Column) -> Column:
    """Words of two characters or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def cosine_to_query(documents: DataFrame, query: DataFrame, key: str, text: str) -> DataFrame:
    """``key, cosine``: TF-IDF cosine between each document and the query documents taken as one.

    Rows of one key form one document. The query is a document of the corpus too: idf is
    ln((1 + n) / (1 + df)) + 1 over n documents with it, tf is the raw count. Blank documents are
    left out; those that share no word with the query score 0.
    """
    words = lambda d, k: d.where(F.trim(text) != "").select(k.alias("k"), F.explode(tfidf_terms(F.col(text))).alias("w"))
    tf = words(documents, F.col(key)).groupBy("k", "w").agg(F.count(F.lit(1)).alias("tf"))
    q = words(query, F.lit(0)).groupBy("w").agg(F.count(F.lit(1)).alias("qtf"))
    n = documents.where(F.trim(text) != "").agg((F.count_distinct(key) + 1).alias("n"))
    seen = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = (
        seen.join(q, "w", "full")
        .select("w", "qtf", (F.log((1 + n.scalar()) / (1 + F.coalesce("df", F.lit(0)) + F.when(F.col("qtf").isNotNull(), 1).otherwise(0))) + 1).alias("idf"))
    )
    q_norm = idf.agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("qn"))
    weighted = tf.join(idf, "w").groupBy("k").agg(
        F.sum(F.coalesce(F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf"), F.lit(0.0))).alias("dot"),
        F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("dn"),
    )
    return weighted.select(F.col("k").alias(key), F.coalesce(F.col("dot") / (F.col("dn") * q_norm.scalar()), F.lit(0.0)).alias("cosine"))


def most_similar(documents: DataFrame, query: DataFrame, key: str, text: str, share: float = 0.8) -> DataFrame:
    """Documents at or above the ``share`` percentile of similarity to the query."""
    cosine = cosine_to_query(documents, query, key, text)
    return keep_top(materialise(cosine.withColumn("cosine", F.round("cosine", 12)), "cosine"), share, "cosine")
