"""Queries over scores, samples, language models, connectors and streams, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import rules
from rookery.functions.labels import named_language
from rookery.operators import language_id as lid
from rookery.operators import scoring as sc
from rookery.plans import sampling as smp
from rookery.plans.graph_queries import PROFILES_SQL, posts, profiles
from rookery.plans.text_queries import RECORDS_SQL, records, sql_text
from rookery.session import materialise, table, work_path
from rookery.sources import connectors as api
from rookery.sources import messages, sinks
from rookery.streaming.live_language import run_stream

START, END = "2024-02-01 00:00:00+00:00", "2024-04-30 23:59:59+00:00"
_WIN = f"created_at BETWEEN TIMESTAMPTZ '{START}' AND TIMESTAMPTZ '{END}'"
POSTS_SQL = "t AS (SELECT DISTINCT ON (tweet_id) * FROM tweets WHERE tweet_id IS NOT NULL)"


def _window(spark: SparkSession, d: str) -> DataFrame:
    return sc.in_window(posts(spark, d), START, END)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The three smallest user ids."""
    return table(spark, d, "users").where("user_id IS NOT NULL").select("user_id").distinct().orderBy("user_id").limit(3)


_SEEDS = "seeds AS (SELECT DISTINCT user_id FROM users WHERE user_id IS NOT NULL ORDER BY 1 LIMIT 3)"
_STOP = "[" + ", ".join(sql_text(w) for w in rules.STOP_WORDS) + "]"
_CLEAN = (
    f"list_filter(list_transform(string_split(tweet, ' '), lambda w: CASE WHEN contains(w, 'http:') OR contains(w, 'https:') THEN w ELSE lower(translate(w, {sql_text(rules.ASCII_PUNCTUATION)}, '')) END), "
    f"lambda w: contains(w, 'http:') OR contains(w, 'https:') OR (w <> '' AND NOT list_contains({_STOP}, w)))"
)
_COUNTS = f"{POSTS_SQL}, wc AS (SELECT user_id, u.w AS word, count(*) AS n FROM t, unnest({_CLEAN}) AS u(w) WHERE user_id IS NOT NULL AND {_WIN} GROUP BY 1, 2)"
# whole words in any case by the rule itself: neither a letter nor a digit nor a low line before and after
_WHOLE = "CASE WHEN contains(lower(coalesce(tweet, '')), lower(topic)) THEN regexp_matches(tweet, '(?i)(^|[^\\p{L}\\p{N}_])' || regexp_escape(topic) || '($|[^\\p{L}\\p{N}_])') ELSE false END"
_HITS = f"""hits AS MATERIALIZED (SELECT DISTINCT t.tweet_id, t.user_id, topic FROM t JOIN topics ON topic <> '' AND CASE WHEN contains(topic, 'http')
  THEN contains(coalesce(tweet, ''), topic) OR list_contains(url_entities, topic)
  ELSE {_WHOLE} OR list_contains(list_transform(hashtag_entities, lambda h: lower(h)), lower(topic)) END)"""


def sc_documents(spark: SparkSession, d: str) -> DataFrame:
    return sc.word_documents(_window(spark, d)).select("user_id", "part", F.array_join("words", " ").alias("document"))


def sc_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return sc.word_counts(_window(spark, d))


def _tf(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        terms = table(spark, d, "topics").select(F.col("topic").alias("term"))
        return sc.term_frequency(sc.word_counts(_window(spark, d)), terms, kind).select("user_id", "term", F.round("tf", 6).alias("tf"))

    return run


def sc_topic_hits(spark: SparkSession, d: str) -> DataFrame:
    return sc.topic_hits(posts(spark, d), table(spark, d, "topics"))


def sc_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    df = sc.document_frequency(_window(spark, d), table(spark, d, "topics"))
    return df.select("topic", F.round("document_frequency", 6).alias("document_frequency"))


def sc_candid(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the friends and followers of the user with the smallest id, and who is kept."""
    parent = table(spark, d, "users").agg(F.min("user_id")).first()[0]
    scores = smp.candid_scores(profiles(spark, d), posts(spark, d), table(spark, d, "topics"), parent, START, END)
    return scores.select("user_id", F.round("score", 6).alias("score"), "expand")


def sc_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every source's documents to the English bios'."""
    docs = table(spark, d, "documents")
    cosine = sc.cosine_to_query(docs.where("source NOT LIKE 'bio%'"), docs.where("source LIKE 'bio%' AND lang = 'en'"), "source", "text")
    return cosine.select("source", F.round("cosine", 6).alias("cosine"))


def sc_top_users(spark: SparkSession, d: str) -> DataFrame:
    """Users at or above the 80th percentile of favourites."""
    sums = posts(spark, d).groupBy("user_id").agg(F.sum("favorite_count").cast("double").alias("score"))
    return sc.keep_top(sums, 0.8)


def smp_breadth_first(spark: SparkSession, d: str) -> DataFrame:
    """The default number of hops, with every id of all four sources."""
    limits = smp.HopLimits(friends=smp.EVERY, followers=smp.EVERY, mentions=smp.EVERY, replies=smp.EVERY)
    tweets = materialise(posts(spark, d).select("user_id", "user_mentions", "in_reply_to_user_id"), "posts")
    return smp.breadth_first(profiles(spark, d), tweets, _seeds(spark, d), limits)


def smp_growth(spark: SparkSession, d: str) -> DataFrame:
    """Users by hop and source, from the seeds."""
    growth, users, tweets = smp.Growth(), profiles(spark, d), posts(spark, d)
    for name in ("friends", "followers", "mentions", "replies"):
        growth.add(1, name, smp.next_frontier(users, tweets, _seeds(spark, d), smp.HopLimits(**{name: smp.EVERY})))
    return growth.table()


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with a decision by hop: undecided, expand, reject."""
    state = F.when(F.col("khop") == 1, F.lit(True)).when(F.col("khop") == 2, F.lit(False))
    return profiles(spark, d).select("user_id", "khop", "friends_count", "followers_count", state.alias("expand_user"), F.lit(None).cast("boolean").alias("timeline_is_relevant"))


_STATES = f"{PROFILES_SQL}, s AS (SELECT user_id, khop, friends_count, followers_count, CASE WHEN khop = 1 THEN true WHEN khop = 2 THEN false END AS expand_user FROM v)"


def smp_degree_rule(spark: SparkSession, d: str) -> DataFrame:
    return smp.degree_rule(_states(spark, d)).select("user_id", "expand_user")


def smp_timeline_filter(spark: SparkSession, d: str) -> DataFrame:
    return smp.filter_by_timeline(_states(spark, d), posts(spark, d), table(spark, d, "topics"), START, END).select("user_id", "expand_user", "has_timeline_filter")


def smp_timeline_state(spark: SparkSession, d: str) -> DataFrame:
    return smp.timeline_state(_states(spark, d), posts(spark, d)).select("user_id", "has_timeline", "timeline_is_relevant")


def smp_state_partition(spark: SparkSession, d: str) -> DataFrame:
    asked = posts(spark, d).select(F.explode("user_mentions").alias("user_id"))
    return smp.state_partition(asked, _states(spark, d))


def smp_lost(spark: SparkSession, d: str) -> DataFrame:
    asked = posts(spark, d).select(F.explode("user_mentions").alias("user_id"))
    gone = table(spark, d, "lost_profiles").select("user_id")  # asked for as well, and never there
    return smp.lost_profiles(asked.unionByName(gone), profiles(spark, d))


def smp_hashtags(spark: SparkSession, d: str) -> DataFrame:
    return smp.harvest_hashtags(_window(spark, d), _seeds(spark, d))


def smp_topics(spark: SparkSession, d: str) -> DataFrame:
    return smp.harvest_topics(posts(spark, d), table(spark, d, "topics"), 1)


def smp_overlap(spark: SparkSession, d: str) -> DataFrame:
    return smp.hashtag_overlap(posts(spark, d), profiles(spark, d), table(spark, d, "topics"))


def smp_causal_hop(spark: SparkSession, d: str) -> DataFrame:
    seeds = profiles(spark, d).where("khop = 1").select("user_id")
    return smp.causal_hop(profiles(spark, d), posts(spark, d), table(spark, d, "topics"), seeds, START, END)


def smp_causal(spark: SparkSession, d: str) -> DataFrame:
    seeds = profiles(spark, d).where("khop = 1").select("user_id")
    return smp.causal_search(profiles(spark, d), posts(spark, d), table(spark, d, "topics"), seeds, START, END)


def smp_cascade_hop(spark: SparkSession, d: str) -> DataFrame:
    return smp.cascade_hop(profiles(spark, d), posts(spark, d), _seeds(spark, d), START, END, 0)


def smp_cascade(spark: SparkSession, d: str) -> DataFrame:
    return smp.cascade_search(profiles(spark, d), posts(spark, d), _seeds(spark, d), START, END)


LANGS = ["de", "en", "es", "fr", "pt", "ru"]


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label names one of six languages, in any spelling; the collection channel is the domain."""
    docs = table(spark, d, "documents").withColumn("l", named_language(F.col("lang")))
    return lid.corpus(docs, "doc_id", "text", "l", "source", LANGS)


_FIRST_WORD = "regexp_extract(lower(trim({x}, ' ')), '^([^\\s_.,;()/-]+)', 1)"
_NAMED = (
    "CASE WHEN {w} IN ('en', 'eng', 'english') THEN 'en' WHEN {w} IN ('es', 'spa', 'spanish', 'español', 'espanol', 'castellano') THEN 'es' WHEN {w} IN ('pt', 'por', 'portuguese', 'português', 'portugues') THEN 'pt' "
    "WHEN {w} IN ('de', 'deu', 'ger', 'german', 'deutsch') THEN 'de' WHEN {w} IN ('fr', 'fra', 'fre', 'french', 'français', 'francais') THEN 'fr' WHEN {w} IN ('ru', 'rus', 'russian', 'русский') THEN 'ru' END"
)


def _named_sql(column: str) -> str:
    return _NAMED.format(w=_FIRST_WORD.format(x=column))


_CORPUS = f"c AS (SELECT doc_id, {_named_sql('lang')} AS l, source AS dom, hex(text) AS hx, text FROM documents WHERE text <> '' AND source IS NOT NULL AND {_named_sql('lang')} IS NOT NULL)"
_GRAMS = "g AS (" + " UNION ALL ".join(f"SELECT doc_id, l, dom, substr(hx, CAST(2 * u.i + 1 AS INTEGER), {2 * k}) AS term FROM c, unnest(range(0, greatest(CAST(length(hx) / 2 AS INTEGER) - {k - 1}, 0))) AS u(i)" for k in (1, 2, 3, 4)) + ")"
_DF = f"{_CORPUS}, {_GRAMS}, df AS (SELECT term, l AS lang, dom AS domain, count(DISTINCT doc_id) AS n FROM g WHERE doc_id IN (SELECT doc_id FROM c WHERE length(hx) >= 6) GROUP BY 1, 2, 3)"


def lid_df(spark: SparkSession, d: str) -> DataFrame:
    return lid.document_frequencies(_corpus(spark, d))


def lid_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return lid.top_terms(lid_df(spark, d))


def lid_word_df(spark: SparkSession, d: str) -> DataFrame:
    return lid.word_frequencies(_corpus(spark, d))


def lid_min_domain(spark: SparkSession, d: str) -> DataFrame:
    return lid.min_domain(_corpus(spark, d), 20).groupBy("lang", "domain").agg(F.count(F.lit(1)).alias("n"))


def _gains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = _corpus(spark, d)
    df = materialise(lid.document_frequencies(rows), "df")
    kept = materialise(df.join(lid.top_terms(df), "term", "left_semi"), "kept")
    size = {by: {r[by]: r["count"] for r in rows.groupBy(by).count().collect()} for by in ("lang", "domain")}
    return rows, kept, lid.information_gain(kept, size["lang"], "lang", True), lid.information_gain(kept, size["domain"], "domain", False)


def lid_gain_lang(spark: SparkSession, d: str) -> DataFrame:
    return _gains(spark, d)[2].select("term", "event", F.round("ig", 6).alias("ig"))


def lid_gain_domain(spark: SparkSession, d: str) -> DataFrame:
    return _gains(spark, d)[3].select("term", F.round("ig", 6).alias("ig"))


def lid_selected(spark: SparkSession, d: str) -> DataFrame:
    _, _, lang, domain = _gains(spark, d)
    return lid.select_features(lid.ld_weights(lang, domain)).select("lang", "term")


def _ptc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    rows, kept, lang, domain = _gains(spark, d)
    features = materialise(lid.select_features(lid.ld_weights(lang, domain)).select(F.col("term").alias("feature")).distinct(), "features")
    names = [r["feature"] for r in features.collect()]  # at most 300 for each language
    return lid.naive_bayes(lid.feature_counts(rows, names), features, LANGS), features, kept, lang, domain


def lid_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return _ptc(spark, d)[0].select("feature", "lang", F.round("ptc", 6).alias("ptc"))


def lid_pair_weights(spark: SparkSession, d: str) -> DataFrame:
    return lid.pair_weights(_ptc(spark, d)[0], "es", "pt").select("feature", F.round("weight", 6).alias("weight"))


def lid_feature_table(spark: SparkSession, d: str) -> DataFrame:
    ptc, features, kept, lang, domain = _ptc(spark, d)
    wide = lid.feature_table(features, kept, lang, domain, ptc, LANGS)
    return wide.select("term", "len", "df", F.round("ig_domain", 6).alias("ig_domain"), *(F.round(f"{k}_{x}", 6).alias(f"{k}_{x}") for k in ("ig", "ptc") for x in LANGS))


def src_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of features written as CSV, and read again."""
    folder = work_path(spark, "weights")
    sinks.write_weights(lid_pair_weights(spark, d), folder, "feature", "weight")
    return messages.read_weights(spark, folder).select(F.col("term").alias("feature"), F.col("weights")[0].alias("weight"))


def src_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents written as one file each, by domain and language, and read again as bytes."""
    folder = work_path(spark, "corpus-files")
    texts = _corpus(spark, d).select(F.decode("bytes", "utf-8").alias("value"), "domain", "lang")
    texts.write.partitionBy("domain", "lang").option("maxRecordsPerFile", 1).text(folder)
    read = messages.read_corpus(spark, folder)
    return read.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bytes")).alias("n_bytes"))


def lid_top_total(spark: SparkSession, d: str) -> DataFrame:
    """The thousand n-grams of most documents, whatever their order."""
    return lid.top_terms(lid_df(spark, d), total=1_000)


def lid_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every topic in each document: features longer than four bytes, by the automaton."""
    topics = table(spark, d, "topics").where("topic <> ''").select(F.hex(F.encode("topic", "utf-8")).alias("f")).distinct()
    names = [r["f"] for r in topics.orderBy("f").collect()]  # the table of topics has 63 rows
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("bytes"))
    return lid.scan(docs, "doc_id", names).select("doc_id", F.decode(F.unhex("feature"), "utf-8").alias("topic"), "n")


def lid_classified(spark: SparkSession, d: str) -> DataFrame:
    """Best language of each post, by a model trained on the documents."""
    model = lid.train(_corpus(spark, d))
    rows = records(spark, d).select("tweet_id", F.encode("msg", "utf-8").alias("bytes"))
    ranked = lid.classify(rows, ["tweet_id"], model)
    return lid.message_language(ranked, records(spark, d), "tweet_id", "msg")


_TOP = f"{_DF}, s AS (SELECT term, sum(n) AS n FROM df GROUP BY 1), top AS (SELECT term, n FROM (SELECT term, n, row_number() OVER (PARTITION BY length(term) ORDER BY n DESC, term) AS k FROM s) WHERE k <= 15000), kept AS (SELECT df.* FROM df JOIN top USING (term))"
_H = "CASE WHEN {x} > 0 THEN -{x} * ln({x}) ELSE 0 END"
_GAIN_LANG = f"""{_TOP}, sz AS (SELECT l AS event, CAST(count(*) AS DOUBLE) AS ne FROM c GROUP BY 1), tot AS (SELECT sum(ne) AS nn FROM sz),
ct AS (SELECT top.term, event, ne, nn, CAST(top.n AS DOUBLE) AS cn, CAST(coalesce((SELECT sum(k.n) FROM kept k WHERE k.term = top.term AND k.lang = sz.event), 0) AS DOUBLE) AS ce FROM top, sz, tot),
gl AS (SELECT term, event,
  ({_H.format(x='(ne / nn)')}) + ({_H.format(x='((nn - ne) / nn)')})
  - cn / nn * (({_H.format(x='(ce / cn)')}) + ({_H.format(x='((cn - ce) / cn)')}))
  - (nn - cn) / nn * (CASE WHEN nn > cn THEN ({_H.format(x='((ne - ce) / nullif(nn - cn, 0))')}) + ({_H.format(x='(((nn - ne) - (cn - ce)) / nullif(nn - cn, 0))')}) ELSE 0 END) AS ig FROM ct)"""
_GAIN_DOMAIN = f"""{_GAIN_LANG}, szd AS (SELECT dom AS event, CAST(count(*) AS DOUBLE) AS ne FROM c GROUP BY 1),
cd AS (SELECT top.term, ne, nn, CAST(top.n AS DOUBLE) AS cn, CAST(coalesce(x.n, 0) AS DOUBLE) AS ce FROM top CROSS JOIN szd CROSS JOIN tot LEFT JOIN (SELECT term, domain, sum(n) AS n FROM kept GROUP BY 1, 2) x ON x.term = top.term AND x.domain = szd.event),
gd AS (SELECT term, sum({_H.format(x='(ne / nn)')}) - any_value(cn / nn) * sum({_H.format(x='(ce / cn)')}) - any_value((nn - cn) / nn) * sum(CASE WHEN nn > cn THEN {_H.format(x='((ne - ce) / nullif(nn - cn, 0))')} ELSE 0 END) AS ig FROM cd GROUP BY 1)"""
_SELECTED = f"{_GAIN_DOMAIN}, ld AS (SELECT gl.term, event AS lang, gl.ig - gd.ig AS w FROM gl JOIN gd USING (term)), sel AS (SELECT lang, term FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(w, 9) DESC, term) AS k FROM ld) WHERE k <= 300)"
_PTC = f"""{_SELECTED}, fs AS (SELECT DISTINCT term AS feature FROM sel), fc AS (SELECT term AS feature, l AS lang, count(*) AS n FROM g WHERE term IN (SELECT feature FROM fs) GROUP BY 1, 2),
dn AS (SELECT feature, event AS lang, coalesce(n, 0) AS n FROM fs CROSS JOIN sz LEFT JOIN fc USING (feature) WHERE fc.lang IS NULL OR fc.lang = event UNION SELECT feature, event, 0 FROM fs CROSS JOIN sz WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.feature = fs.feature AND fc.lang = sz.event)),
ptc AS (SELECT feature, lang, ln(1.0 + n) - ln(CAST(sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang) AS DOUBLE)) AS ptc FROM dn)"""


def api_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of everyone who is mentioned, and of the screen names of lost profiles and authors of replies."""
    users, tweets = profiles(spark, d), posts(spark, d)
    names = table(spark, d, "lost_profiles").select("screen_name").unionByName(users.join(tweets.where("in_reply_to_user_id IS NOT NULL").select("user_id"), "user_id", "left_semi").select(F.upper("screen_name").alias("screen_name")))
    ids = tweets.select(F.explode("user_mentions").alias("user_id"))
    return api.lookup_users(users, names, ids).select("user_id", "screen_name")


def api_friends(spark: SparkSession, d: str) -> DataFrame:
    return api.list_ids(profiles(spark, d), "friends_list", api.IDS_PER_PAGE)


def api_followers(spark: SparkSession, d: str) -> DataFrame:
    return api.list_ids(profiles(spark, d), "followers_list", api.IDS_PER_PAGE)


def api_friend_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of everyone whom a stored user lists as a friend."""
    users = profiles(spark, d)
    return api.list_profiles(users, users, "friends_list").select("user_id", "screen_name")


def api_place(spark: SparkSession, d: str) -> DataFrame:
    return api.lookup_place(table(spark, d, "places"), 7).select("place_id", "place_full_name", "country", "place_type")


def api_follower_profiles(spark: SparkSession, d: str) -> DataFrame:
    users = profiles(spark, d)
    return api.list_profiles(users, _seeds(spark, d).join(users, "user_id"), "followers_list", 100).select("user_id", "screen_name")


def api_timeline(spark: SparkSession, d: str) -> DataFrame:
    tweets = posts(spark, d)
    busiest = tweets.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()[0]
    return api.timeline(tweets, busiest, START, replies=False, reposts=False).select("tweet_id")


def api_tweets(spark: SparkSession, d: str) -> DataFrame:
    """Posts that others reply to; those outside the collection have nulls."""
    ids = posts(spark, d).where("in_reply_to_status_id IS NOT NULL").select(F.col("in_reply_to_status_id").alias("tweet_id"))
    return api.get_tweets(posts(spark, d), ids, True).select("tweet_id", "user_id")


def api_reposts(spark: SparkSession, d: str) -> DataFrame:
    """Reposts after the first dated post of a reposted author, with whatever text."""
    users, tweets = profiles(spark, d), posts(spark, d)
    marks = tweets.select(F.lower(F.regexp_extract("tweet", "^RT @([A-Za-z0-9_]+):", 1)).alias("n")).where("n <> ''")
    authors = users.join(marks, F.lower("screen_name") == F.col("n"), "left_semi").select("user_id")
    first = tweets.where("created_at IS NOT NULL").join(authors, "user_id", "left_semi").orderBy("created_at", "tweet_id").first()
    return api.reposts_of(tweets, users, first["tweet_id"], same_text=False).select("tweet_id")


def api_search(spark: SparkSession, d: str) -> DataFrame:
    """Popular posts with any of two words around a place, by authors whose profile names a language."""
    tweets = posts(spark, d).join(profiles(spark, d).select("user_id", F.col("profile_language").alias("lang")), "user_id", "left")
    return api.search_tweets(tweets, ["river", "boots"], exclusive=True, around=(0.0, 0.0, 15_000.0), until=END, kind="popular", lang="en").select("tweet_id")


def api_hashtag(spark: SparkSession, d: str) -> DataFrame:
    return api.search_hashtag(posts(spark, d), "#TinyLedger", 50).select("tweet_id")


def api_users(spark: SparkSession, d: str) -> DataFrame:
    return api.search_users(profiles(spark, d), ["saint", "port"], True, 200).select("user_id")


def api_nearest_places(spark: SparkSession, d: str) -> DataFrame:
    return api.reverse_geocode(table(spark, d, "places"), 10.0, 20.0, "city", 10).select("place_id", F.round("metres", 3).alias("metres"))


def api_places(spark: SparkSession, d: str) -> DataFrame:
    return api.search_places(table(spark, d, "places"), position=(9.5, -161.5)).select("place_id", "place_full_name")


def api_trend_places(spark: SparkSession, d: str) -> DataFrame:
    return api.trend_locations(table(spark, d, "tweets"))


def api_trends(spark: SparkSession, d: str) -> DataFrame:
    return api.trends(posts(spark, d))


def api_trend_words(spark: SparkSession, d: str) -> DataFrame:
    return api.trends(posts(spark, d), exclude="hashtags")


def api_entities(spark: SparkSession, d: str) -> DataFrame:
    return api.top_entities(posts(spark, d), "mention")


def sm_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Posts replayed as a stream of JSON status lines and labelled on the way."""
    folder = work_path(spark, "statuses")
    lines = records(spark, d).select(F.to_json(F.struct(F.col("msg").alias("text"), F.lit(0).alias("retweet_count"))).alias("value"))
    lines.write.text(folder)
    model = lid.train(_corpus(spark, d))
    return run_stream(spark, folder, model, work_path(spark, "labelled"), work_path(spark, "labelled-offsets"), ("en", "es", "pt"))


_D = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_ASKED = f"{POSTS_SQL}, a AS (SELECT DISTINCT u.x AS user_id FROM t, unnest(user_mentions) AS u(x) WHERE u.x IS NOT NULL)"
_COS = """d AS (SELECT source, text FROM documents WHERE source NOT LIKE 'bio%' AND trim(text) <> ''), q0 AS (SELECT text FROM documents WHERE source LIKE 'bio%' AND lang = 'en' AND trim(text) <> ''),
tf AS (SELECT source, u.w AS w, count(*) AS tf FROM d, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS u(w) GROUP BY 1, 2),
q AS (SELECT u.w AS w, count(*) AS qtf FROM q0, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS u(w) GROUP BY 1),
n AS (SELECT count(DISTINCT source) + 1 AS n FROM d), dfr AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT w, qtf, ln((1 + n) / (1.0 + coalesce(df, 0) + CASE WHEN qtf IS NOT NULL THEN 1 ELSE 0 END)) + 1 AS idf FROM dfr FULL JOIN q USING (w), n)"""
_TAGS = "SELECT DISTINCT lower(u.h) AS topic FROM t, unnest(hashtag_entities) AS u(h)"
_FF = "SELECT unnest(list_concat(coalesce(friends_list, []), coalesce(followers_list, []))) AS user_id FROM v WHERE user_id = (SELECT min(user_id) FROM users)"

_RANKED = f"""{_PTC}, {RECORDS_SQL}, mg AS (SELECT tweet_id, substr(hex(msg), CAST(2 * u.i + 1 AS INTEGER), CAST(2 * o.k AS INTEGER)) AS term FROM r, (SELECT unnest([1, 2, 3, 4]) AS k) o, unnest(range(0, greatest(strlen(msg) - o.k + 1, 0))) AS u(i)),
sc AS (SELECT tweet_id, lang AS l, sum(ptc) AS s FROM mg JOIN ptc ON feature = term GROUP BY 1, 2),
ranked AS (SELECT tweet_id, l, row_number() OVER (PARTITION BY tweet_id ORDER BY s DESC, l) AS k FROM (SELECT tweet_id, event AS l, ln(ne) + coalesce(s, 0) AS s FROM r CROSS JOIN sz LEFT JOIN sc USING (tweet_id) WHERE sc.l IS NULL OR sc.l = event
  UNION ALL SELECT r.tweet_id, event, ln(ne) FROM r CROSS JOIN sz WHERE r.tweet_id IN (SELECT tweet_id FROM sc) AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.tweet_id = r.tweet_id AND sc.l = event)))"""


def _breadth_first_sql(hops: int) -> str:
    """Hops one after the other; a user belongs to the first that reaches it."""
    parts = [PROFILES_SQL, POSTS_SQL, _SEEDS, """nb AS MATERIALIZED (SELECT DISTINCT a, x FROM (SELECT user_id AS a, unnest(list_concat(coalesce(friends_list, []), coalesce(followers_list, []))) AS x FROM v
      UNION ALL SELECT user_id, unnest(user_mentions) FROM t UNION ALL SELECT user_id, in_reply_to_user_id FROM t) WHERE a IS NOT NULL AND x IN (SELECT user_id FROM v))""", "a0 AS MATERIALIZED (SELECT user_id, 0 AS khop FROM seeds)"]
    for h in range(1, hops + 1):
        parts.append(f"a{h} AS MATERIALIZED (SELECT * FROM a{h - 1} UNION ALL SELECT DISTINCT x, {h} FROM nb JOIN a{h - 1} p ON p.user_id = nb.a AND p.khop = {h - 1} WHERE x NOT IN (SELECT user_id FROM a{h - 1}))")
    return f"WITH {', '.join(parts)} SELECT user_id, khop FROM a{hops}"


def _walk_sql(parts: list[str], seeds: str, hops: int, met: Callable[[int], list[str]], only_hop: bool) -> str:
    """A crawl hop by hop: ``met`` gives the parts that end in ``m{h}`` (user_id, source), everyone whom hop h meets; no source, no expansion."""
    parts = [*parts, f"s0 AS MATERIALIZED (SELECT user_id, 0 AS khop, user_id IN (SELECT user_id FROM ok) AS expand FROM v WHERE user_id IN ({seeds}))"]
    for h in range(1, hops + 1):
        parts.append(f"f{h} AS MATERIALIZED (SELECT user_id FROM s{h - 1} WHERE khop = {h - 1} AND expand)")
        parts += met(h)
        parts.append(f"s{h} AS MATERIALIZED (SELECT * FROM s{h - 1} UNION ALL SELECT user_id, {h}, source IS NOT NULL AND user_id IN (SELECT user_id FROM ok) FROM m{h} WHERE user_id NOT IN (SELECT user_id FROM s{h - 1}))")
    if only_hop:
        return f"WITH {', '.join(parts)} SELECT user_id, source FROM m1 WHERE source IS NOT NULL AND user_id IN (SELECT user_id FROM ok)"
    return f"WITH {', '.join(parts)} SELECT user_id, khop FROM s{hops} WHERE expand"


_IN_WINDOW = f"t AS MATERIALIZED (SELECT DISTINCT ON (tweet_id) * FROM tweets WHERE tweet_id IS NOT NULL AND user_id IS NOT NULL AND {_WIN})"


def _listed_sql(limit: int) -> str:
    return f"ff AS MATERIALIZED (SELECT user_id AS parent, unnest(list_concat(coalesce(friends_list[1:{limit}], []), coalesce(followers_list[1:{limit}], []))) AS x FROM v)"


def _causal_sql(hops: int, only_hop: bool) -> str:
    parts = [
        PROFILES_SQL, _IN_WINDOW, _HITS, _listed_sql(100), "hu AS MATERIALIZED (SELECT DISTINCT user_id, topic FROM hits)",
        "ok AS MATERIALIZED (SELECT user_id FROM v WHERE user_id NOT IN (SELECT user_id FROM t) OR user_id IN (SELECT user_id FROM hu))",
        f"tf AS MATERIALIZED (SELECT user_id, u.w AS topic, count(*) AS n FROM t, unnest({_CLEAN}) AS u(w) WHERE u.w IN (SELECT topic FROM topics) GROUP BY 1, 2)",
        "mp AS MATERIALIZED (SELECT DISTINCT user_id AS a, unnest(user_mentions) AS x FROM t)",
    ]

    def met(h: int) -> list[str]:
        return [
            f"c{h} AS MATERIALIZED (SELECT parent, x, count(*) AS m FROM ff WHERE parent IN (SELECT user_id FROM f{h}) AND x IS NOT NULL GROUP BY 1, 2)",
            f"p{h} AS (SELECT parent, count(*) AS n FROM c{h} WHERE x IN (SELECT user_id FROM t) GROUP BY 1)",
            f"d{h} AS (SELECT parent, topic, log10(count(*) / CAST(any_value(n) AS DOUBLE)) AS f FROM c{h} JOIN hu ON hu.user_id = x JOIN p{h} USING (parent) GROUP BY 1, 2)",
            f"w{h} AS (SELECT parent, x, sum(n * f) AS s FROM c{h} JOIN tf ON tf.user_id = x JOIN d{h} USING (parent, topic) GROUP BY 1, 2)",
            f"z{h} AS MATERIALIZED (SELECT parent, x, m, round(coalesce(s, 0) / sum(m) OVER (PARTITION BY parent), 12) AS score FROM c{h} LEFT JOIN w{h} USING (parent, x))",
            f"k{h} AS (SELECT parent, quantile_cont(score, 0.05) AS cut FROM z{h}, unnest(range(m)) AS u(i) GROUP BY 1)",
            f"m{h} AS MATERIALIZED (SELECT user_id, min(source) AS source FROM (SELECT x AS user_id, 'mention' AS source FROM mp WHERE a IN (SELECT user_id FROM f{h}) UNION ALL SELECT x, CASE WHEN score >= cut THEN 'score' END FROM z{h} JOIN k{h} USING (parent)) WHERE user_id IN (SELECT user_id FROM v) GROUP BY 1)",
        ]

    return _walk_sql(parts, "SELECT user_id FROM v WHERE khop = 1", hops, met, only_hop)


def _cascade_sql(hops: int, only_hop: bool) -> str:
    parts = [
        PROFILES_SQL, _IN_WINDOW, _SEEDS, _listed_sql(1_000), "ok AS MATERIALIZED (SELECT user_id FROM v WHERE NOT coalesce(friends_count + followers_count > 1000, false))",
        "tags AS (SELECT DISTINCT lower(u.h) AS topic FROM t, unnest(hashtag_entities) AS u(h) WHERE user_id IN (SELECT user_id FROM seeds) AND user_id IN (SELECT user_id FROM ok) AND u.h <> '')",
        "wd AS MATERIALIZED (SELECT user_id, u.w AS w, count(*) AS tf FROM t, unnest(regexp_extract_all(lower(tweet), '[\\p{L}\\p{N}_]{2,}')) AS u(w) WHERE trim(tweet, ' ') <> '' GROUP BY 1, 2)",
        "blank AS (SELECT DISTINCT user_id FROM t WHERE trim(tweet, ' ') <> '')",
    ]

    def met(h: int) -> list[str]:
        out = [
            f"c{h} AS MATERIALIZED (SELECT DISTINCT x AS user_id FROM ff WHERE parent IN (SELECT user_id FROM f{h}) AND x IN (SELECT user_id FROM ok))",
            f"q{h} AS (SELECT w, sum(tf) AS qtf FROM wd WHERE user_id IN (SELECT user_id FROM f{h}) GROUP BY 1)",
            f"x{h} AS MATERIALIZED (SELECT * FROM wd WHERE user_id IN (SELECT user_id FROM c{h}))",
            f"n{h} AS (SELECT count(*) + 1 AS n FROM blank WHERE user_id IN (SELECT user_id FROM c{h}))",
            f"i{h} AS MATERIALIZED (SELECT w, qtf, ln((1 + n) / (1.0 + coalesce(df, 0) + CASE WHEN qtf IS NOT NULL THEN 1 ELSE 0 END)) + 1 AS idf FROM (SELECT w, count(*) AS df FROM x{h} GROUP BY 1) FULL JOIN q{h} USING (w), n{h})",
            f"z{h} AS MATERIALIZED (SELECT user_id, round(coalesce(sum(coalesce(tf * idf * qtf * idf, 0)) / (sqrt(sum(pow(tf * idf, 2))) * (SELECT sqrt(sum(pow(qtf * idf, 2))) FROM i{h})), 0), 12) AS score FROM x{h} JOIN i{h} USING (w) GROUP BY 1)",
            f"y{h} AS MATERIALIZED (SELECT user_id FROM z{h} WHERE score >= (SELECT quantile_cont(score, 0.8) FROM z{h}))",
        ]
        tagged = f" UNION ALL SELECT DISTINCT user_id, 'hashtag' FROM t, unnest(hashtag_entities) AS u(h) WHERE user_id IN (SELECT user_id FROM c{h}) AND user_id NOT IN (SELECT user_id FROM y{h}) AND lower(u.h) IN (SELECT topic FROM tags)"
        out.append(f"m{h} AS MATERIALIZED (SELECT user_id, min(source) AS source FROM (SELECT unnest(user_mentions) AS user_id, 'mention' AS source FROM t WHERE user_id IN (SELECT user_id FROM f{h}) UNION ALL SELECT user_id, 'similar' FROM y{h}{tagged if h > 1 else ''} UNION ALL SELECT user_id, NULL FROM c{h}) WHERE user_id IN (SELECT user_id FROM ok) GROUP BY 1)")
        return out

    return _walk_sql(parts, "SELECT user_id FROM seeds", hops, met, only_hop)


QUERIES = {
    "sc_documents": (sc_documents, f"WITH {POSTS_SQL}, o AS (SELECT user_id, tweet_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY tweet_id) - 1) / 5000) AS INTEGER) AS part, {_CLEAN} AS l FROM t WHERE user_id IS NOT NULL AND tweet IS NOT NULL AND {_WIN}), x AS (SELECT user_id, part, list(l ORDER BY tweet_id) AS p FROM o GROUP BY 1, 2) SELECT user_id, part, coalesce(array_to_string(flatten(p), ' '), '') AS document FROM x"),
    "sc_word_counts": (sc_word_counts, f"WITH {_COUNTS} SELECT user_id, word, n FROM wc"),
    "sc_tf_raw": (_tf("raw"), f"WITH {_COUNTS} SELECT user_id, topic AS term, CAST(n AS DOUBLE) AS tf FROM wc JOIN topics ON word = topic"),
    "sc_tf_boolean": (_tf("boolean"), f"WITH {_COUNTS} SELECT user_id, topic AS term, CAST(1 AS DOUBLE) AS tf FROM wc JOIN topics ON word = topic"),
    "sc_tf_augmented": (_tf("augmented"), f"WITH {_COUNTS}, m AS (SELECT user_id, max(n) AS most FROM wc GROUP BY 1) SELECT m.user_id, topic AS term, round(0.5 + 0.5 * coalesce(n, 0) / most, 6) AS tf FROM m CROSS JOIN (SELECT DISTINCT topic FROM topics) LEFT JOIN wc ON wc.user_id = m.user_id AND word = topic"),
    "sc_topic_hits": (sc_topic_hits, f"WITH {POSTS_SQL}, {_HITS} SELECT tweet_id, user_id, topic FROM hits"),
    "sc_document_frequency": (sc_document_frequency, f"WITH t AS (SELECT DISTINCT ON (tweet_id) * FROM tweets WHERE tweet_id IS NOT NULL AND {_WIN}), {_HITS}, h AS (SELECT topic, count(DISTINCT user_id) AS k FROM hits GROUP BY 1) SELECT topics.topic, round(coalesce(log10(k / (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM t)), 0), 6) AS document_frequency FROM topics LEFT JOIN h USING (topic)"),
    "sc_candid": (sc_candid, f"""WITH {PROFILES_SQL}, ff AS ({_FF}), t AS (SELECT DISTINCT ON (tweet_id) * FROM tweets WHERE tweet_id IS NOT NULL AND {_WIN} AND user_id IN (SELECT user_id FROM ff)), {_HITS},
      h AS (SELECT topic, count(DISTINCT user_id) AS k FROM hits GROUP BY 1), df AS (SELECT topic, log10(k / (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM t)) AS f FROM h),
      wc AS (SELECT user_id, u.w AS word, count(*) AS n FROM t, unnest({_CLEAN}) AS u(w) GROUP BY 1, 2), s AS (SELECT user_id, sum(n * f) AS s FROM wc JOIN df ON word = topic GROUP BY 1),
      z AS (SELECT DISTINCT ff.user_id, coalesce(s, 0) / (SELECT count(*) FROM ff) AS score FROM ff LEFT JOIN s USING (user_id) WHERE ff.user_id IS NOT NULL)
      SELECT user_id, round(score, 6) AS score, score >= (SELECT quantile_cont(score, 0.5) FROM z) AS expand FROM z"""),
    "sc_cosine": (sc_cosine, f"WITH {_COS} SELECT source, round(sum(coalesce(tf * idf * qtf * idf, 0)) / (sqrt(sum(pow(tf * idf, 2))) * (SELECT sqrt(sum(pow(qtf * idf, 2))) FROM idf)), 6) AS cosine FROM tf JOIN idf USING (w) GROUP BY 1"),
    "sc_top_users": (sc_top_users, f"WITH {POSTS_SQL}, s AS (SELECT user_id, CAST(sum(favorite_count) AS DOUBLE) AS score FROM t GROUP BY 1) SELECT user_id, score FROM s WHERE score >= (SELECT quantile_cont(score, 0.8) FROM s)"),
    "smp_breadth_first": (smp_breadth_first, _breadth_first_sql(6)),
    "smp_growth": (smp_growth, f"WITH {PROFILES_SQL}, {POSTS_SQL}, {_SEEDS}, p AS (SELECT v.* FROM v JOIN seeds USING (user_id)), q AS (SELECT t.* FROM t JOIN seeds USING (user_id)) SELECT DISTINCT 1 AS hop, set_name, user_id FROM (SELECT 'friends' AS set_name, unnest(friends_list) AS user_id FROM p UNION ALL SELECT 'followers', unnest(followers_list) FROM p UNION ALL SELECT 'mentions', unnest(user_mentions) FROM q UNION ALL SELECT 'replies', in_reply_to_user_id FROM q) WHERE user_id IS NOT NULL"),
    "smp_degree_rule": (smp_degree_rule, f"WITH {_STATES} SELECT user_id, CASE WHEN expand_user IS NULL AND friends_count + followers_count > 1000 THEN false ELSE expand_user END AS expand_user FROM s"),
    "smp_timeline_filter": (smp_timeline_filter, f"WITH {_STATES}, t AS (SELECT DISTINCT ON (tweet_id) * FROM tweets WHERE tweet_id IS NOT NULL AND {_WIN}), {_HITS}, z AS (SELECT user_id, expand_user, expand_user IS NULL AND user_id IN (SELECT user_id FROM t WHERE user_id IS NOT NULL) AS tested FROM s) SELECT user_id, CASE WHEN tested AND user_id NOT IN (SELECT user_id FROM hits WHERE user_id IS NOT NULL) THEN false ELSE expand_user END AS expand_user, CASE WHEN tested THEN true END AS has_timeline_filter FROM z"),
    "smp_timeline_state": (smp_timeline_state, f"WITH {_STATES} SELECT user_id, user_id IN (SELECT user_id FROM tweets WHERE user_id IS NOT NULL) AS has_timeline, CASE WHEN user_id NOT IN (SELECT user_id FROM tweets WHERE user_id IS NOT NULL) THEN false END AS timeline_is_relevant FROM s"),
    "smp_state_partition": (smp_state_partition, f"WITH {_STATES}, {_ASKED} SELECT a.user_id, CASE WHEN s.user_id IS NULL THEN 'missing' WHEN expand_user THEN 'expand' WHEN NOT expand_user THEN 'reject' ELSE 'undecided' END AS state FROM a LEFT JOIN s ON s.user_id = a.user_id"),
    "smp_lost": (smp_lost, f"WITH {_ASKED} SELECT user_id FROM (SELECT user_id FROM a UNION SELECT user_id FROM lost_profiles WHERE user_id IS NOT NULL) WHERE user_id NOT IN (SELECT user_id FROM users)"),
    "smp_hashtags": (smp_hashtags, f"WITH {_SEEDS}, t AS (SELECT * FROM tweets WHERE {_WIN} AND user_id IN (SELECT user_id FROM seeds)) SELECT topic FROM ({_TAGS}) WHERE topic <> ''"),
    "smp_topics": (smp_topics, f"WITH {POSTS_SQL}, {_HITS}, o AS (SELECT * FROM t WHERE tweet_id IN (SELECT tweet_id FROM hits)) SELECT DISTINCT topic, 1 AS khop FROM (SELECT lower(u.h) AS topic FROM o, unnest(hashtag_entities) AS u(h) UNION SELECT u.h FROM o, unnest(url_entities) AS u(h)) WHERE topic <> '' AND topic NOT IN (SELECT topic FROM topics)"),
    "smp_overlap": (smp_overlap, f"WITH {POSTS_SQL} SELECT DISTINCT user_id FROM t, unnest(hashtag_entities) AS u(h) WHERE lower(u.h) IN (SELECT lower(topic) FROM topics) AND user_id IN (SELECT user_id FROM users)"),
    "smp_causal_hop": (smp_causal_hop, _causal_sql(1, True)),
    "smp_causal": (smp_causal, _causal_sql(5, False)),
    "smp_cascade_hop": (smp_cascade_hop, _cascade_sql(1, True)),
    "smp_cascade": (smp_cascade, _cascade_sql(5, False)),
    "lid_df": (lid_df, f"WITH {_DF} SELECT term, lang, domain, n FROM df"),
    "lid_top_terms": (lid_top_terms, f"WITH {_TOP} SELECT term, CAST(n AS BIGINT) AS n FROM top"),
    "lid_word_df": (lid_word_df, f"WITH {_CORPUS} SELECT hex(u.w) AS term, l AS lang, dom AS domain, count(DISTINCT doc_id) AS n FROM c, unnest(string_split_regex(text, '\\s+')) AS u(w) WHERE u.w <> '' GROUP BY 1, 2, 3"),
    "lid_min_domain": (lid_min_domain, f"WITH {_CORPUS} SELECT l AS lang, dom AS domain, count(*) AS n FROM c WHERE l IN (SELECT l FROM c GROUP BY 1 HAVING count(DISTINCT dom) >= 20) GROUP BY 1, 2"),
    "lid_gain_lang": (lid_gain_lang, f"WITH {_GAIN_LANG} SELECT term, event, round(ig, 6) AS ig FROM gl"),
    "lid_gain_domain": (lid_gain_domain, f"WITH {_GAIN_DOMAIN} SELECT term, round(ig, 6) AS ig FROM gd"),
    "lid_selected": (lid_selected, f"WITH {_SELECTED} SELECT lang, term FROM sel"),
    "lid_probabilities": (lid_probabilities, f"WITH {_PTC} SELECT feature, lang, round(ptc, 6) AS ptc FROM ptc"),
    "lid_pair_weights": (lid_pair_weights, f"WITH {_PTC}, z AS (SELECT feature, lang, exp(ptc) / sum(exp(ptc)) OVER (PARTITION BY lang) AS p FROM ptc) SELECT feature, round(abs(sum(p) FILTER (WHERE lang = 'es') - sum(p) FILTER (WHERE lang = 'pt')) / sum(p), 6) AS weight FROM z GROUP BY 1"),
    "lid_feature_table": (lid_feature_table, f"WITH {_PTC} SELECT feature AS term, CAST(length(feature) / 2 AS INTEGER) AS len, CAST((SELECT n FROM top WHERE top.term = feature) AS BIGINT) AS df, round((SELECT ig FROM gd WHERE gd.term = feature), 6) AS ig_domain, " + ", ".join(f"round((SELECT ig FROM gl WHERE gl.term = feature AND event = '{x}'), 6) AS ig_{x}, round((SELECT ptc FROM ptc WHERE ptc.feature = fs.feature AND lang = '{x}'), 6) AS ptc_{x}" for x in LANGS) + " FROM fs"),
    "lid_top_total": (lid_top_total, f"WITH {_DF} SELECT term, CAST(sum(n) AS BIGINT) AS n FROM df GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 1000"),
    "lid_scanned": (lid_scanned, "WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text <> ''), k AS (SELECT DISTINCT topic, length(topic) AS n FROM topics WHERE topic <> ''), s AS (SELECT doc_id, n, substr(text, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS w FROM p, (SELECT DISTINCT n FROM k)) SELECT doc_id, topic, count(*) AS n FROM s JOIN k ON w = topic AND s.n = k.n GROUP BY 1, 2"),
    "src_weights": (src_weights, f"WITH {_PTC}, z AS (SELECT feature, lang, exp(ptc) / sum(exp(ptc)) OVER (PARTITION BY lang) AS p FROM ptc) SELECT feature, round(abs(sum(p) FILTER (WHERE lang = 'es') - sum(p) FILTER (WHERE lang = 'pt')) / sum(p), 6) AS weight FROM z GROUP BY 1"),
    "src_corpus": (src_corpus, f"WITH {_CORPUS} SELECT dom AS domain, l AS lang, count(*) AS n, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM c GROUP BY 1, 2"),
    "lid_classified": (lid_classified, f"WITH {_RANKED}, m AS (SELECT tweet_id, first(l ORDER BY k) FILTER (WHERE l IN ('en', 'es', 'pt')) AS known, first(l ORDER BY k DESC) AS last FROM ranked GROUP BY 1) SELECT r.tweet_id, CASE WHEN len(string_split(trim(regexp_replace(msg, '\\s+', ' ', 'g'), ' '), ' ')) < 5 THEN '--' ELSE coalesce(known, last) END AS lid_lui FROM r LEFT JOIN m USING (tweet_id)"),
    "api_lookup": (api_lookup, f"WITH {PROFILES_SQL}, {POSTS_SQL} SELECT user_id, screen_name FROM v WHERE user_id IN (SELECT unnest(user_mentions) FROM t) OR lower(screen_name) IN (SELECT lower(screen_name) FROM lost_profiles UNION SELECT lower(screen_name) FROM v WHERE user_id IN (SELECT user_id FROM t WHERE in_reply_to_user_id IS NOT NULL))"),
    "api_friends": (api_friends, f"WITH {PROFILES_SQL} SELECT user_id, CAST(u.i - 1 AS INTEGER) AS position, friends_list[u.i] AS id FROM v, unnest(range(1, least(coalesce(len(friends_list), 0), 5000) + 1)) AS u(i)"),
    "api_followers": (api_followers, f"WITH {PROFILES_SQL} SELECT user_id, CAST(u.i - 1 AS INTEGER) AS position, followers_list[u.i] AS id FROM v, unnest(range(1, least(coalesce(len(followers_list), 0), 5000) + 1)) AS u(i)"),
    "api_friend_profiles": (api_friend_profiles, f"WITH {PROFILES_SQL} SELECT user_id, screen_name FROM v WHERE user_id IN (SELECT unnest(friends_list) FROM v)"),
    "api_place": (api_place, "SELECT place_id, place_full_name, country, place_type FROM places WHERE place_id = 7"),
    "api_trend_words": (api_trend_words, f"WITH {POSTS_SQL} SELECT u.w AS name, count(DISTINCT tweet_id) AS n FROM t, unnest(string_split_regex(lower(tweet), '[^\\w#@]+')) AS u(w) WHERE length(u.w) > 3 AND NOT regexp_matches(u.w, '^[#@]') GROUP BY 1 ORDER BY n DESC, name LIMIT 50"),
    "api_follower_profiles": (api_follower_profiles, f"WITH {PROFILES_SQL}, {_SEEDS} SELECT user_id, screen_name FROM v WHERE user_id IN (SELECT unnest(followers_list[1:100]) FROM v JOIN seeds USING (user_id))"),
    "api_timeline": (api_timeline, f"WITH {POSTS_SQL} SELECT tweet_id FROM t WHERE user_id = (SELECT user_id FROM t GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) AND created_at >= TIMESTAMPTZ '{START}' AND in_reply_to_status_id IS NULL AND NOT starts_with(tweet, 'RT @') ORDER BY created_at DESC, tweet_id DESC LIMIT 3200"),
    "api_tweets": (api_tweets, f"WITH {POSTS_SQL} SELECT DISTINCT a.in_reply_to_status_id AS tweet_id, t.user_id FROM t a LEFT JOIN t ON t.tweet_id = a.in_reply_to_status_id WHERE a.in_reply_to_status_id IS NOT NULL"),
    "api_reposts": (api_reposts, f"WITH {PROFILES_SQL}, {POSTS_SQL}, a AS (SELECT DISTINCT user_id, lower(screen_name) AS n FROM v WHERE lower(screen_name) IN (SELECT lower(regexp_extract(tweet, '^RT @([A-Za-z0-9_]+):', 1)) FROM t)), f AS (SELECT t.user_id, created_at FROM t JOIN a USING (user_id) WHERE created_at IS NOT NULL ORDER BY created_at, tweet_id LIMIT 1) SELECT t.tweet_id FROM t, f JOIN a USING (user_id) WHERE starts_with(lower(tweet), 'rt @' || n || ':') AND t.created_at >= f.created_at ORDER BY t.created_at DESC, tweet_id DESC LIMIT 100"),
    "api_search": (api_search, f"WITH {PROFILES_SQL}, {POSTS_SQL} SELECT tweet_id FROM t JOIN v USING (user_id) WHERE {_named_sql('profile_language')} = 'en' AND (contains(lower(tweet), 'river') OR contains(lower(tweet), 'boots')) AND created_at < TIMESTAMPTZ '{END}' AND {_D.format(a='t.latitude', b='0', c='t.longitude', d='0')} <= 15000000 ORDER BY coalesce(retweet_count, 0) + coalesce(favorite_count, 0) DESC, tweet_id DESC LIMIT 100"),
    "api_hashtag": (api_hashtag, f"WITH {POSTS_SQL} SELECT tweet_id FROM t WHERE list_contains(list_transform(hashtag_entities, lambda h: lower(h)), 'tinyledger') ORDER BY created_at DESC NULLS LAST, tweet_id DESC LIMIT 50"),
    "api_users": (api_users, f"WITH {PROFILES_SQL}, z AS (SELECT user_id, lower(concat_ws(' ', user_name, screen_name, location)) AS s FROM v) SELECT user_id FROM z WHERE contains(s, 'saint') OR contains(s, 'port') ORDER BY user_id LIMIT 200"),
    "api_nearest_places": (api_nearest_places, f"WITH z AS (SELECT place_id, (south + north) / 2 AS la, ((west + (CASE WHEN west > east THEN 360.0 ELSE 0.0 END + east - west) / 2 + 180.0 + 360.0) % 360.0) - 180.0 AS lo FROM places WHERE place_type IN ('city', 'admin', 'country')) SELECT place_id, round({_D.format(a='la', b='10.0', c='lo', d='20.0')}, 3) AS metres FROM z ORDER BY {_D.format(a='la', b='10.0', c='lo', d='20.0')}, place_id LIMIT 10"),
    "api_places": (api_places, "SELECT place_id, place_full_name FROM places WHERE 9.5 BETWEEN south AND north AND CASE WHEN west > east THEN -161.5 >= west OR -161.5 <= east ELSE -161.5 BETWEEN west AND east END"),
    "api_trend_places": (api_trend_places, "SELECT DISTINCT country, place_full_name, place_type FROM tweets WHERE place_full_name IS NOT NULL"),
    "api_trends": (api_trends, f"WITH {POSTS_SQL} SELECT '#' || lower(u.h) AS name, count(DISTINCT tweet_id) AS n FROM t, unnest(hashtag_entities) AS u(h) WHERE u.h <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 50"),
    "api_entities": (api_entities, f"WITH {POSTS_SQL} SELECT DISTINCT user_id, u.x AS id FROM t, unnest(user_mentions) AS u(x) WHERE u.x IS NOT NULL AND user_id IS NOT NULL"),
    "sm_labelled": (sm_labelled, f"WITH {_RANKED} SELECT l AS lang, msg AS text FROM ranked JOIN r USING (tweet_id) WHERE k = 1 AND l IN ('en', 'es', 'pt') AND msg <> ''"),
}
