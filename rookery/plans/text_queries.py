"""Queries over messages: sources, filters, entities, normalizer stages and counts, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import entities, rules, text
from rookery.functions.geo import in_box, is_position
from rookery.operators.relational import last_by_key
from rookery.operators.scoring import days_since
from rookery.session import table, work_path
from rookery.sources import messages, sinks
from rookery.sources.connectors import is_media

BOX = (0.0, -60.0, 45.0, 60.0)


def records(spark: SparkSession, d: str) -> DataFrame:
    """``tweet_id, userid, msg, ...``: each post once, whatever the number of its deliveries."""
    return table(spark, d, "tweets").where("tweet IS NOT NULL AND tweet_id IS NOT NULL").dropDuplicates(["tweet_id"]).withColumn("userid", F.col("user_id").cast("string")).withColumnRenamed("tweet", "msg")


RECORDS_SQL = "r AS (SELECT DISTINCT ON (tweet_id) *, CAST(user_id AS VARCHAR) AS userid, tweet AS msg FROM tweets WHERE tweet IS NOT NULL AND tweet_id IS NOT NULL)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_rules(expr: str, chain: list[tuple[str, str]]) -> str:
    for pattern, to in chain:
        expr = f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(to.replace('$1', chr(92) + '1'))}, 'g')"
    return expr


def sql_transliterate(expr: str) -> str:
    for char, words in rules.SPELLED.items():
        expr = f"replace({expr}, {sql_text(char)}, {sql_text(words)})"
    expr = f"translate({expr}, {sql_text(''.join(rules.TRANSLITERATED))}, {sql_text(''.join(rules.TRANSLITERATED.values()))})"
    return sql_rules(f"regexp_replace({expr}, '[^\\x00-\\x7E]', ' ', 'g')", rules.SQUEEZE + rules.LAST_CHARACTER)


def sql_capped(expr: str) -> str:
    """Runs of equal characters cut to three, as a fold over the characters."""
    return f"list_reduce(list_prepend('', regexp_extract_all({expr}, '(?s).')), lambda a, c: CASE WHEN ends_with(a, c || c || c) THEN a ELSE a || c END)"


def _normalized_sql() -> str:
    """All stages of each sentence, in the order of the pipeline."""
    split = "msg"
    for mark, broken in rules.SENTENCE_BREAKS:
        split = f"replace({split}, {sql_text(mark)}, {sql_text(broken)})"
    own = f"SELECT tweet_id, CAST(u.i AS INTEGER) AS i, regexp_replace(l[u.i], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT tweet_id, string_split({split}, chr(10)) AS l FROM r), unnest(range(1, len(l) + 1)) AS u(i)"
    steps = [sql_transliterate("s"), *(sql_rules("s", table + rules.SQUEEZE) for table in (rules.META, rules.PUNCTUATION, rules.MARKUP)), sql_capped("s"), sql_rules("s", rules.LAUGHS + rules.BLANKS)]
    chain, last = [f"q0 AS ({own})"], "q0"
    for k, step in enumerate(steps, 1):
        chain.append(f"q{k} AS (SELECT tweet_id, i, {step} AS s FROM {last}{' WHERE s <> %s' % sql_text('') if k == 1 else ''})")
        last = f"q{k}"
    return f"WITH {RECORDS_SQL}, {', '.join(chain)}, j AS (SELECT tweet_id, string_agg(s, ' ' ORDER BY i) AS s FROM {last} WHERE s NOT IN ('', ' ') GROUP BY 1) SELECT r.tweet_id, coalesce(s, '') AS msg_norm FROM r LEFT JOIN j USING (tweet_id)"


def sql_found(expr: str, pattern: str, skip: int = 0) -> str:
    """The offsets of matches from the pieces between them, as the operator states them."""
    m, s = f"regexp_extract_all({expr}, {sql_text(pattern)})", f"string_split_regex({expr}, {sql_text(pattern)})"
    return (
        f"list_transform(range(1, len({m}) + 1), lambda i: {{'pos': CAST(list_sum(list_transform({s}[1:i], lambda x: length(x))) "
        f"+ coalesce(list_sum(list_transform({m}[1:i-1], lambda x: length(x))), 0) + {skip} AS INTEGER), 'value': substr({m}[i], {skip + 1})}})"
    )


def _stage(apply: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: records(spark, d).select("tweet_id", apply(text.squeeze(F.col("msg"))).alias("out"))


def _stage_sql(expr: str) -> str:
    return f"WITH {RECORDS_SQL} SELECT tweet_id, {expr} AS out FROM r"


def _matches(find: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: records(spark, d).select("tweet_id", F.explode(find(F.col("msg"))).alias("e")).select("tweet_id", "e.pos", "e.value")


def _matches_sql(pattern: str, skip: int) -> str:
    return f"WITH {RECORDS_SQL} SELECT tweet_id, u.e.pos AS pos, u.e.value AS value FROM r, unnest({sql_found('msg', pattern, skip)}) AS u(e)"


def src_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Posts written as files of tab-separated lines, compressed, and read again."""
    flat = lambda c: F.regexp_replace(c, r"[\t\n\r]+", " ")
    place = F.format_string("(%s,%s)", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
    lines = records(spark, d).select(F.concat_ws("\t", F.col("tweet_id").cast("string"), F.lit("-"), F.lit("und"), place, "userid", flat("msg")).alias("value"))
    folder = work_path(spark, "tsv")
    lines.write.option("compression", "gzip").text(folder)
    return messages.read_tsv(spark, folder).select("id", "userid", "msg", F.nanvl("geo.lat", F.lit(None)).alias("lat"), F.nanvl("geo.lon", F.lit(None)).alias("lon"))


def src_last_row(spark: SparkSession, d: str) -> DataFrame:
    """Keyed load: of the deliveries of one post the last one counts."""
    rows = table(spark, d, "tweets").select("tweet_id", "retweet_count", "favorite_count", "date_of_collection")
    order = F.struct("date_of_collection", "favorite_count", "retweet_count")
    return last_by_key(rows, "tweet_id", order).select("tweet_id", "retweet_count", "favorite_count")


def _json_files(rows: DataFrame, key: str, label: str, each: int = 500) -> str:
    """A folder of files with one JSON array of about ``each`` rows each."""
    folder = work_path(rows.sparkSession, label)
    bucket = F.pmod(F.xxhash64(key), F.lit(max(1, rows.count() // each)))
    arrays = rows.groupBy(bucket.alias("b")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def src_profiles_json(spark: SparkSession, d: str) -> DataFrame:
    """Profiles written as JSON files and read again."""
    u = table(spark, d, "users").select(
        F.col("user_id").alias("id"), F.col("user_name").alias("name"), "screen_name", "location", F.col("profile_url").alias("url"), "geo_enabled", F.col("profile_language").alias("lang"),
        "friends_list", "followers_list", "friends_count", "followers_count", "utc_offset", "khop", F.coalesce(F.date_format("date_of_collection", "MM-dd-yyyy HH:mm:ss"), F.lit("02-03-2024 04:05:06")).alias("DOC"),
    )
    read = messages.read_profiles(spark, _json_files(u.where("id IS NOT NULL"), "id", "profiles"), "*.txt")
    return read.select("user_id", "user_name", "location", "profile_url", "geo_enabled", "friends_list", "friends_count", "utc_offset", F.unix_seconds("date_of_collection").alias("collected_s"))


def src_timelines_json(spark: SparkSession, d: str) -> DataFrame:
    """Posts written as timeline files and read again, with all that a timeline holds."""
    number = lambda c: F.nanvl(c, F.lit(None))
    t = records(spark, d).select(
        F.col("tweet_id").alias("id"), F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"), F.col("msg").alias("text"), F.struct(F.col("user_id").alias("id")).alias("user"),
        F.struct("country", F.col("place_full_name").alias("full_name"), "place_type", F.col("place_url").alias("url")).alias("place"), F.struct(F.array(number("longitude"), number("latitude")).alias("coordinates")).alias("geo"),
        F.struct(
            F.transform("user_mentions", lambda x: F.struct(x.alias("id"))).alias("user_mentions"), F.transform("hashtag_entities", lambda x: F.struct(x.alias("text"))).alias("hashtags"),
            F.transform("url_entities", lambda x: F.struct(x.alias("expanded_url"))).alias("urls"),
        ).alias("entities"),
        "in_reply_to_status_id", "in_reply_to_user_id", F.lit(1).alias("retweet_count"), F.lit(2).alias("favorite_count"), F.lit("02-03-2024 04:05:06").alias("DOC"),
    )
    read = messages.read_timelines(spark, _json_files(t, "id", "timelines"), "*.txt")[0]
    return read.select(
        "tweet_id", "user_id", F.unix_seconds("created_at").alias("created_s"), "tweet", "user_mentions", "hashtag_entities", "url_entities", "in_reply_to_status_id", "in_reply_to_user_id", "latitude", "longitude", "country", "place_full_name",
        "place_type", "place_url", "retweet_count", "favorite_count", F.unix_seconds("date_of_collection").alias("collected_s"),
    )


def flt_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")


def flt_box(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(in_box(F.col("latitude"), F.col("longitude"), BOX)).select("tweet_id", "latitude", "longitude")


def flt_kept(spark: SparkSession, d: str) -> DataFrame:
    return sinks.keep_percentage(table(spark, d, "tweets"), in_box(F.col("latitude"), F.col("longitude"), BOX)).withColumn("percentage", F.round("percentage", 6))


def flt_position(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy(is_position(F.col("latitude"), F.col("longitude")).alias("usable")).agg(F.count(F.lit(1)).alias("n"))


def flt_key_value(spark: SparkSession, d: str) -> DataFrame:
    return sinks.display_lines(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "source", "bio-north")


def flt_media(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pictures and films among those of profiles and posts."""
    own = table(spark, d, "users").select(F.explode(F.array("profile_image_url", "profile_background_image_url", "profile_url")).alias("link"))
    linked = table(spark, d, "tweets").select(F.explode("url_entities").alias("link"))
    return own.unionByName(linked).where(is_media(F.col("link"))).distinct()


def str_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", "i", "sentence")


def _sentences_sql() -> str:
    expr = "text"
    for mark, broken in rules.SENTENCE_BREAKS:
        expr = f"replace({expr}, {sql_text(mark)}, {sql_text(broken)})"
    trim = "regexp_replace(s, '^\\s+|\\s+$', '', 'g')"
    lists = f"list_filter(list_transform(string_split({expr}, chr(10)), lambda s: {trim}), lambda s: s <> '')"
    return f"WITH s AS (SELECT doc_id, {lists} AS l FROM documents) SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS i, l[u.i] AS sentence FROM s, unnest(range(1, len(l) + 1)) AS u(i)"


def str_normalized(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("tweet_id", text.normalize(F.col("msg")).alias("msg_norm"))


def str_entities(spark: SparkSession, d: str) -> DataFrame:
    """All entity columns of each message in one pass."""
    own = entities.with_entities(records(spark, d).select("tweet_id", "msg"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    return own.select("tweet_id", n("http_links"), n("hashtags"), n("mentions"), n("retweet"), F.coalesce("user_msg", F.lit(False)).alias("user_msg"))


def agg_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = records(spark, d).select("tweet_id", F.explode(text.count_words(text.squeeze(F.col("msg")))).alias("word"))
    return words.groupBy("tweet_id", "word").agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def snk_count_lines(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d)
    words = own.select("tweet_id", "user_id", F.explode(text.count_words(text.squeeze(F.col("msg")))).alias("word"))
    counts = words.groupBy("tweet_id", "user_id", "word").agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    return sinks.count_lines(counts, "tweet_id", "user_id")


def snk_message_lines(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d).select("tweet_id", text.remove_word_ends(F.lower(text.squeeze(F.col("msg")))).alias("m"))
    return sinks.message_lines(own, "tweet_id", "m")


def snk_date_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.date_lines(dt_day_key(spark, d), "tweet_id", "day")


def dt_day_key(spark: SparkSession, d: str) -> DataFrame:
    shown = F.date_format("created_at", "EEE MMM dd HH:mm:ss 'UTC' yyyy")
    return records(spark, d).select("tweet_id", messages.day_key(shown).alias("day"))


def dt_parsed(spark: SparkSession, d: str) -> DataFrame:
    created, collected = F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy"), F.date_format("created_at", "MM-dd-yyyy HH:mm:ss")
    return records(spark, d).select(
        "tweet_id", F.unix_seconds(messages.created_at(created)).alias("created_s"), F.date_format(messages.created_date(created), "yyyy-MM-dd").alias("created_day"),
        F.unix_seconds(messages.collected_at(collected)).alias("collected_s"),
    )


def dt_days(spark: SparkSession, d: str) -> DataFrame:
    """Days from a fixed day to each user's oldest post."""
    oldest = records(spark, d).where("user_id IS NOT NULL").groupBy("user_id").agg(F.min("created_at").alias("oldest"))
    return oldest.select("user_id", days_since("2024-02-01 00:00:00", F.col("oldest")).alias("days"))


_WORD = sql_rules("lower(" + sql_rules("msg", rules.SQUEEZE) + ")", rules.WORD_ENDS + rules.SQUEEZE)
_IN_BOX = f"latitude BETWEEN {BOX[0]} AND {BOX[2]} AND longitude BETWEEN {BOX[1]} AND {BOX[3]}"
_SQUEEZED = sql_rules("msg", rules.SQUEEZE)
_UTC = "(created_at AT TIME ZONE 'UTC')"
_CNT = f"SELECT tweet_id, user_id, u.w AS word, count(*) AS n FROM r, unnest(string_split({_WORD}, ' ')) AS u(w) GROUP BY 1, 2, 3"
_FLAT = "regexp_replace(regexp_replace(msg, '[\\t\\n\\r]+', ' ', 'g'), '\\s+$', '')"

QUERIES = {
    "src_tsv": (src_tsv, f"WITH {RECORDS_SQL} SELECT CAST(tweet_id AS VARCHAR) AS id, userid, {_FLAT} AS msg, CASE WHEN longitude IS NOT NULL AND NOT isnan(latitude) THEN latitude END AS lat, CASE WHEN latitude IS NOT NULL AND NOT isnan(longitude) THEN longitude END AS lon FROM r WHERE {_FLAT} <> '' AND userid IS NOT NULL"),
    "src_last_row": (src_last_row, "SELECT tweet_id, retweet_count, favorite_count FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY date_of_collection DESC NULLS LAST, favorite_count DESC NULLS LAST, retweet_count DESC NULLS LAST) AS k FROM tweets WHERE tweet_id IS NOT NULL) WHERE k = 1"),
    "src_profiles_json": (src_profiles_json, "SELECT user_id, user_name, location, profile_url, coalesce(geo_enabled, false) AS geo_enabled, friends_list, friends_count, utc_offset, CAST(floor(epoch(coalesce(date_of_collection, TIMESTAMPTZ '2024-02-03 04:05:06+00'))) AS BIGINT) AS collected_s FROM users WHERE user_id IS NOT NULL"),
    "src_timelines_json": (src_timelines_json, f"WITH {RECORDS_SQL} SELECT tweet_id, user_id, CAST(floor(epoch(created_at)) AS BIGINT) AS created_s, msg AS tweet, user_mentions, hashtag_entities, url_entities, in_reply_to_status_id, in_reply_to_user_id, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude, country, place_full_name, place_type, place_url, CAST(1 AS INTEGER) AS retweet_count, CAST(2 AS BIGINT) AS favorite_count, CAST(epoch(TIMESTAMP '2024-02-03 04:05:06') AS BIGINT) AS collected_s FROM (SELECT DISTINCT ON (tweet_id) *, CAST(user_id AS VARCHAR) AS userid, tweet AS msg FROM tweets WHERE tweet IS NOT NULL AND tweet_id IS NOT NULL)"),
    "flt_language": (flt_language, "SELECT doc_id, n_chars FROM documents WHERE lang = 'en'"),
    "flt_box": (flt_box, f"WITH {RECORDS_SQL} SELECT tweet_id, latitude, longitude FROM r WHERE {_IN_BOX}"),
    "flt_kept": (flt_kept, f"SELECT count(*) AS n_lines, count(*) FILTER (WHERE {_IN_BOX}) AS n_kept, round(100.0 * count(*) FILTER (WHERE {_IN_BOX}) / nullif(count(*), 0), 6) AS percentage FROM tweets"),
    "flt_position": (flt_position, f"WITH {RECORDS_SQL} SELECT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS usable, count(*) AS n FROM r GROUP BY 1"),
    "flt_key_value": (flt_key_value, "SELECT concat('doc_id: ', doc_id, chr(10), 'lang: ', coalesce(lang, ''), chr(10), 'n_chars: ', coalesce(CAST(n_chars AS VARCHAR), ''), chr(10), 'source: ', source) AS text FROM documents WHERE source = 'bio-north'"),
    "flt_media": (flt_media, "WITH a AS (SELECT unnest([profile_image_url, profile_background_image_url, profile_url]) AS link FROM users UNION SELECT unnest(url_entities) FROM tweets) SELECT link FROM a WHERE " + " OR ".join(f"ends_with(link, '.{x}')" for x in ("gif", "jpg", "jpeg", "jif", "jfif", "tif", "tiff", "png", "pdf", "mp4"))),
    "str_links": (_matches(entities.links), _matches_sql(entities.LINK, 0)),
    "str_hashtags": (_matches(entities.hashtags), _matches_sql(entities.HASHTAG, 1)),
    "str_mentions": (_matches(entities.mentions), _matches_sql(entities.MENTION, 1)),
    "str_reposts": (_matches(lambda c: entities.found(c, entities.REPOST)), _matches_sql(entities.REPOST, 0)),
    "str_entities": (str_entities, f"WITH {RECORDS_SQL} SELECT tweet_id, " + ", ".join(f"CAST(len(regexp_extract_all(msg, {sql_text(p)})) AS INTEGER) AS n_{n}" for n, p in (("http_links", entities.LINK), ("hashtags", entities.HASHTAG), ("mentions", entities.MENTION), ("retweet", entities.REPOST))) + ", regexp_matches(msg, '^\\s?@') AS user_msg FROM r"),
    "str_sentences": (str_sentences, _sentences_sql()),
    "str_transliterated": (_stage(text.transliterate), _stage_sql(sql_transliterate(_SQUEEZED))),
    "str_without_meta": (_stage(text.remove_meta), _stage_sql(sql_rules(_SQUEEZED, rules.META + rules.SQUEEZE))),
    "str_without_punctuation": (_stage(text.remove_punctuation), _stage_sql(sql_rules(_SQUEEZED, rules.PUNCTUATION + rules.SQUEEZE))),
    "str_without_markup": (_stage(text.remove_markup), _stage_sql(sql_rules(_SQUEEZED, rules.MARKUP + rules.SQUEEZE))),
    "str_laughs": (_stage(text.canonical_laughs), _stage_sql(sql_rules(_SQUEEZED, rules.LAUGHS))),
    "str_repeats": (_stage(text.cap_repeats), _stage_sql(sql_rules(sql_capped(_SQUEEZED), rules.LAUGHS))),
    "str_word_ends": (_stage(text.remove_word_ends), _stage_sql(sql_rules(_SQUEEZED, rules.WORD_ENDS + rules.SQUEEZE))),
    "str_normalized": (str_normalized, _normalized_sql()),
    "str_without_marks": (_stage(text.without_marks), _stage_sql(f"translate({_SQUEEZED}, '-,?!\":;.()', '')")),
    "str_marks_to_spaces": (_stage(text.marks_to_spaces), _stage_sql(f"translate({_SQUEEZED}, '-,?!\":;.()', '           ')")),
    "snk_message_lines": (snk_message_lines, f"WITH {RECORDS_SQL} SELECT tweet_id, regexp_replace(concat(tweet_id, chr(9), {_WORD}), '[^\\x00-\\x7F]', '', 'g') AS line FROM r"),
    "snk_date_lines": (snk_date_lines, f"WITH {RECORDS_SQL} SELECT tweet_id, concat(tweet_id, '.counts ', strftime({_UTC}, '%Y%m%d')) AS line FROM r WHERE created_at IS NOT NULL"),
    "dt_days": (dt_days, f"WITH {RECORDS_SQL} SELECT user_id, CAST(date_diff('day', DATE '2024-02-01', CAST(min({_UTC}) AS DATE)) AS INTEGER) AS days FROM r WHERE user_id IS NOT NULL GROUP BY 1"),
    "agg_word_counts": (agg_word_counts, f"WITH {RECORDS_SQL}, c AS ({_CNT}) SELECT tweet_id, word, CAST(n AS DOUBLE) AS cnt FROM c"),
    "snk_count_lines": (snk_count_lines, f"WITH {RECORDS_SQL}, c AS ({_CNT}) SELECT tweet_id, regexp_replace(concat_ws(' ', tweet_id, user_id, string_agg(word || '|' || n || '.0', ' ' ORDER BY word)), '[^\\x00-\\x7F]', '', 'g') AS line FROM c GROUP BY tweet_id, user_id"),
    "dt_day_key": (dt_day_key, f"WITH {RECORDS_SQL} SELECT tweet_id, strftime({_UTC}, '%Y%m%d') AS day FROM r"),
    "dt_parsed": (dt_parsed, f"WITH {RECORDS_SQL} SELECT tweet_id, CAST(floor(epoch(created_at)) AS BIGINT) AS created_s, strftime({_UTC}, '%Y-%m-%d') AS created_day, CAST(floor(epoch(created_at)) AS BIGINT) AS collected_s FROM r"),
}
