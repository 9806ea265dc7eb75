"""Readers of message, profile, timeline, graph and weight files. Bad rows are dropped, not fatal, where noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery import schema


def parse_tsv(lines: DataFrame, value: str = "value") -> DataFrame:
    """``id, date, lid_gnip, geo, userid, msg`` of tab-separated lines.

    No quoting; white space at a line's end is cut; lines of fewer than six fields are dropped and
    further fields ignored. ``geo`` is ``(lat,long)``; what isn't two numbers gives a null ``geo``.
    """
    f = F.split(F.regexp_replace(value, r"\s+$", ""), "\t", -1)
    lat, lon = F.expr("try_cast(_p[0] AS DOUBLE)"), F.expr("try_cast(_p[1] AS DOUBLE)")
    rows = lines.select(F.col(value), f.alias("_f")).where(F.size("_f") >= 6).withColumn("_p", F.split(F.regexp_replace(F.col("_f")[3], r"[()\s]", ""), ","))
    geo = F.when((F.size("_p") == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
    return rows.select(F.col("_f")[0].alias("id"), F.col("_f")[1].alias("date"), F.col("_f")[2].alias("lid_gnip"), geo.alias("geo"), F.col("_f")[4].alias("userid"), F.col("_f")[5].alias("msg"))


def read_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Messages of TSV files, plain or gzip by extension; of equal ids in one file the last line counts."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    rows = parse_tsv(lines.withColumn("value", F.concat_ws("\u0001", "_file", F.col("_line").cast("string"), "value")))
    parts = F.split("id", "\u0001")
    rows = rows.withColumns({"_file": parts[0], "_line": parts[1].cast("long"), "id": parts[2]})
    last = rows.groupBy("_file", "id").agg(F.max_by(F.struct("date", "lid_gnip", "geo", "userid", "msg"), "_line").alias("r"))
    return last.select("id", "r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored records; a folder that isn't there or holds nothing is an empty set."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema.RECORD)
    return spark.read.schema(schema.RECORD).option("ignoreMissingFiles", True).parquet(path)


_USER = "id LONG, name STRING, screen_name STRING, location STRING, profile_background_image_url STRING, profile_image_url STRING, url STRING, time_zone STRING, utc_offset STRING, geo_enabled BOOLEAN, lang STRING, friends_list ARRAY<LONG>, followers_list ARRAY<LONG>, friends_count LONG, followers_count LONG, DOC STRING, khop INT"
PROFILE_JSON = _USER
TIMELINE_JSON = (
    f"id LONG, created_at STRING, text STRING, user STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in _USER.split(', '))}>, place STRUCT<country: STRING, place_type: STRING, full_name: STRING, url: STRING>, "
    "geo STRUCT<coordinates: ARRAY<DOUBLE>>, entities STRUCT<user_mentions: ARRAY<STRUCT<id: LONG>>, hashtags: ARRAY<STRUCT<text: STRING>>, urls: ARRAY<STRUCT<expanded_url: STRING>>>, "
    "in_reply_to_status_id LONG, in_reply_to_user_id LONG, retweet_count INT, favorite_count LONG, DOC STRING"
)


def created_at(text: Column) -> Column:
    """``Wed Apr 22 03:39:06 +0000 2015`` as a timestamp; null for anything else."""
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def created_date(text: Column) -> Column:
    """Day, month and year of the same format."""
    return F.to_date(created_at(text))


def collected_at(text: Column) -> Column:
    """``04-22-2015 03:39:06`` as a timestamp; null for anything else."""
    return F.try_to_timestamp(F.trim(text), F.lit("MM-dd-yyyy HH:mm:ss"))


def day_key(date: Column) -> Column:
    """``Wed Apr 22 03:39:06 EDT 2015`` as ``20150422``: the day as written, in its own zone."""
    part = F.split(date, r"\s+")
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    month = F.lpad(F.array_position(F.array(*(F.lit(m) for m in months)), F.get(part, 1)).cast("string"), 2, "0")
    return F.when(date.rlike(r"^\w{3} [A-Z][a-z]{2} \d{1,2} \d\d:\d\d:\d\d \w+ \d{4}$"), F.concat(F.get(part, 5), month, F.lpad(F.get(part, 2), 2, "0")))


def _users_of(rows: DataFrame, p: str = "") -> DataFrame:
    c = lambda n: F.col(p + n)
    return rows.where(c("id").isNotNull()).select(
        c("id").alias("user_id"), c("name").alias("user_name"), c("screen_name").alias("screen_name"), c("location").alias("location"), c("friends_list").alias("friends_list"), c("followers_list").alias("followers_list"),
        c("profile_background_image_url").alias("profile_background_image_url"), c("profile_image_url").alias("profile_image_url"), c("url").alias("profile_url"), c("time_zone").alias("time_zone"),
        F.coalesce(collected_at(c("DOC")), F.col("_mtime")).alias("date_of_collection"), c("khop").alias("khop"), F.coalesce(c("geo_enabled"), F.lit(False)).alias("geo_enabled"),
        c("lang").alias("profile_language"), c("friends_count").alias("friends_count"), c("followers_count").alias("followers_count"), c("utc_offset").alias("utc_offset"),
    )


def profile_rows(parsed: DataFrame) -> DataFrame:
    """Profiles from parsed JSON (with ``_mtime``, the default date of collection); rows without an id are dropped."""
    return _users_of(parsed)


def timeline_rows(parsed: DataFrame) -> DataFrame:
    """Posts from parsed timeline JSON; a missing nested field is null. Latitude is the second coordinate, longitude the first."""
    ids = lambda path, leaf: F.transform(path, lambda x: x[leaf])
    return parsed.where("id IS NOT NULL").select(
        F.col("id").alias("tweet_id"), F.col("user.id").alias("user_id"), created_at(F.col("created_at")).alias("created_at"), F.col("text").alias("tweet"),
        ids("entities.user_mentions", "id").alias("user_mentions"), ids("entities.hashtags", "text").alias("hashtag_entities"), ids("entities.urls", "expanded_url").alias("url_entities"),
        "in_reply_to_status_id", "in_reply_to_user_id", F.get("geo.coordinates", F.lit(1)).alias("latitude"), F.get("geo.coordinates", F.lit(0)).alias("longitude"), "retweet_count",
        F.col("place.country").alias("country"), F.col("place.full_name").alias("place_full_name"), F.col("place.place_type").alias("place_type"), F.col("place.url").alias("place_url"),
        "favorite_count", F.coalesce(collected_at(F.col("DOC")), F.col("_mtime")).alias("date_of_collection"),
    )


def timeline_authors(parsed: DataFrame) -> DataFrame:
    """The authors embedded in timelines, without a hop."""
    return _users_of(parsed, "user.")


def _read_json(spark: SparkSession, path: str, ddl: str, names: str) -> DataFrame:
    reader = spark.read.schema(ddl).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", names)
    return reader.json(path).withColumn("_mtime", F.col("_metadata.file_modification_time"))


def read_profiles(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """The profile, or the array of profiles, of each file; empty and unreadable files, and those without an id, are skipped."""
    return profile_rows(_read_json(spark, folder, PROFILE_JSON, names))


def read_timelines(spark: SparkSession, folder: str, names: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Posts and their authors; a file holds an array of posts or a single one."""
    parsed = _read_json(spark, folder, TIMELINE_JSON, names)
    return timeline_rows(parsed), timeline_authors(parsed)


def _fields(lines: DataFrame, allowed: tuple[int, ...]) -> DataFrame:
    """Fields between white space; blank lines are skipped, another number of fields is an error."""
    f = lines.where(F.trim("value") != "").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))
    wrong = F.concat(F.lit("line with "), F.size("f").cast("string"), F.lit(" fields: "), F.array_join("f", " "))
    return f.select(F.when(F.size("f").isin(*allowed), F.col("f")).otherwise(F.raise_error(wrong)).alias("f"))


def parse_edges(lines: DataFrame) -> DataFrame:
    """``src, dst, count_coc, count_comm, count_rt, count_ht`` of lines ``src dst a`` or ``src dst coc comm rt``."""
    f = F.col("f")
    five = F.size(f) == 5
    n = lambda i: F.get(f, F.lit(i)).cast("long")
    return _fields(lines, (3, 5)).select(
        n(0).alias("src"), n(1).alias("dst"), F.when(five, n(2)).alias("count_coc"), F.when(five, n(3)).alias("count_comm"), F.when(five, n(4)).alias("count_rt"), F.when(~five, n(2)).alias("count_ht")
    )


def parse_nodes(lines: DataFrame) -> DataFrame:
    """``node_id, name`` of lines ``id name``."""
    return _fields(lines, (2,)).select(F.col("f")[0].cast("long").alias("node_id"), F.col("f")[1].alias("name"))


def parse_degrees(lines: DataFrame) -> DataFrame:
    """``node_id, in_w, out_w``; any other number of fields is an error."""
    return _fields(lines, (3,)).select(*(F.col("f")[i].cast("long").alias(n) for i, n in enumerate(("node_id", "in_w", "out_w"))))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``doc, domain, lang, bytes`` of files laid out as ``domain/lang/name``, or as ``domain=.../lang=.../name``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    part = F.split("path", "/")
    name = lambda i: F.regexp_replace(part[F.size(part) - i], "^(domain|lang)=", "")
    return files.select(F.col("path").alias("doc"), name(3).alias("domain"), name(2).alias("lang"), F.col("content").alias("bytes"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``term, weights`` of CSV lines; the term may be quoted and hold commas then, ``nan`` counts as 0."""
    quoted = r"^'((?:[^'\\]|\\.)*)'(?:,(.*))?$"
    rows = spark.read.text(path).where(F.trim("value") != "")
    plain = F.regexp_extract("value", r"^([^,]*)(?:,(.*))?$", 1)
    is_quoted = F.col("value").rlike(quoted)
    term = F.when(is_quoted, F.regexp_replace(F.regexp_extract("value", quoted, 1), r"\\(.)", "$1")).otherwise(plain)
    rest = F.when(is_quoted, F.regexp_extract("value", quoted, 2)).otherwise(F.regexp_extract("value", r"^([^,]*)(?:,(.*))?$", 2))
    w = F.filter(F.split(rest, ","), lambda x: F.trim(x) != "")
    return rows.select(term.alias("term"), w.alias("w")).select("term", F.expr("transform(w, x -> nanvl(coalesce(try_cast(trim(x) AS DOUBLE), 0D), 0D))").alias("weights"))


def split_list(paths: list[str], parts: int) -> list[list[str]]:
    """Near-equal parts in order, the first ones one longer; no more parts than paths."""
    parts = max(1, min(parts, len(paths)))
    size, more = divmod(len(paths), parts)
    out, at = [], 0
    for i in range(parts):
        out.append(paths[at : at + size + (i < more)])
        at += len(out[-1])
    return out


STATUS = T.StructType([T.StructField("text", T.StringType()), T.StructField("retweet_count", T.LongType())])
