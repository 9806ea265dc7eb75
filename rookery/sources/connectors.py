"""The web interface's requests as queries over stored tables, and a paged data source with rate limits.

Each function answers what the remote call would, from tables of the same shape; nothing here opens
a connection. Limits are clipped as the service clips them.
"""

from __future__ import annotations

import json
import random
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rookery.functions.geo import haversine_m, require_position
from rookery.functions.labels import named_language
from rookery.operators.relational import numbered

# Fixed values of the service.
IDS_PER_PAGE, PROFILES_PER_CALL, TIMELINE_PAGE, TIMELINE_DEPTH, USERS_PER_PAGE, MOST_USERS, TRENDS = 5_000, 100, 200, 3_200, 20, 1_000, 50
WINDOW_S, STATUS_CALLS, LONGEST_WAIT_S = 900, 180, 300


def lookup_users(users: DataFrame, screen_names: DataFrame | None = None, user_ids: DataFrame | None = None) -> DataFrame:
    """Profiles by screen name (case aside), by id, or both; each profile row once."""
    names = users.where(F.lit(False)) if screen_names is None else users.join(screen_names.select(F.lower("screen_name").alias("_s")).distinct(), F.lower("screen_name") == F.col("_s"), "left_semi")
    ids = users.where(F.lit(False)) if user_ids is None else users.join(user_ids.select("user_id").distinct(), "user_id", "left_semi").select(*users.columns)
    return names.unionByName(ids).dropDuplicates(["user_id", "date_of_collection"])


def list_ids(users: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """``user_id, position, id``: the first ``limit`` ids of a list column of each user."""
    listed = F.col(column) if limit is None else F.slice(column, 1, limit)
    return users.select("user_id", F.posexplode(listed).alias("position", "id"))


def list_profiles(users: DataFrame, of: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Profiles of the listed ids."""
    return users.join(list_ids(of, column, limit).select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi").select(*users.columns)


def timeline(tweets: DataFrame, user_id: int, since: str | None = None, replies: bool = True, reposts: bool = True, depth: int = TIMELINE_DEPTH) -> DataFrame:
    """A user's latest posts back to ``since``, newest first, at most ``depth``."""
    own = tweets.where(F.col("user_id") == user_id)
    if since is not None:
        own = own.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if not replies:
        own = own.where("in_reply_to_status_id IS NULL")
    if not reposts:
        own = own.where(~F.col("tweet").startswith("RT @"))
    return own.orderBy(F.desc("created_at"), F.desc("tweet_id")).limit(depth)


def get_tweets(tweets: DataFrame, ids: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Posts by id; with ``keep_missing`` unknown ids have a row of nulls."""
    return ids.select("tweet_id").distinct().join(tweets, "tweet_id", "left" if keep_missing else "inner")


def reposts_of(tweets: DataFrame, users: DataFrame, tweet_id: int, limit: int = 100, same_text: bool = True) -> DataFrame:
    """Latest reposts of one post, by its id; the limit is clipped to 1..100.

    Stored posts don't say which post they repeat. A repost opens with the mark of the author's
    screen name (case aside), isn't older than the post, and goes on with the post's text, which may
    have been cut short; without ``same_text`` any text will do. An unknown id has none.
    """
    names = users.where("screen_name IS NOT NULL").select("user_id", F.lower("screen_name").alias("_name")).distinct()
    post = tweets.where(F.col("tweet_id") == tweet_id).limit(1).select("user_id", F.coalesce("tweet", F.lit("")).alias("_text"), F.col("created_at").alias("_since"))
    marks = F.broadcast(post.join(names, "user_id").select(F.concat(F.lit("rt @"), "_name", F.lit(":")).alias("_mark"), "_text", "_since"))  # a row for each name of one author
    rest = F.trim(F.substr("tweet", F.length("_mark") + 1))
    whole = F.col("_text").startswith(F.regexp_replace(rest, r"(\u2026|\.\.\.)$", "")) & (rest != "")
    found = tweets.join(marks, F.lower("tweet").startswith(F.col("_mark")) & (F.col("_since").isNull() | (F.col("created_at") >= F.col("_since"))))
    if same_text:
        found = found.where(whole)
    return found.select(*tweets.columns).distinct().orderBy(F.desc("created_at"), F.desc("tweet_id")).limit(max(1, min(limit, 100)))


def _terms(text: Column, q: str | list[str], exclusive: bool) -> Column:
    words = q.split() if isinstance(q, str) else q
    tests = [F.lower(text).contains(w.lower()) for w in words]
    out = tests[0]
    for t in tests[1:]:
        out = out | t if exclusive else out & t
    return out


def query_string(terms: list[str], exclusive: bool = False) -> str:
    """Terms joined for all (a space) or any (``OR``) of them."""
    return (" OR " if exclusive else " ").join(terms)


def search_tweets(
    tweets: DataFrame, q: str | list[str] = "", exclusive: bool = False, around: tuple[float, float, float] | None = None, until: str | None = None, kind: str = "mixed", limit: int = 100,
    lang: str | None = None, lang_column: str = "lang",
) -> DataFrame:
    """Posts with all terms (``exclusive``: any), within ``around`` = (lat, lon, km), created before ``until``, in a language.

    ``lang`` is a two-letter code; ``lang_column`` holds labels in any spelling.

    ``kind``: ``recent`` by time, ``popular`` by reposts and favourites, ``mixed`` by both in turn;
    ties by id. At most ``limit`` rows.
    """
    own = tweets
    if q:
        own = own.where(_terms(F.col("tweet"), q, exclusive))
    if around:
        own = own.where(haversine_m(F.col("latitude"), F.col("longitude"), F.lit(around[0]), F.lit(around[1])) <= around[2] * 1000)
    if until:
        own = own.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    if lang:
        own = own.where(named_language(F.col(lang_column)) == lang.lower())
    weight = F.coalesce("retweet_count", F.lit(0)) + F.coalesce("favorite_count", F.lit(0))
    order = {"recent": [F.desc_nulls_last("created_at")], "popular": [F.desc(weight)], "mixed": [F.desc(weight), F.desc_nulls_last("created_at")]}[kind]
    return own.orderBy(*order, F.desc("tweet_id")).limit(limit)


def search_hashtag(tweets: DataFrame, tag: str, limit: int = 100) -> DataFrame:
    """Latest posts with a hashtag, with or without ``#`` and in any case."""
    own = tweets.where(F.exists("hashtag_entities", lambda h: F.lower(h) == tag.lstrip("#").lower()))
    return own.orderBy(F.desc_nulls_last("created_at"), F.desc("tweet_id")).limit(limit)


def search_users(users: DataFrame, q: str | list[str], exclusive: bool = False, limit: int = MOST_USERS) -> DataFrame:
    """Profiles whose name, screen name or place has the terms; at most ``limit`` and 1,000, smallest ids first."""
    text = F.concat_ws(" ", "user_name", "screen_name", "location")
    return users.where(_terms(text, q, exclusive)).orderBy("user_id", "date_of_collection").limit(min(limit, MOST_USERS))


GRANULARITY = ("poi", "neighborhood", "city", "admin", "country")


def reverse_geocode(places: DataFrame, lat: float, lon: float, granularity: str = "neighborhood", limit: int = 20) -> DataFrame:
    """Places at or above a granularity nearest to a position, with their distance; limit clipped to 0..20."""
    require_position(lat, lon)
    if granularity not in GRANULARITY:
        raise ValueError(f"unknown granularity: {granularity}")
    kinds = GRANULARITY[GRANULARITY.index(granularity) :]
    width = F.when(F.col("west") > F.col("east"), 360.0).otherwise(0.0) + F.col("east") - F.col("west")
    middle = (F.col("south") + F.col("north")) / 2, F.pmod(F.col("west") + width / 2 + 180.0, F.lit(360.0)) - 180.0
    d = haversine_m(middle[0], middle[1], F.lit(lat), F.lit(lon))
    return places.where(F.col("place_type").isin(*kinds)).withColumn("metres", d).orderBy("metres", "place_id").limit(max(0, min(limit, 20)))


def lookup_place(places: DataFrame, place_id: int) -> DataFrame:
    return places.where(F.col("place_id") == place_id)


def search_places(places: DataFrame, q: str = "", position: tuple[float, float] | None = None, country: str | None = None) -> DataFrame:
    """Places by name, by a position inside their box (boxes may cross longitude 180), by country, or all of these."""
    own = places
    if q:
        own = own.where(F.lower("place_full_name").contains(q.lower()))
    if country:
        own = own.where(F.col("country") == country)
    if position:
        lat, lon = position
        require_position(lat, lon)
        across = F.col("west") > F.col("east")
        inside = F.when(across, (F.lit(lon) >= F.col("west")) | (F.lit(lon) <= F.col("east"))).otherwise(F.lit(lon).between(F.col("west"), F.col("east")))
        own = own.where(F.lit(lat).between(F.col("south"), F.col("north")) & inside)
    return own


def trend_locations(tweets: DataFrame) -> DataFrame:
    """Places that posts come from."""
    return tweets.select("country", "place_full_name", "place_type").where("place_full_name IS NOT NULL").distinct()


def trends(tweets: DataFrame, country: str | None = None, exclude: str = "") -> DataFrame:
    """``name, n``: the 50 hashtags (or, with ``exclude='hashtags'``, words) of most posts; ties by name."""
    own = tweets if country is None else tweets.where(F.col("country") == country)
    source = F.filter(F.split(F.lower("tweet"), r"[^\w#@]+"), lambda w: (F.length(w) > 3) & ~w.rlike("^[#@]")) if exclude == "hashtags" else F.transform("hashtag_entities", lambda h: F.concat(F.lit("#"), F.lower(h)))
    named = own.select("tweet_id", F.explode(F.array_distinct(source)).alias("name")).where("name IS NOT NULL AND name <> '#'").distinct()
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(TRENDS)


# Endings of media that are fetched, as they are written.
MEDIA = ("gif", "jpg", "jpeg", "jif", "jfif", "tif", "tiff", "png", "pdf", "mp4")


def is_media(link: Column) -> Column:
    return link.rlike(rf"\.({'|'.join(MEDIA)})$")


@dataclass
class Credentials:
    """Key sets of a reader. They are options of the source and never part of a plan or a log."""

    keys: list[dict]
    needed: tuple[str, ...] = ("API_KEY", "API_SECRET", "ACCESS_TOKEN", "ACCESS_TOKEN_SECRET")

    def __post_init__(self):
        if not self.keys:
            raise ValueError("no keys")
        for k in self.keys:
            if lacking := [n for n in self.needed if not k.get(n)]:
                raise ValueError(f"key set lacks {', '.join(lacking)}")

    def __repr__(self):
        return f"Credentials({len(self.keys)} key sets)"

    @classmethod
    def load(cls, folder: str) -> Credentials:
        """Key sets of the JSON files of a folder; files that hold none are passed over with a warning."""
        found = []
        for path in _json_files(folder):
            try:
                found += cls([json.loads(_read(path))]).keys
            except (ValueError, AttributeError) as error:
                warnings.warn(f"{path}: no key set ({error})", stacklevel=2)
        return cls(found)

    def working(self, probe: Callable[[dict], bool]) -> Credentials:
        """Only the key sets that ``probe`` finds to work; none at all is an error."""
        return Credentials([k for k in self.keys if probe(k)], self.needed)

    def pick(self, seed: int | None = None) -> dict:
        """One key set by chance."""
        return random.Random(seed).choice(self.keys)


@dataclass
class RateLimiter:
    """Calls left of each key and kind in windows of 900 s; rotates keys where the wait is too long."""

    keys: int
    limits: dict[str, int]
    window_s: float = WINDOW_S
    clock: object = time.monotonic
    sleep: object = time.sleep
    _used: dict = field(default_factory=dict)
    current: int = 0

    def wait_of(self, key: int, kind: str) -> float:
        start, n = self._used.get((key, kind), (self.clock(), 0))
        if self.clock() - start >= self.window_s:
            return 0.0
        return 0.0 if n < self.limits[kind] else start + self.window_s - self.clock()

    def take(self, kind: str) -> int:
        """Count one call; returns the key to make it with, after a wait if there is no other way."""
        if self.wait_of(self.current, kind) > LONGEST_WAIT_S:
            self.current = min(range(self.keys), key=lambda k: (self.wait_of(k, kind), k))
        if (wait := self.wait_of(self.current, kind)) > 0:
            self.sleep(wait)
        start, n = self._used.get((self.current, kind), (self.clock(), 0))
        if self.clock() - start >= self.window_s:
            start, n = self.clock(), 0
        self._used[self.current, kind] = (start, n + 1)
        return self.current


def _json_files(folder: str) -> list[str]:
    files, path = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return sorted(scheme + f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".json"))


def _read(path: str) -> str:
    files, place = fs.FileSystem.from_uri(path)
    with files.open_input_stream(place) as stream:
        return stream.read().decode()


class _Page(InputPartition):
    """One answer, with its share of the calls that all answers may make together."""

    def __init__(self, path: str, key: int, calls: int, window_s: float):
        self.path, self.key, self.calls, self.window_s = path, key, calls, window_s


def shares(answers: int, keys: int, calls: int, window_s: float) -> tuple[int, float]:
    """Calls and window of one of ``answers`` readers at work at the same time, so that ``keys`` keys with ``calls`` each are never overdrawn."""
    own = keys * calls // max(1, answers)
    return (own, window_s) if own else (1, window_s * answers / (keys * calls))


class _PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema_, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        paths, keys = _json_files(self.options["path"]), max(1, int(self.options.get("keys", 1)))
        calls, window_s = shares(len(paths), keys, int(self.options.get("calls", STATUS_CALLS)), float(self.options.get("window", WINDOW_S)))
        return [_Page(path, i % keys, calls, window_s) for i, path in enumerate(paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Follows the pages of one answer: a file holds ``{"pages": [{"rows": [...], "next": cursor}, ...]}``."""
        limiter = RateLimiter(1, {"page": partition.calls}, partition.window_s)
        limit = int(self.options.get("limit", 0)) or None
        pages = json.loads(_read(partition.path))["pages"]
        cursor, n = 0, 0
        while True:
            limiter.take("page")
            for row in pages[cursor]["rows"]:
                if limit is not None and n >= limit:
                    return
                n += 1
                yield tuple(row.get(name) for name in self.schema_.names)
            cursor = pages[cursor].get("next") or 0
            if not cursor:
                return


class PagedSource(DataSource):
    """``spark.read.format("rookery_pages")``: paged answers stored as JSON, read page by page under a rate limit."""

    @classmethod
    def name(cls) -> str:
        return "rookery_pages"

    def schema(self) -> str:
        return "user_id long, screen_name string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def top_entities(tweets: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """``user_id, id``: distinct ids that each user's posts mention (``mention``) or reply to (``reply``), the smallest ``limit`` or all."""
    ids = F.explode("user_mentions") if kind == "mention" else F.col("in_reply_to_user_id")
    own = tweets.select("user_id", ids.alias("id")).where("id IS NOT NULL AND user_id IS NOT NULL").distinct()
    return own if limit is None else numbered(own, "user_id", [F.col("id")], limit)
