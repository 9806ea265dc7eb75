"""Schemas of the relational tables and of message records."""

from pyspark.sql import types as T

ENTITY = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())]))
GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def _of(spec: str) -> T.StructType:
    kinds = {
        "L": T.LongType(), "I": T.IntegerType(), "H": T.ShortType(), "D": T.DoubleType(), "S": T.StringType(), "B": T.BooleanType(),
        "TS": T.TimestampType(), "AL": T.ArrayType(T.LongType()), "AS": T.ArrayType(T.StringType()),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


USERS = _of(
    "user_id:L user_name:S screen_name:S location:S friends_list:AL followers_list:AL profile_background_image_url:S profile_image_url:S profile_url:S "
    "time_zone:S date_of_collection:TS khop:I geo_enabled:B profile_language:S friends_count:L followers_count:L utc_offset:S"
)
#: Columns that sampling adds to users; null means undecided.
SAMPLING = _of("has_timeline:B expand_user:B timeline_is_relevant:B has_timeline_filter:B timeline_document:AS decision_candid_tfdf_score:D decision_tfidf:D")
TWEETS = _of(
    "tweet_id:L user_id:L created_at:TS tweet:S user_mentions:AL hashtag_entities:AS url_entities:AS in_reply_to_status_id:L in_reply_to_user_id:L latitude:D "
    "longitude:D retweet_count:I country:S place_full_name:S place_type:S place_url:S favorite_count:L date_of_collection:TS"
)
GRAPH = _of("edge_id:L from_id:L to_id:L edge_type:H tweet_id:L hashtag:S")
TOPICS = _of("topic_id:L topic:S khop:I document_frequency:D")
LOST_PROFILES = _of("profile_id:L screen_name:S user_id:L")
TABLES = {"users": USERS, "tweets": TWEETS, "graph": GRAPH, "topics": TOPICS, "lost_profiles": LOST_PROFILES}

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "date", "userid", "msg")]
    + [T.StructField("geo", GEO), T.StructField("lid_gnip", T.StringType())]
    + [T.StructField(n, ENTITY) for n in ("http_links", "hashtags", "mentions")]
    + [T.StructField("retweet", T.ArrayType(T.IntegerType())), T.StructField("user_msg", T.BooleanType()), T.StructField("msg_norm", T.StringType()), T.StructField("lid_lui", T.StringType())]
)
