"""Raw post JSON: the feed built from the given tables, its parser (S02),
entity extraction (S03) and the bad-record quarantine (S17).

The feed nests what a post API delivers: a short ``text`` plus
``extended_tweet.full_text`` for long texts, ``user``, ``entities`` and,
for retweets, a ``retweeted_status`` that carries part of the entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from communitylens.sources.tables import Tables

SHORT_TEXT = 140
TWITTER_TIME = "EEE MMM dd HH:mm:ss +0000 yyyy"

_ENT = T.StructType([
    T.StructField("hashtags", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
    T.StructField("user_mentions", T.ArrayType(T.StructType([T.StructField("id_str", T.StringType())]))),
    T.StructField("urls", T.ArrayType(T.StructType([T.StructField("expanded_url", T.StringType())]))),
    T.StructField("symbols", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
])
_MEDIA = T.StructType([T.StructField("media", T.ArrayType(T.StructType([
    T.StructField("media_url", T.StringType()), T.StructField("type", T.StringType())])))])
POST_JSON_SCHEMA = T.StructType([
    T.StructField("id_str", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("extended_tweet", T.StructType([T.StructField("full_text", T.StringType()),
                                                  T.StructField("entities", _ENT)])),
    T.StructField("user", T.StructType([T.StructField("id_str", T.StringType()),
                                        T.StructField("screen_name", T.StringType())])),
    T.StructField("in_reply_to_user_id_str", T.StringType()),
    T.StructField("is_quote_status", T.StringType()),
    T.StructField("quoted_status", T.StructType([T.StructField("id_str", T.StringType()),
                                                 T.StructField("entities", _ENT)])),
    T.StructField("retweeted_status", T.StructType([T.StructField("id_str", T.StringType()),
                                                    T.StructField("entities", _ENT)])),
    T.StructField("entities", _ENT),
    T.StructField("extended_entities", _MEDIA),
    T.StructField("favorite_count", T.IntegerType()),
    T.StructField("retweet_count", T.IntegerType()),
    T.StructField("reply_count", T.IntegerType()),
    T.StructField("quote_count", T.IntegerType()),
])


def post_json_feed(t: Tables) -> DataFrame:
    """One JSON document per post (column ``value``).  Tags are written as
    upper-case hashtag texts ('P<tag>'); for retweets the odd tags sit in
    the retweeted post's entities, so parsing must merge both."""
    def values(kind, cast="string"):
        return F.array_sort(F.array_compact(F.transform(F.filter("entities", lambda e: e["kind"] == kind), lambda e: e["value"].cast(cast))))

    media = F.filter("entities", lambda e: (e["kind"] == "media") & e["value"].isNotNull())
    p = t.posts_and_entities.select(
        "*", values("hashtag", "bigint").alias("tags"), values("mention", "bigint").alias("ments"), values("url").alias("urls"),
        values("symbol").alias("syms"), F.try_element_at(media, F.lit(1))["value"].alias("media")).drop("entities")
    is_rt = F.col("kind") == "retweet"

    def hashtags(cond):
        return F.transform(F.filter(F.coalesce("tags", F.array().cast("array<bigint>")), cond),
                           lambda x: F.struct(F.concat(F.lit("P"), x.cast("string")).alias("text")))

    outer_tags = F.when(is_rt, hashtags(lambda x: x % 2 == 0)).otherwise(hashtags(lambda x: F.lit(True)))
    entities = F.struct(
        outer_tags.alias("hashtags"),
        F.transform(F.coalesce("ments", F.array().cast("array<bigint>")), lambda x: F.struct(x.cast("string").alias("id_str"))).alias("user_mentions"),
        F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda x: F.struct(x.alias("expanded_url"))).alias("urls"),
        F.transform(F.coalesce("syms", F.array().cast("array<string>")), lambda x: F.struct(x.alias("text"))).alias("symbols"))
    rt_entities = F.struct(hashtags(lambda x: x % 2 == 1).alias("hashtags"))
    long = F.length("status_text") > SHORT_TEXT
    doc = F.struct(
        F.col("id").cast("string").alias("id_str"),
        F.date_format("created_at", TWITTER_TIME).alias("created_at"),
        F.lit("en").alias("lang"),
        F.substring("status_text", 1, SHORT_TEXT).alias("text"),
        F.when(long, F.struct(F.col("status_text").alias("full_text"))).alias("extended_tweet"),
        F.struct(F.col("user_id").cast("string").alias("id_str")).alias("user"),
        F.col("in_reply_to_user_id").cast("string").alias("in_reply_to_user_id_str"),
        F.when(F.col("kind") == "quote", "true").otherwise("false").alias("is_quote_status"),
        F.when(F.col("kind") == "quote", F.struct((F.col("id") + 1).cast("string").alias("id_str"))).alias("quoted_status"),
        F.when(is_rt, F.struct((F.col("id") - 1).cast("string").alias("id_str"), rt_entities.alias("entities"))).alias("retweeted_status"),
        entities.alias("entities"),
        F.when(F.col("media").isNotNull(), F.struct(F.array(F.struct(F.col("media").alias("media_url"),
                                                                      F.lit("photo").alias("type"))).alias("media"))).alias("extended_entities"),
        "favorite_count", "retweet_count", "reply_count", "quote_count")
    return p.select(F.to_json(doc).alias("value"))


def parse_post_json(feed: DataFrame) -> DataFrame:
    """Flatten a post document; the long text wins over the short one;
    the created_at string is parsed (X14) instead of stamping arrival time."""
    j = feed.select(F.from_json("value", POST_JSON_SCHEMA).alias("j")).select("j.*")
    return j.select(
        F.col("id_str").cast("bigint").alias("id"),
        F.to_timestamp(F.substr("created_at", F.lit(5)), "MMM dd HH:mm:ss Z yyyy").cast("timestamp_ntz").alias("created_at"),
        "lang",
        F.coalesce(F.col("extended_tweet.full_text"), F.col("text")).alias("status_text"),
        F.col("user.id_str").alias("user_id_str"),
        "in_reply_to_user_id_str",
        "is_quote_status",
        F.col("quoted_status.id_str").alias("quoted_status_id_str"),
        F.col("retweeted_status.id_str").alias("retweeted_status_id_str"),
        F.col("retweeted_status.id_str").isNotNull().alias("retweeted"),
        "favorite_count", "retweet_count", "reply_count", "quote_count",
        F.col("entities").alias("_ent"), F.col("quoted_status.entities").alias("_qent"),
        F.col("retweeted_status.entities").alias("_rent"), F.col("extended_entities").alias("_media"))


def entity_columns() -> list:
    """S03 column expressions over a parsed post (see ``parse_post_json``):
    hashtags / symbols lower-cased and mentions de-duplicated in order, with
    the quoted and the retweeted post's entities merged in; urls as
    expanded, not de-duplicated; only the first media item."""
    def texts(e, field, key):
        return F.coalesce(F.transform(F.col(e)[field], lambda x: x[key]), F.array().cast("array<string>"))

    def merged(field, key, lower=True):
        arr = F.concat(texts("_ent", field, key), texts("_qent", field, key), texts("_rent", field, key))
        if lower:
            arr = F.transform(arr, lambda x: F.lower(x))
        return F.array_distinct(arr)

    urls = F.concat(texts("_ent", "urls", "expanded_url"), texts("_qent", "urls", "expanded_url"),
                    texts("_rent", "urls", "expanded_url"))
    media = F.try_element_at(F.col("_media.media"), F.lit(1))
    return [merged("hashtags", "text").alias("entities_hashtag"),
            merged("symbols", "text").alias("entities_symbol"),
            merged("user_mentions", "id_str", lower=False).alias("entities_user_mention"),
            urls.alias("entities_url"),
            media["media_url"].alias("entities_media_url"),
            media["type"].alias("entities_media_type")]


def extract_entities(parsed: DataFrame) -> DataFrame:
    """(id, entity columns) of parsed posts."""
    return parsed.select("id", *entity_columns())


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    T.StructField("_corrupt_record", T.StringType())])


def event_feed(events: DataFrame, broken_type: str | None = "error") -> DataFrame:
    """The event feed as JSON lines; lines of ``broken_type`` events are cut
    short (a deterministic stand-in for damaged records)."""
    js = F.to_json(F.struct(F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                            "user_id", "event_type", "value", "props"))
    if broken_type is None:
        return events.select(js.alias("value"))
    x = events.select(js.alias("_js"), F.col("event_type").alias("_t"))
    cut = F.expr("substring(_js, 1, length(_js) - 1)")
    return x.select(F.when(F.col("_t") == broken_type, cut).otherwise(F.col("_js")).alias("value"))


def quarantine_bad_records(feed: DataFrame) -> DataFrame:
    """Parse permissively; a line that fails keeps its raw text in
    ``_corrupt_record`` and is routed to quarantine, named by the id found
    in the raw text (or null); processing goes on."""
    parsed = feed.select(F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE",
                                                             "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    bad = F.col("j._corrupt_record").isNotNull()
    rid = F.regexp_extract(F.col("j._corrupt_record"), r"\"event_id\":(\d+)", 1)
    return parsed.select(
        F.when(bad, F.when(rid != "", rid.cast("bigint"))).otherwise(F.col("j.event_id")).alias("event_id"),
        (~bad).alias("ok"), F.col("j.event_type").alias("event_type"))
