"""Queries for the streaming rows (R01-R05).  Each runs a Structured
Streaming job to completion over a feed derived from the given tables and
returns its sink; the oracle is the batch SQL of the same operation."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.plans import q_filters, q_sources  # noqa: F401  (oracle strings used below)
from communitylens.plans.registry import ORACLE, query
from communitylens.sources import post_json as pj
from communitylens.sources.tables import Tables
from communitylens.streaming import stream as st

DUPLICATED_TYPE = "view"   # events of this type are delivered twice
BROKEN_TYPE = "error"      # events of this type arrive as damaged JSON


def _ingest_sql():
    return f"""
WITH p AS ({ORACLE['parse_post_json']}), e AS ({ORACLE['extract_entities']})
SELECT p.*, e.entities_hashtag, e.entities_symbol, e.entities_user_mention, e.entities_url, e.entities_media_url,
       e.entities_media_type FROM p JOIN e ON p.id = e.id"""


@query("stream_ingest", _ingest_sql())
def q_r01(spark, d):
    return st.stream_ingest(spark, pj.post_json_feed(Tables(spark, d)))


@query("stream_dedup", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_r02(spark, d):
    ev = Tables(spark, d).events
    again = ev.filter(F.col("event_type") == DUPLICATED_TYPE)
    feed = pj.event_feed(ev, None).select("value").unionByName(pj.event_feed(again, None).select("value"))
    out = st.stream_dedup(spark, feed)
    return out.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


@query("stream_upsert", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_r02_upsert(spark, d):
    """R02 in its upsert form: events delivered twice go into a keyed table."""
    ev = Tables(spark, d).events
    again = ev.filter(F.col("event_type") == DUPLICATED_TYPE)
    feed = pj.event_feed(ev, None).select("value").unionByName(pj.event_feed(again, None).select("value"))
    out = st.stream_upsert(spark, feed)
    return out.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


@query("stream_dedup_for", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_r02_for(spark, d):
    """R02 with a state store that forgets ids a week after their last arrival."""
    ev = Tables(spark, d).events
    again = ev.filter(F.col("event_type") == DUPLICATED_TYPE)
    feed = pj.event_feed(ev, None).select("value").unionByName(pj.event_feed(again, None).select("value"))
    out = st.stream_dedup_for(spark, feed)
    return out.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


@query("stream_quarantine", f"""
SELECT event_id, CASE WHEN event_type = '{BROKEN_TYPE}' THEN 'quarantine' ELSE 'good' END AS sink,
       CASE WHEN event_type = '{BROKEN_TYPE}' THEN NULL ELSE user_id END AS user_id FROM events""")
def q_r03(spark, d):
    good, bad = st.stream_quarantine(spark, pj.event_feed(Tables(spark, d).events, BROKEN_TYPE))
    return (good.select("event_id", F.lit("good").alias("sink"), "user_id")
            .unionByName(bad.select("event_id", F.lit("quarantine").alias("sink"), F.lit(None).cast("bigint").alias("user_id"))))


@query("stream_progress", "SELECT count(*) AS n FROM events")
def q_r04(spark, d):
    return st.stream_progress(spark, pj.event_feed(Tables(spark, d).events, None))


@query("stream_filter", f"SELECT id, status_text FROM ({ORACLE['keyword_track_filter']}) k")
def q_r05(spark, d):
    kw = spark.createDataFrame([(k,) for k in q_filters.TRACKED_KEYWORDS], "keyword string")
    return st.stream_filter(spark, pj.post_json_feed(Tables(spark, d)), kw)
