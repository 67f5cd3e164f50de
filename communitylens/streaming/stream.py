"""Structured Streaming jobs over the post and event feeds.

Every job reads a folder of JSON-line files with the file source, runs to
completion with ``availableNow``, writes a checkpointed sink under the shared
checkpoint folder and returns the sink read back as a batch table.  A
micro-batch holds ``max_bytes`` of input at most; sinks written from
``foreachBatch`` use a folder for each batch and overwrite it, so a batch that is
run again writes the same rows once.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from communitylens.session import scratch_path
from communitylens.sources import post_json as pj
from communitylens.sources import sinks
from communitylens.sources.post_json import EVENT_SCHEMA

FILE_RECORDS = 1_000_000   # records in one landed feed file
MAX_BYTES = 64 << 30       # input of one micro-batch, as it lies in its files


def _run(spark: SparkSession, name: str):
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    return base, f"{base}/feed", f"{base}/out", f"{base}/checkpoint"


def write_feed(lines: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Land a feed as packed JSON-line files, a tenth of their lines; no job
    below depends on their order."""
    lines.select("value").write.mode("append").option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def _source(spark: SparkSession, feed: str, max_bytes: int) -> DataFrame:
    return spark.readStream.option("maxBytesPerTrigger", max_bytes).text(feed)


def _finish(writer, ckpt: str) -> None:
    writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


def ingest_table(parsed: DataFrame) -> DataFrame:
    """Flat post row plus its merged entity lists (blank-joined), in one
    projection."""
    flat = [c for c in parsed.columns if not c.startswith("_")]
    ents = pj.entity_columns()
    arrays = [F.array_join(c, " ").alias(n) for c, n in zip(ents[:4], ("entities_hashtag", "entities_symbol",
                                                                       "entities_user_mention", "entities_url"))]
    return parsed.select(*flat, *arrays, *ents[4:])


def stream_ingest(spark: SparkSession, feed_lines: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Post feed -> parse (S02) + entities (S03) -> parquet table."""
    _, feed, out, ckpt = _run(spark, "ingest")
    write_feed(feed_lines, feed)
    rows = ingest_table(pj.parse_post_json(_source(spark, feed, max_bytes)))
    _finish(rows.writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.parquet(out)


def parse_events(src: DataFrame) -> DataFrame:
    j = src.select(F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE",
                                                      "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return j.select("j.*").withColumn("event_time", F.to_timestamp("ts"))


def dedup_feed(spark: SparkSession, feed: str, out: str, ckpt: str, delay: str | None = None,
               max_bytes: int = MAX_BYTES) -> DataFrame:
    """Deduplicate the event files of a folder into ``out``.

    By default state is keyed by event id and no row is ever late, so the
    result is right in any file order.  ``delay`` bounds the state for a
    caller who knows how late a repeat can come: rows later than that
    behind the watermark are then dropped, and only then."""
    ev = parse_events(_source(spark, feed, max_bytes)).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    once = (ev.dropDuplicates(["event_id"]) if delay is None
            else ev.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"]))
    _finish(once.writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.parquet(out)


def stream_dedup(spark: SparkSession, feed_lines: DataFrame, delay: str | None = None,
                 max_bytes: int = MAX_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """The same event id arriving twice becomes one row."""
    _, feed, out, ckpt = _run(spark, "dedup")
    write_feed(feed_lines, feed, file_records)
    return dedup_feed(spark, feed, out, ckpt, delay, max_bytes)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_feed_for(spark: SparkSession, feed: str, out: str, ckpt: str, keep_seconds: int,
                   max_bytes: int = MAX_BYTES) -> list[dict]:
    """Deduplicate the event files of a folder into ``out`` with state that
    is bounded by arrival (R02).

    The watermark runs on the time at which a row's batch began, so no row is
    ever late, whatever its event time.  A repeat that arrives within
    ``keep_seconds`` of the row that passed is dropped; by twice that time the
    id has left the state store (RocksDB: on the executors' disks, with changes
    in the checkpoint).  Null ids are one key.  Returns for every batch its
    number, its input rows and the keys held after it."""
    ev = parse_events(_source(spark, feed, max_bytes)).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    once = (ev.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", f"{keep_seconds} seconds")
            .dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived"))
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = (once.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "keys": p["stateOperators"][0]["numRowsTotal"]}
            for p in query.recentProgress if p["stateOperators"]]


def stream_dedup_for(spark: SparkSession, feed_lines: DataFrame, keep_seconds: int = 7 * 86400,
                     max_bytes: int = MAX_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """R02 with state that forgets: the same event id arriving twice within
    ``keep_seconds`` becomes one row."""
    _, feed, out, ckpt = _run(spark, "dedup-for")
    write_feed(feed_lines, feed, file_records)
    dedup_feed_for(spark, feed, out, ckpt, keep_seconds, max_bytes)
    return spark.read.parquet(out)


def stream_quarantine(spark: SparkSession, feed_lines: DataFrame, max_bytes: int = MAX_BYTES
                      ) -> tuple[DataFrame, DataFrame]:
    """Good records to the table, broken ones to a quarantine sink (two
    writes of one parsed micro-batch); processing goes on."""
    base, feed, _, ckpt = _run(spark, "quarantine")
    good_path, bad_path = f"{base}/good", f"{base}/quarantine"
    write_feed(feed_lines, feed)
    parsed = parse_events(_source(spark, feed, max_bytes))

    def write_both(batch: DataFrame, epoch_id: int):
        batch.persist()
        bad = F.col("_corrupt_record").isNotNull()
        rid = F.regexp_extract(F.col("_corrupt_record"), r"\"event_id\":(\d+)", 1)
        (batch.filter(~bad).drop("_corrupt_record").write.mode("overwrite").parquet(f"{good_path}/epoch={epoch_id}"))
        (batch.filter(bad).select(F.when(rid != "", rid.cast("bigint")).alias("event_id"),
                                  F.col("_corrupt_record").alias("raw"))
         .write.mode("overwrite").parquet(f"{bad_path}/epoch={epoch_id}"))
        batch.unpersist()

    _finish(parsed.writeStream.foreachBatch(write_both), ckpt)
    return spark.read.parquet(good_path), spark.read.parquet(bad_path)


class _Rows(StreamingQueryListener):
    """Collects the observed row count of each micro-batch of one query."""

    def __init__(self, metric: str):
        self.metric, self.batches, self.done, self.run = metric, {}, threading.Event(), None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        row = p.observedMetrics.get(self.metric)
        if row is not None:
            self.batches[int(p.batchId)] = int(row["n"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run is None or str(event.runId) == self.run:
            self.done.set()


def progress_by_batch(spark: SparkSession, feed_lines: DataFrame, max_bytes: int = MAX_BYTES,
                      file_records: int = FILE_RECORDS) -> DataFrame:
    """(batch, n, total): the records of each micro-batch and the running
    total.  Rows are counted by an observed metric as the batch passes, without
    an aggregate of their own and without state; a listener gets the counts,
    one number a batch."""
    _, feed, out, ckpt = _run(spark, "progress")
    write_feed(feed_lines, feed, file_records)
    metric = f"rows_{uuid.uuid4().hex[:8]}"
    seen = _Rows(metric)
    spark.streams.addListener(seen)
    try:
        lines = _source(spark, feed, max_bytes).observe(metric, F.count(F.lit(1)).alias("n"))
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        seen.run = str(query.runId)
        query.awaitTermination()
        if not seen.done.wait(60):
            raise RuntimeError("the stream's progress did not arrive")
    finally:
        spark.streams.removeListener(seen)
    rows, total = [], 0
    for batch in sorted(seen.batches):
        total += seen.batches[batch]
        rows.append((batch, seen.batches[batch], total))
    return spark.createDataFrame(rows, "batch long, n long, total long")


def stream_progress(spark: SparkSession, feed_lines: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The number of processed records after the last batch."""
    return progress_by_batch(spark, feed_lines, max_bytes).agg(F.coalesce(F.max("total"), F.lit(0).cast("long")).alias("n"))


def upsert_feed(spark: SparkSession, feed: str, table: str, ckpt: str, buckets: int, max_bytes: int = MAX_BYTES) -> None:
    """R02 as an upsert: every micro-batch of the event files in ``feed`` goes
    into the keyed table by event id, the latest event time winning.  No state
    is kept between batches but the table itself, and a batch that runs again
    changes nothing."""
    ev = parse_events(_source(spark, feed, max_bytes)).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")

    def into(batch: DataFrame, epoch_id: int):
        sinks.upsert_into(table, batch, "event_id", "event_time", buckets)

    _finish(ev.writeStream.foreachBatch(into), ckpt)


def stream_upsert(spark: SparkSession, feed_lines: DataFrame, buckets: int = 64, max_bytes: int = MAX_BYTES,
                  file_records: int = FILE_RECORDS) -> DataFrame:
    """The same event id arriving twice becomes one row of a table."""
    _, feed, out, ckpt = _run(spark, "upsert")
    write_feed(feed_lines, feed, file_records)
    none = parse_events(spark.createDataFrame([], "value string")).drop("_corrupt_record")
    spark.createDataFrame([], none.withColumn("_bucket", F.lit(0)).schema).write.parquet(out)
    upsert_feed(spark, feed, out, ckpt, buckets, max_bytes)
    return spark.read.schema(none.withColumn("_bucket", F.lit(0)).schema).parquet(out).drop("_bucket")


def stream_filter(spark: SparkSession, feed_lines: DataFrame, keywords: DataFrame, langs=("en",),
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """F08 + F09 on the post feed: language filter, then a stream-static
    semi join of the text tokens with the tracked keyword table.  The keywords
    go to the posts: a track list is short, the feed's words do not move."""
    _, feed, out, ckpt = _run(spark, "filter")
    write_feed(feed_lines, feed)
    src = _source(spark, feed, max_bytes)
    parsed = pj.parse_post_json(src).select("id", "lang", "status_text").filter(F.col("lang").isin(*langs))
    toks = parsed.select("id", "status_text", F.explode(F.split(F.lower("status_text"), r"\s+")).alias("keyword"))
    tracked = keywords.select(F.lower("keyword").alias("keyword")).distinct()
    hits = toks.join(F.broadcast(tracked), "keyword", "left_semi")
    _finish(hits.select("id", "status_text").writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.parquet(out).distinct()
