"""Keyed tables, files by name, and streams that write them."""

import os
import time

from communitylens.session import scratch_path
from communitylens.sources import named_files as nf
from communitylens.sources import sinks
from communitylens.streaming import stream as st


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark):
    path = scratch_path(spark, "keyed-test")
    old = spark.range(500).selectExpr("id AS k", "0 AS version", "CAST(id AS string) AS v")
    sinks.create_keyed_table(old, path, "k", 16)
    before = _files(path)
    new = spark.createDataFrame([(7, 1, "new"), (7, 2, "newest"), (900, 1, "added"), (8, -1, "stale")], "k long, version int, v string")
    touched = sinks.upsert_into(path, new, "k", "version", 16)
    once = {r.k: (r.version, r.v) for r in sinks.read_keyed_table(spark, path).collect()}
    assert len(once) == 501 and once[7] == (2, "newest") and once[900] == (1, "added") and once[8] == (0, "8")
    same = before & _files(path)
    assert same == {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched} and len(touched) <= 3
    sinks.upsert_into(path, new, "k", "version", 16)  # a batch that runs again
    assert {r.k: (r.version, r.v) for r in sinks.read_keyed_table(spark, path).collect()} == once
    assert sinks.upsert_into(path, new.limit(0), "k", "version", 16) == []


def test_upsert_feed_in_any_order_with_restarts(spark):
    base = scratch_path(spark, "upsert-test")
    lines = [f'{{"event_id": {i}, "ts": "2024-01-0{1 + i % 5} 00:00:0{k}", "user_id": {k}, "event_type": "t", "value": 1.0, "props": ""}}'
             for i in range(30) for k in ((1, 0) if i % 2 else (0, 1))]
    schema = st.parse_events(spark.createDataFrame([], "value string")).drop("_corrupt_record").selectExpr("*", "0 AS _bucket").schema
    spark.createDataFrame([], schema).write.parquet(f"{base}/table")
    for part in (lines[30:], lines[:30], lines[10:50]):  # out of order, and many rows twice; the stream restarts
        st.write_feed(spark.createDataFrame([(x,) for x in part], "value string"), f"{base}/feed", 7)
        st.upsert_feed(spark, f"{base}/feed", f"{base}/table", f"{base}/checkpoint", 4)
    got = spark.read.schema(schema).parquet(f"{base}/table").collect()
    assert sorted(r.event_id for r in got) == list(range(30)) and {r.user_id for r in got} == {1}


def test_dedup_by_arrival_forgets_and_restarts(spark):
    base = scratch_path(spark, "dedup-for-test")

    def land(ids, day):
        lines = [(f'{{"event_id": {i}, "ts": "2024-01-{day:02d} 00:00:00", "user_id": 1, "event_type": "t", "value": 1.0, "props": ""}}',) for i in ids]
        st.write_feed(spark.createDataFrame(lines, "value string"), f"{base}/feed", 11)

    def run(keep):
        return st.dedup_feed_for(spark, f"{base}/feed", f"{base}/out", f"{base}/checkpoint", keep)

    land([*range(40), *range(40)], 20)
    run(3)
    land([*range(20, 60)], 1)  # after a restart: repeats with a far earlier event time, and new ids as early
    run(3)
    assert sorted(r.event_id for r in spark.read.parquet(f"{base}/out").collect()) == list(range(60))
    time.sleep(8)
    held = []
    for k in range(3):  # the store does not grow: the first sixty ids leave it
        land([100 + k], 1)
        held.append(run(3)[-1]["keys"])
    assert held[-1] <= 3 and spark.read.parquet(f"{base}/out").count() == 63


def test_progress_by_batch_adds_up(spark):
    feed = spark.range(95).selectExpr("CAST(id AS string) AS value").repartition(1)
    rows = st.progress_by_batch(spark, feed, max_bytes=60, file_records=10).orderBy("batch").collect()
    assert len(rows) > 1 and sum(r.n for r in rows) == 95 and rows[-1].total == 95


def test_named_files_round_trip(spark):
    path = scratch_path(spark, "names-test")
    odd = "a/b ü%.txt"
    lines = [(odd, 2, "last\nline"), (odd, 0, "first"), ("u2", 0, None), (None, 0, "x")] + [(f"n{i}", 0, str(i)) for i in range(40)]
    nf.write_named_files(spark.createDataFrame(lines, "name string, place long, value string").repartition(4), path)
    local = path.removeprefix("file:")
    os.makedirs(f"{local}/part-lost")  # what a lost attempt leaves is not read
    with open(f"{local}/part-lost/n1", "w") as f:
        f.write("twice\n")
    got = [(r.name, r.place, r.value) for r in nf.read_named_files(spark, path).collect()]
    assert len(got) == 43 and {g for g in got if not g[0].startswith("n")} == {(odd, 0, "first"), (odd, 1, "last line"), ("u2", 0, "")}


def test_user_corpus_and_class_lists(spark):
    path = scratch_path(spark, "corpus-test")
    posts = spark.createDataFrame([(5, 2, "rt", "b | c"), (5, 1, "ot", "a"), (6, 9, "ot", "")], "user long, post_id long, kind string, text string")
    nf.write_user_corpus(posts, path)
    heads = {(r.name, r.value) for r in nf.read_named_files(spark, path).where("place = 0").collect()}
    assert heads == {("5", "5"), ("6", "6")}
    assert sorted(map(tuple, nf.read_user_corpus(spark, path).collect())) == [("5", "ot", "a"), ("5", "rt", "b | c"), ("6", "ot", "")]
    path = scratch_path(spark, "lists-test")
    lists = spark.createDataFrame([("any", "en", f"w{k}", float(-k), k) for k in range(1, 9)], "pos string, class string, word string, score double, rank int")
    nf.write_class_dictionary_files(lists, path, 6)
    assert sorted(map(tuple, nf.read_class_dictionary_lists(spark, path, 3).collect())) == [("any", "en", f"w{k}", float(-k)) for k in (1, 2, 3)]
