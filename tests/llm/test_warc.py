"""WARC round trip, revisits and the merged index."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from communitylens.llm import warc
from communitylens.session import scratch_path

SCHEMA = "page_id long, url string, html string, archive string"


def pages():
    rng = random.Random(6)
    bodies = ["", None, "<p>é</p>", "a\r\n\r\nb", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nx", "z" * 300_000, "<p>same</p>"]
    rows = [(i, f"http://www.Host{i % 5}.example.org/p/{i % 11}?q={i % 3}#f", bodies[i % 8] if i % 3 else f"<p>{rng.random()}</p>",
             "x") for i in range(120)]
    return rows + [(500, None, "<p>same</p>", ""), (501, "not a url\n at: all", "", ""), (502, "http://[bad", "q", None), rows[7]]


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def expected(rows, least=0):
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h, _ in rows:
        n = len((h or "").encode())
        again = i != last[h or ""] and n >= least
        out.append((i, n, digest(h), "revisit" if again else "response", last[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(5)
    got = warc.capture_histories(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages(), least)


def test_archives_hold_the_payloads(spark):
    path = scratch_path(spark, f"warc-test-{random.random()}")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), path)
    want = {(i, digest(h)) for i, _, h, _ in pages()}
    seen = set()
    for f in spark.read.format("binaryFile").load(path).collect():
        data = gzip.decompress(bytes(f.content))
        for e in warc.parse_archive(data):
            assert data[e["offset"]:].startswith(b"WARC/1.1\r\n")
            seen.add((e["page_id"], e["payload_digest"]))
    assert seen == want


def test_broken_archives_are_errors():
    good = (warc.record(1, "http://a/", "body", warc.sha1_base32(b"body"), None, False) + warc.RECORD_END).encode()
    assert len(list(warc.parse_archive(good * 2))) == 2
    for bad in (good[:-1], good.replace(b"body", b"bodx"), b"XARC" + good[4:]):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse_archive(bad))


def test_merged_index_is_in_global_order(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(6)
    rows = [r.asDict() for r in warc.merge_runs(warc.read_runs(spark, _written(spark, df)), 5)
            .withColumn("part", F.spark_partition_id()).collect()]
    assert len(rows) == len(pages())
    order = [warc._order(r) for r in sorted(rows, key=lambda r: r["part"])]  # sorted() keeps order inside a part
    assert order == sorted(order) and len({r["part"] for r in rows}) > 1


def test_capture_histories_are_in_global_order(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(6)
    off = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k in off:
            spark.conf.set(k, "-1")
        rows = [r.asDict() for r in warc.capture_histories(df).withColumn("part", F.spark_partition_id()).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(pages()) and len({r["part"] for r in rows}) > 1
    order = [warc._order(r) for r in sorted(rows, key=lambda r: r["part"])]
    assert order == sorted(order)


def _written(spark, df):
    path = scratch_path(spark, f"warc-test-{random.random()}")
    warc.write_archives(df, path)
    return path


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.choice([0, 1, 7, 30]))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("https://m.x.org:8080") == "org,x,m:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_null_id_and_no_rows(spark):
    df = spark.createDataFrame([(None, "http://a/", "x", ""), (3, "http://a/", "x", ""), (2, "http://a/", "x", "")], SCHEMA)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.capture_histories(df).collect()}
    assert got == {(None, "response", None), (3, "response", None), (2, "revisit", 3)}
    assert warc.capture_histories(df.limit(0)).count() == 0


def test_runs_reach_the_merge_in_order(spark):
    """Every archive is one run of each range, with no join between that could
    mix its entries."""
    rows = pages() + [(10_000 + i, f"http://h{i % 7}.org/{i}", f"text {i % 50}", "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    path = scratch_path(spark, f"warc-test-{random.random()}")
    warc.write_archives(df, path, archive_bytes=4000)
    entries = warc.read_runs(spark, path)
    assert entries.select("archive").distinct().count() > 12  # archives end by bytes

    def disorder(batches):
        import pyarrow as pa
        last, bad, n = {}, 0, 0
        for b in batches:
            for key in warc._keys(b):
                bad += key < last.get(key[4], key)
                last[key[4]] = key
                n += 1
        yield pa.RecordBatch.from_pydict({"bad": [bad], "n": [n]})
    got = (entries.repartitionByRange(5, "url_key", "captured", "page_id", "archive", "offset").mapInArrow(disorder, "bad long, n long")
           .selectExpr("sum(bad) AS bad", "sum(n) AS n").first())
    assert got.bad == 0 and got.n == len(rows)


def test_hot_digest_and_long_page(spark):
    rows = [(i, "http://a/", "same text", "") for i in range(400)] + [(900, "http://b/", "x" * 3_000_000, ""), (901, "http://b/", "y", "")]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in
           warc.capture_histories(spark.createDataFrame(rows, SCHEMA), archive_bytes=1000).collect()}
    assert got == {i: ("revisit", 399, 9) for i in range(399)} | {399: ("response", None, 9), 900: ("response", None, 3_000_000),
                                                                  901: ("response", None, 1)}
