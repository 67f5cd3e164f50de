"""WARC archives: writing, reading back, and a merged capture index.

Records are written by Spark's own text sink, a gzip file for each partition,
into the shared folder: a record is a header, an empty line and its payload,
and the sink's line separator is the two line ends that close a record.  An archive
read back gives a run of index entries sorted by URL key and time; runs are
dealt by ranges of that order and each task merges its share of every run
with a loser tree, so the ranges one after the other are the capture
histories in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import reliable, text_or_empty
from communitylens.session import ensure_checkpoint_dir, scratch_path

RECORD_END = "\r\n\r\n"
#: Bytes of an archive before it is zipped: it ends with the record that
#: reaches them.
ARCHIVE_BYTES = 32 << 20
#: Index entries of one range of the merge, about.
ENTRIES_PER_RANGE = 200_000
#: Parts that the rows of one digest are spread over.
SALTS = 16
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels turned round, then path and query;
    scheme, port 80/443, a leading www, case of the host and the fragment
    do not count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # not a URL: the text as it stands
        return url
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    at = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(labels[::-1]) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    """The tables have no capture time: one second for each page id."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, html: str, digest: str, original: int | None, revisit: bool) -> str:
    """One record without its closing line ends.  A revisit has no payload;
    it names the record and page that hold it, and the payload's length."""
    payload, size = "" if revisit else html, len(html.encode("utf-8", "surrogatepass"))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
            f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Date: {capture_time(page_id)}",
            f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{original}')}>")
        head += [f"WARC-Refers-To-Page-ID: {original}", f"WARC-Payload-Length: {size}"]
    head += ["Content-Type: text/html", f"Content-Length: {0 if revisit else size}"]
    return "\r\n".join(head) + "\r\n\r\n" + payload


def revisits(rows: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(v_id, v_sha, original) of the rows (page_id, sha, size) that revisit
    another one.  Rows of one digest meet its largest id in ``SALTS`` parts."""
    keyed = rows.where((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("page_id", "sha").agg(F.lit(1).alias("one"))
    copies = (keyed.groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("sha", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return (keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(copies, ["sha", "salt"])
            .where("page_id <> original").select(F.col("page_id").alias("v_id"), F.col("sha").alias("v_sha"), "original"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row of ``pages``.  Of equal payloads the row with
    the largest page_id is the response, the others revisit it; rows of that
    same id and payload are responses all of them, and so is a row
    without id.  Which rows revisit is found on ids and digests alone; texts
    move by id, not by digest.  A task begins a new archive where one has
    ``archive_bytes``."""
    sha = F.sha1(text_or_empty("html").cast("binary"))
    gone = revisits(pages.select("page_id", sha.alias("sha"), F.octet_length(text_or_empty("html")).alias("size")), min_revisit_bytes)
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"), sha.alias("sha"))
    typed = rows.join(gone, (F.col("page_id") == F.col("v_id")) & (F.col("sha") == F.col("v_sha")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, filled = 0, 0
        for b in batches:
            out, volumes = [], []
            for i, u, h, o in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "original"))):
                if filled >= archive_bytes:
                    volume, filled = volume + 1, 0
                out.append(record(i, u, h, sha1_base32(h.encode("utf-8", "surrogatepass")), o, o is not None))
                volumes.append(volume)
                filled += len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(out, pa.string())], names=["volume", "value"])
    (typed.select("page_id", "url", "html", "original").mapInArrow(run, "volume int, value string")
     .write.partitionBy("volume").option("lineSep", RECORD_END).option("compression", "gzip").text(path))


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive (its bytes after unzipping) in file order; a
    payload whose digest differs from its header's is an error."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        payload = bytes(view[start:start + size])
        if len(payload) != size or data[start + size:start + size + 4] != b"\r\n\r\n" or lines[0] != "WARC/1.1":
            raise ValueError(f"broken record at byte {at}")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and sha1_base32(payload) != digest:
            raise ValueError(f"payload at byte {start} does not have its digest")
        page, refers = head["WARC-Page-ID"].strip(), head.get("WARC-Refers-To-Page-ID", "").strip()
        yield {"page_id": int(page) if page else None, "url_key": url_key(head["WARC-Target-URI"]),
               "captured": head["WARC-Date"], "record_type": kind, "payload_digest": digest,
               "payload_bytes": int(head.get("WARC-Payload-Length", size)), "refers_to": int(refers) if refers else None,
               "offset": at, "length": start + size + 4 - at}
        at = start + size + 4


ENTRY = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()),
                   ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                   ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("archive", pa.string())])
ENTRY_SQL = ("page_id long, url_key string, captured string, record_type string, payload_digest string, "
             "payload_bytes long, refers_to long, offset long, length long, archive string")


def _order(e: dict) -> tuple:
    return (e["url_key"].encode("utf-8", "surrogatepass"), e["captured"], e["page_id"] is None, e["page_id"] or 0,
            e["archive"], e["offset"])


def read_runs(spark, path: str) -> DataFrame:
    """Index entries of all archives in a folder; those of one archive are a
    sorted run.  Offsets count unzipped bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                archive = "/".join(name.rsplit("/", 2)[-2:])
                data = gzip.decompress(content.as_py())
                entries = sorted((e | {"archive": archive} for e in parse_archive(data)), key=_order)
                yield from pa.Table.from_pylist(entries, ENTRY).to_batches()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ENTRY_SQL)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next
    entry costs one replay from its run's leaf to the root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.heads = [self._head(i) for i in range(len(runs))]
        self.losers = [0] * self.k
        self.winner = self._play(1) if runs else None

    def _head(self, i: int):
        return (False, self.key(self.runs[i][self.at[i]]), i) if self.at[i] < len(self.runs[i]) else (True, (), i)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.winner is not None and not self.heads[self.winner][0]:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            node = (w + self.k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[w]:
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """``_order`` of every entry of a batch."""
    columns = [batch.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive", "offset")]
    return [(u.encode("utf-8", "surrogatepass"), t, p is None, p or 0, a, o) for u, t, p, a, o in zip(*columns)]


def merge_runs(entries: DataFrame, parts: int | None = None, entries_per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """The entries in global order of URL key, time and page id: ranges of
    that order are partitions, as many as the entries need, and inside each
    the archives' runs are merged.  A hot URL is split like any range, since
    time and id are part of the order.  Entries stay Arrow columns; the tree
    plays with their keys.  Nothing is sorted here: an archive whose entries
    came in pieces out of order would be several runs.  Further columns of the
    entries stay beside them."""
    spark = entries.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // entries_per_range))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, runs, open_run, n = [], [], {}, 0
        for b in batches:
            held.append(b)
            for key in _keys(b):
                mine = open_run.get(key[4])
                if mine is None or mine[-1][0] > key:
                    mine = open_run[key[4]] = []
                    runs.append(mine)
                mine.append((key, n))
                n += 1
        if not n:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order = [at for _, at in LoserTree(runs, lambda e: e[0])]
        for at in range(0, n, 8192):
            yield from table.take(pa.array(order[at:at + 8192], pa.int64())).to_batches()
    return (entries.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "offset")
            .mapInArrow(run, entries.schema))


def capture_histories(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages``, read the archives back, merge their indexes; the
    rows come in global order of URL key, time and page id.

    One row for each row of ``pages``: the index entry with payload_bytes and
    payload_digest of the full payload and refers_to (page id of the response
    that a revisit refers to); a revisit's record says all three.  A null html
    is an empty payload, a null url an empty URL; repeated rows are records
    of their own; a page of any length is one record, in an archive of its own
    if need be; an empty table gives no rows."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex[:12]}")
    write_archives(pages, path, min_revisit_bytes, archive_bytes)
    if pages.isEmpty():  # no folders
        return spark.createDataFrame([], ENTRY_SQL)
    return merge_runs(reliable(read_runs(spark, path)))
