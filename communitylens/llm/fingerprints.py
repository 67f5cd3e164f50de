"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct shingle hashes of a text.  Sketches merge
by keeping the k smallest of their union, so parts of a text or of a corpus
can be sketched apart; they estimate resemblance, containment and the number of
distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communitylens.llm.common import pieces, text_or_empty
from communitylens.llm.shingles import BATCH_BYTES, WIDTH, distinct, in_batches, shingle_batch

K = 128
#: Characters in one range of ids, and most ranges (as a range
#: partitioning, their bounds live on the driver).
RANGE_CHARS = 4_000_000
MAX_RANGES = 10_000
_NONE = np.zeros(0, dtype=np.uint64)


def sketches(texts: list[str | None], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text: sorted, distinct, k hashes at most."""
    flat, counts = shingle_batch(texts, width)
    return [distinct(part)[:k] for part in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what was sketched."""
    parts = list(parts)
    return distinct(np.concatenate(parts))[:k] if parts else _NONE


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's k smallest
    hashes that both have; exact while the union has at most k.  Two texts
    without shingles are alike, one without is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge((a, b), k)
    return float(np.isin(both, a).astype(int) @ np.isin(both, b).astype(int)) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct_count(merge((a, b), k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    """A sketch as base64 of its little-endian 64-bit hashes; empty: ''."""
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u8").astype(np.uint64)


def group_sketches(docs: DataFrame, by: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """(group, fingerprint, n_shingles): one merged sketch for each value of
    column ``by``.  The sketches of an Arrow batch are merged by group, and a
    task's k smallest of a group are picked before the shuffle, so a hot group
    of copies sends k hashes a batch at most.  Null is a group of its own; a
    null or blank text brings no shingle (a group of those alone has an empty
    sketch), a repeated row changes nothing, no rows give no groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for texts in in_batches(t.as_py() for t in b.column("text")) for x in sketches(texts, k, width)]
            groups: dict[str | None, list[np.ndarray]] = {}
            for g, x in zip(b.column("grp").to_pylist(), got):
                groups.setdefault(g, []).append(x)
            signed = [(merge(x, k) ^ np.uint64(1 << 63)).view(np.int64) for x in groups.values()]  # order as unsigned
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.string()), pa.array(signed, pa.list_(pa.int64()))],
                                             names=["grp", "hashes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.sort(np.array(x.as_py(), np.int64).view(np.uint64) ^ np.uint64(1 << 63)) for x in b.column("hashes")]
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array([to_text(x) for x in got]),
                                              pa.array([distinct_count(x, k) for x in got])],
                                             names=["grp", "fingerprint", "n_shingles"])
    rows = docs.select(F.col(by).cast("string").alias("grp"), "text").mapInArrow(run, "grp string, hashes array<long>")
    rank = Window.partitionBy("grp").orderBy(F.col("hash").asc_nulls_last())  # a null stands for no shingle
    low = (rows.select("grp", F.explode_outer("hashes").alias("hash")).withColumn("rn", F.dense_rank().over(rank))
           .where(F.col("rn") <= k).groupBy("grp").agg(F.collect_set("hash").alias("hashes")))
    return low.mapInArrow(pack, "grp string, fingerprint string, n_shingles double")


# --- a document, its edited text and the next document --------------------------

def edited(text: str, following: str) -> str:
    """The last third of a text (floor) replaced by as much of the next."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def _compare(rows: list[tuple[int | None, str]], k: int, width: int) -> pa.RecordBatch:
    """Result rows for all but the last of consecutive documents."""
    texts = [t for _, t in rows]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, other = sketches(texts, k, width), sketches(changed, k, width)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([d for d, _ in rows[:-1]], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                                  pa.string()),
        "fingerprint": pa.array([to_text(s) for s in own[:-1]], pa.string()),
        "edited_fingerprint": pa.array([to_text(s) for s in other], pa.string()),
        "near_edited": pa.array([resemblance(a, b, k) for a, b in zip(own, other)], pa.float64()),
        "near_next": pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64())})


def compare_with_next(docs: DataFrame, k: int = K, width: int = WIDTH, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id; after the last
    one comes the first.  Null ids come last; rows of one id follow by a hash of their text.
    A null text is the empty text; a single row is its own next.

    Texts move once, to ranges of ids.  The first document of each range goes
    to the range before it as well, so that each range is a stream that
    holds every document's successor and a task keeps one batch in memory."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    n = min(MAX_RANGES, pieces(rows, F.length("text") + 1, range_chars))
    bounds: list[int] = []
    if n > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []))

    def ranges(ids: pa.Array) -> np.ndarray:
        """0 for the highest ids; null ids lie in the last range."""
        got = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds), got)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranges(b.column("doc_id")).astype(np.int32)), b.column("doc_id")],
                                             names=["rng", "doc_id"])
    heads = {r.rng: r.top for r in rows.select("doc_id").mapInArrow(tops, "rng int, doc_id long")
             .groupBy("rng").agg(F.max("doc_id").alias("top")).collect()}  # a row for each range
    filled = sorted(heads)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}  # the first range comes after the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = ranges(b.column("doc_id"))
            ids = b.column("doc_id").to_pylist()
            guest = [i for i, (d, r) in enumerate(zip(ids, at.tolist())) if heads[r] == d]
            take = pa.array(np.concatenate((np.arange(len(ids)), np.array(guest, dtype=np.int64))).astype(np.int64))
            rng = np.concatenate((at, [before[at[i]] for i in guest])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rng), pa.array(np.arange(len(rng)) >= len(ids)), b.column("doc_id").take(take),
                 b.column("text").take(take)], names=["rng", "guest", "doc_id", "text"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, closed, here = 0, True, None
        for b in batches:
            for rng, guest, d, t in zip(b.column("rng").to_pylist(), b.column("guest").to_pylist(),
                                        b.column("doc_id").to_pylist(), b.column("text")):
                if rng != here:
                    held, size, closed, here = [], 0, False, rng
                if closed:
                    continue  # further rows of the next range's first id
                held.append((d, t.as_py()))
                size += len(held[-1][1])
                if guest or size >= BATCH_BYTES and len(held) > 1:
                    yield _compare(held, k, width)
                    held, size, closed = held[-1:], 0, guest
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return (rows.mapInArrow(deal, "rng int, guest boolean, doc_id long, text string")
            .repartition(max(1, len(filled)), "rng")
            .sortWithinPartitions("rng", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
            .mapInArrow(stream, schema))
