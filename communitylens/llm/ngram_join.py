"""N-gram Jaccard join: which documents share most of their word shingles.

MinHash signatures are cut into bands; documents that agree in a band meet
in its bucket.  Documents with the same shingle set are one class and travel
as one row.  Bucket members are dealt to blocks of bounded size, near
members to the same block, and each pair of blocks that share a bucket is
verified by one task on the full shingle sets, so that each pair of classes
is verified once, whatever number of bands it shares, and no pair is ever a
row.  What comes out of a task is, for each class, the number of its links
and one edge to its group's smallest class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import reliable
from communitylens.llm.components import components
from communitylens.llm.shingles import WIDTH, distinct, in_batches, mix64, shingle_batch
from communitylens.session import ensure_checkpoint_dir

THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold meets in some band.
RECALL = 0.9999
MAX_HASHES = 128
#: Classes in one block, about; a task compares two blocks at most.
BLOCK = 512
SEED = 20_240_601


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that the bands needed
    for the recall at the threshold, 1 - (1 - t^rows)^bands, fit the hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError("no band shape reaches this recall with so few hashes")
    return best


def band_hashes(flat: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket ids, one row of ``bands`` for each text that has shingles."""
    rng = np.random.default_rng(SEED)
    flip = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)
    mult = rng.integers(0, 2**64, bands * rows, dtype=np.uint64) | np.uint64(1)
    counts = counts[counts > 0]
    first = np.cumsum(counts) - counts
    out = np.empty((len(counts), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(counts), b + 1, dtype=np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ flip[i]) * mult[i], first))
        out[:, b] = h
    return out


def _signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, cls, bands): cls is a 128-bit digest of the shingle
    set, null for a text without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sigs, done = [], [], 0
            for texts in in_batches(t.as_py() for t in b.column("text")):
                flat, counts = shingle_batch(texts, width)
                sig = iter(band_hashes(flat, counts, bands, rows).view(np.int64).tolist() if len(flat) else [])
                at = 0
                for n in counts.tolist():
                    keys.append(xxhash.xxh3_128_digest(distinct(flat[at:at + n]).tobytes()) if n else None)
                    sigs.append(next(sig) if n else None)
                    at += n
                done += len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "text_key", "cls", "bands"])
    return (docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
            .mapInArrow(run, "doc_id long, text_key long, cls binary, bands array<long>"))


def _payload(docs: DataFrame, width: int) -> DataFrame:
    """(cls, shingles): distinct shingle hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [], []
            for texts in in_batches(t.as_py() for t in b.column("text")):
                flat, counts = shingle_batch(texts, width)
                for part in np.split(flat, np.cumsum(counts)[:-1]):
                    s = distinct(part).tobytes()
                    keys.append(xxhash.xxh3_128_digest(s) if s else None)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                             names=["cls", "shingles"])
    return docs.select("text").mapInArrow(run, "cls binary, shingles binary").where("cls IS NOT NULL")


def linked(sets: list[np.ndarray], left: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: a boolean matrix.  ``left`` marks one
    side where two blocks meet; if all or none are marked, all pairs count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1          # a shingle of one set only joins nothing
    keep = shared[column]
    who, column = who[keep], (np.cumsum(shared) - 1)[column[keep]]
    common = np.zeros((n, n), dtype=np.float32)
    step = 2048
    for c in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (c, c + step))
        x = np.zeros((n, step), dtype=np.float32)
        x[who[a:b], column[a:b] - c] = 1
        common += x @ x.T
    common = common.astype(np.float64)
    ok = common / (sizes[:, None] + sizes[None, :] - common) >= threshold
    np.fill_diagonal(ok, False)
    if left.any() and not left.all():
        ok &= left[:, None] != left[None, :]
    return ok


def _verify(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        cls, copies = group.column("cls").to_pylist(), np.array(group.column("copies").to_pylist())
        order = sorted(range(len(cls)), key=cls.__getitem__)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()]
        side = np.array(group.column("blk").to_pylist()) == group.column("lo")[0].as_py()
        cls, copies = [cls[i] for i in order], copies[order]
        ok = linked([sets[i] for i in order], side[order], threshold)
        label, n = np.arange(len(cls)), len(cls)
        while True:
            low = np.minimum(label, np.where(ok, label[None, :], n).min(axis=1, initial=n))
            if (low == label).all():
                break
            label = low
        hit = np.flatnonzero(ok.any(axis=1))
        return pa.table({"cls": pa.array([cls[i] for i in hit], pa.binary()),
                         "root": pa.array([cls[label[i]] for i in hit], pa.binary()),
                         "classes": pa.array(ok.sum(axis=1)[hit], pa.int64()),
                         "docs": pa.array((ok @ copies)[hit], pa.int64())})
    return run


def class_links(docs: DataFrame, signatures: DataFrame, width: int, threshold: float, block: int
                ) -> tuple[DataFrame, DataFrame]:
    """(classes, links): every shingle-set class with copies and smallest
    doc_id; per class with links (cls, root, classes, docs) rows that each
    count the verified links of one pair of blocks."""
    classes = reliable(signatures.where("cls IS NOT NULL").groupBy("cls")
                       .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("min_id"),
                            F.any_value("bands").alias("bands")))
    in_bucket = classes.select("cls", F.explode("bands").alias("bucket"))
    buckets = (in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("lead"))
               .where("n > 1").select("bucket", "lead"))
    members = reliable(in_bucket.join(buckets, "bucket"))
    # near members get the same lead: the smallest class met, one step on
    lead = members.groupBy("cls").agg(F.min("lead").alias("lead"))
    lead = reliable(lead.join(lead.select(F.col("cls").alias("lead"), F.col("lead").alias("far")), "lead", "left")
                    .select("cls", F.coalesce("far", "lead").alias("lead")))
    split = lead.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    blocks = (lead.join(split, "lead")
              .select("cls", F.xxhash64("lead", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("blk")))
    placed = members.select("bucket", "cls").join(blocks, "cls")
    present = (placed.groupBy("bucket", "blk").agg(F.count(F.lit(1)).alias("n"))
               .select("bucket", F.col("blk").alias("other"), "n"))
    tasks = reliable(placed.join(present, "bucket").where("blk != other OR n > 1")
                     .select(F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "cls", "blk")
                     .distinct())
    meeting = tasks.select("cls").distinct().join(classes.select("cls", "copies", "min_id"), "cls")
    wanted = meeting.select("min_id").distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("min_id")), "left_semi")
    sets = _payload(texts, width).dropDuplicates(["cls"]).join(meeting.select("cls", "copies"), "cls")
    links = (tasks.join(sets, "cls").groupBy("lo", "hi")
             .applyInArrow(_verify(threshold), "cls binary, root binary, classes long, docs long"))
    return classes, reliable(links)


def _verdicts(docs: DataFrame, threshold: float, width: int, recall: float, block: int) -> DataFrame:
    """Per row: doc_id, text_key, root (null without words), class_id,
    set_id, n_links, n_linked_sets."""
    ensure_checkpoint_dir(docs.sparkSession)
    bands, rows = band_shape(threshold, recall)
    signatures = reliable(_signatures(docs, width, bands, rows))
    classes, links = class_links(docs, signatures, width, threshold, block)
    counts = links.groupBy("cls").agg(F.sum("classes").alias("classes"), F.sum("docs").alias("docs"))
    roots = components(links, "cls", "root")
    grouped = (classes.select("cls", "copies", "min_id").join(roots, F.col("cls") == F.col("node"), "left")
               .select("cls", "copies", "min_id", F.coalesce("root", "cls").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("min_id").alias("class_id"))
    verdict = (grouped.join(smallest, "root").join(counts, "cls", "left")
               .select("cls", "root", "class_id", F.col("min_id").alias("set_id"),
                       (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("classes", F.lit(0)).cast("long").alias("n_linked_sets")))
    blank = signatures.where("cls IS NULL").select(
        "doc_id", "text_key", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_linked_sets"))
    return (signatures.where("cls IS NOT NULL").select("doc_id", "text_key", "cls").join(verdict, "cls")
            .select(blank.columns).unionByName(blank))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL,
                 block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, set_id, n_links, n_linked_sets.

    ``set_id`` is the smallest doc_id with the same shingle set, ``class_id``
    the smallest one that chains of links reach, ``n_links`` the number of
    other rows whose Jaccard similarity with this one is at least
    ``threshold`` (rows of the same set included), ``n_linked_sets`` the
    number of different sets among them.

    Words are lower-cased in A-Z; a text of fewer than ``width`` words is one
    shingle.  A text without words (null, empty or blank) has no shingles,
    links to nothing and is a class of its own.  A row without doc_id joins
    like any other; only a class whose rows all lack an id has a null id.
    Repeated rows are rows of the same set.  No rows give no rows."""
    return (_verdicts(docs, threshold, width, recall, block)
            .select("doc_id", "class_id", "set_id", "n_links", "n_linked_sets"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL,
                block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they came: of each class
    the row with the smallest doc_id (a null id last, then by a hash of the
    text).  Texts without words, null ones too, all stay; a row repeated in
    full stays or goes with its twins; no rows give no rows."""
    rows = reliable(_verdicts(docs, threshold, width, recall, block)
                    .where("root IS NOT NULL").select("root", "doc_id", "text_key").distinct())
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    best = rows.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = (rows.join(best, "root").where(~rank.eqNullSafe(F.col("best")))
            .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id"))
                     & (F.xxhash64("text") == F.col("gone_key")), "left_anti")
