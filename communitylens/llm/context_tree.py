"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions.  Each decision has a context tree of its
own over the bytes before it, up to ``depth`` of them; every node holds a
Krichevsky-Trofimov estimate of its bit, and a node's weighted probability is
half its own estimate and half the product of its children's.  The trained
model is frozen: a bit's probability is the mixture over all depths with the
weights that training gave, so the log probability of a byte depends on its
last ``depth`` bytes and itself, a (depth + 1)-gram.

That makes the work a join.  Documents are dealt to chunks; a chunk gives
each distinct gram once; counts are summed by gram, trees are built by tasks
that own whole subtrees (all contexts that share their last two bytes), and
every chunk gets back the log probabilities of its own grams, against which
its texts are scored.  The word model beside it takes the same route.  Of the
whole model only the two top levels, 65,536 nodes at most, pass through the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import pieces, reliable, stored, text_or_empty
from communitylens.llm.shingles import in_batches, words
from communitylens.llm.u64map import U64Map

DEPTH = 5
#: Characters in a chunk, grams in a part of the tree, characters whose grams
#: are sorted at a time, rows in an Arrow batch.
CHUNK_CHARS = 24_000_000
PART_GRAMS = 100_000
BLOCK_CHARS = 1_000_000
BATCH_ROWS = 200_000
#: Share of held-out documents: one in so many, by crc32 of the id.
FOLDS = 10
#: Ends every text; no word holds white space.
END = b"\n"

_U = np.uint64


# --- texts to grams -----------------------------------------------------------

def normal_bytes(text: str | None) -> bytes:
    """What the model reads: words in lower case with single spaces, an end."""
    return b" ".join(words(text)) + END


def gram_keys(docs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed gram of every byte of every text, and bytes per text.  The
    context before a text is a row of ends."""
    pad = END * depth
    raw = np.frombuffer(b"".join(x for d in docs for x in (pad, d)), dtype=np.uint8)
    lens = np.array([len(d) for d in docs], dtype=np.int64)
    keys = np.zeros(max(0, len(raw) - depth), dtype=np.uint64)
    for k in range(depth + 1):
        keys = keys << _U(8) | raw[k:len(raw) - depth + k]
    # position p of the joined bytes is predicted by keys[p - depth]
    begin = np.cumsum(lens + depth) - lens - depth
    at = np.arange(lens.sum()) + np.repeat(begin - (np.cumsum(lens) - lens), lens)
    return keys[at], lens


def _merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.concatenate((first, [len(s)])))


def _distinct_items(depth: int):
    """A chunk's distinct grams and words with their training counts; those
    of held-out texts come with a count of 0.  Texts come and items leave in
    Arrow batches; besides them a task holds the grams of a block and what
    was counted so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, counts = None, [], Counter()
        for batch in batches:
            chunk, texts = batch.column("chunk")[0].as_py(), batch.column("text")
            trains = batch.column("train").to_pylist()
            for train in (True, False):
                own = (texts[i].as_py() for i, t in enumerate(trains) if t is train)
                for block in in_batches(own, BLOCK_CHARS):
                    split = [words(t) for t in block]
                    for ws in split:
                        if train:
                            counts.update(ws)
                        else:
                            counts.update(dict.fromkeys(ws, 0))
                    counts[END] += len(split) if train else 0
                    keys, n = _counted(gram_keys([b" ".join(ws) + END for ws in split], depth)[0])
                    parts.append((keys, n if train else np.zeros_like(n)))
                    if sum(len(k) for k, _ in parts[1:]) > max(len(parts[0][0]), BLOCK_CHARS):
                        parts = [_merge_counts(parts)]
        keys, n = _merge_counts(parts)
        del parts
        for at in range(0, len(keys), BATCH_ROWS):
            some, c = keys[at:at + BATCH_ROWS].view(np.int64), n[at:at + BATCH_ROWS].astype(np.int64)
            yield _items(chunk, pa.array(some), pa.nulls(len(some), pa.binary()), pa.array(c))
        every = list(counts)
        for at in range(0, len(every), BATCH_ROWS):
            some = every[at:at + BATCH_ROWS]
            yield _items(chunk, pa.nulls(len(some), pa.int64()), pa.array(some, pa.binary()),
                         pa.array([counts[w] for w in some], pa.int64()))
    return run


def _items(chunk: int, grams: pa.Array, ws: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk, np.int32)), grams, ws, n],
                                      names=["chunk", "gram", "word", "n"])


# --- the weighted trees -------------------------------------------------------

def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0 (Stirling's series from x + 7 on)."""
    shift = np.ones_like(x)
    for k in range(7):
        shift = shift * (x + k)
    y = x + 7
    s = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + s - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of so many zeros and ones.  The shift
    product of ``lgamma`` would overflow above 1e43, far beyond any count."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _path(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its eight tree nodes (1..255) and bits."""
    bits = (symbols[:, None] >> np.arange(7, -1, -1)) & 1
    nodes = (symbols[:, None] | 256) >> np.arange(8, 0, -1)
    return nodes, bits


class Level:
    """The nodes of one depth: (context, bit node) with counts."""

    def __init__(self, keys: np.ndarray, inverse: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.inverse, self.zeros, self.ones = keys, inverse, zeros, ones
        self.log_e = log_kt(zeros, ones)
        self.log_w = self.log_e            # of the weighted probability
        self.own = np.ones(len(keys))      # weight of the node's own estimate

    def weigh(self, below: np.ndarray) -> None:
        """``below``: summed log weighted probability of the children."""
        self.log_w = np.logaddexp(self.log_e, below) - math.log(2)
        self.own = np.exp(self.log_e - math.log(2) - self.log_w)

    def estimate(self, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return (np.where(bits, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)


def build_levels(grams: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[list[Level], np.ndarray]:
    """Levels ``least``..``depth`` for grams that own their subtrees, weighted
    bottom up; and the bits of each gram's byte."""
    nodes, bits = _path((grams & _U(255)).astype(np.int64))
    bits = bits.astype(np.int8)
    context = (grams >> _U(8)).astype(np.int64)
    levels = []
    for d in range(least, depth + 1):
        key = ((context & ((1 << 8 * d) - 1))[:, None] << 8 | nodes).ravel()
        keys, inverse = np.unique(key, return_inverse=True)
        weight = np.repeat(n, 8)
        ones = np.bincount(inverse, weights=weight * bits.ravel(), minlength=len(keys))
        both = np.bincount(inverse, weights=weight, minlength=len(keys))
        levels.append(Level(keys, inverse.reshape(nodes.shape).astype(np.int32), both - ones, ones))
    for d in range(depth - 1, least - 1, -1):
        child, parent = levels[d + 1 - least], levels[d - least]
        up = ((child.keys >> 8) & ((1 << 8 * d) - 1)) << 8 | child.keys & 255
        at = np.searchsorted(parent.keys, up)
        parent.weigh(np.bincount(at, weights=child.log_w, minlength=len(parent.keys)))
    return levels, bits


def log10_probabilities(grams: np.ndarray, n: np.ndarray, depth: int, least: int = 0,
                        top: "Top | None" = None) -> np.ndarray:
    """log10 of each gram's byte given its context.  ``top`` gives the levels
    above ``least`` when they hold more than these grams."""
    levels, bits = build_levels(grams, n, depth, least)
    p = levels[-1].estimate(levels[-1].inverse, bits)
    for level in levels[-2::-1]:
        own = level.own[level.inverse]
        p = own * level.estimate(level.inverse, bits) + (1 - own) * p
    if top is not None:
        p = top.mix(grams, bits, p)
    return np.log10(p).sum(axis=1)


class Top:
    """Depths 0 and 1, 256 * 255 nodes at most: arrays over (byte, bit node)."""

    def __init__(self, node: np.ndarray, log_w: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        size = 1 << 16
        below, z, o = (np.bincount(node, weights=x, minlength=size) for x in (log_w, zeros, ones))
        everything = np.arange(size)
        self.one = Level(everything, everything, z, o)
        self.one.weigh(below)
        fold = everything & 255
        self.root = Level(np.arange(256), fold, np.bincount(fold, weights=z), np.bincount(fold, weights=o))
        self.root.weigh(np.bincount(fold, weights=self.one.log_w))

    def mix(self, grams: np.ndarray, bits: np.ndarray, p: np.ndarray) -> np.ndarray:
        nodes, _ = _path((grams & _U(255)).astype(np.int64))
        last = ((grams >> _U(8)) & _U(255)).astype(np.int64)[:, None]
        for level, at in ((self.one, last << 8 | nodes), (self.root, nodes)):
            own = level.own[at]
            p = own * level.estimate(at, bits) + (1 - own) * p
        return p


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a part as (grams, counts), sorted so that results do not
    depend on the order in which rows arrive."""
    got = [(b.column("gram").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)) for b in batches]
    if not got:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    grams, n = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(grams)
    return grams[order].astype(np.uint64), n[order]


def gram_model(totals: DataFrame, depth: int, part_grams: int = PART_GRAMS) -> DataFrame:
    """(gram, value): log10 probability of every gram of ``totals`` (gram, n)."""
    parts = pieces(totals, F.lit(1), part_grams)
    owned = reliable(totals.repartition(parts, F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long")))
                     .select("gram", "n"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _columns(batches)
        if len(grams):
            level = build_levels(grams, n, depth, 2)[0][0]
            node = (level.keys >> 8 & 255) << 8 | level.keys & 255
            at = np.unique(node)
            sums = [np.bincount(node, weights=x, minlength=1 << 16)[at] for x in (level.log_w, level.zeros, level.ones)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x) for x in sums)],
                                             names=["node", "log_w", "zeros", "ones"])
    rows = (owned.mapInArrow(summarise, "node int, log_w double, zeros double, ones double").groupBy("node")
            .agg(*(F.sum(c).alias(c) for c in ("log_w", "zeros", "ones"))).toArrow())  # 65,280 rows at most
    top = Top(*(rows.column(c).to_numpy().astype(np.int64 if c == "node" else float)
                for c in ("node", "log_w", "zeros", "ones")))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _columns(batches)
        if len(grams):
            value = log10_probabilities(grams, n, depth, 2, top)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(value)], names=["gram", "value"])
    return owned.mapInArrow(evaluate, "gram long, value double")


# --- scoring ------------------------------------------------------------------

def _score_chunk(depth: int, denominator: float):
    """Scores of a chunk's texts from the items that were looked up for it."""
    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        # an item is a gram with its value or a word with its count
        counts = items.column("c").drop_null().to_numpy()
        word_value = dict(zip(items.column("word").drop_null().to_pylist(), np.log10((counts + 0.1) / denominator).tolist()))
        unseen = {w for w, c in zip(word_value, counts.tolist()) if c == 0}
        table = U64Map(items.column("gram").drop_null().to_numpy().view(np.uint64))
        value = items.column("value").drop_null().to_numpy()
        n_tokens, n_known, base, score, n_bytes = [], [], [], [], []
        for texts in in_batches((t.as_py() for t in docs.column("text")), BLOCK_CHARS):
            data = []
            for t in texts:
                ws = words(t)
                data.append(b" ".join(ws) + END)
                ws.append(END)
                n_tokens.append(len(ws))
                n_known.append(len(ws) - sum(map(unseen.__contains__, ws)))
                base.append(math.fsum(map(word_value.__getitem__, ws)))
            keys, lens = gram_keys(data, depth)
            score += np.add.reduceat(value[table.find(keys)], np.cumsum(lens) - lens).tolist()
            n_bytes += lens.tolist()
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": pa.compute.invert(docs.column("train")),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
                         "n_bytes": pa.array(n_bytes, pa.int64())})
    return run


def score_documents(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS, chunk_chars: int = CHUNK_CHARS,
                    part_grams: int = PART_GRAMS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes, bits_per_byte.

    Trained on the rows whose crc32(doc_id) mod ``folds`` is not 0 (a null id
    trains).  ``score`` is the log10 probability of the normal text: words
    lower-cased in A-Z with single spaces, and an end byte; ``bits_per_byte``
    is the same as a code length.  ``base_score`` is the unigram word model.
    A null or blank text is its end alone.  If nothing trains, every byte has
    the probability 1/256.  Repeated rows train and are scored as often as they come."""
    if not 2 < depth <= 6:
        raise ValueError("depth must be 3 to 6")
    n_chunks = pieces(docs, F.length(text_or_empty()) + 1, chunk_chars)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0, F.lit(True))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.lit(n_chunks)).cast("int").alias("chunk"),
                        "doc_id", "text", train.alias("train"))
    items = stored(dealt.groupBy("chunk").applyInArrow(_distinct_items(depth), "chunk int, gram long, word binary, n long"),
                   "ctw-items")
    grams = items.where("gram IS NOT NULL").select("chunk", "gram", "n")
    tokens = items.where("word IS NOT NULL").select("chunk", "word", "n")
    model = gram_model(grams.groupBy("gram").agg(F.sum("n").alias("n")), depth, part_grams)
    counts = stored(tokens.groupBy("word").agg(F.sum("n").alias("c")), "ctw-words")
    total, distinct_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    back = (grams.select("chunk", "gram").join(model, "gram")
            .select("chunk", "gram", "value", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"))
            .unionByName(tokens.select("chunk", "word").join(counts, "word")
                         .select("chunk", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("value"),
                                 "word", "c")))
    scored = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        _score_chunk(depth, total + 0.1 * (distinct_words + 1)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                             "score double, n_bytes long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score", "n_bytes",
                         (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
