"""Source divergence audit by three-dimensional cube partitioning.

Each language's sources are compared pair by pair over the language's terms.
The comparison is a cube of (source block, source block, term block) cells:
a slice of one source block and one term block is replicated to the cells of
its row and column, every cell is one dense numpy block, and the partial
divergences of the cells are summed along the term axis.  A hot language or
source only has more cells; no cell grows with the data.

All arithmetic is exact: shares are decimal integer divisions, cells hold
64-bit integers whose squares stay below 2^63.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communitylens.llm.common import stored

#: Documents of its language that a term must be in.
MIN_DOCS = 10
#: Sources and terms on the sides of a cell, about (blocks are by hash).
SOURCE_BLOCK = 32
TERM_BLOCK = 4096
#: Shares are billionths.
SCALE = 1_000_000_000
#: Distinct (group, term) entries that a task counts before it hands them on.
FLUSH_ENTRIES = 300_000

#: Bytes of terms are A-Z (lower-cased), a-z and all bytes of other characters
#: than ASCII ones; the rest separates.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TO_TERMS).split()


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_terms(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in counts.items():
                d = docs[lang, source]
                names = [None] + [t.decode("utf-8", "replace") for t in c]
                k = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(names, pa.string()),
                     pa.array([0, *c.values()], pa.int64()), pa.array([0, *(d[t] for t in c)], pa.int64())], schema=_COUNTS)
            counts.clear()
            docs.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                found = terms_of(text)
                counts.setdefault((lang, source), Counter()).update(found)
                docs.setdefault((lang, source), Counter()).update(set(found))
            if sum(map(len, counts.values())) > flush:
                yield from rows()
        yield from rows()
    return run


def term_counts(docs: DataFrame, flush: int = FLUSH_ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in
    each (lang, source) group, counted in the tasks before the shuffle.  Every
    group has one row without a term too.  Null lang, source and text are ''."""
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return (docs.select(*cols).mapInArrow(_count_terms(flush), "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly; null
    where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.nullif(total + 2 * kept, F.lit(0).cast("long"))
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(SCALE), wide(below))


_CELL = "lang string, source string, item string, value long"


def _cell(cell: pa.Table) -> pa.Table:
    """Partial divergences of one cell: every source of the row block against
    every source of the column block over the terms of the term block."""
    lang, i, j = cell.column("lang")[0].as_py(), cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    source = np.array(cell.column("source").to_pylist(), dtype=object)
    block, share_ = cell.column("gblock").to_numpy(), cell.column("p").to_numpy()
    head = cell.column("tid").is_null().to_numpy(zero_copy_only=False)
    n_terms = int(cell.column("terms")[int(np.flatnonzero(head)[0])].as_py())
    ids = np.asarray(cell.column("tid").fill_null(-1).to_numpy())
    known, col = np.unique(ids[~head], return_inverse=True)
    place = {s: k for k, s in enumerate(source[head])}
    dense = np.repeat(share_[head].astype(np.int64)[:, None], len(known) + 1, axis=1)  # last column: a term that neither has
    if len(known):
        dense[[place[s] for s in source[~head]], col] = share_[~head]
    at = block[head]
    rows, cols = np.flatnonzero(at == i), np.flatnonzero(at == j)
    weight = np.ones(len(known) + 1, dtype=np.int64)
    weight[-1] = n_terms - len(known)
    names = source[head]
    left, right, value = [], [], []
    other = dense[cols]
    for r in rows:
        diff = other - dense[r]
        f = (diff * diff // (other + dense[r]) * weight).sum(axis=1)
        for c, v in zip(cols, f.tolist()):
            if c != r:
                left.append(names[r])
                right.append(names[c])
                value.append(v)
    if i != j:
        left, right, value = left + right, right + left, value + value
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()),
                     "item": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def pair_divergences(groups: DataFrame, facts: DataFrame, kept: DataFrame, source_block: int = SOURCE_BLOCK,
                     term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources.

    ``groups`` (lang, source, total, kept, sources), ``facts`` (the same with
    term, tid and p) and ``kept`` (lang, term, kept) are term tables as
    ``audit`` makes them.  A slice goes once to each cell of its row and
    column; a source without a term of the block is there by its head row,
    which has the share of a count of 0."""
    n_term = F.greatest(F.lit(1), F.ceil(F.col("kept") / term_block)).cast("int")
    n_source = F.ceil(F.col("sources") / source_block).cast("int")
    tblock = F.pmod(F.xxhash64("term"), n_term).cast("int")
    gblock = F.pmod(F.xxhash64(F.lit("source"), F.col("source")), n_source).cast("int")
    sizes = kept.groupBy("lang", tblock.alias("tblock")).agg(F.count(F.lit(1)).alias("terms"))
    none = F.lit(None).cast("long")
    empty = F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(1).cast("long"))
    heads = (groups.select("lang", "source", gblock.alias("gblock"), n_source.alias("blocks"), empty.alias("p"),
                           F.explode(F.sequence(F.lit(0), n_term - 1)).alias("tblock"))
             .join(sizes, ["lang", "tblock"], "left")
             .select("lang", "source", "gblock", "blocks", "tblock", none.alias("tid"), "p",
                     F.coalesce("terms", F.lit(0)).cast("long").alias("terms")))
    slices = facts.select("lang", "source", gblock.alias("gblock"), n_source.alias("blocks"), tblock.alias("tblock"), "tid", "p",
                          none.alias("terms"))
    cells = (heads.unionByName(slices)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("lang", F.least("gblock", "other").alias("i"), F.greatest("gblock", "other").alias("j"), "tblock",
                     "source", "gblock", "tid", "p", "terms"))
    parts = cells.groupBy("lang", "i", "j", "tblock").applyInArrow(_cell, _CELL)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = 10, source_block: int = SOURCE_BLOCK,
          term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` has every other source of the language with the divergence
    of the two over all kept terms; part ``term`` the ``top_terms`` kept terms
    that set the source apart from its language.  A kept term is in
    ``min_docs`` documents of the language at least.

    Null and empty lang, source and text are the same ''; a group whose
    documents have no terms takes part with counts of 0; a language that keeps
    no term has pairs of value 0; repeated rows count as often as they come; a
    text of any length is read whole; an empty table gives no rows."""
    counts = stored(term_counts(docs), "divergence-counts")
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("tid")))
    kept = stored(kept, "divergence-terms")
    named = counts.where("term IS NULL").select("lang", "source")
    langs = (named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
             .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left")
             .select("lang", "sources", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
                     F.coalesce("lang_total", F.lit(0)).cast("long").alias("lang_total")))
    langs = stored(langs, "divergence-langs")
    found = stored(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "tid", "n", "lang_n"),
                   "divergence-found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (named.join(totals, ["lang", "source"], "left").join(langs, "lang")
              .select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "sources", "kept", "lang_total"))
    groups = stored(groups, "divergence-groups")
    facts = found.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    pairs = pair_divergences(groups, facts, kept.join(langs.select("lang", "kept"), "lang"), source_block, term_block)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    apart = (facts.withColumn("q", q).where("n > 0 AND p > q")
             .select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return (pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
            .unionByName(apart.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")))
