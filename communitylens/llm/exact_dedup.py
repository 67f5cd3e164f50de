"""Exact dedup by progressive refinement.

Texts are equal when they are identical without their ASCII white space.
Rows are grouped by the length of that normal form first, then by length and
a hash of its first characters, and only rows that still share a group are
hashed in full.  Every grouping counts map-side, so a group that holds a
third of all rows arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import SPACE_CLASS, packed, reliable, text_or_empty


def normal_form(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS + "+", "")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Orders rows of one group: most code points first, then the smallest
    id, a null id last."""
    return F.struct((-n_chars).alias("neg_chars"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def _keyed(rows: DataFrame, prefix_chars: int) -> DataFrame:
    norm = normal_form(F.col("row.text"))
    return rows.select("*", F.length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix"))


def refine(docs: DataFrame, prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the row itself), ``len``,
    ``prefix``, ``digest`` (SHA-256 of the normal form, null where length or
    prefix already told the row apart; ``digest_all`` fills those too) and
    ``alive`` (whether it went into the full comparison)."""
    keyed = _keyed(packed(docs.select("doc_id", "text")), prefix_chars)
    cells = keyed.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    lens = cells.groupBy("len").agg(F.sum("n").alias("n")).where("n > 1").select("len")
    shared = (cells.join(lens, "len", "left_semi").where("n > 1")
              .select("len", "prefix", F.lit(True).alias("alive")))
    digest = F.sha2(normal_form(F.col("row.text")), 256)
    joined = _keyed(packed(docs), prefix_chars).join(shared, ["len", "prefix"], "left")
    return joined.select("row", "len", "prefix", F.coalesce("alive", F.lit(False)).alias("alive"),
                         digest.alias("digest") if digest_all else F.when(F.col("alive"), digest).alias("digest"))


def decisions(docs: DataFrame, prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, digest, keep_id, group_size, kept.

    Of equal texts the one with the most code points stays, then the one
    with the smallest doc_id; rows that tie in both (repeated in full, or of
    one id and length with other white space) share one decision.  A null
    text is the empty text, and all empty or blank texts are equal.  A
    row without doc_id stays only where its group has no id at all
    (``keep_id`` is then null)."""
    rows = reliable(refine(docs.select("doc_id", "text"), prefix_chars, digest_all)
                    .select(F.col("row.doc_id").alias("doc_id"), F.length(text_or_empty("row.text")).alias("n_chars"),
                            "len", "prefix", "alive", "digest"))
    groups = (rows.where("alive").groupBy("len", "prefix", "digest")
              .agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank(F.col("n_chars"), F.col("doc_id"))).alias("best"))
              .select(F.col("len").alias("g_len"), F.col("prefix").alias("g_prefix"), F.col("digest").alias("g_digest"),
                      "group_size", "best"))
    on = [F.col("len") == F.col("g_len"), F.col("prefix") == F.col("g_prefix"), F.col("alive"),
          F.col("digest") == F.col("g_digest")]
    alone = F.col("best").isNull()
    return rows.join(groups, on, "left").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | _rank(F.col("n_chars"), F.col("doc_id")).eqNullSafe(F.col("best"))).alias("kept"))


def drop_copies(docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with the
    columns of ``docs``.  Rows repeated in full leave one row.  Null, empty
    and blank texts are equal; a row without doc_id stays only where its group
    has no id; no rows give no rows."""
    text_key = F.xxhash64(text_or_empty())
    shared = refine(docs.select("doc_id", "text"), prefix_chars).where("alive")
    rank = F.struct(_rank(F.length(text_or_empty("row.text")), F.col("row.doc_id")).alias("rank"),
                    F.xxhash64(text_or_empty("row.text")).alias("text_key"))
    rows = reliable(shared.select(F.struct("len", "prefix", "digest").alias("key"), rank.alias("rank")))
    best = rows.groupBy("key").agg(F.min("rank").alias("best"))
    ranked = rows.join(best, "key").select((F.col("rank") == F.col("best")).alias("stays"),
                                           F.col("rank.rank.doc_id").alias("key_id"), F.col("rank.text_key").alias("key_text"))
    ids = reliable(ranked.groupBy("key_id", "key_text").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
                   .where("NOT stays OR n > 1"))
    same = lambda x: F.col("doc_id").eqNullSafe(x["key_id"]) & (text_key == x["key_text"])
    gone, twins = ids.where("NOT stays"), ids.where("stays")
    kept = docs.join(gone, same(gone), "left_anti")
    if twins.isEmpty():
        return kept
    one = kept.join(twins, same(twins), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twins, same(twins), "left_anti").unionByName(one)
