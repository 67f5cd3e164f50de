"""Token counts of flat, unindexed token files by separator scan.

A token file is little-endian 16-bit ids, each document followed by an
end-of-document id, and nothing else.  Files are cut into blocks; a block is
scanned for the separator with one vector comparison and reports where its
separators lie.  What spans blocks is stitched by a prefix scan over the
blocks of a file: the running maximum of the last separator's place and the
running count of separators.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from communitylens.llm import byte_bpe
from communitylens.llm.common import pieces, text_or_empty
from communitylens.session import ensure_checkpoint_dir, scratch_path

#: End of a document: the free id of the 50k byte-level vocabulary.
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18
#: Documents handed on at a time; they are encoded some millions of characters
#: at a time.
SLICE_ROWS = 500
#: How an id lies in a file; the vocabulary has fewer than 65,536 ids.
ID = np.dtype("<u2")
#: Characters of text in one token file, about.
FILE_CHARS = 16_000_000


def write_token_files(docs: DataFrame, path: str, rank_file: bytes, pattern: str, separator: int = SEPARATOR,
                      file_chars: int = FILE_CHARS, by_split: bool = False) -> DataFrame:
    """Writes ``docs`` as token files, one for each shard folder, and returns
    (shard, ordinal, doc_id), the order in which documents were written.

    With ``by_split``, for a table just read from files, a shard is an input
    split and nothing is shuffled; otherwise it is a hash of doc_id.  Another
    job may cut other splits, so with ``by_split`` the job that writes the token
    files (folder ``kind=ids``) writes the order beside them (``kind=order``:
    ordinal, and doc_id in hex behind a mark, nothing for a null id).  In a shard
    documents lie by doc_id (null first), then by a hash of the text.  Spark's
    text sink writes the files: a document's ids are the bytes of a line, the
    separator is the line's end."""
    if by_split:
        shard = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    else:
        n = pieces(docs, F.length(text_or_empty()) + 1, file_chars)
        shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(n).cast("long"))
    dealt = docs.select(shard.alias("shard"), "doc_id", "text", F.xxhash64("text").alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = None, -1
        with byte_bpe.encoder(rank_file, pattern) as bpe:
            for b in batches:
                ids, keys, marks = [], b.column("shard").to_pylist(), b.column("mark").to_pylist()
                for done, x in enumerate(bpe.encode_stream(t.as_py() for t in b.column("text")), 1):
                    ids.append(np.frombuffer(x, "<u4").astype(ID).tobytes())
                    if len(ids) < SLICE_ROWS and done < b.num_rows:
                        continue
                    at, seqs = done - len(ids), []
                    for key in keys[at:done]:
                        last, seq = key, seq + 1 if key == last else 0
                        seqs.append(seq)
                    yield _lines("ids", b.column("shard")[at:done], seqs, ids)
                    if by_split:
                        yield _lines("order", b.column("shard")[at:done], seqs,
                                     [f"{q},{d}".encode() for q, d in zip(seqs, marks[at:done])])
                    ids = []
    end = np.array(separator, ID).tobytes().decode("latin-1")
    sink = {"encoding": "ISO-8859-1", "lineSep": end}
    folders = ["kind", "shard"] if by_split else ["shard"]
    mark = F.coalesce(F.concat(F.lit("x"), F.hex(F.col("doc_id").cast("string").cast("binary"))), F.lit(""))
    laid = dealt if by_split else dealt.repartition(n, "shard")
    (laid.sortWithinPartitions("shard", "doc_id", "tie").select("shard", "text", mark.alias("mark"))
     .mapInArrow(run, "kind string, shard long, seq long, value binary")
     .select("kind", "shard", "seq", F.col("value").cast("string").alias("value"))  # the cast keeps the bytes as they are
     .sortWithinPartitions(*folders, "seq").select(*folders, "value")
     .write.partitionBy(*folders).options(**sink).text(path))
    if not by_split:
        order = Window.partitionBy("shard").orderBy("doc_id", "tie")
        return dealt.select("shard", "doc_id", "tie").withColumn("ordinal", F.row_number().over(order) - 1).drop("tie")
    if docs.isEmpty():  # no folders
        return dealt.select("shard", F.lit(0).alias("ordinal"), "doc_id").limit(0)
    parts = F.split("value", ",")
    return (docs.sparkSession.read.options(**sink).text(f"{path}/kind=order")
            .select(F.col("shard").cast("long").alias("shard"), parts[0].cast("int").alias("ordinal"),
                    F.when(parts[1] != "", F.unhex(F.substr(parts[1], F.lit(2))).cast("string"))
                    .cast(docs.schema["doc_id"].dataType).alias("doc_id")))


def _lines(kind: str, shard: pa.Array, seqs: list[int], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(seqs), pa.string()), shard, pa.array(seqs, pa.int64()),
                                       pa.array(values, pa.binary())], names=["kind", "shard", "seq", "value"])


def scan_blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n, places): the tokens of each block and the places of
    its separators in the file."""
    size = ID.itemsize * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    blocks = (files.where(~F.col("path").contains("/kind=order/") & (F.col("length") > 0))
              .select(F.col("path").alias("file"), "content",
                      F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))).alias("block"))
              .select("file", "block", F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places = [], []
            for block, data in zip(b.column("block").to_pylist(), b.column("bytes")):
                ids = np.frombuffer(data.as_buffer(), dtype=ID)
                n.append(len(ids))
                places.append(np.flatnonzero(ids == separator) + block * block_tokens)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(n, pa.int64()),
                                              pa.array(places, pa.list_(pa.int64()))], names=["file", "block", "n", "places"])
    return blocks.mapInArrow(run, "file string, block int, n long, places array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document, from ``scan_blocks``.
    Tokens behind the last separator are a last document without one."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    scanned = (blocks.withColumn("last", F.coalesce(F.max(F.try_element_at("places", F.lit(-1))).over(before), F.lit(-1).cast("long")))
               .withColumn("ordinal", F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)))
               .withColumn("final", F.col("block") == F.max("block").over(whole))
               .withColumn("tokens", F.sum("n").over(whole)))
    rest = F.col("tokens") - 1 - F.coalesce(F.try_element_at("places", F.lit(-1)), F.col("last"))
    ends = F.when(F.col("final") & (rest > 0), F.concat("places", F.array("tokens"))).otherwise(F.col("places"))
    return (scanned.withColumn("ends", ends)
            .withColumn("starts", F.concat(F.array(F.col("last") + 1), F.transform("ends", lambda p: p + 1)))
            .select("file", "ordinal", "starts", F.posexplode("ends").alias("k", "stop"))
            .select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
                    F.element_at("starts", F.col("k") + 1).alias("start"), "stop")
            .select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens")))


def token_counts(docs: DataFrame, rank_file: bytes, pattern: str, separator: int = SEPARATOR,
                 file_chars: int = FILE_CHARS, block_tokens: int = BLOCK_TOKENS, by_split: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, shard, ordinal, start, n_tokens, counted
    in the token files that hold them.

    A null or empty text has 0 tokens; repeated rows are documents of their
    own; a null id is an id like any other; an empty table gives no rows.  A
    document written and not counted, or counted and not written, is an error."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex[:12]}")
    written = write_token_files(docs, path, rank_file, pattern, separator, file_chars, by_split)
    counted = stitch(scan_blocks(spark, path, separator, block_tokens))
    shard = F.regexp_extract("file", r"shard=(-?\d+)", 1).cast("long")
    found = counted.select(shard.alias("shard"), "ordinal", "start", "n_tokens")
    return (written.withColumn("listed", F.lit(True)).join(found, ["shard", "ordinal"], "full_outer")
            .select("doc_id", "shard", "ordinal", "start",
                    F.when(F.col("listed") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(
                        F.raise_error(F.concat_ws(" ", F.lit("documents written and counted differ at"), "shard", "ordinal")))
                    .cast("long").alias("n_tokens")))
