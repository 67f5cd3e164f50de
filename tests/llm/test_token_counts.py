"""Separator scan of token files against the encoder's own counts."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from communitylens.llm import byte_bpe as bb
from communitylens.llm import queries
from communitylens.llm import token_counts as tc
from communitylens.session import scratch_path

RANKS = bb.read_vocabulary(P.path("byte_bpe_50k.tiktoken"))
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bb.ByteBPE(RANKS, P.PATTERN).ranks, special_tokens={})
SCHEMA = "doc_id long, text string, shard string, ordinal int"


@pytest.mark.parametrize("block_tokens", [1, 7, 1000])
def test_counts_equal_the_encoder(spark, block_tokens):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd é\n10") for _ in range(rng.choice([0, 1, 5, 60, 700]))) for _ in range(70)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(500, None, "x", 1), (501, "", None, 2), (None, "null id", "", 0),
                                                            (3, texts[3], "x", 1), (502, "long " * 9000, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = tc.token_counts(df, RANKS, P.PATTERN, file_chars=5000, block_tokens=block_tokens).collect()
    key = lambda x: (x[0] is None, x)
    assert (sorted(((r.doc_id, r.n_tokens) for r in got), key=key)
            == sorted(((d, len(REF.encode_ordinary(t or ""))) for d, t, *_ in rows), key=key))


def test_query_reads_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r.doc_id, len(REF.encode_ordinary(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_token_counts(spark, sf).collect()
    assert len(got) == len(want) and {(r.doc_id, r.n_tokens) for r in got} == want


def test_splits_may_differ_between_jobs(spark, tmp_path):
    """Shards by input split, read when the splits are no longer those of the write."""
    rows = [(i, f"word {i} " * (i % 40)) for i in range(3000)] + [(None, "null id"), (7, None)]
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    pq.write_table(table, tmp_path / "documents.parquet", row_group_size=300, compression="none")
    confs = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        spark.conf.set(confs[1], "0")
        spark.conf.set(confs[0], "60000")
        got = tc.token_counts(spark.read.parquet(f"file://{tmp_path}/documents.parquet"), RANKS, P.PATTERN, by_split=True)
        spark.conf.set(confs[0], "200000")
        got = got.collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len({r.shard for r in got}) > 2
    key = lambda x: (x[0] is None, x)
    assert (sorted(((r.doc_id, r.n_tokens) for r in got), key=key)
            == sorted(((d, len(REF.encode_ordinary(t or ""))) for d, t in rows), key=key))


def test_missing_documents_are_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some text", "", 0) for i in range(9)], SCHEMA)
    whole = tc.stitch
    monkeypatch.setattr(tc, "stitch", lambda blocks: whole(blocks).where("ordinal <> 0"))
    with pytest.raises(Exception, match="written and counted differ"):
        tc.token_counts(df, RANKS, P.PATTERN).collect()


def test_files_not_written_here(spark, tmp_path):
    """Separators at both ends, in a row, at block borders and missing at the end."""
    S = tc.SEPARATOR
    files = [[S], [S, S, 1, S], [1, 2, 3], [5, S, 6], list(range(10)) + [S] + list(range(7)), [], [1] * 16 + [S]]
    for i, ids in enumerate(files):
        (tmp_path / f"f{i}.bin").write_bytes(np.array(ids, tc.ID).tobytes())
    got = tc.stitch(tc.scan_blocks(spark, f"file://{tmp_path}", block_tokens=4)).collect()
    by_file = {}
    for r in sorted(got, key=lambda r: (r.file, r.ordinal)):
        by_file.setdefault(int(r.file.rsplit("/f")[-1].split(".")[0]), []).append((r.start, r.n_tokens))
    assert by_file == {0: [(0, 0)], 1: [(0, 0), (1, 0), (2, 1)], 2: [(0, 3)], 3: [(0, 1), (2, 1)], 4: [(0, 10), (11, 7)],
                       6: [(0, 16)]}


def test_flat_files_hold_ids_and_separators_only(spark):
    df = spark.createDataFrame([(1, "hello there", "", 0), (2, "ÿ", "", 0)], SCHEMA)
    path = scratch_path(spark, "flat-test-" + str(random.random()))
    tc.write_token_files(df, path, RANKS, P.PATTERN)
    data = b"".join(r.content for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect())
    want = [*REF.encode_ordinary("hello there"), tc.SEPARATOR, *REF.encode_ordinary("ÿ"), tc.SEPARATOR]
    assert np.frombuffer(data, tc.ID).tolist() == want


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_empty_table_by_split(spark):
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN, by_split=True).count() == 0
