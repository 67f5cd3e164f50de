"""The quality classifier: held-out accuracy, recomputed scores, edge cases."""

import zlib

import numpy as np
import pytest

from communitylens.llm import quality_model as qm
from communitylens.llm import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy_and_scores(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(test) > 40 and sum(p == y for p, y in test) / len(test) >= 0.95
    # the folded table gives what averaging the learned vectors gives
    docs, table = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = qm.fit(docs, table)
    for r in got[:60]:
        ids, w = qm.features(texts[r.doc_id])
        z = (w.astype(float) @ model.vectors[ids].astype(float)) @ model.output.astype(float) + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-6)


def test_accept_keeps_columns_and_good_rows(spark):
    good, bad = "calm words in a line number {} go on", "BUY!! NOW!! IT!! IS!! {}!! CHEAP!!"
    rows = [(i, (good if i % 2 else bad).format("ab" * (i % 7 + 1)) * 3, "en", "s", 1) for i in range(300)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, good.format("x"), None, None, None),
             (1002, bad.format("q") * 20_000, "en", "s", 9), rows[1]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0.5D AS score", "1 AS label", "'r' AS row")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    kept = qm.accept(df, labels)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in range(300) if i % 2} <= set(ids) and not any(i % 2 == 0 for i in ids if i is not None and i < 300)
    assert ids.count(1) == 2 and None in ids and 1002 not in ids


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "a b", "", "", 3), (2, None, "", "", 0)], SCHEMA)
    assert [r.score for r in qm.score(df, qm.fit(df, none)).collect()] == [0.5, 0.5]
    assert qm.accept(df.limit(0), none).count() == 0
