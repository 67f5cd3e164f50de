"""Exact dedup against brute force, with edge cases."""

import hashlib
import re

from communitylens.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
TEXTS = ["a b", "ab", "a  b ", "A b", None, "", " \n\t", "x" * 64 + "1", "x" * 64 + "2", "x" * 64 + " 1", LONG, LONG + " ",
         "é è", "éè", " é", "b a", "same", "same"]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def rows():
    out = [(100 - i, t, "en", None, None) for i, t in enumerate(TEXTS)]
    return out + [(None, "a b", None, None, None), (None, "only here", None, None, None), out[0], out[10]]


def brute(rs):
    groups = {}
    for d, t, *_ in rs:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t, *_ in rs:
        g = groups[norm(t)]
        best = min(g)
        out.append((d, best[3], len(g), d == best[3] and len(t or "") == -best[0],
                    hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def key(t):
    return tuple((x is None, x) for x in t)


def test_decisions(spark):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS len", "'p' AS prefix", "true AS alive").repartition(4)
    got = [tuple(r) for r in ed.decisions(df, digest_all=True)
           .select("doc_id", "keep_id", "group_size", "kept", "digest").collect()]
    assert sorted(got, key=key) == sorted(brute(rows()), key=key)


def test_full_hash_only_where_length_and_prefix_are_shared(spark):
    got = {r.doc_id: r.digest for r in ed.decisions(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got[100 - TEXTS.index("b a")] is None      # same length as "ab", other prefix
    assert got[100 - TEXTS.index("x" * 64 + "1")] is not None


def test_drop_copies_leaves_one_row_of_each_text(spark):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS digest", "'p' AS row", "0 AS best")
    kept = ed.drop_copies(df)
    assert kept.columns == df.columns
    want = {(d, norm(t)) for d, _, _, k, h in brute(rows()) if k for dd, t, *_ in rows()
            if dd == d and hashlib.sha256(norm(t).encode()).hexdigest() == h}
    got = [(r.doc_id, norm(r.text)) for r in kept.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ed.decisions(df).count() == 0 and ed.drop_copies(df).count() == 0
