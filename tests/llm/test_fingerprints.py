"""Bottom-k fingerprints: definitions, estimates, the next document."""

import hashlib
import random

import numpy as np
import pytest

from communitylens.llm import fingerprints as fp
from communitylens.llm.shingles import shingle_batch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n)]


def exact(a, b):
    x, y = (set(shingle_batch([t])[0].tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x and y else float(len(x) == len(y))


def docs():
    rng = random.Random(8)
    out = [(i * 3, " ".join(words(rng, rng.choice([1, 4, 5, 30, 300]))), "en", None, None) for i in range(80)]
    out += [(1000, None, "", "", 0), (1001, "", "", "", 0), (1002, " \n", "", "", 0), (1003, "ä" * 50_000, "", "", 0),
            (1004, "w " * 40_000, "", "", 0), (1005, out[3][1], "", "", 0), (1006, out[3][1], "", "", 0)]
    return out


@pytest.mark.parametrize("range_chars", [10**9, 3000])
def test_next_document_and_digests(spark, range_chars):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rng", "true AS guest").repartition(5)
    got = {r.doc_id: r for r in fp.compare_with_next(df, range_chars=range_chars).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (d, t, *_) in enumerate(order):
        t, following, r = t or "", order[(i + 1) % len(order)][1] or "", got[d]
        m = len(t) // 3
        changed = t[:len(t) - m] + following[:m]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = fp.sketches([t, changed, following])
        assert (r.fingerprint, r.edited_fingerprint) == (fp.to_text(a), fp.to_text(b))
        assert r.near_edited == fp.resemblance(a, b) and r.near_next == fp.resemblance(a, c)
        assert abs(r.near_edited - exact(t, changed)) < 0.2 and abs(r.near_next - exact(t, following)) < 0.2
    assert got[1005].fingerprint == got[1006].fingerprint == got[9].fingerprint and got[1006].near_next == 1.0


def test_ties_nulls_one_row_no_rows(spark):
    rows = [(5, "a b c", "", "", 0), (5, "a b c", "", "", 0), (5, "other words", "", "", 0), (None, "no id", "", "", 0),
            (None, None, "", "", 0), (1, "x", "", "", 0)]
    got = fp.compare_with_next(spark.createDataFrame(rows, SCHEMA), range_chars=4).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in got) == sorted((d is None, d, len(t or "")) for d, t, *_ in rows)
    one = fp.compare_with_next(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates():
    rng = random.Random(1)
    base = words(rng, 4000)
    a, b = " ".join(base[:3000]), " ".join(base[1000:])
    sa, sb = fp.sketches([a, b], k=512)
    x, y = (set(shingle_batch([t])[0].tolist()) for t in (a, b))
    assert abs(fp.resemblance(sa, sb, 512) - len(x & y) / len(x | y)) < 0.08
    assert abs(fp.containment(sa, sb, 512) - len(x & y) / len(x)) < 0.12
    assert abs(fp.distinct_count(sa, 512) / len(x) - 1) < 0.15
    assert np.array_equal(fp.from_text(fp.to_text(sa)), sa)


def test_merged_parts_equal_the_whole(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, 200)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)], SCHEMA).repartition(7)
    got = {r.grp: r for r in fp.group_sketches(df, "source", k=64).collect()}
    for i, s in enumerate("ab"):
        want = fp.merge(fp.sketches(texts[i::2], 64), 64)
        assert np.array_equal(fp.from_text(got[s].fingerprint), want)
        assert got[s].n_shingles == pytest.approx(fp.distinct_count(want, 64))


def test_groups_without_a_name_or_text(spark):
    schema = "doc_id long, text string, source string, grp string"
    assert fp.group_sketches(spark.createDataFrame([], schema), "source", k=8).count() == 0
    five = "one two three four five"
    rows = [(1, None, "a", "x"), (2, " ", "a", "x"), (3, five, None, "x"), (3, five, None, "x"), (None, five, "b", "x")]
    got = {r.grp: r for r in fp.group_sketches(spark.createDataFrame(rows, schema), "source", k=8).collect()}
    assert {g: r.n_shingles for g, r in got.items()} == {"a": 0, None: 1, "b": 1}
    assert got[None].fingerprint == got["b"].fingerprint
