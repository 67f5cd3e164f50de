"""The n-gram Jaccard join against all pairs, and its edge cases."""

import random
import re

import numpy as np
import pytest

from communitylens.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    """{(doc_id, text): (class_id, n_links)} over rows with an id."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j]
             and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(near):
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    out = {}
    for i, (d, t) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out[(d, t)] = (min(ids) if ids else None, len(near[i]))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(rng.randint(1, 9)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = word()
            texts.append(("\n" if rng.random() < .3 else " ").join(c))
    hot = [word() for _ in range(150)]
    for _ in range(60):
        c = list(hot)
        for k in rng.sample(range(150), 2):
            c[k] = word()
        texts.append(" ".join(c))
    texts += [" ".join(base[0]).upper(), "one", "ONE", "", "  \n", None, "w " * 5000, "long " + "w " * 20000]
    rows = [(i * 7 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, " ".join(base[1]), None, None, None), rows[0], (None, "nobody else says this at all", "x", "y", 1)]


def test_links_and_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in nj.jaccard_join(df, block=16).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.n_links))
    want = {}
    for (d, _), v in brute([r[:2] for r in rows]).items():
        want.setdefault(d, set()).add(v)
    assert got == want


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [r for r in corpus() if r[0] is not None][:-1]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cls", "1 AS root", "2 AS bucket")
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    want = brute([r[:2] for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for (d, _), (c, _) in want.items() if d == c)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nj.jaccard_join(df).count() == 0
    assert nj.one_of_each(df).count() == 0


def test_band_shape_reaches_the_recall():
    for t, r, h in ((0.8, 0.9999, 128), (0.5, 0.99, 200), (0.9, 0.999, 64)):
        b, n = nj.band_shape(t, r, h)
        assert b * n <= h and 1 - (1 - t ** n) ** b >= r
    with pytest.raises(ValueError):
        nj.band_shape(0.1, 0.9999, 4)


def test_linked_matrix_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60), dtype=np.uint64)) for _ in range(70)]
    ok = nj.linked(sets, np.zeros(70, bool), 0.5)
    for i in range(70):
        for j in range(70):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert ok[i, j] == (i != j and len(a & b) / len(a | b) >= 0.5)
