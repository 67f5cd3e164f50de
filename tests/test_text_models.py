"""Nearest vectors, hashtag cuts, polarity, sparse vectors and index
sequences against plain versions."""

import itertools
import math
import random
import re

import numpy as np

from communitylens.operators import polarity, segmentation, sparse
from communitylens.operators import textfeat as tf
from communitylens.operators.nearest import nearest_exact, nearest_sketched
from communitylens.session import scratch_path


def vectors(n, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim))
    v = centres[rng.integers(0, 30, n)] + 0.35 * rng.standard_normal((n, dim))
    v[:40] = v[0]  # one group of equal vectors
    return v


def test_nearest_exact_and_sketched(spark):
    v = vectors(400)
    rows = [(i, x.tolist(), "b") for i, x in enumerate(v)] + [(900, [0.0] * 24, "b"), (901, None, "b"), (902, [float("nan")] * 24, "b")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, bucket string").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    want = {i: [j for j in sorted(range(400), key=lambda j: (-cos[i, j], j)) if j != i][:5] for i in range(400)}
    got = {}
    for r in nearest_exact(df, 5, block=64).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
        assert abs(r.cosine - cos[r.id, r.other]) < 1e-6
    assert all(abs(cos[i, a] - cos[i, b]) < 1e-8 for i in want for a, b in zip(want[i], got[i])) and set(got) == set(want)
    found = {}
    for r in nearest_sketched(df, 5, block=64).collect():
        found.setdefault(r.id, []).append(cos[r.id, r.other])
    hits = sum(sum(c >= cos[i, want[i][-1]] - 1e-9 for c in found.get(i, ())) for i in want)
    assert hits >= 0.9 * 5 * 400  # recall against the exact form
    assert nearest_exact(df.limit(0)).count() == 0 and nearest_sketched(df.limit(0)).count() == 0


def test_hashtags_are_cut_as_by_exhaustive_search(spark):
    corpus = "breast cancer awareness cancer a ware ness aware month or wait fit ness fitness month the them theme me breast breast fit".split()
    counts = {w: corpus.count(w) for w in corpus}
    tags = ["breastcancerawareness", "fitnessmonth", "themefit", "zzz", "awarenesszz", "a", "", None, "themefit", "é"]

    def cost(w):
        n = len(corpus)
        return round((math.log(n) - math.log(counts[w]) if w in counts else math.log(n) + (len(w) - 1) * math.log(10)) * 1_000_000)

    def exhaustive(tag):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(tag) - 1):
            words, last = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    words.append(tag[last:i])
                    last = i
            if max(map(len, words)) <= 20:
                to = (sum(map(cost, words)), len(words), " ".join(words))
                best = min(best, to) if best else to
        return best[2], best[0]
    c = spark.createDataFrame(list(counts.items()), "word string, count long")
    got = {r.tag: (r.words, r.cost) for r in segmentation.segment(spark.createDataFrame([(t,) for t in tags], "tag string"), c).collect()}
    assert set(got) == {t for t in tags if t}
    assert got["breastcancerawareness"][0] == "breast cancer a ware ness" or got["breastcancerawareness"][0] == "breast cancer awareness"
    for t in got:
        if len(t) < 18:
            assert got[t] == exhaustive(t)
    posts = [(1, "RT #FitnessMonth isn't over, I’m *in* "), (2, None), (3, "#1 #themefit.")]
    out = {r.id: r.text for r in segmentation.unpack_posts(spark.createDataFrame(posts, "id long, text string"), c, "id", "text").collect()}
    assert out == {1: f"{got['fitnessmonth'][0]} is not over, i am in", 2: "", 3: "1 themefit."}
    empty = segmentation.segment(spark.createDataFrame([("abc",)], "tag string"), c.limit(0)).collect()
    assert [(r.tag, r.words) for r in empty] == [("abc", "abc")]


def test_polarity_in_order(spark):
    lexicon = {"good": 1.9, "bad": -2.5, "fine": 0.8}
    boost, negation = {"very": 1.0, "hardly": -1.0}, {"not", "never"}
    rng = random.Random(2)
    words = [*lexicon, *boost, *negation, "x", "GOOD", "Bad", "VERY", "y's"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(80)] + ["", None, "GOOD", "good " * 3000]

    def plain(t):
        ws = re.findall(r"[^\W\d_]+(?:'[^\W\d_]*)*", t or "")
        caps = [w.upper() == w and w.lower() != w and len(w) > 1 for w in ws]
        mixed, s = any(caps) and not all(caps), 0.0
        for i, w in enumerate(ws):
            v = lexicon.get(w.lower())
            if v is None:
                continue
            add = 0.733 if caps[i] and mixed else 0.0
            turn = False
            for k, fade in ((1, 1.0), (2, .95), (3, .9)):
                if i >= k:
                    add += boost.get(ws[i - k].lower(), 0.0) * 0.293 * fade
                    turn |= ws[i - k].lower() in negation
            v += math.copysign(1, v) * add
            s += v * -0.74 if turn else v
        return s
    lex = [(w, "valence", v) for w, v in lexicon.items()] + [(w, "booster", v) for w, v in boost.items()] + [(w, "negation", 0.0) for w in negation]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in polarity.text_polarity(df, spark.createDataFrame(lex, "word string, role string, value double"), "id", "text").collect()}
    for i, t in enumerate(texts):
        s = plain(t)
        assert abs(got[i].valence - s) < 1e-4 and abs(got[i].compound - s / math.sqrt(s * s + 15)) < 1e-4


def test_sparse_vectors_hold_the_rows(spark):
    rows = [(1, "b", "x", 2.0), (1, "a", "y", 0.0), (2, "a", "x", 1.5), (2, "a", "x", 1.5), (1, "a", "new", 7.0)]
    df = spark.createDataFrame(rows, "user_id long, block string, feature string, value double")
    index = sparse.column_index(df.where("feature <> 'new'"))
    assert [tuple(r) for r in index.orderBy("index").collect()] == [("a", "x", 0), ("a", "y", 1), ("b", "x", 2)]
    keys = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    path = scratch_path(spark, "sparse-test")
    v = {r.user_id: r.features for r in sparse.sparse_vectors(df, index, keys, "user_id", path).collect()}
    assert {k: (x.size, dict(zip(x.indices.tolist(), x.values.tolist()))) for k, x in v.items()} == {
        1: (3, {2: 2.0}), 2: (3, {0: 3.0}), 3: (3, {})}


def test_index_sequences_skip_unknown_words(spark):
    words = spark.createDataFrame([("red", 0, 1), ("bolt", 1, 1)], "word string, index int, count long")
    docs = spark.createDataFrame([(1, "Red bolt, blue red"), (2, "blue"), (3, None)], "id long, text string")
    from pyspark.sql import functions as F
    got = tf.index_sequences(tf.token_places(docs, ["id"], F.col("text")), words, ["id"]).collect()
    assert [(r.id, r.sequence) for r in got] == [(1, [0, 1, 0])]
