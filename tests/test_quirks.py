"""Hand-computed micro-tables for the quirk rows and the exact algorithms
that replace single-task windows and pairwise loops."""

import math
from datetime import datetime
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from communitylens.functions.text import split_whitespace, username_shape
from communitylens.operators import cooccur as co
from communitylens.operators import features as fe
from communitylens.operators import model as md
from communitylens.operators import stats
from communitylens.operators import textfeat as tf
from communitylens.operators import windows as wn


def _iqr_ref(values):
    v = sorted(values)
    n = len(v)
    if n == 0:
        return None
    q1, q3 = v[(n * 25) // 100], v[(n * 75) // 100]
    iqr = q3 - q1
    if iqr == 0:
        return None
    lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    return sum(x < lo for x in values), sum(x > hi for x in values)


def test_iqr_outliers_ranks_and_strict_fences(spark):
    groups = {"one": [5.0], "four": [1.0, 2.0, 3.0, 100.0], "eight": [1, 2, 2, 3, 3, 3, 4, 40],
              "flat": [7.0] * 6, "fence": [0.0, 10.0, 10.0, 20.0, 35.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    out = {r["g"]: r for r in stats.iqr_outliers(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g, vs in groups.items():
        ref = _iqr_ref([float(x) for x in vs])
        r = out[g]
        if ref is None:
            assert not r["has_fences"] or r["iqr"] == 0
        else:
            assert (r["n_low"], r["n_high"]) == ref, g
    # value exactly on the upper fence (q3 + 1.5 iqr = 35) is not an outlier
    assert out["fence"]["n_high"] == 0


def test_split_whitespace_java_semantics(spark):
    df = spark.createDataFrame([(" a b",), ("a b  ",), ("   ",), ("",), ("A\tB",)], "t string")
    got = [r[0] for r in df.select(split_whitespace("t")).collect()]
    assert got == [["", "a", "b"], ["a", "b"], [], [""], ["a", "b"]]


def test_username_shape_without_letters_is_class_1(spark):
    df = spark.createDataFrame([("12345",), ("ABC",), ("abc",), ("AbC1",)], "n string")
    got = [tuple(r) for r in df.select(*username_shape("n")).collect()]
    assert got == [(0, 5, 1), (3, 0, 1), (3, 0, 2), (3, 1, 3)]


def test_tag_communities_needs_two_tags_and_two_communities(spark):
    pt = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 10), (3, 20), (3, 99)], "post_id long, tag long")
    comm = spark.createDataFrame([(10, "A"), (11, "A"), (20, "B")], "tag long, community string")
    got = sorted(tuple(r) for r in co.tag_communities(pt, comm).collect())
    # post 1 has one tag, post 2 two tags of one community: only post 3 counts
    assert got == [(10, "A"), (10, "B"), (20, "A"), (20, "B"), (99, "A"), (99, "B")]


def test_inter_post_gaps_two_level_equals_plain_lag(spark):
    ts = [datetime(2020, 1, 1, 10), datetime(2020, 1, 1, 10), datetime(2020, 1, 2, 9), datetime(2021, 1, 2, 9)]
    rows = [(1, i, t) for i, t in enumerate(ts)] + [(2, 9, datetime(2020, 5, 5))]
    posts = spark.createDataFrame(rows, "user_id long, id long, created_at timestamp")
    out = {r["user_id"]: r for r in wn.inter_post_gaps(posts).collect()}
    gaps = [(b - a).total_seconds() for a, b in zip(ts, ts[1:])]
    assert out[1]["n_gaps"] == 3
    assert math.isclose(out[1]["mean_gap"], round(np.mean(gaps), 4))
    assert math.isclose(out[1]["std_gap"], round(float(np.std(gaps, ddof=1)), 4))
    assert out[2]["n_gaps"] == 0 and out[2]["mean_gap"] == 0.0 and out[2]["std_gap"] == 0.0


def test_sample_share_and_hash_rank_match_brute_force(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = {(r["g"], r["id"]) for r in wn.sample_share(df, "g", "id", 0.1).collect()}
    import hashlib
    want = set()
    for g in ("hot", "cold"):
        ids = sorted((i for gg, i in rows if gg == g), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        want |= {(g, i) for i in ids[: int(len(ids) * 0.1)]}
    assert got == want
    ranks = {r["id"]: r["hash_rank"] for r in wn.hash_rank(df.filter("g = 'hot'"), "g", "id").collect()}
    ids = sorted(range(3000), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    assert all(ranks[i] == k + 1 for k, i in enumerate(ids))


def test_global_row_number_and_running_sum(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500, 0, -1)], "k long, v long")
    rn = {r["k"]: r["row_number"] for r in wn.global_row_number(df, ["k"], 5).collect()}
    assert rn == {k: k for k in range(1, 501)}
    cs = {r["k"]: r["cum_before"] for r in wn.global_running_sum(df, ["k"], "v", "cum_before", 5).collect()}
    acc = 0
    for k in range(1, 501):
        assert cs[k] == acc
        acc += k % 7


def test_jaccard_pairs_match_brute_force(spark):
    sets = {"A": {1, 2, 3}, "B": {2, 3, 4, 5}, "C": {9}, "D": {1, 9}}
    rows = [(g, e) for g, es in sets.items() for e in es]
    out = {(r["community1"], r["community2"]): r["similarity"]
           for r in co.jaccard_pairs(spark.createDataFrame(rows, "community string, tag long"), "community", "tag").collect()}
    for a, b in combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter:
            assert math.isclose(out[(a, b)], inter / len(sets[a] | sets[b]))
            assert 0 <= out[(a, b)] <= 1
        else:
            assert (a, b) not in out


def test_post_cosine_identity_equals_pairwise(spark):
    texts = {1: ["gear gear old", "old cold", "x", "gear old"], 2: ["solo post"]}
    rows = [(u, u * 100 + i, "original", t) for u, ts in texts.items() for i, t in enumerate(ts)]
    pec = spark.createDataFrame(rows, "user_id long, id long, kind string, status_text string")
    out = {r["user_id"]: r for r in fe.post_cosine(pec).collect()}
    import re
    vecs = []
    for t in texts[1]:
        c = {}
        for w in re.findall(r"\b\w\w+\b", t.lower()):
            c[w] = c.get(w, 0) + 1
        vecs.append(c)

    def cos(a, b):
        na, nb = math.sqrt(sum(v * v for v in a.values())), math.sqrt(sum(v * v for v in b.values()))
        return 0.0 if na == 0 or nb == 0 else sum(a[k] * b.get(k, 0) for k in a) / (na * nb)

    pairs = [cos(a, b) for a, b in combinations(vecs, 2)]
    assert math.isclose(out[1]["ot_cos_mean"], round(sum(pairs) / len(texts[1]), 4), abs_tol=1e-4)
    assert math.isclose(out[1]["ot_cos_std"], round(float(np.std(pairs)), 4), abs_tol=1e-4)
    assert out[2]["ot_cos_std"] is None  # one post: no pair


def test_skipgram_offsets_follow_window_definition():
    for n, k in ((2, 1), (2, 2), (3, 1), (3, 2)):
        offs = tf.skipgram_offsets(n, k)
        brute = [c for c in combinations(range(n + k), n) if c[0] == 0]
        assert sorted(offs) == sorted(brute)


def test_class_scores_zero_safe_and_micro_equals_accuracy(spark):
    rows = [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "c", "b")]
    pred = spark.createDataFrame(rows, "doc_id long, truth string, prediction string")
    out = {r["name"]: r for r in md.class_scores(pred).collect()}
    assert out["c"]["precision"] == 0.0 and out["c"]["f1"] == 0.0  # never predicted
    assert out["micro avg"]["f1"] == out["accuracy"]["precision"] == 0.5


def test_kappa_disjoint_and_shared_labels(spark):
    a1 = spark.createDataFrame([(1, [1, 3]), (2, [2]), (3, [0])], "id long, labels array<int>")
    a2 = spark.createDataFrame([(1, [3]), (2, [1]), (3, [0])], "id long, labels array<int>")
    pairs = md.resolve_annotations(a1, a2, "id")
    got = {r["id"]: (r["a1"], r["a2"]) for r in pairs.collect()}
    assert got == {1: (3, 3), 2: (2, 1), 3: (0, 0)}
    k = md.cohen_kappa(pairs).collect()[0]
    po = 2 / 3
    pe = (1 * 1 + 1 * 1) / 9  # classes 3 and 0 each once for both annotators
    assert math.isclose(k["kappa"], round((po - pe) / (1 - pe), 6))


def test_stream_dedup_and_quarantine(spark):
    from communitylens.session import scratch_path
    from communitylens.sources import post_json as pj
    from communitylens.streaming import stream as st
    ev = spark.createDataFrame(
        [(i, datetime(2024, 1, 1 + i % 20, i % 24, 0), 5, "error" if i % 7 == 0 else "view", 1.0, "{}") for i in range(1, 201)],
        "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    feed = pj.event_feed(ev, None)
    # several files, newest events first, every file's events again in a later file
    path = scratch_path(spark, "feed-out-of-order")
    for part in ("event_id > 150", "event_id <= 60", "event_id > 150", "event_id BETWEEN 61 AND 150", "event_id <= 60"):
        st.write_feed(pj.event_feed(ev.filter(part), None).coalesce(1), path, file_records=40)
    out = st.dedup_feed(spark, path, path + "-out", path + "-ckpt", max_bytes=4096)
    assert sorted(r["event_id"] for r in out.collect()) == list(range(1, 201))
    twice = st.stream_dedup(spark, feed.unionByName(feed).repartition(4), file_records=30)
    assert sorted(r["event_id"] for r in twice.collect()) == list(range(1, 201))
    good, bad = st.stream_quarantine(spark, pj.event_feed(ev, "error").unionByName(
        spark.createDataFrame([("{not json",)], "value string")), max_bytes=4096)
    assert sorted(r["event_id"] for r in good.collect()) == [i for i in range(1, 201) if i % 7]
    assert sorted(r["event_id"] or 0 for r in bad.collect()) == [0] + [i for i in range(1, 201) if i % 7 == 0]

