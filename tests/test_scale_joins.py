"""Steps whose rows used to grow faster than their input or move more than
once: the same results, and plans or counts that show the step is gone."""

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from communitylens.operators import features as fe
from communitylens.operators import nearest
from communitylens.operators import textfeat as tf
from communitylens.plans import q_model, q_text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _counted(df):
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), made


def test_a_topic_hit_is_not_a_row_for_each_community(spark):
    words = [("red", f"c{i}") for i in range(40)] + [("blue", "c1"), ("blue", "d"), ("green", None), (None, "x")]
    texts = [(1, "red red #blue"), (2, "red"), (3, "green #t"), (4, "nothing #here"), (None, "red #t"), (5, None), (6, "blue #t"), (6, "red #t")]
    df = spark.createDataFrame(texts, "id long, text string")
    out = tf.community_word_match(df, "id", "text", spark.createDataFrame(words, "word string, community string"))
    got = sorted((r.id or 0, r.has_match, r.n_communities) for r in out.collect())
    assert got == [(0, False, 0), (1, True, 41), (2, False, 0), (3, False, 0), (4, False, 0), (5, False, 0), (6, True, 41), (6, True, 41)]
    assert not re.search(r"keys=\[id#\d+L?, community#", _plan(out))


def test_post_cosine_makes_pairs_without_a_join_of_posts(spark):
    rng = random.Random(5)
    posts = [(i, rng.choice([1, 2, None]), rng.choice(["retweet", "x"]), " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randrange(5)))) for i in range(40)]
    posts += [(3, 9, "x", "aa bb"), (3, 9, "x", "aa"), (None, 9, "x", "aa"), (50, 9, "x", "aa cc"), (51, 8, "x", "aa bb"), (51, 7, "x", "bb cc")]
    df = spark.createDataFrame(posts, "id long, user_id long, kind string, status_text string")
    out = fe.post_cosine(df)
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", _plan(out).split("== Initial Plan ==")[-1])) == 1
    # the sums over words and pairs, cell by cell
    c, n, words = Counter(), Counter(), Counter()
    for i, u, kind, text in posts:
        side = "rt" if kind == "retweet" else "ot"
        n[u, side] += 1
        words[u, side] += bool(text)
        for w in text.split():
            c[i, u, side, w] += 1
    cells, one, two = defaultdict(list), Counter(), Counter()
    for (i, u, side, w), k in c.items():
        if i is not None:
            cells[i].append((u, side, w, k))
    for group in cells.values():
        size = math.sqrt(sum(x[3] ** 2 for x in group))
        for u, side, w, k in group:
            one[u, side, w] += k / size
            for *_, w2, k2 in group:
                if w <= w2:
                    two[u, side, w, w2] += k * k2 / size ** 2
    got = {r.user_id: r for r in out.collect()}
    for (u, side), k in n.items():
        s2 = sum(m * m for (a, b, _), m in one.items() if (a, b) == (u, side)) if u is not None else 0.0
        m2 = sum(m * m * (1 if v == w else 2) for (a, b, v, w), m in two.items() if (a, b) == (u, side)) if u is not None else 0.0
        pairs, dot, dot2 = k * (k - 1) / 2, (s2 - words[u, side]) / 2, (m2 - words[u, side]) / 2
        assert got[u][f"{side}_cos_mean"] == pytest.approx(dot / k, abs=1e-4)
        if pairs:
            assert got[u][f"{side}_cos_std"] == pytest.approx(math.sqrt(max(dot2 / pairs - (dot / pairs) ** 2, 0)), abs=1e-4)
        else:
            assert got[u][f"{side}_cos_std"] is None


def test_sequences_of_placed_texts_move_no_words(spark):
    docs = [(1, "dog cat zz"), (1, "cat"), (None, "cat dog"), (2, "zz"), (3, None)]
    words = spark.createDataFrame([("cat", 0), ("dog", 1)], "word string, index long")
    placed = q_text._placed_texts(SimpleNamespace(documents=spark.createDataFrame(docs, "doc_id long, text string")))
    out = tf.index_sequences(tf.token_places(placed, ["doc_id"], F.col("text")), words, ["doc_id"])
    assert re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", _plan(out)) == ["doc_id"]
    assert sorted((r.doc_id or 0, sorted(r.sequence)) for r in out.collect()) == [(0, [0, 1]), (1, [0, 0, 1])]


def test_texts_are_cut_once_for_cluster_counts(spark):
    docs, made = _counted(spark.createDataFrame([(1, "bb cc bb"), (1, "cc"), (2, ""), (None, "bb"), (4, None)], "doc_id long, text string"))
    users = spark.createDataFrame([(1, "dd"), (2, "dd dd bb"), (3, None)], "id long, user_desc string")
    clusters = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "vec_id long, cluster long")
    got = {(r.user, r.cluster): r.n for r in q_text.cluster_counts(SimpleNamespace(documents=docs, users=users), clusters).collect()}
    assert got == {(1, 7): 2, (1, 8): 2, (None, 7): 1, (2, 9): 2, (2, 7): 1}
    assert made.value == 5


def test_only_the_blocks_of_a_set_are_kept_and_read_once(spark):
    rows = [("text", 1, "a", 1.0), ("behaviour", 1, "n", 2.0), ("auto", 1, "x", 3.0), ("text", 2, "b", 4.0)]
    blocks, made = _counted(spark.createDataFrame(rows, "block string, user_id long, feature string, value double"))
    vectors, index, _ = q_model.set_vectors(spark, blocks, spark.range(1, 4).withColumnRenamed("id", "user_id"), "text_and_behaviour")
    assert {r.user_id: r.features.toArray().tolist() for r in vectors.collect()} == {1: [2.0, 1.0, 0.0], 2: [0.0, 0.0, 4.0], 3: [0.0, 0.0, 0.0]}
    assert index.count() == 3 and made.value == 4


def test_best_of_a_block_with_ties():
    rng = np.random.default_rng(1)
    ids = rng.permutation(40)
    cos = rng.integers(0, 4, (9, 40)) / 4.0
    cos[2, 5:] = -np.inf
    cos[3] = 1.0
    row, col = nearest._best(cos, ids, 6)
    for r in range(9):
        want = sorted((-cos[r, c], ids[c]) for c in range(40) if cos[r, c] > -np.inf)[:6]
        assert [(-cos[r, c], ids[c]) for c in col[row == r]] == want


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="different lengths"):
        nearest.nearest_exact(df, 1).collect()
