"""Steps that were made to grow with their input: the same rows as the plain
forms, and texts that are read once."""

import random

import pytest
from pyspark.sql import functions as F

from communitylens.operators import joins as jn
from communitylens.operators import textfeat as tf


def _counted(df):
    """``df`` and the number of its rows that were made so far."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), made


def test_dictionary_match_reads_the_texts_once(spark):
    toks = [(1, "a"), (1, "a"), (1, "b"), (2, "x"), (None, "a"), (3, "b"), (3, None)]
    df, made = _counted(spark.createDataFrame(toks, "user long, word string"))
    entries = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.25), ("q", "b", 1.0), ("r", "zz", 2.0)], "class string, word string, score double")
    got = {(r.user, r.dict): (r.score_sum, r.match_count, r.max_score, r.any_match) for r in tf.dictionary_match(df, entries).collect()}
    none = (0.0, 0, 0.0, 0)
    assert got == {(1, "p"): (0.75, 2, 0.5, 1), (1, "q"): (1.0, 1, 1.0, 1), (1, "r"): none,
                   (2, "p"): none, (2, "q"): none, (2, "r"): none, (3, "p"): (0.25, 1, 0.25, 1), (3, "q"): (1.0, 1, 1.0, 1), (3, "r"): none,
                   (0, "p"): none, (0, "q"): none, (0, "r"): none}  # a null user is filled too
    assert made.value == len(toks)


def test_goodness_counts_its_lists_once(spark):
    rows = [("p", "a", 3), ("q", "a", 1), ("q", "b", 4)]
    df, made = _counted(spark.createDataFrame(rows, "class string, word string, freq long"))
    got = {(r["class"], r.word): r.score for r in tf.class_word_goodness(df).collect()}
    assert got == pytest.approx({("p", "a"): 3 / 4 * 3 / 3, ("q", "a"): 1 / 4 * 1 / 5, ("q", "b"): 4 / 4 * 4 / 5})
    assert made.value == len(rows)


def test_word_groups_are_sets_of_values(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    pairs = [(w, f"c{rng.randrange(150):03d}") for w in words for _ in range(rng.randrange(1, 60))] + [("lone", None), ("w0", None), (None, "c000")]
    toks = [(rng.choice([None, *range(12)]), rng.choice([*words, "other", "lone", None])) for _ in range(300)] + [(99, "other"), (98, "lone")]
    want = {}
    for k, w in toks:
        if w is not None and any(w == x for x, _ in pairs):
            want.setdefault(k, (set(), set()))[0].add(w)
            want[k][1].update(c for x, c in pairs if x == w and c is not None)
    out = jn.word_groups(spark.createDataFrame(toks, "k long, word string"), spark.createDataFrame(pairs, "word string, c string"), "k", "c")
    assert {r.k: (r.n_words, r["values"]) for r in out.collect()} == {k: (len(a), sorted(b)) for k, (a, b) in want.items()}
    none = jn.word_groups(spark.createDataFrame(toks, "k long, word string"), spark.createDataFrame([], "word string, c string"), "k", "c")
    assert none.count() == 0


@pytest.mark.parametrize("cells, features", [(4, 5), (64, 12), (1 << 20, 7), (1 << 20, 10_000)])
def test_tfidf_of_many_is_tfidf_of_groups(spark, cells, features):
    rng = random.Random(cells + features)
    rows = [(s, rng.choice([None, *range(20)]), f"t{int(rng.paretovariate(0.6)) % 300}") for s in ("n2k1", "n3k2") for _ in range(900)]
    rows += [("n3k2", 1, "once"), ("few", 1, "a"), ("few", 2, "a")]
    items = spark.createDataFrame(rows, "shape string, doc long, term string")
    n = items.select(F.count_distinct(F.coalesce("doc", F.lit(-1)))).scalar()
    want = sorted(tuple(r) for r in tf.tfidf_of_groups(items, "shape", n, max_features=features).select("shape", F.coalesce("doc", F.lit(-1)), "term", "tf", "weight").collect())
    placed = items.repartition(3, "doc")
    got = tf.tfidf_of_many(placed, "shape", n, max_features=features, cells=cells).select("shape", F.coalesce("doc", F.lit(-1)), "term", "tf", "weight")
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_grams_of_placed_texts_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c", "a"]) for i in range(6)], "doc long, t array<string>").repartition(3, "doc")
    counts = tf.skipgram_rows(docs, "t", ((2, 1),)).groupBy("shape", "doc", "term").count()
    assert counts._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") == 1
