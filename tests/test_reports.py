"""Quantiles, long forms, word lists and printed deltas on micro tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from communitylens.functions.text import analyse_text, fold_accents
from communitylens.operators import model as md
from communitylens.operators import sets as st
from communitylens.operators import stats
from communitylens.operators import textfeat as tf
from communitylens.session import scratch_path
from communitylens.sources import dictionaries as dic
from communitylens.sources import sinks


def test_set_except_with_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (3,)], "tag int")
    b = spark.createDataFrame([(1,), (3,), (3,)], "tag int")
    assert [r.tag for r in st.set_except(a, b).collect()] == [2]


def test_ranks_and_fences_equal_a_sort(spark):
    rng = random.Random(3)
    groups = {"a": [rng.choice([-5.5, -0.0, 0.0, 1, 7, 7, 1e9, 3.25]) for _ in range(400)],
              "b": [float(rng.randint(-10**6, 10**6)) for _ in range(1001)], "c": [4.0], "d": [2.0] * 30}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    for r in stats.iqr_outliers(df, ["g"], "v").collect():
        v = sorted(groups[r.g])
        q1, q3 = v[len(v) * 25 // 100], v[len(v) * 75 // 100]
        assert (r.n, r.q1, r.q3) == (len(v), q1, q3)
        assert r.n_high == sum(x > q3 + 1.5 * (q3 - q1) for x in v) and r.n_low == sum(x < q1 - 1.5 * (q3 - q1) for x in v)
    for r in stats.distribution_summary(df, "v", ["g"]).collect():
        v = sorted(groups[r.g])
        if len(v) > 1:
            want = statistics.quantiles(v, n=4, method="inclusive")
            assert [r.p25, r.p50, r.p75] == pytest.approx(want, abs=1e-4)
        assert (r.max, r.min) == (v[-1], v[0]) and r.mean == pytest.approx(sum(v) / len(v), rel=1e-6, abs=1e-4)


def test_dictionary_match_is_long_and_has_zero_rows(spark):
    toks = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "user long, word string")
    d = spark.createDataFrame([(f"class {i}", "x" if i == 0 else f"w{i}", 0.5) for i in range(1500)],
                              "class string, word string, score double")
    got = tf.dictionary_match(toks, d)
    assert got.count() == 2 * 1500
    hit = got.filter("match_count > 0").collect()
    assert [(r.user, r.dict, r.score_sum, r.match_count, r.any_match) for r in hit] == [(1, "class 0", 0.5, 1, 1)]


def test_entry_shares_keep_users_without_a_hit(spark):
    toks = spark.createDataFrame([(1, "x"), (1, "x"), (1, "q"), (2, "z")], "user long, word string")
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "dictionary string, word string")
    got = {(r.user, r.dictionary, r.entry): (round(r.share, 4), r.n_entries) for r in tf.entry_shares(toks, d).collect()}
    assert got == {(1, "a", "x"): (0.6667, 1), (2, "b", "z"): (1.0, 1), (1, "a", None): (0.6667, 1), (1, "b", None): (0.0, 0),
                   (2, "a", None): (0.0, 0), (2, "b", None): (1.0, 1)}


def test_multi_value_lines_lose_no_value(spark):
    path = scratch_path(spark, f"multi-{random.random()}")
    dic.write_text_file(spark, f"{path}/words.csv", "w," + ",".join(f"c{i}" for i in range(5000)) + ",, \nempty,\n")
    assert dic.read_multi_value_dict(spark, path).count() == 5000


def test_word_lists_by_file_name(spark):
    path = scratch_path(spark, f"lists-{random.random()}")
    dic.write_text_file(spark, f"{path}/person titles.txt", "dr\n\n prof \n")
    dic.write_text_file(spark, f"{path}/b.txt", "dr")
    got = {tuple(r) for r in dic.read_word_lists(spark, path).collect()}
    assert got == {("person titles", "dr"), ("person titles", "prof"), ("b", "dr")}


def test_class_dictionary_files(spark):
    path = scratch_path(spark, f"classes-{random.random()}")
    dic.write_text_file(spark, f"{path}/hpi_nouns.csv", 'b,0.5\na,0.25\n"c,d",0.1\n')
    dic.write_text_file(spark, f"{path}/hpo_2_verbs.csv", "run,1.5\nno score\nrun,0.5\nlast,9\n")
    dic.write_text_file(spark, f"{path}/hpo_any.txt", "x,1")
    got = {tuple(r) for r in dic.read_class_dictionary_files(spark, path, 3).select("pos", "label", "word", "score").collect()}
    assert got == {("nouns", "hpi", "b", 0.5), ("nouns", "hpi", "a", 0.25), ("nouns", "hpi", "c,d", 0.1),
                   ("verbs", "hpo", "run", 0.5), ("verbs", "hpo", "no score", 0.0), ("any", "hpo", "x", 1.0)}
    assert dic.read_class_dictionary_files(spark, path, 2, pos=["nouns"]).count() == 2


def test_user_files(spark):
    path = scratch_path(spark, f"users-{random.random()}")
    dic.write_text_file(spark, f"{path}/a.txt", "ann\not|one | two\nrt|three\nno bar here\n")
    dic.write_text_file(spark, f"{path}/b.txt", "bob\nxx|four")
    assert {tuple(r) for r in dic.read_user_files(spark, path).collect()} == {
        ("ann", "ot", "one | two"), ("ann", "rt", "three"), ("bob", "rt", "four")}


def test_matrix_long_and_wide(spark):
    pairs = spark.createDataFrame([("#a", "b", 0.5), ("b", "c", 0.25)], "x string, y string, s double")
    long = {tuple(r) for r in sinks.long_matrix(pairs, "x", "y", "s").collect()}
    assert long == {("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", 0.25), ("c", "b", 0.25)}
    wide = sinks.wide_matrix(pairs, "x", "y", "s", ["#a", "b", "c"])
    assert sorted(wide.columns) == ["a", "b", "c", "community"] and wide.count() == 3


def test_printed_deltas_go_back_to_the_values(spark):
    base = spark.createDataFrame([("k", 0.51, 0.7, 0.333)], "class string, p double, r double, f1 double")
    other = spark.createDataFrame([("k", 0.48, 0.7, 0.9)], "class string, p double, r double, f1 double")
    deltas = md.format_deltas(base, other, ["class"])
    assert {r.metric: r.delta for r in deltas.collect()} == {"p": "(0.03)", "r": "-", "f1": "0.57"}
    got = {r.metric: r.value for r in md.absolute_results(base, deltas, ["class"]).collect()}
    assert got == {"p": 0.48, "r": 0.7, "f1": 0.9}


def test_out_of_fold_predicts_every_row_once(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(i, [float(i % 2), i / 100], float(i % 2)) for i in range(60)],
                               "user_id long, x array<double>, label_idx double").withColumn("features", array_to_vector("x"))
    got = md.out_of_fold(df, {"lr": LogisticRegression(labelCol="label_idx")}, "user_id", "label_idx", 3).collect()
    assert sorted(r.user_id for r in got) == list(range(60)) and {r.fold for r in got} == {0, 1, 2}
    assert all(r.prediction == r.label_idx for r in got)


def test_folding(spark):
    df = spark.createDataFrame([("Šš łŁ ğ ő ñ Æß ẽ Đ x",)], "t string")
    assert df.select(F.concat(fold_accents("t"))).first()[0] == "Ss lL g o n AEss e D x"


def test_folding_covers_names_decompositions_and_fixed_values(spark):
    texts = {"Þór ðað ŋ ſ": "THor dad n s", "ﬁne ﬄ Ｔｅｘｔ９": "fine ffl Text9", "x² H₂O ⑳ ª": "x2 H2O 20 a",
             "ƒ Ɓ ɛ ŉ ǆ ǅ": "f B e n dz Dz", "don’t ‘a’": "don't 'a'", "Ελλάδα ½ – µ": "Ελλάδα ½ – µ", "": ""}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.f for r in df.select("t", fold_accents("t").alias("f")).collect()}
    assert got == {**texts, None: None}
    assert df.filter("t LIKE 'don%'").select(analyse_text("t").alias("a")).first().a == []
