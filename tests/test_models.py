"""Outputs of the trained models (T13-T15) and what must hold of them."""

import __spark_entry__ as E
from communitylens.plans import q_model

SF = "/root/testdata/sf0.001"


def test_topic_weights_leave_the_query(spark, monkeypatch):
    whole = q_model.topic_weights
    monkeypatch.setattr(q_model, "topic_weights", lambda docs: whole(docs, topics=5, iterations=2))
    got = E.queries()["lda_topics"](spark, SF).collect()
    sums = {}
    for r in got:
        assert 0 <= r.weight <= 1
        sums.setdefault(r.doc_id, {})[r.topic] = r.weight
    assert all(len(w) == 5 and round(sum(w.values()), 4) in (0, 1) for w in sums.values())


def test_clusters_and_counts_leave_the_queries(spark, monkeypatch):
    whole = q_model.vector_clusters
    monkeypatch.setattr(q_model, "vector_clusters", lambda e: whole(e, k=8, iterations=3))
    clusters = E.queries()["word_vectors_and_clusters"](spark, SF).collect()
    assert len({r.vec_id for r in clusters}) == len(clusters) and 1 < len({r.cluster for r in clusters}) <= 8
    counts = E.queries()["word_cluster_counts_trained"](spark, SF).collect()
    items = q_model.q_text.cluster_items(q_model.Tables(spark, SF)).groupBy("user").count().collect()
    own = {}
    for r in counts:
        own[r.user] = own.get(r.user, 0) + r.n
    assert own == {r.user: r["count"] for r in items} and len({r.cluster for r in counts}) > 1


def test_trainings_are_not_shortened(spark, monkeypatch):
    from pyspark.sql import functions

    from communitylens.operators import boosting
    seen = []

    def note(out):
        return lambda *a, **k: seen.append((len(a), sorted(k))) or out

    df = spark.range(3).selectExpr("id AS user_id", "0.0 AS label_idx", "array(1.0) AS features")
    indexer = type("Indexer", (), {"labels": ["a", "b"]})
    monkeypatch.setattr(q_model, "_training", lambda spark, d: (df, df, ["x"], indexer))
    monkeypatch.setattr(q_model.md, "class_weights", lambda df: df)
    monkeypatch.setattr(q_model.md, "fold_column", lambda df, *a: df.selectExpr("*", "0 AS fold"))
    monkeypatch.setattr("pyspark.ml.functions.vector_to_array", functions.col)
    monkeypatch.setattr(q_model.md, "classifiers", note({}))
    part = df.selectExpr("'m' AS model", "user_id", "label_idx", "0.0 AS prediction", "0 AS fold")
    monkeypatch.setattr(q_model.md, "out_of_fold", note(part))
    monkeypatch.setattr(boosting, "boost_out_of_fold", note(part.drop("model")))
    E.queries()["train_classifiers"](spark, SF)
    monkeypatch.setattr(q_model, "topic_weights", note(df))
    E.queries()["lda_topics"](spark, SF)
    assert seen == [(3, []), (4, []), (4, ["classes"]), (1, [])]
