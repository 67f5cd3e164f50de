"""The whole pipeline over small folders: what stays, and odd tables."""

import random

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, cell string"
LABELS = "doc_id long, quality int, toxic int"


def folder(spark, tmp_path, docs, labels, name="sf"):
    path = str(tmp_path / name)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def texts(seed, n):
    """Good texts of real words, bad ones of junk; and which is which."""
    rng = random.Random(seed)
    words = ["river", "mountain", "letter", "window", "garden", "music", "winter", "paper", "stone", "market", "harbour", "village"]
    for i in range(n):
        good = rng.random() < .8
        pool = words if good else ["$$$", "!!!", "zxqj", "%%%", "###", "qqq", "xx7"]
        yield i, " ".join(rng.choice(pool) + (str(rng.randint(0, 999)) if rng.random() < .3 else "") for _ in range(40)), good


def test_stages_take_effect(spark, tmp_path):
    made = list(texts(1, 240))
    docs = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t), "r", 1, "c") for i, t, _ in made]
    original = next(t for _, t, good in made if good)
    docs += [(1000 + k, original, "en", "a", 0, "", 0, "") for k in range(60)]  # one large group of copies
    near = original.split()
    docs += [(2000 + k, " ".join([*near, *near, *near, *near, f"end{k}"]), "en", "b", 0, "", 0, "") for k in range(20)]  # near copies
    docs += [(3000, None, None, None, None, None, None, None), (3001, "", "", "", 0, "", 0, ""), (None, original, None, "a", 0, "", 0, "")]
    labels = [(i, int(good), 0) for i, _, good in made if i % 3]
    got = cp.run(spark, folder(spark, tmp_path, docs, labels)).collect()
    ids = [r.doc_id for r in got]
    clean = [i for i, _, good in made if good and made[i][1] != original]
    assert {i for i in ids if i is not None and i < 1000} <= set(i for i, _, good in made if good)
    assert len(set(ids) & set(clean)) > 0.2 * len(clean)  # the mix takes sources by weight
    copies = {i for i in ids if i is None or 1000 <= i < 2000 or i < 1000 and made[i][1] == original}
    assert len(copies) <= 1 and len({i for i in ids if i is not None and 2000 <= i < 3000}) <= 1
    assert all(r.n_tokens > 0 and len(r.ids_sha256) == 64 for r in got)
    again = cp.run(spark, str(tmp_path / "sf")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_no_documents_and_no_labels(spark, tmp_path):
    assert cp.run(spark, folder(spark, tmp_path, [], [(1, 1, 0)], "none")).count() == 0
    docs = [(i, t, "en", "a", 0, "", 0, "") for i, t, _ in texts(2, 30)]
    assert cp.run(spark, folder(spark, tmp_path, docs, [], "unlabelled")).count() >= 0


def test_stages_keep_the_columns(spark, tmp_path):
    docs = [(i, t, "en", "a", 0, "", 0, "") for i, t, _ in texts(3, 60)]
    path = folder(spark, tmp_path, docs, [(i, i % 2, 0) for i in range(60)])
    df = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, df, path).columns == df.columns, name
