"""Named feature sets hold all columns of their blocks, from posts made once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from communitylens.operators import edges as eg
from communitylens.plans import q_edges, q_model
from communitylens.sources.tables import Tables

DAY = dt.datetime(2020, 1, 2)
ROWS = {
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                 [(1, "Ann One", 0, 100.5, "BUILDING"), (2, None, 0, -51.0, "MACHINERY"), (3, "Cy", None, None, None)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
    "documents": ("doc_id long, text string, lang string, source string, n_chars int",
                  [(1, "doctor health health", "en", "a", 20), (2, "doctor krankheit", "de", "a", 16), (4, "", "en", "a", 0)]),
    "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
               [(1, DAY, 1, "click", 1.0, "{}"), (2, DAY, 1, "view", 1.0, "{}")]),
    "pages": ("page_id long, url string, html string", [(1, "http://a", "")]),
    "part": ("p_partkey long, p_name string, p_type string, p_size int, p_brand string",
             [(1, "red blue", "T", 3, "A"), (2, "rt green", "T", 9, "B"), (3, "red", None, 3, "A")]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
               [(1, 1, DAY, "5-LOW"), (2, 1, DAY, "1-URGENT"), (2, 1, DAY, "1-URGENT"), (3, 2, DAY, None), (None, 2, DAY, "5-LOW")]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
                 [(1, 1, 7, 1, 2.0, "R", "O"), (1, 3, 8, 2, 3.0, "A", "O"), (2, 2, 7, 1, 1.0, "R", "O"), (2, 1, None, 2, 1.0, "N", "O"),
                  (3, 99, 7, 1, 1.0, "N", "O"), (None, 1, 7, 1, 1.0, "N", "O")])}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sets"))
    for name, (schema, data) in ROWS.items():
        spark.createDataFrame(data, schema).write.parquet(f"{base}/{name}.parquet")
    return base


def test_sets_hold_all_counters_and_all_values_of_a_match(spark, folder):
    got = {}
    for r in q_model.q_m01(spark, folder).collect():
        got.setdefault((r.block, r.user_id), {})[r.feature] = r.value
    one = got["behaviour", 1]
    assert len(one) == 16
    assert {k.removeprefix("user_"): v for k, v in one.items() if k.startswith("user_") and k != "user_activeness"} == {
        "statuses_count": 3, "friends_count": 10, "favorites_count": 1, "retweeted_count": 2 + 2 * 1, "retweet_count": 3, "followers_count": 100,
        "listed_count": 2, "newtweet_count": 0, "favorited_count": 3, "entities_hashtag": 3, "entities_url": 2, "entities_user_mention": 2,
        "entities_media_url": 2}
    two = got["behaviour", 2]  # no screen name; one post without a known part, one without a key
    assert two["user_statuses_count"] == 2 and two["user_entities_hashtag"] == 0 and set(two) == set(one)
    assert len(got["behaviour", 3]) == 16
    en = {k: v for k, v in got["auto", 1].items() if k.startswith("en")}
    assert set(en) == {"en", "en_match_count", "en_max_score", "en_any_match"} and en["en_match_count"] == 2 and en["en_any_match"] == 1
    assert 0 < en["en_max_score"] < en["en"]
    names = {k.split("_")[0] for k in got["manual", 1]}
    assert all({n, f"{n}_score_sum", f"{n}_max_score", f"{n}_any_match"} <= set(got["manual", 1]) for n in names)


def test_posts_of_the_user_table_are_made_once(spark, folder, monkeypatch):
    whole, made = Tables._lines, []
    monkeypatch.setattr(Tables, "_lines", lambda t: made.append(t) or whole(t))
    out = q_edges.q_g05(spark, folder)
    assert len(made) == 1
    # a user's clicks, posts and different entities, which are gathered once, and the numbers of these
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [user_id#") == 4
    rows = {r.user_screen_name: r for r in out.collect()}
    assert set(rows) == {"Ann One", "Cy"}
    assert rows["Ann One"].user_entities_hashtag == 3 and rows["Ann One"].user_entities_media_url == 2 and rows["Cy"].user_statuses_count == 0


def test_edges_of_a_community_are_made_where_its_posts_lie(spark, folder):
    t = Tables(spark, folder)
    pc = t.post_communities.select("community", F.concat(F.lit("ID_"), F.col("post_id").cast("string")).alias("imported_id"))
    want = pc.join(q_edges._edges(t, q_edges._screen_names(t)), "imported_id").select("community", *eg.EDGE_COLUMNS)
    out = q_edges.q_g02(spark, folder)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect())) and out.count() == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(imported_id" not in plan


def test_rows_of_a_set_are_kept_packed(spark, monkeypatch):
    whole = DataFrame.checkpoint
    rows = spark.createDataFrame([("text", u, w, 1.0) for u in range(300) for w in ("health", "doctor", "krankheit")],
                                 "block string, user_id long, feature string, value double")
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: pytest.fail("rows of a set are not kept as Java rows") if "value" in a[0].columns else whole(*a, **k))
    vectors, index, path = q_model.set_vectors(spark, rows, spark.range(300).withColumnRenamed("id", "user_id"), "text")
    assert vectors.count() == 300 and index.count() == 3
    kept = path.removesuffix("/vectors") + "/rows"
    assert spark.read.parquet(kept).count() == 900
