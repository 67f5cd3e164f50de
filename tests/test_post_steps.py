"""Posts made in one pass over their lines: content statistics, the post feed
and the weights of several text columns."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from communitylens.operators import stats
from communitylens.operators import textfeat as tf
from communitylens.plans.q_stats import content_of
from communitylens.sources import post_json as pj
from communitylens.sources.tables import Tables

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
PARTS = "p_partkey long, p_name string, p_type string, p_size int, p_brand string"
ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Posts 1 to 5: 3 without a community, 4 without lines, 5 delivered
    twice; 6 has lines only; nulls and repeated lines."""
    day = dt.datetime(2020, 1, 2)
    rows = {
        "part": (PARTS, [(1, "red  Blue", "T1", 3, "A"), (2, "blue", "T2", 5, "B"), (3, "green", None, 40, "A"),
                         (4, None, "T1", 1, "A"), (5, "grey", "T1", 2, None), (2, "blue", "T2", 5, "B")]),
        "lineitem": (LINES, [(1, 2, 7, 2, 1.0, "R", "O"), (1, 1, 7, 1, 2.0, "A", "O"), (1, 1, 8, 1, 2.0, "A", "O"),
                             (2, 4, None, 1, 5.0, "R", "F"), (2, 3, 9, None, 5.0, "A", "F"), (3, 3, 7, 1, 1.0, "R", "O"), (3, 5, 7, 2, 1.0, "R", "O"),
                             (5, 1, 7, 1, 1.0, "N", "O"), (6, 2, 7, 1, 1.0, "N", "O"), (None, 1, 7, 1, 1.0, "N", "O"), (1, 99, 7, 3, 1.0, "N", "O")]),
        "orders": (ORDERS, [(1, 10, day, "5-LOW"), (2, 10, day, None), (3, 11, day, "3-MEDIUM"), (4, 12, day, "2-HIGH"),
                            (5, 12, day, "1-URGENT"), (5, 13, day, "5-LOW"), (None, 13, day, "5-LOW")])}
    base = str(tmp_path_factory.mktemp("posts"))
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{base}/{name}.parquet")
    return Tables(spark, base)


def reads(df, column):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [{column}#")


def test_content_stats_read_the_lines_once(tables):
    out = content_of(tables)
    assert reads(out, "l_orderkey") == 1
    want = stats.content_stats(tables.posts, tables.post_entities, tables.post_communities, tables.communities)
    rows = {r["tag"]: r.asDict() for r in out.collect()}
    assert rows == {r["tag"]: r.asDict() for r in want.collect()}
    a = rows["A"]  # posts 1, 2 and both rows of 5; "RT red blue red blue blue blue", "green", "red blue", "RT red blue"
    assert a["total_tweets"] == 4 and a["avg_tweet_length"] == (7 + 1 + 2 + 3) / 4 and a["avg_tweet_uniquewords"] == 4 / 4
    assert a["avg_unique_hashtag"] == 4 / 4 and a["avg_hashtags"] == (2 + 2 + 1) / 4 and a["avg_mention"] == (2 + 1 + 1) / 4
    assert rows[None]["total_tweets"] == 0 and rows["B"]["total_tweets"] == 1


def test_post_feed_reads_the_lines_once(tables):
    feed = pj.post_json_feed(tables)
    assert reads(feed, "l_orderkey") == 1
    posts = {}
    for r in feed.collect():
        posts.setdefault(json.loads(r[0]).get("id_str"), []).append(json.loads(r[0]))
    assert sorted(map(str, posts)) == ["1", "2", "3", "4", "5", "None"] and len(posts["5"]) == 2
    one = posts["1"][0]
    assert one["text"] == "RT red  Blue red  Blue blue blue" and one["retweet_count"] == 2 and one["favorite_count"] == 4
    ent = one["entities"]
    assert [x["text"] for x in ent["hashtags"]] == ["P2"] and [x["text"] for x in one["retweeted_status"]["entities"]["hashtags"]] == ["P1"]
    assert [x["id_str"] for x in ent["user_mentions"]] == ["7", "8"] and [x["text"] for x in ent["symbols"]] == ["T1", "T2"]
    assert [x["expanded_url"] for x in ent["urls"]] == ["https://shop.example/size/3", "https://shop.example/size/5"]
    assert one["extended_entities"]["media"][0]["media_url"] == "red  Blue"
    assert posts["4"][0]["text"] == "" and posts["4"][0]["entities"]["hashtags"] == []


def test_weights_of_columns_do_not_move_the_counts(spark):
    texts = [(1, "a b b"), (2, "b c"), (2, "c c d"), (3, "d"), (None, "a"), (4, "")]
    df = spark.createDataFrame(texts, "doc long, text string").repartition("doc")
    items = {n: df.select("doc", F.explode(F.split(c, " ")).alias("term")).filter("term <> ''")
             for n, c in (("x", F.col("text")), ("y", F.reverse("text")))}
    out = tf.tfidf_by_column(items, F.lit(6), min_df=2, max_df=0.9, max_features=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    counts = {}
    for d, t in texts:
        for w in t.split():
            counts[d, w] = counts.get((d, w), 0) + 1
    df_, cf = {}, {}
    for (_, w), n in counts.items():
        df_[w], cf[w] = df_.get(w, 0) + 1, cf.get(w, 0) + n
    top = sorted((w for w in df_ if 2 <= df_[w] <= 5.4), key=lambda w: (-cf[w], w))[:2]
    want = {(n, d, w, c, round(c * (math.log(6 / df_[w]) + 1), 6)) for n in "xy" for (d, w), c in counts.items() if w in top}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
