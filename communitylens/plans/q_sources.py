"""Queries for scans, sources and sinks (S01-S17; S07 is with the class
dictionaries in q_text).  File sinks write under the session's shared
checkpoint folder and the queries return the table read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from communitylens.operators import stats
from communitylens.operators.cooccur import community_tag_sets, jaccard_pairs, outlier_exclusion_list
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import query
from communitylens.session import scratch_path
from communitylens.sources import dictionaries as dic
from communitylens.sources import post_json as pj
from communitylens.sources import sinks
from communitylens.sources.tables import Tables

SHARD_BUDGET = 10_000
EDGE_FILE_ROWS = 10_000


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("scan_posts", "SELECT * FROM posts")
def q_s01(spark, d):
    return Tables(spark, d).posts


@query("parse_post_json", """
SELECT id, created_at, 'en' AS lang, status_text, CAST(user_id AS VARCHAR) AS user_id_str,
  CAST(in_reply_to_user_id AS VARCHAR) AS in_reply_to_user_id_str,
  CASE WHEN kind = 'quote' THEN 'true' ELSE 'false' END AS is_quote_status,
  CASE WHEN kind = 'quote' THEN CAST(id + 1 AS VARCHAR) END AS quoted_status_id_str,
  CASE WHEN kind = 'retweet' THEN CAST(id - 1 AS VARCHAR) END AS retweeted_status_id_str,
  kind = 'retweet' AS retweeted, favorite_count, retweet_count, reply_count, quote_count FROM posts""")
def q_s02(spark, d):
    parsed = pj.parse_post_json(pj.post_json_feed(Tables(spark, d)))
    return parsed.drop("_ent", "_qent", "_rent", "_media")


@query("extract_entities", """
SELECT p.id,
  coalesce((SELECT string_agg('p' || CAST(pt.tag AS VARCHAR), ' ' ORDER BY CASE WHEN p.kind = 'retweet' THEN pt.tag % 2 ELSE 0 END, pt.tag)
            FROM post_tags pt WHERE pt.post_id = p.id), '') AS entities_hashtag,
  coalesce((SELECT string_agg(lower(e.value), ' ' ORDER BY e.value) FROM post_entities e WHERE e.post_id = p.id AND e.kind = 'symbol'), '') AS entities_symbol,
  coalesce((SELECT string_agg(CAST(m.mention AS VARCHAR), ' ' ORDER BY m.mention) FROM post_mentions m WHERE m.post_id = p.id), '') AS entities_user_mention,
  coalesce((SELECT string_agg(e.value, ' ' ORDER BY e.value) FROM post_entities e WHERE e.post_id = p.id AND e.kind = 'url'), '') AS entities_url,
  (SELECT e.value FROM post_entities e WHERE e.post_id = p.id AND e.kind = 'media') AS entities_media_url,
  (SELECT 'photo' FROM post_entities e WHERE e.post_id = p.id AND e.kind = 'media') AS entities_media_type
FROM posts p""")
def q_s03(spark, d):
    ents = pj.extract_entities(pj.parse_post_json(pj.post_json_feed(Tables(spark, d))))
    return ents.select("id", *[F.array_join(c, " ").alias(c) for c in
                               ("entities_hashtag", "entities_symbol", "entities_user_mention", "entities_url")],
                       "entities_media_url", "entities_media_type")


register("dict_long", """
SELECT p_brand AS community, 'p' || CAST(p_partkey AS VARCHAR) AS tag, CASE WHEN p_size <= 5 THEN 'own' ELSE 'cb' END AS kind
FROM part WHERE p_size <= 10""")


def _dict_long(spark, d):
    path = _scratch(spark, "community-dict")
    dic.write_community_tsv(Tables(spark, d).part, path)
    return dic.read_community_dict(spark, path)


@query("read_community_dict", "SELECT community, tag, kind FROM dict_long")
def q_s04(spark, d):
    return _dict_long(spark, d)


@query("invert_community_dict", "SELECT tag, max(community) AS community FROM dict_long GROUP BY tag")
def q_s05(spark, d):
    return dic.invert_community_dict(_dict_long(spark, d))


_ROLLUP_SCHEMA = "user_id bigint, newtweet_count int, retweet_count int, reply_count int, quote_count int"


@query("read_feature_csv", "SELECT user_id, newtweet_count, retweet_count, reply_count, quote_count FROM user_rollup")
def q_s06(spark, d):
    path = _scratch(spark, "features")
    r = stats.user_rollup(Tables(spark, d).posts).select("user_id", "newtweet_count", "retweet_count", "reply_count", "quote_count")
    sinks.sink_rolled_csv(r, path, 10_000)
    return sinks.read_feature_csv(spark, path, _ROLLUP_SCHEMA)


@query("read_multi_value_dict", "SELECT word, community AS value FROM word_dictionary")
def q_s08(spark, d):
    from communitylens.plans.q_joins import word_dictionary
    path = _scratch(spark, "word-dict")
    wd = word_dictionary(Tables(spark, d).part)
    lines = wd.groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("community")), ",").alias("cs"))
    lines.select(F.concat("word", F.lit(","), "cs", F.lit(",,")).alias("value")).write.mode("overwrite").text(path)
    return dic.read_multi_value_dict(spark, path)


register("corpus_lines", """
SELECT CAST(user_id AS VARCHAR) AS "user", CASE WHEN kind = 'retweet' THEN 'rt' ELSE 'ot' END AS kind,
       trim(regexp_replace(status_text, '\\s+', ' ', 'g')) AS text FROM posts""")


def _corpus(spark, d):
    path = _scratch(spark, "user-corpus")
    sinks.sink_user_corpus(Tables(spark, d).posts, path)
    return path


@query("read_user_post_files", """
SELECT "user", kind, regexp_replace(lower(text), '^rt ', '') AS text FROM corpus_lines""")
def q_s09(spark, d):
    return sinks.read_user_post_files(spark, _corpus(spark, d), strip_rt=True)


@query("sink_user_corpus", """SELECT "user" || '|' || kind || '|' || text AS value FROM corpus_lines""")
def q_s12(spark, d):
    return spark.read.text(_corpus(spark, d)).select("value")


@query("user_corpus_files", """SELECT "user", kind, text FROM corpus_lines""")
def q_s12_files(spark, d):
    """S12 and S09 in the original layout: one file a user, line 0 the user,
    written and read back."""
    from communitylens.sources import named_files as nf
    path = _scratch(spark, "user-files")
    posts = Tables(spark, d).posts.select(
        F.col("user_id").alias("user"), F.col("id").alias("post_id"), F.when(F.col("kind") == "retweet", "rt").otherwise("ot").alias("kind"),
        sinks.collapse_whitespace("status_text").alias("text"))
    nf.write_user_corpus(posts, path)
    return nf.read_user_corpus(spark, path)


@query("upsert_in_place", """
SELECT id, CASE WHEN year(created_at) = 1998 THEN favorite_count + reply_count ELSE favorite_count END AS favorite_count,
       CASE WHEN year(created_at) = 1998 THEN 1 ELSE 0 END AS version FROM posts""")
def q_s13_in_place(spark, d):
    """S13 on a kept table: new versions of some posts go into their buckets."""
    path = _scratch(spark, "keyed")
    p = Tables(spark, d).posts
    sinks.create_keyed_table(p.select("id", "favorite_count", F.lit(0).alias("version")), path, "id", 64)
    new = (p.filter(F.year("created_at") == 1998)
           .select("id", (F.col("favorite_count") + F.col("reply_count")).alias("favorite_count"), F.lit(1).alias("version")))
    sinks.upsert_into(path, new, "id", "version", 64)
    return sinks.read_keyed_table(spark, path)


@query("sink_rolled_csv", """
SELECT p.user_id AS "from", m.mention AS "to", count(*) AS weight
FROM posts p JOIN post_mentions m ON p.id = m.post_id GROUP BY p.user_id, m.mention""")
def q_s10(spark, d):
    t = Tables(spark, d)
    e = t.posts.select(F.col("id").alias("post_id"), F.col("user_id").alias("from")).join(
        t.post_mentions.withColumnRenamed("mention", "to"), "post_id")
    path = _scratch(spark, "edges")
    sinks.sink_rolled_csv(stats.edge_weights(e), path, EDGE_FILE_ROWS)
    return sinks.read_feature_csv(spark, path, "from bigint, to bigint, weight bigint")


@query("shard_by_word_budget", f"""
WITH p AS (SELECT id, CAST(CASE WHEN regexp_replace(status_text, '\\s+$', '') = '' AND length(status_text) > 0 THEN 0
                  ELSE len(string_split_regex(regexp_replace(status_text, '\\s+$', ''), '\\s+')) END AS BIGINT) AS n_tokens,
                  length(status_text) > 2 AS written
           FROM posts WHERE user_id NOT IN (SELECT id FROM users WHERE label IS NULL))
SELECT id, n_tokens, CAST(floor(coalesce(sum(n_tokens) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {SHARD_BUDGET}) AS BIGINT) AS shard,
       written FROM p""")
def q_s11(spark, d):
    t = Tables(spark, d)
    ignore = t.users.filter(F.col("label").isNull()).select(F.col("id").alias("user_id"))
    return sinks.corpus_shards(t.posts, ignore, SHARD_BUDGET)


@query("upsert_by_id", """
SELECT id, CASE WHEN year(created_at) = 1998 THEN favorite_count + reply_count ELSE favorite_count END AS favorite_count,
       CASE WHEN year(created_at) = 1998 THEN 1 ELSE 0 END AS version FROM posts""")
def q_s13(spark, d):
    p = Tables(spark, d).posts
    old = p.select("id", "favorite_count", F.lit(0).alias("version"))
    new = (p.filter(F.year("created_at") == 1998)
           .select("id", (F.col("favorite_count") + F.col("reply_count")).alias("favorite_count"), F.lit(1).alias("version")))
    return sinks.upsert_by_id(old, new, "id", "version")


@query("partial_update", """
WITH u AS (SELECT l_orderkey AS id, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS fav,
                  count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS rt FROM lineitem GROUP BY l_orderkey)
SELECT p.id, CASE WHEN u.fav > 0 THEN u.fav ELSE p.favorite_count END AS favorite_count,
       CASE WHEN u.rt > 0 THEN u.rt ELSE p.retweet_count END AS retweet_count
FROM posts p LEFT JOIN u ON p.id = u.id""")
def q_s14(spark, d):
    t = Tables(spark, d)
    li = t.lineitem
    upd = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("favorite_count"),
        F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("retweet_count"))
    base = t.posts.select("id", F.col("favorite_count").cast("bigint"), F.col("retweet_count").cast("bigint"))
    return sinks.partial_update(base, upd, "id", positive_only=("favorite_count", "retweet_count"))


def _s15_sql():
    from communitylens.plans.q_stats import A01_SQL
    return f"SELECT tag, total_tweets, avg_hashtags, avg_tweet_length FROM ({A01_SQL}) s ORDER BY tag"


@query("merge_shards", _s15_sql())
def q_s15(spark, d):
    from communitylens.plans.q_stats import content_of
    cs = content_of(Tables(spark, d)).select(
        "tag", "total_tweets", "avg_hashtags", "avg_tweet_length")
    path = _scratch(spark, "stats-shards")
    cs.repartition(4).write.mode("overwrite").option("header", "true").csv(path)
    return sinks.merge_shards(spark, path, "tag string, total_tweets bigint, avg_hashtags double, avg_tweet_length double", "tag")


@query("sink_wide_matrix", """
WITH m AS (SELECT DISTINCT pc.community AS g, lt.tag AS e FROM post_communities pc JOIN long_tags lt ON pc.post_id = lt.post_id
           WHERE lt.tag NOT IN (SELECT tag FROM excluded_tags)),
sz AS (SELECT g, count(*) AS n FROM m GROUP BY g),
ov AS (SELECT a.g AS g1, b.g AS g2, count(*) AS inter FROM m a JOIN m b ON a.e = b.e AND a.g < b.g GROUP BY a.g, b.g),
s AS (SELECT g1, g2, inter / (s1.n + s2.n - inter) AS similarity FROM ov JOIN sz s1 ON ov.g1 = s1.g JOIN sz s2 ON ov.g2 = s2.g)
SELECT g1 AS community, g2 AS other, similarity FROM s UNION ALL SELECT g2, g1, similarity FROM s""")
def q_s16(spark, d):
    t = Tables(spark, d)
    excl = outlier_exclusion_list(t.post_tags, t.communities, 100)
    pairs = jaccard_pairs(community_tag_sets(t.post_tags, t.post_communities, excl), "community", "tag")
    path = _scratch(spark, "matrix")
    sinks.long_matrix(pairs, "community1", "community2", "similarity").write.parquet(path)
    return spark.read.parquet(path)


@query("quarantine_bad_records", """
SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events""")
def q_s17(spark, d):
    return pj.quarantine_bad_records(pj.event_feed(Tables(spark, d).events))
