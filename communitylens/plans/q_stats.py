"""Queries for community statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.operators import stats
from communitylens.plans.registry import query
from communitylens.plans.sqlfrag import ratio, split_ws
from communitylens.sources.tables import Tables

_KINDS = stats.ENTITY_KINDS
_U = {"hashtag": "avg_unique_hashtag", "mention": "avg_unique_mention", "url": "avg_unique_urls",
      "media": "avg_unique_media", "symbol": "avg_unique_symbol"}
_T = {"hashtag": "avg_hashtags", "mention": "avg_mention", "url": "avg_urls",
      "media": "avg_media", "symbol": "avg_symbol"}

A01_SQL = f"""
WITH pcw AS (
  SELECT pc.community, pc.post_id, w.words
  FROM post_communities pc JOIN (SELECT id AS post_id, {split_ws('status_text')} AS words FROM posts) w
    ON pc.post_id = w.post_id),
base AS (SELECT community, count(*) AS total_tweets, sum(len(words)) AS n_words FROM pcw GROUP BY community),
uw AS (SELECT community, count(DISTINCT word) AS u_words
       FROM (SELECT community, unnest(words) AS word FROM pcw) x GROUP BY community),
ent AS (SELECT pc.community, count(DISTINCT e.value) AS u_any,
  {", ".join(f"count(DISTINCT CASE WHEN e.kind = '{k}' THEN e.value END) AS u_{k}" for k in _KINDS)},
  {", ".join(f"count(CASE WHEN e.kind = '{k}' THEN 1 END) AS t_{k}" for k in _KINDS)}
  FROM post_communities pc JOIN post_entities e ON pc.post_id = e.post_id GROUP BY pc.community),
j AS (SELECT n.community, coalesce(b.total_tweets, 0) AS n, coalesce(b.n_words, 0) AS n_words,
        coalesce(uw.u_words, 0) AS u_words, coalesce(ent.u_any, 0) AS u_any,
        {", ".join(f"coalesce(ent.u_{k}, 0) AS u_{k}, coalesce(ent.t_{k}, 0) AS t_{k}" for k in _KINDS)}
      FROM (SELECT DISTINCT community FROM communities) n
      LEFT JOIN base b ON n.community = b.community
      LEFT JOIN uw ON n.community = uw.community
      LEFT JOIN ent ON n.community = ent.community)
SELECT community AS tag, CAST(n AS BIGINT) AS total_tweets,
  {", ".join(f"{ratio('u_' + k, 'n')} AS {_U[k]}" for k in _KINDS)},
  {ratio('u_any', 'n')} AS avg_unique_anyentity,
  {", ".join(f"{ratio('t_' + k, 'n')} AS {_T[k]}" for k in _KINDS)},
  {ratio(' + '.join('t_' + k for k in _KINDS), 'n')} AS avg_anyentity,
  {ratio('u_words', 'n')} AS avg_tweet_uniquewords,
  {ratio('n_words', 'n')} AS avg_tweet_length,
  {ratio('u_words', 'n_words')} AS avg_tweet_density
FROM j
"""


def content_of(t):
    """A01 of a data folder: from written views where the session has them,
    else from one row for each post of a community."""
    if t.has_views:
        return stats.content_stats(t.posts, t.post_entities, t.post_communities, t.communities)
    return stats.content_stats_of_rows(t.community_posts, t.communities)


@query("content_stats", A01_SQL)
def q_content_stats(spark, sf_dir):
    return content_of(Tables(spark, sf_dir))


# ---- A02 ----------------------------------------------------------------------------
def _a02_sql() -> str:
    inter = "(retweet_count > 0 OR quote_count > 0 OR favorite_count > 0 OR reply_count > 0)"

    def cs(cond, val="1"):
        return f"sum(CASE WHEN {inter} AND {cond} THEN {val} ELSE 0 END)"

    return f"""
WITH g AS (SELECT pc.community, count(*) AS n_all, {cs('TRUE')} AS n_interacted,
  {cs('retweet_count > 0')} AS retweeted, {cs('retweet_count > 0', 'retweet_count')} AS rt_freq,
  {cs('quote_count > 0')} AS quoted, {cs('quote_count > 0', 'quote_count')} AS quote_freq,
  {cs('favorite_count > 0')} AS liked, {cs('favorite_count > 0', 'favorite_count')} AS like_freq,
  {cs('reply_count > 0')} AS replied, {cs('reply_count > 0', 'reply_count')} AS reply_freq,
  {cs("kind = 'reply'")} AS as_replies_n, {cs("kind = 'quote'")} AS as_quotes_n
  FROM post_communities pc JOIN posts p ON p.id = pc.post_id GROUP BY pc.community)
SELECT community AS tag, CAST(n_interacted AS BIGINT) AS total,
  {ratio('retweeted + quoted', 'n_all')} AS pct_retweeted, {ratio('rt_freq + quote_freq', 'n_all')} AS avg_rt_freq,
  {ratio('liked', 'n_all')} AS pct_liked, {ratio('like_freq', 'n_all')} AS avg_like_freq,
  {ratio('replied', 'n_all')} AS pct_replied, {ratio('reply_freq', 'n_all')} AS avg_reply_freq,
  {ratio('n_interacted', 'n_all')} AS pct_interacted,
  {ratio('rt_freq + quote_freq + like_freq + reply_freq', 'n_all')} AS avg_interact_freq,
  {ratio('as_replies_n', 'n_all')} AS as_replies, {ratio('as_quotes_n', 'n_all')} AS as_quotes,
  CAST(n_interacted AS BIGINT) AS n_interacted, CAST(n_all AS BIGINT) AS n_all FROM g"""


@query("interaction_stats", _a02_sql())
def q_interaction_stats(spark, d):
    t = Tables(spark, d)
    return stats.interaction_stats(t.posts, t.post_communities)


# ---- A05 / A06 / A07 / A08 ---------------------------------------------------------------
from communitylens.plans.oracle_views import register  # noqa: E402

register("user_rollup", """
SELECT user_id,
  CAST(sum(CASE WHEN NOT starts_with(lower(status_text), 'rt ') THEN 1 ELSE 0 END) AS INTEGER) AS newtweet_count,
  CAST(sum(CASE WHEN starts_with(lower(status_text), 'rt ') THEN 1 ELSE 0 END) AS INTEGER) AS retweet_count,
  CAST(sum(CASE WHEN in_reply_to_user_id IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS reply_count,
  CAST(sum(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END) AS INTEGER) AS quote_count,
  CAST(sum(favorite_count) AS BIGINT) AS favorited_count, CAST(sum(reply_count) AS BIGINT) AS replied_count,
  CAST(sum(retweet_count) AS BIGINT) AS retweeted_count, CAST(sum(quote_count) AS BIGINT) AS quoted_count
FROM posts GROUP BY user_id""")
register("user_communities", """
SELECT DISTINCT p.user_id, pc.community FROM posts p JOIN post_communities pc ON p.id = pc.post_id""")


@query("user_rollup", f"""
WITH sets AS (SELECT user_id, {", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in _KINDS)}
  FROM (SELECT DISTINCT p.user_id, e.kind, e.value FROM posts p JOIN post_entities e ON p.id = e.post_id) x
  GROUP BY user_id)
SELECT r.*, {", ".join(f"coalesce(s.n_{k}, 0) AS n_{k}" for k in _KINDS)}
FROM user_rollup r LEFT JOIN sets s ON r.user_id = s.user_id""")
def q_user_rollup(spark, d):
    t = Tables(spark, d)
    return stats.user_rollup_with_sets(t.posts, t.post_entities)


@query("user_entity_sets", f"""
WITH own AS (SELECT p.user_id, e.kind, e.value FROM posts p JOIN post_entities e ON p.id = e.post_id)
SELECT DISTINCT user_id, kind, value FROM own
UNION SELECT user_id, 'media_type', '{stats.MEDIA_TYPE}' FROM own WHERE kind = 'media'""")
def q_user_entity_sets(spark, d):
    t = Tables(spark, d)
    return stats.user_entity_sets(t.posts, t.post_entities)


@query("distinct_authors", "SELECT DISTINCT user_id FROM posts")
def q_distinct_authors(spark, d):
    return stats.distinct_authors(Tables(spark, d).posts)


@query("communities_per_user", """
SELECT u.id AS user_id, CAST(coalesce(n.n_communities, 0) AS BIGINT) AS n_communities FROM users u
LEFT JOIN (SELECT user_id, count(DISTINCT community) AS n_communities FROM user_communities GROUP BY user_id) n
  ON u.id = n.user_id""")
def q_communities_per_user(spark, d):
    t = Tables(spark, d)
    return stats.communities_per_user(t.users, t.posts, t.post_communities)


@query("tag_user_counts", """
SELECT pt.tag, count(DISTINCT p.user_id) AS n_users, (SELECT count(DISTINCT user_id) FROM posts) AS total_users
FROM post_tags pt JOIN posts p ON p.id = pt.post_id WHERE length(CAST(pt.tag AS VARCHAR)) > 1 GROUP BY pt.tag""")
def q_tag_user_counts(spark, d):
    t = Tables(spark, d)
    return stats.tag_user_counts(t.posts, t.post_tags)


# ---- A03 / A04 / A10 ------------------------------------------------------------------------
def _iqr_sql(src: str, gcols: str) -> str:
    """A10 in SQL over ``src`` with columns (gcols..., v): row_number ranks."""
    return f"""
SELECT {gcols}, n, q1, q3, q3 - q1 AS iqr,
  sum(CASE WHEN v < q1 - 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS n_low,
  sum(CASE WHEN v > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS n_high
FROM (SELECT s.*, q.n, q.q1, q.q3 FROM {src} s JOIN (
        SELECT {gcols}, any_value(n) AS n,
          max(CASE WHEN rn = floor(n * 25 / 100) THEN v END) AS q1,
          max(CASE WHEN rn = floor(n * 75 / 100) THEN v END) AS q3
        FROM (SELECT {gcols}, v, row_number() OVER (PARTITION BY {gcols} ORDER BY v) - 1 AS rn,
                     count(*) OVER (PARTITION BY {gcols}) AS n FROM {src}) r GROUP BY {gcols}) q
      USING ({gcols})) z
GROUP BY {gcols}, n, q1, q3"""


@query("iqr_outliers", f"""
WITH src AS (SELECT uc.community, CAST(u.followers AS DOUBLE) AS v FROM user_communities uc
             JOIN users u ON u.id = uc.user_id)
SELECT community, CAST(n AS BIGINT) AS n, q1, q3, iqr, CAST(n_low AS BIGINT) AS n_low,
       CAST(n_high AS BIGINT) AS n_high, iqr <> 0 AS has_fences
FROM ({_iqr_sql('src', 'community')}) x""")
def q_iqr_outliers(spark, d):
    t = Tables(spark, d)
    from communitylens.operators.filters import users_of_community
    uc = users_of_community(t.posts, t.post_tags, t.communities)
    src = uc.join(t.users.select(F.col("id").alias("user_id"), F.col("followers").cast("double").alias("v")), "user_id")
    out = stats.iqr_outliers(src, ["community"], "v")
    return out.select("community", F.col("n").cast("bigint").alias("n"), "q1", "q3", "iqr",
                      F.col("n_low").cast("bigint").alias("n_low"), F.col("n_high").cast("bigint").alias("n_high"),
                      "has_fences")


def _a03_sql() -> str:
    metrics = {"nt": ("nt > 0", "nt"), "rt": ("rt > 0", "rt"), "cgr": ("nt > 0", "followers"),
               "cpr": ("rt > 0", "followers")}
    series = " UNION ALL ".join(
        f"SELECT community, '{m}' AS m, CAST({val} AS DOUBLE) AS v FROM u WHERE {cond}"
        for m, (cond, val) in metrics.items())

    def share(m, side):
        return (f"coalesce((SELECT CASE WHEN o.n >= 10 AND o.iqr <> 0 THEN round(o.n_{side} / o.n, 4) ELSE -1.0 END "
                f"FROM o WHERE o.community = b.community AND o.m = '{m}'), -1.0)")

    return f"""
WITH u AS (SELECT uc.user_id, uc.community,
             coalesce(r.newtweet_count + r.reply_count, 0) AS nt, coalesce(r.retweet_count + r.quote_count, 0) AS rt,
             coalesce(us.followers, 0) AS followers
           FROM user_communities uc LEFT JOIN user_rollup r ON uc.user_id = r.user_id
           LEFT JOIN users us ON us.id = uc.user_id),
series AS ({series}),
o AS ({_iqr_sql('series', 'community, m')}),
b AS (SELECT community, count(*) AS users, count(CASE WHEN nt > 0 THEN 1 END) AS cg,
        count(CASE WHEN rt > 0 THEN 1 END) AS cp,
        sum(CASE WHEN nt > 0 THEN nt END) AS total_nt, sum(CASE WHEN rt > 0 THEN rt END) AS total_rt,
        sum(CASE WHEN nt > 0 THEN followers END) AS cg_follower, sum(CASE WHEN rt > 0 THEN followers END) AS cp_follower,
        stddev_samp(CASE WHEN nt > 0 THEN nt END) AS dev_nt, stddev_samp(CASE WHEN rt > 0 THEN rt END) AS dev_rt,
        stddev_samp(CASE WHEN nt > 0 THEN followers END) AS dev_cgr,
        stddev_samp(CASE WHEN rt > 0 THEN followers END) AS dev_cpr
      FROM u GROUP BY community)
SELECT community AS tag, CAST(users AS BIGINT) AS unique_users,
  {ratio('cg', 'users')} AS pct_content_gen, {ratio('cp', 'users')} AS pct_content_pp,
  {ratio('total_nt', 'cg')} AS avg_nt_per_cg, round(coalesce(dev_nt, 0), 4) AS dev_nt,
  {share('nt', 'low')} AS pct_cg_outliers_low, {share('nt', 'high')} AS pct_cg_outliers_high,
  {ratio('total_rt', 'cp')} AS avg_rt_per_cp, round(coalesce(dev_rt, 0), 4) AS dev_rt,
  {share('rt', 'low')} AS pct_cp_outliers_low, {share('rt', 'high')} AS pct_cp_outliers_high,
  {ratio('cg_follower', 'cg')} AS cg_reach, round(coalesce(dev_cgr, 0), 4) AS dev_cgr,
  {share('cgr', 'low')} AS cgr_outliers_low, {share('cgr', 'high')} AS cgr_outliers_high,
  {ratio('cp_follower', 'cp')} AS cp_reach, round(coalesce(dev_cpr, 0), 4) AS dev_cpr,
  {share('cpr', 'low')} AS cpr_outliers_low, {share('cpr', 'high')} AS cpr_outliers_high
FROM b"""


@query("user_stats", _a03_sql())
def q_user_stats(spark, d):
    t = Tables(spark, d)
    from communitylens.operators.filters import users_of_community
    uc = users_of_community(t.posts, t.post_tags, t.communities)
    return stats.user_stats(t.users, stats.user_rollup(t.posts), uc)


@query("user_type_counts", f"""
SELECT uc.community AS tag,
  {", ".join(f"count(CASE WHEN lower(u.label) = '{x}' THEN 1 END) AS {x}" for x in stats.USER_TYPES)},
  count(CASE WHEN u.label IS NOT NULL AND lower(u.label) NOT IN ({", ".join(repr(x) for x in stats.USER_TYPES)}) THEN 1 END) AS other,
  count(CASE WHEN u.label IS NULL THEN 1 END) AS none
FROM user_communities uc LEFT JOIN users u ON u.id = uc.user_id GROUP BY uc.community""")
def q_user_type_counts(spark, d):
    t = Tables(spark, d)
    from communitylens.operators.filters import users_of_community
    return stats.user_type_counts(t.users, users_of_community(t.posts, t.post_tags, t.communities))


# ---- A09 / A11 / A12 / A13 / A14 / A15 -------------------------------------------------------
@query("distribution_summary", """
WITH v AS (SELECT tag, CAST(count(DISTINCT community) AS DOUBLE) AS v FROM post_tags JOIN post_communities USING (post_id)
           GROUP BY tag)
SELECT max(v) AS max, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.5), 4) AS p50,
       round(quantile_cont(v, 0.25), 4) AS p25, min(v) AS min, round(avg(v), 4) AS mean FROM v""")
def q_distribution_summary(spark, d):
    t = Tables(spark, d)
    v = (t.post_tags.join(t.post_communities, "post_id").groupBy("tag")
         .agg(F.count_distinct("community").alias("v")))
    return stats.distribution_summary(v, "v")


@query("edge_weights", """
SELECT p.user_id AS "from", m.mention AS "to", count(*) AS weight
FROM posts p JOIN post_mentions m ON p.id = m.post_id GROUP BY p.user_id, m.mention""")
def q_edge_weights(spark, d):
    t = Tables(spark, d)
    e = t.posts.select(F.col("id").alias("post_id"), F.col("user_id").alias("from")).join(
        t.post_mentions.withColumnRenamed("mention", "to"), "post_id")
    return stats.edge_weights(e)


WINDOW_START, WINDOW_END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@query("posts_in_window_ratio", f"""
WITH g AS (SELECT user_id, count(*) AS total,
             count(CASE WHEN ts BETWEEN TIMESTAMP '{WINDOW_START}' AND TIMESTAMP '{WINDOW_END}' THEN 1 END) AS in_range_n,
             max(ts) AS newest, min(ts) AS oldest FROM events GROUP BY user_id),
h AS (SELECT user_id, CAST(CASE WHEN oldest > TIMESTAMP '{WINDOW_START}'
        THEN floor(total / (floor((epoch_us(newest) - epoch_us(oldest)) / 86400000000) + 1)) * 30
        ELSE in_range_n END AS BIGINT) AS in_range FROM g),
s AS (SELECT user_id, count(*) AS stored FROM posts GROUP BY user_id),
j AS (SELECT h.user_id, CAST(coalesce(s.stored, 0) AS BIGINT) AS stored, h.in_range FROM h LEFT JOIN s ON h.user_id = s.user_id)
SELECT user_id, stored,
  CASE WHEN in_range = 0 OR in_range < stored THEN stored ELSE in_range END AS in_range,
  round(CAST(stored AS DOUBLE) / nullif(CASE WHEN in_range = 0 OR in_range < stored THEN stored ELSE in_range END, 0), 4) AS ratio
FROM j""")
def q_posts_in_window_ratio(spark, d):
    t = Tables(spark, d)
    stored = t.posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("stored"))
    return stats.posts_in_window_ratio(t.events.select("user_id", "ts"), stored, WINDOW_START, WINDOW_END)


@query("stats_cleaner", f"""
WITH cs AS ({A01_SQL}),
sup AS (SELECT community, count(DISTINCT post_id) AS n_posts, count(DISTINCT user_id) AS n_users
        FROM post_communities JOIN posts ON id = post_id GROUP BY community)
SELECT cs.tag, cs.total_tweets, cs.avg_hashtags, cs.avg_tweet_length,
       coalesce(sup.n_posts >= 50 AND sup.n_users >= 10, FALSE) AS kept
FROM cs LEFT JOIN sup ON cs.tag = sup.community""")
def q_stats_cleaner(spark, d):
    t = Tables(spark, d)
    from communitylens.operators import filters as fl
    cs = content_of(t)
    return stats.stats_cleaner(cs, fl.community_support(t.posts, t.post_communities),
                               ["tag", "total_tweets", "avg_hashtags", "avg_tweet_length"])


@query("tag_inventory_stats", """
WITH d AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_size <= 5 THEN 'own' WHEN p_size <= 10 THEN 'cb'
                  ELSE 'discarded' END AS role FROM part)
SELECT 'discarded' AS metric, p_type AS key, count(*) AS value FROM d WHERE role = 'discarded' GROUP BY p_type
UNION ALL SELECT 'total_discarded', '', count(*) FROM d WHERE role = 'discarded'
UNION ALL SELECT 'total_tags', '', count(DISTINCT p_partkey) FROM d WHERE role <> 'discarded'
UNION ALL SELECT 'total_communities', '', count(DISTINCT p_brand) FROM d WHERE role <> 'discarded'
UNION ALL SELECT 'with_own', '', count(DISTINCT p_brand) FROM d WHERE role = 'own'
UNION ALL SELECT 'with_cb', '', count(DISTINCT p_brand) FROM d WHERE role = 'cb'""")
def q_tag_inventory_stats(spark, d):
    from communitylens.sources.dictionaries import organise_tags
    return stats.tag_inventory_stats(organise_tags(Tables(spark, d).part))


@query("count_matches", """
SELECT count(*) AS n FROM posts WHERE greatest(favorite_count, retweet_count, reply_count, quote_count) >= 1""")
def q_count_matches(spark, d):
    from communitylens.operators.filters import any_interaction
    p = Tables(spark, d).posts
    return stats.count_matches(p.filter(any_interaction(p)))
