"""Queries for interaction edges and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.operators import edges as eg
from communitylens.operators import stats
from communitylens.operators.windows import sample_share, tumbling_windows
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import query
from communitylens.sources.tables import Tables

SHARE, WINDOW_DAYS, USER_TYPE = 0.1, 10, "hpi"
_HOST = eg._HOST

register("edge_targets", """
SELECT post_id, 'Mentions' AS relationship, CAST(mention AS VARCHAR) AS target FROM post_mentions
UNION ALL SELECT id, 'Replies to', CAST(in_reply_to_user_id AS VARCHAR) FROM posts WHERE in_reply_to_user_id IS NOT NULL
UNION ALL SELECT id, 'Tweet', NULL FROM posts WHERE id NOT IN (SELECT post_id FROM post_mentions)
          AND in_reply_to_user_id IS NULL""")
register("post_attrs", f"""
SELECT p.*, coalesce(e.urls, '') AS urls, coalesce(e.domains, '') AS domains, coalesce(e.hashtags, '') AS hashtags,
       coalesce(e.media, '') AS media
FROM posts p LEFT JOIN (
  SELECT post_id,
    array_to_string(list_sort(list_distinct(list(value) FILTER (WHERE kind = 'url'))), ' ') AS urls,
    array_to_string(list_sort(list_distinct(list(regexp_extract(value, '{_HOST}', 1)) FILTER (WHERE kind = 'url'))), ' ') AS domains,
    array_to_string(list_sort(list_distinct(list(value) FILTER (WHERE kind = 'hashtag'))), ' ') AS hashtags,
    array_to_string(list_sort(list_distinct(list(value) FILTER (WHERE kind = 'media'))), ' ') AS media
  FROM post_entities GROUP BY post_id) e ON p.id = e.post_id""")


def _edges_sql(author: str, id_prefix: str = "ID_", vprefix: str = "") -> str:
    v1 = f"'{vprefix}' || {author}"
    return f"""
SELECT {v1} AS vertex1, CASE WHEN t.target IS NULL THEN {v1} ELSE '{vprefix}' || t.target END AS vertex2,
  '' AS reciprocated, '' AS col3, t.relationship, strftime(a.created_at, '%d-%m-%Y %H:%M:%S') AS relationship_date,
  a.status_text AS tweet, a.urls, a.domains, a.hashtags, a.media, '' AS tweet_image,
  strftime(a.created_at, '%d-%m-%Y %H:%M:%S') AS tweet_date, 'https://twitter.com/statuses/' || CAST(a.id AS VARCHAR) AS tweet_page,
  coalesce(CAST(f.latitude AS VARCHAR), '') AS latitude, coalesce(CAST(f.longitude AS VARCHAR), '') AS longitude,
  '{id_prefix}' || CAST(a.id AS VARCHAR) AS imported_id,
  CASE WHEN a.kind = 'reply' THEN '{id_prefix}' || CAST(a.id - 2 AS VARCHAR) ELSE '' END AS in_reply_to_tweet_id,
  '0' AS favorited, coalesce(CAST(a.favorite_count AS VARCHAR), '') AS favorite_count,
  coalesce('{id_prefix}' || CAST(a.in_reply_to_user_id AS VARCHAR), '') AS in_reply_to_user_id,
  CASE WHEN a.kind = 'quote' THEN '1' ELSE '0' END AS is_quote_status, coalesce(f.language, '') AS language, '' AS possibly_sensitive,
  CASE WHEN a.kind = 'quote' THEN '{id_prefix}' || CAST(a.id + 1 AS VARCHAR) ELSE '' END AS quoted_status_id,
  '0' AS retweeted, coalesce(CAST(a.retweet_count AS VARCHAR), '') AS retweet_count,
  CASE WHEN a.kind = 'retweet' THEN '{id_prefix}' || CAST(a.id - 1 AS VARCHAR) ELSE '' END AS retweet_id,
  '' AS source, '' AS truncated, '{id_prefix}' || CAST(a.id AS VARCHAR) AS unified_id, '' AS imported_tweet_type"""


def _edges(t, author_name, id_prefix="ID_", vertex_prefix="", posts=None):
    return eg.interaction_edges(posts if posts is not None else t.posts, t.post_mentions, t.post_entities,
                                author_name, id_prefix, vertex_prefix)


def _screen_names(t):
    return _with_place(t, t.users.select(F.col("id").alias("user_id"), F.col("screen_name").alias("author")))


def _with_place(t, authors):
    """``authors`` with their language and coordinates."""
    facts = t.profile_facts.select(F.col("id").alias("user_id"), "language", "latitude", "longitude")
    return authors.join(facts, "user_id", "left")


@query("interaction_edges", _edges_sql("u.screen_name") + """
FROM edge_targets t JOIN post_attrs a ON t.post_id = a.id LEFT JOIN users u ON u.id = a.user_id LEFT JOIN profile_facts f ON f.id = a.user_id""")
def q_g01(spark, d):
    t = Tables(spark, d)
    return _edges(t, _screen_names(t))


@query("edges_by_community", "WITH e AS (" + _edges_sql("u.screen_name") + """,
  a.id AS post_id FROM edge_targets t JOIN post_attrs a ON t.post_id = a.id LEFT JOIN users u ON u.id = a.user_id LEFT JOIN profile_facts f ON f.id = a.user_id)
SELECT pc.community, e.* EXCLUDE (post_id) FROM post_communities pc JOIN e ON pc.post_id = e.post_id""")
def q_g02(spark, d):
    t = Tables(spark, d)
    # the posts of a community alone become edges, after their authors are known
    posts = eg.listed_targets(t.posts_and_entities, t.post_community_lists.join(t.post_mention_lists, "post_id", "left"))
    edges = eg.edges_of_lists(posts, _screen_names(t), more=("communities",))
    return edges.select(F.col("communities.community").alias("community"), *eg.EDGE_COLUMNS)


@query("edges_by_days", f"""
WITH f AS (SELECT min(created_at) AS first FROM posts),
w AS (SELECT p.id, CAST(floor((epoch_us(p.created_at) - epoch_us(f.first)) / 1000000 / {WINDOW_DAYS * 86400}) AS BIGINT) AS window_id
      FROM posts p, f),
s AS (SELECT id, window_id FROM (SELECT id, window_id, row_number() OVER (PARTITION BY window_id ORDER BY md5(CAST(id AS VARCHAR)), id) AS r,
             count(*) OVER (PARTITION BY window_id) AS n FROM w) x WHERE r <= floor(n * {SHARE}))
""" + _edges_sql("CAST(a.user_id AS VARCHAR)", "twitterID_", "twitterID_") + """, s.window_id
FROM s JOIN post_attrs a ON a.id = s.id JOIN edge_targets t ON t.post_id = a.id LEFT JOIN profile_facts f ON f.id = a.user_id""")
def q_g03(spark, d):
    t = Tables(spark, d)
    win = tumbling_windows(t.posts.select("id", "created_at"), WINDOW_DAYS).select("id", "window_id")
    picked = sample_share(win, "window_id", "id", SHARE)
    posts = t.posts.join(picked, "id")
    authors = t.posts.select("user_id").distinct().select("user_id", F.col("user_id").cast("string").alias("author"))
    e = _edges(t, _with_place(t, authors), "twitterID_", "twitterID_", posts=posts)
    return (e.join(picked.select(F.concat(F.lit("twitterID_"), F.col("id").cast("string")).alias("imported_id"), "window_id"),
                   "imported_id")
            .select("window_id", *eg.EDGE_COLUMNS))


@query("edges_by_user_type", f"""
WITH u AS (SELECT id FROM users WHERE lower(label) = '{USER_TYPE}'),
s AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS r, count(*) OVER () AS n FROM u) x
      WHERE r <= floor(n * {SHARE}))
""" + _edges_sql("CAST(a.user_id AS VARCHAR)") + """
FROM post_attrs a JOIN s ON a.user_id = s.id JOIN edge_targets t ON t.post_id = a.id LEFT JOIN profile_facts f ON f.id = a.user_id""")
def q_g04(spark, d):
    t = Tables(spark, d)
    from communitylens.operators.filters import users_by_type
    u = users_by_type(t.users, USER_TYPE).select("id", F.lit(USER_TYPE).alias("g"))
    picked = sample_share(u, "g", "id", SHARE).select(F.col("id").alias("user_id"))
    posts = t.posts.join(picked, "user_id", "left_semi")
    authors = picked.select("user_id", F.col("user_id").cast("string").alias("author"))
    return _edges(t, _with_place(t, authors), posts=posts)


@query("basic_user_features", """
WITH s AS (SELECT user_id, count(CASE WHEN kind = 'hashtag' THEN 1 END) AS n_hashtag, count(CASE WHEN kind = 'url' THEN 1 END) AS n_url,
                  count(CASE WHEN kind = 'mention' THEN 1 END) AS n_mention, count(CASE WHEN kind = 'media' THEN 1 END) AS n_media
           FROM (SELECT DISTINCT p.user_id, e.kind, e.value FROM posts p JOIN post_entities e ON p.id = e.post_id) x GROUP BY user_id)
SELECT 'https://twitter.com/' || u.screen_name AS twitter_id,
  CAST(coalesce(r.newtweet_count, 0) + coalesce(r.retweet_count, 0) AS BIGINT) AS user_statuses_count,
  CAST(coalesce(u.friends, 0) AS BIGINT) AS user_friends_count, f.favourites AS user_favorites_count,
  CAST(coalesce(r.retweeted_count, 0) AS BIGINT) AS user_retweeted_count, CAST(coalesce(r.retweet_count, 0) AS BIGINT) AS user_retweet_count,
  CAST(coalesce(u.followers, 0) AS BIGINT) AS user_followers_count, f.listed AS user_listed_count,
  CAST(coalesce(r.newtweet_count, 0) AS BIGINT) AS user_newtweet_count, CAST(coalesce(r.favorited_count, 0) AS BIGINT) AS user_favorited_count,
  CAST(coalesce(s.n_hashtag, 0) AS BIGINT) AS user_entities_hashtag, CAST(coalesce(s.n_url, 0) AS BIGINT) AS user_entities_url,
  CAST(coalesce(s.n_mention, 0) AS BIGINT) AS user_entities_user_mention, CAST(coalesce(s.n_media, 0) AS BIGINT) AS user_entities_media_url,
  u.screen_name AS user_screen_name, f.user_name, coalesce(u.user_desc, '') AS user_desc
FROM users u JOIN profile_facts f ON f.id = u.id LEFT JOIN user_rollup r ON u.id = r.user_id LEFT JOIN s ON u.id = s.user_id WHERE u.screen_name IS NOT NULL""")
def q_g05(spark, d):
    t = Tables(spark, d)
    posts = t.kept_posts
    return eg.basic_user_features(t.full_users, stats.user_rollup(posts), stats.user_entity_sets(posts))


@query("extract_column", "SELECT regexp_replace(string_split(text, ',')[2], '\\s', '', 'g') AS value FROM conversations")
def q_g06(spark, d):
    return eg.extract_column(Tables(spark, d).conversations, "text")
