"""Queries for filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.operators import filters as fl
from communitylens.plans.registry import query
from communitylens.sources.tables import Tables

# Fixed parameters of the registered filter queries.
SCREEN_NAME = "Customer#000000007"
USER_TYPE = "hpi"
RANGE_START, RANGE_END = "1996-01-01 00:00:00", "1996-12-31 00:00:00"
ACCOUNT = 7
TRACKED_KEYWORDS = ("anvil", "gizmo")


@query("posts_of_community", "SELECT DISTINCT post_id, community FROM post_tags JOIN communities USING (tag)")
def q_f01(spark, d):
    t = Tables(spark, d)
    return fl.posts_of_community(t.post_tags, t.communities)


@query("users_of_community", """
SELECT DISTINCT p.user_id, c.community FROM posts p JOIN post_tags pt ON p.id = pt.post_id
JOIN communities c ON pt.tag = c.tag""")
def q_f02(spark, d):
    t = Tables(spark, d)
    return fl.users_of_community(t.posts, t.post_tags, t.communities)


@query("interacted_posts_of_community", """
SELECT DISTINCT pt.post_id, c.community FROM post_tags pt JOIN communities c ON pt.tag = c.tag
WHERE pt.post_id IN (SELECT id FROM posts WHERE greatest(favorite_count, retweet_count, reply_count, quote_count) >= 1)""")
def q_f03(spark, d):
    t = Tables(spark, d)
    return fl.interacted_posts_of_community(t.posts, t.post_tags, t.communities)


@query("posts_of_user", f"""
SELECT id, user_id, created_at, kind, status_text FROM posts
WHERE user_id IN (SELECT id FROM users WHERE screen_name = '{SCREEN_NAME}')""")
def q_f04(spark, d):
    t = Tables(spark, d)
    return fl.posts_of_user(t.posts, t.users, SCREEN_NAME).select("id", "user_id", "created_at", "kind", "status_text")


@query("users_by_type", f"SELECT id, screen_name, label FROM users WHERE lower(label) = '{USER_TYPE}'")
def q_f05(spark, d):
    t = Tables(spark, d)
    return fl.users_by_type(t.users, USER_TYPE).select("id", "screen_name", "label")


@query("posts_in_date_range", f"""
SELECT id, created_at FROM posts WHERE created_at BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'""")
def q_f06(spark, d):
    t = Tables(spark, d)
    return fl.posts_in_date_range(t.posts, RANGE_START, RANGE_END).select("id", "created_at")


@query("posts_in_range_about_account", f"""
SELECT id, user_id, created_at FROM posts
WHERE created_at BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'
  AND (user_id = {ACCOUNT} OR id IN (SELECT post_id FROM post_mentions WHERE mention = {ACCOUNT}))""")
def q_f07(spark, d):
    t = Tables(spark, d)
    return (fl.posts_in_range_about_account(t.posts, t.post_mentions, RANGE_START, RANGE_END, ACCOUNT)
            .select("id", "user_id", "created_at"))


@query("lang_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en')")
def q_f08(spark, d):
    return fl.lang_filter(Tables(spark, d).documents).select("doc_id", "lang", "n_chars")


@query("keyword_track_filter", f"""
SELECT id, status_text FROM posts WHERE id IN (
  SELECT id FROM (SELECT id, unnest(string_split_regex(lower(status_text), '\\s+')) AS w FROM posts) x
  WHERE w IN ({", ".join(repr(k) for k in TRACKED_KEYWORDS)}))""")
def q_f09(spark, d):
    t = Tables(spark, d)
    kw = spark.createDataFrame([(k,) for k in TRACKED_KEYWORDS], "keyword string")
    return fl.keyword_track_filter(t.posts.select("id", "status_text"), "id", "status_text", kw)


@query("min_tag_length", "SELECT post_id, tag FROM post_tags WHERE length(CAST(tag AS VARCHAR)) >= 2")
def q_f10(spark, d):
    return fl.min_tag_length(Tables(spark, d).post_tags)


@query("min_activity_users", """
WITH nc AS (SELECT p.user_id, count(DISTINCT pc.community) AS n_communities
            FROM posts p JOIN post_communities pc ON p.id = pc.post_id GROUP BY p.user_id),
     np AS (SELECT user_id, count(*) AS n_posts FROM posts GROUP BY user_id)
SELECT nc.user_id, n_communities, n_posts FROM nc JOIN np ON nc.user_id = np.user_id
WHERE n_communities >= 2 AND n_posts >= 2""")
def q_f11(spark, d):
    t = Tables(spark, d)
    return fl.min_activity_users(t.posts, t.post_communities)


@query("min_support_communities", """
SELECT pc.community, count(DISTINCT pc.post_id) AS n_posts, count(DISTINCT p.user_id) AS n_users
FROM post_communities pc JOIN posts p ON p.id = pc.post_id GROUP BY pc.community
HAVING count(DISTINCT pc.post_id) >= 50 AND count(DISTINCT p.user_id) >= 10""")
def q_f12(spark, d):
    t = Tables(spark, d)
    return fl.min_support_communities(fl.community_support(t.posts, t.post_communities))


DROPPED = ("avg_unique_media", "avg_media", "avg_unique_symbol", "avg_symbol")


def _register_drop_columns():
    from communitylens.plans.registry import ORACLE, QUERIES
    from communitylens.plans.q_stats import A01_SQL, content_of
    keep = ["tag", "total_tweets", "avg_unique_hashtag", "avg_unique_mention", "avg_unique_urls",
            "avg_unique_anyentity", "avg_hashtags", "avg_mention", "avg_urls", "avg_anyentity",
            "avg_tweet_uniquewords", "avg_tweet_length", "avg_tweet_density"]

    def q_f13(spark, d):
        return fl.drop_columns(content_of(Tables(spark, d)), DROPPED)

    QUERIES["drop_columns"] = q_f13
    ORACLE["drop_columns"] = (f"SELECT {', '.join(keep)} FROM ({A01_SQL}) s")


_register_drop_columns()


@query("min_tokens", """
SELECT doc_id, trim(text) || '.' AS text FROM documents
WHERE len(string_split_regex(trim(text) || '.', '\\s+')) >= 5""")
def q_f14(spark, d):
    return fl.min_tokens(Tables(spark, d).documents.select("doc_id", "text"), "text")


@query("drop_empty_profiles", """
SELECT id, trim(regexp_replace(regexp_replace(user_desc, '[,"]', ' ', 'g'), '\\s+', ' ', 'g')) AS user_desc
FROM users WHERE length(trim(user_desc)) > 0""")
def q_f15(spark, d):
    return fl.drop_empty_profiles(Tables(spark, d).users.select("id", "user_desc"), "user_desc")


@query("drop_short_rows", """
SELECT page_id, len(string_split(html, ',')) AS n_fields, len(string_split(html, ',')) >= 18 AS accepted FROM pages""")
def q_f16(spark, d):
    return fl.drop_short_rows(Tables(spark, d).pages.select("page_id", "html"), "html").drop("html")


@query("strip_trailing_quote", """
SELECT doc_id, regexp_replace(text, '"$', '') AS text, regexp_replace(lang, '"$', '') AS lang,
       regexp_replace(source, '"$', '') AS source FROM documents""")
def q_f17(spark, d):
    return fl.strip_trailing_quote(Tables(spark, d).documents.select("doc_id", "text", "lang", "source"))


@query("fill_missing", """
SELECT id, screen_name, coalesce(label, ' ') AS label, coalesce(user_desc, ' ') AS user_desc,
       coalesce(followers, 0) AS followers FROM users""")
def q_f18(spark, d):
    return fl.fill_missing(Tables(spark, d).users.select("id", "screen_name", "label", "user_desc", "followers"))


@query("drop_repeated_headers", """
WITH lines AS (SELECT doc_id, ln, line FROM (
        SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln,
               unnest(string_split(text, chr(10))) AS line FROM documents) x),
     first AS (SELECT min((doc_id, ln)) AS k FROM lines WHERE starts_with(line, 'INDEX'))
SELECT doc_id, ln, line FROM lines
WHERE NOT starts_with(line, 'INDEX') OR (doc_id, ln) = (SELECT k FROM first)""")
def q_f19(spark, d):
    docs = Tables(spark, d).documents
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    lines = lines.withColumn("ln", F.col("ln") + 1)
    return fl.drop_repeated_headers(lines, "line", ["doc_id", "ln"])


@query("strip_retweet_prefix", "SELECT id, regexp_replace(lower(status_text), '^rt ', '') AS text FROM posts")
def q_f20(spark, d):
    from communitylens.functions.text import strip_retweet_prefix
    return Tables(spark, d).posts.select("id", strip_retweet_prefix("status_text").alias("text"))
