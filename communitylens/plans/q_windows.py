"""Queries for windows, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.operators import windows as wn
from communitylens.plans.registry import query
from communitylens.sources.tables import Tables

RECENT_N, SAMPLE_SHARE, WINDOW_DAYS, TOP_WORDS, SHUFFLE_N = 3, 0.1, 10, 20, 100


@query("sort_by_date", "SELECT user_id, min(created_at) AS first_post, max(created_at) AS last_post FROM posts GROUP BY user_id")
def q_w01(spark, d):
    return wn.first_last_post(Tables(spark, d).posts)


@query("inter_post_gaps", """
WITH g AS (SELECT user_id, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id))) / 1000000 AS gap
           FROM posts),
s AS (SELECT user_id, count(gap) AS n_gaps, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap FROM g GROUP BY user_id)
SELECT user_id, n_gaps, round(coalesce(mean_gap, 0), 4) AS mean_gap, round(coalesce(std_gap, 0), 4) AS std_gap FROM s""")
def q_w02(spark, d):
    return wn.inter_post_gaps(Tables(spark, d).posts)


@query("posts_per_day", """
SELECT user_id, count(*) AS n_days, round(avg(n), 4) AS mean_per_day, round(coalesce(stddev_samp(n), 0), 4) AS std_per_day
FROM (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM posts GROUP BY user_id, CAST(created_at AS DATE)) x
GROUP BY user_id""")
def q_w03(spark, d):
    return wn.posts_per_day(Tables(spark, d).posts)


@query("recent_n_per_user", f"""
SELECT user_id, count(*) AS n_recent, string_agg(status_text, ' || ' ORDER BY rn) AS recent_texts FROM (
  SELECT user_id, status_text, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM posts) r
WHERE rn <= {RECENT_N} GROUP BY user_id""")
def q_w04(spark, d):
    return wn.recent_n_per_user(Tables(spark, d).posts, RECENT_N)


@query("tumbling_export", f"""
WITH f AS (SELECT min(created_at) AS first FROM posts),
w AS (SELECT p.id, CAST(floor((epoch_us(p.created_at) - epoch_us(f.first)) / 1000000 / {WINDOW_DAYS * 86400}) AS BIGINT) AS window_id,
             f.first FROM posts p, f),
s AS (SELECT id, window_id, first, row_number() OVER (PARTITION BY window_id ORDER BY md5(CAST(id AS VARCHAR)), id) AS r,
             count(*) OVER (PARTITION BY window_id) AS n FROM w)
SELECT window_id, min(first) + to_seconds(window_id * {WINDOW_DAYS * 86400}) AS window_start,
       min(first) + to_seconds(window_id * {WINDOW_DAYS * 86400}) + INTERVAL {WINDOW_DAYS} DAY AS window_end,
       count(*) AS n_posts, count(CASE WHEN r <= floor(n * {SAMPLE_SHARE}) THEN 1 END) AS n_sampled
FROM s GROUP BY window_id""")
def q_w05(spark, d):
    t = Tables(spark, d)
    win = wn.tumbling_windows(t.posts.select("id", "created_at"), WINDOW_DAYS)
    counts = win.groupBy("window_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n_posts"))
    sampled = (wn.sample_share(win.select("id", "window_id"), "window_id", "id", SAMPLE_SHARE)
               .groupBy("window_id").agg(F.count(F.lit(1)).alias("n_sampled")))
    return (counts.join(sampled, "window_id", "left")
            .select("window_id", "window_start", "window_end", "n_posts",
                    F.coalesce("n_sampled", F.lit(0)).cast("bigint").alias("n_sampled")))


@query("topn_dictionary", f"""
WITH f AS (SELECT class, word, count(*) AS freq FROM (
  SELECT lang AS class, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS word
  FROM documents) t WHERE length(word) >= 2 GROUP BY class, word)
SELECT class, word, freq, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY freq DESC, word ASC) AS rank FROM f) r WHERE rank <= {TOP_WORDS}""")
def q_w06(spark, d):
    from communitylens.functions.text import letters_only_tokens
    docs = Tables(spark, d).documents
    f = (docs.select(F.col("lang").alias("class"), F.explode(letters_only_tokens("text")).alias("word"))
         .filter(F.length("word") >= 2).groupBy("class", "word").agg(F.count(F.lit(1)).alias("freq")))
    return wn.topn_per_group(f, "class", "freq", "word", TOP_WORDS).select("class", "word", "freq", "rank")


@query("sample_share", f"""
SELECT community, post_id FROM (
  SELECT community, post_id, row_number() OVER (PARTITION BY community ORDER BY md5(CAST(post_id AS VARCHAR)), post_id) AS r,
         count(*) OVER (PARTITION BY community) AS n FROM post_communities) s
WHERE r <= floor(n * {SAMPLE_SHARE})""")
def q_w07(spark, d):
    return wn.sample_share(Tables(spark, d).post_communities, "community", "post_id", SAMPLE_SHARE)


@query("sort_by_key", """
SELECT community AS tag, count(*) AS total_tweets FROM post_communities GROUP BY community ORDER BY tag""")
def q_w08(spark, d):
    pc = Tables(spark, d).post_communities
    return pc.groupBy(F.col("community").alias("tag")).agg(F.count(F.lit(1)).alias("total_tweets")).orderBy("tag")


@query("keyword_batches", """
SELECT keyword, CAST(floor((row_number() OVER (ORDER BY keyword) - 1) / 400) AS BIGINT) AS batch
FROM (SELECT DISTINCT '#p' || CAST(tag AS VARCHAR) AS keyword FROM communities) k""")
def q_w09(spark, d):
    c = Tables(spark, d).communities
    kw = c.select(F.concat(F.lit("#p"), F.col("tag").cast("string")).alias("keyword"))
    return wn.keyword_batches(kw, 400)


@query("shuffle_users", f"""
SELECT id AS user_id FROM users ORDER BY md5(CAST(id AS VARCHAR) || '42'), id LIMIT {SHUFFLE_N}""")
def q_w10(spark, d):
    u = Tables(spark, d).users.select(F.col("id").alias("user_id"))
    return wn.shuffle_take(u, "user_id", SHUFFLE_N, "42")
