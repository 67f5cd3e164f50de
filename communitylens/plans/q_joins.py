"""Queries for joins (J01-J14; J10 is registered with the similarity queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.functions.text import letters_only_tokens
from communitylens.operators import joins as jn
from communitylens.operators import stats
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import query
from communitylens.sources.tables import Tables

RECENT_N = 5


@query("tag_to_community", "SELECT pt.post_id, pt.tag, c.community FROM post_tags pt JOIN communities c ON pt.tag = c.tag")
def q_j01(spark, d):
    t = Tables(spark, d)
    return jn.tag_to_community(t.post_tags, t.communities)


@query("user_posts_left", """
SELECT u.id AS user_id, CAST(count(p.id) AS BIGINT) AS n_posts FROM users u LEFT JOIN posts p ON p.user_id = u.id
GROUP BY u.id""")
def q_j02(spark, d):
    t = Tables(spark, d)
    return jn.user_posts_left(t.users, t.posts)


@query("merge_by_id", """
SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d
JOIN (SELECT doc_id, arg_max(quality, (quality, toxic)) AS quality, arg_max(toxic, (quality, toxic)) AS toxic
      FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def q_j03(spark, d):
    t = Tables(spark, d)
    return jn.merge_by_id(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", ["quality", "toxic"])


@query("fill_profile_from_posts", f"""
WITH r AS (SELECT user_id, status_text, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
           FROM posts),
f AS (SELECT user_id, string_agg(status_text, ' ' ORDER BY rn) AS txt FROM r
      WHERE rn <= {RECENT_N} AND length(status_text) >= 3 GROUP BY user_id)
SELECT u.id, CASE WHEN u.user_desc IS NULL OR length(trim(u.user_desc)) < 2 THEN coalesce(trim(f.txt), '')
                  ELSE u.user_desc END AS profile
FROM users u LEFT JOIN f ON u.id = f.user_id""")
def q_j04(spark, d):
    t = Tables(spark, d)
    return jn.fill_profile_from_posts(t.users, t.posts, RECENT_N)


@query("replace_profile_with_posts", """
SELECT u.id, coalesce(a.txt, u.user_desc) AS profile FROM users u
LEFT JOIN (SELECT user_id, string_agg(status_text, ' ' ORDER BY created_at, id) AS txt FROM posts GROUP BY user_id) a
  ON u.id = a.user_id""")
def q_j05(spark, d):
    t = Tables(spark, d)
    return jn.replace_profile_with_posts(t.users, t.posts)


@query("keep_listed_ids", "SELECT id, screen_name FROM users WHERE id IN (SELECT doc_id FROM labels)")
def q_j06(spark, d):
    t = Tables(spark, d)
    return jn.keep_listed_ids(t.users.select("id", "screen_name"),
                              t.labels.select(F.col("doc_id").alias("id")), "id")


# Category flags of a community from its brand number (fixture rule):
# odd -> communicable 'c' else 'uc'; number <= 12 -> chronic 'ch' else 'ac'.
register("category_flags", """
SELECT p_brand AS tag, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 1 THEN 'c' ELSE 'uc' END AS category
FROM (SELECT DISTINCT p_brand FROM part) b
UNION ALL
SELECT p_brand, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) <= 12 THEN 'ch' ELSE 'ac' END FROM (SELECT DISTINCT p_brand FROM part) b""")


def category_flags(part):
    num = F.substr("p_brand", F.lit(7)).cast("int")
    b = part.select("p_brand").distinct()
    c1 = b.select(F.col("p_brand").alias("tag"), F.when(num % 2 == 1, "c").otherwise("uc").alias("category"))
    c2 = b.select(F.col("p_brand").alias("tag"), F.when(num <= 12, "ch").otherwise("ac").alias("category"))
    return c1.unionByName(c2)


@query("split_by_category", """
SELECT s.tag, f.category, s.pct_interacted, s.avg_interact_freq, s.n_all FROM (
  SELECT pc.community AS tag, CAST(count(*) AS BIGINT) AS n_all,
    CASE WHEN count(*) > 0 THEN round(count(CASE WHEN greatest(retweet_count, quote_count, favorite_count, reply_count) > 0 THEN 1 END) / count(*), 4) ELSE 0.0 END AS pct_interacted,
    CASE WHEN count(*) > 0 THEN round(sum(retweet_count + quote_count + favorite_count + reply_count) / count(*), 4) ELSE 0.0 END AS avg_interact_freq
  FROM post_communities pc JOIN posts p ON p.id = pc.post_id GROUP BY pc.community) s
JOIN category_flags f ON s.tag = f.tag""")
def q_j07(spark, d):
    t = Tables(spark, d)
    s = stats.interaction_stats(t.posts, t.post_communities).select("tag", "pct_interacted", "avg_interact_freq", "n_all")
    return jn.split_by_category(s, category_flags(t.part)).select("tag", "category", "pct_interacted",
                                                                  "avg_interact_freq", "n_all")


@query("exclude_listed", """
SELECT post_id, tag FROM post_tags WHERE tag NOT IN (SELECT tag FROM excluded_tags)""")
def q_j08(spark, d):
    from communitylens.operators.cooccur import outlier_exclusion_list
    t = Tables(spark, d)
    return jn.exclude_listed(t.post_tags, outlier_exclusion_list(t.post_tags, t.communities, 100), "tag")


@query("attach_labels", """
SELECT d.doc_id, d.lang, coalesce(CASE l.quality WHEN 1 THEN 'quality' WHEN 0 THEN 'low' END, 'Other') AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_j09(spark, d):
    t = Tables(spark, d)
    lab = t.labels.select("doc_id", F.when(F.col("quality") == 1, "quality").when(F.col("quality") == 0, "low").alias("label"))
    return jn.attach_labels(t.documents.select("doc_id", "lang"), lab, "doc_id")


@query("assemble_features", """
SELECT u.id AS user_id, coalesce(r.newtweet_count, 0) AS newtweet_count, coalesce(r.retweet_count, 0) AS retweet_count,
       coalesce(r.favorited_count, 0) AS favorited_count, CAST(coalesce(c.n_communities, 0) AS BIGINT) AS n_communities,
       coalesce(d.n_chars, 0) AS n_chars
FROM users u LEFT JOIN user_rollup r ON u.id = r.user_id
LEFT JOIN (SELECT user_id, count(*) AS n_communities FROM user_communities GROUP BY user_id) c ON u.id = c.user_id
LEFT JOIN documents d ON u.id = d.doc_id""")
def q_j11(spark, d):
    from communitylens.operators.cooccur import user_communities
    t = Tables(spark, d)
    r = stats.user_rollup(t.posts).select("user_id", "newtweet_count", "retweet_count", "favorited_count")
    c = user_communities(t.posts, t.post_communities).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_communities"))
    docs = t.documents.select(F.col("doc_id").alias("user_id"), "n_chars")
    base = t.users.select(F.col("id").alias("user_id"))
    return jn.assemble_features(base, "user_id", r, c, docs)


register("word_dictionary", """
SELECT DISTINCT w AS word, p_brand AS community FROM (
  SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size <= 5) x WHERE length(w) > 3""")


def word_dictionary(part):
    """T10 on the fixture: words (length > 3) of the names of a community's
    seed tags -> community (one row per word and community)."""
    return (part.filter(F.col("p_size") <= 5)
            .select(F.col("p_brand").alias("community"), F.explode(F.split("p_name", " ")).alias("word"))
            .filter(F.length("word") > 3).select("word", "community").distinct())


@query("dictionary_probe", """
SELECT t.post_id, count(DISTINCT t.word) AS n_words, count(DISTINCT w.community) AS n_communities FROM (
  SELECT DISTINCT id AS post_id, unnest(list_filter(string_split(regexp_replace(lower(status_text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS word
  FROM posts) t JOIN word_dictionary w ON t.word = w.word GROUP BY t.post_id""")
def q_j12(spark, d):
    t = Tables(spark, d)
    toks = t.posts.select(F.col("id").alias("post_id"), F.explode(F.array_distinct(letters_only_tokens("status_text"))).alias("word"))
    hits = jn.word_groups(toks, word_dictionary(t.part), "post_id", "community")
    return hits.select("post_id", "n_words", F.size("values").cast("bigint").alias("n_communities"))


@query("drop_ids_across_tables", """
WITH ok AS (SELECT id FROM users WHERE NOT (user_desc IS NULL OR length(trim(user_desc)) = 0))
SELECT 'posts' AS table_name, r.user_id, r.newtweet_count AS value FROM user_rollup r WHERE r.user_id IN (SELECT id FROM ok)
UNION ALL SELECT 'favourites', r.user_id, r.favorited_count FROM user_rollup r WHERE r.user_id IN (SELECT id FROM ok)
UNION ALL SELECT 'profiles', u.id, CAST(length(u.user_desc) AS BIGINT) FROM users u WHERE u.id IN (SELECT id FROM ok)""")
def q_j13(spark, d):
    t = Tables(spark, d)
    bad = t.users.filter(F.col("user_desc").isNull() | (F.length(F.trim("user_desc")) == 0)).select(F.col("id").alias("user_id"))
    rollup = stats.user_rollup(t.posts)
    tables = {"posts": rollup.select("user_id", F.col("newtweet_count").cast("bigint").alias("value")),
              "favourites": rollup.select("user_id", F.col("favorited_count").cast("bigint").alias("value")),
              "profiles": t.users.select(F.col("id").alias("user_id"), F.length("user_desc").cast("bigint").alias("value"))}
    kept = jn.drop_ids_across_tables(bad, "user_id", *tables.values())
    parts = [k.select(F.lit(n).alias("table_name"), "user_id", "value") for n, k in zip(tables, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("enrich_user_profile", """
SELECT u.id, u.screen_name, e.event_type AS last_event_type, e.value AS last_value FROM users u
LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
           FROM events GROUP BY user_id) e ON u.id = e.user_id""")
def q_j14(spark, d):
    t = Tables(spark, d)
    snaps = t.events.select(F.col("user_id").alias("id"), "ts", "event_id",
                            F.col("event_type").alias("last_event_type"), F.col("value").alias("last_value"))
    out = jn.enrich_user_profile(t.users.select("id", "screen_name"), snaps, "id", ["ts", "event_id"])
    return out.select("id", "screen_name", "last_event_type", "last_value")
