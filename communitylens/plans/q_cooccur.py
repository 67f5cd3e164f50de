"""Queries for co-occurrence, presence and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.operators import cooccur as co
from communitylens.operators import filters as fl
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import query
from communitylens.sources.tables import Tables

TOP_TAGS, TOP_PRESENCE, MAX_EXCLUDED = 100, 500, 100

register("long_tags", "SELECT post_id, tag FROM post_tags WHERE length(CAST(tag AS VARCHAR)) >= 2")
register("tag_comm", """
WITH nt AS (SELECT post_id FROM post_tags GROUP BY post_id HAVING count(*) >= 2),
lt AS (SELECT * FROM long_tags WHERE post_id IN (SELECT post_id FROM nt)),
pcomm AS (SELECT DISTINCT lt.post_id, c.community FROM lt JOIN communities c ON lt.tag = c.tag),
good AS (SELECT post_id FROM pcomm GROUP BY post_id HAVING count(*) >= 2)
SELECT DISTINCT lt.tag, pcomm.community FROM lt JOIN pcomm ON lt.post_id = pcomm.post_id
WHERE lt.post_id IN (SELECT post_id FROM good)""")
register("tag_ncomm", "SELECT tag, count(*) AS n_communities FROM tag_comm GROUP BY tag HAVING count(*) > 1")


def _iqr_hi(src: str, v: str) -> str:
    """Upper fence Q3 + 1.5 IQR of column v over src (NULL when IQR = 0)."""
    return f"""(SELECT CASE WHEN q3 - q1 <> 0 THEN q3 + 1.5 * (q3 - q1) END FROM (
  SELECT max(CASE WHEN rn = floor(n * 25 / 100) THEN x END) AS q1, max(CASE WHEN rn = floor(n * 75 / 100) THEN x END) AS q3
  FROM (SELECT CAST({v} AS DOUBLE) AS x, row_number() OVER (ORDER BY {v}) - 1 AS rn, count(*) OVER () AS n FROM {src}) r) f)"""


def _summary(v: str) -> str:
    return (f"max({v}) AS max, round(quantile_cont({v}, 0.75), 4) AS p75, round(quantile_cont({v}, 0.5), 4) AS p50, "
            f"round(quantile_cont({v}, 0.25), 4) AS p25, min({v}) AS min, round(avg({v}), 4) AS mean")


@query("cooccurring_tags_topn", f"""
WITH total AS (SELECT community, count(*) AS total_posts FROM post_communities GROUP BY community),
freq AS (SELECT pc.community, lt.tag, count(*) AS freq FROM post_communities pc JOIN long_tags lt ON pc.post_id = lt.post_id
         WHERE (pc.community, lt.tag) NOT IN (SELECT community, tag FROM communities)
         GROUP BY pc.community, lt.tag),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY freq DESC, tag ASC) AS rank FROM freq)
SELECT r.community, r.rank, r.tag, r.freq, r.freq / t.total_posts AS share FROM r JOIN total t USING (community)
WHERE r.rank <= {TOP_TAGS}""")
def q_c01(spark, d):
    t = Tables(spark, d)
    return co.cooccurring_tags_topn(t.post_tags, t.post_communities, t.communities, TOP_TAGS)


@query("tag_communities", "SELECT tag, community FROM tag_comm")
def q_c02(spark, d):
    t = Tables(spark, d)
    return co.tag_communities(t.post_tags, t.communities)


def _report_sql(src: str, key: str, totals: dict) -> str:
    """The three sections of a presence report over (key, n_communities)."""
    v = "CAST(n_communities AS DOUBLE)"
    parts = dict(totals) | {
        "max": f"max({v})", "p75": f"round(quantile_cont({v}, 0.75), 4)", "p50": f"round(quantile_cont({v}, 0.5), 4)",
        "p25": f"round(quantile_cont({v}, 0.25), 4)", "min": f"min({v})", "mean": f"round(avg({v}), 4)",
        "n_upper_outliers": f"count(CASE WHEN n_communities > {_iqr_hi(src, 'n_communities')} THEN 1 END)"}
    summary = " UNION ALL ".join(f"SELECT 'summary' AS section, NULL::INTEGER AS rank, '{k}' AS item, CAST({e} AS DOUBLE) AS value "
                                 f"FROM {src}" for k, e in parts.items())
    return f"""{summary}
UNION ALL SELECT 'top', rank::INTEGER, item, value FROM (SELECT row_number() OVER (ORDER BY n_communities DESC, {key}) AS rank,
  CAST({key} AS VARCHAR) AS item, {v} AS value FROM {src}) r WHERE rank <= {TOP_PRESENCE}
UNION ALL SELECT 'outlier', NULL, CAST({key} AS VARCHAR), {v} FROM {src} WHERE n_communities > {_iqr_hi(src, 'n_communities')}"""


@query("hashtag_community_presence", _report_sql("tag_ncomm", "tag", {
    "n_tags_c02": "max((SELECT count(DISTINCT tag) FROM tag_comm))",
    "n_tags_all": "max((SELECT count(DISTINCT tag) FROM long_tags))",
    "n_multi": "count(*)", "share_multi": "count(*) / (SELECT count(DISTINCT tag) FROM tag_comm)",
    "share_multi_all": "count(*) / (SELECT count(DISTINCT tag) FROM long_tags)"}))
def q_c03(spark, d):
    t = Tables(spark, d)
    return co.hashtag_community_presence(t.post_tags, t.communities, TOP_PRESENCE)


@query("user_communities", """
SELECT a.user_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_communities FROM (SELECT DISTINCT user_id FROM posts) a
LEFT JOIN (SELECT user_id, count(*) AS n FROM user_communities GROUP BY user_id) n ON a.user_id = n.user_id""")
def q_c04(spark, d):
    t = Tables(spark, d)
    return co.user_community_counts(t.posts, t.post_communities)


register("user_ncomm", """
SELECT a.user_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_communities FROM (SELECT DISTINCT user_id FROM posts) a
LEFT JOIN (SELECT user_id, count(*) AS n FROM user_communities GROUP BY user_id) n ON a.user_id = n.user_id""")


register("user_multi", "SELECT user_id, n_communities FROM user_ncomm WHERE n_communities > 1")


@query("user_community_presence", _report_sql("user_multi", "user_id", {
    "n_users": "max((SELECT count(*) FROM user_ncomm))", "n_multi": "count(*)",
    "share_multi": "count(*) / (SELECT count(*) FROM user_ncomm)"}))
def q_c05(spark, d):
    t = Tables(spark, d)
    return co.user_community_presence(t.posts, t.post_communities, TOP_PRESENCE)


@query("tag_user_awareness", f"""
WITH tu AS (SELECT pt.tag, count(DISTINCT p.user_id) AS n_users, (SELECT count(DISTINCT user_id) FROM posts) AS total_users
            FROM post_tags pt JOIN posts p ON p.id = pt.post_id WHERE length(CAST(pt.tag AS VARCHAR)) > 1 GROUP BY pt.tag),
r AS (SELECT *, row_number() OVER (ORDER BY n_users DESC, tag ASC) AS rank FROM tu)
SELECT rank, tag, n_users, n_users / total_users AS pct_users,
       (SELECT count(*) FROM tu WHERE n_users > 1) / (SELECT count(*) FROM tu) AS share_multi_user
FROM r WHERE rank <= {TOP_PRESENCE}""")
def q_c06(spark, d):
    from communitylens.operators.stats import tag_user_counts
    t = Tables(spark, d)
    return co.tag_user_awareness(tag_user_counts(t.posts, t.post_tags), TOP_PRESENCE)


register("tag_awareness", """
SELECT pt.tag, count(DISTINCT p.user_id) AS n_communities
FROM post_tags pt JOIN posts p ON p.id = pt.post_id WHERE length(CAST(pt.tag AS VARCHAR)) > 1 GROUP BY pt.tag""")


@query("tag_user_awareness_report", _report_sql("tag_awareness", "tag", {
    "n_tags": "count(*)", "n_users": "max((SELECT count(DISTINCT user_id) FROM posts))",
    "share_multi": "count(CASE WHEN n_communities > 1 THEN 1 END) / count(*)"}))
def q_c06_report(spark, d):
    """C06 in full: totals, the summary of users per tag, the tags that most
    users know and the upper outliers, as the reports of C03 and C05."""
    from communitylens.operators.stats import tag_user_counts
    t = Tables(spark, d)
    return co.tag_user_awareness_report(tag_user_counts(t.posts, t.post_tags), TOP_PRESENCE)


@query("community_tag_matrix", """
SELECT tc.community, tc.tag, f.freq FROM tag_comm tc
JOIN (SELECT tag, count(*) AS freq FROM post_tags WHERE tag IN (SELECT tag FROM tag_ncomm) GROUP BY tag) f ON tc.tag = f.tag""")
def q_c07(spark, d):
    t = Tables(spark, d)
    return co.community_tag_matrix(t.post_tags, co.tag_communities(t.post_tags, t.communities))


@query("community_user_matrix", """
WITH sel AS (SELECT nc.user_id FROM (SELECT p.user_id, count(DISTINCT pc.community) AS n_c FROM posts p
               JOIN post_communities pc ON p.id = pc.post_id GROUP BY p.user_id) nc
             JOIN (SELECT user_id, count(*) AS n_p FROM posts GROUP BY user_id) np ON nc.user_id = np.user_id
             WHERE n_c >= 2 AND n_p >= 2)
SELECT c.community, p.user_id, count(*) AS n FROM posts p JOIN post_tags pt ON p.id = pt.post_id
JOIN communities c ON pt.tag = c.tag WHERE p.user_id IN (SELECT user_id FROM sel) GROUP BY c.community, p.user_id""")
def q_c08(spark, d):
    t = Tables(spark, d)
    sel = fl.min_activity_users(t.posts, t.post_communities)
    return co.community_user_matrix(t.posts, t.post_tags, t.communities, sel)


def _jaccard_sql(members: str) -> str:
    return f"""
WITH m AS (SELECT DISTINCT g, e FROM ({members}) x),
sz AS (SELECT g, count(*) AS n FROM m GROUP BY g),
ov AS (SELECT a.g AS g1, b.g AS g2, count(*) AS inter FROM m a JOIN m b ON a.e = b.e AND a.g < b.g GROUP BY a.g, b.g)
SELECT ov.g1 AS community1, ov.g2 AS community2, CAST(inter AS BIGINT) AS inter,
       CAST(s1.n + s2.n - inter AS BIGINT) AS "union", inter / (s1.n + s2.n - inter) AS similarity
FROM ov JOIN sz s1 ON ov.g1 = s1.g JOIN sz s2 ON ov.g2 = s2.g"""


register("excluded_tags", f"""
SELECT tag, n_communities FROM tag_ncomm WHERE n_communities > {_iqr_hi('tag_ncomm', 'n_communities')}
ORDER BY n_communities DESC, tag ASC LIMIT {MAX_EXCLUDED}""")

_C09_MEMBERS = ("SELECT pc.community AS g, lt.tag AS e FROM post_communities pc JOIN long_tags lt ON pc.post_id = lt.post_id "
                "WHERE lt.tag NOT IN (SELECT tag FROM excluded_tags)")


@query("community_similarity_by_tag", _jaccard_sql(_C09_MEMBERS))
def q_c09(spark, d):
    t = Tables(spark, d)
    excl = co.outlier_exclusion_list(t.post_tags, t.communities, MAX_EXCLUDED)
    return co.jaccard_pairs(co.community_tag_sets(t.post_tags, t.post_communities, excl), "community", "tag")


@query("community_similarity_by_selected_tag", f"""
WITH s AS ({_jaccard_sql(_C09_MEMBERS + " AND lt.tag IN (SELECT tag FROM communities)")})
SELECT community1, community2, inter, "union", similarity / (SELECT max(similarity) FROM s) AS similarity FROM s""")
def q_c10(spark, d):
    t = Tables(spark, d)
    excl = co.outlier_exclusion_list(t.post_tags, t.communities, MAX_EXCLUDED)
    members = co.community_tag_sets(t.post_tags, t.post_communities, excl, restrict_to=t.communities)
    return co.normalise_by_max(co.jaccard_pairs(members, "community", "tag"))


@query("community_similarity_by_user", _jaccard_sql("SELECT community AS g, user_id AS e FROM user_communities"))
def q_c11(spark, d):
    t = Tables(spark, d)
    return co.jaccard_pairs(co.user_communities(t.posts, t.post_communities), "community", "user_id")


@query("similar_pairs", f"""
SELECT community1, community2, similarity AS score FROM ({_jaccard_sql(_C09_MEMBERS)}) s WHERE similarity > 0""")
def q_c12(spark, d):
    t = Tables(spark, d)
    excl = co.outlier_exclusion_list(t.post_tags, t.communities, MAX_EXCLUDED)
    return co.similar_pairs(co.jaccard_pairs(co.community_tag_sets(t.post_tags, t.post_communities, excl),
                                             "community", "tag"))


@query("outlier_exclusion_list", """
SELECT row_number() OVER (ORDER BY n_communities DESC, tag ASC) AS rank, tag, n_communities FROM excluded_tags""")
def q_c13(spark, d):
    t = Tables(spark, d)
    return co.outlier_exclusion_list(t.post_tags, t.communities, MAX_EXCLUDED).select("rank", "tag", "n_communities")


@query("community_pairs", """
WITH m AS (SELECT DISTINCT community AS g, tag AS e FROM tag_comm)
SELECT a.g AS g1, b.g AS g2, count(*) AS inter FROM m a JOIN m b ON a.e = b.e AND a.g < b.g GROUP BY a.g, b.g""")
def q_j10(spark, d):
    t = Tables(spark, d)
    tc = co.tag_communities(t.post_tags, t.communities)
    return co.pair_overlaps(tc, "community", "tag").withColumn("inter", F.col("inter").cast("bigint"))
