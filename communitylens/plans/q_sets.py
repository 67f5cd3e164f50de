"""Queries for set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.operators import sets as st
from communitylens.operators.cooccur import community_tag_sets, outlier_exclusion_list
from communitylens.plans.registry import query
from communitylens.sources.tables import Tables

A, B = "Brand#1", "Brand#2"
_TAGS = "SELECT DISTINCT lt.tag FROM post_communities pc JOIN long_tags lt ON pc.post_id = lt.post_id WHERE pc.community = '{}'"


def _tags_of(t, community):
    return (community_tag_sets(t.post_tags, t.post_communities)
            .filter(F.col("community") == community).select("tag"))


@query("union_rows", "SELECT id, label FROM users WHERE label = 'hpi' UNION ALL SELECT id, label FROM users WHERE label = 'hpo'")
def q_e01(spark, d):
    u = Tables(spark, d).users
    return st.union_rows(u.filter(F.col("label") == "hpi").select("id", "label"),
                         u.filter(F.col("label") == "hpo").select("id", "label"))


@query("set_intersect", f"{_TAGS.format(A)} INTERSECT {_TAGS.format(B)}")
def q_e02(spark, d):
    t = Tables(spark, d)
    return st.set_intersect(_tags_of(t, A), _tags_of(t, B))


@query("set_union", f"{_TAGS.format(A)} UNION {_TAGS.format(B)}")
def q_e03(spark, d):
    t = Tables(spark, d)
    return st.set_union(_tags_of(t, A), _tags_of(t, B))


@query("set_except", """
SELECT pt.tag FROM post_communities pc JOIN post_tags pt ON pc.post_id = pt.post_id WHERE pc.community = '{a}'
EXCEPT SELECT tag FROM excluded_tags""".format(a=A))
def q_e04(spark, d):
    t = Tables(spark, d)
    # one row per post and tag: a tag repeats as often as posts of the community carry it
    used = t.post_communities.filter(F.col("community") == A).join(t.post_tags, "post_id").select("tag")
    return st.set_except(used, outlier_exclusion_list(t.post_tags, t.communities, 100).select("tag"))


@query("retain_only", f"SELECT tag FROM ({_TAGS.format(A)}) x WHERE tag IN (SELECT tag FROM communities)")
def q_e05(spark, d):
    t = Tables(spark, d)
    return st.retain_only(_tags_of(t, A), t.communities, "tag")


@query("dedup_texts", "SELECT DISTINCT status_text FROM posts")
def q_e06(spark, d):
    return st.dedup_texts(Tables(spark, d).posts, "status_text")


@query("dedup_sorted_tags", """
SELECT DISTINCT line FROM (SELECT '#p' || CAST(tag AS VARCHAR) AS line FROM post_tags
                           UNION ALL SELECT p_name FROM part) x WHERE starts_with(line, '#') ORDER BY line""")
def q_e07(spark, d):
    t = Tables(spark, d)
    lines = (t.post_tags.select(F.concat(F.lit("#p"), F.col("tag").cast("string")).alias("line"))
             .unionByName(t.part.select(F.col("p_name").alias("line"))))
    return st.dedup_sorted_tags(lines, "line")
