"""Projections, filters and predicates.

All filters are plain Column predicates or semi/anti joins, so Catalyst
pushes the column predicates into the parquet scan and prunes columns.
Membership tests use the exploded (post_id, tag) table, not array
predicates, because array-contains predicates are not pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens.functions.text import collapse_whitespace


def posts_of_community(post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """(post_id, community) for every post having any tag of a community."""
    return post_tags.join(communities, "tag").select("post_id", "community").distinct()


def users_of_community(posts: DataFrame, post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """(user_id, community) for users whose posts carry a community tag."""
    pc = posts_of_community(post_tags, communities)
    return (posts.select(F.col("id").alias("post_id"), "user_id").join(pc, "post_id")
            .select("user_id", "community").distinct())


def any_interaction(df: DataFrame) -> Column:
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in
                        ("favorite_count", "retweet_count", "reply_count", "quote_count")]) >= 1


def interacted_posts_of_community(posts: DataFrame, post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """F01 restricted to posts with any counter >= 1."""
    pc = posts_of_community(post_tags, communities)
    hot = posts.filter(any_interaction(posts)).select(F.col("id").alias("post_id"))
    return pc.join(hot, "post_id", "left_semi")


def posts_of_user(posts: DataFrame, users: DataFrame, screen_name: str) -> DataFrame:
    """posts of the author with this screen name."""
    u = users.filter(F.col("screen_name") == screen_name).select(F.col("id").alias("user_id"))
    return posts.join(u, "user_id", "left_semi")


def users_by_type(users: DataFrame, label: str) -> DataFrame:
    """users whose label equals ``label`` (case-insensitive)."""
    return users.filter(F.lower(F.col("label")) == label.lower())


def posts_in_date_range(posts: DataFrame, start: str, end: str) -> DataFrame:
    """created_at in [start, end], both ends inclusive."""
    return posts.filter(F.col("created_at").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def posts_in_range_about_account(posts: DataFrame, post_mentions: DataFrame, start: str, end: str,
                                 account: int) -> DataFrame:
    """F06 and (author = account or the post mentions the account)."""
    ment = post_mentions.filter(F.col("mention") == account).select(F.col("post_id").alias("id"))
    rng = posts_in_date_range(posts, start, end)
    by_author = rng.filter(F.col("user_id") == account)
    by_mention = rng.join(ment, "id", "left_semi")
    return by_author.unionByName(by_mention).distinct()


def lang_filter(df: DataFrame, langs=("en",)) -> DataFrame:
    """keep rows in the given languages."""
    return df.filter(F.col("lang").isin(*langs))


def keyword_track_filter(df: DataFrame, id_col: str, text_col: str, keywords: DataFrame) -> DataFrame:
    """keep rows whose lower-cased whitespace tokens meet any tracked
    keyword (``keywords`` has one column ``keyword``): explode + semi join."""
    toks = (df.select(F.col(id_col).alias("_id"), F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("keyword"))
            .join(keywords.select(F.lower("keyword").alias("keyword")).distinct(), "keyword", "left_semi")
            .select(F.col("_id").alias(id_col)).distinct())
    return df.join(toks, id_col, "left_semi")


def min_tag_length(post_tags: DataFrame, min_len: int = 2) -> DataFrame:
    """drop tags shorter than ``min_len`` characters."""
    return post_tags.filter(F.length(F.col("tag").cast("string")) >= min_len)


def min_activity_users(posts: DataFrame, post_communities: DataFrame, min_communities: int = 2,
                       min_posts: int = 2) -> DataFrame:
    """users in >= 2 distinct communities with new + retweet posts >= 2."""
    pc = posts.select(F.col("id").alias("post_id"), "user_id").join(post_communities, "post_id")
    n_comm = pc.groupBy("user_id").agg(F.count_distinct("community").alias("n_communities"))
    n_posts = posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"))
    return (n_comm.join(n_posts, "user_id")
            .filter((F.col("n_communities") >= min_communities) & (F.col("n_posts") >= min_posts)))


def community_support(posts: DataFrame, post_communities: DataFrame) -> DataFrame:
    """(community, n_posts, n_users) used by F12."""
    pc = post_communities.join(posts.select(F.col("id").alias("post_id"), "user_id"), "post_id")
    return pc.groupBy("community").agg(F.count_distinct("post_id").alias("n_posts"),
                                       F.count_distinct("user_id").alias("n_users"))


def min_support_communities(support: DataFrame, min_posts: int = 50, min_users: int = 10) -> DataFrame:
    """communities with at least ``min_posts`` posts and ``min_users`` users."""
    return support.filter((F.col("n_posts") >= min_posts) & (F.col("n_users") >= min_users))


def drop_columns(df: DataFrame, names) -> DataFrame:
    """F13."""
    return df.drop(*names)


def min_tokens(df: DataFrame, text_col: str, n: int = 5) -> DataFrame:
    """keep texts with >= n whitespace tokens after trimming and
    appending '.'."""
    t = F.concat(F.trim(F.col(text_col)), F.lit("."))
    return df.withColumn(text_col, t).filter(F.size(F.split(t, r"\s+")) >= n)


def drop_empty_profiles(df: DataFrame, col: str) -> DataFrame:
    """drop null / blank profiles; clean the kept ones of commas and
    quotes and collapse their whitespace."""
    cleaned = collapse_whitespace(F.regexp_replace(F.col(col), "[,\"]", " "))
    return df.filter(F.length(F.trim(F.col(col))) > 0).withColumn(col, cleaned)


def drop_short_rows(lines: DataFrame, line_col: str, min_fields: int = 18, sep: str = ",") -> DataFrame:
    """F16: split CSV lines; rows with fewer than ``min_fields`` fields are
    rejected (flag ``accepted`` = false) so they can be counted apart."""
    n = F.size(F.split(F.col(line_col), sep))
    return lines.withColumn("n_fields", n).withColumn("accepted", n >= min_fields)


def strip_trailing_quote(df: DataFrame) -> DataFrame:
    """strip one trailing '"' from every string column."""
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            out = out.withColumn(f.name, F.regexp_replace(F.col(f.name), "\"$", ""))
    return out


def fill_missing(df: DataFrame, numeric_default=0, text_default=" ") -> DataFrame:
    """NaN / null numbers -> 0, null text -> ' '."""
    out = df
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out = out.withColumn(f.name, F.coalesce(F.nanvl(F.col(f.name), F.lit(None).cast(t)), F.lit(numeric_default).cast(t)))
        elif t in ("int", "bigint", "smallint", "tinyint"):
            out = out.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(numeric_default).cast(t)))
        elif t == "string":
            out = out.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(text_default)))
    return out


def drop_repeated_headers(lines: DataFrame, line_col: str, order_cols, marker: str = "INDEX") -> DataFrame:
    """drop header lines (starting with ``marker``) except the first.
    The first header key is a scalar subquery (one value, no join)."""
    is_head = F.col(line_col).startswith(marker)
    key = F.struct(*order_cols)
    first = lines.filter(is_head).select(F.min(key)).scalar()
    return lines.filter(~is_head | F.coalesce(key == first, F.lit(False)))
