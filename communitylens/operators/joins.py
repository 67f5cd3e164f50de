"""Joins (J01-J14, J10 lives with the similarity operators).

Physical join choice is left to Catalyst and AQE: a side is broadcast only
when its measured size is below the adaptive threshold; otherwise a
sort-merge join runs, with AQE splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_to_community(post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """Probe each post tag in the tag -> community table."""
    return post_tags.join(communities, "tag").select("post_id", "tag", "community")


def user_posts_left(users: DataFrame, posts: DataFrame) -> DataFrame:
    """Users left-joined to their posts (one join instead of one search
    per user); the post count is 0 for users without posts."""
    n = posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"))
    return (users.select(F.col("id").alias("user_id")).join(n, "user_id", "left")
            .select("user_id", F.coalesce("n_posts", F.lit(0)).cast("bigint").alias("n_posts")))


def dedup_last(df: DataFrame, key: str, order_cols) -> DataFrame:
    """Keep one row per key: the last by ``order_cols`` (last write wins).
    ``max_by`` aggregates partially before the shuffle, so a key repeated
    a billion times costs no more than one repeated twice."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order_cols)).alias("_r"))
    return best.select(key, "_r.*")


def merge_by_id(left: DataFrame, right: DataFrame, key: str, order_cols) -> DataFrame:
    """Inner join after de-duplicating the right side (last wins)."""
    return left.join(dedup_last(right, key, order_cols), key)


def _ordered_concat(df: DataFrame, group_col: str, order_col: str, text_col: str, sep: str = " "):
    return df.groupBy(group_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda s: s[text_col]), sep).alias("_txt"))


def fill_profile_from_posts(users: DataFrame, posts: DataFrame, n: int = 5, min_len: int = 3) -> DataFrame:
    """Users whose profile is missing or shorter than 2 characters get
    the texts (longer than 2 characters) among their n newest posts,
    joined by a blank."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    recent = (posts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
              .filter(F.length("status_text") >= min_len))
    filled = _ordered_concat(recent, "user_id", "rn", "status_text")
    empty = F.col("user_desc").isNull() | (F.length(F.trim(F.col("user_desc"))) < 2)
    j = users.select("id", "user_desc").join(filled, users.id == filled.user_id, "left")
    return j.select("id", F.when(empty, F.coalesce(F.trim("_txt"), F.lit(""))).otherwise(F.col("user_desc")).alias("profile"))


def replace_profile_with_posts(users: DataFrame, posts: DataFrame) -> DataFrame:
    """Profile <- all post texts of the user (oldest first) when the user
    has posts; else the stored profile."""
    ordered = posts.select("user_id", F.struct("created_at", "id").alias("o"), "status_text")
    allp = _ordered_concat(ordered, "user_id", "o", "status_text")
    j = users.select("id", "user_desc").join(allp, users.id == allp.user_id, "left")
    return j.select("id", F.coalesce(F.col("_txt"), F.col("user_desc")).alias("profile"))


def keep_listed_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """J06."""
    return df.join(ids, key, "left_semi")


def split_by_category(stats_df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of communities by category in one pass: flags has (tag,
    category) with up to two categories per community (c/uc and ch/ac)."""
    return stats_df.join(flags, "tag")


def exclude_listed(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """J08."""
    return df.join(excluded.select(key), key, "left_anti")


def attach_labels(features: DataFrame, labels: DataFrame, key: str, default: str = "Other") -> DataFrame:
    """Left join labels; a missing label becomes ``default``."""
    return features.join(labels, key, "left").na.fill({"label": default})


def assemble_features(base: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Left joins of feature tables on the key; missing features 0."""
    out = base
    for t in tables:
        out = out.join(t, key, "left")
    num = [f.name for f in out.schema.fields if f.name != key and f.dataType.typeName() in
           ("integer", "long", "double", "float", "short")]
    return out.na.fill(0, num)


def dictionary_probe(tokens: DataFrame, dictionary: DataFrame, token_col: str = "word") -> DataFrame:
    """Exploded tokens joined to a dictionary on the word."""
    return tokens.join(dictionary, token_col)


def word_groups(tokens: DataFrame, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """J12 by key: (key, n_words, values) for every key of ``tokens`` (key,
    word) with a word of ``dictionary`` (word, ``value``): how many different
    words hit, and the sorted set of their values.  A word meets the list of
    its values as one row, however many values it has; a null value is none,
    but its word counts."""
    lists = dictionary.groupBy("word").agg(F.collect_set(value).alias("values"))
    # a key's words are made distinct before they carry their lists
    words = tokens.select(key, "word").join(F.broadcast(lists.select("word")), "word", "left_semi").select(key, "word").distinct()
    hits = dictionary_probe(words, F.broadcast(lists))
    return hits.groupBy(key).agg(F.count("word").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))


def drop_ids_across_tables(bad_ids: DataFrame, key: str, *tables: DataFrame):
    """Remove the bad ids from every sibling table by key (not by row
    position)."""
    return [t.join(bad_ids.select(key), key, "left_anti") for t in tables]


def enrich_user_profile(users: DataFrame, snapshots: DataFrame, key: str, order_cols) -> DataFrame:
    """Users left-joined to their latest profile snapshot."""
    latest = dedup_last(snapshots, key, order_cols)
    return users.join(latest, key, "left")
