"""Co-occurrence, presence and similarity between communities.

Set similarity is computed from long (group, element) tables.  Pairs of
groups sharing elements are counted by first collapsing elements that
belong to the same *set of groups* (their signature): one row per distinct
signature with its element count, then the group pairs of each signature
are emitted once and weighted.  The pair step therefore scales with the
number of distinct signatures, not with the number of elements, and a
signature holds at most the (dictionary-bounded) number of communities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communitylens.operators.stats import distribution_summary, iqr_outliers


def _scalar(one_value: DataFrame):
    """A one-row, one-column aggregate as a literal column (one number
    reaches the driver; the outer plan needs no join)."""
    v = one_value.first()[0]
    return F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v)


def _long_tags(post_tags: DataFrame, min_len: int = 2) -> DataFrame:
    return post_tags.filter(F.length(F.col("tag").cast("string")) >= min_len)


def cooccurring_tags_topn(post_tags: DataFrame, post_communities: DataFrame, communities: DataFrame,
                          n: int = 100) -> DataFrame:
    """Per community the n most frequent other tags of its posts
    (own dictionary tags removed); rank by freq desc, tag asc; share =
    freq / posts of the community."""
    pc = post_communities.select("post_id", "community")
    total = pc.groupBy("community").agg(F.count(F.lit(1)).alias("total_posts"))
    freq = (pc.join(_long_tags(post_tags), "post_id").groupBy("community", "tag")
            .agg(F.count(F.lit(1)).alias("freq"))
            .join(communities.select("community", "tag"), ["community", "tag"], "left_anti"))
    w = Window.partitionBy("community").orderBy(F.col("freq").desc(), F.col("tag").asc())
    top = freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.join(total, "community")
            .select("community", "rank", "tag", "freq",
                    (F.col("freq") / F.col("total_posts")).alias("share")))


def tag_communities(post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """(tag, community) -- for posts with >= 2 tags whose tags meet
    >= 2 communities, every tag of the post (length > 1) is linked to all
    communities of the post.  One group-by per post (tag count, long tags
    and their community set), then the post's own tags x communities,
    which is bounded by the size of one post."""
    long_tag = F.length(F.col("tag").cast("string")) >= 2
    per_post = (post_tags.join(communities.select("tag", "community"), "tag", "left")
                .groupBy("post_id").agg(
                    F.count_distinct("tag").alias("n_tags"),
                    F.collect_set(F.when(long_tag, F.col("tag"))).alias("tags"),
                    F.collect_set(F.when(long_tag, F.col("community"))).alias("comms"))
                .filter((F.col("n_tags") >= 2) & (F.size("comms") >= 2)))
    return (per_post.select(F.explode("tags").alias("tag"), "comms")
            .select("tag", F.explode("comms").alias("community")).distinct())


def community_counts_per_tag(tag_comm: DataFrame) -> DataFrame:
    """(tag, n_communities) from C02, only tags linked to > 1 community."""
    return (tag_comm.groupBy("tag").agg(F.count(F.lit(1)).alias("n_communities"))
            .filter(F.col("n_communities") > 1))


def upper_outliers(df: DataFrame, key: str, value_col: str) -> DataFrame:
    """Rows whose value lies above Q3 + 1.5 IQR of the whole column (A10
    with one group)."""
    fences = iqr_outliers(df.select(F.lit(0).alias("_g"), F.col(value_col).cast("double").alias("_v")), ["_g"], "_v")
    hi = fences.filter(F.col("has_fences")).select((F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    # one number: taken as a literal so the filter needs no join at all
    bound = hi.agg(F.max("_hi")).first()[0]
    if bound is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(value_col).cast("double") > F.lit(float(bound)))


def tag_presence(post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """(tag, n_communities) of every C02 tag, made once and kept: reports,
    fences and exclusion lists all read this small table."""
    return (tag_communities(post_tags, communities).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("n_communities")).checkpoint())


def _report(numbers: DataFrame, key: str, n_top: int, totals: dict) -> DataFrame:
    """The presence report as rows (section, rank, item, value): the summary
    (``totals`` plus A09 of the numbers and the count of upper outliers), the
    ``n_top`` largest, and every upper outlier."""
    outliers = upper_outliers(numbers, key, "n_communities")
    summary = distribution_summary(numbers, "n_communities").select(
        *[v.cast("double").alias(k) for k, v in totals.items()], "max", "p75", "p50", "p25", "min", "mean",
        _scalar(outliers.select(F.count(F.lit(1)))).cast("double").alias("n_upper_outliers"))
    rows = summary.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value"))
                                              for c in summary.columns])).alias("s"))
    item, value = F.col(key).cast("string").alias("item"), F.col("n_communities").cast("double").alias("value")
    none = F.lit(None).cast("int").alias("rank")
    return (rows.select(F.lit("summary").alias("section"), none, "s.item", "s.value")
            .unionByName(top_by_value(numbers, key, "n_communities", n_top)
                         .select(F.lit("top").alias("section"), "rank", item, value))
            .unionByName(outliers.select(F.lit("outlier").alias("section"), none, item, value)))


def hashtag_community_presence(post_tags: DataFrame, communities: DataFrame, n_top: int = 500) -> DataFrame:
    """Tags seen in C02 and over all tags, share of tags in > 1
    community (both denominators), A09 of their community counts, the tags in
    the most communities and the upper outliers."""
    tags = tag_presence(post_tags, communities)
    counts = tags.filter(F.col("n_communities") > 1)
    n_c02, n_multi = tags.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_communities") > 1, 1))).first()
    n_all = _long_tags(post_tags).select("tag").distinct().count()
    totals = {"n_tags_c02": F.lit(n_c02), "n_tags_all": F.lit(n_all), "n_multi": F.lit(n_multi),
              "share_multi": F.try_divide(F.lit(float(n_multi)), F.lit(n_c02)),
              "share_multi_all": F.try_divide(F.lit(float(n_multi)), F.lit(n_all))}
    return _report(counts, "tag", n_top, totals)


def top_by_value(df: DataFrame, key: str, value_col: str, n: int) -> DataFrame:
    """Top-n rows by value desc, key asc, with a rank column (a distributed
    top-n: each partition keeps its n best before one small merge)."""
    top = df.orderBy(F.col(value_col).desc(), F.col(key).asc()).limit(n)
    w = Window.orderBy(F.col(value_col).desc(), F.col(key).asc())
    return top.withColumn("rank", F.row_number().over(w))  # over <= n rows


def outlier_exclusion_list(post_tags: DataFrame, communities: DataFrame, max_n: int = 100) -> DataFrame:
    """The upper-outlier tags of C03 (by community count), at most
    ``max_n``, ordered by count desc then tag."""
    counts = tag_presence(post_tags, communities).filter(F.col("n_communities") > 1)
    return top_by_value(upper_outliers(counts, "tag", "n_communities"), "tag", "n_communities", max_n)


def user_communities(posts: DataFrame, post_communities: DataFrame) -> DataFrame:
    """C04 base: (user_id, community) distinct."""
    return (posts.select(F.col("id").alias("post_id"), "user_id").join(post_communities, "post_id")
            .select("user_id", "community").distinct())


def user_community_counts(posts: DataFrame, post_communities: DataFrame) -> DataFrame:
    """Every author with the number of distinct communities (0 kept)."""
    n = user_communities(posts, post_communities).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_communities"))
    return (posts.select("user_id").distinct().join(n, "user_id", "left")
            .select("user_id", F.coalesce("n_communities", F.lit(0)).cast("bigint").alias("n_communities")))


def user_community_presence(posts: DataFrame, post_communities: DataFrame, n_top: int = 500) -> DataFrame:
    """The report of C03 over users (zero-community users stay in the
    denominator)."""
    uc = user_community_counts(posts, post_communities).checkpoint()
    n_users, n_multi = uc.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_communities") > 1, 1))).first()
    totals = {"n_users": F.lit(n_users), "n_multi": F.lit(n_multi),
              "share_multi": F.try_divide(F.lit(float(n_multi)), F.lit(n_users))}
    return _report(uc.filter(F.col("n_communities") > 1), "user_id", n_top, totals)


def tag_user_awareness(tag_users: DataFrame, n: int = 500) -> DataFrame:
    """Top n tags by #users with users / total users, plus the share of
    tags used by more than one user (same value on every row)."""
    n_tags = tag_users.select(F.count(F.lit(1))).scalar()
    n_multi = tag_users.filter(F.col("n_users") > 1).select(F.count(F.lit(1))).scalar()
    top = top_by_value(tag_users, "tag", "n_users", n)
    return top.select("rank", "tag", "n_users",
                      (F.col("n_users") / F.col("total_users")).alias("pct_users"),
                      F.try_divide(n_multi.cast("double"), n_tags).alias("share_multi_user"))


def tag_user_awareness_report(tag_users: DataFrame, n_top: int = 500) -> DataFrame:
    """The report of C03 over tags and the users who know them.
    ``tag_users`` (tag, n_users, total_users) is kept, as totals, summary and
    fences read it; its totals are taken while the query is built."""
    kept = tag_users.checkpoint()
    n_tags, n_users, n_multi = kept.agg(F.count(F.lit(1)), F.max("total_users"), F.count(F.when(F.col("n_users") > 1, 1))).first()
    totals = {"n_tags": F.lit(n_tags), "n_users": F.lit(n_users), "share_multi": F.try_divide(F.lit(float(n_multi)), F.lit(n_tags))}
    return _report(kept.select("tag", F.col("n_users").alias("n_communities")), "tag", n_top, totals)


def community_tag_matrix(post_tags: DataFrame, tag_comm: DataFrame) -> DataFrame:
    """C07 long form: (community, tag, freq) -- posts carrying each
    multi-community tag, for every community the tag is linked to."""
    counts = community_counts_per_tag(tag_comm).select("tag")
    freq = post_tags.join(counts, "tag", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("freq"))
    return tag_comm.join(counts, "tag", "left_semi").join(freq, "tag").select("community", "tag", "freq")


def community_user_matrix(posts: DataFrame, post_tags: DataFrame, communities: DataFrame,
                          selected_users: DataFrame) -> DataFrame:
    """C08 long form: (community, user_id, n) -- tag uses of each selected
    user that belong to the community."""
    p = posts.select(F.col("id").alias("post_id"), "user_id").join(selected_users.select("user_id"), "user_id", "left_semi")
    return (p.join(post_tags, "post_id").join(communities, "tag")
            .groupBy("community", "user_id").agg(F.count(F.lit(1)).alias("n")))


def pair_overlaps(members: DataFrame, group_col: str, elem_col: str) -> DataFrame:
    """(g1, g2, inter) for every unordered pair g1 < g2 sharing at
    least one element, via signature pre-aggregation."""
    sig = (members.select(group_col, elem_col).distinct()
           .groupBy(elem_col).agg(F.array_sort(F.collect_set(group_col)).alias("sig"))
           .filter(F.size("sig") >= 2)
           .groupBy("sig").agg(F.count(F.lit(1)).alias("w")))
    pairs = (sig.select("w", "sig", F.posexplode("sig").alias("i", "g1"))
             .select("w", "g1", F.explode(F.slice("sig", F.col("i") + 2, F.size("sig"))).alias("g2")))
    return pairs.groupBy("g1", "g2").agg(F.sum("w").alias("inter"))


def jaccard_pairs(members: DataFrame, group_col: str, elem_col: str) -> DataFrame:
    """|A n B| / |A u B| for group pairs with a shared element."""
    sizes = members.select(group_col, elem_col).distinct().groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    ov = pair_overlaps(members, group_col, elem_col)
    a = sizes.select(F.col(group_col).alias("g1"), F.col("n").alias("n1"))
    b = sizes.select(F.col(group_col).alias("g2"), F.col("n").alias("n2"))
    j = ov.join(a, "g1").join(b, "g2")
    union = F.col("n1") + F.col("n2") - F.col("inter")
    return j.select(F.col("g1").alias("community1"), F.col("g2").alias("community2"),
                    F.col("inter").cast("bigint").alias("inter"), union.cast("bigint").alias("union"),
                    (F.col("inter") / union).alias("similarity"))


def community_tag_sets(post_tags: DataFrame, post_communities: DataFrame, exclusion: DataFrame | None = None,
                       restrict_to: DataFrame | None = None) -> DataFrame:
    """(community, tag): tags (length > 1) seen in the posts of each
    community, minus an exclusion list, optionally only dictionary tags."""
    ct = post_communities.join(_long_tags(post_tags), "post_id").select("community", "tag")
    if exclusion is not None:
        ct = ct.join(exclusion.select("tag"), "tag", "left_anti")
    if restrict_to is not None:
        ct = ct.join(restrict_to.select("tag").distinct(), "tag", "left_semi")
    return ct.distinct()


def normalise_by_max(pairs: DataFrame, col: str = "similarity") -> DataFrame:
    """Divide by the maximum score (scalar subquery, no join)."""
    mx = pairs.select(F.max(col)).scalar()
    return pairs.withColumn(col, F.col(col) / mx)


def similar_pairs(pairs: DataFrame) -> DataFrame:
    """(c1, c2, score) with score > 0."""
    return (pairs.filter(F.col("similarity") > 0)
            .select("community1", "community2", F.col("similarity").alias("score")))
