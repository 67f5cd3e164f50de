"""Community statistics.

Every statistic is one declarative plan: posts are attached to communities
by an equi-join on the exploded tag table, then aggregated with partial
(map-side) aggregation.  Distinct counts are done as two-level group-bys on
(community, value) so that a hot community is spread over many tasks by
the value hash instead of landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communitylens.functions.text import r4, split_whitespace

MEDIA_TYPE = "photo"  # the one media type of the post feed
ENTITY_KINDS = ("hashtag", "mention", "url", "media", "symbol")


def _ratio(num, den):
    """num / den rounded to 4 decimals, 0 when den is 0 (reference prints 0)."""
    return F.when(den > 0, r4(F.try_divide(num.cast("double"), den.cast("double")))).otherwise(F.lit(0.0))


def content_stats(posts: DataFrame, post_entities: DataFrame, post_communities: DataFrame,
                  community_names: DataFrame) -> DataFrame:
    """Per community the entity and word statistics of its posts.

    ``community_names`` is the list of communities to report (all zeros when
    a community has no post)."""
    pc = post_communities.select("post_id", "community")
    words = posts.select(F.col("id").alias("post_id"), _word_items("status_text").alias("items"))
    return _content_table(
        pc.join(words, "post_id").select("community", F.explode("items").alias("item"))
        .unionByName(pc.join(post_entities, "post_id").select("community", F.struct("kind", "value").alias("item"))), community_names)


def content_stats_of_rows(rows: DataFrame, community_names: DataFrame) -> DataFrame:
    """A01 of posts that are one row each (communities, entities, texts), the
    lists of its communities, its (kind, value) entities and its texts."""
    items = F.concat("entities", F.flatten(F.transform("texts", _word_items)))
    each = rows.select("communities", F.explode(items).alias("item"))
    return _content_table(each.select(F.explode("communities").alias("community"), "item"), community_names)


def _word_items(text):
    """A text as (kind, value): itself, then its words."""
    words = F.transform(split_whitespace(text), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("value")))
    return F.concat(F.array(F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("value"))), words)


def _content_table(items: DataFrame, community_names: DataFrame) -> DataFrame:
    """A01 from (community, item): an entity, a word or a text of a post in the
    community.  One group-by on the different values, one on the communities."""
    kind = F.col("item.kind")
    sort = F.when(kind.isin("word", "text"), kind).otherwise("entity")
    per_value = items.groupBy("community", sort.alias("sort"), F.col("item.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in ENTITY_KINDS])
    of = lambda s, v: F.sum(F.when(F.col("sort") == s, v).otherwise(0))
    found = per_value.groupBy("community").agg(
        of("text", F.col("n")).alias("total_tweets"), of("word", F.col("n")).alias("n_words"), of("word", 1).alias("u_words"),
        of("entity", 1).alias("u_any"),
        *[F.count(F.when(F.col(f"n_{k}") > 0, 1)).alias(f"u_{k}") for k in ENTITY_KINDS],
        *[F.sum(f"n_{k}").alias(f"t_{k}") for k in ENTITY_KINDS])

    j = community_names.select("community").distinct().join(found, "community", "left").na.fill(0)
    n = F.col("total_tweets")
    t_any = sum((F.col(f"t_{k}") for k in ENTITY_KINDS), F.lit(0))
    return j.select(
        F.col("community").alias("tag"),
        n.cast("bigint").alias("total_tweets"),
        _ratio(F.col("u_hashtag"), n).alias("avg_unique_hashtag"),
        _ratio(F.col("u_mention"), n).alias("avg_unique_mention"),
        _ratio(F.col("u_url"), n).alias("avg_unique_urls"),
        _ratio(F.col("u_media"), n).alias("avg_unique_media"),
        _ratio(F.col("u_symbol"), n).alias("avg_unique_symbol"),
        _ratio(F.col("u_any"), n).alias("avg_unique_anyentity"),
        _ratio(F.col("t_hashtag"), n).alias("avg_hashtags"),
        _ratio(F.col("t_mention"), n).alias("avg_mention"),
        _ratio(F.col("t_url"), n).alias("avg_urls"),
        _ratio(F.col("t_media"), n).alias("avg_media"),
        _ratio(F.col("t_symbol"), n).alias("avg_symbol"),
        _ratio(t_any, n).alias("avg_anyentity"),
        _ratio(F.col("u_words"), n).alias("avg_tweet_uniquewords"),
        _ratio(F.col("n_words"), n).alias("avg_tweet_length"),
        _ratio(F.col("u_words"), F.col("n_words")).alias("avg_tweet_density"),
    )


def interaction_stats(posts: DataFrame, post_communities: DataFrame) -> DataFrame:
    """Per community interaction shares and frequencies.

    Counters are taken over the interacted posts (any counter >= 1); the
    denominators are all posts of the community (``n_all``) as the reference
    intends; ``total`` = ``n_interacted`` keeps the reference's column."""
    p = posts.select(F.col("id").alias("post_id"), "kind",
                     *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
                       ("retweet_count", "quote_count", "favorite_count", "reply_count")])
    rt, qt, fv, rp = (F.col(c) for c in ("retweet_count", "quote_count", "favorite_count", "reply_count"))
    inter = (rt > 0) | (qt > 0) | (fv > 0) | (rp > 0)

    def csum(cond, val=None):
        return F.sum(F.when(inter & cond, 1 if val is None else val).otherwise(0))

    g = post_communities.join(p, "post_id").groupBy("community").agg(
        F.count(F.lit(1)).alias("n_all"),
        csum(F.lit(True)).alias("n_interacted"),
        csum(rt > 0).alias("retweeted"), csum(rt > 0, rt).alias("rt_freq"),
        csum(qt > 0).alias("quoted"), csum(qt > 0, qt).alias("quote_freq"),
        csum(fv > 0).alias("liked"), csum(fv > 0, fv).alias("like_freq"),
        csum(rp > 0).alias("replied"), csum(rp > 0, rp).alias("reply_freq"),
        csum(F.col("kind") == "reply").alias("as_replies_n"),
        csum(F.col("kind") == "quote").alias("as_quotes_n"))
    n = F.col("n_all")
    c = F.col
    return g.select(
        c("community").alias("tag"), c("n_interacted").cast("bigint").alias("total"),
        _ratio(c("retweeted") + c("quoted"), n).alias("pct_retweeted"),
        _ratio(c("rt_freq") + c("quote_freq"), n).alias("avg_rt_freq"),
        _ratio(c("liked"), n).alias("pct_liked"),
        _ratio(c("like_freq"), n).alias("avg_like_freq"),
        _ratio(c("replied"), n).alias("pct_replied"),
        _ratio(c("reply_freq"), n).alias("avg_reply_freq"),
        _ratio(c("n_interacted"), n).alias("pct_interacted"),
        _ratio(c("rt_freq") + c("quote_freq") + c("like_freq") + c("reply_freq"), n).alias("avg_interact_freq"),
        _ratio(c("as_replies_n"), n).alias("as_replies"),
        _ratio(c("as_quotes_n"), n).alias("as_quotes"),
        c("n_interacted").cast("bigint").alias("n_interacted"), n.cast("bigint").alias("n_all"))


def user_rollup(posts: DataFrame) -> DataFrame:
    """Per author the given and received counts.

    new vs retweet by the text prefix 'rt ' (case-insensitive); replies are
    posts with a reply target; quotes are quote posts."""
    is_rt = F.lower(F.col("status_text")).startswith("rt ")
    return posts.groupBy("user_id").agg(
        F.sum(F.when(~is_rt, 1).otherwise(0)).cast("int").alias("newtweet_count"),
        F.sum(F.when(is_rt, 1).otherwise(0)).cast("int").alias("retweet_count"),
        F.sum(F.when(F.col("in_reply_to_user_id").isNotNull(), 1).otherwise(0)).cast("int").alias("reply_count"),
        F.sum(F.when(F.col("kind") == "quote", 1).otherwise(0)).cast("int").alias("quote_count"),
        F.sum(F.coalesce("favorite_count", F.lit(0))).cast("bigint").alias("favorited_count"),
        F.sum(F.coalesce("reply_count", F.lit(0))).cast("bigint").alias("replied_count"),
        F.sum(F.coalesce("retweet_count", F.lit(0))).cast("bigint").alias("retweeted_count"),
        F.sum(F.coalesce("quote_count", F.lit(0))).cast("bigint").alias("quoted_count"))


def _user_entities(posts: DataFrame, post_entities: DataFrame | None = None) -> DataFrame:
    """(user_id, kind, value) of the entities in each author's posts, which may
    carry them as ``entities``."""
    if post_entities is None:
        return posts.select("user_id", F.explode("entities").alias("e")).select("user_id", "e.*")
    return posts.select(F.col("id").alias("post_id"), "user_id").join(post_entities, "post_id").select("user_id", "kind", "value")


def user_entity_sets(posts: DataFrame, post_entities: DataFrame | None = None) -> DataFrame:
    """A05 entity part: the distinct entity set of each author as a long
    table (user_id, kind, value) -- never a per-user array.  A media entity
    brings its type along as a kind of its own, in the same pass."""
    own = F.struct(F.col("kind").alias("kind"), F.col("value").alias("value"))
    media = F.struct(F.lit("media_type").alias("kind"), F.lit(MEDIA_TYPE).alias("value"))
    both = F.when(F.col("kind") == "media", F.array(own, media)).otherwise(F.array(own))
    return _user_entities(posts, post_entities).select("user_id", F.explode(both).alias("e")).select("user_id", "e.*").distinct()


def user_rollup_with_sets(posts: DataFrame, post_entities: DataFrame) -> DataFrame:
    """A05 as one row per author: counts plus the size of each entity set."""
    sets = (_user_entities(posts, post_entities).distinct().groupBy("user_id")
            .agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ENTITY_KINDS]))
    return user_rollup(posts).join(sets, "user_id", "left").na.fill(0, [f"n_{k}" for k in ENTITY_KINDS])


def _value_bucket(v):
    """A coarse bucket that never falls as the value rises: a 256th of a
    natural-log step, so that a (group, bucket) window stays small however
    many distinct values a group has."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 256).cast("bigint")


def values_at_ranks(hist: DataFrame, group_cols, value_col: str, ranks: dict) -> DataFrame:
    """(group, n, one column per rank) from a histogram (group, value, _c).

    ``ranks`` maps a column name to its 0-based rank as an expression over
    ``_n``, the rows of the group.  Two levels: rows before a value bucket come from
    the bucket counts of the group, the rank inside from a window over the
    distinct values of that one bucket."""
    g = list(group_cols)
    x = hist.withColumn("_b", _value_bucket(F.col(value_col)))
    buckets = x.groupBy(*g, "_b").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (buckets.withColumn("_before", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
               .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*g))))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r.cast("bigint").alias("r")) for k, r in ranks.items()]))
    wanted = (buckets.select(*g, "_b", "_before", "_bc", "_n", asked.alias("q"))
              .filter((F.col("_before") <= F.col("q.r")) & (F.col("q.r") < F.col("_before") + F.col("_bc")))
              .select(*g, "_b", "_n", F.col("q.k").alias("_k"), (F.col("q.r") - F.col("_before")).alias("_r")))
    inside = Window.partitionBy(*g, "_k").orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = x.join(wanted, [*g, "_b"]).withColumn("_cum", F.sum("_c").over(inside)).filter(F.col("_cum") > F.col("_r"))
    return hit.groupBy(*g).agg(F.first("_n").alias("n"),
                               *[F.min(F.when(F.col("_k") == k, F.col(value_col))).alias(k) for k in ranks])


def iqr_outliers(df: DataFrame, group_cols, value_col: str) -> DataFrame:
    """A10: rank-based IQR fences per group.

    Q1 = v[floor(25n/100)], Q3 = v[floor(75n/100)] of the ascending values
    (0-based, no interpolation); outliers lie strictly outside
    Q1 - 1.5 IQR .. Q3 + 1.5 IQR; fences are null when IQR = 0.

    Values are first reduced to a (group, value) histogram (partial
    aggregation, spread by value hash); the two ranks come from
    ``values_at_ranks``, so no window runs over all values of a group."""
    g = list(group_cols)
    h = df.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_c"))
    q = values_at_ranks(h, g, value_col, {"q1": F.floor(F.col("_n") * 25 / 100), "q3": F.floor(F.col("_n") * 75 / 100)})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    hq = h.join(q, g)
    return hq.groupBy(*g).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("q3").alias("q3"),
        F.first("iqr").alias("iqr"),
        F.sum(F.when(F.col(value_col) < lo, F.col("_c")).otherwise(0)).alias("n_low"),
        F.sum(F.when(F.col(value_col) > hi, F.col("_c")).otherwise(0)).alias("n_high"),
    ).withColumn("has_fences", F.col("iqr") != 0)


MIN_INSTANCES_FOR_OUTLIER = 10


def user_stats(users: DataFrame, rollup: DataFrame, user_communities: DataFrame) -> DataFrame:
    """Per community over its users: generators (new + replies > 0),
    propagators (retweets + quotes > 0), their activity and reach with
    sample deviations and IQR outlier shares (-1 when fewer than 10 values
    or IQR = 0).  The propagator arrays use the retweet count."""
    u = (user_communities.select("user_id", "community")
         .join(rollup.select("user_id", (F.col("newtweet_count") + F.col("reply_count")).alias("nt"),
                             (F.col("retweet_count") + F.col("quote_count")).alias("rt")), "user_id", "left")
         .join(users.select(F.col("id").alias("user_id"), "followers"), "user_id", "left")
         .na.fill(0, ["nt", "rt", "followers"]))
    base = u.groupBy("community").agg(
        F.count(F.lit(1)).alias("users"),
        F.count(F.when(F.col("nt") > 0, 1)).alias("cg"),
        F.count(F.when(F.col("rt") > 0, 1)).alias("cp"),
        F.sum(F.when(F.col("nt") > 0, F.col("nt"))).alias("total_nt"),
        F.sum(F.when(F.col("rt") > 0, F.col("rt"))).alias("total_rt"),
        F.sum(F.when(F.col("nt") > 0, F.col("followers"))).alias("cg_follower"),
        F.sum(F.when(F.col("rt") > 0, F.col("followers"))).alias("cp_follower"),
        F.stddev_samp(F.when(F.col("nt") > 0, F.col("nt"))).alias("dev_nt"),
        F.stddev_samp(F.when(F.col("rt") > 0, F.col("rt"))).alias("dev_rt"),
        F.stddev_samp(F.when(F.col("nt") > 0, F.col("followers"))).alias("dev_cgr"),
        F.stddev_samp(F.when(F.col("rt") > 0, F.col("followers"))).alias("dev_cpr"))
    series = u.select("community", F.explode(F.array(
        F.when(F.col("nt") > 0, F.struct(F.lit("nt").alias("m"), F.col("nt").cast("double").alias("v"))),
        F.when(F.col("rt") > 0, F.struct(F.lit("rt").alias("m"), F.col("rt").cast("double").alias("v"))),
        F.when(F.col("nt") > 0, F.struct(F.lit("cgr").alias("m"), F.col("followers").cast("double").alias("v"))),
        F.when(F.col("rt") > 0, F.struct(F.lit("cpr").alias("m"), F.col("followers").cast("double").alias("v"))),
    )).alias("s")).filter(F.col("s").isNotNull()).select("community", "s.m", "s.v")
    out = iqr_outliers(series, ["community", "m"], "v")
    ok = (F.col("n") >= MIN_INSTANCES_FOR_OUTLIER) & F.col("has_fences")
    shares = out.select(
        "community", "m",
        F.when(ok, r4(F.col("n_low") / F.col("n"))).otherwise(F.lit(-1.0)).alias("low"),
        F.when(ok, r4(F.col("n_high") / F.col("n"))).otherwise(F.lit(-1.0)).alias("high"))
    piv = shares.groupBy("community").pivot("m", ["nt", "rt", "cgr", "cpr"]).agg(
        F.first("low").alias("low"), F.first("high").alias("high"))
    j = base.join(piv, "community", "left")
    c = F.col

    def share(name):
        return F.coalesce(c(name), F.lit(-1.0))

    def dev(name):
        return r4(F.coalesce(c(name), F.lit(0.0)))

    return j.select(
        c("community").alias("tag"), c("users").cast("bigint").alias("unique_users"),
        _ratio(c("cg"), c("users")).alias("pct_content_gen"),
        _ratio(c("cp"), c("users")).alias("pct_content_pp"),
        _ratio(c("total_nt"), c("cg")).alias("avg_nt_per_cg"), dev("dev_nt").alias("dev_nt"),
        share("nt_low").alias("pct_cg_outliers_low"), share("nt_high").alias("pct_cg_outliers_high"),
        _ratio(c("total_rt"), c("cp")).alias("avg_rt_per_cp"), dev("dev_rt").alias("dev_rt"),
        share("rt_low").alias("pct_cp_outliers_low"), share("rt_high").alias("pct_cp_outliers_high"),
        _ratio(c("cg_follower"), c("cg")).alias("cg_reach"), dev("dev_cgr").alias("dev_cgr"),
        share("cgr_low").alias("cgr_outliers_low"), share("cgr_high").alias("cgr_outliers_high"),
        _ratio(c("cp_follower"), c("cp")).alias("cp_reach"), dev("dev_cpr").alias("dev_cpr"),
        share("cpr_low").alias("cpr_outliers_low"), share("cpr_high").alias("cpr_outliers_high"))


USER_TYPES = ("patient", "advocate", "research", "hpi", "hpo")


def user_type_counts(users: DataFrame, user_communities: DataFrame) -> DataFrame:
    """Users per community by label (case-insensitive); 'other' for an
    unknown label, 'none' for a missing one."""
    lab = F.lower(F.col("label"))
    j = user_communities.join(users.select(F.col("id").alias("user_id"), "label"), "user_id", "left")
    return j.groupBy(F.col("community").alias("tag")).agg(
        *[F.count(F.when(lab == t, 1)).alias(t) for t in USER_TYPES],
        F.count(F.when(lab.isNotNull() & ~lab.isin(*USER_TYPES), 1)).alias("other"),
        F.count(F.when(lab.isNull(), 1)).alias("none"))


def distinct_authors(posts: DataFrame) -> DataFrame:
    """A06."""
    return posts.select("user_id").distinct()


def communities_per_user(users: DataFrame, posts: DataFrame, post_communities: DataFrame) -> DataFrame:
    """Distinct communities of each listed user, 0 when none."""
    pc = posts.select(F.col("id").alias("post_id"), "user_id").join(post_communities, "post_id")
    n = pc.groupBy("user_id").agg(F.count_distinct("community").alias("n_communities"))
    return (users.select(F.col("id").alias("user_id")).join(n, "user_id", "left")
            .select("user_id", F.coalesce("n_communities", F.lit(0)).cast("bigint").alias("n_communities")))


def tag_user_counts(posts: DataFrame, post_tags: DataFrame) -> DataFrame:
    """Users per tag (tags of length > 1) and the total user count
    (a scalar subquery, no join)."""
    ut = (post_tags.filter(F.length(F.col("tag").cast("string")) > 1)
          .join(posts.select(F.col("id").alias("post_id"), "user_id"), "post_id"))
    total = posts.select(F.count_distinct("user_id")).scalar()
    return (ut.groupBy("tag").agg(F.count_distinct("user_id").alias("n_users"))
            .withColumn("total_users", total))


def distribution_summary(df: DataFrame, value_col: str, group_cols=()) -> DataFrame:
    """Max, .75, .50, .25, min and mean (exact, interpolated
    percentiles as DuckDB quantile_cont): each percentile lies between the
    values at two ranks of a histogram."""
    g = list(group_cols) or ["_all"]
    src = df.select(*group_cols, *([] if group_cols else [F.lit(0).alias("_all")]), F.col(value_col).cast("double").alias("_v"))
    h = src.filter(F.col("_v").isNotNull()).groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c"))
    shares = {"p75": 0.75, "p50": 0.5, "p25": 0.25}
    ranks = {}
    for name, p in shares.items():
        place = F.lit(p) * (F.col("_n") - 1)
        ranks |= {f"{name}_lo": F.floor(place), f"{name}_hi": F.ceil(place)}
    q = values_at_ranks(h, g, "_v", ranks)
    whole = h.groupBy(*g).agg(F.max("_v").alias("max"), F.min("_v").alias("min"),
                              r4(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))

    def between(name, p):
        place = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return r4(lo + (hi - lo) * (place - F.floor(place))).alias(name)
    return (q.join(whole, g).select(*group_cols, "max", between("p75", 0.75), between("p50", 0.5), between("p25", 0.25),
                                    "min", "mean"))


def edge_weights(edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """Count of each (from, to) pair."""
    return edges.groupBy(src, dst).agg(F.count(F.lit(1)).alias("weight"))


def posts_in_window_ratio(timeline: DataFrame, stored: DataFrame, start: str, end: str,
                          estimate_days: int = 30) -> DataFrame:
    """Per user the share of stored posts among the posts in [start,
    end].  When the whole available timeline begins after ``start`` the
    in-range count is estimated as (total // days) * 30.  The in-range
    count is raised to the stored count when it is smaller (or zero)."""
    s, e = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    ts = F.col("ts")
    g = timeline.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(ts.between(s, e), 1)).alias("in_range_n"),
        F.max(ts).alias("newest"), F.min(ts).alias("oldest"))
    us = F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp"))
    days = F.floor(us / F.lit(86400000000)) + 1
    est = F.floor(F.col("total") / days) * estimate_days
    g = g.withColumn("in_range", F.when(F.col("oldest") > s, est).otherwise(F.col("in_range_n")).cast("bigint"))
    j = g.join(stored, "user_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)).cast("bigint"))
    adj = F.when((F.col("in_range") == 0) | (F.col("in_range") < F.col("stored")), F.col("stored")).otherwise(F.col("in_range"))
    return j.select("user_id", "stored", adj.alias("in_range"),
                    r4(F.try_divide(F.col("stored").cast("double"), adj.cast("double"))).alias("ratio"))


def count_matches(df: DataFrame) -> DataFrame:
    """Number of rows matching (already filtered) -- one row."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def stats_cleaner(stats_df: DataFrame, support: DataFrame, cols, min_posts: int = 50,
                  min_users: int = 10) -> DataFrame:
    """F12 + F13 on a statistics table; rows of communities below the
    support limits are kept apart with ``kept`` = false."""
    s = support.select(F.col("community").alias("tag"),
                       ((F.col("n_posts") >= min_posts) & (F.col("n_users") >= min_users)).alias("kept"))
    return (stats_df.select(*cols).join(s, "tag", "left")
            .withColumn("kept", F.coalesce("kept", F.lit(False))))


def tag_inventory_stats(organised: DataFrame) -> DataFrame:
    """Totals of a organised tag dictionary (tag, community, role, type):
    discarded tags by type, kept tags, communities, communities with own and
    with community-building tags.  One long (metric, key, value) table."""
    o = organised
    disc = o.filter(F.col("role") == "discarded")
    kept = o.filter(F.col("role") != "discarded")
    parts = [
        disc.groupBy(F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("discarded").alias("metric"), "key", "value"),
        disc.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_discarded").alias("metric"), F.lit("").alias("key"), "value"),
        kept.agg(F.count_distinct("tag").alias("value")).select(F.lit("total_tags").alias("metric"), F.lit("").alias("key"), "value"),
        kept.agg(F.count_distinct("community").alias("value")).select(F.lit("total_communities").alias("metric"), F.lit("").alias("key"), "value"),
        o.filter(F.col("role") == "own").agg(F.count_distinct("community").alias("value")).select(F.lit("with_own").alias("metric"), F.lit("").alias("key"), "value"),
        o.filter(F.col("role") == "cb").agg(F.count_distinct("community").alias("value")).select(F.lit("with_cb").alias("metric"), F.lit("").alias("key"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
