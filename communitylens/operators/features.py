"""Per-user feature tables (U-K1 ... U-T1).

All features are group-by aggregates over long (user, post, value) tables.
Pairwise post similarity (U-K4) uses exact sum identities over normalised
word-count vectors, so no (post, post) pairs are ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.functions.lexicons import POLARITY_THRESHOLD, SENTIMENT_ALPHA, SENTIMENT_LEXICON
from communitylens.functions.text import harmonic_mean, null_safe_ratio, split_whitespace, username_shape

WORD_PATTERN = r"\b\w\w+\b"


def post_entity_counts(posts: DataFrame, post_entities: DataFrame | None = None) -> DataFrame:
    """(id, user_id, kind, n_hashtag, n_url, n_mention, favorite_count,
    retweet_count, created_at, status_text): per-post entity counts, 0 when
    the post has none.  Posts that carry their ``entities`` need no join."""
    if post_entities is None:
        def own(k):
            found = F.size(F.filter("entities", lambda x: x["kind"] == k)).cast("bigint")
            return F.when(F.col("entities").isNotNull(), found).otherwise(F.lit(0)).alias(f"n_{k}")
        return posts.select("*", *[own(k) for k in ("hashtag", "url", "mention")]).drop("entities")
    c = post_entities.groupBy("post_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("hashtag", "url", "mention")])
    p = posts.join(c, posts.id == c.post_id, "left").drop("post_id")
    return p.na.fill(0, ["n_hashtag", "n_url", "n_mention"])


def flag(condition) -> F.Column:
    """'1' where the condition holds, else '0'."""
    return F.when(condition, "1").otherwise("0")


def kim_profile_features(users: DataFrame, rollup: DataFrame) -> DataFrame:
    """U-K1: profile counters, image flags and word counts of screen name and
    profile; ``users`` carries the profile facts."""
    j = users.join(rollup, users.id == rollup.user_id, "left")
    z = F.lit(0)
    return j.select(
        F.col("id").alias("user_id"), flag(~F.col("own_image")).alias("default_profile_image"),
        F.coalesce("favorited_count", z).cast("bigint").alias("favorite_count"),
        F.col("favourites").alias("favorites_count"),
        F.col("followers").cast("bigint").alias("followers_count"), F.col("friends").cast("bigint").alias("friends_count"),
        F.col("listed").alias("listed_count"), flag(F.col("own_background")).alias("profile_use_background_image"),
        F.coalesce("retweet_count", z).cast("bigint").alias("retweet_count"),
        (F.coalesce("newtweet_count", z) + F.coalesce("retweet_count", z)).cast("bigint").alias("statuses_count"),
        F.size(split_whitespace(F.coalesce("screen_name", F.lit("")))).alias("screen_name_words"),
        F.size(split_whitespace(F.coalesce("user_desc", F.lit("")))).alias("desc_words"))


_KINDS3 = ("hashtag", "url", "mention")


def kim_post_features(pec: DataFrame) -> DataFrame:
    """U-K2: originals (ot) vs retweets (rt) per user: count, favourites,
    totals; mean / median / max / min over *all* posts with 0 for posts of
    the other kind (as the reference's arrays); total mentions from
    mentions.  A median is exact and keeps a count for each different value,
    combined before the shuffle: entity counts of a post are small numbers."""
    is_rt = F.col("kind") == "retweet"
    aggs = []
    for side, cond in (("ot", ~is_rt), ("rt", is_rt)):
        aggs += [F.count(F.when(cond, 1)).alias(f"{side}_count"),
                 F.coalesce(F.sum(F.when(cond, F.col("favorite_count"))), F.lit(0)).cast("bigint").alias(f"{side}_favorite_count")]
        for k in _KINDS3:
            v = F.when(cond, F.col(f"n_{k}")).otherwise(0).cast("double")
            aggs += [F.sum(v).alias(f"total_{k}_in_{side}"), F.round(F.avg(v), 4).alias(f"mean_{k}_in_{side}"),
                     F.round(F.median(v), 4).alias(f"median_{k}_in_{side}"), F.max(v).alias(f"max_{k}_in_{side}"),
                     F.min(v).alias(f"min_{k}_in_{side}")]
    return pec.groupBy("user_id").agg(*aggs)


def _regex_hits(text_col, keywords) -> F.Column:
    """All matches of every keyword pattern in the lower-cased text (one
    array per keyword, concatenated: overlapping keywords all count)."""
    t = F.lower(text_col)
    return F.concat(*[F.regexp_extract_all(t, F.lit(k), 0) for k in keywords]) if keywords else F.array()


def kim_keyword_features(pec: DataFrame, entity_strings: DataFrame, keywords) -> DataFrame:
    """U-K3: total and unique keyword hits per user, for originals and
    retweets, in the text, hashtags, urls and mentions."""
    is_rt = F.col("kind") == "retweet"
    base = pec.select("id", "user_id", F.when(is_rt, "rt").otherwise("ot").alias("side"), "status_text")
    x = base.join(entity_strings, "id", "left")
    fields = {"text": F.col("status_text"), "hashtag": F.col("hashtags"), "url": F.col("urls"), "mention": F.col("mentions")}
    long = x.select("user_id", "side", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), _regex_hits(F.coalesce(c, F.lit("")), keywords).alias("hits"))
        for f, c in fields.items()])).alias("e")).select("user_id", "side", "e.field", F.explode("e.hits").alias("hit"))
    g = long.groupBy("user_id", "side", "field").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("hit").alias("uniq"))
    out = g.select("user_id", F.concat_ws("_", "side", "field").alias("k"), "total", "uniq")
    names = [f"{s}_{f}" for s in ("ot", "rt") for f in fields]
    w = out.groupBy("user_id").pivot("k", names).agg(F.first("total").alias("total"), F.first("uniq").alias("unique"))
    users = pec.select("user_id").distinct()
    return users.join(w, "user_id", "left").na.fill(0)


def post_cosine(pec: DataFrame) -> DataFrame:
    """U-K4: per user and side (ot / rt): mean = sum of pairwise cosines of
    the posts' word-count vectors / number of posts; std = population std
    over the pairs (null without pairs).

    With unit vectors a_i: sum_{i<j} cos = (|sum a_i|^2 - n')/2 and
    sum_{i<j} cos^2 = (||sum a_i a_i^T||_F^2 - n')/2, n' = non-empty posts.
    Both need only per-post word (pair) weights, never post pairs."""
    is_rt = F.col("kind") == "retweet"
    p = pec.select("id", "user_id", F.when(is_rt, "rt").otherwise("ot").alias("side"),
                   F.regexp_extract_all(F.lower("status_text"), F.lit(WORD_PATTERN), 0).alias("w"))
    counts = (p.select("id", "user_id", "side", F.explode("w").alias("word"))
              .groupBy("id", "user_id", "side", "word").agg(F.count(F.lit(1)).cast("double").alias("c")))
    # a post's vector is one row, so that its pairs need no join; a word alone stands for the sum of vectors
    cell = F.struct("user_id", "side", "word", "c")
    posts = (counts.filter(F.col("id").isNotNull()).groupBy("id")
             .agg(F.collect_list(cell).alias("cells"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm")))
    a, b, norm = F.col("a"), F.col("b"), F.col("norm")
    # the word-pair matrix is symmetric: its upper half is made, what is off the diagonal counts twice
    pairs = (posts.select("norm", "cells", F.explode("cells").alias("a"))
             .select("norm", "a", F.explode(F.concat(F.array(F.lit(None)), "cells")).alias("b"))
             .filter(b.isNull() | (a.word <= b.word))
             .groupBy(a.user_id.alias("user_id"), a.side.alias("side"), a.word.alias("w1"), b.word.alias("w2"))
             .agg(F.sum(a.c / norm * F.coalesce(b.c / norm, F.lit(1.0))).alias("m")))
    square = F.col("m") * F.col("m")
    sums = pairs.groupBy("user_id", "side").agg(
        F.sum(F.when(F.col("w2").isNull(), square)).alias("s2"),
        F.sum(F.when(F.col("w1") == F.col("w2"), square).when(F.col("w1") < F.col("w2"), 2.0 * square)).alias("m2"))
    n = p.groupBy("user_id", "side").agg(F.count(F.lit(1)).alias("n"),
                                         F.count(F.when(F.size("w") > 0, 1)).alias("n_nz"))
    j = n.join(sums, ["user_id", "side"], "left").na.fill(0.0, ["s2", "m2"])
    npairs = F.col("n") * (F.col("n") - 1) / 2
    sum_cos = (F.col("s2") - F.col("n_nz")) / 2
    sum_cos2 = (F.col("m2") - F.col("n_nz")) / 2
    mean_pairs = sum_cos / npairs
    var = F.greatest(sum_cos2 / npairs - mean_pairs * mean_pairs, F.lit(0.0))
    r = j.select("user_id", "side", F.round(sum_cos / F.col("n"), 4).alias("cos_mean"),
                 F.when(npairs > 0, F.round(F.sqrt(var), 4)).alias("cos_std"))
    return r.groupBy("user_id").pivot("side", ["ot", "rt"]).agg(F.first("cos_mean").alias("cos_mean"),
                                                                 F.first("cos_std").alias("cos_std"))


def penn_profile_features(users: DataFrame, rollup: DataFrame) -> DataFrame:
    """U-P1: name length and shape (X08), avatar / location flags,
    followers, friends, friend/follower ratio, totals and retweet share."""
    name = F.col("screen_name")
    alpha, digits, case = username_shape(name)
    case = case.cast("string")
    j = users.join(rollup, users.id == rollup.user_id, "left")
    total = F.coalesce("newtweet_count", F.lit(0)) + F.coalesce("retweet_count", F.lit(0))
    rts = F.coalesce("retweet_count", F.lit(0))
    return j.select(F.col("id").alias("user_id"), F.length(name).alias("user_name_length"),
                    digits.alias("num_char_in_username"), alpha.alias("alph_char_in_username"),
                    case.alias("username_cap"), flag(F.col("own_image")).alias("avatar"),
                    F.col("followers").cast("bigint").alias("followers"), F.col("friends").cast("bigint").alias("friends"),
                    null_safe_ratio("friends", "followers").alias("friends_follower_ratio"),
                    flag(F.col("location").isNotNull()).alias("location"), total.cast("bigint").alias("total_tweets"), rts.cast("bigint").alias("retweets"),
                    null_safe_ratio(rts, total).alias("retweet_frac"))


def penn_post_features(pec: DataFrame, gaps: DataFrame, per_day: DataFrame) -> DataFrame:
    """U-P2: mean hashtags and urls per post plus W02 and W03."""
    m = pec.groupBy("user_id").agg(F.round(F.avg("n_hashtag"), 4).alias("mean_hashtag"),
                                   F.round(F.avg("n_url"), 4).alias("mean_url"))
    return (m.join(gaps.select("user_id", F.col("mean_gap").alias("avg_time_btw_tweets"),
                               F.col("std_gap").alias("std_time_btw_tweets")), "user_id", "left")
            .join(per_day.select("user_id", F.col("mean_per_day").alias("avg_tweets_per_day"),
                                 F.col("std_per_day").alias("std_tweets_per_day")), "user_id", "left"))


def uddin_features(users: DataFrame, rollup: DataFrame, pec: DataFrame) -> DataFrame:
    """U-U1: activity, entity totals and spreads, tweet influence
    (sum of retweet counts / retweeted posts, the intended formula),
    activeness, inclination (X24) and collective influence."""
    t = pec.groupBy("user_id").agg(
        F.sum("n_mention").alias("total_mentions"), F.sum("n_url").alias("total_urls"),
        F.sum("n_hashtag").alias("total_hashtags"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("retweet_count") > 0, F.col("retweet_count"))).cast("double"),
                                F.count(F.when(F.col("retweet_count") > 0, 1)).cast("double")), F.lit(0.0)).alias("tweet_influence"),
        F.round(F.coalesce(F.stddev_samp("n_url"), F.lit(0.0)), 4).alias("std_urls"),
        F.round(F.coalesce(F.stddev_samp("n_hashtag"), F.lit(0.0)), 4).alias("std_hashtags"))
    j = users.join(rollup, users.id == rollup.user_id, "left").drop("user_id").join(t, users.id == t.user_id, "left")
    z = F.lit(0)
    rt, ot = F.coalesce("retweet_count", z), F.coalesce("newtweet_count", z)
    fav = F.coalesce("favorited_count", z)
    return j.select(F.col("id").alias("user_id"), fav.cast("bigint").alias("favorites_count"),
                    ot.cast("bigint").alias("plain_statuses"), F.coalesce("replied_count", z).cast("bigint").alias("replies_received"),
                    F.coalesce("reply_count", z).cast("bigint").alias("replies_given"), rt.cast("bigint").alias("retweets"),
                    F.coalesce("total_mentions", z).cast("bigint").alias("total_mentions"),
                    F.coalesce("total_urls", z).cast("bigint").alias("total_urls"),
                    F.coalesce("total_hashtags", z).cast("bigint").alias("total_hashtags"),
                    F.round(F.coalesce("tweet_influence", F.lit(0.0)), 4).alias("tweet_influence"),
                    F.coalesce("std_urls", F.lit(0.0)).alias("std_urls"), F.coalesce("std_hashtags", F.lit(0.0)).alias("std_hashtags"),
                    (rt + ot + F.col("friends") + F.col("listed")).cast("bigint").alias("user_activeness"),
                    F.round(harmonic_mean(rt, ot), 4).alias("user_inclination"),
                    (F.col("followers") + fav + F.col("listed")).cast("bigint").alias("collective_influence"))


def sentiment_compound(text_col) -> F.Column:
    """Lexicon sum s of the lower-cased word tokens, then s / sqrt(s^2 + a)."""
    lex = F.create_map(*[F.lit(x) for kv in SENTIMENT_LEXICON.items() for x in kv])
    toks = F.regexp_extract_all(F.lower(text_col), F.lit(r"[a-z']+"), 0)
    s = F.aggregate(toks, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(lex, w), F.lit(0.0)))
    return s / F.sqrt(s * s + F.lit(SENTIMENT_ALPHA))


def penn_sentiment_shares(posts: DataFrame, keywords) -> DataFrame:
    """U-S1, the keyword part: (user_id, keyword, pos, neg, neu), the share of
    the user's posts of each polarity that contain the keyword (substring);
    a row for every user and keyword, 0 without a post."""
    n, hits = _keyword_shares(posts, keywords)
    every = n.select("user_id", F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
    return every.join(hits, ["user_id", "keyword"], "left").na.fill(0)


def _keyword_shares(posts: DataFrame, keywords) -> tuple[DataFrame, DataFrame]:
    """(posts per user, shares of the keywords that occur)."""
    comp = sentiment_compound(F.col("status_text"))
    pol = F.when(comp >= POLARITY_THRESHOLD, "pos").when(comp <= -POLARITY_THRESHOLD, "neg").otherwise("neu")
    p = posts.select("user_id", pol.alias("pol"), F.lower("status_text").alias("t"))
    n = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    kw = F.array(*[F.lit(k) for k in keywords])
    hits = (p.select("user_id", "pol", F.explode(F.filter(kw, lambda k: F.col("t").contains(k))).alias("keyword"))
            .groupBy("user_id", "keyword").agg(*[F.count(F.when(F.col("pol") == x, 1)).alias(x) for x in ("pos", "neg", "neu")])
            .join(n, "user_id")
            .select("user_id", "keyword", *[(F.col(x) / F.col("n")).alias(x) for x in ("pos", "neg", "neu")]))
    return n, hits


def penn_sentiment_features(posts: DataFrame, keywords) -> DataFrame:
    """U-S1 per user: over the keyword shares the mean, population std and
    non-zero count per polarity."""
    n, hits = _keyword_shares(posts, keywords)
    k = float(len(keywords))
    summ = hits.groupBy("user_id").agg(
        *[F.sum(x).alias(f"s_{x}") for x in ("pos", "neg", "neu")],
        *[F.sum(F.col(x) * F.col(x)).alias(f"q_{x}") for x in ("pos", "neg", "neu")],
        *[F.count(F.when(F.col(x) > 0, 1)).alias(f"count_{x}") for x in ("pos", "neg", "neu")])
    out = n.join(summ, "user_id", "left").na.fill(0)
    cols = [F.col("user_id")]
    for x in ("pos", "neg", "neu"):
        mean = F.col(f"s_{x}") / k
        cols += [F.round(mean, 4).alias(f"mean_{x}"),
                 F.round(F.sqrt(F.greatest(F.col(f"q_{x}") / k - mean * mean, F.lit(0.0))), 4).alias(f"std_{x}"),
                 F.col(f"count_{x}").cast("bigint").alias(f"count_{x}")]
    return out.select(*cols)


def topic_counts(posts: DataFrame, post_tags: DataFrame, communities: DataFrame) -> DataFrame:
    """(user_id, community, n): tags of a user's posts that belong to each
    community."""
    own = posts.select(F.col("id").alias("post_id"), "user_id")
    return (post_tags.join(communities.select("tag", "community"), "tag").join(own, "post_id")
            .groupBy("user_id", "community").agg(F.count(F.lit(1)).alias("n")))
