"""Queries for the per-user feature tables (U-K1 ... U-T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.functions.lexicons import POLARITY_THRESHOLD, SENTIMENT_ALPHA, SENTIMENT_LEXICON
from communitylens.functions.text import append_hashtag_words, letters_only_tokens
from communitylens.operators import features as fe
from communitylens.operators import stats
from communitylens.operators.windows import inter_post_gaps, posts_per_day
from communitylens.plans import q_windows
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import ORACLE, query
from communitylens.plans.sqlfrag import split_ws
from communitylens.sources.tables import Tables

# Fixed parameters: tracked keyword patterns of the keyword and sentiment features.
FEATURE_KEYWORDS = ("old", "cold", "gear", "anvil", "gizmo")

register("pec", """
SELECT p.*, coalesce(c.n_hashtag, 0) AS n_hashtag, coalesce(c.n_url, 0) AS n_url, coalesce(c.n_mention, 0) AS n_mention
FROM posts p LEFT JOIN (SELECT post_id, count(CASE WHEN kind = 'hashtag' THEN 1 END) AS n_hashtag,
                               count(CASE WHEN kind = 'url' THEN 1 END) AS n_url,
                               count(CASE WHEN kind = 'mention' THEN 1 END) AS n_mention
                        FROM post_entities GROUP BY post_id) c ON p.id = c.post_id""")


def _pec(t):
    return fe.post_entity_counts(t.posts, t.post_entities)


@query("kim_profile_features", f"""
SELECT u.id AS user_id, CASE WHEN f.own_image THEN '0' ELSE '1' END AS default_profile_image, CAST(coalesce(r.favorited_count, 0) AS BIGINT) AS favorite_count,
  f.favourites AS favorites_count, u.followers AS followers_count, u.friends AS friends_count, f.listed AS listed_count,
  CASE WHEN f.own_background THEN '1' ELSE '0' END AS profile_use_background_image, CAST(coalesce(r.retweet_count, 0) AS BIGINT) AS retweet_count,
  CAST(coalesce(r.newtweet_count, 0) + coalesce(r.retweet_count, 0) AS BIGINT) AS statuses_count,
  len({split_ws("coalesce(u.screen_name, '')")}) AS screen_name_words, len({split_ws("coalesce(u.user_desc, '')")}) AS desc_words
FROM users u JOIN profile_facts f ON f.id = u.id LEFT JOIN user_rollup r ON u.id = r.user_id""")
def q_uk1(spark, d):
    t = Tables(spark, d)
    return fe.kim_profile_features(t.full_users, stats.user_rollup(t.posts))


def _uk2_sql():
    cols = []
    for side, cond in (("ot", "kind <> 'retweet'"), ("rt", "kind = 'retweet'")):
        cols += [f"count(CASE WHEN {cond} THEN 1 END) AS {side}_count",
                 f"CAST(coalesce(sum(CASE WHEN {cond} THEN favorite_count END), 0) AS BIGINT) AS {side}_favorite_count"]
        for k in ("hashtag", "url", "mention"):
            v = f"CAST(CASE WHEN {cond} THEN n_{k} ELSE 0 END AS DOUBLE)"
            cols += [f"sum({v}) AS total_{k}_in_{side}", f"round(avg({v}), 4) AS mean_{k}_in_{side}",
                     f"round(median({v}), 4) AS median_{k}_in_{side}", f"max({v}) AS max_{k}_in_{side}",
                     f"min({v}) AS min_{k}_in_{side}"]
    return f"SELECT user_id, {', '.join(cols)} FROM pec GROUP BY user_id"


@query("kim_post_features", _uk2_sql())
def q_uk2(spark, d):
    return fe.kim_post_features(_pec(Tables(spark, d)))


def _entity_strings(t):
    e = t.post_entities

    def j(kind):
        return F.concat_ws(" ", F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    return e.groupBy(F.col("post_id").alias("id")).agg(j("hashtag").alias("hashtags"), j("url").alias("urls"),
                                                        j("mention").alias("mentions"))


def _uk3_sql():
    def hits(c):
        expr = f"regexp_extract_all({c}, '{FEATURE_KEYWORDS[0]}')"
        for k in FEATURE_KEYWORDS[1:]:
            expr = f"list_concat({expr}, regexp_extract_all({c}, '{k}'))"
        return expr

    fields = ("text", "hashtag", "url", "mention")
    h = " UNION ALL ".join(f"SELECT user_id, side, '{f}' AS field, unnest({hits(f)}) AS hit FROM x" for f in fields)
    names = [f"{s}_{f}" for s in ("ot", "rt") for f in fields]
    piv = ", ".join(f"coalesce(max(CASE WHEN k = '{n}' THEN total END), 0) AS {n}_total, "
                    f"coalesce(max(CASE WHEN k = '{n}' THEN uniq END), 0) AS {n}_unique" for n in names)
    return f"""
WITH e AS (SELECT post_id, string_agg(CASE WHEN kind = 'hashtag' THEN value END, ' ') AS hashtags,
                  string_agg(CASE WHEN kind = 'url' THEN value END, ' ') AS urls,
                  string_agg(CASE WHEN kind = 'mention' THEN value END, ' ') AS mentions FROM post_entities GROUP BY post_id),
x AS (SELECT p.user_id, CASE WHEN p.kind = 'retweet' THEN 'rt' ELSE 'ot' END AS side, lower(p.status_text) AS text,
             lower(coalesce(e.hashtags, '')) AS hashtag, lower(coalesce(e.urls, '')) AS url, lower(coalesce(e.mentions, '')) AS mention
      FROM posts p LEFT JOIN e ON e.post_id = p.id),
h AS ({h}),
g AS (SELECT user_id, side || '_' || field AS k, count(*) AS total, count(DISTINCT hit) AS uniq FROM h GROUP BY user_id, side, field)
SELECT u.user_id, {piv} FROM (SELECT DISTINCT user_id FROM posts) u LEFT JOIN g ON u.user_id = g.user_id GROUP BY u.user_id"""


@query("kim_keyword_features", _uk3_sql())
def q_uk3(spark, d):
    t = Tables(spark, d)
    return fe.kim_keyword_features(_pec(t), _entity_strings(t), FEATURE_KEYWORDS)


@query("post_cosine", """
WITH p AS (SELECT id, user_id, CASE WHEN kind = 'retweet' THEN 'rt' ELSE 'ot' END AS side,
                  regexp_extract_all(lower(status_text), '\\b\\w\\w+\\b') AS w FROM posts),
c AS (SELECT id, user_id, side, word, CAST(count(*) AS DOUBLE) AS c
      FROM (SELECT id, user_id, side, unnest(w) AS word FROM p) x GROUP BY id, user_id, side, word),
nrm AS (SELECT id, sqrt(sum(c * c)) AS norm FROM c GROUP BY id),
pp AS (SELECT a.user_id, a.side, a.id AS i, b.id AS j FROM p a JOIN p b ON a.user_id = b.user_id AND a.side = b.side AND a.id < b.id),
dot AS (SELECT ca.id AS i, cb.id AS j, sum(ca.c * cb.c) AS d FROM c ca JOIN c cb
        ON ca.user_id = cb.user_id AND ca.side = cb.side AND ca.word = cb.word AND ca.id < cb.id GROUP BY ca.id, cb.id),
cs AS (SELECT pp.user_id, pp.side, coalesce(dot.d / (na.norm * nb.norm), 0.0) AS cs FROM pp
       LEFT JOIN dot ON pp.i = dot.i AND pp.j = dot.j LEFT JOIN nrm na ON na.id = pp.i LEFT JOIN nrm nb ON nb.id = pp.j),
n AS (SELECT user_id, side, count(*) AS n FROM p GROUP BY user_id, side),
s AS (SELECT n.user_id, n.side, round(coalesce(sum(cs.cs), 0) / n.n, 4) AS cos_mean,
             CASE WHEN count(cs.cs) > 0 THEN round(stddev_pop(cs.cs), 4) END AS cos_std, n.n
      FROM n LEFT JOIN cs ON n.user_id = cs.user_id AND n.side = cs.side GROUP BY n.user_id, n.side, n.n)
SELECT user_id,
  coalesce(max(CASE WHEN side = 'ot' THEN cos_mean END), 0.0) AS ot_cos_mean,
  CASE WHEN max(CASE WHEN side = 'ot' THEN n END) IS NULL THEN 0.0 ELSE max(CASE WHEN side = 'ot' THEN cos_std END) END AS ot_cos_std,
  coalesce(max(CASE WHEN side = 'rt' THEN cos_mean END), 0.0) AS rt_cos_mean,
  CASE WHEN max(CASE WHEN side = 'rt' THEN n END) IS NULL THEN 0.0 ELSE max(CASE WHEN side = 'rt' THEN cos_std END) END AS rt_cos_std
FROM s GROUP BY user_id""")
def q_uk4(spark, d):
    out = fe.post_cosine(_pec(Tables(spark, d)))
    return out.select("user_id",
                      F.coalesce("ot_cos_mean", F.lit(0.0)).alias("ot_cos_mean"),
                      F.when(F.col("ot_cos_mean").isNull(), F.lit(0.0)).otherwise(F.col("ot_cos_std")).alias("ot_cos_std"),
                      F.coalesce("rt_cos_mean", F.lit(0.0)).alias("rt_cos_mean"),
                      F.when(F.col("rt_cos_mean").isNull(), F.lit(0.0)).otherwise(F.col("rt_cos_std")).alias("rt_cos_std"))


@query("penn_profile_features", """
WITH x AS (SELECT u.id, u.screen_name AS name, u.followers, u.friends, coalesce(r.newtweet_count, 0) + coalesce(r.retweet_count, 0) AS total,
                  coalesce(r.retweet_count, 0) AS rts, f.own_image, f.location FROM users u JOIN profile_facts f ON f.id = u.id LEFT JOIN user_rollup r ON u.id = r.user_id)
SELECT id AS user_id, length(name) AS user_name_length, length(regexp_replace(name, '[^\\p{Nd}]', '', 'g')) AS num_char_in_username,
  length(regexp_replace(name, '[^\\p{L}]', '', 'g')) AS alph_char_in_username,
  CASE WHEN length(regexp_replace(name, '[^\\p{Lu}]', '', 'g')) = length(regexp_replace(name, '[^\\p{L}]', '', 'g')) THEN '1'
       WHEN length(regexp_replace(name, '[^\\p{Lu}]', '', 'g')) = 0 THEN '2' ELSE '3' END AS username_cap,
  CASE WHEN own_image THEN '1' ELSE '0' END AS avatar, followers, friends, coalesce(CAST(friends AS DOUBLE) / nullif(followers, 0), 0.0) AS friends_follower_ratio,
  CASE WHEN location IS NULL THEN '0' ELSE '1' END AS location, CAST(total AS BIGINT) AS total_tweets, CAST(rts AS BIGINT) AS retweets,
  coalesce(CAST(rts AS DOUBLE) / nullif(total, 0), 0.0) AS retweet_frac FROM x""")
def q_up1(spark, d):
    t = Tables(spark, d)
    return fe.penn_profile_features(t.full_users, stats.user_rollup(t.posts))


@query("penn_post_features", f"""
WITH g AS ({ORACLE['inter_post_gaps']}), pd AS ({ORACLE['posts_per_day']}),
m AS (SELECT user_id, round(avg(n_hashtag), 4) AS mean_hashtag, round(avg(n_url), 4) AS mean_url FROM pec GROUP BY user_id)
SELECT m.user_id, m.mean_hashtag, m.mean_url, g.mean_gap AS avg_time_btw_tweets, g.std_gap AS std_time_btw_tweets,
       pd.mean_per_day AS avg_tweets_per_day, pd.std_per_day AS std_tweets_per_day
FROM m LEFT JOIN g ON m.user_id = g.user_id LEFT JOIN pd ON m.user_id = pd.user_id""")
def q_up2(spark, d):
    t = Tables(spark, d)
    return fe.penn_post_features(_pec(t), inter_post_gaps(t.posts), posts_per_day(t.posts))


@query("uddin_features", """
WITH t AS (SELECT user_id, sum(n_mention) AS total_mentions, sum(n_url) AS total_urls, sum(n_hashtag) AS total_hashtags,
             coalesce(CAST(sum(CASE WHEN retweet_count > 0 THEN retweet_count END) AS DOUBLE) / nullif(count(CASE WHEN retweet_count > 0 THEN 1 END), 0), 0.0) AS tweet_influence,
             round(coalesce(stddev_samp(n_url), 0), 4) AS std_urls, round(coalesce(stddev_samp(n_hashtag), 0), 4) AS std_hashtags
           FROM pec GROUP BY user_id)
SELECT u.id AS user_id, CAST(coalesce(r.favorited_count, 0) AS BIGINT) AS favorites_count,
  CAST(coalesce(r.newtweet_count, 0) AS BIGINT) AS plain_statuses, CAST(coalesce(r.replied_count, 0) AS BIGINT) AS replies_received,
  CAST(coalesce(r.reply_count, 0) AS BIGINT) AS replies_given, CAST(coalesce(r.retweet_count, 0) AS BIGINT) AS retweets,
  CAST(coalesce(t.total_mentions, 0) AS BIGINT) AS total_mentions, CAST(coalesce(t.total_urls, 0) AS BIGINT) AS total_urls,
  CAST(coalesce(t.total_hashtags, 0) AS BIGINT) AS total_hashtags, round(coalesce(t.tweet_influence, 0.0), 4) AS tweet_influence,
  coalesce(t.std_urls, 0.0) AS std_urls, coalesce(t.std_hashtags, 0.0) AS std_hashtags,
  CAST(coalesce(r.retweet_count, 0) + coalesce(r.newtweet_count, 0) + u.friends + f.listed AS BIGINT) AS user_activeness,
  round(coalesce(2.0 * coalesce(r.retweet_count, 0) * coalesce(r.newtweet_count, 0) / nullif(coalesce(r.retweet_count, 0) + coalesce(r.newtweet_count, 0), 0), 0.0), 4) AS user_inclination,
  CAST(u.followers + coalesce(r.favorited_count, 0) + f.listed AS BIGINT) AS collective_influence
FROM users u JOIN profile_facts f ON f.id = u.id LEFT JOIN user_rollup r ON u.id = r.user_id LEFT JOIN t ON u.id = t.user_id""")
def q_uu1(spark, d):
    t = Tables(spark, d)
    return fe.uddin_features(t.full_users, stats.user_rollup(t.posts), _pec(t))


def _us1_sql(final=None):
    val = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SENTIMENT_LEXICON.items()) + " ELSE 0.0 END"
    kw = ", ".join(f"'{k}'" for k in FEATURE_KEYWORDS)
    k = float(len(FEATURE_KEYWORDS))
    cols = []
    for x in ("pos", "neg", "neu"):
        cols += [f"round(coalesce(s_{x}, 0) / {k}, 4) AS mean_{x}",
                 f"round(sqrt(greatest(coalesce(q_{x}, 0) / {k} - (coalesce(s_{x}, 0) / {k}) * (coalesce(s_{x}, 0) / {k}), 0.0)), 4) AS std_{x}",
                 f"CAST(coalesce(count_{x}, 0) AS BIGINT) AS count_{x}"]
    return f"""
WITH s AS (SELECT user_id, lower(status_text) AS t,
             coalesce(list_sum(list_transform(regexp_extract_all(lower(status_text), '[a-z'']+'), lambda w: {val})), 0.0) AS sc FROM posts),
p AS (SELECT user_id, t, CASE WHEN sc / sqrt(sc * sc + {SENTIMENT_ALPHA}) >= {POLARITY_THRESHOLD} THEN 'pos'
                             WHEN sc / sqrt(sc * sc + {SENTIMENT_ALPHA}) <= -{POLARITY_THRESHOLD} THEN 'neg' ELSE 'neu' END AS pol FROM s),
n AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id),
h AS (SELECT p.user_id, k.keyword, count(CASE WHEN pol = 'pos' THEN 1 END) AS pos, count(CASE WHEN pol = 'neg' THEN 1 END) AS neg,
             count(CASE WHEN pol = 'neu' THEN 1 END) AS neu
      FROM p JOIN (SELECT unnest([{kw}]) AS keyword) k ON contains(p.t, k.keyword) GROUP BY p.user_id, k.keyword),
r AS (SELECT h.user_id, h.pos / n.n AS pos, h.neg / n.n AS neg, h.neu / n.n AS neu FROM h JOIN n ON h.user_id = n.user_id),
a AS (SELECT user_id, sum(pos) AS s_pos, sum(neg) AS s_neg, sum(neu) AS s_neu, sum(pos * pos) AS q_pos, sum(neg * neg) AS q_neg,
             sum(neu * neu) AS q_neu, count(CASE WHEN pos > 0 THEN 1 END) AS count_pos, count(CASE WHEN neg > 0 THEN 1 END) AS count_neg,
             count(CASE WHEN neu > 0 THEN 1 END) AS count_neu FROM r GROUP BY user_id)
{{final}}""".replace("{final}", final or f"SELECT n.user_id, {', '.join(cols)} FROM n LEFT JOIN a ON n.user_id = a.user_id")


# the lexicon is a table: here the words of the part names, their roles and values by md5
register("word_lexicon", """
SELECT word, CASE WHEN h < 8 THEN 'valence' WHEN h < 12 THEN 'booster' ELSE 'negation' END AS role,
       CASE WHEN h < 8 THEN (h - 3.5) / 2 WHEN h < 10 THEN 1.0 WHEN h < 12 THEN -1.0 ELSE 0.0 END::DOUBLE AS value
FROM (SELECT word, ('0x' || substr(md5(word), 1, 1))::INT AS h FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) w) x""")


def word_lexicon(t):
    h = F.conv(F.substring(F.md5("word"), 1, 1), 16, 10).cast("int")
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().select("word", h.alias("h"))
    return words.select("word", F.when(F.col("h") < 8, "valence").when(F.col("h") < 12, "booster").otherwise("negation").alias("role"),
                        F.when(F.col("h") < 8, (F.col("h") - 3.5) / 2).when(F.col("h") < 10, 1.0).when(F.col("h") < 12, -1.0)
                        .otherwise(0.0).cast("double").alias("value"))


@query("text_polarity", """
WITH w AS (SELECT id, unnest(list_transform(regexp_extract_all(status_text, '[\\p{L}'']+'), lambda x, i: struct_pack(i := i, w := x))) AS t FROM posts),
r AS (SELECT id, t.i AS i, upper(t.w) = t.w AND lower(t.w) <> t.w AND length(t.w) > 1 AS caps, l.role, l.value
      FROM w LEFT JOIN word_lexicon l ON l.word = lower(t.w)),
c AS (SELECT id, max(caps::INT) = 1 AND min(caps::INT) = 0 AS mixed FROM r GROUP BY id),
v AS (SELECT a.id, a.i, a.value + sign(a.value) * ((CASE WHEN a.caps AND c.mixed THEN 0.733 ELSE 0 END)
        + coalesce(sum(CASE WHEN b.role = 'booster' THEN b.value * 0.293 * (CASE a.i - b.i WHEN 1 THEN 1 WHEN 2 THEN 0.95 ELSE 0.9 END) END), 0)) AS v,
        coalesce(bool_or(b.role = 'negation'), FALSE) AS neg
      FROM r a JOIN c ON c.id = a.id LEFT JOIN r b ON b.id = a.id AND b.i BETWEEN a.i - 3 AND a.i - 1
      WHERE a.role = 'valence' GROUP BY a.id, a.i, a.value, a.caps, c.mixed),
s AS (SELECT id, sum(round((CASE WHEN neg THEN v * -0.74 ELSE v END) * 1e7)::BIGINT) / 1e7 AS s FROM v GROUP BY id)
SELECT p.id, round(coalesce(s, 0.0), 7) AS valence, round(coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + 15.0), 6) AS compound
FROM posts p LEFT JOIN s ON s.id = p.id""")
def q_us1_ordered(spark, d):
    """U-S1's polarity in the order of words, by a lexicon table."""
    from communitylens.operators.polarity import text_polarity
    t = Tables(spark, d)
    return text_polarity(t.posts, word_lexicon(t), "id", "status_text")


@query("penn_sentiment_features", _us1_sql())
def q_us1(spark, d):
    return fe.penn_sentiment_features(Tables(spark, d).posts, FEATURE_KEYWORDS)


@query("topic_stats", """
WITH x AS (SELECT post_id, text, regexp_matches(text, '#[\\w\\-]+') AS has_tag,
                  concat_ws(' ', text, array_to_string(list_transform(regexp_extract_all(text, '#[\\w\\-]+'), lambda h: substr(h, 2)), ' ')) AS full_text
           FROM hashtag_texts),
m AS (SELECT x.post_id, count(DISTINCT w.community) AS n FROM (
        SELECT post_id, unnest(list_filter(string_split(regexp_replace(lower(full_text), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '')) AS word
        FROM x WHERE has_tag) x JOIN word_dictionary w ON x.word = w.word GROUP BY x.post_id)
SELECT x.post_id, coalesce(m.n, 0) > 0 AS has_match, coalesce(m.n, 0) AS n_communities FROM x LEFT JOIN m ON x.post_id = m.post_id""")
def q_ut1(spark, d):
    from communitylens.plans.q_joins import word_dictionary
    from communitylens.plans.q_scalar import hashtag_texts
    t = Tables(spark, d)
    from communitylens.operators.textfeat import community_word_match
    return community_word_match(hashtag_texts(t), "post_id", "text", word_dictionary(t.part))


@query("penn_sentiment_shares", _us1_sql(f"""
SELECT n.user_id, k.keyword, coalesce(r.pos, 0.0) AS pos, coalesce(r.neg, 0.0) AS neg, coalesce(r.neu, 0.0) AS neu
FROM n CROSS JOIN (SELECT unnest([{', '.join(repr(k) for k in FEATURE_KEYWORDS)}]) AS keyword) k
LEFT JOIN (SELECT h.user_id, h.keyword, h.pos / n.n AS pos, h.neg / n.n AS neg, h.neu / n.n AS neu FROM h JOIN n ON h.user_id = n.user_id) r
  ON r.user_id = n.user_id AND r.keyword = k.keyword"""))
def q_us1_shares(spark, d):
    return fe.penn_sentiment_shares(Tables(spark, d).posts, FEATURE_KEYWORDS)
