"""Queries for model data work (M01-M15) and the ML-backed text rows
(T13 LDA topics, T14 word clusters).  Evaluation tables have SQL oracles;
model training and scoring are rows-only checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from communitylens.operators import edges as eg
from communitylens.operators import features as fe
from communitylens.operators import model as md
from communitylens.operators import stats
from communitylens.operators import textfeat as tf
from communitylens.plans import q_features, q_text
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import ORACLE, query
from communitylens.session import scratch_path
from communitylens.sources.dictionaries import organise_tags
from communitylens.sources.tables import Tables

BEHAVIOUR = ("total_hashtags", "user_activeness", "collective_influence")
# Fixed label codes of the annotation lookup (M13), in code order.
LABEL_CODES = ("advocate", "hpi", "hpo", "patient", "quality", "research", "toxic")


def _uddin(t):
    posts = t.kept_posts
    return fe.uddin_features(t.full_users, stats.user_rollup(posts), fe.post_entity_counts(posts))


def _auto_match(t):
    return tf.dictionary_match(q_text._doc_tokens(t), tf.class_word_goodness(q_text._pass1(t)))


# ---- M01 / M02 / M03 / M04 ---------------------------------------------------------------
# The named feature sets and the blocks that each is made of.
FEATURE_SETS = {
    "text": ("text",), "text_and_name": ("text", "name"), "behaviour": ("behaviour",), "numeric": ("behaviour", "topical"),
    "manual_dict": ("manual",), "autodict": ("auto",), "behaviour_and_autodict": ("behaviour", "auto"),
    "text_and_autodict": ("text", "auto"), "basic_and_user_url": ("behaviour", "url"),
    "text_and_behaviour": ("text", "behaviour"), "text_and_manualdict": ("text", "manual"),
    "text_and_autodict_and_behaviour": ("text", "auto", "behaviour"),
}
# What a dictionary match says of a user.
MATCH_VALUES = ("score_sum", "match_count", "max_score", "any_match")
_SETS_SQL = ", ".join(f"('{s}', '{b}')" for s, bs in FEATURE_SETS.items() for b in bs)


def _unpivot_sql(src: str, key: str, block: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{block}' AS block, {key} AS user_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}"
                              for c in cols)


def feature_blocks(spark, t, whole: bool = True):
    """(block, user_id, feature, value): every block of the named sets as
    long rows; a feature that is not there is 0.  Behaviour is all counters of
    the user table and three of their sums, a dictionary gives all four values
    of a match.  Without ``whole``: the sums alone and one value a match, the
    columns of the sets' vectors."""
    def wide(df, block, cols):
        return df.select(F.lit(block).alias("block"), "user_id", F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("f")).select(
            "block", "user_id", "f.*")

    def long(df, block, user, feature, value):
        return df.select(F.lit(block).alias("block"), F.col(user).alias("user_id"), F.col(feature).cast("string").alias("feature"),
                         F.col(value).cast("double").alias("value"))

    def terms(col):
        words = tf.token_rows(t.users, [F.col("id").alias("user")], F.col(col), "word", min_len=2)
        return words.groupBy("user", "word").agg(F.count(F.lit(1)).alias("n"))
    def match(df, block, named):
        # the value that goes by the dictionary's name, then the others
        values = (named, *[v for v in MATCH_VALUES if v != named]) if whole else (named,)
        return df.select(F.lit(block).alias("block"), F.col("user").alias("user_id"), F.explode(F.array(*[
            F.struct((F.col("dict") if v == named else F.concat("dict", F.lit(f"_{v}"))).alias("feature"), F.col(v).cast("double").alias("value"))
            for v in values])).alias("f")).select("block", "user_id", "f.*")

    url = md.has_url_feature(t.users, t.pages.select(F.col("page_id").alias("id"), "url"))
    topical = fe.topic_counts(t.kept_posts, t.post_tags, t.communities)
    blocks = (wide(_uddin(t), "behaviour", BEHAVIOUR)
              .unionByName(long(topical, "topical", "user_id", "community", "n"))
              .unionByName(match(_auto_match(t), "auto", "score_sum"))
              .unionByName(match(tf.dictionary_match(q_text._doc_tokens(t), q_text.manual_dictionary(spark)), "manual", "match_count"))
              .unionByName(wide(url, "url", ["has_url"]))
              .unionByName(long(terms("user_desc"), "text", "user", "word", "n"))
              .unionByName(long(terms("screen_name"), "name", "user", "word", "n")))
    if not whole:
        return blocks
    counters = eg.user_counters(t.full_users, stats.user_rollup(t.kept_posts), stats.user_entity_sets(t.kept_posts))
    return blocks.unionByName(wide(counters, "behaviour", eg.USER_COUNTERS))


def set_members(sets=FEATURE_SETS):
    """Column: the names of the sets that a row's block belongs to."""
    by_block = {}
    for name, parts in sets.items():
        for b in parts:
            by_block.setdefault(b, []).append(name)
    return F.create_map(*[x for b, ns in by_block.items() for x in (F.lit(b), F.lit(" ".join(sorted(ns))))])[F.col("block")]


def feature_set(blocks, name: str, sets=FEATURE_SETS):
    """One set by its name, (user_id, block, feature, value)."""
    return blocks.filter(F.col("block").isin(*sets[name])).select("user_id", "block", "feature", "value")


_BLOCKS_SQL = f"""
WITH ud AS ({ORACLE['uddin_features']}), dm AS ({ORACLE['dictionary_match']}), mm AS ({ORACLE['manual_dictionary_match']}),
hu AS (SELECT u.id AS user_id, CAST(p.url IS NOT NULL AS INTEGER) AS has_url FROM users u LEFT JOIN pages p ON u.id = p.page_id),
tc AS (SELECT p.user_id, c.community, count(*) AS n FROM posts p JOIN post_tags pt ON pt.post_id = p.id
       JOIN communities c ON c.tag = pt.tag GROUP BY p.user_id, c.community),
tx AS (SELECT id AS user_id, unnest({q_text._tok_sql("coalesce(user_desc, '')", True, 2)}) AS word FROM users),
nm AS (SELECT id AS user_id, unnest({q_text._tok_sql("coalesce(screen_name, '')", True, 2)}) AS word FROM users),
blocks AS ({_unpivot_sql('ud', 'user_id', 'behaviour', BEHAVIOUR)}
  UNION ALL SELECT 'topical', user_id, community, n FROM tc
  UNION ALL SELECT 'auto', "user", dict, score_sum FROM dm
  UNION ALL SELECT 'manual', "user", dict, match_count FROM mm
  UNION ALL SELECT 'url', user_id, 'has_url', has_url FROM hu
  UNION ALL SELECT 'text', user_id, word, count(*) FROM tx GROUP BY user_id, word
  UNION ALL SELECT 'name', user_id, word, count(*) FROM nm GROUP BY user_id, word)
"""

# The counters of the user table, of users without a screen name too.
_COUNTERS_SQL = """
SELECT u.id AS user_id, coalesce(r.newtweet_count, 0) + coalesce(r.retweet_count, 0) AS user_statuses_count,
  coalesce(u.friends, 0) AS user_friends_count, f.favourites AS user_favorites_count, coalesce(r.retweeted_count, 0) AS user_retweeted_count,
  coalesce(r.retweet_count, 0) AS user_retweet_count, coalesce(u.followers, 0) AS user_followers_count, f.listed AS user_listed_count,
  coalesce(r.newtweet_count, 0) AS user_newtweet_count, coalesce(r.favorited_count, 0) AS user_favorited_count,
  coalesce(s.n_hashtag, 0) AS user_entities_hashtag, coalesce(s.n_url, 0) AS user_entities_url,
  coalesce(s.n_mention, 0) AS user_entities_user_mention, coalesce(s.n_media, 0) AS user_entities_media_url
FROM users u JOIN profile_facts f ON f.id = u.id LEFT JOIN user_rollup r ON u.id = r.user_id LEFT JOIN (
  SELECT user_id, count(CASE WHEN kind = 'hashtag' THEN 1 END) AS n_hashtag, count(CASE WHEN kind = 'url' THEN 1 END) AS n_url,
         count(CASE WHEN kind = 'mention' THEN 1 END) AS n_mention, count(CASE WHEN kind = 'media' THEN 1 END) AS n_media
  FROM (SELECT DISTINCT p.user_id, e.kind, e.value FROM posts p JOIN post_entities e ON p.id = e.post_id) x GROUP BY user_id) s ON u.id = s.user_id"""


def _other_values_sql(src: str, block: str, named: str) -> str:
    return " UNION ALL ".join(f"SELECT '{block}', \"user\", dict || '_{v}', CAST({v} AS DOUBLE) FROM {src}" for v in MATCH_VALUES if v != named)


@query("feature_sets", f"""{_BLOCKS_SQL.rstrip()},
uc AS ({_COUNTERS_SQL}),
whole AS (SELECT * FROM blocks UNION ALL {_unpivot_sql('uc', 'user_id', 'behaviour', eg.USER_COUNTERS)}
  UNION ALL {_other_values_sql('dm', 'auto', 'score_sum')}
  UNION ALL {_other_values_sql('mm', 'manual', 'match_count')})
SELECT b.user_id, b.block, b.feature, b.value, v.sets FROM whole b JOIN (
  SELECT block, string_agg(set_name, ' ' ORDER BY set_name) AS sets FROM (VALUES {_SETS_SQL}) x(set_name, block) GROUP BY block) v
  ON v.block = b.block""")
def q_m01(spark, d):
    blocks = feature_blocks(spark, Tables(spark, d))
    return blocks.select("user_id", "block", "feature", "value", set_members().alias("sets"))


SPARSE_SET = "text_and_behaviour"
_SET_BLOCKS = ", ".join(f"'{b}'" for b in FEATURE_SETS[SPARSE_SET])


def set_vectors(spark, blocks, users, name):
    """One named set as sparse vectors of all users: (user_id, features), the
    saved column index, and the vectors' folder."""
    from communitylens.operators import sparse as sp
    base = scratch_path(spark, f"vectors-{uuid.uuid4().hex[:12]}")
    # read twice: the set's own blocks are kept, as Parquet, where a word is a number of a column's dictionary
    rows = feature_set(blocks, name)
    rows.write.parquet(f"{base}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    sp.save_index(sp.column_index(rows), f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    vectors = sp.sparse_vectors(rows, index, users, "user_id", f"{base}/vectors")
    return vectors, index, f"{base}/vectors"


@query("feature_set_vectors", _BLOCKS_SQL + f"""
, w AS (SELECT user_id, block, feature, sum(value) AS value FROM blocks WHERE block IN ({_SET_BLOCKS}) GROUP BY ALL),
ix AS (SELECT block, feature, row_number() OVER (ORDER BY block, feature) - 1 AS index FROM (
  SELECT DISTINCT block, feature FROM blocks WHERE block IN ({_SET_BLOCKS})) z)
SELECT user_id, index::INTEGER AS index, round(value, 6) AS value FROM w JOIN ix USING (block, feature) WHERE value <> 0""")
def q_m01_vectors(spark, d):
    """A named set as sparse vectors, shown as what they hold."""
    from communitylens.operators.sparse import stored_columns
    t = Tables(spark, d)
    vectors, _, path = set_vectors(spark, feature_blocks(spark, t, whole=False), t.users.select(F.col("id").alias("user_id")), SPARSE_SET)
    return stored_columns(vectors, "user_id", path).select("user_id", "index", F.round("value", 6).alias("value"))


@query("cross_validate_set")
def q_m07_set(spark, d, name=SPARSE_SET):
    """M07 by set name: out-of-fold predictions on the named set's vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    t = Tables(spark, d)
    labels = t.users.where("label IS NOT NULL").select(F.col("id").alias("user_id"), "label")
    labels = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc").fit(labels).transform(labels)
    vectors, _, _ = set_vectors(spark, feature_blocks(spark, t, whole=False), labels.select("user_id"), name)
    out = md.out_of_fold(labels.join(vectors, "user_id"), {name: LogisticRegression(labelCol="label_idx", maxIter=100)}, "user_id", "label_idx", at_once=4)
    return out.withColumnRenamed("model", "set")


@query("has_url_feature", "SELECT u.id AS user_id, CAST(p.url IS NOT NULL AS INTEGER) AS has_url FROM users u LEFT JOIN pages p ON u.id = p.page_id")
def q_m02(spark, d):
    t = Tables(spark, d)
    return md.has_url_feature(t.users, t.pages.select(F.col("page_id").alias("id"), "url"))


@query("standardise", f"""
WITH ud AS ({ORACLE['uddin_features']}),
s AS (SELECT {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max' for c in BEHAVIOUR)} FROM ud)
SELECT ud.user_id, {', '.join(f'round(coalesce(({c} - {c}_mean) / nullif({c}_std, 0), 0.0), 6) AS z_{c}, round(coalesce(({c} - {c}_min) / nullif(CAST({c}_max - {c}_min AS DOUBLE), 0), 0.0), 6) AS mm_{c}' for c in BEHAVIOUR)}
FROM ud, s""")
def q_m03(spark, d):
    return md.standardise(_uddin(Tables(spark, d)), list(BEHAVIOUR), "user_id")


@query("validate_features", f"""
WITH pc AS ({ORACLE['post_cosine']})
SELECT user_id, (CASE WHEN ot_cos_std IS NULL OR isnan(ot_cos_std) THEN 1 ELSE 0 END)
              + (CASE WHEN rt_cos_std IS NULL OR isnan(rt_cos_std) THEN 1 ELSE 0 END) AS n_bad FROM pc
WHERE ot_cos_std IS NULL OR rt_cos_std IS NULL OR isnan(ot_cos_std) OR isnan(rt_cos_std)""")
def q_m04(spark, d):
    pc = q_features.q_uk4(spark, d)
    return md.validate_features(pc, "user_id", ["ot_cos_std", "rt_cos_std"])


# ---- M10-M14: a deterministic dictionary classifier ---------------------------------------
def _rule_predictions(spark, d, dictionary="auto"):
    """(doc_id, truth = language, prediction = the dictionary with the
    largest score sum, ties by name, 'none' without any match)."""
    t = Tables(spark, d)
    if dictionary == "auto":
        m, score = _auto_match(t), "score_sum"
    else:
        m, score = tf.dictionary_match(q_text._doc_tokens(t), q_text.manual_dictionary(spark)), "match_count"
    best = m.filter(F.col(score) > 0).groupBy(F.col("user").alias("doc_id")).agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col("dict"))).alias("b"))
    return (t.documents.select("doc_id", F.col("lang").alias("truth"))
            .join(best.select("doc_id", F.col("b.dict").alias("prediction")), "doc_id", "left")
            .select("doc_id", "truth", F.coalesce("prediction", F.lit("none")).alias("prediction")))


def _pred_sql(match_sql: str, score: str) -> str:
    return f"""
SELECT d.doc_id, d.lang AS truth, coalesce(b.dict, 'none') AS prediction FROM documents d LEFT JOIN (
  SELECT "user", dict FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY {score} DESC, dict) AS rn
                            FROM ({match_sql}) m WHERE {score} > 0) r WHERE rn = 1) b ON b."user" = d.doc_id"""


def _auto_pred_sql():
    return _pred_sql(ORACLE["dictionary_match"], "score_sum")


def _manual_pred_sql():
    return _pred_sql(ORACLE["manual_dictionary_match"], "match_count")


def _scores_sql(pred: str) -> str:
    return f"""
WITH pr AS ({pred}),
cl AS (SELECT truth AS c FROM pr UNION SELECT prediction FROM pr),
per AS (SELECT cl.c, coalesce(tp.tp, 0) AS tp, coalesce(sp.support, 0) AS support, coalesce(np.npred, 0) AS npred FROM cl
        LEFT JOIN (SELECT truth AS c, count(*) AS tp FROM pr WHERE truth = prediction GROUP BY truth) tp ON cl.c = tp.c
        LEFT JOIN (SELECT truth AS c, count(*) AS support FROM pr GROUP BY truth) sp ON cl.c = sp.c
        LEFT JOIN (SELECT prediction AS c, count(*) AS npred FROM pr GROUP BY prediction) np ON cl.c = np.c),
pr2 AS (SELECT c, coalesce(CAST(tp AS DOUBLE) / nullif(npred, 0), 0.0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS r,
               support FROM per),
pf AS (SELECT c, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f, support FROM pr2),
tot AS (SELECT count(*) AS n, count(CASE WHEN truth = prediction THEN 1 END) AS tp FROM pr)
SELECT c AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'micro avg', round(CAST(tp AS DOUBLE) / n, 6), round(CAST(tp AS DOUBLE) / n, 6), round(CAST(tp AS DOUBLE) / n, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'accuracy', round(CAST(tp AS DOUBLE) / n, 6), round(CAST(tp AS DOUBLE) / n, 6), round(CAST(tp AS DOUBLE) / n, 6), CAST(n AS BIGINT) FROM tot"""


def _register_eval():
    from communitylens.plans.registry import QUERIES

    def q_m10(spark, d):
        return md.class_scores(_rule_predictions(spark, d))

    def q_m11(spark, d):
        return md.confusion_matrix(_rule_predictions(spark, d))

    def q_m12(spark, d):
        return md.prediction_audit(_rule_predictions(spark, d), "doc_id")

    def both(spark, d):
        a = md.class_scores(_rule_predictions(spark, d, "auto")).withColumn("setting", F.lit("auto"))
        m = md.class_scores(_rule_predictions(spark, d, "manual")).withColumn("setting", F.lit("manual"))
        return md.experiment_pivot(a.unionByName(m))

    def q_m14(spark, d):
        return both(spark, d)

    def q_m14_absolute(spark, d):
        """The manual results again, from the auto ones and printed deltas."""
        pivot = both(spark, d).checkpoint()
        auto, manual = (pivot.filter(F.col("setting") == s).drop("setting") for s in ("auto", "manual"))
        return md.absolute_results(auto, md.format_deltas(auto, manual, ["class"]), ["class"])

    QUERIES["class_scores"] = q_m10
    ORACLE["class_scores"] = _scores_sql(_auto_pred_sql())
    QUERIES["confusion_matrix"] = q_m11
    ORACLE["confusion_matrix"] = (f"WITH pr AS ({_auto_pred_sql()}) SELECT truth, prediction, count(*) AS n FROM pr "
                                  "GROUP BY truth, prediction")
    QUERIES["prediction_audit"] = q_m12
    ORACLE["prediction_audit"] = (f"WITH pr AS ({_auto_pred_sql()}) SELECT doc_id, prediction, truth, "
                                  "CASE WHEN prediction = truth THEN 'ok' ELSE 'wrong' END AS result FROM pr")
    QUERIES["experiment_pivot"] = q_m14
    means = "('macro avg', 'weighted avg', 'micro avg', 'accuracy')"
    pivot = lambda setting, pred: (f"SELECT '{setting}' AS setting, name AS class, precision AS p, recall AS r, f1 "  # noqa: E731
                                   f"FROM ({_scores_sql(pred)}) {setting} WHERE name NOT IN {means}")
    ORACLE["experiment_pivot"] = f"{pivot('auto', _auto_pred_sql())} UNION ALL {pivot('manual', _manual_pred_sql())}"
    QUERIES["experiment_absolute"] = q_m14_absolute
    ORACLE["experiment_absolute"] = (f"WITH a AS ({pivot('auto', _auto_pred_sql())}), m AS ({pivot('manual', _manual_pred_sql())}) "
                                     + " UNION ALL ".join(f"SELECT m.class, '{x}' AS metric, round(m.{x}, 2) AS value FROM m JOIN a ON a.class = m.class"
                                                          for x in ("p", "r", "f1")))


_register_eval()


# ---- M13 -------------------------------------------------------------------------------------
def _code(col):
    codes = F.create_map(*[F.lit(x) for i, lab in enumerate(LABEL_CODES) for x in (lab, i)])
    return F.try_element_at(codes, col)


@query("annotator_agreement", f"""
WITH codes AS (SELECT * FROM (VALUES {', '.join(f"('{lab}', {i})" for i, lab in enumerate(LABEL_CODES))}) v(name, code)),
a AS (SELECT u.id, list_filter([(SELECT code FROM codes WHERE name = u.label),
                                CASE WHEN l.toxic = 1 THEN 6 END], lambda x: x IS NOT NULL) AS l1,
             list_filter([(SELECT code FROM codes WHERE name = CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'research' ELSE u.label END),
                          CASE WHEN l.quality = 1 THEN 4 END], lambda x: x IS NOT NULL) AS l2
      FROM users u JOIN labels l ON u.id = l.doc_id JOIN customer c ON c.c_custkey = u.id),
r AS (SELECT id,
        CASE WHEN (len(l1) > 1 OR len(l2) > 1) AND len(list_intersect(l1, l2)) > 0 THEN list_max(list_intersect(l1, l2)) ELSE list_max(l1) END AS a1,
        CASE WHEN (len(l1) > 1 OR len(l2) > 1) AND len(list_intersect(l1, l2)) > 0 THEN list_max(list_intersect(l1, l2)) ELSE list_max(l2) END AS a2
      FROM a WHERE len(l1) > 0 AND len(l2) > 0),
n AS (SELECT count(*) AS n, CAST(count(CASE WHEN a1 = a2 THEN 1 END) AS DOUBLE) / count(*) AS po FROM r),
pe AS (SELECT CAST(sum(n1 * n2) AS DOUBLE) / ((SELECT n FROM n) * (SELECT n FROM n)) AS pe FROM
        (SELECT a1 AS c, count(*) AS n1 FROM r GROUP BY a1) x JOIN (SELECT a2 AS c, count(*) AS n2 FROM r GROUP BY a2) y USING (c))
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS po, round(coalesce(pe, 0.0), 6) AS pe,
       round((po - coalesce(pe, 0.0)) / (1 - coalesce(pe, 0.0)), 6) AS kappa FROM n, pe""")
def q_m13(spark, d):
    t = Tables(spark, d)
    seg = t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment")
    base = t.users.select("id", "label").join(t.labels.withColumnRenamed("doc_id", "id"), "id").join(seg, "id")
    l2_label = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("research")).otherwise(F.col("label"))
    a1 = base.select("id", F.filter(F.array(_code(F.col("label")), F.when(F.col("toxic") == 1, F.lit(6))),
                                    lambda x: x.isNotNull()).alias("labels"))
    a2 = base.select("id", F.filter(F.array(_code(l2_label), F.when(F.col("quality") == 1, F.lit(4))),
                                    lambda x: x.isNotNull()).alias("labels"))
    return md.cohen_kappa(md.resolve_annotations(a1, a2, "id"))


@query("organise_tags", """
SELECT community, array_to_string(list_sort(list('#P' || CAST(tag AS VARCHAR)) FILTER (WHERE role = 'own')), '|') AS own_tags,
       array_to_string(list_sort(list('#P' || CAST(tag AS VARCHAR)) FILTER (WHERE role = 'cb')), '|') AS cb_tags,
       count(CASE WHEN role = 'own' THEN 1 END) AS n_own, count(CASE WHEN role = 'cb' THEN 1 END) AS n_cb,
       count(CASE WHEN role = 'discarded' THEN 1 END) AS n_discarded
FROM (SELECT p_partkey AS tag, p_brand AS community, CASE WHEN p_size <= 5 THEN 'own' WHEN p_size <= 10 THEN 'cb' ELSE 'discarded' END AS role
      FROM part) o GROUP BY community HAVING count(CASE WHEN role <> 'discarded' THEN 1 END) > 0""")
def q_m15(spark, d):
    return md.organised_lines(organise_tags(Tables(spark, d).part))


# ---- M05-M09: Spark ML (rows-only) -----------------------------------------------------------
FEATURE_COLS = BEHAVIOUR + ("favorites_count", "plain_statuses", "retweets", "total_mentions", "total_urls",
                            "tweet_influence", "std_urls", "std_hashtags", "user_inclination")


def _training(spark, d):
    """(every user's vector, the labelled ones, columns, label indexer).
    Iterative estimators read their input many times: it is made once and
    kept in the shared checkpoint folder, which also cuts the lineage."""
    from pyspark.ml.feature import StringIndexer
    from communitylens.operators.joins import assemble_features
    t = Tables(spark, d)
    match = _auto_match(t).checkpoint()
    dicts = sorted(r[0] for r in match.select("dict").distinct().collect())  # a column each: the vector's own width
    dm = match.groupBy(F.col("user").alias("user_id")).pivot("dict", dicts).agg(F.first("score_sum"))
    dm = dm.select("user_id", *[F.col(f"`{c}`").alias(f"score_sum_{i}") for i, c in enumerate(dicts)])
    base = t.users.select(F.col("id").alias("user_id"), "label")
    df = assemble_features(base, "user_id", _uddin(t).select("user_id", *FEATURE_COLS), dm)
    cols = list(FEATURE_COLS) + [f"score_sum_{i}" for i in range(len(dicts))]
    df = md.assemble_vector(df, cols).checkpoint()
    lab = df.filter(F.col("label").isNotNull())
    indexer = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc").fit(lab)
    return df, indexer.transform(lab).checkpoint(), cols, indexer


@query("train_classifiers")
def q_m05(spark, d):
    """Every model's out-of-fold predictions, with the reference's
    settings (10 folds, 100 boosting rounds of depth 3, 500 hidden units)."""
    from pyspark.ml.functions import vector_to_array

    from communitylens.operators.boosting import boost_out_of_fold
    _, df, cols, ix = _training(spark, d)
    df = md.fold_column(md.class_weights(df), "user_id", "label_idx").checkpoint()
    plain = md.out_of_fold(df, md.classifiers(len(cols), len(ix.labels), df.count()), "user_id", "label_idx")
    rows = df.select("user_id", "label_idx", "fold", vector_to_array("features").alias("features"))
    boosted = boost_out_of_fold(rows, "user_id", "label_idx", "fold", classes=len(ix.labels))
    return plain.unionByName(boosted.select(F.lit("gradient_boosting").alias("model"), "user_id", "label_idx", "prediction", "fold"))


@query("pca_then_train")
def q_m06(spark, d):
    """Half of the columns' principal components (1,000 at most), then a
    classifier; components and classifier are fitted without the row's fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA
    _, df, cols, _ = _training(spark, d)
    k = min(1000, max(1, len(cols) // 2))
    pipe = Pipeline(stages=[PCA(k=k, inputCol="features", outputCol="pca"),
                            LogisticRegression(featuresCol="pca", labelCol="label_idx", maxIter=100)])
    return md.out_of_fold(df, {"pca": pipe}, "user_id", "label_idx").drop("model")


@query("pca_then_train_set")
def q_m06_set(spark, d, name=SPARSE_SET, components=20, folds=10):
    """M06 on a named set's sparse rows: components by a randomised range
    finder, then a classifier; both are fitted without the row's fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from communitylens.operators import sparse as sp
    from communitylens.operators.components import components_by_fold
    t = Tables(spark, d)
    labels = t.users.where("label IS NOT NULL").select(F.col("id").alias("user_id"), "label")
    labels = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc").fit(labels).transform(labels)
    labels = md.fold_column(labels, "user_id", "label_idx", folds).checkpoint()
    cells = feature_set(feature_blocks(spark, t, whole=False), name).checkpoint()
    rows = (cells.join(sp.column_index(cells), ["block", "feature"]).groupBy("user_id", "index")
            .agg(F.sum("value").alias("value")).checkpoint())
    placed = components_by_fold(rows, labels, "user_id", folds, components, powers=1).join(labels, "user_id")
    placed = placed.withColumn("features", array_to_vector("v")).checkpoint()
    out = None
    for fold in range(folds):
        mine = placed.filter(F.col("without") == fold)
        model = LogisticRegression(labelCol="label_idx", maxIter=100).fit(mine.filter(F.col("fold") != fold))
        part = model.transform(mine.filter(F.col("fold") == fold)).select("user_id", "label_idx", "prediction", "fold")
        out = part if out is None else out.unionByName(part)
    return out


@query("cross_validate")
def q_m07(spark, d):
    from pyspark.ml.classification import LogisticRegression
    _, df, _, _ = _training(spark, d)
    return md.out_of_fold(df, {"logistic_regression": LogisticRegression(labelCol="label_idx", maxIter=100)},
                          "user_id", "label_idx", folds=10).drop("model")


@query("feature_importance_select")
def q_m08(spark, d):
    """Forest importances; the columns of at least mean importance are
    cut out of the vectors, whose kept part is returned beside each user."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.functions import vector_to_array
    _, df, cols, _ = _training(spark, d)
    imp = RandomForestClassifier(labelCol="label_idx", numTrees=20, seed=42).fit(df).featureImportances.toArray()
    kept = [i for i, v in enumerate(imp.tolist()) if v >= imp.mean()]  # one value per feature column
    cut = VectorSlicer(inputCol="features", outputCol="kept", indices=kept).transform(df)
    named = F.arrays_zip(F.array(*[F.lit(cols[i]) for i in kept]).alias("f"), F.array(*[F.lit(float(imp[i])) for i in kept]).alias("i"),
                         vector_to_array("kept").alias("v"))
    return cut.select("user_id", F.explode(named).alias("z")).select(
        "user_id", F.col("z.f").alias("feature"), F.col("z.i").alias("importance"), F.col("z.v").alias("value"))


@query("predict_batch")
def q_m09(spark, d):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString
    everyone, df, _, ix = _training(spark, d)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:12]}")
    Pipeline(stages=[LogisticRegression(labelCol="label_idx", maxIter=100)]).fit(df).write().overwrite().save(path)
    scored = PipelineModel.load(path).transform(everyone)
    lab = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=ix.labels).transform(scored)
    return lab.select("user_id", "label", "predicted_label")


def topic_weights(docs, topics: int = 100, iterations: int = 500, min_df: int = 5, max_df: float = 0.5,
                  vocabulary: int = 1_000_000):
    """Bag of words (df >= 5, <= 50 %, <= 1e6 words) -> tf-idf -> LDA ->
    (doc_id, topic, weight), every topic of every document."""
    from pyspark.ml.feature import CountVectorizer, IDF

    from communitylens.operators.topics import lda_weights
    toks = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("deal"), tf.text_tokens(F.col("text"), True, 2).alias("toks"))
    cv = CountVectorizer(inputCol="toks", outputCol="tf", minDF=min_df, maxDF=max_df, vocabSize=vocabulary).fit(toks)
    counted = cv.transform(toks)
    bag = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted).select("doc_id", "tfidf", "deal").checkpoint()
    found = lda_weights(bag, "doc_id", "tfidf", "deal", len(cv.vocabulary), topics, iterations)
    return found.select("doc_id", F.posexplode("weights").alias("topic", "weight"))


@query("lda_topics")
def q_t13(spark, d):
    """(doc_id, topic, weight), every topic of every document."""
    return topic_weights(Tables(spark, d).documents)


def vector_clusters(embeddings, k: int = 200, iterations: int = 300):
    """L2-normalised vectors -> k-means -> (vec_id, cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector
    e = embeddings.select("vec_id", array_to_vector("embedding").alias("v"))
    n = Normalizer(inputCol="v", outputCol="features", p=2.0).transform(e).checkpoint()
    return KMeans(k=k, seed=42, maxIter=iterations).fit(n).transform(n).select("vec_id", F.col("prediction").alias("cluster"))


@query("word_vectors_and_clusters")
def q_t14(spark, d):
    """(vec_id, cluster), every vector's cluster of 200."""
    return vector_clusters(Tables(spark, d).embeddings)


@query("word_cluster_counts_trained")
def q_t15_trained(spark, d):
    """T15 over the clusters of T14: (user, cluster, n)."""
    t = Tables(spark, d)
    return q_text.cluster_counts(t, vector_clusters(t.embeddings))


@query("min_max", f"""
WITH ud AS ({ORACLE['uddin_features']}),
s AS (SELECT {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in BEHAVIOUR)} FROM ud)
SELECT ud.user_id, {', '.join(f'round(coalesce(({c} - {c}_min) / nullif(CAST({c}_max - {c}_min AS DOUBLE), 0), 0.0), 6) AS mm_{c}' for c in BEHAVIOUR)}
FROM ud, s""")
def q_m03_minmax(spark, d):
    """M03 second form: min-max scaling to [0, 1] only."""
    out = md.standardise(_uddin(Tables(spark, d)), list(BEHAVIOUR), "user_id")
    return out.select("user_id", *[f"mm_{c}" for c in BEHAVIOUR])
