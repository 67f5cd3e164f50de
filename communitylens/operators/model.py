"""Model data work (M01-M15): feature assembly, scaling, evaluation tables
and Spark ML training / scoring.

Evaluation tables (M10-M14) are exact group-by aggregates over a
(truth, prediction) table; training uses Spark ML estimators on the
assembled vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ---- M01-M04 -------------------------------------------------------------------------
def assemble_vector(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """A named feature set as one ML vector column."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def has_url_feature(users: DataFrame, urls: DataFrame) -> DataFrame:
    """1 when the user has a profile url."""
    return (users.select("id").join(urls.select("id", "url"), "id", "left")
            .select(F.col("id").alias("user_id"), F.col("url").isNotNull().cast("int").alias("has_url")))


def standardise(df: DataFrame, cols, key: str) -> DataFrame:
    """Z-score with mean and population std, and min-max to [0, 1].
    The column statistics are one aggregate row, taken as literals."""
    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in
                     (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
    out = [F.col(key)]
    for c in cols:
        mean, std, low, high = (F.lit(None if (x := stats[f"{c}__{n}"]) is None else float(x)).cast("double")
                                for n in ("mean", "std", "min", "max"))
        v = F.col(c).cast("double")
        out += [F.round(F.coalesce(F.try_divide(v - mean, std), F.lit(0.0)), 6).alias(f"z_{c}"),
                F.round(F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)), 6).alias(f"mm_{c}")]
    return df.select(*out)


def validate_features(df: DataFrame, key: str, cols) -> DataFrame:
    """Rows with a NaN (or missing) feature and how many."""
    bad = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c)), 1).otherwise(0) for c in cols), F.lit(0))
    return df.select(key, bad.alias("n_bad")).filter(F.col("n_bad") > 0)


# ---- M10-M14 -------------------------------------------------------------------------
def contingency(pred: DataFrame, truth_col: str = "truth", pred_col: str = "prediction") -> DataFrame:
    """(truth, prediction, n): one pass over the predictions, kept, as every
    score below is a sum over this small table."""
    return (pred.groupBy(F.col(truth_col).alias("truth"), F.col(pred_col).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")).checkpoint())


def class_scores(pred: DataFrame, truth_col: str = "truth", pred_col: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support (0 when undefined),
    then unweighted (macro) and support-weighted means, micro scores and
    accuracy, as one long table (name, precision, recall, f1, support)."""
    cells = contingency(pred, truth_col, pred_col)
    hit = F.col("truth") == F.col("prediction")
    # each cell counts for its truth's support and its prediction's total
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("truth").alias("c"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("npred")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("npred")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "npred")])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    per = per.select("c", prec.alias("p"), rec.alias("r"), "support", "tp")
    per = per.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    rows = per.select(F.col("c").alias("name"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"),
                      F.round("f", 6).alias("f1"), F.col("support").cast("bigint").alias("support"))
    total = F.sum("support").cast("bigint")
    micro = F.round(F.sum("tp").cast("double") / F.sum("support"), 6)
    weighted = lambda x: F.round(F.sum(F.col(x) * F.col("support")) / F.sum("support"), 6)
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"),
                                          f.alias("f1"), total.alias("support"))
    means = per.agg(F.array(
        line("macro avg", *[F.round(F.avg(x), 6) for x in "prf"]), line("weighted avg", *[weighted(x) for x in "prf"]),
        line("micro avg", micro, micro, micro), line("accuracy", micro, micro, micro)).alias("m"))
    return rows.unionByName(means.select(F.explode("m").alias("m")).select("m.*"))


def confusion_matrix(pred: DataFrame, truth_col: str = "truth", pred_col: str = "prediction") -> DataFrame:
    """(truth, prediction, n), one row per pair that occurs; ``pivot``
    in a sink that knows its labels makes it wide."""
    return contingency(pred, truth_col, pred_col)


def prediction_audit(pred: DataFrame, key: str, truth_col: str = "truth", pred_col: str = "prediction") -> DataFrame:
    """(key, prediction, truth, ok|wrong)."""
    return pred.select(key, pred_col, truth_col,
                       F.when(F.col(pred_col) == F.col(truth_col), "ok").otherwise("wrong").alias("result"))


def resolve_annotations(a1: DataFrame, a2: DataFrame, key: str) -> DataFrame:
    """M13 part 1: label lists of two annotators (arrays of codes); when
    either has several labels, a shared label wins (the highest code),
    else each keeps its first label (highest code)."""
    j = a1.select(key, F.col("labels").alias("l1")).join(a2.select(key, F.col("labels").alias("l2")), key)
    j = j.filter((F.size("l1") > 0) & (F.size("l2") > 0))
    inter = F.array_intersect("l1", "l2")
    multi = (F.size("l1") > 1) | (F.size("l2") > 1)
    shared = F.array_max(inter)
    return j.select(key,
                    F.when(multi & (F.size(inter) > 0), shared).otherwise(F.array_max("l1")).alias("a1"),
                    F.when(multi & (F.size(inter) > 0), shared).otherwise(F.array_max("l2")).alias("a2"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """M13 part 2: Cohen's kappa (po - pe) / (1 - pe) from a contingency
    group-by (no pairwise work)."""
    n = pairs.select(F.count(F.lit(1))).scalar()
    po = pairs.filter(F.col("a1") == F.col("a2")).select(F.count(F.lit(1))).scalar().cast("double") / n
    m1 = pairs.groupBy(F.col("a1").alias("c")).agg(F.count(F.lit(1)).alias("n1"))
    m2 = pairs.groupBy(F.col("a2").alias("c")).agg(F.count(F.lit(1)).alias("n2"))
    pe = m1.join(m2, "c").agg(F.sum(F.col("n1") * F.col("n2")).alias("s")).select(F.col("s").cast("double") / (n * n)).scalar()
    return m1.agg(F.count(F.lit(1)).alias("_")).select(
        n.cast("bigint").alias("n"), F.round(po, 6).alias("po"), F.round(F.coalesce(pe, F.lit(0.0)), 6).alias("pe"),
        F.round(F.try_divide(po - F.coalesce(pe, F.lit(0.0)), 1 - F.coalesce(pe, F.lit(0.0))), 6).alias("kappa"))


def experiment_pivot(scores: DataFrame) -> DataFrame:
    """(setting, class, p, r, f1): one row per setting and class (scores:
    setting, name, precision, recall, f1); the means are not classes."""
    means = ("macro avg", "weighted avg", "micro avg", "accuracy")
    return (scores.filter(~F.col("name").isin(*means))
            .select("setting", F.col("name").alias("class"), F.col("precision").alias("p"), F.col("recall").alias("r"), "f1"))


def format_deltas(base: DataFrame, other: DataFrame, keys) -> DataFrame:
    """M14, how a paper prints changes: (keys, metric, delta) with '-' for
    none, '(0.03)' for a loss and '0.03' for a gain."""
    b, o = (_metrics_long(x, keys, n) for x, n in ((base, "b"), (other, "o")))
    d = F.round(F.col("o"), 2) - F.round(F.col("b"), 2)
    text = (F.when(F.abs(d) < 0.005, "-").when(d < 0, F.concat(F.lit("("), F.format_number(-d, 2), F.lit(")")))
            .otherwise(F.format_number(d, 2)))
    return b.join(o, [*keys, "metric"]).select(*keys, "metric", text.alias("delta"))


def _metrics_long(scores: DataFrame, keys, value: str) -> DataFrame:
    return scores.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(value))
                                                    for m in ("p", "r", "f1")])).alias("m")).select(*keys, "m.*")


def absolute_results(base: DataFrame, deltas: DataFrame, keys) -> DataFrame:
    """M14 second half: base values (two decimals) plus a table of printed
    deltas; '-' adds nothing and brackets subtract."""
    text = F.regexp_replace("delta", r"[()]", "").try_cast("double")
    change = (F.when(F.col("delta") == "-", 0.0).when(F.col("delta").startswith("("), -text).otherwise(text))
    return (_metrics_long(base, keys, "b").join(deltas, [*keys, "metric"])
            .select(*keys, "metric", F.round(F.round("b", 2) + change, 2).alias("value")))


def organised_lines(organised: DataFrame) -> DataFrame:
    """Per community its own and community-building tags (sorted,
    '|' joined) and the number of discarded tag lines by type."""
    kept = organised.filter(F.col("role") != "discarded")
    g = kept.groupBy("community").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == "own", F.concat(F.lit("#P"), F.col("tag").cast("string"))))), "|").alias("own_tags"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == "cb", F.concat(F.lit("#P"), F.col("tag").cast("string"))))), "|").alias("cb_tags"),
        F.count(F.when(F.col("role") == "own", 1)).alias("n_own"), F.count(F.when(F.col("role") == "cb", 1)).alias("n_cb"))
    disc = organised.filter(F.col("role") == "discarded").groupBy("community").agg(F.count(F.lit(1)).alias("n_discarded"))
    return g.join(disc, "community", "left").na.fill(0, ["n_discarded"])


# ---- M05-M09 (Spark ML) ------------------------------------------------------------------
def class_weights(df: DataFrame, label_col: str = "label_idx") -> DataFrame:
    """Balanced class weights n / (k * n_c) as a column (join of a per-class
    count, k = number of classes)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return df.join(counts, label_col).withColumn("weight", n.cast("double") / (k * F.col("_nc"))).drop("_nc")


def classifiers(n_features: int, n_classes: int, n_rows: int, seed: int = 42, svm_c: float = 0.01, hidden: int = 500):
    """The reference's model family as Spark ML estimators (boosting has
    its own operator, ``boosting``).  A penalty C on summed losses is
    regParam = 1 / (C n) on averaged ones; a forest's trees grow as deep as
    Spark lets them."""
    from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                           RandomForestClassifier)
    return {
        "logistic_regression": LogisticRegression(labelCol="label_idx", maxIter=100),
        "random_forest": RandomForestClassifier(labelCol="label_idx", numTrees=20, maxDepth=30, seed=seed),
        "linear_svm": OneVsRest(classifier=LinearSVC(regParam=1.0 / (svm_c * max(1, n_rows)), maxIter=50),
                                labelCol="label_idx", weightCol="weight", parallelism=n_classes),
        "mlp": MultilayerPerceptronClassifier(labelCol="label_idx", layers=[n_features, hidden, n_classes], maxIter=100, seed=seed),
    }


def out_of_fold(df: DataFrame, estimators: dict, key: str, label_col: str, folds: int = 10, at_once: int = 8) -> DataFrame:
    """(model, key, label, prediction, fold); every row is predicted
    by a model that was fitted without the row's fold.  The fits run while the
    query is built, ``at_once`` of them side by side over one kept table."""
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target
    df = (df if "fold" in df.columns else fold_column(df, key, label_col, folds)).checkpoint()

    @inheritable_thread_target(df.sparkSession)
    def fitted(task):
        name, k = task
        model = estimators[name].fit(df.filter(F.col("fold") != k))
        return model.transform(df.filter(F.col("fold") == k)).select(F.lit(name).alias("model"), key, label_col, "prediction", "fold")

    with ThreadPool(at_once) as pool:
        parts = pool.map(fitted, [(name, k) for name in estimators for k in range(folds)], chunksize=1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_column(df: DataFrame, key: str, label_col: str, k: int = 10) -> DataFrame:
    """fold = (row number within the label in md5(key) order) mod k,
    i.e. stratified folds; the rank is the skew-safe two-level hash rank."""
    from communitylens.operators.windows import hash_rank
    return hash_rank(df, label_col, key).withColumn("fold", (F.col("hash_rank") - 1) % k).drop("hash_rank")
