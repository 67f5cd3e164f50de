"""Sinks and file sources.

Every writer goes to a folder under the shared checkpoint directory (or a
path the caller names), never to a machine-local folder; every reader reads
the folder back with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communitylens.functions.text import collapse_whitespace
from communitylens.operators.windows import global_running_sum


def sink_rolled_csv(df: DataFrame, path: str, max_rows: int) -> None:
    """CSV files of at most ``max_rows`` rows each, with a header."""
    df.write.mode("overwrite").option("header", "true").option("maxRecordsPerFile", max_rows).csv(path)


def read_feature_csv(spark, path: str, schema: str) -> DataFrame:
    """Header CSV with an explicit schema."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def corpus_shards(posts: DataFrame, ignore_users: DataFrame, budget: int) -> DataFrame:
    """Corpus in id order without ignored users; shard =
    floor(words before the post / budget), so each shard holds at most
    budget words plus one post.  Texts of <= 2 characters count their
    words but are not written (``written`` false).  The running sum is a
    two-level prefix sum (no single-task window)."""
    p = posts.join(ignore_users.select(F.col("user_id")), "user_id", "left_anti")
    t = F.regexp_replace(F.col("status_text"), r"\s+$", "")
    n = F.when((t == "") & (F.length("status_text") > 0), 0).otherwise(F.size(F.split(t, r"\s+")))
    x = p.select("id", n.cast("bigint").alias("n_tokens"), (F.length("status_text") > 2).alias("written"))
    r = global_running_sum(x, ["id"], "n_tokens")
    return r.select("id", "n_tokens", (F.floor(F.col("cum_before") / budget)).cast("bigint").alias("shard"), "written")


def user_corpus_lines(posts: DataFrame, buckets: int = 64) -> DataFrame:
    """One line per post: ``<user>|ot|<text>`` or ``<user>|rt|<text>``
    (retweet = non-empty retweet mark, here the retweet kind), whitespace
    collapsed; ``bucket`` spreads users over a bounded number of folders."""
    kind = F.when(F.col("kind") == "retweet", "rt").otherwise("ot")
    return posts.select(F.pmod(F.col("user_id"), F.lit(buckets)).alias("bucket"),
                        F.concat_ws("|", F.col("user_id").cast("string"), kind,
                                    collapse_whitespace("status_text")).alias("value"))


def sink_user_corpus(posts: DataFrame, path: str, buckets: int = 64) -> None:
    user_corpus_lines(posts, buckets).write.mode("overwrite").partitionBy("bucket").text(path)


def read_user_post_files(spark, path: str, strip_rt: bool = False) -> DataFrame:
    """(user, kind, text) from corpus lines; lines without a legal
    kind are skipped; the variant strips a leading 'rt ' and lower-cases."""
    lines = spark.read.text(path)
    parts = F.split("value", r"\|", 3)
    x = lines.select(F.try_element_at(parts, F.lit(1)).alias("user"), F.try_element_at(parts, F.lit(2)).alias("kind"),
                     F.try_element_at(parts, F.lit(3)).alias("text")).filter(F.col("kind").isin("ot", "rt"))
    if strip_rt:
        x = x.withColumn("text", F.regexp_replace(F.lower("text"), "^rt ", ""))
    return x


def upsert_by_id(old: DataFrame, new: DataFrame, key: str, version_col: str) -> DataFrame:
    """Old and new rows keyed by id; the highest version wins (max_by:
    partial aggregation, no per-key sort)."""
    u = old.unionByName(new)
    others = [c for c in u.columns if c != key]
    return (u.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version_col)).alias("_r")).select(key, "_r.*"))


def partial_update(base: DataFrame, updates: DataFrame, key: str, positive_only=()) -> DataFrame:
    """Set only the given columns of existing rows: columns of
    ``updates`` replace the base value when present (or, for
    ``positive_only`` columns, when > 0)."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = base.join(u, key, "left")
    for c in cols:
        new = F.col(f"_new_{c}")
        cond = (new > 0) if c in positive_only else new.isNotNull()
        j = j.withColumn(c, F.when(cond, new).otherwise(F.col(c))).drop(f"_new_{c}")
    return j


def merge_shards(spark, path: str, schema: str, sort_col: str) -> DataFrame:
    """All per-worker CSV files of a folder (one header each) as one
    table, sorted."""
    return spark.read.option("header", "true").schema(schema).csv(path).orderBy(sort_col)


def long_matrix(pairs: DataFrame, row_col: str, col_col: str, value_col: str) -> DataFrame:
    """S16, the matrix as rows: (community, other, value) both ways round,
    '#' trimmed; the form for any number of communities."""
    a, b = (F.regexp_replace(c, "^#", "") for c in (row_col, col_col))
    return (pairs.select(a.alias("community"), b.alias("other"), F.col(value_col))
            .unionByName(pairs.select(b.alias("community"), a.alias("other"), F.col(value_col))))


def wide_matrix(pairs: DataFrame, row_col: str, col_col: str, value_col: str, values) -> DataFrame:
    """Square matrix, one row per ``row_col`` value, one column per
    value of ``values`` (the column list is always given); '#' trimmed."""
    trimmed = [v[1:].strip() if v.startswith("#") else v for v in values]
    sym = pairs.select(F.col(row_col).alias("r"), F.col(col_col).alias("c"), value_col).unionByName(
        pairs.select(F.col(col_col).alias("r"), F.col(row_col).alias("c"), value_col))
    sym = sym.withColumn("r", F.regexp_replace("r", "^#", "")).withColumn("c", F.regexp_replace("c", "^#", ""))
    return sym.groupBy(F.col("r").alias("community")).pivot("c", trimmed).agg(F.first(value_col))


KEY_BUCKETS = 256


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")).cast("int")


def create_keyed_table(rows: DataFrame, path: str, key: str, buckets: int = KEY_BUCKETS) -> None:
    """A table that ``upsert_into`` keeps: one folder for each
    bucket of the key's hash."""
    (rows.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket")
     .write.mode("overwrite").partitionBy("_bucket").parquet(path))


def read_keyed_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def upsert_into(path: str, rows: DataFrame, key: str, version_col: str, buckets: int = KEY_BUCKETS) -> list[int]:
    """S13 in place: of old and new rows with one key the highest version
    stays, of equal versions the greater row, so the same rows may come again
    and again.  Only the buckets of the new keys are read and written over
    (dynamic partition overwrite); the files of others stay as they are.
    Returns the buckets, ``buckets`` numbers at most.  ``buckets`` must be the
    number that the table was created with; a null key is a key."""
    spark = rows.sparkSession
    new = rows.withColumn("_bucket", _bucket(key, buckets)).checkpoint()
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    if not touched:
        return []
    old = spark.read.schema(new.schema).parquet(path).where(F.col("_bucket").isin(touched)).select(*new.columns)
    others = [c for c in rows.columns if c not in (key, version_col)]
    best = F.max(F.struct(F.col(version_col), *[F.col(c) for c in others])).alias("_r")
    merged = old.unionByName(new).groupBy("_bucket", key).agg(best).select(key, "_r.*", "_bucket").select(*new.columns)
    # the merged rows are kept first: a bucket is never read while it is written over
    (merged.checkpoint().repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket").parquet(path))
    return touched
