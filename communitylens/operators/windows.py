"""Window, sort, limit and top-k.

Windows partitioned by a user or a community put that whole group into one
task.  Where a group can be hot (a third of all rows), the operators here
use a two-level form instead: a window over a finer key (user + day, or
group + hash bucket) plus a small fix-up over the per-bucket summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_last_post(posts: DataFrame) -> DataFrame:
    """First and last post time per user (min / max, no sort)."""
    return posts.groupBy("user_id").agg(F.min("created_at").alias("first_post"),
                                        F.max("created_at").alias("last_post"))


def _epoch_s(c):
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000)


def inter_post_gaps(posts: DataFrame, user_col: str = "user_id", ts_col: str = "created_at",
                    id_col: str = "id") -> DataFrame:
    """Per user the seconds between successive posts (ordered by time,
    then id): count, mean and sample std of the gaps; 0 when < 2 posts.

    Gaps inside one day come from a window over (user, day); the gap that
    crosses into a day comes from the previous non-empty day's last post,
    found with a window over the per-day summaries (one row per user-day).
    A hot user is thus spread over its days."""
    p = posts.select(F.col(user_col).alias("u"), F.col(id_col).alias("pid"), _epoch_s(ts_col).alias("t"),
                     F.to_date(F.col(ts_col)).alias("day"))
    wd = Window.partitionBy("u", "day").orderBy("t", "pid")
    inner = (p.withColumn("prev", F.lag("t").over(wd)).filter(F.col("prev").isNotNull())
             .select("u", (F.col("t") - F.col("prev")).alias("gap")))
    days = p.groupBy("u", "day").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    wu = Window.partitionBy("u").orderBy("day")
    cross = (days.withColumn("prev_last", F.lag("last_t").over(wu)).filter(F.col("prev_last").isNotNull())
             .select("u", (F.col("first_t") - F.col("prev_last")).alias("gap")))
    gaps = inner.unionByName(cross)
    stats = gaps.groupBy("u").agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap").alias("mean_gap"),
                                  F.stddev_samp("gap").alias("std_gap"))
    users = posts.select(F.col(user_col).alias("u")).distinct()
    return (users.join(stats, "u", "left")
            .select(F.col("u").alias(user_col), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
                    F.round(F.coalesce("mean_gap", F.lit(0.0)), 4).alias("mean_gap"),
                    F.round(F.coalesce("std_gap", F.lit(0.0)), 4).alias("std_gap")))


def posts_per_day(posts: DataFrame, user_col: str = "user_id", ts_col: str = "created_at") -> DataFrame:
    """Per user mean and sample std of posts per day, over days with
    posts (real dates); std 0 for a single day."""
    d = posts.groupBy(user_col, F.to_date(ts_col).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_days"),
                                   F.round(F.avg("n"), 4).alias("mean_per_day"),
                                   F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 4).alias("std_per_day"))


def recent_n_per_user(posts: DataFrame, n: int = 3, sep: str = " || ") -> DataFrame:
    """The newest n texts of each user in one row (newest first).
    ``row_number() <= n`` lets Spark cut each group to n rows before the
    shuffle (window group limit)."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    top = posts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return top.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_recent"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "status_text"))),
                                 lambda s: s["status_text"]), sep).alias("recent_texts"))


def sample_share(df: DataFrame, group_col: str, id_col: str, share: float, buckets_hex: int = 4) -> DataFrame:
    """A deterministic random share without replacement per group: the
    floor(share * n) rows with the smallest md5(id) in each group.

    Exact and skew-safe: rows are counted per (group, md5 prefix); the
    bucket holding the cut-off is found on that small histogram, and only
    the rows of that one bucket are ranked."""
    h = F.md5(F.col(id_col).cast("string"))
    x = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, buckets_hex))
    hist = x.groupBy(group_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy(group_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_cum", F.sum("_c").over(wc))
            .withColumn("_n", F.sum("_c").over(Window.partitionBy(group_col)))
            .withColumn("_k", F.floor(F.col("_n") * F.lit(share)))
            .withColumn("_before", F.col("_cum") - F.col("_c")))
    # per bucket: all in / none in / the cut bucket with its remaining quota
    hist = hist.select(group_col, "_b", F.when(F.col("_cum") <= F.col("_k"), F.lit(-1))
                       .when(F.col("_before") < F.col("_k"), F.col("_k") - F.col("_before"))
                       .otherwise(F.lit(0)).alias("_quota"))
    j = x.join(hist, [group_col, "_b"])
    full = j.filter(F.col("_quota") == -1)
    cut = j.filter(F.col("_quota") > 0)
    wr = Window.partitionBy(group_col, "_b").orderBy("_h", id_col)
    cut = cut.withColumn("_r", F.row_number().over(wr)).filter(F.col("_r") <= F.col("_quota")).drop("_r")
    return full.unionByName(cut).drop("_h", "_b", "_quota")


def tumbling_windows(posts: DataFrame, days: int = 10) -> DataFrame:
    """Successive half-open windows of ``days`` days from the first
    post; (window_id, window_start, window_end) per post.  The first post
    time is a scalar subquery."""
    first = posts.select(F.min("created_at")).scalar()
    span = F.lit(days * 86400)
    wid = F.floor((F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(first.cast("timestamp")))
                  / F.lit(1_000_000) / span)
    start = F.timestamp_seconds(F.unix_micros(first.cast("timestamp")) / F.lit(1_000_000) + wid * span)
    return (posts.withColumn("window_id", wid.cast("bigint"))
            .withColumn("window_start", start.cast("timestamp_ntz"))
            .withColumn("window_end", (start + F.make_dt_interval(F.lit(days))).cast("timestamp_ntz")))


def topn_per_group(df: DataFrame, group_col: str, value_col: str, key_col: str, n: int) -> DataFrame:
    """Per group the top n rows by value desc, key asc."""
    w = Window.partitionBy(group_col).orderBy(F.col(value_col).desc(), F.col(key_col).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def global_row_number(df: DataFrame, order_cols, n_parts: int | None = None) -> DataFrame:
    """A gap-free 1-based row number in the global order of ``order_cols``
    without a single-task window: range-partition, number rows inside each
    partition, then add the prefix sum of the (few) partition sizes."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # Range boundaries come from a sample, so the two readers below must see
    # one materialised copy: a reliable checkpoint in the shared folder.
    x = x.withColumn("_off", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)).checkpoint()
    sizes = x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_sz"))
    pre = sizes.withColumn("_base", F.coalesce(F.sum("_sz").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: bounded by the partition count, safe to broadcast
    return (x.join(F.broadcast(pre.select("_pid", "_base")), "_pid")
            .withColumn("row_number", F.col("_base") + F.col("_off") + 1)
            .drop("_pid", "_mid", "_off", "_base"))


def keyword_batches(keywords: DataFrame, batch_size: int = 400) -> DataFrame:
    """Unique keywords in sorted order cut into batches of <= 400."""
    kw = keywords.select("keyword").distinct()
    rn = global_row_number(kw, ["keyword"])
    return rn.select("keyword", F.floor((F.col("row_number") - 1) / batch_size).cast("bigint").alias("batch"))


def shuffle_take(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """A seeded random order by md5(id || seed), first n rows (a
    distributed top-n, no global sort)."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))
    return df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")


def global_running_sum(df: DataFrame, order_cols, value_col: str, out_col: str = "cum_before",
                       n_parts: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value_col`` in the global order of
    ``order_cols`` without a single-task window: range-partition, running
    sums inside each partition (window over the partition id), plus the
    prefix of the per-partition totals (one row per partition)."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n_parts, *order_cols).withColumn("_pid", F.spark_partition_id())
    # Range boundaries come from a sample, so the two readers below must see
    # one materialised copy: a reliable checkpoint in the shared folder.
    x = x.checkpoint()
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_local", F.coalesce(F.sum(value_col).over(w), F.lit(0)))
    totals = x.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    pre = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (x.join(F.broadcast(pre.select("_pid", "_base")), "_pid")
            .withColumn(out_col, F.col("_base") + F.col("_local"))
            .drop("_pid", "_local", "_base"))


def hash_rank(df: DataFrame, group_col: str, key: str, buckets_hex: int = 4, out: str = "hash_rank") -> DataFrame:
    """1-based rank of each row inside its group in md5(key) order, computed
    without sorting a whole group in one task: rows before the row's md5
    bucket come from a per-group histogram of md5 prefixes, the rank inside
    the bucket from a window over (group, bucket)."""
    h = F.md5(F.col(key).cast("string"))
    x = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, buckets_hex))
    hist = x.groupBy(group_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy(group_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(group_col, "_b", F.coalesce(F.sum("_c").over(wc), F.lit(0)).alias("_before"))
    wl = Window.partitionBy(group_col, "_b").orderBy("_h", key)
    return (x.join(hist, [group_col, "_b"]).withColumn(out, F.col("_before") + F.row_number().over(wl))
            .drop("_h", "_b", "_before"))
