"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.session import ensure_checkpoint_dir, scratch_path

#: The six ASCII white-space characters, as a Java / RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark removes a query's shuffle files when it ends, not at some later
#: garbage collection, where this is set as the query is planned.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; smaller than a
    checkpoint, and readers take only the columns that they need."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def packed(df: DataFrame, *cols: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside computed columns, so that
    no column of the caller can clash with a name used by an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *cols)


def unpacked(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("row.*", *extra)


def pieces(df: DataFrame, size_of: Column, target: int) -> int:
    """How many pieces of about ``target`` units the rows make (1 at least);
    one aggregate over all rows."""
    total = df.agg(F.sum(size_of.cast("double"))).first()[0] or 0.0
    return max(1, -(-int(total) // target))
