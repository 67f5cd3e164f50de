"""Set operations (E01-E07) as DataFrame set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append rows of two tables with the same columns (by name)."""
    return a.unionByName(b)


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """E02."""
    return a.intersect(b)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """E03."""
    return a.union(b).distinct()


def set_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that do not occur in ``b`` at all, however
    often they occur in ``a``."""
    return a.subtract(b)


def retain_only(a: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Keep only elements present in ``allowed``."""
    return a.join(allowed.select(key).distinct(), key, "left_semi")


def dedup_texts(df: DataFrame, col: str) -> DataFrame:
    """Distinct texts."""
    return df.select(col).dropDuplicates([col])


def dedup_sorted_tags(lines: DataFrame, col: str) -> DataFrame:
    """Unique lines starting with '#', sorted."""
    return lines.filter(F.col(col).startswith("#")).select(col).distinct().orderBy(col)
