"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import reliable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Each round connects every node's larger neighbours to its smallest one
    (large star), then its smaller ones (small star), until nothing changes:
    about log^2 rounds, each with two group-by minima and joins, cut by a
    checkpoint.  Links stay in the table; nothing is collected."""
    u, v = F.col(a), F.col(b)
    edges = reliable(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges, before = reliable(small), state
        state = _state(edges)
        if state == before:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return (stars.select(F.col("u").alias("node"), "root")
            .unionByName(stars.select(F.col("root").alias("node"), "root").distinct()))
