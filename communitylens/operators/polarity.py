"""U-S1: polarity of a text by a lexicon, in the order of its words.

A word's value is raised by boosters and turned by negations among the three
words before it, and raised where it alone is in capitals.  Words are rows; the
three words before come from a window inside the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of the published rule-based model
NEGATED, BOOST, CAPITALS, ALPHA = -0.74, 0.293, 0.733, 15.0
FADE = (1.0, 0.95, 0.9)


def text_polarity(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, valence, compound) of every text.

    ``lexicon`` is (word, role, value) in lower case, roles ``valence``,
    ``booster`` (value 1 raises, -1 lowers) and ``negation``; a word may have
    several roles.  compound = s / sqrt(s^2 + ALPHA) of the summed values s.  A
    text without a lexicon word, an empty or a null one has 0."""
    word = F.col("word")
    tokens = (texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\p{L}']+"), 0))
                           .alias("place", "word")))
    roles = lexicon.groupBy(F.col("word").alias("lower")).agg(
        F.max(F.when(F.col("role") == "valence", F.col("value"))).alias("valence"),
        F.max(F.when(F.col("role") == "booster", F.col("value"))).alias("boost"),
        F.coalesce(F.max(F.col("role") == "negation"), F.lit(False)).alias("negation"))
    capitals = (F.upper("word") == word) & (F.lower("word") != word) & (F.length("word") > 1)
    rows = (tokens.withColumn("lower", F.lower("word")).withColumn("caps", capitals).join(roles, "lower", "left")
            .select("id", "place", "caps", "valence", F.coalesce("boost", F.lit(0.0)).alias("boost"), F.coalesce("negation", F.lit(False)).alias("negation")))
    mixed = rows.groupBy("id").agg((F.max("caps") & ~F.min("caps")).alias("mixed"))
    before = Window.partitionBy("id").orderBy("place")
    boosts, negated = F.lit(0.0), F.lit(False)
    for k, fade in enumerate(FADE, 1):
        boosts = boosts + F.coalesce(F.lag("boost", k).over(before), F.lit(0.0)) * F.lit(BOOST * fade)
        negated = negated | F.coalesce(F.lag("negation", k).over(before), F.lit(False))
    rows = rows.select("id", "valence", "caps", boosts.alias("boosts"), negated.alias("negated")).where("valence IS NOT NULL")
    sign = F.signum("valence")
    value = F.col("valence") + sign * (F.when(F.col("caps") & F.col("mixed"), CAPITALS).otherwise(0.0) + F.col("boosts"))
    scored = (rows.join(mixed, "id").select("id", F.when(F.col("negated"), value * NEGATED).otherwise(value).alias("v"))
              .groupBy("id").agg((F.sum(F.round(F.col("v") * 1e7).cast("long")) / F.lit(1e7)).alias("valence")))
    s = F.coalesce("valence", F.lit(0.0))
    return (texts.select(F.col(id_col).alias("id")).join(scored, "id", "left")
            .select(F.col("id").alias(id_col), F.round(s, 7).alias("valence"), F.round(s / F.sqrt(s * s + ALPHA), 6).alias("compound")))
