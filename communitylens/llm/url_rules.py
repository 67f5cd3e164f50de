"""URL filter by association rules.

A URL is a set of tokens (labels of its host, segments of its path, names in
its query).  FP-growth mines the token combinations of labelled URLs; rules
``tokens -> verdict`` are kept by support and confidence, and a rule that a
more general one makes needless goes.  A URL meets the rules through an
inverted index: every rule is listed under its rarest token, so a URL only
looks at rules whose rarest token it has.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communitylens.llm.common import packed, stored

#: Share of the labelled URLs that a rule's tokens and verdict must have, and
#: share of the URLs with these tokens that must have the verdict.
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
#: The verdict of a URL that no rule knows.
DEFAULT = "allow"
#: (host, path, verdict) of the rules stated by hand.
STATED = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
          ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for a null URL or one without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, null if none does.
    A rule fits its host and all below it, where the path starts with its own."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last one that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The sorted set of a URL's tokens: ``h:`` labels of the host, ``p:``
    segments of the path and ``q:`` names in the query, digits as one 0."""
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    marked = lambda c, mark: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(mark), plain(x)))
    query = F.regexp_extract(_rest(url), r"^[^?#]*[?]([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(marked(F.split(host_of(url), "[.]"), "h:"), marked(F.split(path_of(url), "/"), "p:"),
                                                  marked(names, "q:"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support) from ``labelled`` (url, verdict).

    Tokens that the same URLs have are one item (its least token): they say
    the same, and copies of a long URL would otherwise make every subset of its
    tokens an item set of its own.  A rule is needless where leaving out one of
    its tokens gives a rule of the same confidence or more.  Rows with null URL
    or verdict teach nothing; repeated rows count as often as they come; no
    labelled rows give no rules."""
    urls = stored(labelled.where("url IS NOT NULL AND verdict IS NOT NULL")
                  .select(tokens_of(F.col("url")).alias("tokens"), "verdict", F.monotonically_increasing_id().alias("id")), "url-tokens")
    n = urls.count()
    if not n:
        return urls.select("tokens", "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    item = urls.select(F.explode("tokens").alias("token"), "id")
    same = (item.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("a"),
                                      F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("b"))
            .where(F.col("n") >= F.lit(min_support * n)).groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token"))
    same = stored(same, "url-items")
    baskets = (item.join(same, "token").groupBy("id").agg(F.collect_list("token").alias("items"))
               .join(urls.select("id", "verdict"), "id")
               .select(F.concat("items", F.array(F.concat(F.lit(_LABEL), F.col("verdict")))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(stored(baskets, "url-baskets"))
    rules = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    rules = stored(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1 << 20).alias("verdict"),
                                "confidence", "support"), "url-rules")
    shorter = (rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("out"))
               .select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("out")).alias("less")))
    general = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("general"))
    needless = shorter.join(general, "less").where("general >= confidence").select("tokens", "verdict").distinct()
    return rules.join(needless, ["tokens", "verdict"], "left_anti")


def index(rules: DataFrame) -> DataFrame:
    """The inverted index of rules: each one under the token that the fewest
    rules have."""
    use = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rarest = Window.partitionBy("tokens", "verdict").orderBy("uses", "token")
    return (rules.select("*", F.explode("tokens").alias("token")).join(use, "token")
            .withColumn("at", F.row_number().over(rarest)).where("at = 1").select("token", "tokens", "verdict", "confidence", "support"))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, verdict, confidence, tokens) for ``urls`` (id, url) that a mined
    rule matches: the rule of the highest confidence, then support, then the
    fewest and the least tokens; of one rule's two verdicts allow."""
    listed = stored(index(rules), "url-index")
    have = urls.select("id", tokens_of(F.col("url")).alias("have"))
    met = (have.select("id", "have", F.explode("have").alias("token")).join(listed, "token")
           .where(F.size(F.array_except("tokens", "have")) == 0))
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("k"), "tokens", "verdict")
    best = met.groupBy("id").agg(F.min(rank).alias("best"))
    return best.select("id", F.col("best.verdict").alias("verdict"), (-F.col("best.c")).alias("confidence"), F.col("best.tokens").alias("tokens"))


def filter_urls(pages: DataFrame, stated=STATED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
                default: str = DEFAULT) -> DataFrame:
    """``row`` (the row of ``pages`` itself), host, path, rule, verdict.

    URLs that a stated rule decides keep its verdict, and they are the
    labelled URLs that the association rules are mined from; those decide the
    others.  URLs without a matching rule get ``default``, as do null URLs and
    URLs without ``://``, whose host and path are empty.  Equal URLs have equal
    verdicts; an empty table gives no rows."""
    url = F.col("row.url")
    rows = packed(pages).select("row", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), stated)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("stated"))
    rules = stored(mine(rows.where("stated IS NOT NULL").select("row.url", F.col("stated").alias("verdict")), min_support, min_confidence),
                   "url-kept-rules")
    open_urls = rows.where("stated IS NULL AND row.url IS NOT NULL").select(F.col("row.url").alias("id"), F.col("row.url").alias("url")).distinct()
    mined = judge(open_urls, rules).select(F.col("id").alias("mined_url"), F.col("verdict").alias("mined"))
    met = rows.where("stated IS NULL").join(mined, F.col("row.url") == F.col("mined_url"), "left")
    return (rows.where("stated IS NOT NULL").select("row", "host", "path", "rule", F.col("stated").alias("verdict"))
            .unionByName(met.select("row", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"))))
