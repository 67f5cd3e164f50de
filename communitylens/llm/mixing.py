"""Mixing sources to target weights by Sainte-Lague apportionment.

Everything here is DataFrame expressions.  Work is per row, per block or per
source; the only orderings are a global range-partitioned one (quotients)
and windows inside one (source, md5 bucket) cell, so no source is ever sorted
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communitylens.llm.common import reliable, stored, text_or_empty, unpacked
from communitylens.session import ensure_checkpoint_dir
from communitylens.operators.windows import global_row_number

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Blocks that the whole mix is cut into, at least; a mix of many sources has
#: BLOCKS_PER_SOURCE for each of them.  The block length follows the input.
MIX_BLOCKS = 1 << 14
BLOCKS_PER_SOURCE = 1 << 9
BLOCKS_PER_SHARD = 1 << 8
#: Blocks are nested: each level's block holds so many of the next one's, down
#: to single words.
NESTED = 1 << 6
#: Rows that one (source, md5 prefix) cell holds at most, about.
CELL_ROWS = 20_000
SEED = "mix-1"
#: Multipliers for the order of blocks: primes above any block count.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) -> plus rank, weight and target.

    Sources by code point, null last, weigh ``weights`` in turn and share
    the total; a share above ``max_repeats`` times the source's size stops
    there and the excess is shared anew by weight.  Each pass is one
    aggregate over the sources; a pass either caps a source or is the last."""
    ranked = global_row_number(sizes, [F.col("source").isNull(), F.col("source")], 1 + 8)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("row_number") - 1) % len(weights) + 1).cast("int"))
    src = reliable(ranked.select("source", "source_size", F.col("row_number").alias("source_rank"),
                                 w.alias("weight"), (F.col("source_size") * float(max_repeats)).alias("most")))
    rate, free = 0.0, -1
    while True:
        capped = F.col("most") < F.lit(rate) * F.col("weight")
        total, fixed, w_free, n_free = src.agg(
            F.sum("source_size").cast("double"), F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count(F.when(~capped, 1))).first()
        if n_free == free or not w_free:
            break
        free, rate = n_free, ((total or 0.0) - fixed) / w_free
    return src.withColumn("target", F.least(F.col("most"), F.lit(rate) * F.col("weight"))).drop("most")


def quotas(targets: DataFrame, block_words: int, blocks_per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """(source, shard, blocks): the blocks of ``block_words`` words that each
    shard of the mix takes from each source.

    Block k of a source has the quotient target / (2k + 1).  The highest
    quotients win, in that order; each run of ``blocks_per_shard`` winners is
    a shard, so every prefix of shards is apportioned as well as the whole.
    A source can win at most target * (n + m/2) / total + 1/2 blocks (n
    blocks, m sources), which bounds the quotients made to n + m * 1.5."""
    total, m = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    n = int(round(total / block_words))
    if n == 0:
        return targets.select("source", "source_rank", F.lit(0).cast("long").alias("shard"),
                              F.lit(0).cast("long").alias("blocks"))
    most = F.ceil(F.col("target") * ((n + m / 2) / total) + 0.5).cast("long")
    q = (targets.where("target > 0")
         .select("source", "source_rank", "target", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("k"))
         .select("source", "source_rank", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient")))
    won = global_row_number(q, [F.col("quotient").desc(), F.col("source_rank")]).where(F.col("row_number") <= n)
    return (won.groupBy("source", "source_rank", F.floor((F.col("row_number") - 1) / blocks_per_shard).alias("shard"))
            .agg(F.count(F.lit(1)).alias("blocks")))


def _positions(rows: DataFrame, cell_rows: int) -> DataFrame:
    """Adds ``start``: where the row's words begin in its source's stream,
    rows of a source lying in md5 order.  Rows before a cell come from a
    histogram of md5 prefixes, the rest from a window inside the cell."""
    n = rows.count()
    digits = 1
    while 16 ** digits * cell_rows < n:
        digits += 1
    x = rows.withColumn("cell", F.substring("h", 1, digits))
    hist = x.groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select("source_key", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("source_key", "cell").orderBy("h", F.col("doc_id").isNull(), "doc_id", "size", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (x.join(hist, ["source_key", "cell"])
            .withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))))


def block_lengths(total: int, sources: int, mix_blocks: int = MIX_BLOCKS) -> list[int]:
    """Words of a block on each level, from the whole mix's blocks to words."""
    lengths = [max(1, -(-total // max(mix_blocks, BLOCKS_PER_SOURCE * sources)))]
    while lengths[-1] > 1:
        lengths.append(-(-lengths[-1] // NESTED))
    return lengths


def word_quotas(targets: DataFrame, lengths: list[int], blocks_per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """``targets`` with ``quota``, the words that each source gives.

    One apportionment for all sources, level by level: the blocks of a level
    go to the highest quotients of what the sources still miss.  A source keeps
    all but its last block (never more than it misses); what that leaves of all
    targets is apportioned anew in the next level's blocks, so a source's words
    come within about a word of its target, whatever its size."""
    state = targets.withColumn("quota", F.lit(0).cast("long")).withColumn("miss", F.col("target"))
    for level, length in enumerate(lengths):
        won = (quotas(state.select("source", "source_rank", F.col("miss").alias("target")), length, blocks_per_shard)
               .groupBy("source_rank").agg(F.sum("blocks").alias("blocks")))
        blocks = F.coalesce("blocks", F.lit(0))
        if level < len(lengths) - 1:
            blocks = F.least(F.greatest(blocks - 1, F.lit(0)), F.floor(F.col("miss") / length))
        state = state.join(won, "source_rank", "left").withColumn("quota", F.col("quota") + (blocks * length).cast("long"))
        state = reliable(state.withColumn("miss", F.col("target") - F.col("quota")).drop("blocks"))
    return state.drop("miss")


def _selection(plan: DataFrame, lengths: list[int], seed: str) -> DataFrame:
    """Per source and level the blocks that its last, broken pass gives.

    The pass's words are cut into blocks of the level's length (the last may be
    short), and in a seeded order as many are given as the rest of the quota
    holds.  The next block of that order is cut again on the next level.
    ``levels`` is an array of (base, size, length, n, k, mult, shift): block j of
    the n that begin at ``base`` is given if (j * mult + shift) mod n < k."""
    rest, base, size, levels = F.col("rest"), F.lit(0).cast("long"), F.col("source_size"), []
    for level, length in enumerate(lengths):
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("source_rank").cast("string"), F.lit(str(level)))), 1, 7),
                      16, 10).cast("long")
        plan = (plan.withColumn("_shift", draw).withColumn("_base", base).withColumn("_size", size).withColumn("_rest", rest)
                .withColumn("_n", F.greatest(F.ceil(F.col("_size") / length), F.lit(1)).cast("long"))
                .withColumn("_mult", F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (draw % len(PRIMES) + 1).cast("int"))))
        short = F.col("_n") * length - F.col("_size")
        at = lambda j: F.pmod(j * F.col("_mult") + F.col("_shift"), F.col("_n"))
        with_short = F.floor((F.col("_rest") + short) / length).cast("long")
        plan = plan.withColumn("_k", F.when(at(F.col("_n") - 1) < with_short, with_short)
                               .otherwise(F.floor(F.col("_rest") / length)).cast("long"))
        plan = plan.withColumn("_level", F.struct(
            F.col("_base").alias("base"), F.col("_size").alias("size"), F.lit(length).cast("long").alias("length"), F.col("_n").alias("n"),
            F.col("_k").alias("k"), F.col("_mult").alias("mult"), F.col("_shift").alias("shift")))
        given = F.col("_k") * length - F.when(at(F.col("_n") - 1) < F.col("_k"), short).otherwise(0)
        after = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda j: at(j) == F.col("_k"))
        plan = reliable(plan.withColumn("_next", F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(0).cast("long")))
                        .withColumn(f"level{level}", F.col("_level")).withColumn("_left", F.col("_rest") - given))
        levels.append(f"level{level}")
        rest = F.col("_left")
        base = F.col("_base") + F.col("_next") * length
        size = F.greatest(F.least(F.lit(length).cast("long"), F.col("_size") - F.col("_next") * length), F.lit(0).cast("long"))
    return plan.withColumn("levels", F.array(*levels))


def _given(level: Column) -> Column:
    """Words that a level's given blocks share with [start, end)."""
    lo, hi = F.greatest(F.col("start"), level["base"]), F.least(F.col("end"), level["base"] + level["size"])
    given = lambda j: F.pmod(j * level["mult"] + level["shift"], level["n"]) < level["k"]
    inside = lambda j: (F.least(hi, level["base"] + (j + 1) * level["length"])
                        - F.greatest(lo, level["base"] + j * level["length"]))
    first, last = F.floor((lo - level["base"]) / level["length"]), F.floor((hi - 1 - level["base"]) / level["length"])
    none = F.lit(0).cast("long")
    return F.when((hi > lo) & (level["k"] > 0), F.aggregate(
        F.sequence(first, last), none, lambda acc, j: acc + F.when(given(j), inside(j)).otherwise(none))).otherwise(none)


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, mix_blocks: int = MIX_BLOCKS,
        blocks_per_shard: int = BLOCKS_PER_SHARD, cell_rows: int = CELL_ROWS, seed: str = SEED,
        carry: list[str] | None = None) -> DataFrame:
    """``row`` (the row itself, or its columns ``carry``) with size,
    source_size, target and taken.

    Each source has a quota of words by Sainte-Lague (``word_quotas``).  Its
    words, rows in seeded md5 order, come in whole passes first; the rest comes
    in blocks of the last pass, chosen in a seeded order (``_selection``).
    ``taken`` counts the words of a row in what is given.

    A null or blank text has size 0 and takes 0; null is a source of its own;
    repeated rows are rows of their own; an empty table gives no rows."""
    ensure_checkpoint_dir(docs.sparkSession)
    text, source, doc_id = F.col("text"), F.col("source"), F.col("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    base = docs.select(
        row.alias("row"), doc_id, word_count(text).alias("size"), source,
        F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("source_key"), F.xxhash64(text).alias("tie"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("h"))
    if carry is not None:  # narrow rows: words are counted once
        base = stored(base, "mix-rows")
    sizes = base.select("source", "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = reliable(source_targets(sizes, weights, max_repeats))
    total, m = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    lengths = block_lengths(total, m, mix_blocks)
    quota = F.least(F.col("quota"), F.col("source_size") * max_repeats)
    plan = (word_quotas(targets, lengths, blocks_per_shard)
            .select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("source_key"), "source_rank",
                    "source_size", "target", quota.alias("quota"),
                    F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long").alias("passes"))
            .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")))
    plan = _selection(plan, lengths, seed).select("source_key", "source_size", "target", "passes", "levels")
    out = _positions(base, cell_rows).join(plan, "source_key").withColumn("end", F.col("start") + F.col("size"))
    part = sum((_given(F.col("levels")[i]) for i in range(len(lengths))), F.lit(0).cast("long"))
    return out.select("row", "size", "source_size", "target",
                      (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row comes as many
    whole times as its taken words hold its text; a broken part gives one
    more time with that probability, drawn from the seeded md5 of its id, so
    that the words of a source stay near its target.  Rows without words are
    not part of a mix."""
    share = F.col("taken") / F.col("size")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-draw"), F.col("row.doc_id").cast("string"),
                                                F.xxhash64("row.text").cast("string"))), 1, 8), 16, 10).cast("double")
    times = F.floor(share + draw / float(1 << 32)).cast("int")
    taken = mix(docs, seed=seed, **options).where("taken > 0")
    return unpacked(taken.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))
                                                       .otherwise(F.array().cast("array<int>")))))
