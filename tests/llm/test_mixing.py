"""Source mixing: targets, apportionment, and words taken."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from communitylens.llm import mixing as mx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        s = rng.choices(["a", "b", "c", "Z", "é", None, "tiny"], [40, 8, 4, 2, 2, 2, .2])[0]
        out.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), "en", s, None))
    return out + [(None, "no id here", None, "a", None), (5000, None, "", "b", 0), (5001, "  \n", "", "only blank", 0),
                  (5002, "w " * 30_000, "", "c", 0), out[3], out[3]]


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        got = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and got[s] > 3 * sizes[s]}
        if not over:
            return got
        capped |= over


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS size", "2 AS start", "'c' AS cell").repartition(5)
    got = mx.mix(df, mix_blocks=4000, blocks_per_shard=64, cell_rows=20, carry=["doc_id", "source"]).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.row.source] = taken.get(r.row.source, 0) + r.taken
    block = -(-sum(sizes.values()) // 4000)
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * block
    again = mx.mix(df.repartition(2), mix_blocks=4000, blocks_per_shard=64, cell_rows=20, carry=["doc_id", "source"])
    order = lambda x: sorted(map(str, x))
    assert order(again.collect()) == order(got)


@pytest.mark.parametrize("weights", [mx.WEIGHTS, (5000, 3, 1)])
def test_small_sources_take_their_targets(spark, weights):
    """A long tail beside a hot source, capped at its repeats or by its weight."""
    tail = {f"t{k:02}": n for k, n in enumerate([1, 2, 3, 7, 20, 55, 150, 400, 900, 2500])}
    data = [(i, "w " * 100, "en", "hot", None) for i in range(6000)]
    for s, n in tail.items():
        data += [(len(data) + j, "w " * min(9, n - at), "en", s, None) for j, at in enumerate(range(0, n, 9))]
    got = mx.mix(spark.createDataFrame(data, SCHEMA), weights=weights, carry=["source"]).groupBy("row.source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == len(tail) + 1
    for r in got:
        assert r.target > 0 and abs(r.taken - r.target) <= max(0.5, 0.03 * r.target), r


def test_small_sources_stay_in_the_mix(spark):
    data = [(i, "w " * 300, "en", "hot", 1) for i in range(3000)] + [(3000, "one two", "en", "tail", 1)]
    out = mx.mixed_rows(spark.createDataFrame(data, SCHEMA))
    assert out.where("source = 'tail'").count() == 3


def test_quotas_are_sainte_lague(spark):
    want = {"a": 5310.0, "b": 902.5, "c": 77.0, "d": 0.0, "e": 33.3}
    df = spark.createDataFrame([(s, i + 1, t) for i, (s, t) in enumerate(want.items())],
                               "source string, source_rank long, target double")
    got = mx.quotas(df, 13, 50).collect()
    n = round(sum(want.values()) / 13)
    heap = [(-t, i, s, 0) for i, (s, t) in enumerate(want.items()) if t]
    heapq.heapify(heap)
    shards = {}
    for k in range(n):
        q, i, s, won = heapq.heappop(heap)
        shards[s, k // 50] = shards.get((s, k // 50), 0) + 1
        heapq.heappush(heap, (-want[s] / (2 * won + 3), i, s, won + 1))
    assert {(r.source, r.shard): r.blocks for r in got} == shards


def test_mixed_rows_follow_the_targets(spark):
    data = [(i, "w " * 20, "en", "ab"[i % 10 == 0], 1) for i in range(4000)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("taken", F.lit(1))
    out = mx.mixed_rows(df)
    assert out.columns == df.columns
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 4000 * 5 / 7) < 40 and abs(n["b"] - 4000 * 2 / 7) < 40


def test_empty_and_blank(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mx.mix(empty).count() == 0 and mx.mixed_rows(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", "", "s", 0)], SCHEMA)
    assert [(r.size, r.taken) for r in mx.mix(blank).collect()] == [(0, 0), (0, 0)]
    assert mx.mixed_rows(blank).count() == 0
