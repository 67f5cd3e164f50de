"""Context-tree weighting against the textbook recursion."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from communitylens.llm import context_tree as ct

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["The cat sat on the mat", "the  dog\tsat", "A cat!", "", None, " \n ", "été là-bas, été", "mat mat mat mat",
         "x" * 300, "dog on mat " * 200, "the cat sat on the mat"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """All 255 context trees as dictionaries: (context, node) -> [zeros, ones]."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            data = b"\n" * depth + " ".join(words(t)).encode() + b"\n"
            for i in range(depth, len(data)):
                for node, bit in self.path(data[i]):
                    for d in range(depth + 1):
                        ctx = data[i - d:i]
                        self.n[ctx, node][bit] += 1
                        if d:
                            self.kids[ctx[1:], node].add(ctx)
        self.memo = {}

    @staticmethod
    def path(byte):
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield node, bit
            node = node * 2 + bit

    def log_w(self, ctx, node):
        if (ctx, node) not in self.n:
            return 0.0
        if (ctx, node) not in self.memo:
            e = kt(*self.n[ctx, node])
            if len(ctx) == self.depth:
                self.memo[ctx, node] = e
            else:
                below = sum(self.log_w(c, node) for c in self.kids[ctx, node])
                self.memo[ctx, node] = math.log(.5) + max(e, below) + math.log1p(math.exp(-abs(e - below)))
        return self.memo[ctx, node]

    def p(self, context, node, bit):
        """Ratio of weighted probabilities with one more bit, top down."""
        def ratio(d):
            ctx = context[len(context) - d:]
            a, b = self.n[ctx, node] if (ctx, node) in self.n else (0, 0)
            own = ((b if bit else a) + .5) / (a + b + 1)
            if d == self.depth:
                return own
            e, w = kt(a, b) if a + b else 0.0, self.log_w(ctx, node)
            part = math.exp(math.log(.5) + e - w)
            return part * own + (1 - part) * ratio(d + 1)
        return ratio(0)

    def score(self, t):
        data = b"\n" * self.depth + " ".join(words(t)).encode() + b"\n"
        return sum(math.log10(self.p(data[i - self.depth:i], node, bit))
                   for i in range(self.depth, len(data)) for node, bit in self.path(data[i]))


@pytest.mark.parametrize("depth", [3, 5])
def test_scores_equal_the_recursion(spark, depth):
    rows = [(i + 1, t, "en", "s", 1) for i, t in enumerate(TEXTS * 2)] + [(None, "no id", None, None, None)]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows]
    assert any(held)
    train = [r[1] for r, h in zip(rows, held) if not h]
    tree = Tree(train, depth)
    c = Counter(w for t in train for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS chunk", "'w' AS word", "0L AS gram")
    got = ct.score_documents(df, depth=depth, chunk_chars=900, part_grams=300).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for (d, t, *_), h in zip(rows, held):
        r, ws = by_id[d], [*words(t), "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(tree.score(t), rel=1e-7)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_a_context_gives_a_distribution():
    grams, n = ct._counted(ct.gram_keys([ct.normal_bytes("abra cadabra abra")], 4)[0])
    for context in (b"abra", b"zzzz", b"\n\n\n\n"):
        ask = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], dtype=np.uint64)
        keys, counts = ct._merge_counts([(grams, n), (ask, np.zeros(256, np.int64))])
        p = 10 ** ct.log10_probabilities(keys, counts, 4)
        assert p[np.isin(keys, ask)].sum() == pytest.approx(1.0)


def test_no_rows_and_nothing_trained(spark):
    assert ct.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ct.score_documents(spark.createDataFrame([(held, "ab", "", "", 2)], SCHEMA)).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0
    assert r.score == pytest.approx(-3 * math.log10(256))


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 77.5, 1e5 + 0.5])
    assert ct.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-8)


def test_items_of_a_chunk_in_batches_and_blocks():
    long = " ".join(f"w{i % 977} äx" for i in range(130_000))
    assert len(long) > ct.BLOCK_CHARS
    texts, train = [long, "", "w1 w2", long + "?", "only here"], [True, True, False, False, True]
    rows = pa.table({"chunk": pa.array([7] * 5, pa.int32()), "text": texts, "train": train})
    got = list(ct._distinct_items(5)(iter(rows.to_batches(max_chunksize=2))))
    grams, ws = Counter(), Counter()
    for t, f in zip(texts, train):
        data = b"\n" * 5 + ct.normal_bytes(t)
        g, w = Counter(data[i:i + 6] for i in range(len(data) - 5)), Counter([*words(t), "\n"] if f else words(t))
        for total, part in ((grams, g), (ws, w)):
            total.update(part if f else dict.fromkeys(part, 0))
    items = pa.Table.from_batches(got).to_pylist()
    assert {r["chunk"] for r in items} == {7} and max(b.num_rows for b in got) <= ct.BATCH_ROWS
    assert {r["gram"].to_bytes(6, "big"): r["n"] for r in items if r["word"] is None} == dict(grams)
    assert {r["word"].decode(): r["n"] for r in items if r["gram"] is None} == dict(ws)
    assert len(items) == len(grams) + len(ws)


def test_a_text_longer_than_a_block_is_scored_whole(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    kept = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10]
    long = " ".join(f"{t} {i % 50}" for i, t in enumerate(TEXTS * 500) if t)
    assert len(long) > ct.BLOCK_CHARS
    rows = [(held, long, "", "", 1), *((i, t, "", "", 1) for i, t in zip(kept, TEXTS))]
    got = ct.score_documents(spark.createDataFrame(rows, SCHEMA), depth=3).filter(f"doc_id = {held}").first()
    tree, data = Tree(TEXTS, 3), b"\n" * 3 + ct.normal_bytes(long)
    grams = Counter(data[i - 3:i + 1] for i in range(3, len(data)))
    want = sum(k * math.log10(tree.p(g[:3], node, bit)) for g, k in grams.items() for node, bit in tree.path(g[3]))
    assert (got.held_out, got.n_bytes) == (True, len(data) - 3)
    assert got.score == pytest.approx(want, rel=1e-9)
