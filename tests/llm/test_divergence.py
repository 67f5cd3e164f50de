"""Source divergences against a plain count in exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from communitylens.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n int, p string, tid string, kept string"


def documents(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("wo", "É", "ña", "ZU", "q") for b in ("rd", "Na", "", "é", "xx", "yy")]
    for i in range(n):
        lang = rng.choices(["en", "fr", None, ""], [6, 2, 1, 1])[0]
        source = rng.choices(["hot", "b", "ü", None, "rare"], [8, 2, 2, 1, .3])[0]
        text = None if rng.random() < .03 else "".join(rng.choice(words) + rng.choice([" ", "3", "--", "_", "\x00", "\x7f", "{"])
                                                      for _ in range(rng.randint(0, 20)))
        yield i, text, lang, source, 1, "p", "t", "k"


def brute(data, min_docs, top):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang in {g for g, _ in counts}:
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        both = sum(groups.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in groups.items()}, shares(both)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            apart = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(apart)}
    return out


@pytest.mark.parametrize("source_block,term_block", [(32, 4096), (2, 3), (1, 1)])
def test_equals_plain_counts(spark, source_block, term_block):
    data = list(documents(1, 400))
    data += [(9000, "only ones", "xx", "a", 1, "", "", ""), (9001, "", "xx", "b", 1, "", "", ""),  # a language that keeps no term
             (9002, "word " * 60_000, "en", "long", 1, "", "", ""), data[0], data[0]]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = dv.audit(df, min_docs=10, top_terms=4, source_block=source_block, term_block=term_block).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(data, 10, 4)


def test_counts_are_the_same_when_tasks_flush_often(spark):
    df = spark.createDataFrame(list(documents(2, 200)), SCHEMA)
    a, b = (set(map(tuple, dv.term_counts(df, flush).collect())) for flush in (5, 10 ** 6))
    assert a == b


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n, total, kept = 8_999_999_999_999, 9_123_456_789_012_345, 77
    got = spark.range(1).select(dv.share(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 1000000000 * (n + 2) // (total + 2 * kept)


def test_empty_table(spark):
    assert dv.audit(spark.createDataFrame([], SCHEMA)).count() == 0
