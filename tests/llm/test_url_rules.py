"""URL rules: parts, stated rules, and mining against all token subsets."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from communitylens.llm import url_rules as ur

SCHEMA = "page_id long, url string, host string, verdict string, tokens string, id string"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def stated(host, path):
    fit = [(h + p, v) for h, p, v in ur.STATED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


def tokens(url):
    host, path = parts(url)
    rest = url.split("://", 1)[1] if "://" in url else ""
    query = re.match(r"[^?#]*(?:\?([^#]*))?", rest)[1] or ""
    plain = lambda mark, xs: {mark + re.sub("[0-9]+", "0", x) for x in xs if x}
    return plain("h:", host.split(".")) | plain("p:", path.split("/")) | plain("q:", (x.split("=")[0] for x in query.split("&")))


def brute(urls, min_support, min_confidence):
    labelled = [(tokens(u), stated(*parts(u))[1]) for u in urls if u is not None and stated(*parts(u))[1]]
    n = len(labelled)
    met = {}
    for k, (ts, _) in enumerate(labelled):
        for t in ts:
            met.setdefault(t, []).append(k)
    keep = {}
    for t in sorted(t for t, at in met.items() if len(at) >= min_support * n):
        keep.setdefault(tuple(met[t]), t)
    items, sub, both = set(keep.values()), Counter(), Counter()
    for ts, v in labelled:
        for size in range(1, len(ts & items) + 1):
            for s in itertools.combinations(sorted(ts & items), size):
                sub[s] += 1
                both[s, v] += 1
    rules = [(-c / sub[s], -c, len(s), s, v) for (s, v), c in both.items() if c >= min_support * n and c / sub[s] >= min_confidence]
    out = []
    for u in urls:
        host, path = parts(u)
        rule, verdict = stated(host, path)
        if verdict is None:
            fit = [r for r in rules if u is not None and set(r[3]) <= tokens(u)]
            verdict = min(fit)[4] if fit else ur.DEFAULT
        out.append((u, host, path, rule, verdict))
    return Counter(out)


def urls(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        host = rng.choice(["", "www.", "WWW.", "m."]) + rng.choice(["ex", "example", "shop", "spam"]) + rng.choice([".com", ".net", ".org", "", ".COM:80"])
        path = rng.choice(["", "/", "/en/", "/es/", "/fr/", "/en"]) + rng.choice(["", "7", "a/b12", "x//y"])
        yield rng.choice(["http://", "https://", "HTTP://"]) + host + path + rng.choice(["", "?a=1&b", "#top", "?u=http://x.com/en/"])


def test_equals_subset_counts(spark):
    us = list(urls(1, 500)) + [None, "", "no scheme", "://", "x://?q", "a://b://c.com/", "http://example.com", "http://EXAMPLE.com/en/",
                               "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://xexample.com/en/",
                               "http://h.org/" + "/".join(f"s{'x' * k}" for k in range(400)), "http://long.org/" + "a" * 200_000]
    us += ["http://hot.net/es/" + "/".join("abcdefghijklmnopqrstuvwxyz")] * 300  # copies with many tokens: one item, not 2^26 sets
    df = spark.createDataFrame([(i, u, "h", "v", "t", "i") for i, u in enumerate(us)], SCHEMA).repartition(3)
    got = ur.filter_urls(df, min_support=0.02).select("row.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(us)
    assert Counter(map(tuple, got)) == brute(us, 0.02, ur.MIN_CONFIDENCE)


def test_needless_rules_go(spark):
    data = [(f"http://{h}/{p}", v) for h, p, v, n in [("bad.x", "q", "block", 20), ("bad.x", "r", "block", 20), ("ok.x", "q", "allow", 20)]
            for _ in range(n)]
    rules = ur.mine(spark.createDataFrame(data, "url string, verdict string"), 0.01, 0.8).collect()
    assert {(tuple(r.tokens), r.verdict) for r in rules} == {(("h:bad",), "block"), (("h:ok",), "allow"), (("p:r",), "block")}
    by_token = ur.index(spark.createDataFrame(rules)).select("token", F.size("tokens").alias("n")).collect()
    assert sorted(map(tuple, by_token)) == [("h:bad", 1), ("h:ok", 1), ("p:r", 1)]


def test_empty_and_unlabelled(spark):
    assert ur.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "http://a.org/x", "", "", "", ""), (2, None, "", "", "", "")], SCHEMA)
    assert {(r.row.page_id, r.host, r.verdict) for r in ur.filter_urls(df).collect()} == {(1, "a.org", "allow"), (2, "", "allow")}
