"""Byte-level BPE against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from communitylens.llm import byte_bpe as bb

RANKS = bb.read_vocabulary(P.path("byte_bpe_50k.tiktoken"))
BPE = bb.ByteBPE(RANKS, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
ALPHABET = "abcdeéñ \t\n\r\x0b\x0c\x1c\x1f\x85 ​　'strem19٣!.,!#aaaa日本語😀\x00<|endoftext|>"


def ids(text):
    return np.frombuffer(BPE.encode_batch([text])[0], dtype="<u4").tolist()


def test_random_texts_equal_the_library():
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        assert ids(t) == REF.encode_ordinary(t)
        assert BPE.decode(BPE.encode_batch([t])[0]) == t.encode()


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 9000, "the" * 7000, " " * 3001, "é" * 4000, "=" * 2049])
def test_very_long_pre_tokens(text):
    assert ids(text) == REF.encode_ordinary(text)


def test_long_random_pre_token():
    rng = random.Random(2)
    t = "".join(rng.choice("abcdest") for _ in range(60_000))
    assert ids(t) == REF.encode_ordinary(t)


def test_plain_rule_equals_the_queue():
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abehinorst") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    for p, got in zip(pieces, BPE.merge_all(pieces)):
        assert got.tolist() == BPE.merge_one(p)


def test_documents(spark):
    texts = ["plain text here", None, "", "ünï 日本 \n\n x", "z" * 200_000, "plain text here"]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bb.round_trip(df, RANKS, P.PATTERN).collect()}
    want = set()
    for d, t, *_ in rows:
        e = REF.encode_ordinary(t or "")
        want.add((d, len(e), hashlib.sha256(np.array(e, dtype="<u4").tobytes()).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bb.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
    assert {r.n_tokens for r in bb.encode_documents(df, RANKS, P.PATTERN).collect()} == {w[1] for w in want}
