"""Byte-level BPE encoding and decoding with a rank-bucket queue.

The bytes of pre-tokens form linked lists.  Every adjacent pair that the
vocabulary knows lies in the bucket of its merge rank, and a bitmap of three
levels, 64 ways each, says which buckets hold something: find-first-set gives
the next rank in three steps however long the lists are, so a very long
pre-token needs no special case.  Entries go stale when a neighbour merges
first and are skipped when popped.

Spark deals the texts out; the vocabulary (a few MB at most) goes along with the task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from communitylens.llm.u64map import U64Map

#: Texts are cut here first: a run without white space and one space before
#: it never shares a pre-token with what stands around it.  So it is with the
#: pattern of ``public_tokenizers``; one whose matches span white space inside
#: (several words, or several spaces before one) must not be given.
CHUNK = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Chunks remembered by a worker, and characters encoded at a time.
MEMO = 400_000
BATCH_CHARS = 4_000_000


class RankQueue:
    """Arrays of linked-list positions in a bucket for each merge rank; ``pop``
    takes the whole bucket of the lowest rank that holds something."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Files each position under its rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for rank, part in zip(ranks[first].tolist(), np.split(positions, first[1:])):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.buckets[rank] = [part]
                self.low[rank >> 6] |= 1 << (rank & 63)
                self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                self.top |= 1 << (rank >> 12)
            else:
                bucket.append(part)

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        w = self.mid[a]
        b = a << 6 | (w & -w).bit_length() - 1
        w = self.low[b]
        rank = b << 6 | (w & -w).bit_length() - 1
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank).

    ``pattern`` cuts a text into pre-tokens.  One queue serves all new
    pre-tokens of a batch side by side: they are independent, so the lowest
    rank of all is the next merge of every pre-token that has it."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.chunks: dict[str, bytes] = {}
        self._pair_table()

    def _pair_table(self) -> None:
        """(left id, right id) -> rank for every way to cut a token in two."""
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pair_map = U64Map(np.array([k for k, _ in pairs], dtype=np.uint64))
        self.pair_rank = np.array([r for _, r in pairs] + [-1], dtype=np.int32)  # -1: not found

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, -1 where the vocabulary has none."""
        return self.pair_rank[self.pair_map.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))]

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, one merge at a time (the plain rule)."""
        ids = [piece[i:i + 1] for i in range(len(piece))]
        while len(ids) > 1:
            rank, i = min((self.ranks.get(ids[i] + ids[i + 1], self.size), i) for i in range(len(ids) - 1))
            if rank == self.size:
                break
            ids[i:i + 2] = [ids[i] + ids[i + 1]]
        return [self.ranks[t] for t in ids]

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every pre-token."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is None:
                todo.append(i)
            else:
                out[i] = np.array([whole], dtype="<u4")
        if not todo:
            return out
        lens = np.array([len(pieces[i]) for i in todo])
        stop = np.cumsum(lens)
        start = stop - lens
        tok = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in todo), dtype=np.uint8)]
        n = len(tok)
        owner = np.repeat(np.arange(len(todo), dtype=np.int32), lens)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[stop - 1] = -1
        prv[start] = -1
        alive = np.ones(n, dtype=bool)
        pair = np.full(n, -1, dtype=np.int32)
        has = np.flatnonzero(nxt >= 0)
        pair[has] = self.pair_ranks(tok[has], tok[has + 1])
        queue, again = RankQueue(self.size), set()
        has = np.flatnonzero(pair >= 0)
        if len(has):
            queue.push(pair[has], has)
        while (got := queue.pop()) is not None:
            rank, at = got
            at = np.unique(at[pair[at] == rank])  # the rest is stale: a neighbour merged first
            if not len(at):
                continue
            if len(at) > 1:
                # where merges overlap, the leftmost one wins, then every second
                first = np.concatenate(([True], nxt[at[:-1]] != at[1:]))
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at], alive[gone], pair[gone], nxt[at] = rank, False, -1, after
            pair[at] = -1
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            changed = np.unique(np.concatenate((at[after >= 0], before[before >= 0])))
            if not len(changed):
                continue
            ranks = self.pair_ranks(tok[changed], tok[nxt[changed]])
            pair[changed] = ranks
            good = ranks >= 0
            if good.any():
                ranks, changed = ranks[good], changed[good]
                if ranks.min() < rank:  # a merge that should have come before others of this bucket
                    again.update(owner[changed[ranks < rank]].tolist())
                queue.push(ranks, changed)
        ids, kept = tok[alive].astype("<u4"), np.concatenate(([0], np.cumsum(alive)))
        for k, i in enumerate(todo):
            out[i] = ids[kept[start[k]]:kept[stop[k]]]
        for k in again:
            out[todo[k]] = np.array(self.merge_one(pieces[todo[k]]), dtype="<u4")
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks that are new."""
        cut = [self.pattern.findall(c) for c in chunks]
        names = list({p for c in cut for p in c})
        ids: dict[str, bytes] = {}
        batch, size = [], 0
        for i, name in enumerate(names):
            batch.append(name)
            size += len(name)
            if size >= BATCH_CHARS or i == len(names) - 1:
                got = self.merge_all([p.encode("utf-8", "surrogatepass") for p in batch])
                ids.update(zip(batch, (x.tobytes() for x in got)))
                batch, size = [], 0
        for c, parts in zip(chunks, cut):
            self.chunks[c] = ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        cut = [CHUNK.findall(t) if t else [] for t in texts]
        new = set()
        for parts in cut:
            new.update(parts)
        new.difference_update(self.chunks)
        if new:
            self._learn(list(new))
        get = self.chunks.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def encode_stream(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """As ``encode_batch``, some millions of characters at a time."""
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= BATCH_CHARS:
                yield from self.encode_batch(held)
                held, size = [], 0
        yield from self.encode_batch(held)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _made(rank_file: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(rank_file, pattern)


@contextmanager
def encoder(rank_file: bytes, pattern: str) -> Iterator[ByteBPE]:
    """The worker process's encoder for a vocabulary; what it remembers of
    texts goes when the task ends, so that idle workers stay small."""
    bpe = _made(rank_file, pattern)
    try:
        yield bpe
    finally:
        bpe.chunks.clear()


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary) per row; a null text has no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(rank_file, pattern) as bpe:
            for b in batches:
                ids = list(bpe.encode_stream(t.as_py() for t in b.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Encode every whole text, decode its ids again: doc_id, n_tokens,
    ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (decoded bytes).

    A null or empty text has no tokens; null ids and repeated rows pass
    through, one result row for each row; further columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(rank_file, pattern) as bpe:
            for b in batches:
                n, a, d = [], [], []
                for ids in bpe.encode_stream(t.as_py() for t in b.column("text")):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
