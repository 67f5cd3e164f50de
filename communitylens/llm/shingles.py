"""Words and word shingles as 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WIDTH = 5
#: Bytes of text hashed at a time; keeps the arrays in the processor's cache.
BATCH_BYTES = 600_000

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case; null has none.
    ``bytes.split`` cuts at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word."""
    n = len(h) - k + 1
    out = np.full(n, _U(k), dtype=np.uint64)
    for i in range(k):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[i:i + n])
    return out


def shingle_batch(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, one text after the other, and how many
    each has: one for each run of ``width`` words.  A text of fewer words is
    one shingle, a text without words has none."""
    each = [word_hashes(words(t)) for t in texts]
    lens = np.array([len(h) for h in each], dtype=np.int64)
    counts = np.where(lens >= width, lens - width + 1, np.minimum(lens, 1))
    flat = np.concatenate(each) if each else np.zeros(0, _U)
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    if len(flat) >= width:
        rolled = _rolled(flat, width)
        long = lens >= width
        first = np.concatenate(([0], np.cumsum(lens)))[:-1][long]
        n = counts[long]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        out[np.repeat(long, counts)] = rolled[at]
    short = np.flatnonzero((lens > 0) & (lens < width))
    if len(short):
        begin = np.cumsum(counts) - counts
        for i in short:
            out[begin[i]] = _rolled(each[i], len(each[i]))[0]
    return out, counts


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(hashes)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def in_batches(texts: Iterable[str | None], size: int = BATCH_BYTES) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters, at least one text each."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
