"""The k most similar vectors of every vector, by cosine.

Similarities are computed in cells of two bounded blocks of vectors, one
matrix product a cell; a cell hands on each vector's k best only, and the best
of all cells are merged.  The exact form compares all blocks with each other;
the sketched form only the blocks of each bucket of random-hyperplane bits.
Never are all pairs made as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors on a side of a cell, about (blocks are by hash).
BLOCK = 4096
#: Bits of a bucket's name and bands of such names: of a pair at cosine 0.9
#: the bits of one band agree with 0.31, those of one band of 24 with 0.9998.
BITS, BANDS = 8, 24
_BEST = "id long, other long, cosine double"


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of length 1; one without a length, or with a null or
    NaN in it, is left out, since it has no cosine with any other."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), norm.alias("norm")).where("norm > 0 AND NOT isnan(norm)")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _best(cos: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n largest of each row of ``cos``, equal ones by
    ``ids``; -inf is none."""
    cut = np.partition(cos, cos.shape[1] - n, axis=1)[:, cos.shape[1] - n]
    row, col = np.nonzero((cos >= cut[:, None]) & (cos > -np.inf))
    order = np.lexsort((ids[col], -cos[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n]


def _cell(k: int):
    def run(cell: pa.Table) -> pa.Table:
        ids, block = cell.column("id").to_numpy(), cell.column("block").to_numpy()
        lists = cell.column("v").combine_chunks()
        widths = np.unique(lists.value_lengths().to_numpy())
        if len(widths) > 1:
            raise ValueError(f"vectors of different lengths: {widths.tolist()}")
        vectors = lists.flatten().to_numpy().reshape(len(ids), -1)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        out: list[list[np.ndarray]] = [[], [], []]
        for rows, cols in {(i, j), (j, i)}:
            a, b = np.flatnonzero(block == rows), np.flatnonzero(block == cols)
            if not len(a) or not len(b):
                continue
            right, names = vectors[b].T, ids[b]
            for at in range(0, len(a), 256):
                part = a[at:at + 256]
                # rounded, so that equal cosines tie whatever the order of the sum
                cos = np.round(vectors[part] @ right, 9) + 0.0
                cos[ids[part][:, None] == names[None, :]] = -np.inf
                r, c = _best(cos, names, min(k, len(b)))
                for to, x in zip(out, (ids[part][r], names[c], cos[r, c])):
                    to.append(x)
        one = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("id", "other", "cosine"), one, (pa.int64(), pa.int64(), pa.float64()))})
    return run


def _best_of_cells(rows: DataFrame, k: int, block: int) -> DataFrame:
    """``rows`` (bucket, id, v): the k best of every id among those that share
    a bucket with it.  A bucket is cut into blocks by its size, so a bucket
    with a third of all vectors has more cells, not larger ones."""
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    n = F.ceil(F.col("n") / block).cast("int")
    dealt = (rows.join(size, "bucket").where("n > 1")
             .select("bucket", "id", "v", n.alias("blocks"), F.pmod(F.xxhash64("id"), n).cast("int").alias("block"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cells = dealt.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "v")
    found = cells.groupBy("bucket", "i", "j").applyInArrow(_cell(k), _BEST)
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    return (found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def nearest_exact(vectors: DataFrame, k: int = 10, block: int = BLOCK, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, other, cosine, rank): the k most similar other vectors, equal
    cosines by id.  Work is the square of the vectors, rows are k a vector and
    block.  Fewer than k others give fewer rows; no vectors give none."""
    return _best_of_cells(unit_vectors(vectors, id_col, vector_col).withColumn("bucket", F.lit(0).cast("long")), k, block)


def nearest_sketched(vectors: DataFrame, k: int = 10, bits: int = BITS, bands: int = BANDS, block: int = BLOCK, seed: int = 16,
                     id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """As ``nearest_exact``, among the vectors that have the same side of all
    ``bits`` random hyperplanes in one of the ``bands``; cosines are exact.
    Every vector is in every band."""
    units = unit_vectors(vectors, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lists = b.column("v").to_pylist()
            names = np.empty((len(lists), bands), dtype=np.int64)
            widths = np.array([len(x) for x in lists])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                p = planes.setdefault(int(width), np.random.default_rng(seed).standard_normal((bands * bits, int(width))))
                side = (np.array([lists[x] for x in at]) @ p.T > 0).reshape(len(at), bands, bits)
                names[at] = side @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.list_(pa.int64())), b.column("id"), b.column("v")], names=["buckets", "id", "v"])
    sketched = units.mapInArrow(run, "buckets array<long>, id long, v array<double>")
    return _best_of_cells(sketched.select(F.explode("buckets").alias("bucket"), "id", "v"), k, block)
