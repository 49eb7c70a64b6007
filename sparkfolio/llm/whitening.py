"""Whitening of embeddings from a bit-sliced scatter matrix.

1. Components become whole numbers; one pass finds the least and greatest of every dimension, and
   shifts each dimension so that its least value is 0 and few bits hold a value.
2. In blocks of rows, bit b of dimension d of all rows is packed into words (a plane).  The ones in
   the AND of two planes, weighted by their two bits' values, add up to the exact cross-product of two dimensions;
   the ones in a plane alone give its sum.  Partial sums meet in an aggregate by pair of dimensions.
3. The scatter is centred as whole numbers, n * sum(xy) - sum(x) * sum(y), and only then divided;
   ``eigh`` gives the components.
4. A last pass projects every row.  The covariance of what it wrote is aggregated (centred before
   multiplying) and compared with the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import written
from sparkfolio.llm.vectors import usable_rows, whole_numbers

#: Added to every whole number; it keeps those of ordinary embeddings positive and changes no covariance.
OFFSET = 100_000
#: Components up to this size keep planes below 50 bits.
MOST = float(1 << 38)
#: Rows of a block of planes.
ROWS = 1 << 14
#: Part of the largest eigenvalue below which one counts as zero.
TINY = 1e-12


def _ranges(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column("vector"), size) + OFFSET
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(size), pa.int32()), "low": pa.array(low), "high": pa.array(high)})
    return run


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Words (dimension, bit, word) of the bits of whole numbers >= 0 (row, dimension)."""
    n, size = shifted.shape
    words = -(-n // 64)
    planes = np.zeros((size, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((shifted >> b) & 1).astype(np.uint8), axis=0)
        planes[:, b, : len(packed)] = packed.T
    return planes.view(np.uint64)


def add_scatter(planes: np.ndarray, cross: np.ndarray, sums: np.ndarray) -> None:
    """Add the planes' ones by sum of bit numbers: ``cross[a + b, i, j]`` for i <= j, ``sums[b, i]``."""
    size, bits, _ = planes.shape
    sums += np.bitwise_count(planes).sum(axis=2, dtype=np.int64).T
    for i in range(size):
        for a in range(bits):
            ones = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)
            cross[a : a + bits, i, i:] += ones.T


def _scatter(low: np.ndarray, bits: int):
    size = len(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, sums, n = np.zeros((2 * bits - 1, size, size), np.int64), np.zeros((bits, size), np.int64), 0
        held: list[np.ndarray] = []

        def close() -> None:
            if held:
                add_scatter(bit_planes(np.concatenate(held), bits), cross, sums)
                held.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                held.append(whole_numbers(batch.column("vector").slice(k, ROWS), size) + OFFSET - low)
                n += len(held[-1])
                if sum(map(len, held)) >= ROWS:
                    close()
        close()
        if n:
            i, j = np.triu_indices(size)
            pairs = [sum(int(c) << s for s, c in enumerate(row)) for row in cross[:, i, j].T.tolist()]
            alone = [sum(int(c) << b for b, c in enumerate(row)) for row in sums.T.tolist()]
            yield pa.RecordBatch.from_pydict({
                "i": pa.array([*i, *range(size), -1], pa.int32()), "j": pa.array([*j, *[-1] * size, -1], pa.int32()), "total": pa.array([str(v) for v in (*pairs, *alone, n)], pa.string())})
    return run


def scatter(rows: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Exact n, sums and n * sum(xy) - sum(x) * sum(y) of all ``rows`` (vector)."""
    spans = rows.select("vector").mapInArrow(_ranges(size), "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    got = spans.orderBy("dim").collect()  # a row per dimension
    if not got:
        return 0, [], []
    low = np.array([r["low"] for r in got], np.int64)
    bits = max(1, max(r["high"] - r["low"] for r in got).bit_length())
    parts = rows.select("vector").mapInArrow(_scatter(low, bits), "i int, j int, total string")
    total = {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}  # a row per pair of dimensions
    n, sums = total[-1, -1], [total[i, -1] for i in range(size)]
    centred = [[n * total[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    return n, [s + n * int(v) for s, v in zip(sums, low, strict=True)], centred


def whitening_axes(n: int, centred: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns) by falling eigenvalue, their eigenvalues, and the trace of the covariance."""
    covariance = np.array([[c / (n * n) for c in row] for row in centred])  # whole numbers divided once, correctly rounded
    values, axes = np.linalg.eigh(covariance)
    return axes[:, ::-1][:, :most], values[::-1][:most], sum(centred[i][i] for i in range(len(centred))) / (n * n)


def _projected(size: int, n: int, sums: list[int], axes: np.ndarray, scale: np.ndarray):
    """vec_id, deviation and whitened components (null where ``scale`` is 0)."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)  # x - S / n = (x - base) - rest / n
    shift, usable = rest / n, np.flatnonzero(scale)
    basis = axes[:, usable] / scale[usable]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole_numbers(batch.column("vector"), size) + OFFSET - base
            centred = y - shift
            # modulo 2^64 the whole-number result is exact wherever it fits 63 bits
            exact = ((y.astype(np.uint64) * np.uint64(n) - rest.astype(np.uint64)) ** 2).sum(axis=1, dtype=np.uint64).astype(np.int64)
            fits = (centred * centred).sum(axis=1) * float(n) ** 2 < 2.0**63 * 0.999999
            white = centred @ basis
            columns = dict(zip(usable.tolist(), white.T, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(exact, mask=~fits), *(pa.array(columns[k]) if k in columns else pa.nulls(len(y), pa.float64()) for k in range(len(scale)))],
                names=["vec_id", "deviation", *(f"w{k + 1}" for k in range(len(scale)))])
    return run


def identity_error(white: DataFrame, n: int, names: list[str]) -> float | None:
    """Largest absolute entry of the covariance of ``names`` minus the identity."""
    if not names:
        return None
    means = white.agg(*(F.sum(c).alias(c) for c in names)).first()
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    centred = {c: F.col(c) - F.lit(means[c] / n) for c in names}
    sums = white.agg(*(F.sum(centred[a] * centred[b]).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(sums[f"{a}_{b}"] / n - (a == b)) for a, b in pairs)


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every usable vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null or holds a null or non-finite entry has no row; an entry beyond 2^38 counts as not finite.  All
    others, as x = floor(1024 * c) + 100000, are the fit list.  Vectors of another length than the most frequent one
    (ties: the longer) cannot be fitted with the rest and have no row.  Components go by falling eigenvalue, at most as many
    as dimensions; where an eigenvalue is zero (1e-12 of the largest) ``whitened`` is null and the component is not part of
    ``identity_error``.  ``explained`` is null when no dimension varies, ``deviation`` when it exceeds 64 bits.
    Rows with a null or repeated id stay; an empty table gives an empty result.
    """
    rows = usable_rows(df, id_col, vector_col, MOST)
    kind = rows.schema["vec_id"].dataType.simpleString()
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).filter("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    rows = rows.filter(F.size("vector") == size) if size else rows.limit(0)
    n, sums, centred = scatter(rows, size) if size else (0, [], [])
    if not n:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    axes, values, trace = whitening_axes(n, centred, components)
    scale = np.where(values > TINY * max(values[0], 0.0), np.sqrt(np.maximum(values, 0.0)), 0.0) if trace else np.zeros(len(values))
    names = [f"w{k + 1}" for k in range(len(values))]
    white = written(rows.mapInArrow(_projected(size, n, sums, axes, scale), f"vec_id {kind}, deviation long, " + ", ".join(f"{c} double" for c in names)))
    error = identity_error(white, n, [c for c, s in zip(names, scale, strict=True) if s])
    share = [float(max(v, 0.0)) / trace if trace else None for v in values]
    parts = F.array(*(F.struct(F.lit(k + 1).cast("int").alias("component"), F.col(c).alias("whitened"), F.lit(s).cast("double").alias("explained"))
                      for k, (c, s) in enumerate(zip(names, share, strict=True))))
    return white.select("vec_id", "deviation", F.explode(parts).alias("p")).select(
        "vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(error).cast("double").alias("identity_error"))
