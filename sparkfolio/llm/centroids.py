"""Centroid clustering over a vector-approximation file.

1. One pass finds each dimension's least, greatest, mean and spread over all vectors, which place
   2^bits cells a dimension.
2. One pass writes each vector as a record of fixed width into files of the shared folder, and a
   table with its cells (one byte a dimension) and its place in those files.
3. A round reads the cells only.  Tables of the least and the greatest share of a cell in the squared
   distance to a centroid give, by one lookup a dimension, an interval that holds a vector's distance
   to each centroid (less its distance to their middle, which is common to all and would widen
   the intervals).  Where one centroid's interval lies below all others the vector is decided; where
   intervals overlap its record is fetched and the distances are exact.
4. Sums change by the vectors that change their cluster: their records are fetched too.
   (In the first round that is every vector.)  Partial sums meet in an aggregate of (cluster, dimension).
5. The last pass fetches every record, as each row's exact distance is part of the result.

The labels of a round follow from its centroids, so no state is kept between rounds and a lost task can be run again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import written
from sparkfolio.llm.vectors import usable_rows, whole_numbers
from sparkfolio.session import work_dir

#: Bits of a cell (8 at most, one byte holds a cell).
BITS = 8
#: Components up to this size: squared distances of 64 dimensions fit 64 bits.
MOST = float(1 << 17)
#: Bytes between two wanted records that are read over rather than skipped.
GAP = 1 << 12
#: Vectors that one numpy step works on.
STEP = 4096


def _ranges(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, mean, square = 0, np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min), np.zeros(size), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column("vector"), size)
                n += len(x)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                mean += x.sum(axis=0, dtype=np.float64)
                square += (x.astype(np.float64) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(size), pa.int32()), "n": pa.array(np.full(size, n)), "low": pa.array(low), "high": pa.array(high),
                                              "sums": pa.array(mean), "squares": pa.array(square)})
    return run


def cell_edges(low: np.ndarray, high: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last whole number of each cell of each dimension (dimension, cell).

    Cells are even within four spreads of the mean; the outer ones reach the least and greatest value.
    """
    cells = 1 << bits
    left = np.clip(np.floor(mean - 4 * spread), low, high)
    right = np.clip(np.ceil(mean + 4 * spread), low, high)
    inner = left[:, None] + (right - left)[:, None] * np.arange(1, cells) / cells
    starts = np.concatenate([low[:, None], np.ceil(inner).astype(np.int64)], axis=1)
    ends = np.concatenate([starts[:, 1:] - 1, high[:, None]], axis=1)
    return starts, np.maximum(ends, starts)


def cells_of(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cell of every component."""
    return np.stack([np.searchsorted(starts[d], x[:, d], side="right") - 1 for d in range(x.shape[1])], axis=1).astype(np.uint8)


def distance_tables(centroids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest share of a dimension in the squared distance to a centroid, by cell (centroid, dimension, cell).

    Each share is taken less that of the distance to the centroids' middle m, which is the same for all centroids:
    (x - c)^2 - (x - m)^2 = c^2 - m^2 - 2x(c - m) is linear in x, so its bounds are at a cell's ends and as
    narrow as c is close to m.
    """
    middle = centroids.sum(axis=0) // len(centroids)
    off = (centroids - middle)[:, :, None]
    fixed = (centroids**2 - middle**2)[:, :, None]
    one, two = fixed - 2 * starts[None] * off, fixed - 2 * ends[None] * off
    return np.minimum(one, two), np.maximum(one, two)


def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each vector's squared distance to each centroid, less that to their middle (vector, centroid)."""
    at = np.arange(cells.shape[1])
    low, high = (np.stack([t[k][at, cells].sum(axis=1) for k in range(len(t))], axis=1) for t in tables)
    return low, high


def decide(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vector, centroid) candidates, and the cluster where there is one candidate, else -1."""
    low, high = intervals(cells, tables)
    candidates = low <= high.min(axis=1)[:, None]
    return candidates, np.where(candidates.sum(axis=1) == 1, candidates.argmax(axis=1), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, candidates: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number of the nearest centroid, and the squared distance."""
    gaps = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    if candidates is not None:
        gaps[~candidates] = np.iinfo(np.int64).max
    cluster = gaps.argmin(axis=1)
    return cluster, gaps[np.arange(len(x)), cluster]


def _store_vectors(folder: str, size: int, starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/vectors-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(name, compression=None)
            x = whole_numbers(batch.column("vector"), size)
            out.write(x.astype("<i4").tobytes())
            cells = pa.Array.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(cells_of(x, starts).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cells.cast(pa.binary()), pa.array([name] * len(x), pa.string()), pa.array(np.arange(at, at + len(x)))],
                                             names=["vec_id", "cells", "file", "record"])
            at += len(x)
        if out is not None:
            out.close()
    return run


class _Records:
    """Records of the vector files by number."""

    def __init__(self, folder: str, size: int):
        self.store, self.size = fs.FileSystem.from_uri(folder)[0], size
        self.name, self.file = None, None

    def fetch(self, name: str, records: np.ndarray) -> np.ndarray:
        """Vectors of ascending record numbers; wanted records that lie close are read together."""
        if name != self.name:
            self.close()
            self.name, self.file = name, self.store.open_input_file(name)
        width = 4 * self.size
        out = np.empty((len(records), self.size), np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(records) - 1) * width > GAP) + 1).tolist(), len(records)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            first = int(records[a])
            data = self.file.read_at((int(records[b - 1]) + 1 - first) * width, first * width)
            out[a:b] = np.frombuffer(data, "<i4").reshape(-1, self.size)[records[a:b] - first]
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, str, np.ndarray, np.ndarray]]:
    """Stretches of one file: (rows, file, record numbers, cells)."""
    for batch in batches:
        files = batch.column("file").to_pylist()
        cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for k in range(a, b, STEP):
                part = batch.slice(k, min(STEP, b - k))
                cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, size)
                yield part, files[k], part.column("record").to_numpy(), cells


def _moves(folder: str, size: int, edges: tuple[np.ndarray, np.ndarray], before: np.ndarray | None, now: np.ndarray):
    """Changes of the clusters' counts (dim -1) and sums when centroids go from ``before`` to ``now``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = _Records(folder, size)
        new, old = distance_tables(now, *edges), None if before is None else distance_tables(before, *edges)
        count, sums, fetched = np.zeros(len(now), np.int64), np.zeros((len(now), size), np.int64), 0
        for _, name, places, cells in _steps(batches, size):
            to_candidates, to = decide(cells, new)
            from_candidates, of = (None, np.full(len(cells), -2)) if old is None else decide(cells, old)
            need = np.flatnonzero((to < 0) | (of == -1) | (to != of))
            if not len(need):
                continue
            order = need[np.argsort(places[need], kind="stable")]
            x = records.fetch(name, places[order])
            fetched += len(order)
            goes = nearest(x, now, to_candidates[order])[0]
            comes = None if old is None else nearest(x, before, from_candidates[order])[0]
            for k in range(len(now)):
                into, out = goes == k, np.zeros(len(x), bool) if comes is None else comes == k
                count[k] += into.sum() - out.sum()
                sums[k] += x[into & ~out].sum(axis=0) - x[out & ~into].sum(axis=0)
        records.close()
        k = np.repeat(np.arange(len(now)), size + 1)
        dim = np.tile(np.arange(-1, size), len(now))
        value = np.concatenate([count[:, None], sums], axis=1).ravel()
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([*k, -1], pa.int32()), "dim": pa.array([*dim, -1], pa.int32()), "change": pa.array([*value, fetched], pa.int64())})
    return run


def _assigned(folder: str, size: int, edges: tuple[np.ndarray, np.ndarray], centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = _Records(folder, size)
        tables = distance_tables(centroids, *edges)
        for part, name, places, cells in _steps(batches, size):
            order = np.argsort(places, kind="stable")
            cluster, distance = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
            cluster[order], distance[order] = nearest(records.fetch(name, places[order]), centroids, decide(cells, tables)[0][order])
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        records.close()
    return run


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``; rows that share an id by their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    whole = F.transform("vector", lambda x: F.floor(x * 1024).cast("long"))
    return np.array([r["x"] for r in rows.select(F.sha2(name, 256).alias("hash"), whole.alias("x")).orderBy("hash", "x").limit(k).collect()], np.int64)


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: str = "3", bits: int = BITS, id_col: str = "vec_id",
                    vector_col: str = "embedding", fetched: list[int] | None = None) -> DataFrame:
    """k-means on whole numbers: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly ``size`` finite components take part, as floor(1024 * x); others have no row.  A component beyond
    131,072 counts as not finite (squared distances would not fit 64 bits).  Nearest means squared Euclidean distance, ties
    go to the smaller number; a centroid becomes the floor of its vectors' mean, an empty one stays.  Rounds end early
    when no centroid moves, as nothing changes after that.  With fewer than ``k`` vectors there are fewer centroids.
    Rows with a null or repeated id take part; sums beyond 64 bits are null.  ``fetched`` receives the number of records
    that each round fetched.
    """
    spark = df.sparkSession
    kept = usable_rows(df.filter(F.size(vector_col) == size), id_col, vector_col, MOST)
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spans = kept.select("vector").mapInArrow(_ranges(size), "dim int, n long, low long, high long, sums double, squares double")
    got = spans.groupBy("dim").agg(*(f("n" if f is F.sum else c).alias(c) for f, c in ((F.sum, "n"), (F.min, "low"), (F.max, "high"))),
                                   F.sum("sums").alias("sums"), F.sum("squares").alias("squares")).orderBy("dim").collect()  # a row per dimension
    low, high = (np.array([r[c] for r in got], np.int64) for c in ("low", "high"))
    mean = np.array([r["sums"] / r["n"] for r in got])
    spread = np.array([sqrt(max(0.0, r["squares"] / r["n"] - m * m)) for r, m in zip(got, mean, strict=True)])
    edges = cell_edges(low, high, mean, spread, bits)

    folder = work_dir(spark)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    cells = written(kept.mapInArrow(_store_vectors(folder, size, edges[0]), f"vec_id {kind}, cells binary, file string, record long"))
    approximations = cells.select("cells", "file", "record")
    totals = [[0] * (size + 1) for _ in centroids]
    before = None
    for _ in range(rounds):
        moves = approximations.mapInArrow(_moves(folder, size, edges, before, centroids), "cluster int, dim int, change long")
        for r in moves.groupBy("cluster", "dim").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect():  # k * (size + 1) rows
            if r["cluster"] >= 0:
                totals[r["cluster"]][r["dim"] + 1] += int(r["change"])
            elif fetched is not None:
                fetched.append(int(r["change"]))
        before, centroids = centroids, np.array([[s // t[0] for s in t[1:]] if t[0] else c.tolist() for t, c in zip(totals, centroids, strict=True)], np.int64)
        if (before == centroids).all():
            break
    rows = written(cells.mapInArrow(_assigned(folder, size, edges, centroids), f"vec_id {kind}, cluster int, distance long"))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    every = sum(int(r["total"]) for r in sums)
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(r["cluster"], fits(int(r["total"])), fits(every), digest(r["cluster"])) for r in sums],
                                  "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), F.col("cluster") == F.col("of")).drop("of")  # k rows at most
