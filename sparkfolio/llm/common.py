"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import work_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one numpy step works on, unless one text is longer.
BLOCK = 1 << 20


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder of the cluster's shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread, not a rerun of what came before.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, hash of the text) is in ``keep`` (doc_id, text_hash)."""
    keys = keep.select(F.col("doc_id").alias("good_id"), F.col("text_hash").alias("good_hash")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row_of_docs"))  # one column, so no name of ``docs`` can clash
    kept = row.join(keys, F.col("row_of_docs")[id_col].eqNullSafe(F.col("good_id")) & (_hash_of(F.col("row_of_docs")[text_col]) == F.col("good_hash")), "left_semi")
    return kept.select("row_of_docs.*")


def _hash_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def text_hash(text_col: str = "text") -> Column:
    """Tells rows with one id apart; a null text has the hash of the empty one."""
    return _hash_of(F.col(text_col))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        _, offsets = raw(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets into them.  A null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    got = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, offsets - offsets[0]


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


_RNG = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, 1), base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many each text has.

    A word is a run of bytes outside ``SPACES``; none crosses from one text to the next.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes.  Starts and ends ascend."""
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # blocks of whole spans bound the 8 bytes a byte
        stop = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        low, high = starts[first], ends[stop - 1]
        up, down = _powers(int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LETTER[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[first:stop] - low, ends[first:stop] - low
        hashes[first:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = stop
    return hashes


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, in order, and how many each text has."""
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; the whole sequence as one run when it is shorter."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out
