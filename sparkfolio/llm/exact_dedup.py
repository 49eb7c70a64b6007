"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every document gets a fingerprint of its normalised text; only (sender, id, digest) is kept.
2. Each sender (a scan task of step 1) sorts its distinct fingerprints and sends each owner, a
   range of the fingerprint space, the Golomb-Rice code of their differences.
3. An owner merges what it got and returns one bitmap per sender: which of its fingerprints
   another sender has too.
4. Rows flagged by a bitmap, or repeated within their sender, are suspects.  Only their texts
   are shuffled; grouping by the whole text verifies every byte.

A text that a third of all rows share is one fingerprint per sender for its owner, and one
partly aggregated row per task in step 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import keep_rows, text_hash, written

#: Fingerprint bits beyond log2 of the row count: one false suspect in 2^12 documents or so.
SPARE_BITS = 12
#: Fingerprints that one owner should merge.
OWNER_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """White-space runs to one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def golomb_encode(values: np.ndarray, low: int, high: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct ``values`` of ``[low, high)`` as (Rice parameter, unary quotients, remainders)."""
    gaps = np.diff(values.astype(np.int64), prepend=low - 1) - 1
    bits = max(0, int(log2(max(1.0, 0.69 * (high - low) / max(1, len(values))))))
    quotients = gaps >> bits
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
    return bits, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, bits: int, unary: bytes, rest: bytes, low: int) -> np.ndarray:
    """The inverse of ``golomb_encode``."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    tail = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * bits).reshape(n, bits).astype(np.int64)
    gaps = (quotients << bits) + (tail << np.arange(bits)).sum(axis=1)
    return np.cumsum(gaps + 1) + low - 1


def _bounds(owners: int, bits: int) -> np.ndarray:
    """First fingerprint of each owner's range, and the end."""
    return np.array([(k << bits) // owners for k in range(owners + 1)], np.int64)


_SENT = "sender int, owner int, n long, bits int, unary binary, rest binary"


def _stamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the scan task's number as ``sender``."""
    k = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, k, np.int32))], names=[*batch.schema.names, "sender"])


def _send(owners: int, bits: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        prints = np.unique(table.column("print").to_numpy())
        bounds = _bounds(owners, bits)
        cuts = np.searchsorted(prints, bounds)
        rows = []
        for k in range(owners):
            part = prints[cuts[k] : cuts[k + 1]]
            if len(part):
                rows.append((key[0].as_py(), k, len(part), *golomb_encode(part, int(bounds[k]), int(bounds[k + 1]))))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["sender", "owner", "n", "bits", "unary", "rest"])
    return send


def _answer(owners: int, bits: int):
    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low = int(_bounds(owners, bits)[key[0].as_py()])
        sent = [golomb_decode(r["n"], r["bits"], r["unary"], r["rest"], low) for r in table.select(["n", "bits", "unary", "rest"]).to_pylist()]
        merged = np.sort(np.concatenate(sent))
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
        return pa.table([table.column("sender"), table.column("owner"), table.column("n"), pa.array(maps, pa.binary())], names=["sender", "owner", "n", "bitmap"])
    return answer


def _apply(key: tuple[pa.Scalar, ...], rows: pa.Table, maps: pa.Table) -> pa.Table:
    """Add ``suspect``: the fingerprint is repeated here, or its bit is set."""
    distinct, place, count = np.unique(rows.column("print").to_numpy(), return_inverse=True, return_counts=True)
    flags = count > 1
    got = sorted(maps.select(["owner", "n", "bitmap"]).to_pylist(), key=lambda r: r["owner"])
    if got:
        flags |= np.concatenate([np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]) for r in got]).astype(bool)
    return rows.append_column("suspect", pa.array(flags[place]))


def suspects(prints: DataFrame, n_rows: int) -> DataFrame:
    """``prints`` (sender int, hash64 long, any columns) with ``suspect``: whether another row may have the same text.

    No row with an equal hash elsewhere is missed; a few rows without one are flagged.
    """
    bits = min(62, max(8, ceil(log2(max(2, n_rows))) + SPARE_BITS))
    owners = max(1, -(-n_rows // OWNER_ROWS), min(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // 1000))
    rows = prints.withColumn("print", F.shiftrightunsigned("hash64", 64 - bits))
    sent = rows.select("sender", "print").groupBy("sender").applyInArrow(_send(owners, bits), _SENT)
    maps = sent.groupBy("owner").applyInArrow(_answer(owners, bits), "sender int, owner int, n long, bitmap binary")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("sender").cogroup(maps.groupBy("sender")).applyInArrow(_apply, f"{kept}, suspect boolean")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Group of every document among documents of equal normalised text.

    Returns doc_id, keep_id (smallest id of the group; null only where all ids are null),
    group_size, kept and text_sha256.  A null text counts as empty; empty texts are equal to
    one another.  One row is kept per distinct id: rows repeated with the id that stays are
    all ``kept`` here, and ``drop_copies`` leaves one of them.  Other columns are ignored and
    an empty table gives an empty result.  ``carry`` names columns to keep.
    """
    more = [f"carry_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    prints = rows.select("doc_id", *more, F.unhex(F.sha2("body", 256)).alias("digest"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema)
    prints = prints.mapInArrow(_stamped, f"{kinds}, sender int")
    prints = written(prints.withColumn("hash64", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")))
    n_rows = prints.count()
    flagged = written(suspects(prints, n_rows).select("doc_id", *more, "digest", "suspect"))
    ids = flagged.filter("suspect").select(F.col("doc_id").alias("suspect_id")).distinct()
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
    classes = texts.groupBy("body").agg(F.min("doc_id").alias("keep"), F.count("*").alias("copies"))
    classes = classes.select(F.unhex(F.sha2("body", 256)).alias("class_digest"), "keep", "copies")
    found = flagged.join(classes, F.when(F.col("suspect"), F.col("digest")) == F.col("class_digest"), "left")
    keep = F.when(F.col("copies").isNotNull(), F.col("keep")).otherwise(F.col("doc_id"))
    return (found.select("doc_id", *(F.col(f"carry_{c}").alias(c) for c in carry), keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
                         F.lower(F.hex("digest")).alias("text_sha256"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *carry))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns of ``docs``.

    Of rows that repeat that id too, one stays.
    """
    groups = exact_groups(docs.withColumn("text_hash", text_hash(text_col)), id_col, text_col, ("text_hash",))
    kept = written(groups.filter("kept").groupBy("doc_id", "text_sha256").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("n")))
    out = keep_rows(docs, kept, id_col, text_col)
    if kept.filter("n > 1").limit(1).count():
        out = out.dropDuplicates([id_col, text_col])
    return out


def groups_sql() -> str:
    """The grouping in SQL over ``documents``."""
    return r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)"""
