"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Main path: DataFrame functions only.  Rows are numbered by one range-partitioned sort of a
narrow table; after that shard and slot are arithmetic on the number, with no further shuffle
of rows.  Counts of the sort partitions (one row per partition) are the only thing summed up
in one place.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import written

PRIME = 2147483647
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A factor and a shift below ``PRIME`` for each round."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        a = x = (x * 48271 + 11) % PRIME
        b = x = (x * 48271 + 11) % PRIME
        keys.append((a | 1, b))
    return keys


def domain(n: int) -> tuple[int, int]:
    """Two factors whose product is ``n`` or at most ``isqrt(n) + 1`` more."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _noise(x: Column, key: tuple[int, int]) -> Column:
    y = (x * F.lit(key[0]) + F.lit(key[1])) % F.lit(PRIME)
    return (y * y) % F.lit(PRIME)


def permute(x: Column, n: int, seed: int) -> Column:
    """One pass of the Feistel network over ``[0, a * b)``: left half below a, right half below b."""
    a, b = domain(n)
    left, right = x % F.lit(a), F.call_function("div", x, F.lit(a))
    for k, key in enumerate(round_keys(seed)):
        if k % 2 == 0:
            left = (left + _noise(right, key)) % F.lit(a)
        else:
            right = (right + _noise(left, key)) % F.lit(b)
    return right * F.lit(a) + left


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``row_number_0`` (0 .. n - 1 in ``order``) to a narrow table; returns it with n.

    A sort in ranges gives each row a place in its partition; partition totals, one row each,
    give the offsets.  The row's number depends on the order only, not on the partitions.
    """
    at = F.shiftrightunsigned("place", 33)
    placed = written(df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
                     .drop("tie").withColumn("place", F.monotonically_increasing_id()))
    totals = placed.groupBy(at.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    n = placed.count()
    rows = placed.withColumn("part", at).join(offsets, "part")
    return rows.withColumn("row_number_0", F.col("skip") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "skip", "place"), n


def feistel_shards(rows: DataFrame, n_rows: int, shards: int = 8, seed: int = 42) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows numbered by ``row_number_0``.

    The number's image under the permutation is its place in the shuffled order; place modulo
    ``shards`` is the shard, place divided by ``shards`` the slot.  So shard sizes differ by at
    most one, slots have no gaps, and anyone who knows n, the shard count and the seed can
    compute where a row is.  Images at or above n walk on: a cycle leaves the valid range
    after at most (a * b - n + 1) steps, and fewer than sqrt(n) rows start such a walk.
    """
    a, b = domain(n_rows)
    over = a * b - n_rows
    once = permute(F.col("row_number_0"), n_rows, seed)
    rows = rows.withColumn("image", once)
    if over:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(over)), F.col("image"),
                           lambda x, _: F.when(x < F.lit(n_rows), x).otherwise(permute(x, n_rows, seed)))
        rows = rows.withColumn("image", F.when(F.col("image") < F.lit(n_rows), F.col("image")).otherwise(walk))
    return (rows.withColumn("shard", (F.col("image") % F.lit(shards)).cast("int"))
            .withColumn("slot", F.call_function("div", F.col("image"), F.lit(shards))).drop("image"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal row counts.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; a null text has none, an empty one
    0 bytes), text_crc32, law (always ``rows``), shard, slot and grown_shard (null: the law
    promises nothing about another shard count).  Every input row is one output row: repeated
    rows get places of their own, null ids come first, other columns are ignored, and an empty
    table gives an empty result.  Rows are numbered by (doc_id, size, checksum), so the result
    does not depend on files or partitions.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])
    return feistel_shards(rows, n, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

