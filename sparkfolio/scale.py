"""Running and rank aggregates that never put one key's rows into one task.

A plain window partitioned by a key sorts all rows of that key in one task.  When
one run, user or source holds a third of the data that task decides the job.  The
helpers below cut a key into ordered blocks first:

* ``running``: windows inside (key, block), block totals per key, and a join that
  adds what came before the block.
* ``exact_percentiles``: counts per distinct value, a cumulative count per value
  block, and a window only inside the blocks that hold a wanted rank.
* ``in_passes``: some keys after the other, so that only their exchanges are on disk.

A block is a plain expression of the row (a time slice, a position slice, a slice
of the value range), so it is the same on every recomputation after a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkfolio.session import checkpoint_dir, work_dir

BLOCK_ROWS = 65_536


def position_block(position: Column, size: int = BLOCK_ROWS) -> Column:
    """Ordered block of a 0- or 1-based position column."""
    return F.floor(position / F.lit(size)).cast("long")


def time_block(ts: Column, unit: str = "hour") -> Column:
    """Ordered block of a timestamp column."""
    return F.date_trunc(unit, ts)


def value_block(value: Column, per_octave: int = 64) -> Column:
    """Ordered block of a number: ``per_octave`` slices for each power of two."""
    v = value.cast("double")
    slot = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * per_octave).cast("long") + F.lit(1100 * per_octave)
    return F.when(v > 0, slot).when(v < 0, -slot).otherwise(F.lit(0).cast("long"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    before: Sequence[str] = (),
) -> DataFrame:
    """Add running sums, last non-NULL values and maxima per key in ``order``.

    Names listed in ``before`` look at the rows strictly before the current one;
    the others include it.  ``order`` must be unique inside a key and ``block``
    must not decrease along it.
    """
    sums, lasts, maxes = dict(sums or {}), dict(lasts or {}), dict(maxes or {})
    base = df.withColumn("_blk", block)
    for name, expr in {**sums, **lasts, **maxes}.items():
        base = base.withColumn(f"_in_{name}", expr)
    parts = [*keys, "_blk"]
    local = Window.partitionBy(*parts).orderBy(*order)

    def frame(name: str):
        return local.rowsBetween(Window.unboundedPreceding, -1 if name in before else 0)

    detail = base
    for name in sums:
        detail = detail.withColumn(f"_lo_{name}", F.sum(f"_in_{name}").over(frame(name)))
    for name in lasts:
        detail = detail.withColumn(f"_lo_{name}", F.last(f"_in_{name}", ignorenulls=True).over(frame(name)))
    for name in maxes:
        detail = detail.withColumn(f"_lo_{name}", F.max(f"_in_{name}").over(frame(name)))

    order_key = F.struct(*[F.col(c) for c in order])
    totals = [F.sum(f"_in_{n}").alias(f"_bt_{n}") for n in sums]
    totals += [
        F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), order_key)).alias(f"_bt_{n}") for n in lasts
    ]
    totals += [F.max(f"_in_{n}").alias(f"_bt_{n}") for n in maxes]
    blocks = base.groupBy(*parts).agg(*totals)
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"_bt_{n}").over(prior).alias(f"_ca_{n}") for n in sums]
    carry += [F.last(f"_bt_{n}", ignorenulls=True).over(prior).alias(f"_ca_{n}") for n in lasts]
    carry += [F.max(f"_bt_{n}").over(prior).alias(f"_ca_{n}") for n in maxes]
    carried = blocks.select(*[F.col(c).alias(f"_k_{c}") for c in parts], *carry)

    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in parts]
    out = detail.join(carried, on=cond, how="inner")
    for name in sums:
        total = F.coalesce(F.col(f"_lo_{name}"), F.lit(0)) + F.coalesce(F.col(f"_ca_{name}"), F.lit(0))
        out = out.withColumn(name, total)
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"_lo_{name}"), F.col(f"_ca_{name}")))
    for name in maxes:
        out = out.withColumn(name, F.greatest(F.col(f"_lo_{name}"), F.col(f"_ca_{name}")))
    kept = [c for c in df.columns if c not in {*sums, *lasts, *maxes}]
    return out.select(*kept, *sums, *lasts, *maxes)


def numbered(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], name: str = "seq") -> DataFrame:
    """1-based consecutive number per key in ``order``."""
    return running(df, keys, block, order, sums={name: F.lit(1).cast("long")})


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
                      nearest: bool = False) -> DataFrame:
    """Exact percentiles per key: linear interpolation at ``(n-1)*q``, or the element
    at the half-even rounded rank when ``nearest``.  NULL values are ignored; a key
    without values has no row.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_blk", value_block(F.col("_v")))
    )
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = by_key.orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        hist.groupBy(*keys, "_blk").agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(ordered))
        .withColumn("_total", F.sum("_bn").over(by_key))
    )
    wanted = []
    for name, q in quantiles.items():
        pos = (F.col("_total") - 1) * F.lit(float(q))
        if nearest:
            low = high = F.bround(pos).cast("long")
        else:
            low = F.floor(pos).cast("long")
            high = F.least(low + 1, F.col("_total") - 1)
        wanted.append(F.struct(F.lit(name).alias("name"), low.alias("lo"), high.alias("hi"), (pos - low).alias("frac")))
    picks = blocks.withColumn("_w", F.explode(F.array(*wanted))).filter(
        (F.col("_w.hi") >= F.col("_end") - F.col("_bn")) & (F.col("_w.lo") < F.col("_end"))
    ).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_k_blk"),
             (F.col("_end") - F.col("_bn")).alias("_before"), "_w")
    in_block = Window.partitionBy(*[F.col(k) for k in keys], "_blk").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    needed = picks.select(*[c for c in picks.columns if c.startswith("_k_")]).distinct()
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_blk") == F.col("_k_blk")]
    ranked = hist.join(needed, on=match, how="left_semi").withColumn("_stop", F.sum("_n").over(in_block))
    hit = ranked.join(picks, on=match, how="inner").withColumn(
        "_lo_rank", F.col("_before") + F.col("_stop") - F.col("_n")
    ).withColumn("_hi_rank", F.col("_before") + F.col("_stop") - 1)
    at = lambda rank: (F.col(f"_w.{rank}") >= F.col("_lo_rank")) & (F.col(f"_w.{rank}") <= F.col("_hi_rank"))
    per = hit.groupBy(*keys, F.col("_w.name").alias("_name")).agg(
        F.max(F.when(at("lo"), F.col("_v"))).alias("_lov"),
        F.max(F.when(at("hi"), F.col("_v"))).alias("_hiv"),
        F.max("_w.frac").alias("_frac"),
    ).withColumn("_p", F.col("_lov") if nearest else F.col("_lov") + (F.col("_hiv") - F.col("_lov")) * F.col("_frac"))
    return per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_p"))).alias(n) for n in quantiles]
    )


def filler_key(key: Column, *ids: Column) -> Column:
    """Join key that spreads rows without a key instead of hashing them all to one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000none:"), F.concat_ws(":", *[i.cast("string") for i in ids])))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder named by ``spark.checkpoint.dir``.

    Only a local master, which has no other machine to share with, gets a folder of its
    own when none is named; on a cluster without one ``work_dir`` raises.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession) or work_dir(df.sparkSession))
    return df.checkpoint(eager=True)


# Spark removes the shuffle files of a job when it has ended; otherwise they stay until the driver collects its garbage.
DROP_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that end in this block leave no shuffle files."""
    before = spark.conf.get(DROP_EXCHANGES, "false")
    spark.conf.set(DROP_EXCHANGES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_EXCHANGES, before)


def stored(*parts: DataFrame) -> DataFrame:
    """All rows of ``parts``, written one after the other to the shared folder and read again.

    The exchanges that made a part are gone before the next one starts.  Pages of version 2 keep sorted ids as differences.
    """
    spark, paths = parts[0].sparkSession, []
    for df in parts:
        paths.append(work_dir(spark))
        with exchanges_dropped(spark):
            df.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(paths[-1])
    return spark.read.schema(parts[0].schema).parquet(*paths)


def in_passes(passes: int, key: str, work: Callable[..., DataFrame], *tables: DataFrame, keep: bool = False) -> DataFrame:
    """``work`` on ``tables``, the keys of one pass after the other; all at once where one pass is enough, lazily unless ``keep``.

    ``work`` treats every value of ``key`` for itself.  Each pass reads the tables, so they should be stored.
    """
    if passes == 1:
        return stored(work(*tables)) if keep else work(*tables)
    place = F.pmod(F.xxhash64(key), F.lit(passes))
    return stored(*[work(*[t.filter(place == i) for t in tables]) for i in range(passes)])
