"""Retrieval metrics per query and per system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sparkfolio.scale import exact_percentiles


def unique_ranking(hits: DataFrame) -> DataFrame:
    """(query_id, rank, paper_id): duplicates keep their first place, ranks close up."""
    first = hits.groupBy("query_id", "paper_id").agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy("first_rank", "paper_id")
    return first.select("query_id", F.row_number().over(w).cast("long").alias("rank"), "paper_id")


def drop_self(rank: DataFrame, own: DataFrame) -> DataFrame:
    """A query's own document (query_id, paper_id) never counts."""
    return rank.join(own.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti")


def query_metrics(ranking: DataFrame, gold: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall@k, precision@5, hit rate and reciprocal rank for every query.

    ``ranking`` has unique ids per query.  A query without gold has recall 0, one
    without results counts with zeros.
    """
    ks = sorted(set(ks) | {5})
    golden = gold.select("query_id", "paper_id").distinct()
    sizes = golden.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranking.join(golden, ["query_id", "paper_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first_hit"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks])
    lengths = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    base = queries.select("query_id").join(sizes, "query_id", "left").join(hits, "query_id", "left").join(
        lengths, "query_id", "left")
    at = lambda k: F.coalesce(F.col(f"hits_{k}"), F.lit(0))
    return base.select(
        "query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        *[F.when(F.col("n_gold") > 0, at(k) / F.col("n_gold")).otherwise(0.0).alias(f"recall_{k}") for k in ks],
        (at(5) / 5).alias("precision_5"), F.when(at(5) > 0, 1.0).otherwise(0.0).alias("hit_rate_5"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
    )


def recall_summary(metrics: DataFrame, timing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean metrics over all queries, latency percentiles over successful ones, errors, longest list.

    ``timing``: (by..., query_id, latency, failed).
    """
    names = [c for c in metrics.columns if c.startswith(("recall_", "precision_", "hit_rate_")) or c == "mrr"]
    keys = list(by)
    means = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), F.max("n_results").alias("longest"),
        *[F.avg(c).alias(c) for c in names])
    errors = timing.groupBy(*keys).agg(F.count_if("failed").alias("errors"))
    lat = exact_percentiles(timing.filter(~F.col("failed")), keys, "latency", {"latency_p50": 0.5, "latency_p90": 0.9})
    if not keys:
        means, errors, lat = (d.withColumn("_one", F.lit(1)) for d in (means, errors, lat))
    on = keys or ["_one"]
    out = means.join(errors, on, "left").join(lat, on, "left")
    return out.select(*keys, "queries", "longest", *names, F.coalesce("errors", F.lit(0)).alias("errors"),
                      F.coalesce("latency_p50", F.lit(0.0)).alias("latency_p50"),
                      F.coalesce("latency_p90", F.lit(0.0)).alias("latency_p90"))


def recall_bench(rankings: DataFrame, gold: DataFrame, queries: DataFrame, own: DataFrame, timing: DataFrame,
                 ks: Sequence[int]) -> DataFrame:
    """Metrics of several systems at once; every table but ``gold`` has a ``system`` column.

    A (system, query) pair becomes one compound query, so all systems share one plan.
    """
    pair = F.concat_ws("\u0001", F.col("system"), F.col("query_id").cast("string"))
    systems = timing.select("system").distinct()
    with_system = lambda df: df.join(timing.select("system", "query_id").distinct(), "query_id").withColumn("query_id", pair)
    flat = rankings.withColumn("query_id", pair).select("query_id", "rank", "paper_id")
    metrics = query_metrics(
        unique_ranking(drop_self(flat, with_system(own))), with_system(gold), with_system(queries), ks,
    ).withColumn("system", F.substring_index("query_id", "\u0001", 1))
    return recall_summary(metrics.join(systems, "system", "left_semi"), timing, ["system"])
