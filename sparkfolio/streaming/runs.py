"""Run events as a stream: numbering, replay guard, folding and throttling.

Folded state uses built-in streaming aggregates, which combine rows on the map side, so
a run with most of the traffic is no single task's load.  Numbers and replay guards run per
micro-batch as the batch operators do, with the last seq of each run as a written table.
Only the decisions when to emit keep per-run state in Python, reading Arrow chunks one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkfolio.scale import numbered, running, time_block

EVENT_SCHEMA = ("run_id long, event_id long, ts timestamp, type string, node string, status string, seq long, duration_ms long, "
                "delta string")


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated (run_id, seq) within the watermark.  The watermark is a choice of this
    library: the event log itself has no event time rule."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "seq"])


def fold_runs_stream(events: DataFrame) -> DataFrame:
    """Update-mode state per run: last seq, end, counts; equals the batch fold of the same events."""
    end = F.when(F.col("type").isin("run.completed", "run.failed"), F.col("seq"))
    agg = events.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("type", end).alias("end_type"), F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.sum(F.when(F.col("type") == "assistant.delta", F.length("delta"))), F.lit(0)).alias("answer_chars"))
    status = F.when(F.col("end_type") == "run.completed", "success").when(F.col("end_type") == "run.failed", "error").otherwise("running")
    return agg.select("run_id", "last_seq", status.alias("status"), "n_events", "answer_chars")


def fold_steps_stream(events: DataFrame) -> DataFrame:
    """Update-mode step facts per (run, node); ``settle_steps`` joins the end of the run."""
    done = F.when(F.col("type") == "step.completed", F.col("seq"))
    outcome = F.when(F.col("status").isin("error", "failed"), "error").when(F.col("status") == "skipped", "skipped").otherwise("completed")
    return events.filter(F.col("type").startswith("step.")).groupBy("run_id", "node").agg(
        F.min("seq").alias("first_seq"), F.max(done).alias("done_seq"), F.max_by(outcome, done).alias("outcome"),
        F.max(F.when(F.col("type") == "step.started", F.col("seq"))).alias("start_seq"), F.count(F.lit(1)).alias("n_events"))


def _with_last_seq(folder: str, kept: Callable[[DataFrame, DataFrame], DataFrame], highest: Callable[[DataFrame, DataFrame], DataFrame]):
    """Batch function that writes ``kept(batch, last)`` and, per run, its highest seq so far.

    ``last`` is (run_id, last_seq) after the batch before.  Both results lie in folders of
    the batch's number and are written over when a batch is repeated after a failure.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.parquet(f"{folder}/last/{number - 1}") if number else spark.createDataFrame([], "run_id long, last_seq long")
        target = f"{folder}/events/batch={number}"
        kept(batch, last).write.mode("overwrite").parquet(target)
        seen = highest(batch, spark.read.parquet(target)).groupBy("run_id").agg(F.max("seq").alias("last_seq"))
        last.unionByName(seen).groupBy("run_id").agg(F.max("last_seq").alias("last_seq")).write.mode("overwrite").parquet(f"{folder}/last/{number}")

    return run


def _start(events: DataFrame, folder: str, batch: Callable[[DataFrame, int], None], trigger: dict) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def drop_replayed_stream(events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write to ``folder/events`` (run_id, event_id, seq) of the events whose seq is above every seq of
    the run that came before, like the batch ``drop_replayed``: repeated and late numbers go however
    late they are.  Inside one trigger events count in time order; a run's events split by time."""
    def kept(batch: DataFrame, last: DataFrame) -> DataFrame:
        rows = running(batch.select("run_id", "event_id", "ts", "seq"), ["run_id"], time_block(F.col("ts")), ["ts", "event_id"],
                       maxes={"before": F.col("seq")}, before=["before"]).join(last, "run_id", "left")
        highest = F.greatest("before", "last_seq")
        return rows.filter(highest.isNull() | (F.col("seq") > highest) | (F.col("seq") <= 0)).select("run_id", "event_id", "seq")

    return _start(events, folder, _with_last_seq(folder, kept, lambda batch, written: batch), trigger)


def number_events(events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write to ``folder/events`` (run_id, event_id, seq): consecutive numbers per run in arrival order,
    inside one trigger by time.  A run's events of a trigger are numbered in blocks of time."""
    def kept(batch: DataFrame, last: DataFrame) -> DataFrame:
        rows = numbered(batch.select("run_id", "event_id", "ts"), ["run_id"], time_block(F.col("ts")), ["ts", "event_id"])
        return rows.join(last, "run_id", "left").select("run_id", "event_id", (F.col("seq") + F.coalesce("last_seq", F.lit(0))).alias("seq"))

    return _start(events, folder, _with_last_seq(folder, kept, lambda batch, written: written), trigger)


MIN_CHARS, MIN_SECONDS = 256, 0.15
SENTENCE_ENDS = (".", "!", "?", "\n")


def _throttle(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, sent_at, started = state.get if state.exists else ("", 0.0, False)
    for chunk in chunks:
        out = []
        for at, text in chunk.sort_values("at_s")[["at_s", "text"]].itertuples(index=False):
            pending += text
            due = not started or len(pending) >= MIN_CHARS or at - sent_at >= MIN_SECONDS or pending.endswith(SENTENCE_ENDS)
            if due and pending:
                out.append((key[0], at, pending))
                pending, sent_at, started = "", at, True
        yield pd.DataFrame(out, columns=["run_id", "at_s", "delta"])
    state.update((pending, sent_at, started))


def throttle_deltas(deltas: DataFrame) -> DataFrame:
    """First delta at once, then whenever 256 characters, 0.15 s or the end of a sentence is reached.

    ``deltas``: (run_id, at_s, text).  The clock is the arrival time in the data, so a
    replay gives the same segments.
    """
    return deltas.groupBy("run_id").applyInPandasWithState(
        _throttle, "run_id long, at_s double, delta string", "pending string, sent_at double, started boolean", "append",
        GroupStateTimeout.NoTimeout)


def replay_stream(spark: SparkSession, path: str, run_id: int, after_seq: int) -> DataFrame:
    """Events of one run after a cursor, as a stream over the stored log."""
    return read_events(spark, path).filter((F.col("run_id") == run_id) & (F.col("seq") > after_seq))
