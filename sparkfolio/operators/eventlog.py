"""Run-event log, batch form: numbering, replay, folding of run and step state.

A run can hold any share of all events.  Sequences and running state are computed in
time blocks of a run (see ``sparkfolio.scale``); final states are map-side aggregates.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DecimalType, LongType

from sparkfolio.scale import cut_lineage, numbered, position_block, running, time_block
from sparkfolio.sources.papers import first_row_per_key

TERMINAL = ("success", "degraded", "error")
TERMINAL_TYPES = ("run.completed", "run.failed")
WRAPPER_NODES = ("notes_branch",)


def assign_seq(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), unit: str = "hour") -> DataFrame:
    """1-based ``seq`` per run in event order."""
    return numbered(events, ["run_id"], time_block(F.col(order[0]), unit), list(order), "seq")


def append_event(events: DataFrame) -> DataFrame:
    """Log rows: numbered, facts only on updates, progress within 0 and 1."""
    seq = assign_seq(events)
    return seq.withColumn("facts", F.when(F.col("type") == "step.updated", F.col("facts"))).withColumn(
        "progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress").cast("double"))))


def replay(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events of each asked run after its cursor (run_id, after_seq)."""
    return events.join(cursors, "run_id").filter(F.col("seq") > F.col("after_seq")).drop("after_seq")


def drop_replayed(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Drop events whose seq is not above every seq of the run that arrived before."""
    out = running(events, ["run_id"], position_block(F.col(arrival)), [arrival], maxes={"last_seq": F.col("seq")}, before=["last_seq"])
    return out.filter(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")) | (F.col("seq") <= 0)).drop("last_seq")


def fold_steps(events: DataFrame) -> DataFrame:
    """(run_id, node, status, first_ts, duration_ms, n_events): state of every step after all events.

    A completion sets its outcome; a later start reopens a step unless it is completed; each
    end of the run, in order, closes the steps that run then.
    """
    ends = F.when(F.col("type").isin(*TERMINAL_TYPES), F.col("type"))
    # Read backwards, the last end seen so far is the first end after a row.
    marked = running(events.withColumn("_back", -F.col("seq")), ["run_id"], position_block(F.col("_back")), ["_back"],
                     lasts={"next_end": ends}, before=["next_end"])
    done = F.when(F.col("type") == "step.completed", F.col("seq"))
    outcome = F.when(F.col("status").isin("error", "failed"), "error").when(F.col("status") == "skipped", "skipped").otherwise("completed")
    start, after = F.col("type") == "step.started", F.col("next_end")
    steps = marked.filter(F.col("type").startswith("step.")).groupBy("run_id", "node").agg(
        F.min_by("ts", "seq").alias("first_ts"), F.max(done).alias("done_seq"), F.max_by(outcome, done).alias("outcome"),
        F.max_by("duration_ms", F.when(F.col("duration_ms").isNotNull(), F.col("seq"))).alias("duration_ms"), F.count(F.lit(1)).alias("n_events"),
        F.min_by(F.coalesce(after, F.lit("")), "seq").alias("first_end"), F.max(F.when(start & after.isNull(), F.col("seq"))).alias("open_start"),
        F.max(F.when(start & after.isNotNull(), F.col("seq"))).alias("closed_start"),
        F.max(F.when(start & (after == "run.completed"), F.col("seq"))).alias("well_start"))
    # Only starts after the last outcome count; without an outcome the first event is a start too.
    new = F.col("done_seq").isNull()
    later = lambda c: F.coalesce(F.col(c) > F.coalesce("done_seq", F.lit(-(2**62))), F.lit(False))
    status = (F.when(F.col("outcome") == "completed", "completed")
              .when(later("well_start") | (new & (F.col("first_end") == "run.completed")), "completed")
              .when(later("open_start") | (new & (F.col("first_end") == "")), "running")
              .when(later("closed_start") | new, "error").otherwise(F.col("outcome")))
    return steps.select("run_id", "node", status.alias("status"), "first_ts", "duration_ms", "n_events")


def fold_runs(events: DataFrame) -> DataFrame:
    """(run_id, last_seq, status, started, ended, n_deltas, answer_chars): state of every run."""
    end = F.when(F.col("type").isin(*TERMINAL_TYPES), F.col("seq"))
    is_delta = F.col("type") == "assistant.delta"
    agg = events.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"), F.min_by("ts", "seq").alias("started"), F.max_by("ts", end).alias("ended"),
        F.max_by("type", end).alias("end_type"), F.count_if(is_delta).alias("n_deltas"),
        F.coalesce(F.sum(F.when(is_delta, F.length("delta"))), F.lit(0)).alias("answer_chars"))
    status = F.when(F.col("end_type") == "run.completed", "success").when(F.col("end_type") == "run.failed", "error").otherwise("running")
    return agg.select("run_id", "last_seq", status.alias("status"), "started", "ended", "n_deltas", "answer_chars")


def reduce_updates(updates: DataFrame) -> DataFrame:
    """(run_id, key, subkey, value): last write per key, per paper and per node.

    ``updates``: (run_id, seq, key, subkey, value), already exploded; plain keys have
    subkey ``""``.  Log lines are rows of their own and are kept by ``log_rows``.
    """
    return updates.filter(~F.col("key").isin("trace_logs", "error_logs")).groupBy("run_id", "key", "subkey").agg(
        F.max_by("value", "seq").alias("value"))


def log_rows(updates: DataFrame) -> DataFrame:
    """(run_id, key, seq, value): appended log lines after the last full snapshot of a channel."""
    logs = updates.filter(F.col("key").isin("trace_logs", "error_logs"))
    snap = logs.groupBy("run_id", "key").agg(F.max(F.when(F.col("is_snapshot"), F.col("seq"))).alias("snap_seq"))
    return logs.join(snap, ["run_id", "key"]).filter(F.col("snap_seq").isNull() | (F.col("seq") >= F.col("snap_seq"))).select(
        "run_id", "key", "seq", "value")


def step_durations(events: DataFrame) -> DataFrame:
    """(run_id, task_id, seconds, finished): start and completion of the same task."""
    agg = events.groupBy("run_id", "task_id").agg(
        F.min(F.when(F.col("type") == "step.started", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("type") == "step.completed", F.col("ts"))).alias("ended"))
    both = F.col("started").isNotNull() & F.col("ended").isNotNull() & (F.col("ended") >= F.col("started"))
    return agg.select("run_id", "task_id", F.when(both, F.timestamp_diff("SECOND", F.col("started"), F.col("ended"))).alias("seconds"),
                      both.alias("finished"))


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status): a task error wins, then an incomplete source or any error line degrades."""
    agg = events.groupBy("run_id").agg(F.bool_or("task_error").alias("err"), F.bool_or("incomplete_source").alias("inc"),
                                       F.max("n_errors").alias("n"))
    return agg.select("run_id", F.when(F.col("err"), "error").when(F.col("inc") | (F.col("n") > 0), "degraded").otherwise("success").alias("status"))


def active_runs(events: DataFrame) -> DataFrame:
    """(run_id): runs without a terminal event."""
    ended = events.filter(F.col("type").isin(*TERMINAL_TYPES)).select("run_id").distinct()
    return events.select("run_id").distinct().join(ended, "run_id", "left_anti")


def gate_violations(runs: DataFrame) -> DataFrame:
    """Runs (run_id, started, ended, pos) that began while an earlier run was active.

    The latest end so far is a running maximum over all runs in start order, in blocks.
    """
    rows = runs.withColumn("_all", F.lit(0)).withColumn("_end", F.coalesce("ended", F.lit("9999-12-31").cast("timestamp_ntz")))
    out = running(rows, ["_all"], time_block(F.col("started"), "day"), ["started", "run_id"], maxes={"busy_until": F.col("_end")}, before=["busy_until"])
    return out.filter(F.col("started") < F.col("busy_until")).select("run_id", "started", "busy_until")


def run_summary(events: DataFrame) -> DataFrame:
    """(run_id, quick, seconds): a follow-up step makes a run quick; seconds from the summary or the clock."""
    end = F.when(F.col("type").isin(*TERMINAL_TYPES), F.col("seq"))
    agg = events.groupBy("run_id").agg(
        F.bool_or((F.col("node") == "answer_followup") | ((F.col("node") == "router") & (F.col("intent") == "followup"))).alias("quick"),
        F.max("summary_seconds").alias("stated"), F.min_by("ts", "seq").alias("a"), F.max_by("ts", end).alias("b"))
    clock = F.round(F.timestamp_diff("MILLISECOND", F.col("a"), F.col("b")) / 1000).cast("long")
    return agg.select("run_id", "quick", F.coalesce(F.when(F.col("stated") >= 0, F.col("stated")), F.greatest(F.lit(0), clock)).alias("seconds"))


def split_updates(payloads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(payload_id, node, update): one row per node update of a payload.

    ``payloads``: (payload_id, payload JSON text); ``nodes``: (node) the known nodes.
    Wrapper nodes drop out; an unknown payload goes to its log prefix, then its newest timing.
    """
    keys = payloads.select("payload_id", "payload", F.posexplode(F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))).alias("pos", "k"))
    known = keys.join(nodes.select(F.col("node").alias("k")), "k", "left_semi")
    as_map = F.from_json("payload", "map<string,string>")
    direct = known.select("payload_id", F.col("k").alias("node"), F.try_element_at(as_map, F.col("k")).alias("update")).filter(
        F.col("update").startswith("{"))
    wrappers = keys.groupBy("payload_id").agg(F.bool_and(F.col("k").isin(*WRAPPER_NODES)).alias("only")).filter("only")
    rest = payloads.join(direct.select("payload_id").distinct(), "payload_id", "left_anti").join(wrappers, "payload_id", "left_anti")
    logs = F.from_json(F.try_element_at(F.from_json("payload", "map<string,string>"), F.lit("trace_logs")), "array<string>")
    prefix = F.filter(F.transform(F.coalesce(logs, F.array().cast("array<string>")), lambda l: F.regexp_extract(l, r"^\[([^\]]+)\]", 1)), lambda x: x != "")
    timing = F.json_object_keys(F.get_json_object("payload", "$.node_timings"))
    names = nodes.select("node")
    guess = rest.select("payload_id", "payload", F.try_element_at(prefix, F.lit(-1)).alias("g1"), F.posexplode_outer(F.reverse(timing)).alias("tp", "t"))
    n1 = guess.join(names.select(F.col("node").alias("g1"), F.lit(True).alias("ok1")), "g1", "left")
    n2 = n1.join(names.select(F.col("node").alias("t"), F.lit(True).alias("ok2")), "t", "left")
    picked = n2.groupBy("payload_id").agg(F.max(F.when(F.col("ok1"), F.col("g1"))).alias("g1"),
                                          F.min_by("t", F.when(F.col("ok2"), F.col("tp"))).alias("t"), F.first("payload").alias("payload"))
    report = F.when(F.json_object_keys("payload").isNotNull() & F.array_contains(F.json_object_keys("payload"), "final_report"), "final_report")
    return direct.unionByName(picked.select("payload_id", F.coalesce("g1", "t", report, F.lit("workflow")).alias("node"), F.col("payload").alias("update")))


def merge_chunks(chunks: DataFrame, piece_rows: int = 4096) -> DataFrame:
    """(run_id, piece, text, chars): answer text in pieces of consecutive chunks.

    The text starts at the last chunk that ``flag_restarts`` (or the producer) flagged
    ``restart``.  Pieces stay bounded however long one answer gets; a short answer is one piece.
    """
    last = chunks.groupBy("run_id").agg(F.max(F.when(F.col("restart"), F.col("pos"))).alias("from_pos"))
    kept = chunks.join(last, "run_id").filter(F.col("from_pos").isNull() | (F.col("pos") >= F.col("from_pos")))
    piece = position_block(F.col("pos"), piece_rows)
    return kept.groupBy("run_id", piece.alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "text"))), lambda c: c["text"]), "").alias("text")).withColumn("chars", F.length("text").cast("long"))


#: Safe prime, so that powers of 256 do not repeat; a text's hash is its bytes, as digits to base 256, modulo it.
HASH_MOD = 2**88 - 797


@F.pandas_udf(DecimalType(38, 0))
def _placed_hash(text: pd.Series, end: pd.Series) -> pd.Series:
    """Hash of a chunk scaled to its place, so that the hash of consecutive chunks is a sum."""
    inverse = pow(256, -1, HASH_MOD)
    return pd.Series([Decimal(int.from_bytes(t.encode()) % HASH_MOD * pow(inverse, e, HASH_MOD) % HASH_MOD) for t, e in zip(text, end, strict=True)])


@F.pandas_udf(ArrayType(LongType()))
def _repeated(text: pd.Series, at: pd.Series, starts: pd.Series) -> pd.Series:
    """Of (size, r, total), by size: each r from which the chunks up to byte ``at`` hash like as many bytes of ``text``."""
    found = []
    for t, end, asked in zip(text, at, starts, strict=True):
        data, seen, value, same = t.encode(), 0, 0, []
        for a in asked:
            size, total = a["size"], int(a["total"]) % HASH_MOD
            value = (value * pow(256, size - seen, HASH_MOD) + int.from_bytes(data[seen:size])) % HASH_MOD
            seen = size
            if value == total * pow(256, end, HASH_MOD) % HASH_MOD:
                same.append(a["r"])
        found.append(same)
    return pd.Series(found)


def flag_restarts(chunks: DataFrame) -> DataFrame:
    """(run_id, pos, text, restart): flag the chunks that start with the whole text so far, over 8 characters.

    No run is collected: each chunk's hash is scaled to its byte offset, so running sums over
    blocks of a run give the hash of any stretch of chunks.  A chunk can only repeat the text since an
    earlier restart (or the run's first chunk) that lies at most its own length back, so a run's
    candidate pairs grow with its text; restarts then follow from one another by doubling steps.
    Null texts count as empty; (run_id, pos) is unique.  The hash has 88 bits.
    """
    base = chunks.select("run_id", "pos", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.octet_length("text").cast("long"))
    block = position_block(F.col("pos"))
    sized = running(base, ["run_id"], block, ["pos"], sums={"ends": F.col("n"), "chars": F.length("text").cast("long")})
    placed = cut_lineage(running(sized.withColumn("h", _placed_hash("text", "ends")), ["run_id"], block, ["pos"], sums={"hashes": F.col("h")}))
    first = placed.groupBy("run_id").agg(F.min_by("text", F.when(F.col("n") > 0, F.col("pos"))).alias("head"), F.min("pos").alias("first_pos"))
    starts = F.col("text").startswith(F.col("head")) & (F.length("text") > 8)
    able = placed.join(first, "run_id").filter(starts | (F.col("pos") == F.col("first_pos"))).select(
        "run_id", "pos", "text", (F.col("ends") - F.col("n")).alias("at"), (F.col("chars") - F.length("text")).alias("at_chars"),
        (F.col("hashes") - F.col("h")).alias("sum_at"), (F.col("pos") > F.col("first_pos")).alias("later"), "n")
    # Slices of bytes in powers of two: a chunk meets the starts in its own and the slice before.
    origin = able.select("run_id", F.col("pos").alias("r"), F.col("at").alias("r_at"), F.col("at_chars").alias("r_chars"), F.col("sum_at").alias("r_sum"))
    asked = able.filter("later").drop("text").withColumn("w", F.ceil(F.log2("n")).cast("int")).withColumn(
        "slot", F.expr("explode(array(shiftright(at, w), shiftright(at, w) - 1))"))
    offered = origin.join(asked.select("run_id", "w").distinct(), "run_id").withColumn("slot", F.expr("shiftright(r_at, w)"))
    size = F.col("at") - F.col("r_at")
    pairs = asked.join(offered, ["run_id", "w", "slot"]).filter((F.col("r") < F.col("pos")) & (size <= F.col("n")) & (F.col("at_chars") - F.col("r_chars") > 8))
    # At most one start per nine bytes of a chunk: the list is no longer than the chunk.
    listed = pairs.groupBy("run_id", "pos").agg(F.array_sort(F.collect_list(F.struct(
        size.alias("size"), F.col("r").cast("long").alias("r"), (F.col("sum_at") - F.col("r_sum")).alias("total")))).alias("starts"))
    hit = able.select("run_id", "pos", "text", "at").join(listed, ["run_id", "pos"]).select("run_id", "pos", F.explode(_repeated("text", "at", "starts")).alias("r"))
    step = cut_lineage(hit.groupBy("run_id", "r").agg(F.min("pos").alias("to")))
    reached = cut_lineage(first.select("run_id", F.col("first_pos").alias("r")))
    found = reached
    # ``step`` covers 1, 2, 4, ... restarts; what it reaches from the known ones doubles each time.
    while True:
        new = cut_lineage(found.join(step, ["run_id", "r"]).select("run_id", F.col("to").alias("r")).join(found, ["run_id", "r"], "left_anti"))
        if new.isEmpty():
            break
        found = cut_lineage(found.unionByName(new))
        step = cut_lineage(step.join(step.select("run_id", F.col("r").alias("to"), F.col("to").alias("to2")), ["run_id", "to"]).select(
            "run_id", "r", F.col("to2").alias("to")))
    restarts = found.join(reached, ["run_id", "r"], "left_anti").select("run_id", F.col("r").alias("pos"), F.lit(True).alias("restart"))
    return base.drop("n").join(restarts, ["run_id", "pos"], "left").withColumn("restart", F.coalesce("restart", F.lit(False)))


def lifecycle_once(events: DataFrame) -> DataFrame:
    """One start and one completion per task (else per node); the synthetic router start is not repeated."""
    key = F.coalesce(F.col("task_id"), F.concat(F.lit("node:"), F.col("node")))
    life = events.filter(F.col("type").isin("step.started", "step.completed")).withColumn("life_key", key)
    once = first_row_per_key(life, ["run_id", "type", "life_key"], "seq").drop("life_key")
    synthetic = once.filter((F.col("type") == "step.started") & (F.col("node") == "router") & F.col("task_id").isNull()).select("run_id").distinct()
    first_task = once.filter((F.col("type") == "step.started") & F.col("task_id").isNotNull()).groupBy("run_id").agg(F.min("seq").alias("seq"))
    repeated = once.filter(F.col("node") == "router").join(first_task, ["run_id", "seq"], "left_semi").join(synthetic, "run_id", "left_semi")
    others = events.filter(~F.col("type").isin("step.started", "step.completed"))
    return once.join(repeated.select("run_id", "seq"), ["run_id", "seq"], "left_anti").unionByName(others)


def delta_segments(answers: DataFrame) -> DataFrame:
    """(run_id, pos, delta): text beyond the longest answer already sent.  Input: (run_id, pos, answer)."""
    out = running(answers, ["run_id"], position_block(F.col("pos")), ["pos"], maxes={"sent": F.length("answer")}, before=["sent"])
    sent = F.coalesce(F.col("sent"), F.lit(0))
    return out.filter(F.length("answer") > sent).select("run_id", "pos", F.substring(F.col("answer"), sent + 1, F.length("answer")).alias("delta"))


def pick_duration(measured: Column, direct: Column, *timings: Column) -> Column:
    """Measured task time, else the direct field, else the first timing key."""
    return F.coalesce(measured, direct, *timings)
