"""Statistics over model calls, step timings and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkfolio.functions.redact import safe_text
from sparkfolio.functions.text import casefold
from sparkfolio.operators.graph import topk
from sparkfolio.scale import exact_percentiles, running, value_block

TOKEN_METRICS = ("seconds", "input_tokens", "output_tokens", "reasoning_tokens")
# Steps that run one after another, pipeline order of model calls, known sources.
SEQUENTIAL_NODES = ("router", "search_papers", "eval_search", "refine_query", "read_paper", "final_report")
CALL_ORDER = ("router", "eval_search", "refine_query", "write_notes", "summarize", "final_report", "answer_followup")
SOURCE_VALUES = ("ar5iv", "arxiv_html", "pdf", "mixed", "unknown")
ASOF_TOLERANCE = 0.05
FALLBACK_LINE = r"(?i)^\s*\[write_notes\]\s*([A-Za-z0-9][A-Za-z0-9_.-]{0,255})\s*:\s*PMRL\s+fallback\b"
SAVED_REPORT = r"(?iU)(?:Báo cáo lưu|saved)\s*:\s*([A-Za-z0-9_.-]+\.md)"


def call_stats(calls: DataFrame, keys: Sequence[str] = ("stage", "variant")) -> DataFrame:
    """(keys..., metric, n, median, p90) plus call and failure counts, over the values that exist."""
    keys = list(keys)
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in TOKEN_METRICS]
    long = calls.select(*keys, "ok", F.explode(F.array(*values)).alias("x")).select(*keys, "ok", "x.metric", "x.value")
    counts = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(~F.col("ok")).alias("n_failed"),
                                               F.count("value").alias("n"))
    dist = exact_percentiles(long, [*keys, "metric"], "value", {"median": 0.5, "p90": 0.9})
    return counts.join(dist, [*keys, "metric"], "left").select(
        *keys, "metric", "n_calls", "n_failed", "n", F.round("median", 2).alias("median"), F.round("p90", 2).alias("p90"))


def rep_spread(calls: DataFrame, metric: str = "output_tokens", keys: Sequence[str] = ("stage", "variant")) -> DataFrame:
    """Median over cases of max/min of a metric across repetitions (two and more, all positive)."""
    keys = list(keys)
    ratios = calls.filter(F.col(metric) > 0).groupBy(*keys, "case_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max(metric) / F.min(metric)).alias("ratio")).filter("n >= 2")
    return exact_percentiles(ratios, keys, "ratio", {"spread": 0.5}).withColumn("spread", F.round("spread", 2))


def variant_delta(stats: DataFrame, base: str, value: str = "median") -> DataFrame:
    """Percent change against the base variant, 1 digit; NULL when the base is 0 or missing."""
    b = stats.filter(F.col("variant") == base).select("stage", "metric", F.col(value).alias("base_value"))
    delta = F.round((F.col(value) - F.col("base_value")) / F.nullif("base_value", F.lit(0.0)) * 100, 1)
    return stats.filter(F.col("variant") != base).join(b, ["stage", "metric"], "left").select(
        "stage", "variant", "metric", delta.alias("delta_pct"))


def rate_delta(stats: DataFrame, base: str, value: str) -> DataFrame:
    """Absolute change of a rate, 4 digits."""
    b = stats.filter(F.col("variant") == base).select("stage", F.col(value).alias("base_value"))
    return stats.filter(F.col("variant") != base).join(b, "stage").select(
        "stage", "variant", F.round(F.col(value) - F.col("base_value"), 4).alias("delta"))


def quality_agg(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parse rate over all rows; the other rates and medians over parsed rows only.

    ``calls``: (keys..., parse_ok, all_nonempty, words, equations).
    """
    keys = list(keys)
    parsed = F.col("parse_ok")
    rates = calls.groupBy(*keys).agg(
        F.round(F.avg(parsed.cast("int")), 4).alias("parse_rate"),
        F.round(F.avg(F.when(parsed, F.col("all_nonempty").cast("int"))), 4).alias("all_nonempty_rate"),
        F.round(F.avg(F.when(parsed, F.col("equations"))), 4).alias("equations_mean"))
    med = exact_percentiles(calls.filter(parsed), keys, "words", {"words_median": 0.5})
    return rates.join(med, keys, "left").withColumn("words_median", F.round("words_median", 2))


def call_totals(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token sums (NULL when no call reported any) and the longest call."""
    sums = [F.sum(c).alias(c) for c in TOKEN_METRICS if c != "seconds"]
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), *sums, F.max("seconds").alias("longest"))


def step_calls(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls of a step: token totals only when every call reported them."""
    full = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.max("seconds").alias("longest"),
                                    *[full(c) for c in TOKEN_METRICS if c != "seconds"])


def run_duration(timings: DataFrame) -> DataFrame:
    """(run_id, seconds): sequential steps plus the slowest parallel branch.  Input: (run_id, node, ms)."""
    ms = F.when(F.col("ms") > 0, F.floor("ms")).otherwise(0)
    of = lambda *names: F.sum(F.when(F.col("node").isin(*names), ms).otherwise(0))
    parts = timings.groupBy("run_id").agg(of(*SEQUENTIAL_NODES).alias("seq"), of("write_notes", "summarize").alias("notes"),
                                          of("citation_graph").alias("graph"), of("web_enrich").alias("enrich"))
    total = F.col("seq") + F.greatest("notes", "graph", "enrich")
    return parts.select("run_id", F.bround(total / 1000).cast("long").alias("seconds"))


def node_wall(updates: DataFrame, block: Column) -> DataFrame:
    """(run_id, node, seconds): time since the previous update, charged to the finishing node.

    ``updates``: (run_id, pos, node, at_s); the first update of a run counts from ``start_s``.
    """
    prev = running(updates, ["run_id"], block, ["pos"], lasts={"prev_s": F.col("at_s")}, before=["prev_s"])
    step = F.col("at_s") - F.coalesce("prev_s", "start_s")
    return prev.groupBy("run_id", "node").agg(F.round(F.sum(step), 1).alias("seconds"))


def asof_forward(calls: DataFrame, ends: DataFrame, tolerance: float = ASOF_TOLERANCE) -> DataFrame:
    """(run_id, call_id, node): first node that ends at or after the end of the call (with tolerance).

    ``calls``: (run_id, call_id, end_s); ``ends``: (run_id, pos, node, end_s).  Rows of one
    run are read backwards in time in value blocks, so a long run is split.
    """
    c = calls.select("run_id", "call_id", F.lit(None).cast("string").alias("node"), (-F.col("end_s")).alias("neg"), F.lit(1).alias("kind"),
                     F.lit(0).cast("long").alias("neg_pos"))
    e = ends.select("run_id", F.lit(None).cast("long").alias("call_id"), "node", (-(F.col("end_s") + tolerance)).alias("neg"),
                    F.lit(0).alias("kind"), (-F.col("pos")).cast("long").alias("neg_pos"))
    both = c.unionByName(e).withColumn("neg", F.round("neg", 6)).withColumn("tie", F.coalesce("call_id", F.lit(0)))
    out = running(both, ["run_id"], value_block(F.col("neg")), ["neg", "kind", "neg_pos", "tie"], lasts={"next_node": F.col("node")})
    return out.filter("kind = 1").select("run_id", "call_id", F.coalesce("next_node", F.lit("unknown")).alias("node"))


def combined_source(found: Column) -> Column:
    """One known value, ``mixed`` for several, ``unknown`` for none (array of distinct values)."""
    known = F.filter(found, lambda v: v.isin(*SOURCE_VALUES))
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, F.get(known, 0)).otherwise("mixed")


def fact_totals(papers: DataFrame, key: str) -> DataFrame:
    """Totals per group of (key, source, table_count, reference_count, hardware)."""
    return papers.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_papers"), F.sum("table_count").alias("table_count"), F.sum("reference_count").alias("reference_count"),
        F.count_if("hardware").alias("hardware_count"),
        combined_source(F.collect_set(F.when(F.col("source").isin(*SOURCE_VALUES), F.col("source")))).alias("source"))


def log_facts(logs: DataFrame) -> DataFrame:
    """Facts of the log lines per run.  Input: (run_id, pos, channel, line)."""
    low = casefold(F.col("line"))
    guard = low.contains("no selected papers") | low.contains("danh sách bài báo trống")
    node = F.regexp_extract("line", r"^\[([^\]]+)\]", 1)
    saved = F.regexp_extract("line", SAVED_REPORT, 1)
    return logs.groupBy("run_id").agg(
        F.count_if((F.col("channel") == "error") & ~guard).alias("failed_inputs"),
        F.max_by(node, F.when(node != "", F.col("pos"))).alias("last_node"),
        F.max_by(saved, F.when(saved != "", F.col("pos"))).alias("report_id"))


def fallback_ids(logs: DataFrame, limit: int = 64) -> DataFrame:
    """(run_id, rank, paper_id): distinct ids of fallback lines in first-seen order."""
    found = logs.withColumn("paper_id", F.regexp_extract("line", FALLBACK_LINE, 1)).filter("paper_id <> ''")
    return first_seen(found, ["run_id"], "paper_id", "pos", limit)


def first_seen(df: DataFrame, group: Sequence[str], value: str, pos: str, limit: int) -> DataFrame:
    """Distinct values per group in order of first appearance, the first ``limit``."""
    firsts = df.groupBy(*group, value).agg(F.min(pos).alias("_first"))
    return topk(firsts, group, [F.col("_first"), F.col(value)], limit).drop("_first")


def fixed_terms(notes: DataFrame, known: DataFrame, group: str, limit: int = 12) -> DataFrame:
    """(group, rank, term, n): CamelCase and ALL-CAPS tokens seen twice and more that are no known name."""
    stop = ("ARXIV", "PDF", "HTML", "NOT", "STATED", "THE", "AND", "FOR", "OF", "IN", "WITH")
    pattern = r"\b(?:[A-Z][a-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z]{2,}[A-Za-z0-9]*)(?:-[A-Za-z0-9]+)*\b"
    found = notes.select(group, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term")).filter(
        ~F.upper("term").isin(*stop))
    counted = found.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").withColumn("_k", casefold(F.col("term")))
    fresh = counted.join(known.select(group, casefold(F.col("name")).alias("_k")).distinct(), [group, "_k"], "left_anti")
    return topk(fresh, [group], [F.col("n").desc(), F.col("term")], limit).select(group, "rank", "term", "n")


CALL_FIELDS = ("ms", "inputTokens", "outputTokens", "reasoningTokens")


def call_rows(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(run_id, call_no, node, kind, paper_id, ms, ...): allow-listed call fields from a JSON array.

    Usage in the standard field wins over the raw one; a missing count stays NULL.
    """
    schema = ("array<struct<node:string,kind:string,paperId:string,ms:string,inputTokens:string,outputTokens:string,reasoningTokens:string,"
              "usage_metadata:struct<input_tokens:string,output_tokens:string,output_token_details:struct<reasoning:string>>,"
              "token_usage:struct<prompt_tokens:string,completion_tokens:string,completion_tokens_details:struct<reasoning_tokens:string>>>>")
    rows = records.select("run_id", F.posexplode(F.slice(F.from_json(payload, schema), 1, 64)).alias("call_no", "c"))
    kind = F.trim(F.coalesce("c.kind", F.lit("")))
    whole = lambda *cs: F.coalesce(*[F.when(c.try_cast("bigint") >= 0, c.try_cast("bigint")) for c in cs])
    order = F.array_position(F.array(*[F.lit(n) for n in CALL_ORDER]), F.col("c.node"))
    return rows.filter(kind.rlike("^[a-z][a-z_]{0,23}$")).select(
        "run_id", F.col("call_no").cast("long").alias("call_no"), F.col("c.node").alias("node"), kind.alias("kind"),
        F.when(F.col("c.paperId").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,255}$"), F.col("c.paperId")).alias("paper_id"),
        whole(F.col("c.ms")).alias("ms"),
        whole(F.col("c.inputTokens"), F.col("c.usage_metadata.input_tokens"), F.col("c.token_usage.prompt_tokens")).alias("input_tokens"),
        whole(F.col("c.outputTokens"), F.col("c.usage_metadata.output_tokens"), F.col("c.token_usage.completion_tokens")).alias("output_tokens"),
        whole(F.col("c.reasoningTokens"), F.col("c.usage_metadata.output_token_details.reasoning"),
              F.col("c.token_usage.completion_tokens_details.reasoning_tokens")).alias("reasoning_tokens"),
        order.cast("long").alias("pipeline_pos"))


def flatten_timings(records: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, name, ms): numeric leaves of nested maps as dotted names, four levels deep, 128 per record."""
    name_ok = lambda c: c.rlike(r"^[A-Za-z][A-Za-z0-9_.:-]{0,95}$")
    level = records.select(key, F.lit("").alias("path"), F.try_parse_json(payload).alias("v"))
    out = None
    for _ in range(4):
        objects = level.filter(F.schema_of_variant("v").startswith("OBJECT"))
        parts = objects.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "part")).select(
            key, "path", "pos", "k", F.col("part").alias("v"))
        named = parts.filter(name_ok(F.trim("k")) & (F.col("pos") < 128)).select(
            key, F.when(F.col("path") == "", F.trim("k")).otherwise(F.concat("path", F.lit("."), F.trim("k"))).alias("path"), "v")
        kind = F.schema_of_variant("v")
        num = F.try_variant_get("v", "$", "double")
        leaf = named.filter(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "BOOLEAN") & (num >= 0) & (num < 1e15)).select(
            key, F.col("path").alias("name"), F.least(F.floor(num), F.lit(604800000)).cast("long").alias("ms"))
        out = leaf if out is None else out.unionByName(leaf)
        level = named.filter(kind.startswith("OBJECT"))
    return topk(out, [key], [F.col("name")], 128).drop("rank")


def sanitize_facts(facts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep (node, fact) pairs of the allow-list; counts become non-negative numbers or drop out.

    ``facts``: (event_id, node, fact, value text); ``allowed``: (node, fact, kind).
    """
    j = facts.join(allowed, ["node", "fact"])
    number = F.col("value").try_cast("bigint")
    clean = F.when(F.col("kind") == "count", F.when(number >= 0, number.cast("string"))).otherwise(safe_text(F.col("value"), 80))
    return j.withColumn("value", clean).filter("value IS NOT NULL").drop("kind")
