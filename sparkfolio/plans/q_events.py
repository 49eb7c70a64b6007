"""Telemetry and run-event queries on the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sparkfolio.functions.text import word_count
from sparkfolio.operators import eventlog as el, telemetry as tm
from sparkfolio.plans.bindings import CALLS_SQL, RUN_EVENTS_SQL, calls, run_events, with_ctes
from sparkfolio.plans.q_ground import wc
from sparkfolio.plans.registry import query, table
from sparkfolio.scale import exact_percentiles, position_block

SEQ_SQL = "ev AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM run_events)"
EV = with_ctes(RUN_EVENTS_SQL, SEQ_SQL)


def _seq(spark, sf):
    return el.assign_seq(run_events(spark, sf))


@query("percentile_linear", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentile_linear(spark, sf):
    out = exact_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("percentile_nearest", """
SELECT user_id, max(value) FILTER (rn = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(value) FILTER (rn = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)) AS p90 FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1""")
def percentile_nearest(spark, sf):
    return exact_percentiles(table(spark, sf, "events"), ["user_id"], "value", {"p50": 0.5, "p90": 0.9}, nearest=True)


_LONG = """lg AS (SELECT stage, variant, ok, case_id, unnest(['seconds', 'input_tokens', 'output_tokens', 'reasoning_tokens']) AS metric,
  unnest([seconds, CAST(input_tokens AS DOUBLE), CAST(output_tokens AS DOUBLE), CAST(reasoning_tokens AS DOUBLE)]) AS value FROM calls),
cs AS (SELECT stage, variant, metric, count(*) AS n_calls, count(*) FILTER (NOT ok) AS n_failed, count(value) AS n, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.9), 2) AS p90 FROM lg GROUP BY ALL)"""


@query("call_dist", with_ctes(CALLS_SQL, _LONG) + "SELECT * FROM cs")
def call_dist(spark, sf):
    return tm.call_stats(calls(spark, sf))


@query("rep_spread", with_ctes(CALLS_SQL) + """
SELECT stage, variant, round(median(r), 2) AS spread FROM (SELECT stage, variant, case_id, max(output_tokens) / min(output_tokens) AS r FROM calls WHERE output_tokens > 0 GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL""")
def rep_spread(spark, sf):
    return tm.rep_spread(calls(spark, sf))


@query("variant_delta", with_ctes(CALLS_SQL, _LONG) + """
SELECT a.stage, a.variant, a.metric, round((a.median - b.median) / nullif(b.median, 0) * 100, 1) AS delta_pct FROM cs a JOIN cs b ON a.stage = b.stage AND a.metric = b.metric AND b.variant = 'v0' WHERE a.variant = 'new'""")
def variant_delta(spark, sf):
    return tm.variant_delta(tm.call_stats(calls(spark, sf)), "v0")


@query("quality_agg", f"""
WITH c AS (SELECT role, conv_id % 5 <> 0 AS parse_ok, turn % 3 <> 0 AS ne, {wc('text')} AS words, turn % 4 AS eq FROM conversations)
SELECT role, round(avg(CASE WHEN parse_ok THEN 1 ELSE 0 END), 4) AS parse_rate, round(avg(CASE WHEN parse_ok THEN CASE WHEN ne THEN 1 ELSE 0 END END), 4) AS all_nonempty_rate,
  round(avg(CASE WHEN parse_ok THEN eq END), 4) AS equations_mean, round(quantile_cont(words, 0.5) FILTER (parse_ok), 2) AS words_median FROM c GROUP BY role""")
def quality_agg(spark, sf):
    c = table(spark, sf, "conversations").select(
        "role", (F.col("conv_id") % 5 != 0).alias("parse_ok"), (F.col("turn") % 3 != 0).alias("all_nonempty"),
        word_count(F.col("text")).alias("words"), (F.col("turn") % 4).alias("equations"))
    return tm.quality_agg(c, ["role"])


@query("fact_totals", """
SELECT lang, count(*) AS n_papers, CAST(sum(doc_id % 5) AS BIGINT) AS table_count, CAST(sum(n_chars // 100) AS BIGINT) AS reference_count, count(*) FILTER (contains(text, 'der')) AS hardware_count,
  CASE WHEN count(DISTINCT s) = 0 THEN 'unknown' WHEN count(DISTINCT s) = 1 THEN max(s) ELSE 'mixed' END AS source FROM (
  SELECT *, CASE WHEN lang = 'en' THEN 'pdf' WHEN lang = 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'ar5iv' ELSE 'pdf' END END AS s FROM documents) GROUP BY lang""")
def fact_totals(spark, sf):
    d = table(spark, sf, "documents")
    src = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "fr", F.when(F.col("doc_id") % 2 == 0, "ar5iv").otherwise("pdf")).otherwise("web")
    return tm.fact_totals(d.select("lang", src.alias("source"), (F.col("doc_id") % 5).alias("table_count"),
                                   F.floor(F.col("n_chars") / 100).alias("reference_count"), F.col("text").contains("der").alias("hardware")), "lang")




@query("llm_call_totals", with_ctes(CALLS_SQL) + """
SELECT case_id, stage, count(*) AS n_calls, coalesce(CAST(sum(input_tokens) AS BIGINT), -1) AS input_tokens, coalesce(CAST(sum(output_tokens) AS BIGINT), -1) AS output_tokens, coalesce(CAST(sum(reasoning_tokens) AS BIGINT), -1) AS reasoning_tokens, max(seconds) AS longest FROM calls GROUP BY ALL""")
def llm_call_totals(spark, sf):
    out = tm.call_totals(calls(spark, sf), ["case_id", "stage"])
    return out.select("case_id", "stage", "n_calls", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens")], "longest")


@query("call_line", with_ctes(CALLS_SQL) + """
SELECT case_id, event_id // 100 AS step, count(*) AS n_calls, max(seconds) AS longest, coalesce(CASE WHEN count(input_tokens) = count(*) THEN CAST(sum(input_tokens) AS BIGINT) END, -1) AS input_tokens,
 coalesce(CASE WHEN count(output_tokens) = count(*) THEN CAST(sum(output_tokens) AS BIGINT) END, -1) AS output_tokens, coalesce(CASE WHEN count(reasoning_tokens) = count(*) THEN CAST(sum(reasoning_tokens) AS BIGINT) END, -1) AS reasoning_tokens FROM calls GROUP BY ALL""")
def call_line(spark, sf):
    c = calls(spark, sf).withColumn("step", F.floor(F.col("event_id") / 100))
    out = tm.step_calls(c, ["case_id", "step"])
    return out.select("case_id", "step", "n_calls", "longest", *[F.coalesce(x, F.lit(-1)).alias(x) for x in ("input_tokens", "output_tokens", "reasoning_tokens")])


_NODE7 = "['router', 'search_papers', 'read_paper', 'write_notes', 'summarize', 'citation_graph', 'web_enrich']"


@query("duration_estimate", f"""
WITH t AS (SELECT user_id AS run_id, ({_NODE7})[CAST(event_id % 7 AS INTEGER) + 1] AS node, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events),
p AS (SELECT run_id, sum(CASE WHEN node IN ('router', 'search_papers', 'read_paper') THEN ms ELSE 0 END) AS s, sum(CASE WHEN node IN ('write_notes', 'summarize') THEN ms ELSE 0 END) AS n,
  sum(CASE WHEN node = 'citation_graph' THEN ms ELSE 0 END) AS g, sum(CASE WHEN node = 'web_enrich' THEN ms ELSE 0 END) AS w FROM t GROUP BY 1)
SELECT run_id, CAST(round_even((s + greatest(n, g, w)) / 1000, 0) AS BIGINT) AS seconds FROM p""")
def duration_estimate(spark, sf):
    names = F.array(*[F.lit(n) for n in ("router", "search_papers", "read_paper", "write_notes", "summarize", "citation_graph", "web_enrich")])
    t = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("node"),
                                          F.floor(F.col("value") * 1000).alias("ms"))
    return tm.run_duration(t)


@query("node_wall", with_ctes(RUN_EVENTS_SQL) + """
, d AS (SELECT run_id, node, event_id * 3 - coalesce(lag(event_id) OVER (PARTITION BY run_id ORDER BY event_id), 0) * 3 AS s FROM run_events)
SELECT run_id, node, round(sum(s), 1)::DOUBLE AS seconds FROM d GROUP BY ALL""")
def node_wall(spark, sf):
    up = run_events(spark, sf).select("run_id", "node", F.col("event_id").alias("pos"), (F.col("event_id") * 3.0).alias("at_s"), F.lit(0.0).alias("start_s"))
    return tm.node_wall(up, position_block(F.col("pos"), 1024))


@query("asof_attribute", with_ctes(RUN_EVENTS_SQL) + """
, e AS (SELECT run_id, event_id AS pos, node, CAST(event_id * 10 AS DOUBLE) AS end_s FROM run_events WHERE type = 'step.completed'),
c AS (SELECT run_id, event_id AS call_id, event_id * 10 + value AS end_s FROM run_events WHERE type = 'step.updated')
SELECT c.run_id, call_id, coalesce((SELECT arg_min(e.node, e.end_s) FROM e WHERE e.run_id = c.run_id AND round(e.end_s + 0.05, 6) >= round(c.end_s, 6)), 'unknown') AS node FROM c""")
def asof_attribute(spark, sf):
    ev = run_events(spark, sf)
    ends = ev.filter("type = 'step.completed'").select("run_id", F.col("event_id").alias("pos"), "node", (F.col("event_id") * 10.0).alias("end_s"))
    cl = ev.filter("type = 'step.updated'").select("run_id", F.col("event_id").alias("call_id"), (F.col("event_id") * 10 + F.col("value")).alias("end_s"))
    return tm.asof_forward(cl, ends)


_LOGS_SQL = """logs AS (SELECT user_id AS run_id, event_id AS pos, CASE WHEN event_type = 'error' THEN 'error' ELSE 'trace' END AS channel,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'No selected papers here' ELSE 'failed pdf' END WHEN 'view' THEN '[write_notes] p' || CAST(event_id % 9 AS VARCHAR) || ': PMRL fallback used'
  WHEN 'click' THEN '[read_paper] ok' WHEN 'signup' THEN 'report saved: r' || CAST(event_id AS VARCHAR) || '.md' ELSE 'other' END AS line FROM events)"""


def _logs(spark, sf):
    et, n = F.col("event_type"), F.col("event_id")
    line = (F.when(et == "error", F.when(n % 3 == 0, "No selected papers here").otherwise("failed pdf"))
            .when(et == "view", F.concat(F.lit("[write_notes] p"), (n % 9).cast("string"), F.lit(": PMRL fallback used")))
            .when(et == "click", "[read_paper] ok").when(et == "signup", F.concat(F.lit("report saved: r"), n.cast("string"), F.lit(".md"))).otherwise("other"))
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), n.alias("pos"), F.when(et == "error", "error").otherwise("trace").alias("channel"), line.alias("line"))


@query("log_facts", "WITH " + _LOGS_SQL + """
SELECT run_id, count(*) FILTER (line = 'failed pdf') AS failed_inputs, arg_max(regexp_extract(line, '^\\[([^\\]]+)\\]', 1), pos) FILTER (line LIKE '[%') AS last_node,
  arg_max(substring(line, 15), pos) FILTER (line LIKE 'report saved%') AS report_id FROM logs GROUP BY 1""")
def log_facts(spark, sf):
    return tm.log_facts(_logs(spark, sf))


@query("fallback_ids", "WITH " + _LOGS_SQL + """
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY p, paper_id) AS rank, paper_id FROM (SELECT run_id, regexp_extract(line, '(p\\d+):', 1) AS paper_id, min(pos) AS p FROM logs WHERE line LIKE '[write%' GROUP BY ALL)""")
def fallback_ids(spark, sf):
    return tm.fallback_ids(_logs(spark, sf)).select("run_id", "rank", "paper_id")


@query("first_seen_order", """
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) AS rank, event_type FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) QUALIFY rank <= 4""")
def first_seen_order(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_type", "event_id")
    return tm.first_seen(ev, ["run_id"], "event_type", "event_id", 4).select("run_id", "rank", "event_type")


@query("term_counts", """
WITH n AS (SELECT source AS g, unnest(regexp_extract_all(' ' || regexp_replace(text || ' ' || upper(substring(lang, 1, 2)) || 'Net' || CAST(doc_id % 4 AS VARCHAR) || ' BERT pdf PDF', '[^A-Za-z0-9]+', '  ', 'g') || ' ', ' ([A-Z][a-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z]{2,}[A-Za-z0-9]*) ', 1)) AS term FROM documents),
c AS (SELECT g, term, count(*) AS n FROM n WHERE upper(term) NOT IN ('ARXIV', 'PDF', 'HTML', 'NOT', 'STATED', 'THE', 'AND', 'FOR', 'OF', 'IN', 'WITH') GROUP BY ALL HAVING count(*) >= 2)
SELECT g, row_number() OVER (PARTITION BY g ORDER BY n DESC, term) AS rank, term, n FROM c WHERE lower(term) <> 'bert' QUALIFY rank <= 12""")
def term_counts(spark, sf):
    d = table(spark, sf, "documents")
    noted = F.concat("text", F.lit(" "), F.upper(F.substring("lang", 1, 2)), F.lit("Net"), (F.col("doc_id") % 4).cast("string"), F.lit(" BERT pdf PDF"))
    notes = d.select(F.col("source").alias("g"), F.regexp_replace(noted, "[^A-Za-z0-9]+", "  ").alias("text"))
    return tm.fixed_terms(notes, d.select(F.col("source").alias("g"), F.lit("Bert").alias("name")), "g")


@query("running_seq", EV + "SELECT run_id, event_id, seq FROM ev")
def running_seq(spark, sf):
    return _seq(spark, sf).select("run_id", "event_id", "seq")


@query("append_event", EV + """
SELECT run_id, event_id, seq, CASE WHEN type = 'step.updated' THEN props ELSE '-' END AS facts, greatest(0, least(1, value / 100))::DOUBLE AS progress FROM ev""")
def append_event(spark, sf):
    ev = run_events(spark, sf).withColumn("facts", F.col("props")).withColumn("progress", F.col("value") / 100)
    return el.append_event(ev).select("run_id", "event_id", "seq", F.coalesce("facts", F.lit("-")).alias("facts"), "progress")


@query("events_after", EV + "SELECT run_id, seq, event_id FROM ev WHERE seq > run_id % 60")
def events_after(spark, sf):
    ev = _seq(spark, sf)
    return el.replay(ev, ev.select("run_id", (F.col("run_id") % 60).alias("after_seq")).distinct()).select("run_id", "seq", "event_id")


@query("apply_idempotent", EV + """
, a AS (SELECT run_id, seq, event_id * 2 AS arrival FROM ev UNION ALL SELECT run_id, seq, event_id * 2 + 51 FROM ev WHERE event_id % 4 = 0)
SELECT run_id, seq, arrival FROM (SELECT *, max(seq) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a) WHERE m IS NULL OR seq > m""")
def apply_idempotent(spark, sf):
    ev = _seq(spark, sf)
    twice = ev.select("run_id", "seq", (F.col("event_id") * 2).alias("arrival")).unionByName(
        ev.filter("event_id % 4 = 0").select("run_id", "seq", (F.col("event_id") * 2 + 51).alias("arrival")))
    return el.drop_replayed(twice).select("run_id", "seq", "arrival")


def _folded(spark, sf):
    ev = _seq(spark, sf)
    status = F.when(F.col("k") % 11 == 0, "error").when(F.col("k") % 13 == 0, "skipped").otherwise("completed")
    return ev.withColumn("status", status).withColumn("duration_ms", F.when(F.col("k") % 2 == 0, F.col("k"))).withColumn(
        "delta", F.when(F.col("type") == "step.updated", F.col("props")))


_FOLD_SQL = """fe AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'error' WHEN k % 13 = 0 THEN 'skipped' ELSE 'completed' END AS status, CASE WHEN k % 2 = 0 THEN k END AS duration_ms FROM ev),
st AS (SELECT run_id, node, min(seq) AS first_seq, count(*) AS n_events, max(seq) FILTER (type = 'step.completed') AS done, arg_max(status, seq) FILTER (type = 'step.completed') AS outcome,
  max(seq) FILTER (type = 'step.started') AS st, arg_max(duration_ms, seq) FILTER (duration_ms IS NOT NULL) AS duration_ms FROM fe WHERE type LIKE 'step.%' GROUP BY ALL),
en AS (SELECT run_id, max(seq) AS e FROM fe WHERE type = 'run.failed' GROUP BY 1),
sj AS (SELECT *, CASE WHEN done IS NULL THEN greatest(first_seq, coalesce(st, first_seq)) WHEN outcome = 'completed' THEN NULL WHEN st > done THEN st END AS since FROM st LEFT JOIN en USING (run_id))"""


@query("run_state_fold", EV + "," + _FOLD_SQL + """
SELECT run_id, node, CASE WHEN since IS NULL THEN outcome WHEN e > since THEN 'error' ELSE 'running' END AS status, coalesce(duration_ms, -1) AS duration_ms, n_events FROM sj""")
def run_state_fold(spark, sf):
    return el.fold_steps(_folded(spark, sf)).select("run_id", "node", "status", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"), "n_events")


@query("run_fold", EV + """
SELECT run_id, max(seq) AS last_seq, CASE WHEN count(*) FILTER (type = 'run.failed') > 0 THEN 'error' ELSE 'running' END AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
  count(*) FILTER (type = 'assistant.delta') AS n_deltas, CAST(coalesce(sum(CASE WHEN type = 'assistant.delta' THEN length(props) END), 0) AS BIGINT) AS answer_chars
FROM (SELECT * REPLACE (CASE WHEN event_type = 'click' THEN 'assistant.delta' ELSE type END AS type) FROM ev) GROUP BY 1""")
def run_fold(spark, sf):
    ev = _folded(spark, sf).withColumn("type", F.when(F.col("event_type") == "click", "assistant.delta").otherwise(F.col("type")))
    out = el.fold_runs(ev)
    return out.select("run_id", "last_seq", "status", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_deltas", "answer_chars")


@query("reduce_state", EV + """
SELECT run_id, event_type AS key, node AS subkey, arg_max(CAST(k AS VARCHAR), seq) AS value FROM ev GROUP BY ALL""")
def reduce_state(spark, sf):
    up = _seq(spark, sf).select("run_id", "seq", F.col("event_type").alias("key"), F.col("node").alias("subkey"), F.col("k").cast("string").alias("value"))
    return el.reduce_updates(up)


@query("log_rows", EV + """
, l AS (SELECT run_id, 'trace_logs' AS key, seq, props AS value, event_id % 29 = 0 AS snap FROM ev), s AS (SELECT run_id, max(seq) FILTER (snap) AS m FROM l GROUP BY 1)
SELECT l.run_id, key, seq, value FROM l JOIN s USING (run_id) WHERE m IS NULL OR seq >= m""")
def log_rows(spark, sf):
    up = _seq(spark, sf).select("run_id", "seq", F.lit("trace_logs").alias("key"), F.col("props").alias("value"), (F.col("event_id") % 29 == 0).alias("is_snapshot"))
    return el.log_rows(up)


@query("step_durations", EV + """
SELECT run_id, task_id, coalesce(CASE WHEN e >= s THEN date_diff('microsecond', s, e) // 1000000 END, -1) AS seconds, coalesce(e >= s, false) AS finished FROM (
  SELECT run_id, node AS task_id, min(ts) FILTER (type = 'step.started') AS s, max(ts) FILTER (type = 'step.completed') AS e FROM ev GROUP BY ALL)""")
def step_durations(spark, sf):
    out = el.step_durations(run_events(spark, sf).withColumn("task_id", F.col("node")))
    return out.select("run_id", "task_id", F.coalesce("seconds", F.lit(-1)).alias("seconds"), "finished")


@query("terminal_status", """
SELECT user_id AS run_id, CASE WHEN max(event_type = 'error' AND event_id % 50 = 1) THEN 'error' WHEN max(event_type = 'view' AND event_id % 40 = 2) OR max(CASE WHEN event_type = 'click' THEN event_id % 30 // 29 ELSE 0 END) > 0 THEN 'degraded' ELSE 'success' END AS status FROM events GROUP BY 1""")
def terminal_status(spark, sf):
    n, et = F.col("event_id"), F.col("event_type")
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), ((et == "error") & (n % 50 == 1)).alias("task_error"), ((et == "view") & (n % 40 == 2)).alias("incomplete_source"),
        F.when(et == "click", F.floor(n % 30 / 29)).otherwise(0).alias("n_errors"))
    return el.run_status(ev)


@query("active_runs", EV + "SELECT DISTINCT run_id FROM ev WHERE run_id NOT IN (SELECT run_id FROM ev WHERE type = 'run.failed' AND event_id % 31 = 0)")
def active_runs(spark, sf):
    ev = run_events(spark, sf)
    return el.active_runs(ev.withColumn("type", F.when((F.col("type") == "run.failed") & (F.col("event_id") % 31 != 0), "step.updated").otherwise(F.col("type"))))


@query("gate_violations", """
WITH r AS (SELECT event_id AS run_id, ts AS started, ts + to_seconds(CAST(floor(value * 4) AS BIGINT)) AS ended FROM events),
b AS (SELECT *, max(ended) OVER (ORDER BY started, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM r)
SELECT run_id FROM b WHERE started < busy""")
def gate_violations(spark, sf):
    ev = table(spark, sf, "events")
    ended = F.timestamp_add("SECOND", F.floor(F.col("value") * 4).cast("int"), F.col("ts"))
    return el.gate_violations(ev.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started"), ended.alias("ended"))).select("run_id")


ALLOWED = [("node_0", "resultCount", "count"), ("node_1", "selectedCount", "count"), ("node_2", "intent", "text")]


@query("step_facts", """
SELECT event_id, node, fact, CASE WHEN node = 'node_2' THEN event_type ELSE CAST(k AS VARCHAR) END AS value FROM (
  SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'node_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS node,
    CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN 'resultCount' WHEN 1 THEN 'selectedCount' WHEN 2 THEN 'intent' ELSE 'other' END AS fact FROM events)
WHERE fact <> 'other' AND NOT (fact <> 'intent' AND event_id % 6 = 0)""")
def step_facts(spark, sf):
    k5 = F.col("k") % 5
    fact = F.when(k5 == 0, "resultCount").when(k5 == 1, "selectedCount").when(k5 == 2, "intent").otherwise("secret")
    value = F.when(k5 == 2, F.col("event_type")).otherwise(F.when(F.col("event_id") % 6 == 0, "-1").otherwise(F.col("k").cast("string")))
    facts = run_events(spark, sf).select("event_id", "node", fact.alias("fact"), value.alias("value"))
    return tm.sanitize_facts(facts, spark.createDataFrame(ALLOWED, "node string, fact string, kind string")).select("event_id", "node", "fact", "value")


@query("timings_flatten", """
SELECT event_id, 'k' AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ms FROM events UNION ALL SELECT event_id, 'a.b', CAST(floor(value) AS BIGINT) FROM events UNION ALL SELECT event_id, 'a.c.d.e', event_id FROM events""")
def timings_flatten(spark, sf):
    payload = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "_x": 5, "on": true, "s": "txt", "a": {"b": '), F.format_string("%.2f", "value"),
                       F.lit(', "c": {"d": {"e": '), F.col("event_id").cast("string"), F.lit(', "f": {"g": 1}}}}}'))
    return tm.flatten_timings(table(spark, sf, "events").select("event_id", payload.alias("payload")), "event_id")


@query("run_summary", EV + """
SELECT run_id, max(node = 'node_4' AND k % 50 = 4) AS quick, coalesce(max(CASE WHEN k = 77 THEN k END), CAST(round(date_diff('millisecond', arg_min(ts, seq), arg_max(ts, seq) FILTER (type = 'run.failed')) / 1000) AS BIGINT), -1) AS seconds FROM ev GROUP BY run_id""")
def run_summary(spark, sf):
    ev = _seq(spark, sf).withColumn("node", F.when((F.col("node") == "node_4") & (F.col("k") % 50 == 4), "answer_followup").otherwise(F.col("node"))).withColumn(
        "intent", F.lit("")).withColumn("summary_seconds", F.when(F.col("k") == 77, F.col("k")))
    return el.run_summary(ev).select("run_id", "quick", F.coalesce("seconds", F.lit(-1)).alias("seconds"))


# Every third message repeats the whole conversation before it, as a cumulative producer does.
CHUNKS_SQL = """WITH RECURSIVE c AS (
  SELECT conv_id, row_number() OVER w AS pos, CASE WHEN turn % 3 = 2 THEN coalesce(string_agg(text, '' ) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END || text AS text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, pos, text AS so_far, false AS again FROM c WHERE pos = 1
  UNION ALL SELECT c.conv_id, c.pos, CASE WHEN length(so_far) > 8 AND starts_with(c.text, so_far) THEN '' ELSE so_far END || c.text, length(so_far) > 8 AND starts_with(c.text, so_far)
  FROM f JOIN c ON c.conv_id = f.conv_id AND c.pos = f.pos + 1)"""


def _chunks(spark, sf):
    so_far = Window.partitionBy("conv_id").orderBy("turn")
    before = F.array_join(F.collect_list("text").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), "")
    text = F.concat(F.when(F.col("turn") % 3 == 2, before).otherwise(""), "text")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.row_number().over(so_far).alias("pos"), text.alias("text"))


@query("flag_restarts", CHUNKS_SQL + "SELECT conv_id AS run_id, CAST(pos AS BIGINT) AS pos, again AS restart FROM f")
def flag_restarts(spark, sf):
    return el.flag_restarts(_chunks(spark, sf)).select("run_id", F.col("pos").cast("long").alias("pos"), "restart")


@query("merge_chunks", CHUNKS_SQL + """
SELECT conv_id AS run_id, CAST(0 AS BIGINT) AS piece, md5(arg_max(so_far, pos)) AS text_md5, CAST(length(arg_max(so_far, pos)) AS BIGINT) AS chars FROM f GROUP BY 1""")
def merge_chunks(spark, sf):
    return el.merge_chunks(el.flag_restarts(_chunks(spark, sf))).select("run_id", "piece", F.md5("text").alias("text_md5"), "chars")


@query("lifecycle_once", EV + """
, l AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE 't' || CAST(k AS VARCHAR) END AS task_id FROM ev)
SELECT run_id, seq FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, type, coalesce(task_id, 'node:' || node) ORDER BY seq) AS rn FROM l WHERE type IN ('step.started', 'step.completed')) WHERE rn = 1
UNION ALL SELECT run_id, seq FROM l WHERE type NOT IN ('step.started', 'step.completed')""")
def lifecycle_once(spark, sf):
    ev = _seq(spark, sf).withColumn("task_id", F.when(F.col("k") % 3 != 0, F.concat(F.lit("t"), F.col("k").cast("string"))))
    return el.lifecycle_once(ev).select("run_id", "seq")


@query("delta_segments", """
WITH a AS (SELECT conv_id * 1000 + turn AS run_id, text, unnest(range(1, 2 + length(text) // 50)) AS pos FROM conversations)
SELECT run_id, pos, substring(text, 50 * (pos - 1) + 1, 50) AS delta FROM a WHERE length(text) > 50 * (pos - 1)""")
def delta_segments(spark, sf):
    # Each message is one answer that grows by 50 characters; every third state arrives twice.
    c = table(spark, sf, "conversations")
    grown = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"), "text", F.explode(
        F.sequence(F.lit(1), F.floor(F.length("text") / 50).cast("int") + 1)).alias("step"))
    states = grown.select("run_id", F.explode(F.when(F.col("step") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
                          "step", F.expr("substring(text, 1, 50 * step)").alias("answer"))
    rows = states.select("run_id", (F.col("step") * 2 + F.col("again")).cast("long").alias("pos"), "answer")
    out = el.delta_segments(rows)
    return out.select("run_id", F.floor(F.col("pos") / 2).alias("pos"), "delta")


@query("step_duration_pick", """
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id END, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END, CASE WHEN event_id % 5 = 0 THEN event_id + 2 END, -1) AS duration_ms FROM events""")
def step_duration_pick(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select("event_id", el.pick_duration(
        F.when(n % 2 == 0, n), F.when(n % 3 == 0, n + 1), F.when(n % 5 == 0, n + 2), F.lit(-1)).alias("duration_ms"))


@query("latency_compare", """
WITH n AS (SELECT user_id AS run_id, 'node_' || CAST(event_id % 4 AS VARCHAR) AS node, event_type, value FROM events WHERE event_type IN ('click', 'view'))
SELECT run_id, node, round(round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 6), 1) AS cand_seconds, round(round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 6), 1) AS base_seconds FROM n GROUP BY ALL""")
def latency_compare(spark, sf):
    from sparkfolio.operators.joins import latency_nodes

    ev = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.concat(F.lit("node_"), (F.col("event_id") % 4).cast("string")).alias("node"),
                                           "event_type", F.col("value").alias("seconds"))
    return latency_nodes(ev.filter("event_type = 'click'"), ev.filter("event_type = 'view'"))


@query("latency_target", """
WITH t AS (SELECT user_id AS run_id, sum(value) FILTER (event_type = 'click') AS b, sum(value) FILTER (event_type = 'view') AS c, max(value) FILTER (event_type = 'view') AS m FROM events GROUP BY 1)
SELECT run_id, round(coalesce(b / nullif(c, 0), 0), 4) AS speedup, coalesce(m, 0) AS longest_call, coalesce(c > 0 AND c <= 60, false) AS target_met FROM t WHERE b IS NOT NULL OR c IS NOT NULL""")
def latency_target(spark, sf):
    from sparkfolio.operators.joins import latency_totals

    ev = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_type", F.col("value").alias("seconds"))
    out = latency_totals(ev.filter("event_type = 'click'"), ev.filter("event_type = 'view'"))
    return out.select("run_id", F.round("speedup", 4).alias("speedup"), "longest_call", "target_met")
