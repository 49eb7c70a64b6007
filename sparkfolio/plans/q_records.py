"""Record sources, identity joins, report links and small record functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import ids
from sparkfolio.functions.tex import first_json, tex_to_text
from sparkfolio.functions.text import squeeze
from sparkfolio.operators import (
    context as cx, eventlog as el, filters as fl, graph as gr, ground as gd, markdown as mk, pages as pg, resolve as rs, telemetry as tm,
)
from sparkfolio.plans.bindings import GOLD_SQL, PAPERS_SQL, QUERIES_SQL, gold, papers, search_queries, sq, with_ctes
from sparkfolio.plans.registry import query, table
from sparkfolio.session import work_dir
from sparkfolio.sources import papers as src, records as rec


@query("snapshot_write", with_ctes(PAPERS_SQL) + "SELECT paper_id, date FROM papers")
def snapshot_write(spark, sf):
    path = work_dir(spark)
    p = papers(spark, sf).select("paper_id", "date")
    src.write_snapshot(p.filter("paper_id > '2401.005'"), path, "v1")
    src.write_snapshot(p, path, "v2")
    return src.read_snapshot(spark, path)


@query("read_goldset", with_ctes(QUERIES_SQL, GOLD_SQL) + "SELECT DISTINCT query_id, query, paper_id FROM gold JOIN queries USING (query_id)")
def read_goldset(spark, sf):
    path = work_dir(spark) + "/gold"
    g = gold(spark, sf).join(search_queries(spark, sf), "query_id").select(
        F.col("query_id").cast("string").alias("survey_id"), "query", F.lit("2024-01-01").alias("date"), F.col("paper_id").alias("target"))
    rec.write_goldset(g, path)
    back = rec.read_goldset(spark, path)
    return back.select(F.col("survey_id").cast("long").alias("query_id"), "query", F.explode("gold").alias("paper_id"))


@query("read_runs", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)
SELECT 'run' || id AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'baseline' ELSE 'output' END AS layout, CASE WHEN doc_id % 3 = 0 THEN 'unknown' WHEN doc_id % 3 = 1 THEN 'success' ELSE 'running' END AS status,
  doc_id / 2 AS total_seconds, '2401.' || id AS arxiv_id, field, md5(CASE field WHEN 'problem' THEN lang WHEN 'method' THEN text ELSE '' END) AS text_md5
FROM d, (SELECT unnest(['problem', 'method', 'result', 'limitation']) AS field)""")
def read_runs(spark, sf):
    # Each document is the note of one run; every third run has the older layout.
    id_, lines = F.col("doc_id").cast("string"), lambda *c: F.to_json(F.struct(*c))
    d = table(spark, sf, "documents").withColumn("paper", F.concat(F.lit("arxiv_2401."), id_)).withColumn("folder", F.concat(F.lit("/runs/run"), id_))
    note = F.struct(F.col("lang").alias("problem"), F.col("text").alias("method"))
    file = lambda name, text: F.struct(F.concat("folder", F.lit(name)).alias("path"), text.alias("text"))
    older = F.array(
        file("/run.json", lines((F.col("doc_id") / 2).alias("total_seconds"), F.struct(F.create_map("paper", F.lit("notes/a.json")).alias("pmrl_by_paper")).alias("artifacts"))),
        file("/notes/a.json", F.to_json(note)))
    newer = F.array(
        file("/run.json", lines(F.lit("running").alias("status"), (F.col("doc_id") / 2).alias("total_seconds"))),
        file("/state.json", lines(F.when(F.col("doc_id") % 3 == 1, "success").alias("status"), F.array(F.struct(F.col("paper").alias("paper_id"), note.alias("notes"))).alias("selected_papers"))))
    files = d.select(F.explode(F.when(F.col("doc_id") % 3 == 0, older).otherwise(newer)).alias("f")).select("f.path", "f.text")
    runs, notes = rec.run_artifacts(files)
    return runs.join(notes, "run_id").select("run_id", "layout", "status", "total_seconds", "arxiv_id", "field", F.md5("text").alias("text_md5"))


@query("read_threads", """
SELECT 't' || CAST(conv_id AS VARCHAR) AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, md5(text) AS content_md5, CASE WHEN conv_id % 2 = 0 THEN 'New research' ELSE 'Talk' END AS title,
  CASE WHEN turn % 2 = 0 THEN 'success' ELSE 'error' END AS status FROM conversations WHERE conv_id % 7 <> 0 AND conv_id % 5 <> 0""")
def read_threads(spark, sf):
    # One file per conversation; every seventh is of another version, every fifth is cut short.
    c = table(spark, sf, "conversations")
    entry = F.struct("turn", "role", F.col("text").alias("content"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("runId"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("messages"))
    status = lambda m: F.struct(m["runId"].alias("runId"), F.when(m["turn"] % 2 == 0, "success").otherwise("running").alias("status"))
    text = F.to_json(F.struct(
        F.when(F.col("conv_id") % 7 == 0, 2).otherwise(1).alias("version"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("threadId"),
        F.when(F.col("conv_id") % 2 == 1, "Talk").otherwise(" ").alias("title"), "messages", F.transform("messages", status).alias("runs")))
    files = lists.select(F.when(F.col("conv_id") % 5 == 0, F.left(text, F.length(text) - 1)).otherwise(text).alias("text"))
    threads, messages, runs = rec.thread_records(files)
    return threads.join(messages, "thread_id").join(runs.select("thread_id", "pos", "status"), ["thread_id", "pos"]).select(
        "thread_id", F.col("pos").cast("long").alias("pos"), "role", F.md5("content").alias("content_md5"), "title", "status")


@query("read_atom", with_ctes(PAPERS_SQL) + """
SELECT paper_id || 'v1' AS arxiv_id, title, date AS published, primary_category || ',x' AS subjects, CASE WHEN title <> '' THEN 'complete' ELSE 'missing' END AS metadata_status FROM papers WHERE regexp_matches(paper_id, '^\\d{4}\\.')""")
def read_atom(spark, sf):
    path = work_dir(spark) + "/feed"
    cat = lambda c: F.struct(F.lit("").alias("_VALUE"), c.alias("_term"))
    feed = papers(spark, sf).select(
        F.concat(F.lit("http://arxiv.org/abs/"), "paper_id", F.lit("v1")).alias("id"), F.concat(F.lit("\n  "), "title").alias("title"),
        F.lit("s").alias("summary"), F.concat("date", F.lit("T00:00:00Z")).alias("published"),
        F.array(F.struct(F.lit("Ann Li").alias("name"))).alias("author"), F.array(cat(F.col("primary_category")), cat(F.lit("x"))).alias("category"))
    feed.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").mode("overwrite").save(path)
    return rec.read_atom(spark, path).select("arxiv_id", "title", "published", F.array_join("subjects", ",").alias("subjects"), "metadata_status")


@query("repo_source", """
SELECT doc_id AS paper_id, CASE WHEN doc_id % 4 = 0 THEN 'html' WHEN doc_id % 3 = 0 THEN 'github_search' ELSE 'none' END AS repo_source,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS repo_count FROM documents""")
def repo_source(spark, sf):
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"))
    html = p.filter("paper_id % 4 = 0").select("paper_id", F.explode(F.array(F.lit("u"), F.lit("u"))).alias("url"))
    hits = p.filter("paper_id % 3 = 0").select("paper_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("url"))
    return fl.repo_source(html, hits, p)


@query("lenient_records", """
SELECT doc_id, lang AS problem, CAST(doc_id AS VARCHAR) AS method, '' AS intuition, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_rows, CASE WHEN doc_id % 3 = 0 THEN '-' ELSE CAST(doc_id % 10 AS VARCHAR) || '.5' END AS method_value FROM documents WHERE doc_id % 5 <> 0""")
def lenient_records(spark, sf):
    n = F.col("doc_id").cast("string")
    rows = F.when(F.col("doc_id") % 3 == 0, '"none"').otherwise(F.concat(
        F.lit('[{"benchmark": "b", "metric": null, "method_value": '), (F.col("doc_id") % 10).cast("string"), F.lit('.5, "higher_is_better": true}]')))
    payload = F.concat(F.lit('{"problem": "'), "lang", F.lit('", "method": '), n, F.lit(', "result": "r", "limitation": "'),
                       F.when(F.col("doc_id") % 5 == 0, "").otherwise("l"), F.lit('", "intuition": null, "eval_settings": '), rows, F.lit("}"))
    out = rec.lenient_notes(table(spark, sf, "documents").select("doc_id", payload.alias("payload")))
    first = F.get("eval_settings", 0)
    return out.select("doc_id", "problem", "method", "intuition", F.size("eval_settings").cast("long").alias("n_rows"),
                      F.coalesce(first["method_value"], F.lit("-")).alias("method_value"))


@query("identity_join", with_ctes(PAPERS_SQL) + """
, u AS (SELECT lower(title) AS t, min(paper_id) AS id, count(DISTINCT paper_id) AS n FROM (SELECT paper_id, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS title FROM papers) GROUP BY 1),
w AS (SELECT *, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS nt FROM papers)
SELECT doc_id AS work_id, coalesce(CASE doc_id % 4 WHEN 0 THEN '9999.00001' WHEN 1 THEN paper_id WHEN 2 THEN paper_id ELSE CASE WHEN n = 1 AND len(string_split(nt, ' ')) >= 4 THEN u.id END END, '-') AS arxiv_id,
  coalesce(CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE n = 1 AND len(string_split(nt, ' ')) >= 4 END, false) AS in_index FROM w LEFT JOIN u ON u.t = w.nt""")
def identity_join(spark, sf):
    p = papers(spark, sf)
    k = F.col("doc_id") % 4
    none = F.array().cast("array<string>")
    works = p.select(F.col("doc_id").alias("work_id"), "title", F.when((k == 2) & F.col("paper_id").rlike(r"^\d"), F.concat(F.lit("https://doi.org/10.48550/arXiv."), "paper_id")).alias("doi"),
                     F.when((k == 2) & ~F.col("paper_id").rlike(r"^\d"), F.array(F.concat(F.lit("http://arxiv.org/abs/"), "paper_id", F.lit("v3")))).otherwise(none).alias("urls"))
    hints = p.filter(k == 0).select(F.col("doc_id").alias("work_id"), F.lit("9999.00001").alias("arxiv_id"))
    seeds = p.filter(k < 2).select(F.col("doc_id").alias("work_id"), F.col("paper_id").alias("arxiv_id"))
    return rs.identify(works, hints, seeds, p).select("work_id", F.coalesce("arxiv_id", F.lit("-")).alias("arxiv_id"), "in_index")


@query("title_precedence", f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {sq('text')} WHEN 1 THEN 'ref' WHEN 2 THEN 'own' ELSE 'W' || CAST(doc_id AS VARCHAR) END AS title, CASE doc_id % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'reference' WHEN 2 THEN 'paper' ELSE 'openalex' END AS title_source,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 2001 WHEN doc_id % 3 <> 0 THEN 2010 ELSE 1999 END AS BIGINT) AS year FROM documents WHERE {sq('text')} <> ''""")
def title_precedence(spark, sf):
    k = F.col("doc_id") % 4
    head = squeeze(F.col("text"))
    title, source = rs.best_title(F.when(k == 0, F.col("text")), F.when(k <= 1, "ref"), F.when(k <= 2, "own"), F.lit(" "),
                                  F.concat(F.lit("W"), F.col("doc_id").cast("string")))
    year = rs.best_year(F.when(k == 0, "2001").otherwise(""), F.lit(2010), F.col("doc_id") % 3 == 0, F.lit("1999-05"))
    return table(spark, sf, "documents").filter(head != "").select("doc_id", title.alias("title"), source.alias("title_source"), year.cast("long").alias("year"))


@query("table_support", """
SELECT DISTINCT l_orderkey * 1000000000 + l_partkey * 100 + l_linenumber AS row_id FROM lineitem WHERE (l_orderkey, l_linenumber % 2, CAST(l_quantity AS BIGINT)) IN (SELECT (l_orderkey, l_linenumber % 2, CAST(l_tax * 100 AS BIGINT) + 10) FROM lineitem)""")
def table_support(spark, sf):
    from sparkfolio.functions.numbers import decimal_tokens

    li = table(spark, sf, "lineitem")
    label = F.concat(F.lit("Table "), (F.col("l_linenumber") % 2).cast("string"))
    rows = li.select((F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("row_id"), F.col("l_orderkey").alias("paper_id"),
                     F.upper(label).alias("label"), decimal_tokens(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" %"))).alias("numbers"))
    tables = li.select(F.col("l_orderkey").alias("paper_id"), label.alias("label"), F.concat(F.lit("| "), (F.round(F.col("l_tax") * 100).cast("long") + 10).cast("string"), F.lit(" |")).alias("text"))
    return gd.rows_supported_by_table(rows, tables)


@query("unverified_drop", "SELECT p_partkey AS work_id FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def unverified_drop(spark, sf):
    n = F.col("p_partkey")
    w = table(spark, sf, "part").select(n.alias("work_id"), F.when(n % 2 == 0, "2401.00001").alias("arxiv_id"), F.when(n % 3 == 0, n + 1).alias("n_refs"),
                                        F.when(n % 5 == 0, "reference").otherwise("openalex").alias("title_source"))
    return gr.drop_unverified(w).select("work_id")


@query("table_numbers", "SELECT doc_id AS report_id, CASE WHEN doc_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'checked=3 bad=' || CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END AS detail FROM documents")
def table_numbers(spark, sf):
    n = (F.col("doc_id") % 1000 + 1000).cast("string")
    miss = F.when(F.col("doc_id") % 3 == 0, "7777.25").otherwise(n)
    text = F.concat(F.lit("## 2. Papers\n### One 2401.00001\n| set | metric | method | base |\n|---|---|---|---|\n| a | 9 | "), n, F.lit(" | 46,9 (best of 3) |\n### Two\n\n| x | y | z |\n|--|--|--|\n| q | w | "), miss, F.lit(" |\n"))
    d = table(spark, sf, "documents")
    reports = d.select(F.col("doc_id").alias("report_id"), text.alias("text"))
    lit = F.lit
    ps = d.select(F.col("doc_id").alias("report_id"), F.explode(F.array(
        F.struct(lit(0).alias("pos"), F.concat(lit("b"), F.col("doc_id").cast("string")).alias("paper_id"), lit("").alias("arxiv_id")),
        F.struct(lit(1).alias("pos"), F.concat(lit("a"), F.col("doc_id").cast("string")).alias("paper_id"), lit("2401.00001").alias("arxiv_id")))).alias("p")).select("report_id", "p.*")
    sources = d.select(F.concat(lit("a"), F.col("doc_id").cast("string")).alias("paper_id"), F.concat(n, lit(" and 46.9")).alias("text"))
    return gd.check_table_numbers(reports, ps, sources).select("report_id", "status", "detail")


@query("answer_structure", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'INFO' ELSE 'FAIL' END AS status, CASE doc_id % 4 WHEN 2 THEN 'results rows; single without setup block' WHEN 3 THEN 'kind; empty lead; actions; no blocks' ELSE '' END AS problems FROM documents""")
def answer_structure(spark, sf):
    k = F.col("doc_id") % 4
    head = '{"kind": "single", "lead": "x", "paper": {"a": 1}, "actions": {"reportId": null, "bibtexCount": 1, "graphNodes": 2}, "blocks": ['
    good = head + '{"type": "setup"}, {"type": "results", "rows": [{"setting": "a", "metric": "b", "method": "c", "baseline": "d", "delta": ""}]}]}'
    bad = head + '{"type": "results", "rows": [{"setting": "a"}]}]}'
    d = table(spark, sf, "documents").select("doc_id", F.when(k == 0, good).when(k == 2, bad).when(k == 3, "{}").alias("summary"))
    return rec.check_summary(d).select("doc_id", "status", "problems")


@query("rewrite_links", f"""
SELECT doc_id AS report_id, '# R' || chr(10) || 'see [code](https://github.com/a/b) ' || CASE WHEN doc_id % 2 = 0 THEN '[P ' || CAST(doc_id AS VARCHAR) || '](https://arxiv.org/abs/2401.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || ')' ELSE 'Other _(link unavailable: unverified source)_' END
  || ' and `Unverified link` _(link unavailable: unverified source)_' || chr(10) || lang AS text FROM documents""")
def rewrite_links(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("P "), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("# R\nLanguage Mode: en\nsee [code](http://github.com/a/b) "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), name, F.lit("](./paper_1.txt)"))).otherwise(
        "[Other](/tmp/x.txt)"), F.lit(" and https://evil.example/x\n"), "lang")
    ps = d.select(F.col("doc_id").alias("report_id"), name.alias("title"), F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")).alias("arxiv_id"))
    return mk.rewrite_links(d.select(F.col("doc_id").alias("report_id"), text.alias("text")), ps)


@query("tex_to_text", "SELECT doc_id, '(' || lang || ')/(2) ± α_(ab) ≤ √(x) {' || CAST(doc_id AS VARCHAR) || '} foo' AS t FROM documents")
def tex_to_text_query(spark, sf):
    tex = F.concat(F.lit(r"\frac{"), "lang", F.lit(r"}{2} \mathrm{} \pm \alpha_{ab} \left\leq \sqrt{x} \{"), F.col("doc_id").cast("string"), F.lit(r"\} \foo"))
    return table(spark, sf, "documents").select("doc_id", tex_to_text(tex).alias("t"))


@query("first_author", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS first_author FROM supplier")
def first_author(spark, sf):
    a = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    auth = F.when(F.col("s_suppkey") % 3 == 0, F.array(a(F.lit("")))).otherwise(F.array(a(F.lit(None).cast("string")), a(F.concat(F.lit(" "), "s_name", F.lit("  "))), a(F.lit("Z"))))
    return table(spark, sf, "supplier").select("s_suppkey", ids.first_author(auth).alias("first_author"))


@query("first_json", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '-' ELSE '{\"n\": ' || CAST(doc_id AS VARCHAR) || '}' END AS found FROM documents")
def first_json_query(spark, sf):
    obj = F.concat(F.lit('{"n": '), F.col("doc_id").cast("string"), F.lit("}"))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, obj).when(k == 1, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\nbye {x}"))).when(k == 2, F.concat(F.lit("Sure, "), obj, F.lit(" as asked }"))).otherwise("no {json here")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(first_json(text), F.lit("-")).alias("found"))


@query("llm_calls", """
SELECT event_id AS run_id, CAST(0 AS BIGINT) AS call_no, 'write_notes' AS node, 'pmrl' AS kind, event_id AS ms, CASE WHEN event_id % 2 = 0 THEN 5 ELSE CAST(event_id % 9 AS BIGINT) END AS input_tokens, CAST(-1 AS BIGINT) AS output_tokens FROM events""")
def llm_calls(spark, sf):
    n = F.col("event_id").cast("string")
    usage = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"usage_metadata": {"input_tokens": 5}, "token_usage": {"prompt_tokens": '), n, F.lit("}"))).otherwise(
        F.concat(F.lit('"token_usage": {"prompt_tokens": '), (F.col("event_id") % 9).cast("string"), F.lit("}")))
    payload = F.concat(F.lit('[{"node": "write_notes", "kind": "pmrl", "ms": '), n, F.lit(', "outputTokens": -4, "secret": "x", '), usage, F.lit('}, {"node": "a", "kind": "Bad Kind"}]'))
    out = tm.call_rows(table(spark, sf, "events").select(F.col("event_id").alias("run_id"), payload.alias("payload")))
    return out.select("run_id", "call_no", "node", "kind", "ms", "input_tokens", F.coalesce("output_tokens", F.lit(-1)).alias("output_tokens"))


@query("split_updates", """
SELECT event_id AS payload_id, CASE event_id % 4 WHEN 0 THEN 'read_paper' WHEN 1 THEN 'write_notes' ELSE 'final_report' END AS node FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, 'summarize' FROM events WHERE event_id % 4 = 0""")
def split_updates(spark, sf):
    k = F.col("event_id") % 4
    payload = (F.when(k == 0, '{"read_paper": {"a": 1}, "summarize": {"b": 2}}').when(k == 1, '{"status": "x", "trace_logs": ["[router] a", "[write_notes] b"]}')
               .when(k == 2, '{"node_timings": {"router": {}, "final_report": {"durationMs": 1}}}').otherwise('{"notes_branch": {"c": 3}}'))
    nodes = spark.createDataFrame([(n,) for n in ("router", "read_paper", "write_notes", "summarize", "final_report")], "node string")
    return el.split_updates(table(spark, sf, "events").select(F.col("event_id").alias("payload_id"), payload.alias("payload")), nodes).select("payload_id", "node")


@query("reading_order", """
SELECT conv_id AS doc_id, md5(string_agg(pt, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM (
  SELECT conv_id, turn // 4 AS page, string_agg(trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY turn % 2, -turn) AS pt FROM conversations WHERE trim(text) <> '' GROUP BY ALL) GROUP BY 1""")
def reading_order(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("page"), F.lit(600.0).alias("width"),
        F.when(F.col("turn") % 2 == 1, 300.0).otherwise(10.0).alias("x0"), (100.0 - F.col("turn")).alias("y0"), "text")
    return pg.reading_order(c).select("doc_id", F.md5("text").alias("text_md5"))


@query("table_text", """
SELECT doc_id, '[' || CASE WHEN doc_id % 2 = 0 THEN 'Table ' || CAST(doc_id AS VARCHAR) ELSE 'Table' END || '] Cap ' || lang || ' (section: S)' || chr(10) || 'a | b' || chr(10) || lang || ' | ' || source AS t FROM documents""")
def table_text(spark, sf):
    rows = F.array(F.array(F.lit(" a"), F.lit("b ")), F.array(F.col("lang"), F.col("source")))
    label = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Table "), F.col("doc_id").cast("string"))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", pg.table_text(label, F.concat(F.lit("Cap  "), "lang"), F.lit("S"), rows).alias("t"))


@query("rowspan_fill", """
SELECT doc_id, 'x,' || lang || ',' || lang || ';x,1,2;,' || source || ',' AS grid FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'x,' || lang || ',' || lang || ';x,1,2;' || source FROM documents WHERE doc_id % 2 = 1""")
def rowspan_fill(spark, sf):
    cell = lambda t, c, r: F.struct(t.alias("text"), F.lit(c).alias("colspan"), F.lit(r).alias("rowspan"))
    last = F.when(F.col("doc_id") % 2 == 0, F.array(cell(F.lit(""), 1, 1), cell(F.col("source"), 1, 1), cell(F.lit(""), 1, 1))).otherwise(F.array(cell(F.col("source"), 1, 1)))
    rows = F.array(F.array(cell(F.lit("x"), 1, 2), cell(F.col("lang"), 2, 1)), F.array(cell(F.lit("1"), 1, 1), cell(F.lit("2"), 1, 1)), last)
    grid = pg.expand_spans(rows)
    return table(spark, sf, "documents").select("doc_id", grid.alias("g")).select(
        "doc_id", F.array_join(F.transform("g", lambda r: F.array_join(r, ",")), ";").alias("grid"))


@query("followup_rows", """
SELECT run_id, rank, paper_id FROM (SELECT doc_id % 25 AS run_id, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) AS rank, 'p' || CAST(doc_id AS VARCHAR) AS paper_id FROM documents) WHERE rank <= 12 AND run_id % 5 <> 0""")
def followup_rows(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 25).alias("run_id"), F.col("doc_id").alias("pos"),
                                             F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("lang").alias("title"), F.col("text").alias("abstract"))
    runs = d.select("run_id").distinct().select("run_id", F.lit("success").alias("status"), F.when(F.col("run_id") % 5 == 0, "").otherwise("# ok").alias("report"))
    return cx.followup_rows(runs, d, d)[0].select("run_id", "rank", "paper_id")


@query("related_rows", """
SELECT run_id, rank, title FROM (SELECT doc_id % 5 AS run_id, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS rank, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS title FROM documents) WHERE rank <= 60 AND title <> ''""")
def related_rows(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("run_id"), F.col("doc_id").alias("pos"), F.lit("p").alias("paper_id"),
                                             F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("lang")).alias("title"), F.col("text").alias("abstract"))
    runs = d.select("run_id").distinct().select("run_id", F.lit("success").alias("status"), F.lit("# ok").alias("report"))
    return cx.followup_rows(runs, d, d)[1].select("run_id", "rank", "title")
