"""Context selection, packing, artifact joins and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F


from sparkfolio.functions.text import squeeze
from sparkfolio.operators import context as cx, joins as jn
from sparkfolio.plans.bindings import PAPERS_SQL, papers, sq, with_ctes
from sparkfolio.plans.q_ground import wc
from sparkfolio.plans.registry import query, table
from sparkfolio.scale import position_block

_STOP = ", ".join(f"'{w}'" for w in cx.STOPWORDS)
TOK = "list_distinct(list_filter(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '([\\p{{L}}\\p{{N}}_]{{3,}})', 1), lambda w: w NOT IN (" + _STOP.replace("{", "{{") + ")))"
CONV_SQL = f"""qs AS (SELECT conv_id AS question_id, conv_id AS thread_id, text || CASE WHEN conv_id % 4 = 0 THEN ' see paper 2' WHEN conv_id % 4 = 1 THEN ' 2401.00' || lpad(CAST(conv_id AS VARCHAR), 3, '0') ELSE '' END AS question
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1),
its AS (SELECT conv_id AS thread_id, conv_id * 100 + turn AS item_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN turn % 3 = 1 THEN '2401.00' || lpad(CAST(conv_id AS VARCHAR), 3, '0') ELSE '' END AS arxiv_id,
  array_to_string(list_slice(string_split({sq('text')}, ' '), 1, 6), ' ') AS title FROM conversations WHERE role <> 'user')"""


def _questions(spark, sf):
    from sparkfolio.sources.papers import first_row_per_key

    c = table(spark, sf, "conversations")
    last = first_row_per_key(c.filter("role = 'user'"), "conv_id", F.col("turn").desc())
    pad = F.lpad(F.col("conv_id").cast("string"), 3, "0")
    extra = F.when(F.col("conv_id") % 4 == 0, " see paper 2").when(F.col("conv_id") % 4 == 1, F.concat(F.lit(" 2401.00"), pad)).otherwise("")
    return last.select(F.col("conv_id").alias("question_id"), F.col("conv_id").alias("thread_id"), F.concat("text", extra).alias("question"))


def _items(spark, sf):
    from sparkfolio.scale import numbered

    c = table(spark, sf, "conversations").filter("role <> 'user'")
    pad = F.lpad(F.col("conv_id").cast("string"), 3, "0")
    rows = c.select(F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "turn",
                    F.when(F.col("turn") % 3 == 1, F.concat(F.lit("2401.00"), pad)).otherwise("").alias("arxiv_id"),
                    F.array_join(F.slice(F.split(squeeze(F.col("text")), " "), 1, 6), " ").alias("title"))
    return numbered(rows, ["thread_id"], position_block(F.col("turn")), ["turn"], "pos").withColumn("pos", F.col("pos") - 1)


_TOKQ = TOK.format(x="question")
_SCORED = f"""sc AS (SELECT q.question_id, i.item_id, i.pos, len(list_intersect({_TOKQ}, {TOK.format(x='title')})) + CASE WHEN arxiv_id <> '' AND contains(question, arxiv_id) THEN 5 ELSE 0 END
   + CASE WHEN pos = 1 AND question LIKE '% see paper 2' THEN 5 ELSE 0 END + CASE WHEN n = 1 THEN 1 ELSE 0 END AS score
  FROM qs q JOIN its i USING (thread_id) JOIN (SELECT thread_id, count(*) AS n FROM its GROUP BY 1) USING (thread_id)),
mx AS (SELECT question_id, max(score) AS m FROM sc GROUP BY 1)"""


@query("relevance_select", "WITH " + CONV_SQL + "," + _SCORED + """
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) AS rank, item_id, CAST(score AS BIGINT) AS score FROM sc JOIN mx USING (question_id) WHERE m = 0 OR score > 0 QUALIFY rank <= 2""")
def relevance_select(spark, sf):
    return cx.select_context(_questions(spark, sf), _items(spark, sf))


@query("related_match", "WITH " + CONV_SQL + f"""
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS rank, item_id FROM qs JOIN its USING (thread_id)
WHERE (arxiv_id <> '' AND contains(question, arxiv_id)) OR (title <> '' AND contains(replace(lower(question), 'ß', 'ss'), replace(lower(title), 'ß', 'ss'))) OR len(list_intersect({_TOKQ}, {TOK.format(x='title')})) >= 2 QUALIFY rank <= 3""")
def related_match(spark, sf):
    return cx.match_related(_questions(spark, sf), _items(spark, sf))


@query("table_mention", """
SELECT conv_id AS question_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, conv_id * 100 + turn AS table_id FROM conversations WHERE turn IN (2, 5) AND conv_id % 2 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user')""")
def table_mention(spark, sf):
    q = _questions(spark, sf).withColumn("question", F.when(F.col("question_id") % 2 == 0, "what do Table 2 and bảng 5 say").otherwise("none"))
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("table_id"),
                                                 F.col("turn").alias("pos"), F.concat(F.lit("Table "), F.col("turn").cast("string")).alias("label"))
    return cx.match_tables(q, t)


@query("running_budget", """
SELECT conv_id, turn AS pos, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 2000""")
def running_budget(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    return cx.within_budget(c, "conv_id", position_block(F.col("pos")), 2000).select("conv_id", "pos", "used")


@query("context_pack", """
WITH c AS (SELECT conv_id, turn, role || CAST(turn AS VARCHAR) AS source, trim(text, ' ' || chr(10)) AS t, 300 + turn AS cap FROM conversations)
SELECT conv_id AS question_id, md5(string_agg('[' || source || ']' || chr(10) || CASE WHEN length(t) <= cap THEN t ELSE rtrim(substring(t, 1, cap - 1)) || '…' END, chr(10) || chr(10) ORDER BY turn % 2, turn)) AS context_md5,
  string_agg('- ' || source, chr(10) ORDER BY turn % 2, turn) AS sources FROM c GROUP BY 1""")
def context_pack(spark, sf):
    parts = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn") % 2).alias("section_no"), F.col("turn").alias("pos"),
                     F.concat("role", F.col("turn").cast("string")).alias("source"), "text", (F.col("turn") + 300).alias("cap"))
    return cx.pack_context(parts).select("question_id", F.md5("context").alias("context_md5"), "sources")


@query("pack_text", """
SELECT doc_id, length(s) AS chars, md5(s) AS text_md5 FROM (SELECT doc_id, substring('=== ABSTRACT ===' || chr(10) || text || chr(10) || chr(10) || '=== METHODOLOGY / ARCHITECTURE ===' || chr(10) || text || chr(10) || chr(10) ||
  CASE WHEN doc_id % 2 = 0 THEN '=== EXPERIMENTAL SETUP / TRAINING DETAILS / HARDWARE ===' || chr(10) || lang || chr(10) || chr(10) ELSE '' END || '=== EXPERIMENTS / BENCHMARKS / RESULTS ===' || chr(10) || text || chr(10) || chr(10) || '=== LIMITATIONS / FUTURE WORK ===' || chr(10) ||
  CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '=== TABLES (header row first) ===' || chr(10) || source ELSE '' END, 1, 40000) AS s FROM documents)""")
def pack_text(spark, sf):
    d = table(spark, sf, "documents")
    s = cx.pack_paper({"abstract": F.col("text"), "methodology": F.col("text"), "setup": F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("  "),
                       "experiments": F.col("text"), "limitations": F.lit(None).cast("string")}, F.when(F.col("doc_id") % 3 == 0, F.col("source")))
    return d.select("doc_id", s.alias("s")).select("doc_id", F.length("s").cast("long").alias("chars"), F.md5("s").alias("text_md5"))


@query("read_sources", """
SELECT doc_id, md5(text || chr(10) || lang || chr(10) || 'cap ' || source || chr(10) || 'a | ' || lang || chr(10) || CAST(doc_id AS VARCHAR) || ' | ') AS text_md5 FROM documents""")
def read_sources(spark, sf):
    rows = F.array(F.array(F.array(F.lit("a"), F.col("lang")), F.array(F.col("doc_id").cast("string"), F.lit(""))))
    s = cx.source_text(F.col("text"), [F.col("lang")], F.array(F.concat(F.lit("cap "), "source")), rows)
    return table(spark, sf, "documents").select("doc_id", F.md5(s).alias("text_md5"))


@query("strip_bodies", "SELECT doc_id, CAST(length(text) AS BIGINT) AS extracted_text_chars, CAST(length(lang) AS BIGINT) AS abstract_chars, CAST(0 AS BIGINT) AS setup_chars FROM documents")
def strip_bodies(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("extracted_text"), F.map_from_arrays(
        F.array(F.lit("abstract"), F.lit("setup")), F.array(F.col("lang"), F.lit(None).cast("string"))).alias("sections"))
    out = cx.project_run_state(d)
    return out.select("doc_id", "extracted_text_chars", out.sections_chars["abstract"].cast("long").alias("abstract_chars"),
                      out.sections_chars["setup"].cast("long").alias("setup_chars"))


@query("cache_fresh", """
SELECT event_id FROM events WHERE 2000000 - event_id * 60 <= 86400 * 20 AND event_id % 3 <> 0 AND (event_id % 2 = 0 OR event_id % 4 = 1)""")
def cache_fresh(spark, sf):
    n = F.col("event_id")
    c = table(spark, sf, "events").select(
        "event_id", F.when(n % 2 == 0, "2401.00001").otherwise("2401.00001v1").alias("requested_id"),
        F.concat(F.lit("2401.00001v"), (n % 4).cast("string")).alias("cached_id"), (n * 60).alias("saved_at"),
        F.when(n % 3 == 0, "old").otherwise("h2").alias("version"))
    return jn.usable_cache(c, 2000000, 86400 * 20, "h2").select("event_id")


@query("write_sources", with_ctes(PAPERS_SQL) + """
SELECT paper_id, CASE WHEN quality = 1 THEN 'cache' ELSE 'paper' END AS origin, md5(CASE WHEN quality = 1 THEN 'cached ' || title ELSE abstract END) AS text_md5 FROM papers LEFT JOIN labels USING (doc_id) WHERE doc_id % 9 <> 0""")
def write_sources(spark, sf):
    p = papers(spark, sf)
    cache = p.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").select("paper_id", F.concat(F.lit("cached "), "title").alias("text"))
    rows = p.select(F.when(F.col("doc_id") % 9 != 0, F.col("paper_id")).otherwise("").alias("paper_id"), F.col("abstract").alias("text"))
    return jn.write_sources(rows, cache).select("paper_id", "origin", F.md5("text").alias("text_md5"))


@query("join_branches", with_ctes(PAPERS_SQL) + """
SELECT paper_id, CASE WHEN quality IS NOT NULL THEN 'n' || CAST(doc_id AS VARCHAR) ELSE 'own' END AS notes, CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'complete' ELSE 'fallback' END ELSE 'unknown' END AS quality,
  CASE WHEN toxic = 1 THEN '@a' ELSE '' END AS bibtex, CASE WHEN toxic = 1 THEN 'enrich' WHEN quality IS NOT NULL THEN 'notes' ELSE 'paper' END AS who FROM papers LEFT JOIN labels USING (doc_id)""")
def join_branches(spark, sf):
    p = papers(spark, sf)
    lab = p.join(table(spark, sf, "labels"), "doc_id")
    meta = lambda v: F.map_from_arrays(F.array(F.lit("who"), F.lit(f"k_{v}")), F.array(F.lit(v), F.lit("1")))
    own = p.select("paper_id", F.lit("own").alias("notes"), F.lit("unknown").alias("quality"), F.lit("").alias("bibtex"), F.lit(0).alias("repos"), meta("paper").alias("meta"))
    notes = lab.select("paper_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("notes"),
                       F.when(F.col("quality") == 1, "complete").otherwise("fallback").alias("quality"), meta("notes").alias("meta"))
    enrich = lab.filter("toxic = 1").select("paper_id", F.lit("@a").alias("bibtex"), F.lit(1).alias("repos"), meta("enrich").alias("meta"))
    out = jn.join_branches(own, notes, enrich)
    return out.select("paper_id", "notes", "quality", "bibtex", out.meta["who"].alias("who"))


@query("fill_sections", with_ctes(PAPERS_SQL) + """
, s AS (SELECT paper_id, doc_id, quality, unnest(['abstract', 'methodology', 'setup']) AS section FROM papers LEFT JOIN labels USING (doc_id))
SELECT paper_id, section, CASE WHEN section = 'abstract' THEN 'html' WHEN section = 'methodology' AND quality IS NOT NULL THEN 'pdf' ELSE '  ' END AS text, section = 'methodology' AND quality IS NOT NULL AS filled FROM s""")
def fill_sections(spark, sf):
    p = papers(spark, sf)
    names = F.explode(F.array(F.lit("abstract"), F.lit("methodology"), F.lit("setup"))).alias("section")
    first = p.select("paper_id", names).withColumn("text", F.when(F.col("section") == "abstract", "html").otherwise("  "))
    second = p.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("paper_id", names).withColumn("text", F.lit("pdf"))
    return jn.fill_missing(first, second)


@query("restore_papers", with_ctes(PAPERS_SQL) + "SELECT paper_id, CASE WHEN quality IS NOT NULL THEN 'src' ELSE title END AS title, CASE WHEN quality = 1 THEN 'q' ELSE date END AS date FROM papers LEFT JOIN labels USING (doc_id)")
def restore_papers(spark, sf):
    p = papers(spark, sf)
    s = p.join(table(spark, sf, "labels"), "doc_id").select("paper_id", F.lit("src").alias("title"), F.when(F.col("quality") == 1, "q").alias("date"))
    return jn.attach_sources(p, s, ["title", "date"])


@query("repo_tiers", """
WITH pq AS (SELECT p_partkey AS paper_id, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part),
rp AS (SELECT s_suppkey, 'https://github.com/o/' || CAST(s_suppkey AS VARCHAR) AS url, s_nationkey * 100 + s_suppkey % 100 AS stars, s_suppkey % 7 AS k, s_suppkey AS sk FROM supplier),
d AS (SELECT *, CASE k WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget' WHEN 2 THEN 'small widget kit' WHEN 3 THEN 'green bolt' WHEN 4 THEN 'code 2401.' || lpad(CAST(sk AS VARCHAR), 5, '0') WHEN 5 THEN 'tiny' ELSE 'li small ring' END AS t FROM rp),
w AS (SELECT *, string_split(t, ' ') AS ws FROM d),
h AS (SELECT paper_id, url, stars, CASE WHEN list_contains(ws, '2401.' || lpad(CAST(paper_id AS VARCHAR), 5, '0')) THEN 1 WHEN (length(a) <= 2 OR list_contains(ws, a)) AND (length(b) <= 2 OR list_contains(ws, b)) THEN 2
  ELSE 9 END AS tier FROM pq, w)
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY tier, stars DESC, url) AS rank, url, CAST(tier AS BIGINT) AS tier FROM h WHERE tier < 9 QUALIFY rank <= 5""")
def repo_tiers(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.concat(F.lit("2401."), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("arxiv_id"),
                                        F.col("p_name").alias("title"), F.lit("Bo Li").alias("author"))
    k = F.col("s_suppkey") % 7
    text = (F.when(k == 0, "Small ring").when(k == 1, "red widget").when(k == 2, "small widget kit").when(k == 3, "green bolt")
            .when(k == 4, F.concat(F.lit("code 2401."), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))).when(k == 5, "tiny").otherwise("li small ring"))
    r = table(spark, sf, "supplier").select(F.concat(F.lit("https://github.com/o/"), F.col("s_suppkey").cast("string")).alias("url"), F.lit("").alias("name"),
                                            text.alias("description"), (F.col("s_nationkey") * 100 + F.col("s_suppkey") % 100).alias("stars"))
    return jn.tiered_candidates(p, r).withColumn("tier", F.col("tier").cast("long"))


@query("case_matrix", """
WITH p AS (SELECT DISTINCT 'r' || CAST(o_custkey % 50 AS VARCHAR) AS run, CAST(o_custkey AS VARCHAR) AS pid FROM orders),
c AS (SELECT run, run || '_' || pid AS case_id, unnest(['pmrl', 'section']) AS stage FROM p UNION ALL SELECT DISTINCT run, run, 'overview' FROM p),
v AS (SELECT *, unnest(['new', 'v0']) AS variant FROM c)
SELECT stage, case_id, run, variant, unnest([1, 2])::BIGINT AS rep FROM v WHERE NOT (variant = 'v0' AND stage = 'section' AND case_id LIKE '%7')""")
def case_matrix(spark, sf):
    p = table(spark, sf, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("run"),
                                          F.concat(F.lit("arxiv_"), F.col("o_custkey").cast("string")).alias("paper_id")).distinct()
    gone = p.select(F.lit("v0").alias("variant"), F.lit("section").alias("stage"), F.concat_ws("_", "run", F.regexp_replace("paper_id", "^arxiv_", "")).alias("case_id")).filter(
        F.col("case_id").endswith("7"))
    return jn.case_matrix(p, ["overview", "pmrl", "section"], ["new", "v0"], 2, gone)


_RUNS = "SELECT o_custkey AS thread_id, 'run' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'degraded' ELSE 'error' END AS status FROM orders"


def _runs(spark, sf):
    st = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "degraded").otherwise("error")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("thread_id"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run_id"),
                                             F.col("o_orderkey").alias("pos"), st.alias("status"))


@query("latest_context", f"SELECT thread_id, arg_max(run_id, pos) AS run_id FROM ({_RUNS}) WHERE status IN ('success', 'degraded') AND pos % 3 <> 0 GROUP BY 1")
def latest_context(spark, sf):
    return jn.latest_finished(_runs(spark, sf).withColumn("has_report", F.col("pos") % 3 != 0))


@query("publish_artifacts", f"""
SELECT thread_id, artifact_id, kind, arg_min(run_id, pos) AS run_id, arg_min(title, pos) AS title FROM (SELECT thread_id, run_id, pos, CASE WHEN pos % 4 = 0 THEN 'rep' || CAST(pos % 8 AS VARCHAR) || '.md' ELSE 'answer-' || substring(run_id, 1, 12) END AS artifact_id,
  CASE WHEN pos % 4 = 0 THEN 'report' ELSE 'answer' END AS kind, CASE WHEN pos % 2 = 0 THEN 'T ' || CAST(pos AS VARCHAR) ELSE 'Research answer' END AS title FROM ({_RUNS}) WHERE status <> 'error') GROUP BY thread_id, artifact_id, kind""")
def publish_artifacts(spark, sf):
    r = _runs(spark, sf).withColumn("answer", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("# T "), F.col("pos").cast("string"), F.lit("\nbody"))).otherwise("plain"))
    r = r.withColumn("report_id", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("rep"), (F.col("pos") % 8).cast("string"), F.lit(".md")))).withColumn(
        "finished", F.col("status") != "error")
    return jn.publish_artifacts(r).select("thread_id", "artifact_id", "kind", "run_id", "title")


@query("thread_view", """
SELECT conv_id AS thread_id, coalesce(nullif(substring(trim(arg_min(text, turn) FILTER (role = 'user'), ' ' || chr(10)), 1, 160), ''), 'New research') AS title, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, max(turn) AS last_pos FROM conversations GROUP BY 1""")
def thread_view(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    return jn.thread_views(c)


@query("thread_snapshot", """
WITH c AS (SELECT *, turn + 10 * (conv_id % 3) AS moment FROM conversations)
SELECT conv_id AS thread_id, turn // 4 AS piece, any_value(title) AS title, any_value(updated) AS updated_at, count(*) AS n_messages, md5(string_agg(role || text, '|' ORDER BY turn)) AS messages_md5,
  coalesce(string_agg('run-' || CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS runs,
  coalesce(string_agg('report-' || CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (role = 'assistant' AND length(text) % 2 = 0), '') AS artifacts
FROM c JOIN (SELECT conv_id, greatest(conv_id % 50, max(moment)) AS updated, CASE WHEN conv_id % 4 = 1 THEN 'Thread ' || CAST(conv_id AS VARCHAR)
  ELSE coalesce(nullif(substring(trim(arg_min(text, turn) FILTER (role = 'user'), ' ' || chr(10)), 1, 160), ''), 'New research') END AS title FROM c GROUP BY conv_id) USING (conv_id) GROUP BY ALL""")
def thread_snapshot(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), (F.col("turn") + 10 * (F.col("conv_id") % 3)).alias("at"), "role", F.col("text").alias("content"))
    id_ = F.col("thread_id")
    threads = c.select("thread_id", F.when(id_ % 4 == 1, F.concat(F.lit("Thread "), id_.cast("string"))).otherwise("New research").alias("title"), (id_ % 50).alias("updated_at")).distinct()
    answers = c.filter("role = 'assistant'")
    runs = answers.select("thread_id", "pos", "at", F.concat(F.lit("run-"), F.col("pos").cast("string")).alias("run_id"))
    artifacts = answers.filter(F.length("content") % 2 == 0).select("thread_id", "pos", "at", F.concat(F.lit("report-"), F.col("pos").cast("string")).alias("artifact_id"))
    out = jn.thread_snapshots(threads, c, runs, artifacts, piece_rows=4)
    return out.select("thread_id", "piece", "title", "updated_at", F.size("messages").cast("long").alias("n_messages"),
                      F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "|")).alias("messages_md5"),
                      F.array_join(F.transform("runs", lambda r: r["run_id"]), ",").alias("runs"), F.array_join(F.transform("artifacts", lambda a: a["artifact_id"]), ",").alias("artifacts"))


@query("run_result", with_ctes(PAPERS_SQL) + """
SELECT CAST(doc_id % 40 AS BIGINT) AS run_id, count(*) AS n_papers, count(quality) AS n_bibtex, doc_id % 40 % 4 <> 0 AND doc_id % 40 % 5 <> 0 AS report_ready, CAST(CASE WHEN doc_id % 40 % 3 = 0 THEN 7 ELSE 100 END AS BIGINT) AS seconds FROM papers LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def run_result(spark, sf):
    d = papers(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(
        (F.col("doc_id") % 40).alias("run_id"), F.col("doc_id").alias("pos"), F.when(F.col("quality").isNotNull(), "@x").alias("bibtex"))
    r = F.col("run_id")
    runs = d.select("run_id").distinct().select(
        "run_id", F.when(r % 5 == 0, "Failed").otherwise("success").alias("status"), F.when(r % 4 == 0, "## Error generating final report").otherwise("# ok").alias("report"),
        F.when(r % 3 == 0, 7).cast("long").alias("measured_seconds"), F.lit(100).cast("long").alias("estimated_seconds"))
    return jn.run_results(runs, d)


@query("results_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, 'flag ' || l_returnflag AS setting, CASE WHEN l_linenumber % 2 = 0 THEN 'price (usd)' ELSE 'price in USD' END AS metric, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS method,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' base' END AS baseline,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CASE WHEN l_extendedprice >= l_quantity THEN '+' ELSE '' END || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS delta FROM lineitem""")
def results_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("flag  "), "l_returnflag").alias("benchmark"),
        F.when(F.col("l_linenumber") % 2 == 0, "price ").otherwise("price in USD").alias("metric"), F.lit("usd").alias("unit"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("method_value"), F.lit("base").alias("baseline_name"),
        F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("baseline_value"))
    return cx.results_rows(li)


@query("call_quality", f"""
SELECT conv_id, turn, turn % 3 <> 0 AS parse_ok, CASE WHEN turn % 3 <> 0 THEN {wc('text')} ELSE 0 END AS words_problem, CASE WHEN turn % 3 <> 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS words_method, turn % 3 = 1 AND {wc('text')} > 0 AS all_nonempty FROM conversations""")
def call_quality(spark, sf):
    fields = F.struct(F.col("text").alias("problem"), F.lit("m").alias("method"), F.lit("r").alias("result"), F.when(F.col("turn") % 3 == 1, "l").otherwise("").alias("limitation"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("not json {"), "text")).otherwise(F.to_json(fields)).alias("response"))
    return cx.call_quality(c).select("conv_id", "turn", "parse_ok", "words_problem", "words_method", "all_nonempty")
