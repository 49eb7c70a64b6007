"""Grounding, report checks and style metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import text as tx
from sparkfolio.operators import ground as gd
from sparkfolio.plans.bindings import sq
from sparkfolio.plans.registry import query, table

CANON = "regexp_replace(regexp_replace(CAST(TRY_CAST({x} AS DECIMAL(38,12)) AS VARCHAR), '0+$', ''), '\\.$', '')"
READ = ("list_filter([replace({t}, ',', '.'), CASE WHEN regexp_full_match({t}, '\\d{{1,3}}(,\\d{{3}})+') THEN replace({t}, ',', '') END, "
        "CASE WHEN regexp_full_match({t}, '\\d{{1,3}}\\.\\d{{3}}') THEN replace({t}, '.', '') END], lambda x: x IS NOT NULL)")
NUM = "(?:^|[^\\wÀ-ÿ.])([+-]?(?:\\d{1,3}(?:,\\d{3})+|\\d+(?:[.,]\\d+)?)(?:\\s*%)?)"
SCRUB = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)\\$\\$.*?\\$\\$', ' ', 'g'), '\\$[^$\\n]*\\$', ' ', 'g'), "
         "'https?://\\S+', ' ', 'g'), '(?m)^\\s*(?:#+\\s*)?\\d+[.)]\\s+', '', 'g')")
DOC_NUM = "text || ' Q ' || CAST(doc_id % 97 AS VARCHAR) || ' and ' || CAST(doc_id * 13 % 1000 AS VARCHAR) || '.5%'"


def _numbered(spark, sf):
    d = table(spark, sf, "documents")
    t = F.concat("text", F.lit(" Q "), (F.col("doc_id") % 97).cast("string"), F.lit(" and "),
                 (F.col("doc_id") * 13 % 1000).cast("string"), F.lit(".5%"))
    return d.select("doc_id", F.concat_ws("/", "lang", "source").alias("g"), t.alias("text"))


def _ground_sql(prefix, rep, src):
    return f"""
{prefix}sv AS (SELECT DISTINCT g, {CANON.format(x='v')} AS v FROM (SELECT g, unnest({READ.format(t='tok')}) AS v FROM (
  SELECT g, regexp_replace(trim(regexp_replace(m, '%$', '')), '^[+-]+', '') AS tok FROM (SELECT g, unnest(regexp_extract_all(text, '{NUM}', 1)) AS m FROM nd WHERE {src})))),
{prefix}cl AS (SELECT doc_id, g, i, trim(regexp_replace(m, '%$', '')) AS t0, m LIKE '%\\%' ESCAPE '\\' AS pct FROM (
  SELECT doc_id, g, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT doc_id, g, regexp_extract_all({SCRUB.format(x='text')}, '{NUM}', 1) AS ms FROM nd WHERE {rep}))),
{prefix}c2 AS (SELECT *, regexp_replace(t0, '^[+-]+', '') AS tok FROM {prefix}cl WHERE NOT regexp_full_match(t0, '\\d') OR pct),
{prefix}vv AS (SELECT doc_id, g, i, {CANON.format(x='v')} AS v FROM (SELECT doc_id, g, i, unnest({READ.format(t='tok')}) AS v FROM {prefix}c2)
  UNION ALL SELECT doc_id, g, i, {CANON.format(x='CAST(TRY_CAST(v AS DECIMAL(38,12)) / 100 AS DECIMAL(38,12))')} FROM (SELECT doc_id, g, i, unnest({READ.format(t='tok')}) AS v FROM {prefix}c2 WHERE pct)),
{prefix}hit AS (SELECT DISTINCT doc_id, i FROM {prefix}vv JOIN {prefix}sv USING (g, v)),
{prefix}gr AS (SELECT nd.doc_id, count(c2.i) AS n_claims, count(h.i) AS n_grounded, CASE WHEN count(c2.i) = 0 THEN CAST(1 AS DOUBLE) ELSE count(h.i) / count(c2.i) END AS ratio
  FROM nd LEFT JOIN {prefix}c2 c2 ON c2.doc_id = nd.doc_id LEFT JOIN {prefix}hit h ON h.doc_id = c2.doc_id AND h.i = c2.i WHERE {rep.replace('doc_id', 'nd.doc_id')} GROUP BY nd.doc_id)"""


ND = f"nd AS (SELECT doc_id, lang || '/' || source AS g, {DOC_NUM} AS text FROM documents)"


@query("grounding_ratio", "WITH " + ND + "," + _ground_sql("", "doc_id % 2 = 0", "doc_id % 2 = 1") + "SELECT doc_id, n_claims, n_grounded, round(ratio, 4) AS ratio FROM gr")
def grounding_ratio(spark, sf):
    d = _numbered(spark, sf)
    out = gd.grounding_ratio(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1").select("g", "text"), "doc_id", "g")
    return out.withColumn("ratio", F.round("ratio", 4))


@query("band_grounding", "WITH " + ND + "," + _ground_sql("a", "doc_id % 4 = 0", "doc_id % 2 = 1") + "," + _ground_sql("b", "doc_id % 4 = 2", "doc_id % 2 = 1") + """
SELECT b.doc_id - 2 AS key, round(b.ratio, 4) AS cand_ratio, round(a.ratio, 4) AS base_ratio, round(b.ratio, 9) >= round(a.ratio - 0.05, 9) AS ok FROM bgr b JOIN agr a ON a.doc_id = b.doc_id - 2""")
def band_grounding(spark, sf):
    d = _numbered(spark, sf)
    src = d.filter("doc_id % 2 = 1").select("g", "text")
    ratio = lambda rest, shift: gd.grounding_ratio(d.filter(f"doc_id % 4 = {rest}"), src, "doc_id", "g").select(
        (F.col("doc_id") - shift).alias("key"), "ratio")
    out = gd.band_grounding(ratio(0, 0), ratio(2, 2), "key")
    return out.withColumn("cand_ratio", F.round("cand_ratio", 4)).withColumn("base_ratio", F.round("base_ratio", 4))


@query("claims_subset", """
SELECT doc_id, (doc_id % 97 = doc_id % 89) OR doc_id % 3 = 0 AS supported FROM documents""")
def claims_subset(spark, sf):
    n = lambda k: (F.col("doc_id") % k).cast("string")
    claim = F.when(F.col("doc_id") % 3 == 0, "no number").otherwise(F.concat(F.lit("we get "), n(97), F.lit(".0 %")))
    source = F.concat(F.lit("table: "), n(89), F.lit(" | "), F.lit("x12"))
    return table(spark, sf, "documents").select("doc_id", gd.claims_subset(claim, source).alias("supported"))


_MT = ("list_transform(regexp_extract_all(regexp_replace(replace(lower({x}), 'ß', 'ss'), '(\\d)\\s+([a-z])', '\\1\\2', 'g'), '([a-z0-9]+)', 1), "
       "lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' AND NOT regexp_matches(t, '\\d') THEN t[:-2] ELSE t END)")
_STOPS = ", ".join(f"'{w}'" for w in gd.HARDWARE_STOPWORDS)


@query("ground_text", f"""
WITH x AS (SELECT doc_id, list_filter({_MT.format(x="q")}, lambda t: t NOT IN ({_STOPS})) AS tk, list_distinct({_MT.format(x="text")}) AS src FROM (
  SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE coalesce(n.text, '') END || CASE WHEN d.doc_id % 3 = 0 THEN ' plus some unseen zzword yyword xxword vvword' WHEN d.doc_id % 7 = 0 THEN ' 8 GPUs' ELSE '' END AS q FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1)),
y AS (SELECT doc_id, tk, src, list_filter(tk, lambda t: regexp_matches(t, '\\d')) AS dg, list_filter(tk, lambda t: NOT regexp_matches(t, '\\d') AND length(t) >= 3) AS wd FROM x)
SELECT doc_id, len(tk) > 0 AND len(list_filter(dg, lambda t: NOT list_contains(src, t))) = 0 AND (len(wd) = 0 OR len(list_filter(wd, lambda t: list_contains(src, t))) >= len(wd) / 2) AS supported FROM y""")
def ground_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("claim"))
    claim = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.coalesce("claim", F.lit("")))
    q = F.concat(claim, F.when(F.col("doc_id") % 3 == 0, " plus some unseen zzword yyword xxword vvword").when(
        F.col("doc_id") % 7 == 0, " 8 GPUs").otherwise(""))
    return d.join(following, "doc_id", "left").select("doc_id", gd.text_in_source(q, F.col("text")).alias("supported"))


@query("ground_rows", """
WITH li AS (SELECT l_orderkey AS paper_id, l_linenumber * 10000000000 + l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS pos, l_returnflag AS benchmark, l_linestatus AS metric, CAST(l_quantity AS BIGINT) AS q, CAST(l_tax * 100 AS BIGINT) AS b, l_linenumber FROM lineitem),
held AS (SELECT DISTINCT paper_id, q AS v FROM li WHERE l_linenumber % 2 = 0 UNION SELECT DISTINCT paper_id, b FROM li WHERE l_linenumber < 4),
good AS (SELECT * FROM li WHERE (paper_id, q) IN (SELECT (paper_id, v) FROM held) AND (paper_id, b) IN (SELECT (paper_id, v) FROM held)),
shown AS (SELECT DISTINCT paper_id, q AS v FROM li WHERE l_linenumber <= 3 UNION SELECT DISTINCT paper_id, b FROM li WHERE l_linenumber <= 3),
kept AS (SELECT paper_id, benchmark, metric, q, b, min(pos) AS pos, (paper_id, q) IN (SELECT (paper_id, v) FROM shown) AND (paper_id, b) IN (SELECT (paper_id, v) FROM shown) AS labelled FROM good GROUP BY ALL)
SELECT li.paper_id, count(*) AS proposed, coalesce(any_value(k.n), 0) AS kept, count(*) - coalesce(any_value(k.n), 0) AS dropped, coalesce(any_value(k.l), 0) AS labelled FROM li LEFT JOIN (SELECT paper_id, count(*) AS n, count_if(labelled) AS l FROM kept GROUP BY 1) k ON k.paper_id = li.paper_id GROUP BY li.paper_id""")
def ground_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"),
        (F.col("l_linenumber") * F.lit(10000000000) + F.col("l_partkey") * 1000 + F.col("l_quantity").cast("long")).alias("pos"),
        F.col("l_returnflag").alias("benchmark"), F.col("l_linestatus").alias("metric"), F.col("l_linenumber").alias("n"),
        F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" ms")).alias("method_value"),
        F.lit("base").alias("baseline_name"), F.round(F.col("l_tax") * 100).cast("long").cast("string").alias("baseline_value"),
        F.lit("Table 1").alias("table_label"), F.lit("").alias("source_quote"))
    held = li.select("paper_id", F.explode(F.array(F.when(F.col("n") % 2 == 0, F.col("method_value")), F.when(F.col("n") < 4, F.col(
        "baseline_value")))).alias("v")).filter("v IS NOT NULL").distinct()
    # An order has a handful of lines, so its source text is short.
    corpus = held.groupBy("paper_id").agg(F.concat_ws(" ; ", F.array_sort(F.collect_list("v"))).alias("text"))
    tables = li.filter("n <= 3").groupBy("paper_id").agg(F.concat_ws(" | ", F.array_sort(F.collect_list(F.concat(
        "method_value", F.lit(" | "), "baseline_value")))).alias("text")).withColumn("label", F.lit("table  1"))
    kept, counts = gd.ground_rows(li.drop("n"), corpus, tables)
    labelled = kept.groupBy("paper_id").agg(F.count_if(F.col("table_label") != "").alias("labelled"))
    return counts.join(labelled, "paper_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))


# Reports around whole texts: five sections or a repeated one, with and without context, bullets and many equations.
_BULLETS = "\n- **Insight**: a\n* Metrics : b\n• Setup: c"


def _reports(spark, sf):
    t = tx.squeeze(F.regexp_replace("text", "[#`$|*]", ""))
    lit, k = F.lit, F.col("doc_id")
    rep = F.concat(lit("# T\n## 1. Intro\n"), t, lit("\n## 2. Papers\n### P "), k.cast("string"), lit("\nbody $$x$$ $$y$$"),
                   F.when(k % 5 == 0, " $$z$$ $$w$$").otherwise(""), F.when(k % 4 < 2, _BULLETS).otherwise(""), lit("\n### Q\nmore"),
                   F.when(k % 4 == 0, _BULLETS).otherwise(""), lit("\n"),
                   F.when(k % 3 == 0, "").otherwise(F.concat(lit("## 3) Context\n"), t, lit("\n"))),
                   F.when(k % 2 == 0, "## 4. Figures\nf\n## 5. Refs\nr").otherwise("## 1. Again\nlate"))
    return table(spark, sf, "documents").select(k.alias("report_id"), rep.alias("text"), lit(2).alias("n_papers"))


_DT = "d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[#`$|*]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)"
_BULLETS_SQL = " || ".join("chr(10) || '" + line + "'" for line in _BULLETS.split("\n")[1:])


@query("split_report", "WITH " + _DT + f"""
SELECT doc_id AS report_id, CAST(1 AS BIGINT) AS number, CAST(0 AS BIGINT) AS unit, 'Intro' AS title, md5(t) AS body_md5 FROM d
UNION ALL SELECT doc_id, 2, 0, 'Papers', md5('') FROM d
UNION ALL SELECT doc_id, 2, 1, 'P ' || CAST(doc_id AS VARCHAR), md5('body $$x$$ $$y$$' || CASE WHEN doc_id % 5 = 0 THEN ' $$z$$ $$w$$' ELSE '' END || CASE WHEN doc_id % 4 < 2 THEN {_BULLETS_SQL} ELSE '' END) FROM d
UNION ALL SELECT doc_id, 2, 2, 'Q', md5('more' || CASE WHEN doc_id % 4 = 0 THEN {_BULLETS_SQL} ELSE '' END) FROM d
UNION ALL SELECT doc_id, 3, 0, 'Context', md5(t) FROM d WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 4, 0, 'Figures', md5('f') FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 5, 0, 'Refs', md5('r') FROM d WHERE doc_id % 2 = 0""")
def split_report(spark, sf):
    u = gd.report_units(_reports(spark, sf))
    return u.select("report_id", "number", "unit", "title", F.md5("body").alias("body_md5"))


@query("band_equations", "SELECT doc_id AS report_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 2 END AS BIGINT) AS most, doc_id % 5 <> 0 AS ok FROM documents")
def band_equations(spark, sf):
    return gd.band_equations(_reports(spark, sf))


@query("check_structure", """
SELECT report_id, CASE WHEN ns = '1,2,3,4,5' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN ns = '1,2,3,4,5' THEN '' ELSE 'sections ' || ns END AS detail FROM (
  SELECT doc_id AS report_id, '1,2' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',3' END || CASE WHEN doc_id % 2 = 0 THEN ',4,5' ELSE ',1' END AS ns FROM documents)""")
def check_structure(spark, sf):
    return gd.check_structure(_reports(spark, sf)).select("report_id", "status", "detail")


@query("check_context", "WITH " + _DT + """
SELECT doc_id AS report_id, CASE WHEN doc_id % 3 = 0 OR t = '' THEN 'FAIL' ELSE 'PASS' END AS status FROM d""")
def check_context(spark, sf):
    return gd.check_context(_reports(spark, sf)).select("report_id", "status")


@query("check_bullets", """
SELECT report_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'missing=' || CAST(n AS VARCHAR) AS detail FROM (
  SELECT doc_id AS report_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 6 END AS n FROM documents)""")
def check_bullets(spark, sf):
    return gd.check_bullets(_reports(spark, sf)).select("report_id", "status", "detail")


@query("check_links", """
SELECT page_id AS report_id, '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS arxiv_id FROM pages WHERE page_id % 3 <> 0""")
def check_links(spark, sf):
    aid = F.concat(F.lit("2401."), F.lpad(F.col("page_id").cast("string"), 5, "0"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("report_id"), aid.alias("arxiv_id"), F.concat(
        "html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://arxiv.org/abs/"), aid)).otherwise("")).alias("text"))
    return gd.missing_links(p.select("report_id", "text"), p.select("report_id", "arxiv_id"))


@query("check_internal", "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM documents")
def check_internal(spark, sf):
    k = F.col("doc_id") % 3
    extra = F.when(k == 0, "\n- Language mode: en\n* PMRL quality ok\n").when(k == 1, "\nsaved report_ab-1.md").otherwise("\n```\npipeline: x\n```\n")
    return gd.internal_lines(table(spark, sf, "documents").select("doc_id", F.concat("text", extra).alias("text")), "doc_id")


# Run pairs: user turns are the base, the assistant turn after them the candidate.
_PAIR_SQL = """pr AS (SELECT b.conv_id AS run_id, b.turn // 2 AS item, b.text AS base_text, c.text AS cand_text FROM conversations b
  LEFT JOIN conversations c ON c.conv_id = b.conv_id AND c.turn // 2 = b.turn // 2 AND c.role = 'assistant' WHERE b.role = 'user')"""
_WC = "CAST(CASE WHEN trim(coalesce({x}, '')) = '' THEN 0 ELSE len(string_split({s}, ' ')) END AS BIGINT)"


def wc(x):
    return _WC.format(x=x, s=sq(x))


def _pairs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("item", F.floor(F.col("turn") / 2))
    base = c.filter("role = 'user'").select(F.col("conv_id").alias("run_id"), "item", F.col("text").alias("base_text"))
    cand = c.filter("role = 'assistant'").select(F.col("conv_id").alias("run_id"), "item", F.col("text").alias("cand_text"))
    return base.join(cand, ["run_id", "item"], "left")


@query("baseline_pair", "WITH " + _PAIR_SQL + f"SELECT run_id, item, {wc('base_text')} AS base_words, {wc('cand_text')} AS cand_words FROM pr")
def baseline_pair(spark, sf):
    return gd.band_words(_pairs(spark, sf)).select("run_id", "item", "base_words", "cand_words")


@query("band_words", "WITH " + _PAIR_SQL + f", w AS (SELECT run_id, item, {wc('base_text')} AS b, {wc('cand_text')} AS c FROM pr) SELECT run_id, item, b = 0 OR c / b BETWEEN 0.6 AND 1.6 AS ok FROM w")
def band_words(spark, sf):
    return gd.band_words(_pairs(spark, sf)).select("run_id", "item", "ok")


@query("band_length", "WITH " + _PAIR_SQL + """ SELECT run_id, item, round(CASE WHEN length(base_text) > 0 THEN length(coalesce(cand_text, '')) / length(base_text) ELSE 0 END, 4) AS ratio,
  CASE WHEN length(base_text) > 0 THEN length(coalesce(cand_text, '')) / length(base_text) ELSE 0 END BETWEEN 0.6 AND 1.6 AS ok FROM pr""")
def band_length(spark, sf):
    return gd.band_length(_pairs(spark, sf)).select("run_id", "item", F.round("ratio", 4).alias("ratio"), "ok")


_FIELD = "CASE turn % 4 WHEN 0 THEN 'problem' WHEN 1 THEN 'method' WHEN 2 THEN 'result' ELSE 'limitation' END"


@query("check_nonempty", f"""
SELECT run_id, paper_id, field FROM (SELECT DISTINCT conv_id AS run_id, 'p' || CAST(turn // 4 AS VARCHAR) AS paper_id FROM conversations), (VALUES ('problem'), ('method'), ('result'), ('limitation')) v(field)
WHERE (run_id, paper_id, field) NOT IN (SELECT (conv_id, 'p' || CAST(turn // 4 AS VARCHAR), {_FIELD}) FROM conversations WHERE turn % 5 <> 3 AND trim(text) <> '')""")
def check_nonempty(spark, sf):
    k = F.col("turn") % 4
    field = F.when(k == 0, "problem").when(k == 1, "method").when(k == 2, "result").otherwise("limitation")
    notes = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.concat(F.lit("p"), F.floor(F.col("turn") / 4).cast("string")).alias("paper_id"), field.alias("field"),
        F.when(F.col("turn") % 5 == 3, "  ").otherwise(F.col("text")).alias("text"))
    return gd.empty_notes(notes.select("run_id", "paper_id").distinct(), notes)


@query("check_status", """
SELECT event_id AS run_id, 'status_not_error' AS name, 'HARD' AS grp, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS status, 'status=' || event_type AS detail FROM events""")
def check_status(spark, sf):
    return gd.check_status(table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status")))


@query("verdict", """
SELECT user_id AS run_id, max(event_type = 'error' AND event_id % 7 <> 0 OR event_type = 'signup' AND event_id % 50 = 3) AS failed FROM events GROUP BY 1""")
def verdict(spark, sf):
    ev = table(spark, sf, "events")
    grp = F.when(F.col("event_type") == "signup", "QUALITY").when(F.col("event_id") % 7 == 0, "LATENCY").otherwise("HARD")
    status = F.when(F.col("event_type") == "error", "FAIL").when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 3), "WARN").otherwise("PASS")
    return gd.verdict(ev.select(F.col("user_id").alias("run_id"), grp.alias("grp"), status.alias("status")), "run_id", strict=True)




@query("style_metrics", f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z .\\n]', '', 'g'), '\\n+', ' ', 'g')) AS t FROM documents),
u AS (SELECT doc_id, 'p' AS kind, 'Head. ' || t AS u FROM d UNION ALL SELECT doc_id, 'b', 'First item. Second part' FROM d UNION ALL SELECT doc_id, 'b', 'two more' FROM d),
s AS (SELECT doc_id, kind, list_filter(list_transform(string_split(regexp_replace(u, '([.!?;:])\\s+([A-Z0-9"(\\[*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM u),
l AS (SELECT doc_id, kind, list_transform(ss, lambda x: len(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' '))) AS ls FROM s)
SELECT doc_id AS report_id, CAST(sum(len(ls)) AS BIGINT) AS sentences, round(sum(list_sum(ls)) / sum(len(ls)), 1) AS mean_words,
  round(100 * sum(len(list_filter(ls, lambda n: n > 25))) / sum(len(ls)), 1) AS pct_long, CAST(2 AS BIGINT) AS bullets, CAST(1 AS BIGINT) AS paragraphs, CAST(2 AS DOUBLE) AS bullet_ratio,
  CAST(0 AS BIGINT) AS passive, CAST(sum(CASE WHEN kind = 'p' AND len(ls) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS long_paragraphs FROM l GROUP BY doc_id""")
def style_metrics(spark, sf):
    t = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z .\n]", ""), r"\n+", " "))
    rep = F.concat(F.lit("# Title\n\nHead.\n"), t, F.lit("\n\n- First item.\n  Second part\n* two more\n| a | b |\n```\nx. Y\n```\n## 5. Refs\nNot read."))
    return gd.style_metrics(table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), rep.alias("text")))


@query("paragraph_groups", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT *, regexp_matches(line, '^\\s*$|^\\s*[#|]|^\\s*<!--|^\\s*\\*[^*]+\\*\\s*$|^\\s*([-*•]|\\d+[.)])\\s+') OR contains(line, 'http') AS brk FROM l),
g AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS gid FROM c)
SELECT doc_id, CAST(gid AS BIGINT) AS gid, count(*) AS n FROM g WHERE NOT brk GROUP BY ALL""")
def paragraph_groups(spark, sf):
    from pyspark.sql import Window

    ls = gd.lines(table(spark, sf, "documents"), "doc_id", F.col("text"))
    brk = F.col("line").rlike(r"^\s*$|^\s*[#|]|^\s*<!--|^\s*\*[^*]+\*\s*$|" + gd.BULLET) | F.col("line").contains("http")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("brk", brk).withColumn("gid", F.sum(F.when(F.col("brk"), 1).otherwise(0)).over(w))
    return ls.filter(~F.col("brk")).groupBy("doc_id", "gid").agg(F.count(F.lit(1)).alias("n"))
