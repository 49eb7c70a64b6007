"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import ids, numbers as nb, redact as rd, text as tx
from sparkfolio.operators.filters import split_authors
from sparkfolio.plans.bindings import PAPERS_SQL, norm_sql, papers, sq, with_ctes
from sparkfolio.plans.q_ingest import redact_sql
from sparkfolio.plans.registry import query, table

_P5 = "lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0')"


def _p5():
    return F.lpad((F.col("page_id") % 100000).cast("string"), 5, "0")


@query("clean_id", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2401.' || {_P5} WHEN 1 THEN 'hep-th/00' || {_P5} ELSE '-' END AS resolver_id,
  CASE page_id % 4 WHEN 0 THEN 'arxiv: 2401.' || {_P5} WHEN 1 THEN 'hep-th/00' || {_P5} WHEN 2 THEN '2401.' || {_P5} ELSE lower(url) END AS result_id,
  CASE page_id % 4 WHEN 0 THEN 'arxiv: 2401.' || {_P5} WHEN 1 THEN 'hep-th/00' || {_P5} WHEN 2 THEN 'arxiv_2401.' || {_P5} ELSE lower(url) END AS reference_id
FROM pages""")
def clean_id(spark, sf):
    k = F.col("page_id") % 4
    raw = (F.when(k == 0, F.concat(F.lit(" arXiv: 2401."), _p5(), F.lit("v3"))).when(k == 1, F.concat(F.lit("hep-th/00"), _p5()))
           .when(k == 2, F.concat(F.lit("arxiv_2401."), _p5(), F.lit("v1"))).otherwise(F.col("url")))
    return table(spark, sf, "pages").select(
        "page_id", F.coalesce(ids.clean_arxiv_id(raw), F.lit("-")).alias("resolver_id"),
        ids.clean_result_id(raw).alias("result_id"), ids.clean_reference_id(raw).alias("reference_id"))


@query("normalize_title", f"""
SELECT doc_id, {norm_sql("t")} AS resolver_form, {norm_sql("regexp_replace(t, '\\$[^$]*\\$', ' ', 'g')")} AS gold_form
FROM (SELECT doc_id, text || ' \\alpha* $x_1$ end' AS t FROM documents)""")
def normalize_title(spark, sf):
    t = F.concat("text", F.lit(" \\alpha* $x_1$ end"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.normalize_title(t).alias("resolver_form"), tx.normalize_title(t, drop_math=True).alias("gold_form"))


_JAC_SQL = """round(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END, 4)"""


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm_sql(x)}, ' '), lambda w: w <> ''))"


@query("title_jaccard", with_ctes(PAPERS_SQL) + f"""
SELECT paper_id, {_JAC_SQL.format(a='ta', b='tb')} AS jaccard FROM (
  SELECT paper_id, {tokens_sql('title')} AS ta, {tokens_sql("CASE WHEN doc_id % 9 = 0 THEN '' ELSE abstract END")} AS tb FROM papers)""")
def title_jaccard(spark, sf):
    p = papers(spark, sf)
    other = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("abstract"))
    return p.select("paper_id", F.round(tx.title_jaccard(F.col("title"), other), 4).alias("jaccard"))


@query("fold_accents", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def fold_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold_accents(F.col("text"))).alias("folded"))


@query("normalize_doi", """
SELECT page_id, regexp_replace(regexp_replace(lower(trim(d)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '[.,;)]+$', '') AS resolver_form,
  lower(trim(d)) AS gold_form
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' https://doi.org/10.1000/AB' || CAST(page_id AS VARCHAR) || ').' WHEN 1 THEN 'DOI: 10.5/x' || CAST(page_id AS VARCHAR) || ';' ELSE url END AS d FROM pages)""")
def normalize_doi(spark, sf):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    d = (F.when(k == 0, F.concat(F.lit(" https://doi.org/10.1000/AB"), n, F.lit(").")))
         .when(k == 1, F.concat(F.lit("DOI: 10.5/x"), n, F.lit(";"))).otherwise(F.col("url")))
    return table(spark, sf, "pages").select(
        "page_id", ids.normalize_doi(d).alias("resolver_form"), ids.trim_doi(d).alias("gold_form"))


@query("find_ids", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2402.' || n WHEN 1 THEN 'math.ag/00' || n ELSE '-' END AS arxiv_id,
  CASE doc_id % 4 WHEN 2 THEN '10.1234/abc' || n ELSE '-' END AS doi,
  CASE doc_id % 4 WHEN 0 THEN '2402.' || n || ',2403.00001' WHEN 3 THEN '2312.' || n ELSE '' END AS in_text
FROM (SELECT doc_id, lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS n FROM documents)""")
def find_ids(spark, sf):
    n = F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")
    k = F.col("doc_id") % 4
    text = (F.when(k == 0, F.concat(F.lit("see https://arxiv.org/abs/2402."), n, F.lit("v2, and (2403.00001) pages 1413.12345")))
            .when(k == 1, F.concat(F.lit("preprint arXiv:math.AG/00"), n))
            .when(k == 2, F.concat(F.lit("doi 10.1234/abc"), n, F.lit(").")))
            .otherwise(F.concat(F.lit("bare 2312."), n, F.lit(" twice 2312."), n)))
    got = table(spark, sf, "documents").select(
        "doc_id", F.coalesce(ids.find_arxiv_id(text), F.lit("-")).alias("arxiv_id"),
        F.coalesce(ids.find_doi(text), F.lit("-")).alias("doi"), F.array_join(ids.ids_in_text(text), ",").alias("in_text"))
    return got


@query("paper_key", f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'arxiv_2401.' || {_P5} WHEN 1 THEN 'empty_key'
  ELSE 'id_' || substring(regexp_replace(lower(url), '[^A-Za-z0-9]', '_', 'g'), 1, 30) || '_' || substring(md5(url), 1, 8) END AS paper_key
FROM pages""")
def paper_key(spark, sf):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), _p5(), F.lit("v2"))).when(k == 1, "  ").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", ids.paper_key(raw).alias("paper_key"))


@query("year_of_id", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2000 + yy ELSE CASE WHEN yy >= 91 THEN 1900 + yy ELSE 2000 + yy END END AS year,
  CASE WHEN event_id % 2 = 0 AND mm BETWEEN 1 AND 12 THEN CAST(2000 + yy AS VARCHAR) || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-01' ELSE '-' END AS month
FROM (SELECT event_id, event_id % 100 AS yy, user_id % 15 AS mm FROM events)""")
def year_of_id(spark, sf):
    yy = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    mm = F.lpad((F.col("user_id") % 15).cast("string"), 2, "0")
    pid = F.when(F.col("event_id") % 2 == 0, F.concat(yy, mm, F.lit(".01234"))).otherwise(F.concat(F.lit("cs.AI/"), yy, mm, F.lit("123")))
    return table(spark, sf, "events").select(
        "event_id", ids.year_of_id(pid).cast("long").alias("year"),
        F.coalesce(ids.month_of_id(pid).cast("string"), F.lit("-")).alias("month"))


@query("strip_survey_words", """
SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)^([ ,.&-]|(and|of|on|for|in|the|a|an|with)\\b)+', ''), '(?i)([ ,.&-]+(and|of|on|for|in|the|a|an|with)?)+$', '') AS topic
FROM (SELECT doc_id, regexp_replace(regexp_replace(strip_accents(array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 6), ' ')), '[^A-Za-z ]', '', 'g') || ' graphs and', ' +', ' ', 'g') AS t FROM documents)
WHERE len(string_split(trim(regexp_replace(regexp_replace(t, '(?i)^([ ,.&-]|(and|of|on|for|in|the|a|an|with)\\b)+', ''), '(?i)([ ,.&-]+(and|of|on|for|in|the|a|an|with)?)+$', '')), ' ')) >= 2""")
def strip_survey_words(spark, sf):
    words = tx.fold_accents(F.array_join(F.slice(F.split(tx.squeeze(F.col("text")), " "), 1, 6), " "))
    core = F.regexp_replace(words, "[^A-Za-z ]", "")
    title = F.concat(F.lit("A Comprehensive Survey on "), core, F.lit(" graphs and: A Review and Outlook"))
    topic = tx.topic_query(title)
    return table(spark, sf, "documents").select("doc_id", topic.alias("topic")).filter(
        ~F.col("topic").startswith("A Comprehensive"))


@query("numbers_decimal", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(^|[^0-9A-Za-z_À-ÿ.])([0-9]{1,10})($|[^0-9A-Za-z_À-ÿ.,])', 2), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)))), ';') AS numbers
FROM (SELECT doc_id, ' v ' || CAST(doc_id * 7 AS VARCHAR) || ' and ' || CAST(doc_id AS VARCHAR) || ' ' AS text FROM documents)""")
def numbers_decimal(spark, sf):
    text = F.concat(F.lit(" v "), (F.col("doc_id") * 7).cast("string"), F.lit(" and "), F.col("doc_id").cast("string"), F.lit(" "))
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_sort(nb.decimal_tokens(text)), ";").alias("numbers"))


@query("number_variants", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE p_partkey % 3
   WHEN 0 THEN [CAST(1 + p_partkey % 9 AS VARCHAR) || '.5', CAST(CAST((1 + p_partkey % 9) * 10 + 5 AS DECIMAL(18,3)) / 1000 AS VARCHAR)]
   WHEN 1 THEN [CAST((1 + p_partkey % 9) * 1000 + 500 AS VARCHAR), CAST(1 + p_partkey % 9 AS VARCHAR) || '.5']
   ELSE [CAST(p_partkey AS VARCHAR)] END)), ';') AS variants FROM part""")
def number_variants(spark, sf):
    k, n = F.col("p_partkey") % 3, (1 + F.col("p_partkey") % 9).cast("string")
    token = F.when(k == 0, F.concat(n, F.lit(",5"))).when(k == 1, F.concat(n, F.lit(",500"))).otherwise(
        F.concat(F.lit("+"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(nb.number_variants(token, k == 0)), ";").alias("variants"))


@query("parse_number", """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE l_linenumber % 3 WHEN 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) WHEN 1 THEN CAST(l_quantity AS DECIMAL(18,2)) END, -1)::DOUBLE AS single,
   (CASE l_linenumber % 3 WHEN 1 THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END)::DOUBLE AS first_number FROM lineitem""")
def parse_number(spark, sf):
    money = lambda c: F.format_number(F.col(c), 2)
    k = F.col("l_linenumber") % 3
    v = (F.when(k == 0, F.concat(money("l_extendedprice"), F.lit(" %")))
         .when(k == 1, F.concat(money("l_quantity"), F.lit(" ± 3.1")))
         .otherwise(F.concat(money("l_extendedprice"), F.lit("/"), money("l_quantity"))))
    v = F.when(k != 0, v).otherwise(F.replace(v, F.lit(","), F.lit("")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce(nb.single_number(v).cast("double"), F.lit(-1.0)).alias("single"),
        nb.parse_number(v).cast("double").alias("first_number"))


@query("bibtex", """
SELECT s_suppkey, '@article{' || lower(regexp_replace(CASE WHEN s_suppkey % 4 = 0 THEN 'paper' ELSE s_name END, '[^a-zA-Z]', '', 'g')) || y || 'nation,' || chr(10) || '  title={Nation ' || CAST(s_nationkey AS VARCHAR) || '},' || chr(10) ||
  '  author={' || CASE WHEN s_suppkey % 4 = 0 THEN 'Unknown Author' ELSE 'Ann ' || s_name || ' and Bo Li' END || '},' || chr(10) ||
  CASE WHEN s_suppkey % 2 = 0 THEN '  journal={arXiv preprint arXiv:2401.' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') || '},' || chr(10) || '  year={' || y || '},' || chr(10) || '  eprint={2401.' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') || '},' || chr(10) || '  archivePrefix={arXiv},' || chr(10) || '  primaryClass={cs.AI}' || chr(10) || '}'
  ELSE '  journal={Research Paper Archive},' || chr(10) || '  year={' || y || '}' || chr(10) || '}' END AS entry
FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN '2024' ELSE '2019' END AS y FROM supplier)""")
def bibtex(spark, sf):
    n = F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0")
    authors = F.when(F.col("s_suppkey") % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("Ann "), "s_name"), F.lit("Bo Li")))
    return table(spark, sf, "supplier").select("s_suppkey", nb.bibtex(
        F.concat(F.lit("Nation  "), F.col("s_nationkey").cast("string")), authors,
        F.when(F.col("s_suppkey") % 3 != 0, "2019-05-01").otherwise(""),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("2401."), n, F.lit("v1"))).otherwise("")).alias("entry"))


_VN = "|".join(tx.VIETNAMESE_MARKERS)


@query("detect_language", f"""
SELECT doc_id, CASE WHEN regexp_matches(lower(t), '{_VN}') THEN 'Vietnamese' ELSE 'English' END AS label
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Phân Tích ' || text ELSE text END AS t FROM documents)""")
def detect_language(spark, sf):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Phân Tích "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.detect_language(t).alias("label"))


@query("clip_text", f"""
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 119)) || '…' END AS clipped FROM (SELECT doc_id, {sq('text')} AS t FROM documents)""")
def clip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clip(F.col("text"), 120).alias("clipped"))


@query("squeeze", """
SELECT page_id, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS compact_md5, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS clean_md5 FROM pages""")
def squeeze(spark, sf):
    noisy = F.concat(F.lit("\u00a0😀✔"), "html", F.lit("\u200b "))
    return table(spark, sf, "pages").select(
        "page_id", F.md5(tx.compact(F.concat(F.lit("😀 ✔️"), "html"))).alias("compact_md5"),
        F.md5(tx.clean_inline(F.concat(F.lit("\u00a0\u200b"), "html", F.lit("\u200b ")))).alias("clean_md5"))


@query("redact", f"SELECT doc_id, {redact_sql('text')} AS masked FROM documents")
def redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rd.redact(F.col("text")).alias("masked"))


@query("safe_link", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://arxiv.org/abs/' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'https://github.com/a/b?x=' || CAST(page_id AS VARCHAR) ELSE '-' END AS link FROM pages""")
def safe_link(spark, sf):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = (F.when(k == 0, F.concat(F.lit("http://arXiv.org:80/abs/"), n)).when(k == 1, F.concat(F.lit("https://github.com/a/b?x="), n))
           .when(k == 2, F.concat(F.lit("https://user:pw@github.com/"), n)).otherwise(F.col("url")))
    return table(spark, sf, "pages").select("page_id", F.coalesce(rd.safe_link(url), F.lit("-")).alias("link"))


@query("fingerprint", """
SELECT doc_id, substring(sha256(encode(text) || '\\x00'::BLOB || encode(coalesce(lang, '')) || '\\x00'::BLOB), 1, 16) AS fp FROM documents""")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.fingerprint(F.col("text"), F.col("lang")).alias("fp"))


@query("word_count", f"""
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS words,
  CAST(len(regexp_extract_all(text, '\\$\\$')) // 2 AS BIGINT) AS equations, doc_id % 6 = 0 AS has_table
FROM (SELECT doc_id, text, {sq('text')} AS t FROM documents)""")
def word_count(spark, sf):
    table_text = F.when(F.col("doc_id") % 6 == 0, "x\n | a | b |\n |:--|--:|\n | 1 | 2 |").otherwise("| a | b |\n text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.word_count(F.col("text")).cast("long").alias("words"),
        tx.display_equations(F.col("text")).alias("equations"), tx.has_table(table_text).alias("has_table"))


@query("strip_fences", """
SELECT doc_id, md5(trim(text || chr(10) || chr(10) || 'end', ' ' || chr(10) || chr(9) || chr(13))) AS stripped FROM documents""")
def strip_fences(spark, sf):
    t = F.concat("text", F.lit("\n```bibtex\n## x\n```  \nend"))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.strip_fences(t)).alias("stripped"))


@query("coerce_number", """
SELECT event_id, coalesce(CASE event_id % 5 WHEN 0 THEN event_id END, -1) AS whole,
  coalesce(CASE event_id % 5 WHEN 0 THEN least(event_id, 604800000) WHEN 1 THEN CAST(floor(value) AS BIGINT) WHEN 4 THEN 604800000 END, -1) AS ms FROM events""")
def coerce_number(spark, sf):
    k = F.col("event_id") % 5
    raw = (F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.format_string("%.2f", "value")))
           .when(k == 2, "true").when(k == 3, F.concat(F.lit("-"), (F.col("event_id") + 1).cast("string"))).otherwise("9e20"))
    whole = F.when(k == 1, None).otherwise(nb.nonneg_int(raw))
    return table(spark, sf, "events").select(
        "event_id", F.coalesce(whole, F.lit(-1)).alias("whole"), F.coalesce(nb.duration_ms(raw), F.lit(-1)).alias("ms"))


@query("year_label", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%m/%Y') END AS label FROM orders""")
def year_label(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", nb.published_label(raw).alias("label"))


@query("first_heading", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substring({sq('text')}, 1, 240) ELSE 'none' END AS heading FROM documents""")
def first_heading(spark, sf):
    body = tx.squeeze(F.col("text"))
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## sub\n#   "), body, F.lit("  \n# two"))).otherwise(
        F.concat(F.lit("## "), body))
    return table(spark, sf, "documents").select("doc_id", tx.first_heading(t, F.lit("none")).alias("heading"))


@query("short_id", "SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS short_id FROM pages")
def short_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.short_id(F.col("url")).alias("short_id"))


@query("content_chars", "SELECT conv_id, turn, CAST(length(text) + length(role) AS BIGINT) AS chars FROM conversations")
def content_chars(spark, sf):
    msgs = F.array(F.struct(F.col("role").alias("content")), F.struct(F.col("text").alias("content")))
    payload = F.to_json(F.struct(msgs.alias("messages")))
    parsed = F.from_json(payload, "messages array<struct<content:string>>")["messages"]
    total = F.aggregate(parsed, F.lit(0).cast("long"), lambda acc, m: acc + F.length(m["content"]))
    return table(spark, sf, "conversations").select("conv_id", "turn", total.alias("chars"))


@query("url_base", "SELECT page_id, substring(string_split(url, '?')[1], 1, 200) AS base FROM pages")
def url_base(spark, sf):
    return table(spark, sf, "pages").select("page_id", rd.url_base(F.col("url")).alias("base"))
