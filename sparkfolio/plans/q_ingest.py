"""Scans, ingest, filters and per-row status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import ids, redact, text as tx
from sparkfolio.operators import filters as fl
from sparkfolio.plans.bindings import (
    PAPERS_SQL, PID_SQL, RUN_EVENTS_SQL, papers, raw_papers, run_events, sq, with_ctes,
)
from sparkfolio.plans.registry import query, table
from sparkfolio.sources import papers as src


@query("scan_prune", "SELECT doc_id, lang, source FROM documents")
def scan_prune(spark, sf):
    return src.read_papers(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "source"])


@query("ingest_clean", with_ctes(PAPERS_SQL) + """
SELECT paper_id, title, md5(abstract) AS abstract_md5, authors, categories, primary_category, date, coalesce(doi, '') AS doi
FROM papers""")
def ingest_clean(spark, sf):
    return papers(spark, sf).select(
        "paper_id", "title", F.md5("abstract").alias("abstract_md5"), "authors", "categories", "primary_category",
        "date", "doi")


@query("ingest_dedupe", """
SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY text""")
def ingest_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return src.first_row_per_key(docs, "text_md5", "doc_id")


@query("ingest_stats", """
SELECT count(*) AS scanned, count(DISTINCT text) FILTER (lang LIKE 'e%' OR lang LIKE 'f%') AS papers FROM documents""")
def ingest_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    kept = src.first_row_per_key(docs.filter(fl.has_category_prefix(F.col("lang"), ["e", "f"])), "text_md5", "doc_id")
    return src.build_stats(docs, kept)


@query("filter_category_prefix", with_ctes(PAPERS_SQL) + """
SELECT paper_id, categories FROM papers WHERE len(list_filter(string_split(categories, ' '), lambda c: starts_with(c, 'src1') OR starts_with(c, 'de'))) > 0""")
def filter_category_prefix(spark, sf):
    return papers(spark, sf).filter(fl.has_category_prefix(F.col("categories"), ["src1", "de"])).select(
        "paper_id", "categories")


@query("filter_category", with_ctes(PAPERS_SQL) + """
SELECT paper_id, categories FROM papers
WHERE list_contains(string_split(lower(categories), ' '), 'fr') OR (' ' || lower(categories)) LIKE '% src2%'""")
def filter_category(spark, sf):
    return papers(spark, sf).filter(fl.in_categories(F.col("categories"), ["FR", " ", "src2*"])).select(
        "paper_id", "categories")


@query("filter_date_before", with_ctes(PAPERS_SQL) + """
SELECT paper_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE date END AS date FROM papers
WHERE CASE WHEN doc_id % 10 = 0 THEN '' ELSE date END <= '2024-06-30'""")
def filter_date_before(spark, sf):
    p = papers(spark, sf).withColumn("date", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("date")))
    return p.filter(fl.date_before(F.col("date"), "2024-06-30T12:00:00")).select("paper_id", "date")


@query("filter_legacy_ids", with_ctes(PAPERS_SQL) + """
SELECT paper_id FROM papers WHERE regexp_matches(paper_id, '^[0-9]{4}\\.')""")
def filter_legacy_ids(spark, sf):
    return papers(spark, sf).filter(fl.modern_ids(F.col("paper_id"))).select("paper_id")


@query("select_surveys", with_ctes(PAPERS_SQL) + """
SELECT paper_id, title, date FROM papers
WHERE primary_category = 'en' AND regexp_matches(paper_id, '^[0-9]{4}\\.[0-9]{4,5}$')
  AND 2000 + CAST(substring(paper_id, 1, 2) AS INTEGER) BETWEEN 2021 AND 2030
  AND regexp_matches(lower(title), '\\b(the|that)\\b')""")
def select_surveys(spark, sf):
    return fl.select_candidates(papers(spark, sf), "en", 2021, 2030, r"(?U)\b(the|that)\b")


@query("sample_seeded", None)
def sample_seeded(spark, sf):
    return fl.sample_by_seed(papers(spark, sf).select("paper_id", "title"), 50, 7)


_AUTH_SQL = """list_filter(list_transform(string_split(regexp_replace(regexp_replace(authors, '\\([^)]*\\)', ' ', 'g'), '\\s+and\\s+', ', ', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"""


@query("metadata_status", with_ctes(PAPERS_SQL) + f"""
SELECT paper_id, CASE WHEN title <> '' AND len({_AUTH_SQL}) > 0 AND d <> '' AND s <> '' THEN 'complete' ELSE 'missing' END AS metadata_status
FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' ELSE date END AS d, CASE WHEN doc_id % 11 = 0 THEN '' ELSE categories END AS s FROM papers)""")
def metadata_status(spark, sf):
    p = papers(spark, sf)
    published = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("date"))
    subjects = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.split("categories", " "))
    return p.select("paper_id", fl.metadata_status(
        F.col("title"), fl.split_authors(F.col("authors")), published, subjects).alias("metadata_status"))


@query("needs_metadata", with_ctes(PAPERS_SQL) + """
SELECT paper_id, (trim(abstract) = '' OR doc_id % 13 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0) AS needs_metadata FROM papers""")
def needs_metadata(spark, sf):
    p = papers(spark, sf)
    title = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("arXiv "), "paper_id")).otherwise(F.concat(F.lit("x "), "title"))
    published = F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("date"))
    status = F.when(F.col("doc_id") % 5 == 0, "missing").otherwise("complete")
    return p.select("paper_id", fl.needs_metadata(
        F.col("abstract"), F.split("authors", ","), published, F.split("categories", " "), status, title
    ).alias("needs_metadata"))


@query("project_paper", with_ctes(PAPERS_SQL) + f"""
SELECT CASE WHEN regexp_matches(paper_id, '^[0-9]{{4}}\\.') THEN 'arxiv_' || paper_id ELSE 'arxiv_' || replace(paper_id, '/', '_') END AS paper_key,
       paper_id AS arxiv_id, array_to_string({_AUTH_SQL}, ';') AS authors,
       array_to_string(string_split(categories, ' '), ';') AS subjects,
       'https://arxiv.org/abs/' || paper_id AS abs_url, 'https://arxiv.org/html/' || paper_id AS html_url,
       'https://arxiv.org/pdf/' || paper_id || '.pdf' AS pdf_url,
       CASE WHEN title <> '' AND len({_AUTH_SQL}) > 0 THEN 'complete' ELSE 'missing' END AS metadata_status
FROM papers""")
def project_paper(spark, sf):
    return fl.to_paper_rows(papers(spark, sf)).select(
        "paper_key", "arxiv_id", F.array_join("authors", ";").alias("authors"),
        F.array_join("subjects", ";").alias("subjects"), "abs_url", "html_url", "pdf_url", "metadata_status")


_KW = "(?i)(api[_ -]?key|authorization|bearer|access[_ -]?token|secret)\\s*[:=]\\s*[^\\s,;]+"


def redact_sql(x: str) -> str:
    """The documents hold no URL, no local path and no traceback, so two masks are enough."""
    masked = f"regexp_replace({x}, '{_KW}', '\\1=[REDACTED]', 'g')"
    return f"regexp_replace({masked}, '(?i)\\b(sk-[A-Za-z0-9_-]{{8,}}|zai-[A-Za-z0-9_-]{{8,}})\\b', '[REDACTED]', 'g')"


@query("public_projection", with_ctes(PAPERS_SQL) + f"""
SELECT substring({redact_sql("trim(title)")}, 1, 20) AS title, substring({redact_sql("trim(abstract)")}, 1, 200) AS abstract,
       array_to_string(list_slice(string_split(categories, ' '), 1, 1), ';') AS subjects,
       coalesce(CASE WHEN doc_id % 9 <> 0 THEN doc_id END, -1) AS n
FROM papers""")
def public_projection(spark, sf):
    p = papers(spark, sf).withColumn("subjects", F.split("categories", " ")).withColumn(
        "n", F.when(F.col("doc_id") % 9 == 0, F.lit("x")).otherwise(F.col("doc_id").cast("string")))
    out = fl.public_rows(p, {"title": 20, "abstract": 200}, {"subjects": 1}, ["n"])
    return out.select("title", "abstract", F.array_join("subjects", ";").alias("subjects"),
                      F.coalesce("n", F.lit(-1)).alias("n"))


@query("identifier_ok", """
SELECT page_id, CASE WHEN regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9_.-]{0,255}') THEN t ELSE '-' END AS identifier
FROM (SELECT page_id, trim(CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^https?://([^/]*).*$', 1) ELSE url END) AS t FROM pages)""")
def identifier_ok(spark, sf):
    pages = table(spark, sf, "pages")
    name = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", "^https?://([^/]*).*$", 1)).otherwise(F.col("url"))
    return pages.select("page_id", F.coalesce(ids.public_identifier(name), F.lit("-")).alias("identifier"))


@query("validate_input", """
WITH parts AS (
  SELECT page_id, unnest(string_split(
    CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://arxiv.org/abs/2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v2'
      WHEN 2 THEN 'arXiv:2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || ',  folder/a.pdf'
      WHEN 3 THEN 'paper ' || CAST(page_id AS VARCHAR) ELSE 'http://user@arxiv.org/abs/2401.00001' END, ',')) AS raw FROM pages)
SELECT page_id, coalesce(CASE
    WHEN regexp_matches(t, '(?i)^(arxiv:)?\\d{4}\\.\\d{4,5}(v\\d+)?$') THEN t
    WHEN starts_with(t, 'https://arxiv.org/abs/') THEN regexp_extract(t, '(\\d{4}\\.\\d{4,5}(v\\d+)?)', 1) END, '-') AS value,
  CASE WHEN regexp_matches(t, '(?i)^(arxiv:)?\\d{4}\\.\\d{4,5}(v\\d+)?$') OR starts_with(t, 'https://arxiv.org/abs/') THEN 'ok'
    WHEN contains(t, '://') THEN 'host_not_allowed' WHEN contains(t, '/') THEN 'local_path' ELSE 'not_an_id' END AS reason
FROM (SELECT page_id, trim(raw) AS t FROM parts)""")
def validate_input(spark, sf):
    pid = F.lpad(F.col("page_id").cast("string"), 5, "0")
    kind = F.col("page_id") % 5
    raw = (F.when(kind == 0, F.col("url"))
           .when(kind == 1, F.concat(F.lit("https://arxiv.org/abs/2401."), pid, F.lit("v2")))
           .when(kind == 2, F.concat(F.lit("arXiv:2401."), pid, F.lit(",  folder/a.pdf")))
           .when(kind == 3, F.concat(F.lit("paper "), F.col("page_id").cast("string")))
           .otherwise(F.lit("http://user@arxiv.org/abs/2401.00001")))
    parts = table(spark, sf, "pages").select("page_id", F.explode(redact.split_inputs(raw)).alias("t"))
    got = parts.select("page_id", redact.classify_input(F.col("t")).alias("r"))
    return got.select("page_id", F.coalesce("r.value", F.lit("-")).alias("value"), F.col("r.reason").alias("reason"))


@query("valid_report", """
SELECT doc_id, trim(t) <> '' AND NOT starts_with(lower(regexp_replace(trim(t), '^[ \\t\\r\\n*_`#(]+', '')), 'error generating final report') AS valid
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '## *Error generating final report*: ' || text ELSE text END AS t FROM documents)""")
def valid_report(spark, sf):
    kind = F.col("doc_id") % 4
    t = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("## *Error generating final report*: "), "text")).otherwise(
        F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.is_report(t).alias("valid"))


@query("route_rows", """
SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'error_handler' WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'answer_followup'
       WHEN event_type = 'view' AND k % 3 > 0 THEN 'read_paper' ELSE 'search_papers' END AS after_router,
  CASE WHEN event_type = 'error' THEN 'error_handler' WHEN k % 5 = 0 THEN 'read_paper' WHEN k % 4 < 2 THEN 'refine_query'
       WHEN k % 3 > 0 THEN 'read_paper' ELSE 'error_handler' END AS after_eval,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 3 END AS BIGINT) AS n_branches
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def route_rows(spark, sf):
    ev = run_events(spark, sf)
    status = F.when(F.col("event_type") == "error", "error").otherwise("running")
    intent = F.when(F.col("event_type") == "purchase", "followup").when(F.col("event_type") == "view", "direct_read").otherwise("search")
    k = F.col("k")
    rows = ev.select(
        "event_id", status.alias("status"), fl.route(status, intent, k % 2 == 0, k % 3).alias("after_router"),
        fl.route_after_eval(status, k % 5 == 0, k % 4, k % 3).alias("after_eval"))
    branches = F.when(F.col("status") == "error", 1).otherwise(3)
    return rows.select("event_id", "after_router", "after_eval", branches.cast("long").alias("n_branches"))


@query("is_official_repo", """
SELECT p_partkey, contains(lower(d), 'official') OR contains(lower(d), lower(trim(regexp_replace(p_name, '[^\\w\\s-]', ' ', 'g')))) AS official
FROM (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'The Official code' WHEN 1 THEN 'code for ' || upper(p_name) ELSE p_type END AS d FROM part)""")
def is_official_repo(spark, sf):
    kind = F.col("p_partkey") % 3
    desc = F.when(kind == 0, "The Official code").when(kind == 1, F.concat(F.lit("code for "), F.upper("p_name"))).otherwise(
        F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", fl.is_official_repo(
        desc, F.lit(None).cast("string"), F.col("p_name")).alias("official"))


@query("quality_vocab", """
SELECT event_id,
  CASE event_type WHEN 'signup' THEN 'heading' WHEN 'error' THEN 'fallback' ELSE 'unknown' END AS heading,
  CASE event_type WHEN 'signup' THEN 'success' WHEN 'error' THEN 'error' WHEN 'view' THEN 'degraded' ELSE 'unknown' END AS parser,
  CASE event_type WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'invalid' WHEN 'view' THEN 'unknown' ELSE CASE WHEN event_id % 2 = 0 THEN 'missing' ELSE 'unknown' END END AS quality,
  CASE event_type WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'invalid' WHEN 'view' THEN 'unknown' ELSE CASE WHEN event_id % 2 = 0 THEN 'missing' ELSE 'unknown' END END AS status
FROM events""")
def quality_vocab(spark, sf):
    et = F.col("event_type")
    heading = F.when(et == "signup", " Detected ").when(et == "error", "HEURISTIC").otherwise(et)
    parser = F.when(et == "signup", "OK").when(et == "error", "Failure").when(et == "view", "warn").otherwise(et)
    explicit = F.when(et == "signup", "Complete").when(et == "error", "invalid").when(et == "view", "unknown").otherwise("")
    quality, status = fl.notes_quality(explicit, F.col("event_id") % 2 == 0)
    return table(spark, sf, "events").select(
        "event_id", fl.normalize_status(heading, "heading").alias("heading"),
        fl.normalize_status(parser, "parser").alias("parser"), quality.alias("quality"), status.alias("status"))


@query("case_select", """
SELECT event_id, 'c' || CAST(event_id AS VARCHAR) AS case_id, event_type AS run FROM events WHERE event_type IN ('view', 'click')""")
def case_select(spark, sf):
    cases = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("case_id"), F.col("event_type").alias("run"))
    return fl.select_cases(cases, "view, click ,nothing")


@query("select_indices", """
WITH ranked AS (
  SELECT o_custkey AS group_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders),
picks AS (SELECT DISTINCT group_id, CASE WHEN group_id % 2 = 0 THEN [4, 0, 99] ELSE [99, -1] END AS idx FROM ranked),
wanted AS (SELECT group_id, unnest(idx) AS pos, unnest(range(len(idx))) AS out_pos FROM picks),
hit AS (SELECT r.group_id, w.out_pos, r.item FROM ranked r JOIN wanted w ON r.group_id = w.group_id AND r.pos = w.pos)
SELECT * FROM hit UNION ALL
SELECT group_id, pos AS out_pos, item FROM ranked WHERE pos < 3 AND group_id NOT IN (SELECT group_id FROM hit)""")
def select_indices(spark, sf):
    from sparkfolio.scale import numbered, value_block

    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("item"), (-F.col("o_totalprice")).alias("neg"))
    cands = numbered(o, ["group_id"], value_block(F.col("neg")), ["neg", "item"], "pos").withColumn(
        "pos", F.col("pos") - 1)
    idx = F.when(F.col("group_id") % 2 == 0, F.array(F.lit(4), F.lit(0), F.lit(99))).otherwise(
        F.array(F.lit(99), F.lit(-1)))
    picks = o.select("group_id").distinct().select("group_id", idx.alias("idx"))
    return fl.pick_by_index(cands, picks, 3)
