"""Reference resolution, gold sets and metadata joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.operators import resolve as rs
from sparkfolio.plans.bindings import PAPERS_SQL, REFS_SQL, norm_sql, papers, refs, with_ctes
from sparkfolio.plans.q_scalar import _JAC_SQL, tokens_sql
from sparkfolio.plans.registry import query, table


def _doi(x):
    return f"regexp_replace(regexp_replace(lower(trim({x})), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '[.,;)]+$', '')"


def norm_gold(x):
    return norm_sql(f"regexp_replace({x}, '\\$[^$]*\\$', ' ', 'g')")


RES_SQL = f"""
dd AS (SELECT {_doi('doi')} AS key, min(paper_id) AS id, count(DISTINCT paper_id) AS n FROM papers WHERE doi IS NOT NULL GROUP BY 1),
tt AS (SELECT {norm_sql('title')} AS key, min(paper_id) AS id, count(DISTINCT paper_id) AS n FROM papers GROUP BY 1),
r AS (SELECT *, regexp_replace(regexp_replace(arxiv_id, '^arXiv:', ''), 'v\\d+$', '') AS ex, {_doi('doi')} AS nd, {norm_sql('title')} AS nt FROM refs),
r2 AS (SELECT *, CASE WHEN regexp_matches(ex, '^(\\d{{4}}\\.\\d{{4,5}}|[a-z][a-z.-]*/\\d{{7}})$') THEN ex END AS e,
       nullif(regexp_extract(nd, '^10\\.48550/arxiv\\.(\\d{{4}}\\.\\d{{4,5}}|[a-z][a-z.-]*/\\d{{7}})$', 1), '') AS ad FROM r),
res AS (
  SELECT paper_id, ref_index, coalesce(e, ad, CASE WHEN dd.n = 1 THEN dd.id END, CASE WHEN tt.n = 1 THEN tt.id END) AS target,
    CASE WHEN e IS NOT NULL THEN 'explicit' WHEN ad IS NOT NULL THEN 'arxiv_doi' WHEN dd.n = 1 THEN 'index_doi' WHEN tt.n = 1 THEN 'index_title' END AS method,
    coalesce(e, ad, CASE WHEN dd.n = 1 THEN dd.id END) IS NULL AND coalesce(tt.n, 0) > 1 AS ambiguous
  FROM r2 LEFT JOIN dd ON r2.nd = dd.key LEFT JOIN tt ON r2.nt = tt.key AND len(string_split(r2.nt, ' ')) >= 4)"""
RESOLVED = with_ctes(PAPERS_SQL, REFS_SQL, RES_SQL)


@query("resolve_refs", RESOLVED + "SELECT paper_id, ref_index, coalesce(target, '-') AS target, coalesce(method, '-') AS method, ambiguous FROM res")
def resolve_refs(spark, sf):
    r = rs.resolve_refs(refs(spark, sf), papers(spark, sf))
    return r.withColumn("target", F.coalesce("target", F.lit("-"))).withColumn("method", F.coalesce("method", F.lit("-")))


@query("resolve_stats", RESOLVED + """
SELECT 'refs_total' AS name, count(*) AS n FROM res UNION ALL SELECT 'refs_resolved', count(target) FROM res
UNION ALL SELECT 'refs_ambiguous', count(*) FILTER (ambiguous) FROM res
UNION ALL SELECT m, count(*) FILTER (method = m) FROM res CROSS JOIN (VALUES ('explicit'), ('arxiv_doi'), ('index_doi'), ('index_title')) v(m) GROUP BY m""")
def resolve_stats(spark, sf):
    return rs.resolve_stats(rs.resolve_refs(refs(spark, sf), papers(spark, sf)))


_STRICT_SQL = f"""
p2 AS (SELECT doc_id, paper_id, title, date, CASE WHEN doi IS NOT NULL THEN doi || CASE WHEN doc_id % 2 = 0 THEN ' 10.9/X' || CAST(doc_id // 4 AS VARCHAR) ELSE '' END ELSE '' END AS doi FROM papers),
rr AS (SELECT paper_id, ref_index, CASE WHEN doc_id % 8 = 4 THEN '9999.99999' WHEN doc_id % 8 = 0 THEN upper(substring(arxiv_id, 7)) END AS arxiv_id,
        CASE WHEN doc_id % 4 = 1 THEN substring(doi, 17) WHEN doc_id % 4 = 2 THEN ' 10.9/x' || CAST(doc_id // 5 AS VARCHAR) END AS doi, title, source_date FROM refs),
sdoi AS (SELECT key, arg_min(paper_id, doc_id) AS id FROM (SELECT paper_id, doc_id, unnest(string_split(lower(doi), ' ')) AS key FROM p2 WHERE doi <> '') GROUP BY key),
stt AS (SELECT key, CASE WHEN min(paper_id) = max(paper_id) THEN min(paper_id) END AS id FROM (SELECT paper_id, {norm_gold('title')} AS key FROM p2) GROUP BY key),
s1 AS (SELECT rr.*, a.paper_id AS by_id, b.paper_id AS by_doi_id, sdoi.id AS by_doi, CASE WHEN len(string_split({norm_gold('rr.title')}, ' ')) >= 4 THEN stt.id END AS by_title
  FROM rr LEFT JOIN p2 a ON a.paper_id = regexp_replace(lower(trim(rr.arxiv_id)), 'v\\d+$', '')
  LEFT JOIN p2 b ON b.paper_id = regexp_replace(regexp_extract(lower(trim(rr.doi)), '^10\\.48550/arxiv\\.(.+)$', 1), 'v\\d+$', '')
  LEFT JOIN sdoi ON sdoi.key = lower(trim(rr.doi)) LEFT JOIN stt ON stt.key = {norm_gold('rr.title')}),
strict AS (SELECT paper_id, ref_index, source_date, coalesce(by_id, by_doi_id, by_doi, by_title) AS target,
  CASE WHEN by_id IS NOT NULL THEN 'arxiv_id' WHEN by_doi_id IS NOT NULL THEN 'doi_arxiv' WHEN by_doi IS NOT NULL THEN 'doi_metadata' WHEN by_title IS NOT NULL THEN 'title' END AS method FROM s1)"""
STRICT = with_ctes(PAPERS_SQL, REFS_SQL, _STRICT_SQL)


def _strict_tables(spark, sf):
    extra = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" 10.9/X"), F.floor(F.col("doc_id") / 4).cast("string"))).otherwise("")
    p = papers(spark, sf).withColumn("doi", F.when(F.col("doi") != "", F.concat("doi", extra)).otherwise("")).withColumn(
        "pos", F.col("doc_id"))
    k8, k4 = F.col("doc_id") % 8, F.col("doc_id") % 4
    r = refs(spark, sf).withColumn(
        "arxiv_id", F.when(k8 == 4, "9999.99999").when(k8 == 0, F.upper(F.expr("substring(arxiv_id, 7)")))).withColumn(
        "doi", F.when(k4 == 1, F.expr("substring(doi, 17)")).when(
            k4 == 2, F.concat(F.lit(" 10.9/x"), F.floor(F.col("doc_id") / 5).cast("string"))))
    return p, r


@query("resolve_refs_strict", STRICT + "SELECT paper_id, ref_index, coalesce(target, '-') AS target, coalesce(method, '-') AS method FROM strict")
def resolve_refs_strict(spark, sf):
    p, r = _strict_tables(spark, sf)
    out = rs.resolve_refs_strict(r, p)
    return out.withColumn("target", F.coalesce("target", F.lit("-"))).withColumn("method", F.coalesce("method", F.lit("-")))


@query("wanted_keys", STRICT + f"""
SELECT paper_id FROM p2 WHERE paper_id IN (SELECT regexp_replace(lower(trim(arxiv_id)), 'v\\d+$', '') FROM rr WHERE arxiv_id IS NOT NULL)
  OR paper_id IN (SELECT regexp_replace(regexp_extract(lower(trim(doi)), '^10\\.48550/arxiv\\.(.+)$', 1), 'v\\d+$', '') FROM rr WHERE doi IS NOT NULL)
  OR len(list_intersect(string_split(lower(doi), ' '), (SELECT list(lower(trim(doi))) FROM rr WHERE doi IS NOT NULL))) > 0
  OR {norm_gold('title')} IN (SELECT {norm_gold('title')} FROM rr WHERE len(string_split({norm_gold('title')}, ' ')) >= 4)""")
def wanted_keys(spark, sf):
    p, r = _strict_tables(spark, sf)
    return rs.restrict_to_wanted(p, r).select("paper_id")


@query("temporal_gold", STRICT + """
SELECT s.paper_id, s.target, arg_min(method, ref_index) AS method FROM strict s JOIN papers p ON p.paper_id = s.target
WHERE s.target <> s.paper_id AND p.date < s.source_date GROUP BY ALL""")
def temporal_gold(spark, sf):
    p, r = _strict_tables(spark, sf)
    return rs.gold_before(rs.resolve_refs_strict(r, p), p, r.select("paper_id", "source_date"))


@query("gold_set", STRICT + f""",
grp AS (SELECT s.target, s.method, s.ref_index, CAST(p.doc_id // 40 AS BIGINT) AS g, p.doc_id FROM strict s JOIN papers p USING (paper_id)),
src AS (SELECT g, max(doc_id) AS doc_id FROM grp GROUP BY g),
named AS (SELECT g, p.paper_id, CASE WHEN g % 3 = 0 AND regexp_matches(p.paper_id, '^\\d{{4}}\\.') THEN '2024-01-01' ELSE p.date END AS source_date, CASE WHEN g % 3 = 0 THEN 'id_month' ELSE 'metadata' END AS date_source FROM src JOIN papers p ON src.doc_id = p.doc_id),
gd AS (SELECT n.paper_id, n.source_date, grp.target, arg_min(method, grp.doc_id) AS method FROM grp JOIN named n USING (g) JOIN papers p ON p.paper_id = grp.target
  WHERE grp.target <> n.paper_id AND p.date < n.source_date GROUP BY ALL)
SELECT paper_id, target, method, n_gold, source_date FROM gd JOIN (SELECT paper_id, count(*) AS n_gold FROM gd GROUP BY 1 HAVING count(*) >= 5) USING (paper_id)""")
def gold_set(spark, sf):
    p, r = _strict_tables(spark, sf)
    g = F.floor(F.col("doc_id") / 40)
    last = r.groupBy(g.alias("g")).agg(F.max("doc_id").alias("last_doc"))
    ids_ = p.select(F.col("doc_id").alias("last_doc"), F.col("paper_id").alias("survey"), "date")
    survey = last.join(ids_, "last_doc")
    grouped = r.withColumn("g", g).join(survey.select("g", "survey"), "g").select(
        F.col("survey").alias("paper_id"), F.col("doc_id").alias("ref_index"), "arxiv_id", "doi", "title")
    # Every third source has no date of its own: it is given as if the table lacked it.
    date = F.when(F.col("g") % 3 == 0, F.when(F.col("survey").rlike(r"^\d{4}\."), "2024-01-01").otherwise(F.col("date"))).otherwise(F.col("date"))
    sources = survey.select(F.col("survey").alias("paper_id"), date.alias("date"))
    return rs.gold_set(sources, grouped, p, min_refs=5).select("paper_id", "target", "method", "n_gold", "source_date")


@query("measured_table", with_ctes(PAPERS_SQL) + """
SELECT paper_id, title, substring(date, 1, 4) AS year, md5(abstract) AS abstract_md5 FROM papers WHERE doc_id % 3 = 0 AND title <> ''""")
def measured_table(spark, sf):
    p = papers(spark, sf)
    return rs.index_meta(p.filter(F.col("doc_id") % 3 == 0), p).select("paper_id", "title", "year", F.md5("abstract").alias("abstract_md5"))


_WORK_TITLE = "CASE WHEN doc_id % 4 = 0 THEN title || ' extended' WHEN doc_id % 4 = 1 THEN array_to_string(list_slice(string_split(abstract, ' '), 5, 12), ' ') ELSE title END"


def _work_title():
    k = F.col("doc_id") % 4
    return F.when(k == 0, F.concat("title", F.lit(" extended"))).when(
        k == 1, F.array_join(F.slice(F.split("abstract", " "), 5, 8), " ")).otherwise(F.col("title"))


@query("record_mismatch", with_ctes(PAPERS_SQL) + f"""
SELECT paper_id, j < 0.5 AND title <> '' AND wt <> '' AS wrong, CASE WHEN j < 0.5 AND title <> '' AND wt <> '' THEN -1 ELSE doc_id % 50 END AS cited_by_count FROM (
  SELECT *, {_JAC_SQL.format(a='ta', b='tb')} AS j FROM (SELECT *, {tokens_sql('title')} AS ta, {tokens_sql('wt')} AS tb FROM (SELECT *, {_WORK_TITLE} AS wt FROM papers)))""")
def record_mismatch(spark, sf):
    p = papers(spark, sf).withColumn("wrong", rs.mismatch(F.col("title"), _work_title()))
    return p.select("paper_id", "wrong", F.when(F.col("wrong"), F.lit(-1)).otherwise(F.col("doc_id") % 50).alias("cited_by_count"))


@query("title_repair", with_ctes(PAPERS_SQL) + f"""
, w AS (SELECT paper_id AS work_id, doc_id % 50 AS c, {tokens_sql(_WORK_TITLE)} AS tb FROM papers),
b AS (SELECT paper_id AS id, {tokens_sql('title')} AS ta FROM papers WHERE doc_id % 4 IN (1, 2)),
best AS (SELECT id, max((c, work_id)) AS m FROM b JOIN w ON len(list_intersect(ta, tb)) >= 0.8 * (len(ta) + len(tb) - len(list_intersect(ta, tb))) - 1e-9 AND len(ta) > 0 GROUP BY id)
SELECT id, m[2] AS work_id, m[1] AS cited_by_count FROM best""")
def title_repair(spark, sf):
    p = papers(spark, sf)
    works = p.select(F.col("paper_id").alias("work_id"), _work_title().alias("title"), (F.col("doc_id") % 50).alias("cited_by_count"))
    bad = p.filter((F.col("doc_id") % 4).isin(1, 2)).select(F.col("paper_id").alias("id"), "title")
    return rs.repair_by_title(bad, works)


@query("match_versions", with_ctes(PAPERS_SQL) + """
, e AS (SELECT regexp_extract(paper_id, '^(\\d{4}\\.\\d{4,5})', 1) AS base, 'v' || CAST(1 + doc_id % 3 AS VARCHAR) AS v FROM papers WHERE doc_id % 5 <> 0 AND regexp_matches(paper_id, '^\\d{4}\\.')),
q AS (SELECT DISTINCT regexp_extract(paper_id, '^(\\d{4}\\.\\d{4,5})', 1) AS base, CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE '' END AS v FROM papers WHERE regexp_matches(paper_id, '^\\d{4}\\.'))
SELECT q.base || q.v AS request_id, CASE WHEN e.base IS NULL THEN 'missing' WHEN q.v <> '' AND q.v <> e.v THEN 'version_mismatch' ELSE 'ok' END AS status,
  coalesce(CASE WHEN e.base IS NULL THEN NULL WHEN q.v = '' THEN e.base || e.v WHEN q.v = e.v THEN q.base || q.v END, '-') AS arxiv_id
FROM q LEFT JOIN e ON q.base = e.base""")
def match_versions(spark, sf):
    p = papers(spark, sf)
    entries = p.filter(F.col("doc_id") % 5 != 0).select(
        F.concat("paper_id", F.lit("v"), (1 + F.col("doc_id") % 3).cast("string")).alias("entry_id"), F.col("doc_id").alias("pos"))
    requests = p.select(F.concat(F.lit("https://arxiv.org/abs/"), "paper_id", F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("")).alias("raw"))
    out = rs.match_versions(requests.unionByName(requests), entries.unionByName(
        entries.withColumn("pos", F.col("pos") + 10**9).withColumn("entry_id", F.regexp_replace("entry_id", r"v\d+$", "v9"))))
    return out.withColumn("arxiv_id", F.coalesce("arxiv_id", F.lit("-")))


@query("apply_metadata", with_ctes(PAPERS_SQL) + """
SELECT paper_id, CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN 'T ' || title ELSE 'old ' || paper_id END AS title, CASE WHEN quality IS NOT NULL THEN date ELSE '' END AS published,
  CASE WHEN quality IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'missing' ELSE 'complete' END AS metadata_status
FROM papers LEFT JOIN labels USING (doc_id)""")
def apply_metadata(spark, sf):
    p = papers(spark, sf)
    meta = p.join(table(spark, sf, "labels"), "doc_id").select(
        "paper_id", F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("T "), "title")).otherwise("").alias("title"),
        F.col("date").alias("published"), F.when(F.col("toxic") == 1, "").otherwise("complete").alias("metadata_status"))
    own = p.select("paper_id", F.concat(F.lit("old "), "paper_id").alias("title"), F.lit("").alias("published"),
                   F.lit("unknown").alias("metadata_status"))
    return rs.overlay_metadata(own, meta, ("title", "published"))
