"""Search, ranking and recall queries: benchmark passages against documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions.stem import with_stem
from sparkfolio.operators import recall as rc, search as se
from sparkfolio.plans.bindings import (
    GOLD_SQL, PAPERS_SQL, QUERIES_SQL, gold, norm_sql, paper_id, papers, search_queries, with_ctes,
)
from sparkfolio.plans.registry import query, table
from sparkfolio.plans.stem_sql import stems_sql
from sparkfolio.session import work_dir

_STOP = ", ".join(f"'{w}'" for w in se.QUERY_STOPWORDS)
QTERMS_SQL = f"""qterms AS (
  SELECT query_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM (
    SELECT query_id, list_filter(list_transform(list_sort(list_transform(list_distinct(ts), lambda t: lpad(CAST(list_position(ts, t) AS VARCHAR), 6, '0') || t)), lambda x: substring(x, 7)),
           lambda t: t NOT IN ({_STOP})) AS terms
    FROM (SELECT query_id, regexp_extract_all(lower(query), '([\\p{{L}}\\p{{N}}]+)', 1) AS ts FROM queries)))"""
QIDX_SQL = """qidx AS (
  SELECT query_id, term, weight, count(*) OVER (PARTITION BY query_id) AS n_terms
  FROM (SELECT query_id, strip_accents(term) AS term, count(*) AS weight FROM qterms GROUP BY ALL))"""
_TOK = "regexp_extract_all(strip_accents(lower({x})), '([\\p{{L}}\\p{{N}}]+)', 1)"
POST_SQL = f"""toks AS (
  SELECT paper_id, {_TOK.format(x='title')} AS t, {_TOK.format(x='abstract')} AS a FROM papers),
stats AS (SELECT paper_id, len(t) + len(a) AS length FROM toks),
post AS (
  SELECT paper_id, length, term, sum(f) AS tf_title, sum(1 - f) AS tf_abstract FROM (
    SELECT paper_id, len(t) + len(a) AS length, unnest(t) AS term, 1 AS f FROM toks UNION ALL
    SELECT paper_id, len(t) + len(a), unnest(a), 0 FROM toks) GROUP BY ALL)"""
HITS_SQL = """corpus AS (SELECT count(*) AS n_docs, avg(length) AS avgdl FROM stats),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (
  SELECT q.query_id, p.paper_id, q.n_terms, count(*) AS matched,
         sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * weight * (10.0 * tf_title + tf_abstract) * 2.2
             / ((10.0 * tf_title + tf_abstract) + 1.2 * (0.25 + 0.75 * length / avgdl))) AS s
  FROM qidx q JOIN post p USING (term) JOIN dfs USING (term) CROSS JOIN corpus GROUP BY ALL)"""
RANKED_SQL = """ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN matched = n_terms THEN 0 ELSE 1 END, round(s, 9) DESC, paper_id) AS rank,
         paper_id, round(s, 4) AS score, CAST(CASE WHEN matched = n_terms THEN 0 ELSE 1 END AS BIGINT) AS tier FROM hits WHERE regexp_matches(paper_id, '^[0-9]{4}\\.'))"""
SEARCH = with_ctes(PAPERS_SQL, QUERIES_SQL, QTERMS_SQL, QIDX_SQL, POST_SQL, HITS_SQL)
FULL = with_ctes(PAPERS_SQL, QUERIES_SQL, QTERMS_SQL, QIDX_SQL, POST_SQL, HITS_SQL, RANKED_SQL, GOLD_SQL)


@query("tokenize_index", with_ctes(PAPERS_SQL, POST_SQL) + """
SELECT paper_id, term, CAST(tf_title AS BIGINT) AS tf_title, CAST(tf_abstract AS BIGINT) AS tf_abstract FROM post""")
def tokenize_index(spark, sf):
    return se.postings(papers(spark, sf)).select("paper_id", "term", "tf_title", "tf_abstract")


@query("query_terms", with_ctes(QUERIES_SQL, QTERMS_SQL) + "SELECT query_id, CAST(pos AS BIGINT) AS pos, term FROM qterms")
def query_terms(spark, sf):
    return se.query_terms(search_queries(spark, sf), None)


@query("index_stats", with_ctes(PAPERS_SQL, POST_SQL) + """
SELECT 'df:' || term AS key, CAST(count(*) AS DOUBLE) AS value FROM post GROUP BY term
UNION ALL SELECT 'len:' || paper_id, CAST(length AS DOUBLE) FROM stats
UNION ALL SELECT 'avg', round(avg(length), 4) FROM stats""")
def index_stats(spark, sf):
    p = papers(spark, sf)
    stats = se.doc_stats(p)
    df = se.term_stats(se.postings(p)).select(F.concat(F.lit("df:"), "term").alias("key"), F.col("df").cast("double").alias("value"))
    ln = stats.select(F.concat(F.lit("len:"), "paper_id").alias("key"), F.col("length").cast("double").alias("value"))
    avg = se.corpus_stats(stats).select(F.lit("avg").alias("key"), F.round("avg_length", 4).alias("value"))
    return df.unionByName(ln).unionByName(avg)


@query("bm25_score", SEARCH + "SELECT query_id, paper_id, matched, round(s, 4) AS score FROM hits")
def bm25_score(spark, sf):
    p = papers(spark, sf)
    hits = se.bm25_hits(se.index_query_terms(search_queries(spark, sf), max_terms=None), se.postings(p), se.corpus_stats(se.doc_stats(p)))
    return hits.select("query_id", "paper_id", "matched", "score")


@query("bm25_topk", SEARCH + """
SELECT query_id, rank, paper_id, score FROM (
  SELECT query_id, paper_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, paper_id) AS rank
  FROM hits JOIN papers USING (paper_id) WHERE date <= '2024-10-31' AND regexp_matches(paper_id, '^[0-9]{4}\\.')) WHERE rank <= 10""")
def bm25_topk(spark, sf):
    from sparkfolio.operators.filters import date_before, modern_ids

    p = papers(spark, sf)
    allowed = p.filter(date_before(F.col("date"), "2024-10-31") & modern_ids(F.col("paper_id")))
    hits = se.bm25_hits(se.index_query_terms(search_queries(spark, sf), max_terms=None), se.postings(p), se.corpus_stats(se.doc_stats(p)))
    return se.bm25_topk(hits, 10, allowed)


@query("search_and_or", FULL + "SELECT query_id, rank, paper_id, score, tier FROM ranked WHERE rank <= 5")
def search_and_or(spark, sf):
    return se.search_papers(search_queries(spark, sf), papers(spark, sf), 5, stem=False, max_terms=None)


@query("search_stored", FULL + "SELECT query_id, rank, paper_id, score, tier FROM ranked WHERE rank <= 5")
def search_stored(spark, sf):
    path = work_dir(spark) + "/index"
    se.write_index(papers(spark, sf), path, stem=False)
    return se.search_index(spark, path, search_queries(spark, sf), 5, stem=False, max_terms=None)


STEMS_SQL = stems_sql("SELECT term FROM post0 UNION SELECT term FROM qidx0") + """,
qidx AS (SELECT query_id, stem AS term, sum(weight) AS weight, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qidx0 JOIN stems USING (term) GROUP BY query_id, stem),
post AS (SELECT paper_id, length, stem AS term, sum(tf_title) AS tf_title, sum(tf_abstract) AS tf_abstract FROM post0 JOIN stems USING (term) GROUP BY paper_id, length, stem)"""
STEMMED = with_ctes(PAPERS_SQL, QUERIES_SQL, QTERMS_SQL, QIDX_SQL.replace("qidx AS", "qidx0 AS"), POST_SQL.replace("post AS", "post0 AS"), STEMS_SQL, HITS_SQL, RANKED_SQL)


@query("stem_words", with_ctes(PAPERS_SQL, POST_SQL, stems_sql("SELECT DISTINCT term FROM post")) + "SELECT term, stem FROM stems")
def stem_words(spark, sf):
    return with_stem(se.postings(papers(spark, sf)).select("term").distinct()).select("term", "stem")


@query("search_stemmed", STEMMED + "SELECT query_id, rank, paper_id, score, tier FROM ranked WHERE rank <= 5")
def search_stemmed(spark, sf):
    return se.search_papers(search_queries(spark, sf), papers(spark, sf), 5, stem=True, max_terms=None)


@query("phrase_title", with_ctes(PAPERS_SQL) + f"""
SELECT a.paper_id AS query_id, b.paper_id FROM (SELECT paper_id, {norm_sql('title')} AS n FROM papers WHERE doc_id % 5 = 0) a
JOIN (SELECT paper_id, {norm_sql('title')} AS n FROM papers) b USING (n) WHERE n <> ''""")
def phrase_title(spark, sf):
    p = papers(spark, sf)
    asked = p.filter(F.col("doc_id") % 5 == 0).select(F.col("paper_id").alias("query_id"), F.concat(F.lit("- "), "title", F.lit(" !")).alias("query"))
    return se.exact_title(p, asked)


@query("merge_hits", FULL + """,
prim AS (SELECT query_id, paper_id, rank FROM ranked WHERE rank <= 3),
sec AS (SELECT query_id, paper_id, rank FROM ranked WHERE rank BETWEEN 2 AND 8)
SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY side, rank, paper_id) AS rank FROM (
  SELECT query_id, paper_id, 0 AS side, rank FROM prim UNION ALL
  SELECT query_id, paper_id, 1, rank FROM sec WHERE (query_id, paper_id) NOT IN (SELECT (query_id, paper_id) FROM prim))""")
def merge_hits(spark, sf):
    r = se.search_papers(search_queries(spark, sf), papers(spark, sf), 8, stem=False, max_terms=None)
    return se.merge_ranked(r.filter("rank <= 3"), r.filter("rank >= 2"))


@query("self_exclude", FULL + """
SELECT query_id, paper_id, rank FROM ranked WHERE rank <= 5 AND NOT (query_id = CAST(right(paper_id, 5) AS BIGINT))""")
def self_exclude(spark, sf):
    q = search_queries(spark, sf)
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), paper_id(F.col("doc_id")).alias("paper_id"))
    r = se.search_papers(q, papers(spark, sf), 5, stem=False, max_terms=None).select("query_id", "paper_id", "rank")
    return rc.drop_self(r, own)


_DUP_SQL = """dup AS (SELECT query_id, paper_id, rank FROM ranked WHERE rank <= 6 UNION ALL SELECT query_id, paper_id, rank + 3 FROM ranked WHERE rank <= 6),
uniq AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY r, paper_id) AS rank FROM (
  SELECT query_id, paper_id, min(rank) AS r FROM dup GROUP BY ALL))"""


def _duplicated(spark, sf):
    r = se.search_papers(search_queries(spark, sf), papers(spark, sf), 6, stem=False, max_terms=None).select("query_id", "paper_id", "rank")
    return r.unionByName(r.withColumn("rank", F.col("rank") + 3))


@query("rank_dedupe", FULL + "," + _DUP_SQL + " SELECT query_id, rank, paper_id FROM uniq")
def rank_dedupe(spark, sf):
    return rc.unique_ranking(_duplicated(spark, sf))


_METRICS_SQL = """m AS (
  SELECT q.query_id, coalesce(g.n, 0) AS n_gold, coalesce(l.n, 0) AS n_results,
    CASE WHEN g.n > 0 THEN coalesce(h.h1, 0) / g.n ELSE CAST(0 AS DOUBLE) END AS recall_1,
    CASE WHEN g.n > 0 THEN coalesce(h.h5, 0) / g.n ELSE CAST(0 AS DOUBLE) END AS recall_5,
    CASE WHEN g.n > 0 THEN coalesce(h.h10, 0) / g.n ELSE CAST(0 AS DOUBLE) END AS recall_10,
    coalesce(h.h5, 0) / 5 AS precision_5, CASE WHEN h.h5 > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hit_rate_5, coalesce(1 / h.f, CAST(0 AS DOUBLE)) AS mrr
  FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM {rank} GROUP BY 1) l USING (query_id)
  LEFT JOIN (SELECT query_id, min(rank) AS f, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5,
             count(*) FILTER (rank <= 10) AS h10 FROM {rank} JOIN gold USING (query_id, paper_id) GROUP BY 1) h USING (query_id))"""


@query("query_metrics", FULL + "," + _DUP_SQL + "," + _METRICS_SQL.format(rank="uniq") + """
SELECT query_id, n_gold, n_results, round(recall_1, 4) AS recall_1, round(recall_5, 4) AS recall_5, round(recall_10, 4) AS recall_10,
       round(precision_5, 4) AS precision_5, hit_rate_5, round(mrr, 4) AS mrr FROM m""")
def query_metrics(spark, sf):
    m = rc.query_metrics(rc.unique_ranking(_duplicated(spark, sf)), gold(spark, sf), search_queries(spark, sf), [1, 10])
    r4 = lambda c: F.round(c, 4).alias(c)
    return m.select("query_id", "n_gold", "n_results", r4("recall_1"), r4("recall_5"), r4("recall_10"), r4("precision_5"),
                    "hit_rate_5", r4("mrr"))


def _timing(spark, sf):
    return search_queries(spark, sf).select(
        "query_id", ((F.col("query_id") * 37) % 101 / 100).alias("latency"), (F.col("query_id") % 9 == 0).alias("failed"))


_TOP10 = "top10 AS (SELECT query_id, paper_id, rank FROM ranked WHERE rank <= 10)"


@query("recall_summary", FULL + "," + _TOP10 + "," + _METRICS_SQL.format(rank="top10") + """
SELECT count(*) AS queries, max(n_results) AS longest, round(avg(recall_1), 4) AS recall_1, round(avg(recall_5), 4) AS recall_5,
  round(avg(recall_10), 4) AS recall_10, round(avg(precision_5), 4) AS precision_5, round(avg(hit_rate_5), 4) AS hit_rate_5,
  round(avg(mrr), 4) AS mrr, count(*) FILTER (query_id % 9 = 0) AS errors,
  round(quantile_cont((query_id * 37) % 101 / 100, 0.5) FILTER (query_id % 9 <> 0), 4) AS latency_p50,
  round(quantile_cont((query_id * 37) % 101 / 100, 0.9) FILTER (query_id % 9 <> 0), 4) AS latency_p90 FROM m""")
def recall_summary(spark, sf):
    q = search_queries(spark, sf)
    r = se.search_papers(q, papers(spark, sf), 10, stem=False, max_terms=None)
    out = rc.recall_summary(rc.query_metrics(r, gold(spark, sf), q, [1, 10]), _timing(spark, sf))
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_KEY_STOP = ", ".join(f"'{w}'" for w in se.KEYWORD_STOPWORDS)
KEYWORD_SQL = f"""kw AS (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '([a-z0-9]+)', 1)) AS word FROM queries),
kscore AS (
  SELECT query_id, paper_id, count(*) AS score FROM kw JOIN papers ON contains(lower(title), word)
  WHERE length(word) >= 3 AND word NOT IN ({_KEY_STOP}) GROUP BY ALL),
kranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank, paper_id, score FROM kscore)"""


@query("recall_baseline_rank", with_ctes(PAPERS_SQL, QUERIES_SQL, KEYWORD_SQL) + """
SELECT query_id, rank, paper_id, score FROM kranked WHERE rank <= 10""")
def recall_baseline_rank(spark, sf):
    return se.keyword_title_search(search_queries(spark, sf), papers(spark, sf), 10)


@query("recall_bench", FULL + "," + _TOP10 + "," + KEYWORD_SQL + ", ktop AS (SELECT query_id, paper_id, rank FROM kranked WHERE rank <= 10)," +
       _METRICS_SQL.format(rank="top10") + "," + _METRICS_SQL.format(rank="ktop").replace("m AS", "mk AS", 1) + """
SELECT system, count(*) AS queries, max(n_results) AS longest, round(avg(recall_1), 4) AS recall_1, round(avg(recall_5), 4) AS recall_5,
  round(avg(recall_10), 4) AS recall_10, round(avg(precision_5), 4) AS precision_5, round(avg(hit_rate_5), 4) AS hit_rate_5,
  round(avg(mrr), 4) AS mrr, count(*) FILTER (query_id % 9 = 0) AS errors
FROM (SELECT 'local_plain' AS system, * FROM m UNION ALL SELECT 'keyword', * FROM mk) GROUP BY system""")
def recall_bench(spark, sf):
    q, p = search_queries(spark, sf), papers(spark, sf)
    parts, times = [], []
    for name in ("local_plain", "keyword"):
        parts.append(se.SYSTEMS[name](q, p, 10, **({"max_terms": None} if name != "keyword" else {})).select(F.lit(name).alias("system"), "query_id", "rank", "paper_id"))
        times.append(_timing(spark, sf).withColumn("system", F.lit(name)))
    own = q.select("query_id", F.lit("none").alias("paper_id"))
    out = rc.recall_bench(parts[0].unionByName(parts[1]), gold(spark, sf), q, own, times[0].unionByName(times[1]), [1, 10])
    return out.drop("latency_p50", "latency_p90").select(
        *[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.drop("latency_p50", "latency_p90").dtypes])


@query("title_rerank", """
SELECT p_partkey AS item, p_name AS title, CAST(
  CASE WHEN contains(p_name, 'red-widget') THEN 5 ELSE 0 END + CASE WHEN contains(replace(p_name, '-', ' '), 'red widget') THEN 2 ELSE 0 END +
  CASE WHEN contains(p_name, 'small-ring') THEN 5 ELSE 0 END + CASE WHEN contains(replace(p_name, '-', ' '), 'small ring') THEN 2 ELSE 0 END AS BIGINT) AS title_score
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS p_name FROM part)""")
def title_rerank(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    hits = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"), name.alias("title"), F.lit("a Red-Widget or Small-Ring").alias("query"))
    return se.title_rerank(hits).select("item", "title", "title_score")
