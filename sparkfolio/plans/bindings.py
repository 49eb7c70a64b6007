"""Engine tables built from the driver tables, in Spark and (for the checks) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkfolio.functions.text import squeeze
from sparkfolio.plans.registry import table


# --- SQL fragments -----------------------------------------------------------

def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return (
        f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '\\\\[a-zA-Z]+\\*?', ' ', 'g')),"
        " '[^a-z0-9]+', ' ', 'g'))"
    )


PID_SQL = (
    "CASE WHEN {d} % 50 = 0 THEN 'hep-th/' || lpad(CAST({d} AS VARCHAR), 7, '0') "
    "ELSE lpad(CAST(2401 + {d} // 100000 AS VARCHAR), 4, '0') || '.' || lpad(CAST({d} % 100000 AS VARCHAR), 5, '0') END"
)
PAPERS_SQL = f"""papers AS (
  SELECT doc_id, {PID_SQL.format(d='doc_id')} AS paper_id,
         array_to_string(list_slice(w, 1, 8), ' ') AS title,
         concat_ws(' ', w[1], w[2]) || ', ' || concat_ws(' ', w[3], w[4]) || ' and ' || coalesce(w[5], '') || ' (' || source || ')' AS authors,
         t AS abstract, lang || ' ' || source AS categories, lang AS primary_category,
         strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date,
         CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || CAST(doc_id AS VARCHAR) END AS doi
  FROM (SELECT *, string_split(t, ' ') AS w FROM (SELECT *, {sq('text')} AS t FROM documents)))"""


def paper_id(doc_id: Column) -> Column:
    old = F.concat(F.lit("hep-th/"), F.lpad(doc_id.cast("string"), 7, "0"))
    prefix = F.lpad((F.lit(2401) + F.floor(doc_id / 100000)).cast("string"), 4, "0")
    new = F.concat(prefix, F.lit("."), F.lpad((doc_id % 100000).cast("string"), 5, "0"))
    return F.when(doc_id % 50 == 0, old).otherwise(new)


def raw_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata rows as the snapshot has them (text not cleaned, date as timestamp)."""
    docs = table(spark, sf, "documents")
    # Only the first eight words are read for title and authors, not the whole text.
    head = F.regexp_extract("text", r"^\s*((?:\S+\s+){0,7}\S*)", 1)
    docs = docs.withColumn("head", F.split(squeeze(head), " "))
    w = F.col("head")
    part = lambda i: F.get(w, i)
    return docs.select(
        "doc_id",
        paper_id(F.col("doc_id")).alias("paper_id"),
        F.array_join(F.slice(w, 1, 8), " ").alias("title"),
        F.concat(
            F.concat_ws(" ", part(0), part(1)), F.lit(", "), F.concat_ws(" ", part(2), part(3)),
            F.lit(" and "), F.coalesce(part(4), F.lit("")), F.lit(" ("), "source", F.lit(")"),
        ).alias("authors"),
        F.col("text").alias("abstract"),
        F.concat_ws(" ", "lang", "source").alias("categories"),
        F.col("lang").alias("primary_category"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp_ntz").alias(
            "first_version_date"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string"))).alias("doi"),
    )


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned metadata rows (schema M1 plus ``doc_id``; ``date`` is text)."""
    from sparkfolio.sources.papers import clean_papers

    return clean_papers(raw_papers(spark, sf))


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): the benchmark passages."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), squeeze(F.col("text")).alias("query"))


QUERIES_SQL = f"""queries AS (
  SELECT item_id AS query_id, {sq('text')} AS query FROM benchmark)"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, paper_id): documents whose squeezed text holds the whole passage.

    Each passage (they have 14 words and more) gives its words 2-5 as a key, since only
    edge words may be cut out of a longer document word; passages and documents meet
    on that key, carrying ids only; the texts of the few candidates are fetched to verify them.
    """
    passages = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), squeeze(F.col("text")).alias("passage"))
    grams = F.regexp_extract_all("text", F.lit(r"(?:^| )(?=(\S+ \S+ \S+ \S+))"), F.lit(1))
    pw = F.split(F.col("passage"), " ")
    keyed = passages.withColumn("gram", F.array_join(F.slice(pw, 2, 4), " "))
    docs = table(spark, sf, "documents").select(
        paper_id(F.col("doc_id")).alias("paper_id"), squeeze(F.col("text")).alias("text"))
    near = docs.select("paper_id", F.explode(F.array_distinct(grams)).alias("gram")).join(
        keyed.select("query_id", "gram"), "gram").select("paper_id", "query_id").distinct()
    found = docs.join(near, "paper_id").join(passages, "query_id")
    return found.filter(F.col("text").contains(F.col("passage"))).select("query_id", "paper_id").distinct()


GOLD_SQL = f"""gold AS (
  SELECT b.item_id AS query_id, {PID_SQL.format(d='d.doc_id')} AS paper_id
  FROM benchmark b JOIN documents d ON contains({sq('d.text')}, {sq('b.text')}))"""


def refs(spark: SparkSession, sf: str) -> DataFrame:
    """Reference rows: four kinds by ``doc_id % 4`` (id, arXiv DOI, DOI, title of the next document).

    Every document is one source paper with one reference; ``set_id`` groups sources by 20.
    """
    p = papers(spark, sf).select("doc_id", "paper_id", "title", "date")
    following = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("next_title"),
                         F.col("paper_id").alias("next_id"))
    kind = F.col("doc_id") % 4
    target = F.col("doc_id") * 7 % 1000
    return p.join(following, "doc_id", "left").select(
        "paper_id", F.lit(1).cast("long").alias("ref_index"),
        F.when(kind == 0, F.concat(F.lit("arXiv:"), F.coalesce("next_id", F.lit("")), F.lit("v2"))).alias("arxiv_id"),
        F.when(kind == 1, F.concat(F.lit("https://doi.org/10.48550/arXiv."), F.coalesce("next_id", F.lit(""))))
        .when(kind == 2, F.concat(F.lit("doi:10.1000/"), target.cast("string"), F.lit("."))).alias("doi"),
        F.when(kind >= 2, F.coalesce("next_title", F.lit(""))).otherwise(F.lit("")).alias("title"),
        F.col("date").alias("source_date"), "doc_id",
    )


REFS_SQL = """refs AS (
  SELECT p.paper_id, CAST(1 AS BIGINT) AS ref_index,
         CASE WHEN p.doc_id % 4 = 0 THEN 'arXiv:' || coalesce(n.paper_id, '') || 'v2' END AS arxiv_id,
         CASE WHEN p.doc_id % 4 = 1 THEN 'https://doi.org/10.48550/arXiv.' || coalesce(n.paper_id, '')
              WHEN p.doc_id % 4 = 2 THEN 'doi:10.1000/' || CAST(p.doc_id * 7 % 1000 AS VARCHAR) || '.' END AS doi,
         CASE WHEN p.doc_id % 4 >= 2 THEN coalesce(n.title, '') ELSE '' END AS title,
         p.date AS source_date, p.doc_id
  FROM papers p LEFT JOIN papers n ON n.doc_id = p.doc_id + 1)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (source, target): a customer cites every part it ordered."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target")).distinct()


EDGES_SQL = """edges AS (
  SELECT DISTINCT o_custkey AS source, l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Run-event rows: run = user, block column ``ts`` kept for ordering."""
    ev = table(spark, sf, "events")
    return ev.select(
        F.col("user_id").alias("run_id"), "event_id", "ts", "event_type", "value", "props",
        F.when(F.col("event_type") == "signup", "step.started")
        .when(F.col("event_type").isin("view", "click"), "step.updated")
        .when(F.col("event_type") == "purchase", "step.completed")
        .otherwise("run.failed").alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).withColumn("node", F.concat(F.lit("node_"), (F.col("k") % 5).cast("string")))


RUN_EVENTS_SQL = """run_events AS (
  SELECT user_id AS run_id, event_id, ts, event_type, value, props,
         CASE WHEN event_type = 'signup' THEN 'step.started' WHEN event_type IN ('view', 'click') THEN 'step.updated'
              WHEN event_type = 'purchase' THEN 'step.completed' ELSE 'run.failed' END AS type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'node_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS node
  FROM events)"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Call records: variant v0 = click, new = view; stage = user % 3; case = user."""
    ev = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    missing = F.col("event_id") % 17 == 0
    return ev.select(
        F.when(F.col("event_type") == "click", "v0").otherwise("new").alias("variant"),
        F.concat(F.lit("stage_"), (F.col("user_id") % 3).cast("string")).alias("stage"),
        F.col("user_id").alias("case_id"), "event_id", "ts",
        (F.col("event_id") % 11 != 0).alias("ok"),
        F.when(~missing, F.col("value")).alias("seconds"),
        F.when(~missing, F.get_json_object("props", "$.k").cast("long")).alias("output_tokens"),
        F.when(F.col("event_id") % 23 != 0, (F.col("event_id") % 500)).alias("input_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 70).alias("reasoning_tokens"),
    )


CALLS_SQL = """calls AS (
  SELECT CASE WHEN event_type = 'click' THEN 'v0' ELSE 'new' END AS variant, 'stage_' || CAST(user_id % 3 AS VARCHAR) AS stage,
         user_id AS case_id, event_id, ts, event_id % 11 <> 0 AS ok,
         CASE WHEN event_id % 17 <> 0 THEN value END AS seconds,
         CASE WHEN event_id % 17 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS output_tokens,
         CASE WHEN event_id % 23 <> 0 THEN event_id % 500 END AS input_tokens,
         CASE WHEN event_id % 2 = 0 THEN event_id % 70 END AS reasoning_tokens
  FROM events WHERE event_type IN ('click', 'view'))"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
