"""Ranked full-text search for a table of queries over a table of papers.

The index is a postings table: one row per (paper, term) with the term counts of
both fields and the paper's token count.  A paper's terms are counted (and stemmed)
where its row lies, without an exchange of tokens; only papers that share an id are
grouped.  An ad-hoc search shuffles only the rows of its own terms.

A frequent term is no single group anywhere: postings join the query-term side, which
Spark broadcasts when it is small and else splits at the skewed term, and scores are
summed per (query, paper), in tasks of a bounded number of such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sparkfolio.functions.stem import kept_stem, with_stem
from sparkfolio.functions.text import fold_accents, index_tokens, normalize_title
from sparkfolio.operators.filters import modern_ids

# Field weights, ranking constants, limits and the query stop list.
TITLE_WEIGHT, ABSTRACT_WEIGHT = 10.0, 1.0
K1, B = 1.2, 0.75
MIN_IDF = 1e-6
MAX_QUERY_TERMS = 24
MAX_RESULTS = 1000
QUERY_STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "for", "to", "and", "or", "not", "with",
    "by", "at", "from", "as", "about", "is", "are", "be", "using", "via",
)
KEYWORD_STOPWORDS = ("the", "and", "for", "with", "from", "into", "using", "based", "via", "its", "are", "that")
INDEX_BUCKETS = 256

# Query terms up to this number are sent to every task.
FEW_TERMS = 200_000
# (query, paper) rows that one task should sum.
TASK_HITS = 250_000
# Papers that one numpy step counts.
STEP_PAPERS = 500


def query_terms(queries: DataFrame, max_terms: int | None = MAX_QUERY_TERMS) -> DataFrame:
    """(query_id, pos, term): distinct content words of each query, the first ``max_terms`` or all (None)."""
    raw = F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    kept = F.filter(F.array_distinct(raw), lambda t: ~t.isin(*QUERY_STOPWORDS))
    return queries.select("query_id", F.posexplode(kept if max_terms is None else F.slice(kept, 1, max_terms)).alias("pos", "term")).withColumn(
        "pos", F.col("pos").cast("long"))


def index_query_terms(queries: DataFrame, stem: bool = False, max_terms: int | None = MAX_QUERY_TERMS) -> DataFrame:
    """(query_id, term, weight, n_terms) in index form; words that fold together add up."""
    terms = query_terms(queries, max_terms).withColumn("term", fold_accents(F.col("term")))
    if stem:
        terms = with_stem(terms).drop("term").withColumnRenamed("stem", "term")
    # The window holds the distinct terms of one query.
    per_query = Window.partitionBy("query_id")
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight")).withColumn(
        "n_terms", F.count(F.lit(1)).over(per_query))


def postings(papers: DataFrame, key: str = "paper_id", stem: bool = False) -> DataFrame:
    """(paper_id, term, tf_title, tf_abstract, length) of every paper."""
    title, abstract = index_tokens(F.col("title")), index_tokens(F.col("abstract"))
    rows = papers.select(F.col(key).alias("paper_id"), title.alias("t"), abstract.alias("a")).filter(
        "t IS NOT NULL AND a IS NOT NULL")
    number = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([rows.schema["paper_id"], number("length"), T.StructField("term", T.StringType()),
                           number("tf_title"), number("tf_abstract")])
    index = rows.mapInArrow(_counted(stem), schema)
    if papers.groupBy(key).count().filter("count > 1").limit(1).count():
        # Rows of one id and length are one paper.
        index = index.groupBy("paper_id", "length", "term").agg(
            F.sum("tf_title").alias("tf_title"), F.sum("tf_abstract").alias("tf_abstract"))
    return index


def _counted(stem: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Term counts of rows (paper_id, t, a), each row for itself."""
    def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        return pc.list_value_length(column).to_numpy().astype(np.int64), column.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, STEP_PAPERS):
                batch = whole.slice(k, STEP_PAPERS)
                (n_t, title), (n_a, abstract) = lists(batch.column("t")), lists(batch.column("a"))
                tokens = pa.concat_arrays([title, abstract]).dictionary_encode()
                words = tokens.dictionary
                code = tokens.indices.to_numpy().astype(np.int64)
                if stem:
                    stems = pa.array([kept_stem(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
                    words, code = stems.dictionary, stems.indices.to_numpy().astype(np.int64)[code]
                paper = np.concatenate([np.repeat(np.arange(len(n)), n) for n in (n_t, n_a)])
                found, at, count = np.unique(paper * max(1, len(words)) + code, return_inverse=True, return_counts=True)
                in_title = np.bincount(at[: len(title)], minlength=len(found))
                row, term = found // max(1, len(words)), found % max(1, len(words))
                yield pa.RecordBatch.from_arrays([
                    batch.column("paper_id").take(pa.array(row)), pa.array((n_t + n_a)[row]), words.take(pa.array(term)),
                    pa.array(in_title), pa.array(count - in_title)], ["paper_id", "length", "term", "tf_title", "tf_abstract"])

    return run


def doc_stats(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """(paper_id, length) of every paper, papers without tokens included."""
    count = lambda c: F.regexp_count(fold_accents(F.col(c)), F.lit(r"[\p{L}\p{N}]+"))
    length = count("title") + count("abstract")
    return papers.select(F.col(key).alias("paper_id"), length.cast("long").alias("length"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of papers, average length."""
    return stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df): papers that hold the term.

    The count names both term counts (never NULL) so that it reads the same columns as
    the scoring branch and Spark reuses one shuffle of the postings for both.
    """
    return index.groupBy("term").agg(F.count(F.col("tf_title") + F.col("tf_abstract")).alias("df"))


def bm25_hits(terms: DataFrame, index: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, paper_id, n_terms, matched, score): every paper with any query term."""
    asked = index.join(terms.select("term").distinct(), "term", "left_semi")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    weighted = terms.join(term_stats(asked), "term").withColumn(
        "n_docs", corpus.select("n_docs").scalar()).withColumn("idf", idf * F.col("weight")).select(
        "query_id", "term", "n_terms", "idf")
    freq = F.col("tf_title") * TITLE_WEIGHT + F.col("tf_abstract") * ABSTRACT_WEIGHT
    norm = K1 * (1 - B + B * F.col("length") / corpus.select("avg_length").scalar())
    part = F.col("idf") * freq * (K1 + 1) / (freq + norm)
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        # All terms of a paper stand in one task, where its scores are summed: no exchange of (query, paper) rows.
        # There are as many tasks as these rows need, so that what a task holds does not grow with the papers.
        n_hits = terms.select("query_id").distinct().count() * (corpus.select("n_docs").first() or [0])[0]
        asked, weighted = asked.repartition(max(1, -(-n_hits // TASK_HITS)), "paper_id"), F.broadcast(weighted)
    return (
        asked.join(weighted, "term")
        .groupBy("query_id", "paper_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("matched"), F.sum(part).alias("raw_score"))
        .withColumn("score", F.round("raw_score", 4))
    )


def _rank(hits: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, min(k, MAX_RESULTS))).withColumn(
        "rank", F.col("rank").cast("long"))


def bm25_topk(hits: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Best ``k`` papers per query by score; ``allowed`` (paper_id) keeps filtered papers only."""
    if allowed is not None:
        hits = hits.join(allowed.select("paper_id"), "paper_id", "left_semi")
    return _rank(hits, [F.round("raw_score", 9).desc(), F.col("paper_id")], k).select(
        "query_id", "rank", "paper_id", "score")


def search(queries: DataFrame, index: DataFrame, corpus: DataFrame, k: int = 5, allowed: DataFrame | None = None,
           stem: bool = False, max_terms: int | None = MAX_QUERY_TERMS, legacy_ids: bool = False) -> DataFrame:
    """Papers with all terms first, papers with any term fill the list up to ``k``.  Papers with
    an id of the old kind are left out unless ``legacy_ids``."""
    hits = bm25_hits(index_query_terms(queries, stem, max_terms), index, corpus)
    if not legacy_ids:
        hits = hits.filter(modern_ids(F.col("paper_id")))
    if allowed is not None:
        hits = hits.join(allowed.select("paper_id"), "paper_id", "left_semi")
    hits = hits.withColumn("tier", F.when(F.col("matched") == F.col("n_terms"), 0).otherwise(1).cast("long"))
    order = [F.col("tier"), F.round("raw_score", 9).desc(), F.col("paper_id")]
    return _rank(hits, order, k).select("query_id", "rank", "paper_id", "score", "tier")


def search_papers(queries: DataFrame, papers: DataFrame, k: int = 5, stem: bool = True, **options) -> DataFrame:
    """Search without a stored index."""
    return search(queries, postings(papers, stem=stem), corpus_stats(doc_stats(papers)), k, stem=stem, **options)


def write_index(papers: DataFrame, path: str, stem: bool = True) -> None:
    """Store postings by term bucket, and the paper lengths; rerun replaces both."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int")
    rows = postings(papers, stem=stem).withColumn("bucket", bucket)
    spread = F.pmod(F.xxhash64("paper_id"), F.lit(16))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{path}/postings")
    doc_stats(papers).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, stem: bool = True, **options) -> DataFrame:
    """Search a stored index; only the buckets of the asked terms are read."""
    buckets = index_query_terms(queries, stem, options.get("max_terms", MAX_QUERY_TERMS)).select(
        F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int").alias("bucket")).distinct()
    index = spark.read.parquet(f"{path}/postings").join(buckets, "bucket", "left_semi").drop("bucket")
    return search(queries, index, corpus_stats(spark.read.parquet(f"{path}/stats")), k, stem=stem, **options)


def exact_title(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, paper_id): papers whose normalized title equals the normalized query."""
    titles = papers.select("paper_id", normalize_title(F.col("title")).alias("norm")).filter(F.col("norm") != "")
    asked = queries.select("query_id", normalize_title(F.col("query")).alias("norm")).filter(F.col("norm") != "")
    return asked.join(titles, "norm").select("query_id", "paper_id")


def merge_ranked(primary: DataFrame, secondary: DataFrame, group: str = "query_id", key: str = "paper_id") -> DataFrame:
    """All primary rows in order, then secondary rows with a new key.  Input: (group, rank, key)."""
    second = secondary.groupBy(group, key).agg(F.min("rank").alias("rank")).join(
        primary.select(group, key), [group, key], "left_anti")
    both = primary.select(group, key, F.lit(0).alias("side"), "rank").unionByName(
        second.select(group, key, F.lit(1).alias("side"), "rank"))
    w = Window.partitionBy(group).orderBy("side", "rank", key)
    return both.select(group, key, F.row_number().over(w).cast("long").alias("rank"))


def title_rerank(hits: DataFrame) -> DataFrame:
    """Reorder (group, rank, item, title, query) by hyphenated query terms found in the title."""
    q, t = F.lower("query"), F.lower("title")
    terms = F.regexp_extract_all(q, F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)+)"), F.lit(1))
    loose = F.replace(t, F.lit("-"), F.lit(" "))
    points = F.transform(terms, lambda x: F.when(t.contains(x), 5).otherwise(0) + F.when(
        (F.length(x) > 3) & loose.contains(F.replace(x, F.lit("-"), F.lit(" "))), 2).otherwise(0))
    score = F.aggregate(points, F.lit(0), lambda acc, x: acc + x)
    return hits.withColumn("title_score", score.cast("long"))


def keyword_title_search(queries: DataFrame, papers: DataFrame, k: int) -> DataFrame:
    """Rank titles by how many distinct query words occur in them as substrings.

    A query word lies inside one alphanumeric run of the title, so words are matched
    against the distinct runs of all titles (they meet on the word's first trigram)
    and the matching runs lead back to the titles.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("([a-z0-9]+)"), F.lit(1)))
    asked = queries.select("query_id", F.explode(words).alias("word")).filter(
        (F.length("word") >= 3) & ~F.col("word").isin(*KEYWORD_STOPWORDS))
    runs = papers.select("paper_id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("title"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("run")).filter(F.length("run") >= 3)
    vocab = runs.select("run").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda i: F.substring(F.col("run"), i, F.lit(3)))
    by_gram = vocab.select("run", F.explode(F.array_distinct(grams)).alias("gram"))
    matches = asked.select("word", F.substring("word", 1, 3).alias("gram")).distinct().join(by_gram, "gram").filter(
        F.col("run").contains(F.col("word"))).select("word", "run")
    scored = asked.join(matches, "word").join(runs, "run").select("query_id", "paper_id", "word").distinct().groupBy(
        "query_id", "paper_id").agg(F.count(F.lit(1)).alias("score"))
    return _rank(scored, [F.col("score").desc(), F.col("paper_id")], k).select("query_id", "rank", "paper_id", "score")


# Ranking systems are plain functions (queries, papers, k) -> (query_id, rank, paper_id, ...).
SYSTEMS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "local_fts": lambda queries, papers, k, **options: search_papers(queries, papers, k, stem=True, **options),
    "local_plain": lambda queries, papers, k, **options: search_papers(queries, papers, k, stem=False, **options),
    "keyword": keyword_title_search,
}


def register_system(name: str, system: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
    SYSTEMS[name] = system
