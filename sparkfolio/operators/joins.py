"""Joins of run artifacts: branch results, section fill, sources, run comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sparkfolio.functions.text import is_blank, strip
from sparkfolio.operators.ground import TARGET_SECONDS

REQUIRED = ("abstract", "methodology", "experiments")
FILLABLE = (*REQUIRED, "limitations")


def join_branches(papers: DataFrame, notes: DataFrame, enrich: DataFrame) -> DataFrame:
    """Branch results by paper; a paper without an entry keeps its own fields.

    Metadata maps merge key by key, the later branch wins.
    """
    n = notes.select("paper_id", F.col("notes").alias("n_notes"), F.col("quality").alias("n_quality"), F.col("meta").alias("n_meta"),
                     F.lit(True).alias("has_n"))
    e = enrich.select("paper_id", F.col("bibtex").alias("e_bibtex"), F.col("repos").alias("e_repos"), F.col("meta").alias("e_meta"),
                      F.lit(True).alias("has_e"))
    j = papers.join(n, "paper_id", "left").join(e, "paper_id", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.concat(*[F.map_entries(F.coalesce(m, empty)) for m in ("meta", "n_meta", "e_meta")])
    # The last entry of a key wins: keep an entry when no later one has its key.
    kept = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return j.select(
        "paper_id", F.when(F.col("has_n"), F.coalesce("n_notes", "notes")).otherwise(F.col("notes")).alias("notes"),
        F.when(F.col("has_n"), F.coalesce("n_quality", "quality")).otherwise(F.col("quality")).alias("quality"),
        F.when(F.col("has_e"), F.coalesce("e_bibtex", "bibtex")).otherwise(F.col("bibtex")).alias("bibtex"),
        F.when(F.col("has_e"), F.coalesce("e_repos", F.lit(0))).otherwise(F.col("repos")).alias("repos"),
        F.map_from_entries(kept).alias("meta"))


def fill_missing(first: DataFrame, second: DataFrame) -> DataFrame:
    """(paper_id, section, text, filled): the first source wins where it has text, else the second.

    Inputs: (paper_id, section, text).  Only fillable sections take text from the second.
    """
    a = first.select("paper_id", "section", F.col("text").alias("a"))
    b = second.filter(F.col("section").isin(*FILLABLE)).select("paper_id", "section", F.col("text").alias("b"))
    j = a.join(b, ["paper_id", "section"], "full")
    filled = is_blank(F.col("a")) & ~is_blank(F.col("b"))
    return j.select("paper_id", "section", F.when(filled, F.col("b")).otherwise(F.coalesce("a", F.lit(""))).alias("text"), filled.alias("filled"))


def fill_quality(merged: DataFrame, second_ok: DataFrame) -> DataFrame:
    """(paper_id, n_filled, missing, complete) after filling; filled text counts only from a clean second source."""
    per = merged.groupBy("paper_id").agg(
        F.count_if("filled").alias("n_filled"),
        *[F.max((F.col("section") == s) & ~is_blank(F.col("text"))).alias(f"_{s}") for s in REQUIRED])
    missing = F.array_compact(F.array(*[F.when(~F.col(f"_{s}"), s) for s in REQUIRED]))
    j = per.join(second_ok, "paper_id", "left")
    ok = (F.size(missing) == 0) & ((F.col("n_filled") == 0) | F.coalesce("parser_ok", F.lit(False)))
    return j.select("paper_id", "n_filled", F.array_join(missing, ",").alias("missing"), ok.alias("complete"))


def attach_sources(papers: DataFrame, sources: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Source fields win where a source row exists and has them."""
    s = sources.select("paper_id", *[F.col(f).alias(f"_s_{f}") for f in fields])
    return papers.join(s, "paper_id", "left").select(
        "paper_id", *[F.coalesce(F.col(f"_s_{f}"), F.col(f)).alias(f) for f in fields])


def write_sources(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """(paper_id, origin, text): cached extraction when present, else built from the paper row."""
    rows = papers.filter(F.coalesce("paper_id", F.lit("")) != "")
    c = cache.select("paper_id", F.col("text").alias("cached"))
    return rows.join(c, "paper_id", "left").select(
        "paper_id", F.when(F.col("cached").isNotNull(), "cache").otherwise("paper").alias("origin"),
        F.coalesce("cached", "text", F.lit("")).alias("text"))


def latency_nodes(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(run_id, node, cand_seconds, base_seconds): every node of either side.  Input: (run_id, node, seconds)."""
    total = lambda df, out: df.groupBy("run_id", "node").agg(F.sum("seconds").alias(out))
    j = total(base, "b").join(total(cand, "c"), ["run_id", "node"], "full")
    return j.select("run_id", "node", F.round(F.round(F.coalesce("c", F.lit(0.0)), 6), 1).alias("cand_seconds"),
                    F.round(F.round(F.coalesce("b", F.lit(0.0)), 6), 1).alias("base_seconds"))


def latency_totals(base: DataFrame, cand: DataFrame, target: float = TARGET_SECONDS) -> DataFrame:
    """(run_id, base, cand, speedup, longest_call, target_met).  Input: (run_id, seconds)."""
    b = base.groupBy("run_id").agg(F.sum("seconds").alias("base_total"))
    c = cand.groupBy("run_id").agg(F.sum("seconds").alias("cand_total"), F.max("seconds").alias("longest_call"))
    j = b.join(c, "run_id", "full")
    ct = F.coalesce("cand_total", F.lit(0.0))
    return j.select("run_id", F.coalesce("base_total", F.lit(0.0)).alias("base_total"), ct.alias("cand_total"),
                    F.when(ct != 0, F.coalesce("base_total", F.lit(0.0)) / ct).otherwise(0.0).alias("speedup"),
                    F.coalesce("longest_call", F.lit(0.0)).alias("longest_call"), ((ct > 0) & (ct <= target)).alias("target_met"))


def tiered_candidates(papers: DataFrame, repos: DataFrame, limit: int = 5) -> DataFrame:
    """(paper_id, rank, url, tier): repositories by id, title words, author and title words; URL once.

    ``papers``: (paper_id, arxiv_id, title, author); ``repos``: (url, name, description, stars).
    A query's words are looked up once, however many papers ask for them: they meet the repositories of their rarest
    word, the other words are verified, and the first ``limit`` go back to the papers.  A later tier is only used
    where the earlier ones gave too few.
    """
    from sparkfolio.operators.graph import topk

    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"(?U)[^\w.\-]", " ")), r"\s+"), lambda w: w != ""))
    words = F.slice(F.filter(F.split(strip(F.regexp_replace("title", r"(?U)[^\w\s-]", " ")), r"\s+"), lambda w: F.length(w) > 2), 1, 6)
    p = papers.withColumn("tw", F.transform(words, F.lower))
    last = F.lower(F.element_at(F.split(strip(F.col("author")), r"\s+"), -1))
    asked = p.select("paper_id", F.explode(F.array(
        F.struct(F.lit(1).alias("tier"), F.array(F.lower("arxiv_id")).alias("ws")),
        F.struct(F.lit(2).alias("tier"), F.col("tw").alias("ws")),
        F.struct(F.lit(3).alias("tier"), F.concat(F.array(last), F.slice("tw", 1, 3)).alias("ws")))).alias("q")).select(
        "paper_id", "q.tier", F.array_distinct(F.filter("q.ws", lambda w: w.isNotNull() & (w != ""))).alias("ws")).filter(F.size("ws") > 0)
    # A repeated paper asks once.
    asked = asked.distinct()
    have = repos.select("url", "stars", tokens(F.concat_ws(" ", "name", "description")).alias("have"))
    varies = F.coalesce(F.min("stars") != F.max("stars"), F.lit(False)) | F.count("stars").between(1, F.count(F.lit(1)) - 1)
    several = have.groupBy("url").agg(varies.alias("varies")).filter("varies").withColumnRenamed("url", "named")
    have = have.join(several, F.col("url").eqNullSafe(F.col("named")), "left").withColumn("varies", F.col("varies").isNotNull())
    by_word = have.withColumn("w", F.explode("have"))
    # A repository with all words of a query has its rarest one; a word that no repository has ends the query.
    counts = by_word.groupBy("w").agg(F.count(F.lit(1)).alias("uses"))
    rarest = asked.select("ws").distinct().withColumn("w", F.explode("ws")).join(counts, "w").groupBy("ws").agg(
        F.min_by("w", F.struct("uses", "w")).alias("w"), F.count(F.lit(1)).alias("known")).filter(F.col("known") == F.size("ws"))
    hit = rarest.join(by_word, "w").filter(F.size(F.array_except("ws", "have")) == 0)
    found = hit.groupBy("ws", "url").agg(F.max("stars").alias("stars"), F.first("varies").alias("varies"))
    # A repository with several counts may rise by what another tier finds, so it is never cut here.
    first = topk(found, ["ws"], [F.col("stars").desc(), F.col("url")], limit).filter(~F.col("varies")).drop("rank")
    kept = first.unionByName(found.filter("varies")).drop("varies")
    best = asked.join(kept, "ws").groupBy("paper_id", "url").agg(F.min("tier").alias("tier"), F.max("stars").alias("stars"))
    return topk(best, ["paper_id"], [F.col("tier"), F.col("stars").desc(), F.col("url")], limit).select("paper_id", "rank", "url", "tier")


def case_matrix(papers: DataFrame, stages: Sequence[str], variants: Sequence[str], n: int, unavailable: DataFrame) -> DataFrame:
    """(stage, case_id, run, variant, rep): every case, variant and repetition that is available.

    ``papers``: (run, paper_id).  The overview stage has one case per run.  Stages,
    variants and repetitions are short argument lists, so they are exploded, not joined.
    """
    per_paper = [s for s in stages if s != "overview"]
    cases = papers.select("run", F.concat_ws("_", "run", F.regexp_replace("paper_id", "^arxiv_", "")).alias("case_id"),
                          F.explode(F.array(*[F.lit(s) for s in per_paper])).alias("stage"))
    if "overview" in stages:
        cases = cases.unionByName(papers.select("run").distinct().select("run", F.col("run").alias("case_id"), F.lit("overview").alias("stage")))
    full = cases.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    left = full.join(unavailable.select("variant", "stage", "case_id"), ["variant", "stage", "case_id"], "left_anti")
    return left.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("stage", "case_id", "run", "variant", F.col("rep").cast("long").alias("rep"))


def usable_cache(cache: DataFrame, now, ttl_seconds: int = 24 * 3600, version: str | None = None) -> DataFrame:
    """Fresh records of the right extraction version whose explicit id version agrees.

    ``cache``: (requested_id, cached_id, saved_at seconds, version).
    """
    want = F.regexp_extract("requested_id", r"(v\d+)$", 1)
    have = F.regexp_extract("cached_id", r"(v\d+)$", 1)
    ok = (F.lit(now) - F.col("saved_at") <= ttl_seconds) & ((want == "") | (want == have))
    if version is not None:
        ok = ok & (F.col("version") == version)
    return cache.filter(ok)


def latest_finished(runs: DataFrame) -> DataFrame:
    """Newest run per thread that ended well and has a report.  Input: (thread_id, run_id, pos, status, has_report)."""
    ok = runs.filter(F.col("status").isin("success", "degraded") & F.col("has_report"))
    return ok.groupBy("thread_id").agg(F.max_by("run_id", F.struct("pos", "run_id")).alias("run_id"))


def publish_artifacts(runs: DataFrame) -> DataFrame:
    """(thread_id, artifact_id, kind, run_id, title): one artifact per id and thread, the first run wins.

    ``runs``: (thread_id, run_id, pos, answer, report_id, finished).
    """
    from sparkfolio.functions.text import first_heading
    from sparkfolio.sources.papers import first_row_per_key

    has_answer = F.coalesce("answer", F.lit("")) != ""
    rows = runs.filter(F.col("finished") & (has_answer | F.col("report_id").isNotNull()))
    rows = rows.select(
        "thread_id", "pos", "run_id", F.coalesce("report_id", F.concat(F.lit("answer-"), F.substring("run_id", 1, 12))).alias("artifact_id"),
        F.when(F.col("report_id").isNotNull(), "report").otherwise("answer").alias("kind"),
        first_heading(F.col("answer"), F.lit("Research answer")).alias("title"))
    return first_row_per_key(rows, ["thread_id", "artifact_id"], "pos", "run_id").drop("pos")


def thread_views(messages: DataFrame) -> DataFrame:
    """(thread_id, title, n_messages, n_user, last_pos): title from the first user message.

    ``messages``: (thread_id, pos, role, content).  Messages stay rows; a thread view
    carries counts and keys, not one unbounded nested list.
    """
    from sparkfolio.functions.redact import safe_text

    user = F.when(F.col("role") == "user", F.col("pos"))
    agg = messages.groupBy("thread_id").agg(
        F.min_by("content", user).alias("first_user"), F.count(F.lit(1)).alias("n_messages"), F.count(user).alias("n_user"), F.max("pos").alias("last_pos"))
    return agg.select("thread_id", F.coalesce(F.nullif(F.substring(safe_text(F.col("first_user"), 8000), 1, 160), F.lit("")), F.lit("New research")).alias("title"),
                      "n_messages", "n_user", "last_pos")


def thread_snapshots(threads: DataFrame, messages: DataFrame, runs: DataFrame, artifacts: DataFrame, piece_rows: int = 1000) -> DataFrame:
    """(thread_id, piece, title, updated_at, messages, runs, artifacts): threads with nested lists.

    ``threads``: (thread_id, title, updated_at); the children have (thread_id, pos, at) and their own
    columns, which become lists of structs in order of ``pos``.  A long thread comes in pieces of
    ``piece_rows`` positions; a thread without children has one empty piece.  A default title is
    replaced by the first user message, ``updated_at`` is the latest time of the thread and its children.
    """
    from sparkfolio.functions.redact import safe_text

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select("thread_id", F.floor(F.col("pos") / piece_rows).alias("piece"), F.struct("pos", *[c for c in df.columns if c not in ("thread_id", "pos")]).alias(name))

    children = threads.select("thread_id", F.lit(0).cast("long").alias("piece"))
    for df, name in ((messages, "messages"), (runs, "runs"), (artifacts, "artifacts")):
        children = children.unionByName(rows(df, name), allowMissingColumns=True)
    lists = children.groupBy("thread_id", "piece").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in ("messages", "runs", "artifacts")])
    first = messages.groupBy("thread_id").agg(F.min_by("content", F.when(F.col("role") == "user", F.col("pos"))).alias("asked"))
    times = messages.select("thread_id", "at").unionByName(runs.select("thread_id", "at")).unionByName(artifacts.select("thread_id", "at")).groupBy(
        "thread_id").agg(F.max("at").alias("last_at"))
    title = F.when(F.col("title") != "New research", F.col("title")).otherwise(F.coalesce(
        F.nullif(F.substring(safe_text(F.col("asked"), 8000), 1, 160), F.lit("")), F.lit("New research")))
    heads = threads.join(first, "thread_id", "left").join(times, "thread_id", "left").select(
        "thread_id", title.alias("title"), F.greatest("updated_at", "last_at").alias("updated_at"))
    return heads.join(lists, "thread_id").select("thread_id", "piece", "title", "updated_at", "messages", "runs", "artifacts")


def run_results(runs: DataFrame, papers: DataFrame) -> DataFrame:
    """(run_id, n_papers, n_bibtex, report_ready, seconds): the public result of each run.

    ``runs``: (run_id, status, report, measured_seconds, estimated_seconds); ``papers``:
    (run_id, pos, bibtex).  The measured time replaces the estimate.
    """
    from sparkfolio.functions.text import is_report

    p = papers.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(F.coalesce("bibtex", F.lit("")) != "").alias("n_bibtex"))
    ready = is_report(F.col("report")) & ~F.lower(F.coalesce("status", F.lit(""))).isin("error", "failed")
    return runs.join(p, "run_id", "left").select(
        "run_id", F.coalesce("n_papers", F.lit(0)).alias("n_papers"), F.coalesce("n_bibtex", F.lit(0)).alias("n_bibtex"), ready.alias("report_ready"),
        F.coalesce("measured_seconds", "estimated_seconds").alias("seconds"))


def bibtex_blocks(papers: DataFrame, piece_rows: int = 1024) -> DataFrame:
    """(run_id, piece, bibtex): entries joined by a blank line, in pieces of ``piece_rows`` papers."""
    rows = papers.filter(F.coalesce("bibtex", F.lit("")) != "")
    return rows.groupBy("run_id", F.floor(F.col("pos") / piece_rows).alias("piece")).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "bibtex"))), lambda b: b["bibtex"]), "\n\n").alias("bibtex"))


def last_n(df: DataFrame, group: Sequence[str], pos: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(pos).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
