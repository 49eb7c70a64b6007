"""Context for follow-up questions: which papers, tables and related works a question is about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkfolio.functions.numbers import delta_text, single_number
from sparkfolio.functions.text import (
    casefold, clip, display_equations, is_blank, squeeze, strip, word_count,
)
from sparkfolio.operators.graph import topk
from sparkfolio.operators.ground import NOTE_FIELDS
from sparkfolio.scale import running

# Caps of the packed parts, and words that say nothing about a topic.
MAX_PAPERS, MAX_TABLES, MAX_RELATED = 2, 4, 3
SUMMARY_CHARS, BLOCK_CHARS, NOTES_CHARS, TABLE_CHARS, RELATED_CHARS = 2500, 5000, 3500, 2000, 900
PAPER_CHARS = 40_000
STOPWORDS = (
    "the", "and", "for", "with", "what", "why", "how", "does", "this", "that", "are", "bài", "báo", "của", "và", "các",
    "cho", "với", "trong", "là", "sao", "vì", "thế", "nào", "paper", "papers",
)
ORDINAL = r"(?iU)(?:bài|paper|báo|article)\s*(?:số|thứ|no\.?|#)?\s*(\d{1,2})"
TABLE_NAME = r"(?iU)(?:table|bảng)\s*(\d+[a-z]?)"
ANY_ID = r"\d{4}\.\d{4,5}|[a-z][a-z.\-]*/\d{7}"


def topic_tokens(c: Column) -> Column:
    """Distinct caseless words of three characters and more, stop words left out."""
    found = F.regexp_extract_all(casefold(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOPWORDS)))


def shared_tokens(questions: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(question_id, item_id, n): shared topic words inside a thread, by equality join on the word."""
    q = questions.select("question_id", "thread_id", F.explode(topic_tokens(F.col("question"))).alias("w"))
    d = items.select("thread_id", "item_id", F.explode(topic_tokens(F.col(text))).alias("w"))
    return q.join(d, ["thread_id", "w"]).groupBy("question_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


def id_mentions(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, item_id): the item's id stands in the question."""
    named = questions.select("question_id", "thread_id", F.explode(F.array_distinct(
        F.regexp_extract_all("question", F.lit(ANY_ID), F.lit(0)))).alias("arxiv_id"))
    return named.join(items.filter(F.coalesce("arxiv_id", F.lit("")) != "").select("thread_id", "item_id", "arxiv_id"),
                      ["thread_id", "arxiv_id"]).select("question_id", "item_id")


def select_context(questions: DataFrame, items: DataFrame, k: int = MAX_PAPERS) -> DataFrame:
    """(question_id, rank, item_id, score): best ``k`` papers of the thread, the first ``k`` when none scores.

    ``questions``: (question_id, thread_id, question); ``items``: (thread_id, item_id, pos
    from 0, arxiv_id, title).
    """
    points = shared_tokens(questions, items, "title").select("question_id", "item_id", F.col("n").alias("points"))
    points = points.unionByName(id_mentions(questions, items).select("question_id", "item_id", F.lit(5).alias("points")))
    ordinals = questions.select("question_id", "thread_id", F.explode(
        F.transform(F.regexp_extract_all("question", F.lit(ORDINAL), F.lit(1)), lambda n: n.try_cast("bigint") - 1)).alias("pos"))
    points = points.unionByName(ordinals.join(items.select("thread_id", "pos", "item_id"), ["thread_id", "pos"]).select(
        "question_id", "item_id", F.lit(5).alias("points")))
    single = items.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id")).filter("n = 1")
    points = points.unionByName(questions.join(single, "thread_id").select("question_id", "item_id", F.lit(1).alias("points")))
    scored = points.groupBy("question_id", "item_id").agg(F.sum("points").alias("score"))
    place = items.select("item_id", "pos")
    best = topk(scored.join(place, "item_id"), ["question_id"], [F.col("score").desc(), F.col("pos")], k)
    first = topk(items, ["thread_id"], [F.col("pos")], k)
    rest = questions.join(scored.select("question_id").distinct(), "question_id", "left_anti").join(first, "thread_id").select(
        "question_id", "rank", "item_id", F.lit(0).cast("long").alias("score"))
    return best.select("question_id", "rank", "item_id", "score").unionByName(rest)


def _grams(c: Column) -> Column:
    """Every stretch of one to three characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in (1, 2, 3)]))))


def match_related(questions: DataFrame, items: DataFrame, k: int = MAX_RELATED) -> DataFrame:
    """(question_id, rank, item_id): related works named by id, by title, or by two shared words; item order.

    A contained title meets its question on the title's first three characters, and the
    containment is checked on those candidates only.
    """
    words = shared_tokens(questions, items, "title").filter("n >= 2").select("question_id", "item_id")
    q = questions.select("question_id", "thread_id", casefold(F.col("question")).alias("q"))
    q = q.withColumn("g", F.explode(_grams(F.col("q"))))
    t = items.select("thread_id", "item_id", casefold(F.col("title")).alias("t")).filter("t <> ''").withColumn("g", F.substring("t", 1, 3))
    titles = q.join(t, ["thread_id", "g"]).filter(F.col("q").contains(F.col("t"))).select("question_id", "item_id")
    hits = words.unionByName(titles).unionByName(id_mentions(questions, items)).distinct().join(items.select("item_id", "pos"), "item_id")
    return topk(hits, ["question_id"], [F.col("pos")], k).select("question_id", "rank", "item_id")


def match_tables(questions: DataFrame, tables: DataFrame, k: int = MAX_TABLES) -> DataFrame:
    """(question_id, rank, table_id): tables whose label the question names.  ``tables``: (thread_id, table_id, pos, label)."""
    named = questions.select("question_id", "thread_id", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("question", F.lit(TABLE_NAME), F.lit(1)), lambda n: F.concat(F.lit("table "), F.lower(n))))).alias("key"))
    hits = named.join(tables.withColumn("key", casefold(F.col("label"))), ["thread_id", "key"])
    return topk(hits, ["question_id"], [F.col("pos")], k).select("question_id", "rank", "table_id")


def within_budget(parts: DataFrame, group: str, block: Column, chars: int) -> DataFrame:
    """Whole items in order while their running length fits.  Input: (group, pos, text)."""
    out = running(parts, [group], block, ["pos"], sums={"used": F.length("text")})
    return out.filter(F.col("used") <= chars)


def pack_context(parts: DataFrame, group: str = "question_id") -> DataFrame:
    """(group, context, sources): chosen parts in section order, each clipped to its own cap.

    ``parts``: (group, section_no, pos, source, text, cap).  The selections that feed this
    are capped per question (two papers, four tables, three related works), so a packed
    context is a short text.
    """
    item = F.struct("section_no", "pos", F.concat(F.lit("["), F.col("source"), F.lit("]\n"), F.col("clipped")).alias("t"), "source")
    clipped = parts.withColumn("full", strip(F.coalesce("text", F.lit("")))).withColumn("clipped", F.when(
        F.length("full") <= F.col("cap"), F.col("full")).otherwise(
        F.concat(F.rtrim(F.expr("substring(full, 1, int(cap) - 1)")), F.lit("…"))))
    rows = clipped.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("p"))
    return rows.select(group, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("context"),
                       F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["source"])), "\n").alias("sources"))


# Section labels of a packed paper.
PACK_LABELS = {
    "abstract": "ABSTRACT", "methodology": "METHODOLOGY / ARCHITECTURE", "setup": "EXPERIMENTAL SETUP / TRAINING DETAILS / HARDWARE",
    "experiments": "EXPERIMENTS / BENCHMARKS / RESULTS", "limitations": "LIMITATIONS / FUTURE WORK",
}


def pack_paper(sections: dict[str, Column], tables: Column, cap: int = PAPER_CHARS) -> Column:
    """Labelled sections in fixed order, setup only when there, tables last, cut at ``cap``."""
    parts = []
    for name, label in PACK_LABELS.items():
        text = F.concat(F.lit(f"=== {label} ===\n"), F.coalesce(sections[name], F.lit("")))
        parts.append(F.when(~is_blank(sections[name]), text) if name == "setup" else text)
    shown = F.when(F.coalesce(tables, F.lit("")) != "", F.concat(F.lit("=== TABLES (header row first) ===\n"), tables))
    return F.substring(F.concat_ws("\n\n", *parts, shown), 1, cap)


def source_text(extracted: Column, sections: Sequence[Column], captions: Column, rows: Column) -> Column:
    """Extracted text, sections, then table captions and rows, one per line.

    ``captions``: array<string>; ``rows``: array<array<array<string>>> in the same order.
    """
    tables = F.flatten(F.transform(F.arrays_zip(captions.alias("c"), rows.alias("r")), lambda t: F.concat(
        F.array(F.coalesce(t["c"], F.lit(""))), F.transform(t["r"], lambda row: F.array_join(row, " | ")))))
    return F.array_join(F.concat(F.array(F.coalesce(extracted, F.lit("")), *[F.coalesce(s, F.lit("")) for s in sections]), tables), "\n")


def project_run_state(df: DataFrame, text: str = "extracted_text", sections: str = "sections") -> DataFrame:
    """Paper rows without their bodies: character counts instead of texts."""
    counts = F.transform_values(sections, lambda k, v: F.length(F.coalesce(v, F.lit(""))))
    return df.withColumn("extracted_text_chars", F.length(F.coalesce(text, F.lit(""))).cast("long")).withColumn(
        "sections_chars", counts).drop(text, sections)


def results_rows(rows: DataFrame) -> DataFrame:
    """Display rows of grounded results: unit in the metric, baseline with its name, signed delta."""
    metric, unit = strip(F.col("metric")), strip(F.col("unit"))
    named = (unit != "") & ~casefold(metric).contains(casefold(unit)) & ~casefold(F.col("method_value")).contains(casefold(unit))
    base = strip(F.col("baseline_value"))
    numbered = rows.withColumn("_left", single_number(F.col("method_value"))).withColumn("_right", single_number(base))
    keep = [c for c in rows.columns if c not in ("benchmark", "metric", "unit", "method_value", "baseline_name", "baseline_value")]
    return numbered.select(
        *keep, squeeze(F.col("benchmark")).alias("setting"),
        F.when(named, F.concat(metric, F.lit(" ("), unit, F.lit(")"))).otherwise(metric).alias("metric"), strip(F.col("method_value")).alias("method"),
        F.when(base != "", strip(F.concat(base, F.lit(" "), strip(F.col("baseline_name"))))).otherwise("").alias("baseline"),
        F.when(base != "", delta_text(F.col("_left"), F.col("_right"))).otherwise("").alias("delta"))


def call_quality(calls: DataFrame, payload: str = "response") -> DataFrame:
    """Per call: parses, words per note field, all fields filled, display equations."""
    parsed = F.from_json(payload, "struct<" + ",".join(f"{f}:string" for f in NOTE_FIELDS) + ">")
    ok = F.try_parse_json(payload).isNotNull() & ~is_blank(F.col(payload))
    rows = calls.withColumn("_p", parsed).withColumn("parse_ok", F.coalesce(ok, F.lit(False)))
    for f in NOTE_FIELDS:
        rows = rows.withColumn(f"words_{f}", F.when(F.col("parse_ok"), word_count(F.col(f"_p.{f}"))).otherwise(0).cast("long"))
    filled = F.col("parse_ok")
    for f in NOTE_FIELDS:
        filled = filled & (F.col(f"words_{f}") > 0)
    return rows.withColumn("all_nonempty", filled).withColumn("equations", display_equations(F.col(payload))).drop("_p")


def followup_rows(runs: DataFrame, papers: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, related) kept for follow-up questions: 12 papers and 60 titled related works per reported run."""
    from sparkfolio.functions.redact import safe_text
    from sparkfolio.functions.text import is_report

    ok = runs.filter(is_report(F.col("report")) & ~F.lower(F.coalesce("status", F.lit(""))).isin("error", "failed")).select("run_id")
    kept = topk(papers.join(ok, "run_id", "left_semi"), ["run_id"], [F.col("pos")], 12)
    shown = kept.select("run_id", "rank", safe_text(F.col("paper_id"), 260).alias("paper_id"), safe_text(F.col("title"), 400).alias("title"))
    related = topk(nodes.join(ok, "run_id", "left_semi"), ["run_id"], [F.col("pos")], 60).filter(~is_blank(F.col("title")))
    return shown, related.select("run_id", "rank", safe_text(F.col("title"), 300).alias("title"), safe_text(F.col("abstract"), 1500).alias("abstract"))


def cap_table_rows(rows: Column, max_rows: int = 40, max_cells: int = 12, chars: int = 80) -> Column:
    """Rows of one table within the stored limits."""
    return F.transform(F.slice(rows, 1, max_rows), lambda r: F.transform(F.slice(r, 1, max_cells), lambda c: F.substring(c, 1, chars)))


def latest_reports(df: DataFrame, key: str) -> DataFrame:
    """Reports by time of change, newest first."""
    return df.orderBy(F.col("updated_at").desc(), key)


def notes_lines(title: Column, paper_id: Column, fields: dict[str, Column], setup: dict[str, Column]) -> Column:
    """Compact note lines of one paper, clipped."""
    lines = [F.concat(title, F.lit(" ("), paper_id, F.lit(")"))]
    lines += [F.when(~is_blank(c), F.concat(F.lit(f"{label}: "), c)) for label, c in fields.items()]
    lines += [F.concat(F.lit(f"{label}: "), F.when(is_blank(c), "not stated in the paper").otherwise(c)) for label, c in setup.items()]
    return clip(F.concat_ws("\n", *lines), NOTES_CHARS, squeezed=False)
