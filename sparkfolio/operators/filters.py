"""Row filters and per-row status columns over paper metadata and run state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkfolio.functions.ids import extract_id, is_modern_id, paper_key
from sparkfolio.functions.text import casefold, squeeze, strip

MAX_RETRIES = 2
# Fixed value: default title pattern of a survey paper.
SURVEY_TITLE = r"(?U)\b(survey|a review|literature review|systematic review)\b"


def has_category_prefix(categories: Column, prefixes: Sequence[str]) -> Column:
    """Any space-separated category starts with any prefix."""
    cats = F.split(F.trim(F.coalesce(categories, F.lit(""))), r"\s+")
    starts = lambda c: _any([c.startswith(p) for p in prefixes])
    return F.exists(cats, starts)


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for cond in conditions:
        out = out | cond
    return out


def _some_start_with(cats: Column, prefix: str) -> Column:
    return F.exists(cats, lambda c: c.startswith(prefix))


def in_categories(categories: Column, wanted: Sequence[str]) -> Column:
    """Exact category, or a prefix when the entry ends in ``*``; caseless."""
    cats = F.split(F.lower(F.trim(F.coalesce(categories, F.lit("")))), " +")
    conds = []
    for raw in wanted:
        entry = (raw or "").strip().lower()
        if entry.endswith("*"):
            conds.append(_some_start_with(cats, entry[:-1]))
        elif entry:
            conds.append(F.array_contains(cats, entry))
    return _any(conds) if conds else F.lit(True)


def date_before(date: Column, limit: str) -> Column:
    """Inclusive text compare on the first ten characters; no date passes."""
    return F.coalesce(date, F.lit("")) <= F.lit(str(limit)[:10])


def modern_ids(paper_id: Column) -> Column:
    return paper_id.rlike(r"^[0-9]{4}\.")


def select_candidates(df: DataFrame, category: str, year_from: int, year_to: int | None = None,
                      title_pattern: str = SURVEY_TITLE) -> DataFrame:
    """Survey candidates of a category: modern id, year window, title pattern."""
    year = F.lit(2000) + F.substring("paper_id", 1, 2).try_cast("int")
    title = squeeze(F.coalesce(F.col("title"), F.lit("")))
    cond = (F.col("primary_category") == category) & is_modern_id(F.col("paper_id")) & (year >= year_from)
    if year_to is not None:
        cond = cond & (year <= year_to)
    return df.filter(cond & F.lower(title).rlike(title_pattern)).select("paper_id", title.alias("title"), "date")


def sample_by_seed(df: DataFrame, n: int, seed: int, key: str = "paper_id") -> DataFrame:
    """``n`` rows without replacement, the same for the same seed; all when n is 0 or too large."""
    if n <= 0:
        return df.orderBy(key)
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)


def metadata_status(title: Column, authors: Column, published: Column, subjects: Column) -> Column:
    """``complete`` when title, authors, date and subjects (arrays) are present."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(full(title) & full(published) & some(authors) & some(subjects), "complete").otherwise("missing")


def needs_metadata(summary: Column, authors: Column, published: Column, subjects: Column, status: Column,
                   title: Column) -> Column:
    name = F.lower(strip(F.coalesce(title, F.lit(""))))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return (blank(summary) | none(authors) | blank(published) | none(subjects)
            | (F.coalesce(status, F.lit("")) != "complete") | name.startswith("arxiv ") | name.startswith("paper "))


def split_authors(c: Column) -> Column:
    """Names of a free-text author line, remarks in parentheses removed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"\s+and\s+", ", ")
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def paper_url(paper_id: Column, kind: str) -> Column:
    found = extract_id(paper_id)
    clean = F.when(found != "", found).otherwise(paper_id)
    return F.concat(F.lit(f"https://arxiv.org/{kind}/"), clean, F.lit(".pdf" if kind == "pdf" else ""))


def to_paper_rows(df: DataFrame) -> DataFrame:
    """Search-result shape of index rows: split authors, subjects, links, key, status."""
    authors = split_authors(F.col("authors"))
    subjects = F.filter(F.split(squeeze(F.col("categories")), " "), lambda s: s != "")
    key = F.when(is_modern_id(F.col("paper_id")), paper_key(F.col("paper_id"))).otherwise(
        F.concat(F.lit("arxiv_"), F.replace(F.col("paper_id"), F.lit("/"), F.lit("_"))))
    return df.select(
        key.alias("paper_key"), F.col("paper_id").alias("arxiv_id"), "title", F.col("abstract").alias("summary"),
        authors.alias("authors"), F.col("date").alias("published"), subjects.alias("subjects"),
        paper_url(F.col("paper_id"), "abs").alias("abs_url"), paper_url(F.col("paper_id"), "html").alias("html_url"),
        paper_url(F.col("paper_id"), "pdf").alias("pdf_url"),
        metadata_status(F.col("title"), authors, F.col("date"), subjects).alias("metadata_status"),
    )


def public_rows(df: DataFrame, texts: dict[str, int], arrays: dict[str, int], numbers: Sequence[str]) -> DataFrame:
    """Allow-listed columns only: texts and arrays cut to their limits, bad numbers NULL."""
    from sparkfolio.functions.redact import redact

    cols = [F.substring(redact(strip(F.coalesce(F.col(c), F.lit("")))), 1, n).alias(c) for c, n in texts.items()]
    cols += [F.slice(F.coalesce(F.col(c), F.array()), 1, n).alias(c) for c, n in arrays.items()]
    cols += [F.when(F.col(c).try_cast("bigint") >= 0, F.col(c).try_cast("bigint")).alias(c) for c in numbers]
    return df.select(*cols)


def route(status: Column, intent: Column, followup: Column, n_selected: Column) -> Column:
    """Next step after the request was classified."""
    return (F.when(status == "error", "error_handler")
            .when((intent == "followup") & followup, "answer_followup")
            .when((intent == "direct_read") & (n_selected > 0), "read_paper")
            .otherwise("search_papers"))


def route_after_eval(status: Column, passed: Column, retries: Column, n_selected: Column) -> Column:
    """Next step after a search was judged: error, pass, retry, keep candidates, give up."""
    return (F.when(status == "error", "error_handler").when(passed, "read_paper")
            .when(retries < MAX_RETRIES, "refine_query").when(n_selected > 0, "read_paper")
            .otherwise("error_handler"))


def fan_out(df: DataFrame, status: str = "status") -> DataFrame:
    """One row per next branch after reading: three branches, or the error step."""
    branches = F.when(F.col(status) == "error", F.array(F.lit("error_handler"))).otherwise(
        F.array(F.lit("notes_branch"), F.lit("citation_graph"), F.lit("web_enrich")))
    return df.withColumn("branch", F.explode(branches))


def repo_source(html_repos: DataFrame, search_repos: DataFrame, papers: DataFrame) -> DataFrame:
    """Where a paper's repository comes from: its page first, then a search hit."""
    h = html_repos.groupBy("paper_id").agg(F.countDistinct("url").alias("n_html"))
    s = search_repos.groupBy("paper_id").agg(F.countDistinct("url").alias("n_search"))
    n_html, n_search = F.coalesce("n_html", F.lit(0)), F.coalesce("n_search", F.lit(0))
    return papers.join(h, "paper_id", "left").join(s, "paper_id", "left").select(
        "paper_id",
        F.when(n_html > 0, "html").when(n_search > 0, "github_search").otherwise("none").alias("repo_source"),
        F.when(n_html > 0, n_html).otherwise(n_search).cast("long").alias("repo_count"),
    )


def is_official_repo(description: Column, arxiv_id: Column, title: Column) -> Column:
    desc = F.lower(F.coalesce(description, F.lit("")))
    clean = F.lower(strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\w\s-]", " ")))
    has = lambda needle: (F.coalesce(needle, F.lit("")) != "") & desc.contains(needle)
    return desc.contains("official") | F.coalesce(has(arxiv_id), F.lit(False)) | F.coalesce(has(clean), F.lit(False))


# Free status words and what they stand for.
HEADING_WORDS = {
    "heading": ("heading", "true", "real", "detected", "section", "explicit", "parsed"),
    "fallback": ("fallback", "false", "inferred", "heuristic", "default", "synthetic"),
}
PARSER_WORDS = {
    "success": ("success", "ok", "complete", "completed", "parsed"),
    "degraded": ("degraded", "partial", "warning", "warn"),
    "error": ("error", "failed", "failure"),
}


def normalize_status(c: Column, kind: str = "heading") -> Column:
    text = casefold(strip(F.coalesce(c, F.lit(""))))
    out = None
    for name, words in (HEADING_WORDS if kind == "heading" else PARSER_WORDS).items():
        out = F.when(text.isin(*words), name) if out is None else out.when(text.isin(*words), name)
    return out.otherwise("unknown")


def notes_quality(explicit: Column, has_notes: Column) -> tuple[Column, Column]:
    """(notes quality, notes status) from the stated value or the absence of notes."""
    text = casefold(strip(F.coalesce(explicit, F.lit(""))))
    quality = (F.when(text.isin("complete", "fallback", "invalid", "missing"), text)
               .when(~has_notes | (text == "unknown"), "unknown").otherwise("missing"))
    status = (F.when(quality == "complete", "complete").when(quality.isin("fallback", "invalid"), "invalid")
              .when(quality == "missing", "missing").otherwise("unknown"))
    return quality, status


def select_cases(cases: DataFrame, selector: str) -> DataFrame:
    """All cases, or those whose id or run name is in a comma list."""
    tokens = sorted({t.strip() for t in selector.split(",") if t.strip()})
    if not tokens or "all" in tokens:
        return cases
    return cases.filter(F.col("case_id").isin(tokens) | F.col("run").isin(tokens))


def pick_by_index(cands: DataFrame, picks: DataFrame, k: int = 3) -> DataFrame:
    """Candidates at listed 0-based positions in list order; the first k when none is valid.

    ``cands``: (group_id, pos, item); ``picks``: (group_id, idx array<int>).
    """
    wanted = picks.select("group_id", F.posexplode("idx").alias("out_pos", "pos"))
    hit = cands.join(wanted.withColumn("pos", F.col("pos").cast("long")), ["group_id", "pos"]).select(
        "group_id", F.col("out_pos").cast("long").alias("out_pos"), "item")
    found = hit.select("group_id").distinct()
    fallback = cands.filter(F.col("pos") < k).join(found, "group_id", "left_anti").select(
        "group_id", F.col("pos").alias("out_pos"), "item")
    return hit.unionByName(fallback)
