"""Code and project links of a page: normal form, context, primary candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkfolio.functions.redact import url_host
from sparkfolio.functions.text import clean_inline, strip
from sparkfolio.operators.pages import BREAK_TAGS, CONTEXT_SIDE, MAX_CONTEXT, MAX_LINKS

# Hosts and owner names that decide what a link is.
GITHUB_RESERVED = (
    "orgs", "features", "topics", "sponsors", "marketplace", "settings", "about", "pricing", "login",
    "join", "explore", "collections", "events", "apps", "enterprise", "security", "site", "notifications",
)
CHROME_REPOS = ("dginev/ar5iv", "arxiv/html_feedback", "brucemiller/latexml")
PROJECT_SUFFIXES = (".github.io", ".gitlab.io", ".netlify.app", ".pages.dev", ".vercel.app")
CODE_HOSTS = (
    "gitlab.com", "bitbucket.org", "codeberg.org", "huggingface.co", "zenodo.org",
    "colab.research.google.com", "kaggle.com", "osf.io", "figshare.com", "sourceforge.net",
)
DENY_HOSTS = (
    "arxiv.org", "info.arxiv.org", "ar5iv.labs.arxiv.org", "ar5iv.org", "doi.org", "dx.doi.org",
    "openreview.net", "aclanthology.org", "dlmf.nist.gov", "scholar.google.com", "semanticscholar.org",
    "creativecommons.org", "wikipedia.org", "en.wikipedia.org", "twitter.com", "x.com", "youtube.com",
    "youtu.be", "latexml.mathweb.org", "proceedings.mlr.press", "papers.nips.cc", "ieeexplore.ieee.org",
    "dl.acm.org", "link.springer.com", "nature.com", "science.org",
)
# Wording next to a link.
STRONG_CUE = (
    r"(?i)project (?:page|website|site|webpage)|\bour (?:code|implementation|source|codebase|project|repo|repository|"
    r"website|webpage|models?|library)\b|\bwe (?:have )?(?:publicly )?(?:release[ds]?|open[- ]?sourced?|make (?:our|the) (?:code|implementation))\b|"
    r"\b(?:code|implementations?|models?|checkpoints?|weights|data(?:sets?)?)\b[^.]{0,60}?\b(?:is|are|will be|has been|have been)\s+"
    r"(?:made\s+)?(?:publicly\s+|freely\s+|now\s+|also\s+)?(?:available|released|open[- ]?sourced?)|"
    r"\bopen[- ]?source (?:code|implementation)|\bsource code\b|\b(?:code|implementation) (?:release|repository)\b|"
    r"\b(?:released|available) (?:at|on|under)\b|\bhomepage\b|\bwebpage\b|\bwebsite\b|"
    r"\b(?:videos?|visuali[sz]ations?|demos?|more results)\b[^.]{0,40}?\b(?:at|on|see|viewable|available)\b"
)
WEAK_CUE = r"(?i)\bcode\b|\bavailable\b|\breleas\w*|\bimplementation\b|\bgithub\b|\brepositor\w+|\bopen[- ]?source\b"
NEGATIVE_CUE = (
    r"(?i)\bbaselines?\b|\bfollow(?:ing|s|ed)?\b|\bbased on\b|\bbuilt (?:on|upon|atop)\b|\badapted from\b|\bborrow\w*\b|"
    r"\bofficial implementations? (?:of|from)\b|\bwe (?:use|used|ran|run|adopt|adopted|rely|relied)\b|\bthanks?\b|"
    r"\backnowledg\w*\b|\breference implementations?\b|\bfrom the (?:repository|repo|github)\b|\bpublic implementation\b|"
    r"\bimplementation (?:from|by|of)\b|\bunofficial\b|\bforked?\b|\bmodified version\b"
)
PROJECT_CUE = (
    r"(?i)project (?:page|website|site|webpage)|\bwebsite\b|\bwebpage\b|\bhomepage\b|\bdemos?\b|"
    r"\b(?:videos?|visuali[sz]ations?|more results)\b|\bcode\b|\bavailable (?:at|on)\b"
)


def with_normal_link(df: DataFrame, href: str = "href") -> DataFrame:
    """Add ``url`` and ``kind`` (``github``, ``other``, ``project_page``, ``unknown``); refused links drop out.

    The parts of the link are columns of their own, so each is computed once.
    """
    any_of = lambda names: "(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")"
    rows = df.withColumn("_raw", F.regexp_replace(strip(F.coalesce(F.col(href), F.lit(""))), r"""[.,;:)\]}>"']+$""", ""))
    rows = rows.withColumn("_scheme", F.lower(F.regexp_extract("_raw", r"^([A-Za-z]+)://", 1))).filter(
        F.col("_scheme").isin("http", "https"))
    rows = rows.withColumn("_host", F.regexp_replace(url_host(F.col("_raw")), r"^www\.", "")).withColumn(
        "_path", F.regexp_replace(F.regexp_extract("_raw", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")).filter("_host <> ''")
    rows = rows.withColumn("_parts", F.filter(F.split("_path", "/"), lambda p: p != ""))
    rows = rows.withColumn("_owner", F.get("_parts", 0)).withColumn("_repo", F.regexp_replace(F.get("_parts", 1), r"\.git$", ""))
    free = ~F.lower("_owner").isin(*GITHUB_RESERVED)
    clean = F.col("_owner").rlike(r"^[A-Za-z0-9_.-]+$") & F.col("_repo").rlike(r"^[A-Za-z0-9_.-]+$")
    chrome = F.lower(F.concat_ws("/", "_owner", "_repo")).isin(*CHROME_REPOS)
    github = (F.when((F.size("_parts") >= 2) & free & clean & ~chrome, "github").when((F.size("_parts") == 1) & free, "other"))
    kind = (F.when(F.col("_host") == "github.com", github)
            .when(F.col("_host").rlike(any_of(PROJECT_SUFFIXES) + "$"), "project_page").when(F.col("_host").isin(*CODE_HOSTS), "other")
            .when(~F.col("_host").rlike(r"(?:^|\.)" + any_of(DENY_HOSTS) + "$"), "unknown"))
    rows = rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    scheme = F.when(F.col("kind") == "unknown", F.col("_scheme")).otherwise("https")
    path = F.when(F.col("_host") != "github.com", F.col("_path")).when(F.col("kind") == "github", F.concat(
        F.lit("/"), "_owner", F.lit("/"), "_repo")).otherwise(F.concat(F.lit("/"), "_owner"))
    return rows.withColumn("url", F.concat(scheme, F.lit("://"), "_host", path)).drop(
        "_raw", "_scheme", "_host", "_path", "_parts", "_owner", "_repo")


def link_context(scoped: DataFrame, links: DataFrame) -> DataFrame:
    """Links with ``before``, ``link_text`` and ``after``: up to 90 characters of their own line."""
    heading_open = (F.col("kind") == "open") & (F.col("role") == "heading")
    block_end = (F.col("kind") == "close") & F.col("role").isNotNull() & F.col("tag").isin(*BREAK_TAGS) & ~F.col("tag").isin("td", "th")
    cell_end = (F.col("kind") == "close") & F.col("role").isNotNull() & F.col("tag").isin("td", "th")
    piece = F.when(F.col("text") != "", F.col("text")).when(cell_end, " ").otherwise("")
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ev = scoped.withColumn("piece", piece).withColumn("line", F.sum(F.when(heading_open | block_end, 1).otherwise(0)).over(page))
    in_line = Window.partitionBy("page_id", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(in_line), F.lit(0)))
    starts = ev.select("page_id", F.col("pos").alias("open_pos"), "line", F.col("offset").alias("start"))
    stops = ev.select("page_id", F.col("pos").alias("close_pos"), F.col("line").alias("end_line"), F.col("offset").alias("stop"))
    asked = links.join(starts, ["page_id", "open_pos"]).join(stops, ["page_id", "close_pos"], "left")
    pieces = ev.filter(F.col("piece") != "").join(asked.select("page_id", "line").distinct(), ["page_id", "line"], "left_semi")
    text = pieces.groupBy("page_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "piece"))), lambda p: p["piece"]), "").alias("flow"))
    j = asked.join(text, ["page_id", "line"], "left").withColumn("flow", F.coalesce("flow", F.lit("")))
    stop = F.when(F.col("end_line") == F.col("line"), F.col("stop")).otherwise(F.length("flow"))
    from_ = F.greatest(F.lit(0), F.col("start") - CONTEXT_SIDE)
    before = F.substring("flow", from_ + 1, F.col("start") - from_)
    before = F.when((from_ > 0) & before.contains(" "), F.regexp_replace(before, r"^[^ ]* ", "")).otherwise(before)
    after = F.substring("flow", stop + 1, F.lit(CONTEXT_SIDE))
    after = F.when((stop + CONTEXT_SIDE < F.length("flow")) & after.contains(" "), F.regexp_replace(after, r" [^ ]*$", "")).otherwise(after)
    shown = clean_inline(F.substring("flow", F.col("start") + 1, F.greatest(stop - F.col("start"), F.lit(0))))
    shown = F.when(F.length(shown) > 60, F.concat(F.substring(shown, 1, 57), F.lit("..."))).otherwise(shown)
    return j.withColumn("before", clean_inline(before)).withColumn("link_text", shown).withColumn("after", clean_inline(after)).drop(
        "flow", "start", "stop", "line", "end_line")


def is_primary(before: Column, after: Column, in_bib: Column, front: Column, section: Column) -> Column:
    context = F.concat(before, F.lit(" "), after)
    near = F.when(F.length(before) > 80, F.expr("right(before, 80)")).otherwise(before).rlike(NEGATIVE_CUE)
    strong = context.rlike(STRONG_CUE) & ~near
    weak = ~F.coalesce(section.isin("experiments", "setup"), F.lit(False)) & context.rlike(WEAK_CUE) & ~context.rlike(NEGATIVE_CUE)
    return ~in_bib & (front | strong | weak)


def links(scoped: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page_id, link_index, url, kind, context, in_bibliography, is_primary): one row per link target.

    Unknown hosts stay only when the words around them announce a project page.
    """
    rows = link_context(scoped, with_normal_link(anchors))
    around = F.concat("before", F.lit(" "), "after")
    announced = ~F.col("in_bib") & around.rlike(PROJECT_CUE) & (F.col("front") | around.rlike(STRONG_CUE))
    rows = rows.filter((F.col("kind") != "unknown") | announced)
    kind = F.when(F.col("kind") == "unknown", "project_page").otherwise(F.col("kind"))
    joined = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (F.col("before"), F.col("link_text"), F.col("after"))])
    cut = F.substring(joined, 1, MAX_CONTEXT)
    context = F.when(F.length(joined) > MAX_CONTEXT, F.coalesce(F.nullif(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("")), cut)).otherwise(joined)
    rows = rows.select("page_id", "open_pos", "url", kind.alias("kind"), context.alias("context"), "in_bib",
                       is_primary(F.col("before"), F.col("after"), F.col("in_bib"), F.col("front"), F.col("section")).alias("primary"))
    merged = rows.groupBy("page_id", F.lower("url").alias("key")).agg(
        F.min("open_pos").alias("first_pos"), F.min_by("url", "open_pos").alias("url"), F.min_by("kind", "open_pos").alias("kind"),
        F.coalesce(F.min_by("context", F.when(F.col("primary"), F.col("open_pos"))), F.min_by("context", "open_pos")).alias("context"),
        F.bool_and("in_bib").alias("in_bibliography"), F.bool_or("primary").alias("primary"))
    w = Window.partitionBy("page_id").orderBy("first_pos")
    return merged.withColumn("link_index", F.row_number().over(w).cast("long")).filter(F.col("link_index") <= MAX_LINKS).select(
        "page_id", "link_index", "url", "kind", "context", "in_bibliography",
        (F.col("primary") & ~F.col("in_bibliography")).alias("is_primary"))


def code_urls(link_rows: DataFrame) -> DataFrame:
    """First eight primary code repositories of each page."""
    w = Window.partitionBy("page_id").orderBy("link_index")
    return link_rows.filter((F.col("kind") == "github") & F.col("is_primary")).withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= 8).select("page_id", F.col("rank").cast("long").alias("rank"), "url")


def extraction_report(pages: DataFrame, section_rows: DataFrame, table_rows: DataFrame, reference_rows: DataFrame,
                      link_rows: DataFrame) -> DataFrame:
    """Per page: section lengths, tables, references with id and DOI, primary and other links."""
    sec = section_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("text")).alias("section_chars"))
    tab = table_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tables"))
    ref = reference_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_references"), F.count("arxiv_id").alias("n_with_id"),
                                                F.count("doi").alias("n_with_doi"))
    lnk = link_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("is_primary").alias("n_primary"))
    out = pages.select("page_id", "is_paper")
    for part in (sec, tab, ref, lnk):
        out = out.join(part, "page_id", "left")
    return out.select("page_id", "is_paper", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "n_sections", "section_chars", "n_tables", "n_references", "n_with_id", "n_with_doi", "n_links", "n_primary")])
