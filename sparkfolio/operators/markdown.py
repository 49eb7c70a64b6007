"""Links of Markdown reports: keep safe ones, repair clear placeholders, flatten the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkfolio.functions.redact import PAPER_HOSTS, redact, safe_link, url_host
from sparkfolio.functions.text import casefold, strip

NOTE = " _(link unavailable: unverified source)_"
PIECE = (r"!?\[[^\]\n]{1,1000}\]\((?:<[^>\n]+>|[^)\n]+)\)|<(?i:https?)://[^>\s]+>|(?<![A-Za-z0-9_`<(])(?i:https?)://[^\s)>]+|"
         r"[^\[!<hH]+|(?s:.)")
PAPER_ID = r"(?<!\d)(\d{4}\.\d{4,5}(?:v\d+)?)(?!\d)"
# Link targets that stand for a missing link.
PLACEHOLDERS = ("#", "url", "link", "paper", "paper.pdf", "source", "source.pdf")
INSTRUCTION_LINE = r"(?im)^\s*(?:[*_>]+\s*)?(?:Synthesis requested\b|Analysis scope\s*:|Language Mode\s*:|PMRL quality\s*:)[^\n]*(?:\n|\z)"


def _paper_link(arxiv_id: Column, pdf: Column) -> Column:
    return F.when(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id, F.lit(".pdf"))).otherwise(
        F.concat(F.lit("https://arxiv.org/abs/"), arxiv_id))


def rewrite_links(reports: DataFrame, papers: DataFrame) -> DataFrame:
    """(report_id, text): reports with checked links.  ``papers``: (report_id, title, arxiv_id).

    A report is cut into pieces; placeholder links meet the report's own paper titles and
    are repaired when exactly one paper fits.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), INSTRUCTION_LINE, "")
    pieces = reports.select("report_id", F.posexplode(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0))).alias("pos", "piece"))
    md = F.col("piece").rlike(r"^!?\[[^\]\n]{1,1000}\]\(")
    p = pieces.withColumn("is_md", md).withColumn("is_auto", F.col("piece").rlike(r"(?i)^<https?://")).withColumn(
        "is_bare", F.col("piece").rlike(r"(?i)^https?://"))
    p = p.withColumn("label", F.when(F.col("is_md"), strip(F.regexp_extract("piece", r"^!?\[([^\]\n]{1,1000})\]\(", 1))))
    target = strip(F.regexp_extract("piece", r"^!?\[[^\]\n]{1,1000}\]\((<[^>\n]+>|[^)\n]+)\)$", 1))
    target = F.regexp_replace(strip(F.regexp_replace(target, r"^<(.*)>$", "$1")), r"""^(["'])(.*)\1$""", "$2")
    p = p.withColumn("target", F.when(F.col("is_md"), target).when(F.col("is_auto"), F.regexp_replace("piece", "^<|>$", "")).when(
        F.col("is_bare"), F.col("piece"))).withColumn("safe", safe_link(F.col("target")))
    t = casefold(F.col("target"))
    on_arxiv = url_host(F.col("target")).isin(*PAPER_HOSTS) | t.startswith("arxiv.org/")
    target_id = F.nullif(F.regexp_extract("target", PAPER_ID, 1), F.lit(""))
    label_id = F.nullif(F.regexp_extract("label", PAPER_ID, 1), F.lit(""))
    pdf_word = F.concat_ws(" ", t, casefold(F.col("label"))).contains("pdf")
    direct = F.when(on_arxiv & target_id.isNotNull(), _paper_link(target_id, t.contains("/pdf/") | t.endswith(".pdf"))).when(
        label_id.isNotNull(), _paper_link(label_id, pdf_word))
    hole = ((t == "") | t.isin(*PLACEHOLDERS) | t.startswith("file:") | t.rlike(r"(?:paper|source|upload|tmp|cache)[_./-].*")
            | F.col("target").contains(":\\") | F.col("target").rlike(r"^(?:/|\./|\.\./)"))
    p = p.withColumn("direct", direct).withColumn("hole", F.col("is_md") & F.col("safe").isNull() & F.col("direct").isNull() & hole)
    names = papers.withColumn("arxiv_id", F.regexp_extract("arxiv_id", PAPER_ID, 1)).filter("arxiv_id <> ''").select(
        "report_id", casefold(F.col("title")).alias("title"), "arxiv_id").filter("title <> ''")
    low = casefold(F.col("label"))
    fits = p.filter("hole").join(names, "report_id").filter(low.contains(F.col("title")) | F.col("title").contains(low)).groupBy(
        "report_id", "pos").agg(F.min("arxiv_id").alias("a"), F.max("arxiv_id").alias("b")).filter("a = b")
    p = p.join(fits.select("report_id", "pos", "a"), ["report_id", "pos"], "left")
    link = F.coalesce("safe", "direct", F.when(F.col("a").isNotNull(), _paper_link(F.col("a"), pdf_word)))
    shown = F.when(F.col("label").rlike(r"(?i)(?:https?://|/|\\|:)"), "Unverified link").otherwise(F.col("label"))
    none = F.lit("`Unverified link`" + NOTE)
    text = (F.when(F.col("is_md"), F.when(link.isNotNull(), F.concat(F.lit("["), F.col("label"), F.lit("]("), link, F.lit(")"))).otherwise(
        F.concat(shown, F.lit(NOTE))))
        .when(F.col("is_auto"), F.when(F.col("safe").isNotNull(), F.concat(F.lit("<"), F.col("safe"), F.lit(">"))).otherwise(none))
        .when(F.col("is_bare"), F.when(F.col("safe").isNotNull(), F.col("piece")).otherwise(none)).otherwise(F.col("piece")))
    out = p.select("report_id", "pos", text.alias("t")).groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("text"))
    return reports.select("report_id").join(out, "report_id", "left").select("report_id", redact(F.col("text")).alias("text"))
