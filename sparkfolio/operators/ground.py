"""Grounding of numbers and words against source texts, and checks of whole reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkfolio.functions.numbers import decimal_tokens, number_tokens, number_variants, report_numbers
from sparkfolio.functions.text import (
    bound, casefold, display_equations, flat, is_blank, strip, strip_fences, word_count,
)
from sparkfolio.sources.papers import first_row_per_key

# Stop words, labels, patterns and thresholds of the checks.
HARDWARE_STOPWORDS = (
    "the", "and", "with", "for", "using", "used", "our", "all", "per", "each", "from", "this", "that",
    "trained", "training", "train", "experiments", "experiment", "models", "model",
)
NOTE_FIELDS = ("problem", "method", "result", "limitation")
RESULT_LABELS = {"Insight": "insights?", "Metrics": "đại lượng đo|metrics?", "Setup": "thiết lập|setup"}
INTERNAL_LINE = (
    r"(?i)^\s*(?:synthesis requested|analysis scope:|language mode:|pmrl quality:|"
    r"delivered in .* per language mode|agent (?:status|self-review))\b"
    r"|\bPMRL\s+(?:quality|status)\b|\blanguage[- ]mode\b"
    r"|^\W*pipeline\s*[:=]|\bpipeline[_ ](?:version|status|error|stage)\b|\bSUMMARY_PIPELINE\w*"
    r"|\b(?:report|pmrl)_[0-9a-f]{8,}\b|\breport_[\w-]*\.md\b|\bsummary_quality\b"
    r"|\bnumber_not_in_source\b|\bcard_status(?:es)?\b"
)
RATIO_LOW, RATIO_HIGH, GROUNDING_DROP, MAX_EQUATIONS, TARGET_SECONDS = 0.6, 1.6, 0.05, 3, 60.0
PASSIVE = r"(?iU)\b(?:được|bị)\b"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"
TAIL_LABEL = (r"(?iU)^\s*[-*•]\s*\**\s*(?:mã nguồn|source code|liên kết nguồn|source links|trích dẫn|citation|trích xuất|extraction)\b")
SENTENCE_END = r"(?<=[.!?;:])\s+(?=[A-ZÀ-Ỹ0-9\"(\[*])"


def source_values(sources: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by..., value): every reading of every number in the sources of a group, once."""
    tokens = sources.select(*by, F.explode(number_tokens(F.col(text))).alias("n")).select(*by, F.col("n.token").alias("token")).distinct()
    return tokens.select(*by, F.explode(number_variants(F.col("token"), F.lit(False))).alias("value")).distinct()


def claims(reports: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by..., pos, token, percent): numbers of a report worth grounding."""
    return reports.select(*by, F.posexplode(report_numbers(F.col(text))).alias("pos", "n")).select(
        *by, F.col("pos").cast("long").alias("pos"), F.col("n.token").alias("token"), F.col("n.percent").alias("percent"))


def grounding_ratio(reports: DataFrame, sources: DataFrame, by: str, source_by: str) -> DataFrame:
    """(by, n_claims, n_grounded, ratio): share of report numbers found in the sources; 1 without claims.

    ``reports``: (by, source_by, text); ``sources``: (source_by, text).  Claims meet the
    distinct values of their source group, so a large group is joined, never collected.
    """
    values = source_values(sources, [source_by])
    read = claims(reports, [by, source_by])
    distinct = read.select(source_by, "token", "percent").distinct()
    hit = distinct.withColumn("value", F.explode(number_variants(F.col("token"), F.col("percent")))).join(
        values, [source_by, "value"], "left_semi").select(source_by, "token", "percent").distinct().withColumn("hit", F.lit(1))
    scored = read.join(hit, [source_by, "token", "percent"], "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count("hit").alias("n_grounded"))
    return reports.select(by).join(scored, by, "left").select(
        by, F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_grounded", F.lit(0)).alias("n_grounded"),
        F.coalesce(F.col("n_grounded") / F.col("n_claims"), F.lit(1.0)).alias("ratio"))


def match_tokens(c: Column) -> Column:
    """Loose word tokens: number and unit glued, plural s dropped."""
    joined = F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"(\d)\s+([a-z])", "$1$2")
    tokens = F.regexp_extract_all(joined, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.when(
        (F.length(t) > 3) & t.endswith("s") & ~t.rlike(r"\d"), F.regexp_replace(t, "s$", "")).otherwise(t))


def text_in_source(text: Column, source: Column) -> Column:
    """Every token with a digit, and half of the longer words, occur in the source; no tokens is no support."""
    tokens = F.filter(match_tokens(text), lambda t: ~t.isin(*HARDWARE_STOPWORDS))

    def supported(both: Column) -> Column:
        tokens, known = both["tokens"], both["known"]
        # what the source lacks is found in a hash table; only these words are then counted
        missing = lambda part: F.array_except(part, known)
        digits = F.filter(tokens, lambda t: t.rlike(r"\d"))
        words = F.filter(tokens, lambda t: ~t.rlike(r"\d") & (F.length(t) >= 3))
        half = bound(F.struct(words.alias("all"), missing(words).alias("missing")), lambda w: (F.size(w["all"]) == 0) | (
            F.size(F.filter(w["all"], lambda t: F.array_contains(w["missing"], t))) <= F.size(w["all"]) / 2))
        return (F.size(tokens) > 0) & (F.size(missing(digits)) == 0) & half

    return bound(F.struct(tokens.alias("tokens"), F.array_distinct(match_tokens(source)).alias("known")), supported)


def claims_subset(claim_text: Column, source: Column) -> Column:
    """All numbers of the claim are numbers of the source."""
    return F.size(F.array_except(decimal_tokens(claim_text), decimal_tokens(source))) == 0


def rows_supported_by_table(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """(row_id): rows whose label names a table that holds all the row's numbers.

    ``rows``: (row_id, paper_id, label, numbers); ``tables``: (paper_id, label, text).
    """
    t = tables.select("paper_id", flat(F.col("label")).alias("key"), decimal_tokens(F.col("text")).alias("held"))
    r = rows.select("row_id", "paper_id", flat(F.col("label")).alias("key"), "numbers").filter("key <> ''")
    return r.join(t, ["paper_id", "key"]).filter(F.size(F.array_except("numbers", "held")) == 0).select("row_id").distinct()


def ground_rows(rows: DataFrame, corpus: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts per paper) of proposed result rows.

    ``rows``: (paper_id, pos, benchmark, metric, method_value, baseline_name, baseline_value,
    table_label, source_quote); ``corpus``: (paper_id, text) with one text per paper.
    """
    base = rows.withColumn("row_id", F.xxhash64("paper_id", "pos")).withColumn("mn", decimal_tokens(F.col("method_value"))).withColumn(
        "bn", decimal_tokens(F.col("baseline_value"))).withColumn("numbers", F.array_union("mn", "bn"))
    source = corpus.select("paper_id", decimal_tokens(F.col("text")).alias("held"), flat(F.col("text")).alias("flat_source"))
    usable = ~is_blank(F.col("benchmark")) & ~is_blank(F.col("metric")) & (F.size("mn") > 0)
    good = base.join(source, "paper_id", "left").filter(usable & (F.size(F.array_except(
        "numbers", F.coalesce("held", F.array().cast("array<string>")))) == 0))
    keys = [flat(F.col(c)).alias(f"_k_{c}") for c in ("benchmark", "metric", "method_value", "baseline_value")]
    once = first_row_per_key(good.select("*", *keys), ["paper_id", *[f"_k_{c}" for c in (
        "benchmark", "metric", "method_value", "baseline_value")]], "pos")
    held = rows_supported_by_table(once.select("row_id", "paper_id", F.col("table_label").alias("label"), "numbers"), tables)
    out = once.join(held.withColumn("label_ok", F.lit(True)), "row_id", "left")
    named = ~is_blank(F.col("baseline_value")) & (F.size("bn") == 0)
    quote_ok = F.col("flat_source").contains(flat(F.col("source_quote")))
    kept = out.select(
        "paper_id", "pos", "benchmark", "metric", "method_value",
        F.when(named, "").otherwise(F.col("baseline_name")).alias("baseline_name"),
        F.when(named, "").otherwise(F.col("baseline_value")).alias("baseline_value"),
        F.when(F.col("label_ok"), F.col("table_label")).otherwise("").alias("table_label"),
        F.when(quote_ok, F.col("source_quote")).otherwise("").alias("source_quote"))
    counts = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("proposed")).join(
        kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("kept")), "paper_id", "left").select(
        "paper_id", "proposed", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("proposed") - F.coalesce("kept", F.lit(0))).alias("dropped"))
    return kept, counts


def lines(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, line): lines of a text in order."""
    return df.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))


def report_units(reports: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, number, unit, title, text): numbered sections; section 2 one unit per ``###`` block.

    A report is one row; its lines are grouped inside it.  The first section of a
    repeated number wins.
    """
    ls = lines(reports, key, strip_fences(F.col("text")))
    page = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^##\s+(\d+)\s*[.)].*$", 1)
    ls = ls.withColumn("sec_pos", F.last(F.when(head != "", F.col("pos")), ignorenulls=True).over(page)).withColumn(
        "number", F.last(F.when(head != "", head.try_cast("int")), ignorenulls=True).over(page)).filter("sec_pos IS NOT NULL")
    firsts = ls.groupBy(key, "number").agg(F.min("sec_pos").alias("sec_pos"))
    ls = ls.join(firsts, [key, "number", "sec_pos"], "left_semi")
    inside = Window.partitionBy(key, "sec_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_block = (F.col("number") == 2) & F.col("line").rlike(r"^###\s")
    ls = ls.withColumn("unit", F.sum(F.when(is_block, 1).otherwise(0)).over(inside))
    item = F.array_sort(F.collect_list(F.struct("pos", "line")))
    units = ls.groupBy(key, "number", "sec_pos", "unit").agg(item.alias("ls"))
    first = F.get(F.col("ls"), 0)["line"]
    title = F.when(F.col("unit") > 0, F.regexp_extract(first, r"^###\s*(.*)$", 1)).otherwise(
        F.regexp_extract(first, r"^##\s+\d+\s*[.)]\s*(.*)$", 1))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    after = F.array_join(F.transform(F.slice("ls", 2, F.greatest(F.size("ls"), F.lit(1))), lambda x: x["line"]), "\n")
    return units.select(key, F.col("number").cast("long").alias("number"), F.col("unit").cast("long").alias("unit"),
                        strip(title).alias("title"), strip(body).alias("text"), strip(after).alias("body"))


def paper_blocks(units: DataFrame) -> DataFrame:
    return units.filter((F.col("number") == 2) & (F.col("unit") > 0))


def check_row(name: str, group: str, ok: Column, detail: Column) -> list[Column]:
    return [F.lit(name).alias("name"), F.lit(group).alias("grp"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), detail.alias("detail")]


def check_status(runs: DataFrame) -> DataFrame:
    status = F.coalesce("status", F.lit("unknown"))
    return runs.select("run_id", *check_row("status_not_error", "HARD", status != "error", F.concat(F.lit("status="), status)))


def check_paper_ids(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Per run: ids missing from and extra in the candidate.  Input: (run_id, id)."""
    b = base.select("run_id", "id").distinct().withColumn("b", F.lit(1))
    c = cand.select("run_id", "id").distinct().withColumn("c", F.lit(1))
    counts = b.join(c, ["run_id", "id"], "full").groupBy("run_id").agg(
        F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))
    return counts.select("run_id", *check_row("same_paper_ids", "HARD", (F.col("missing") + F.col("extra")) == 0, F.concat(
        F.lit("missing="), F.col("missing").cast("string"), F.lit(" extra="), F.col("extra").cast("string"))))


def empty_notes(papers: DataFrame, notes: DataFrame) -> DataFrame:
    """(run_id, paper_id, field): note fields without text.  ``notes``: (run_id, paper_id, field, text)."""
    wanted = papers.select("run_id", "paper_id", F.explode(F.array(*[F.lit(f) for f in NOTE_FIELDS])).alias("field"))
    return wanted.join(notes, ["run_id", "paper_id", "field"], "left").filter(is_blank(F.col("text"))).select("run_id", "paper_id", "field")


def check_notes(papers: DataFrame, notes: DataFrame) -> DataFrame:
    empty = empty_notes(papers, notes).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    runs = papers.select("run_id").distinct().join(empty, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return runs.select("run_id", *check_row("pmrl_notes_nonempty", "HARD", F.col("n") == 0, F.concat(F.lit("empty="), F.col("n").cast("string"))))


def check_structure(reports: DataFrame) -> DataFrame:
    """Title line, sections exactly 1 to 5 in order, at least ``n_papers`` paper blocks."""
    text = strip_fences(F.col("text"))
    numbers = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^##\s+([1-5])\s*[.)]"), F.lit(1)), ",")
    blocks = paper_blocks(report_units(reports)).groupBy("report_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    r = reports.join(blocks, "report_id", "left").select(
        "report_id", "n_papers", text.rlike(r"(?m)^#\s+\S").alias("h1"), numbers.alias("numbers"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
    ok = F.col("h1") & (F.col("numbers") == "1,2,3,4,5") & (F.col("n_blocks") >= F.col("n_papers"))
    detail = F.concat_ws("; ", F.when(~F.col("h1"), "no H1"), F.when(F.col("numbers") != "1,2,3,4,5", F.concat(F.lit("sections "), "numbers")),
                         F.when(F.col("n_blocks") < F.col("n_papers"), F.concat(F.lit("blocks "), F.col("n_blocks").cast("string"))))
    return r.select("report_id", *check_row("report_structure", "HARD", ok, detail))


def check_context(reports: DataFrame) -> DataFrame:
    body = report_units(reports).filter("number = 3").select("report_id", word_count(F.col("body")).alias("n"))
    r = reports.select("report_id").join(body, "report_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return r.select("report_id", *check_row("context_section", "HARD", F.col("n") > 0, F.concat(F.lit("words="), F.col("n").cast("string"))))


def check_bullets(reports: DataFrame) -> DataFrame:
    """Every paper block has the three labelled sub-bullets."""
    has = lambda p: F.col("text").rlike(rf"(?mi)^[ \t]*[-*•][ \t]*\**[ \t]*(?:{p})[ \t]*\**[ \t]*:")
    lacking = sum((F.when(has(p), 0).otherwise(1) for p in RESULT_LABELS.values()), F.lit(0))
    blocks = paper_blocks(report_units(reports)).groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.sum(lacking).alias("lacking"))
    r = reports.select("report_id").join(blocks, "report_id", "left")
    ok = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("lacking", F.lit(0)) == 0)
    return r.select("report_id", *check_row("results_format", "HARD", ok, F.concat(F.lit("missing="), F.coalesce("lacking", F.lit(-1)).cast("string"))))


def table_value_cells(block: Column) -> Column:
    """Method and baseline cells of the Markdown tables in one block (header rows left out)."""
    rows = F.split(block, "\n")
    is_row = lambda l: l.rlike(r"^\s*\|") & ~l.rlike(r"^\s*\|[\s:|-]+\|\s*$")
    at = F.sequence(F.lit(0), F.size(rows) - 1)
    body = F.filter(at, lambda i: is_row(F.get(rows, i)) & (i > 0) & F.coalesce(F.get(rows, i - 1).rlike(r"^\s*\|"), F.lit(False)))
    cells = F.transform(body, lambda i: F.slice(F.split(F.regexp_replace(strip(F.get(rows, i)), r"^\|+|\|+$", ""), r"(?<!\\)\|"), 3, 100))
    return F.transform(F.flatten(cells), lambda c: F.regexp_replace(strip(c), r"(?<=\S)\s*\([^)]*\)\s*$", ""))


def check_table_numbers(reports: DataFrame, papers: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbers in result tables occur in the source of the block's paper.

    ``papers``: (report_id, pos, paper_id, arxiv_id); the paper is the one whose id is in
    the block, else the one at the block's place.
    """
    blocks = paper_blocks(report_units(reports)).select("report_id", (F.col("unit") - 1).alias("pos"), "text")
    named = blocks.join(papers.withColumnRenamed("pos", "p_pos"), "report_id").filter(
        (F.coalesce("arxiv_id", F.lit("")) != "") & F.col("text").contains(F.col("arxiv_id")))
    by_id = named.groupBy("report_id", "pos").agg(F.min_by("paper_id", "p_pos").alias("by_id"))
    owner = blocks.join(by_id, ["report_id", "pos"], "left").join(papers.select("report_id", "pos", "paper_id"), ["report_id", "pos"], "left")
    cells = owner.select("report_id", "pos", F.coalesce("by_id", "paper_id").alias("paper_id"), F.explode(table_value_cells(F.col("text"))).alias("cell"))
    nums = cells.select("report_id", "paper_id", F.explode(number_tokens(F.col("cell"))).alias("n")).select(
        "report_id", "paper_id", F.col("n.token").alias("token"), F.col("n.percent").alias("percent"))
    values = source_values(sources, ["paper_id"])
    found = nums.distinct().withColumn("value", F.explode(number_variants(F.col("token"), F.col("percent")))).join(
        values, ["paper_id", "value"], "left_semi").select("report_id", "paper_id", "token", "percent").distinct().withColumn("ok", F.lit(1))
    counts = nums.join(found, ["report_id", "paper_id", "token", "percent"], "left").groupBy("report_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("ok").isNull()).alias("bad"))
    r = reports.select("report_id").join(counts, "report_id", "left").select(
        "report_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("bad", F.lit(0)).alias("bad"))
    return r.select("report_id", *check_row("results_table_numbers", "HARD", F.col("bad") == 0, F.concat(
        F.lit("checked="), F.col("checked").cast("string"), F.lit(" bad="), F.col("bad").cast("string"))))


def missing_links(reports: DataFrame, papers: DataFrame) -> DataFrame:
    """(report_id, arxiv_id) whose canonical link is not in the report text."""
    link = F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id"))
    return papers.filter(F.coalesce("arxiv_id", F.lit("")) != "").join(reports.select("report_id", "text"), "report_id").filter(
        ~F.col("text").contains(link)).select("report_id", "arxiv_id")


def internal_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n): lines outside fences that look like internal notes."""
    ls = lines(df, key, strip_fences(F.col(text)))
    bare = strip(F.regexp_replace("line", r"^[ \-*•>_\t]+", ""))
    return ls.groupBy(key).agg(F.count_if(bare.rlike(INTERNAL_LINE)).alias("n"))


def band_words(pairs: DataFrame, low: float = RATIO_LOW, high: float = RATIO_HIGH) -> DataFrame:
    """Word-count ratio of (base_text, cand_text) per row; rows without base words pass."""
    b, c = word_count(F.col("base_text")), word_count(F.col("cand_text"))
    return pairs.withColumn("base_words", b.cast("long")).withColumn("cand_words", c.cast("long")).withColumn(
        "ok", (F.col("base_words") == 0) | (F.col("cand_words") / F.nullif("base_words", F.lit(0))).between(low, high)).withColumn(
        "ok", F.coalesce("ok", F.lit(True)))


def band_length(pairs: DataFrame, low: float = RATIO_LOW, high: float = RATIO_HIGH) -> DataFrame:
    b, c = F.length(F.coalesce("base_text", F.lit(""))), F.length(F.coalesce("cand_text", F.lit("")))
    ratio = F.when(b > 0, c / b).otherwise(0.0)
    return pairs.withColumn("ratio", ratio).withColumn("ok", F.col("ratio").between(low, high))


def band_grounding(base: DataFrame, cand: DataFrame, key: str, drop: float = GROUNDING_DROP) -> DataFrame:
    b = base.select(key, F.col("ratio").alias("base_ratio"))
    return cand.select(key, F.col("ratio").alias("cand_ratio")).join(b, key).withColumn(
        "ok", F.round(F.col("cand_ratio"), 9) >= F.round(F.col("base_ratio") - drop, 9))


def band_equations(reports: DataFrame, limit: int = MAX_EQUATIONS) -> DataFrame:
    """At most ``limit`` display equations per paper block; without blocks per paper on average."""
    blocks = paper_blocks(report_units(reports)).groupBy("report_id").agg(F.max(display_equations(F.col("text"))).alias("most"))
    r = reports.join(blocks, "report_id", "left")
    whole = display_equations(F.col("text")) <= limit * F.greatest(F.col("n_papers"), F.lit(1))
    return r.select("report_id", F.coalesce(F.col("most"), display_equations(F.col("text"))).alias("most"),
                    F.when(F.col("most").isNotNull(), F.col("most") <= limit).otherwise(whole).alias("ok"))


def verdict(checks: DataFrame, by: str, strict: bool = False, strict_latency: bool = False) -> DataFrame:
    """(by, failed): any FAIL; latency only when asked; WARN of the quality group turns FAIL when strict."""
    status = F.when(F.lit(strict) & (F.col("grp") == "QUALITY") & (F.col("status") == "WARN"), "FAIL").otherwise(F.col("status"))
    bad = (status == "FAIL") & ((F.col("grp") != "LATENCY") | F.lit(strict_latency))
    return checks.groupBy(by).agg(F.max(bad).alias("failed"))


def style_metrics(reports: DataFrame, key: str = "report_id") -> DataFrame:
    """Sentence, bullet and paragraph counts of the prose of each report.

    Lines of one report are grouped by a running count of breaks; a report is one row.
    """
    text = F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```", ""), r"(?s)\$\$.*?\$\$", "")
    text = F.regexp_replace(text, r"(?ms)^##\s+5\s*[.)].*\z", "")
    ls = reports.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).withColumn(
        "line", F.regexp_replace("raw", r"\s+$", "")).withColumn("s", strip(F.col("line")))
    gap = (F.col("s") == "") | F.col("s").startswith("#") | F.col("s").startswith("|") | F.col("s").startswith("<!--") | F.col(
        "line").rlike(r"^\s*\*[^*]+\*\s*$") | F.col("s").contains("http") | F.col("line").rlike(TAIL_LABEL)
    ls = ls.withColumn("cls", F.when(gap, "gap").when(F.col("line").rlike(BULLET), "bullet").when(F.col("raw").startswith("  "), "indent").otherwise("plain"))
    page = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("any_bullet", F.max(F.col("cls") == "bullet").over(page)).withColumn(
        "cls", F.when(F.col("cls") == "indent", F.when(F.col("any_bullet"), "more").otherwise("plain")).otherwise(F.col("cls")))
    ls = ls.withColumn("bullet_id", F.sum(F.when(F.col("cls") == "bullet", 1).otherwise(0)).over(page)).withColumn(
        "para_id", F.sum(F.when(F.col("cls").isin("gap", "bullet"), 1).otherwise(0)).over(page))
    is_b = F.col("cls").isin("bullet", "more")
    piece = F.when(F.col("cls") == "bullet", F.regexp_replace("line", BULLET, "")).otherwise(F.col("s"))
    units = ls.filter("cls <> 'gap'").withColumn("kind", F.when(is_b, "b").otherwise("p")).withColumn(
        "uid", F.when(is_b, F.col("bullet_id")).otherwise(F.col("para_id"))).groupBy(key, "kind", "uid").agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"]), " ").alias("unit"))
    sentences = F.filter(F.transform(F.split(F.regexp_replace("unit", "[*_`]", ""), SENTENCE_END), strip), lambda x: x != "")
    lengths = F.transform(sentences, word_count)
    units = units.withColumn("lens", lengths)
    total = F.aggregate("lens", F.lit(0), lambda a, x: a + x)
    per = units.groupBy(key).agg(
        F.sum(F.size("lens")).alias("sentences"), F.sum(total).alias("words"),
        F.sum(F.size(F.filter("lens", lambda n: n > 25))).alias("long"), F.count_if(F.col("kind") == "b").alias("bullets"),
        F.count_if(F.col("kind") == "p").alias("paragraphs"), F.sum(F.regexp_count("unit", F.lit(PASSIVE))).cast("long").alias("passive"),
        F.count_if((F.col("kind") == "p") & (F.size("lens") > 3)).alias("long_paragraphs"))
    share = lambda a, b, digits, scale=1: F.round(scale * F.col(a) / F.nullif(F.col(b), F.lit(0)), digits)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return reports.select(key).join(per, key, "left").select(
        key, n("sentences"), F.coalesce(share("words", "sentences", 1), F.lit(0.0)).alias("mean_words"),
        F.coalesce(share("long", "sentences", 1, 100), F.lit(0.0)).alias("pct_long"), n("bullets"), n("paragraphs"),
        share("bullets", "paragraphs", 2).alias("bullet_ratio"), n("passive"), n("long_paragraphs"))
