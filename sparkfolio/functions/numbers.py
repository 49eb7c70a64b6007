"""Numbers in text: readings, decimals, deltas, coercion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkfolio.functions.text import strip, strip_fences

# What counts as a number token.
DECIMAL_TOKEN = r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?<!\w)\d+(?:[.,]\d+)?|(?<![\w.\d])\.\d+"
NUMBER_TOKEN = r"(?<![\w.])([+-]?(?:\d{1,3}(?:,\d{3})+|\d+(?:[.,]\d+)?))(\s*%)?"
THOUSANDS = r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$"
WIDE = "decimal(38,12)"
MAX_DURATION_MS = 7 * 24 * 60 * 60 * 1000


def canonical(value: Column) -> Column:
    """Plain text of a decimal without trailing zeros."""
    text = value.cast("string")
    text = F.when(text.contains("E"), F.format_number(value, 12)).otherwise(text)
    text = F.replace(text, F.lit(","), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def decimal_tokens(text: Column) -> Column:
    """Array of canonical unsigned values in a text (commas read as thousands or decimal point)."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DECIMAL_TOKEN), F.lit(0))
    plain = F.transform(raw, lambda t: F.when(
        t.rlike(THOUSANDS), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit("."))))
    values = F.transform(plain, lambda t: canonical(t.try_cast(WIDE)))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def number_variants(token: Column, percent: Column) -> Column:
    """All canonical readings of one token: decimal comma, thousands, percent."""
    t = F.regexp_replace(token, r"^[+-]+", "")
    readings = F.array(
        F.replace(t, F.lit(","), F.lit(".")),
        F.when(t.rlike(r"^\d{1,3}(?:,\d{3})+$"), F.replace(t, F.lit(","), F.lit(""))),
        F.when(t.rlike(r"^\d{1,3}\.\d{3}$"), F.replace(t, F.lit("."), F.lit(""))),
    )
    values = F.transform(readings, lambda r: r.try_cast(WIDE))
    plain = F.transform(values, canonical)
    share = F.transform(values, lambda v: F.when(percent, canonical((v / 100).cast(WIDE))))
    return F.array_distinct(F.filter(F.concat(plain, share), lambda v: v.isNotNull()))


def scrub_for_numbers(text: Column) -> Column:
    """Drop code, math, links, ids and list numbers before numbers are read."""
    t = strip_fences(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?s)\$\$.*?\$\$", " ")
    t = F.regexp_replace(t, r"\$[^$\n]*\$", " ")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, r"\b\d{4}\.\d{4,5}(?:v\d+)?\b", " ")
    return F.regexp_replace(t, r"(?m)^\s*(?:#+\s*)?\d+[.)]\s+", "")


def number_tokens(text: Column) -> Column:
    """Array of (token, percent) in reading order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_TOKEN), F.lit(0))
    return F.transform(found, lambda m: F.struct(
        F.regexp_replace(m, r"\s*%$", "").alias("token"), m.endswith("%").alias("percent")))


def report_numbers(text: Column) -> Column:
    """Number tokens worth grounding: bare single digits are skipped."""
    return F.filter(number_tokens(scrub_for_numbers(text)), lambda n: ~n["token"].rlike(r"^\d$") | n["percent"])


def source_numbers(text: Column) -> Column:
    """Every reading of every number in a source text."""
    return F.array_distinct(F.flatten(F.transform(
        number_tokens(text), lambda n: number_variants(n["token"], F.lit(False)))))


def parse_number(text: Column) -> Column:
    """First signed number of a value text."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\u2212"), F.lit("-"))
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")
    return F.nullif(F.regexp_extract(t, r"[-+]?\d+(?:\.\d+)?", 0), F.lit(""))


def single_number(text: Column) -> Column:
    """The number (as text) of a plain value; NULL for compound values.  Error bars are dropped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*(?:±|\+/-|\+-)\s*[\d.,]+\s*%?", "")
    return F.when(F.regexp_count(t, F.lit(r"\d+(?:[.,]\d+)?")) == 1, parse_number(t))


def delta_text(left: Column, right: Column) -> Column:
    """Signed difference of two ``single_number`` texts with the larger number of decimals.

    Pass columns, not expressions: both are read several times.  ``""`` when one is NULL.
    """
    places = lambda c: F.length(F.regexp_extract(c, r"\.(\d+)$", 1))
    n = F.greatest(places(left), places(right))
    diff = left.try_cast(WIDE) - right.try_cast(WIDE)
    digits = F.abs(diff).cast("decimal(38,12)").cast("string")
    whole, part = F.substring_index(digits, ".", 1), F.substring_index(digits, ".", -1)
    body = F.when(n > 0, F.concat(whole, F.lit("."), F.rpad(F.substring(part, F.lit(1), n), n, F.lit("0")))).otherwise(whole)
    return F.coalesce(F.concat(F.when(diff < 0, "-").otherwise("+"), body), F.lit(""))


def nonneg_int(text: Column) -> Column:
    """Whole number from text; booleans, negatives and non-numbers are NULL."""
    n = text.try_cast("bigint")
    return F.when(~F.lower(text).isin("true", "false") & (n >= 0), n)


def duration_ms(text: Column) -> Column:
    """Milliseconds, capped at seven days; negatives, booleans and non-finite values are NULL."""
    v = text.try_cast("double")
    ok = ~F.lower(text).isin("true", "false") & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))
    return F.when(ok, F.least(F.floor(F.least(v, F.lit(1e15))), F.lit(MAX_DURATION_MS)).cast("long"))


def published_label(c: Column) -> Column:
    """``YYYY-MM...`` becomes ``MM/YYYY``; other text stays."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike(r"^\d{4}-\d{2}"), F.concat(F.substring(t, 6, 2), F.lit("/"), F.substring(t, 1, 4))).otherwise(t)


def bibtex(title: Column, authors: Column, published: Column, arxiv_id: Column) -> Column:
    """Citation entry; ``authors`` is an array of names."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown Paper")), r"\s+", " "))
    known = F.coalesce(F.size(authors), F.lit(0)) > 0
    names = F.when(known, F.array_join(authors, " and ")).otherwise("Unknown Author")
    year = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(published, F.lit("")), r"(\d{4})", 1), F.lit("")), F.lit("2024"))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-zA-Z]", "")
    last = F.when(known, F.element_at(F.split(strip(F.get(authors, 0)), r"\s+"), -1)).otherwise("paper")
    word = F.coalesce(F.nullif(F.get(F.split(strip(F.coalesce(title, F.lit(""))), r"\s+"), 0), F.lit("")), F.lit("research"))
    head = F.concat(F.lit("@article{"), letters(last), year, letters(word), F.lit(",\n  title={"), clean,
                    F.lit("},\n  author={"), names, F.lit("},\n  journal={"))
    aid = F.regexp_replace(strip(F.coalesce(arxiv_id, F.lit(""))), r"v\d+$", "")
    preprint = F.concat(head, F.lit("arXiv preprint arXiv:"), aid, F.lit("},\n  year={"), year, F.lit("},\n  eprint={"), aid,
                        F.lit("},\n  archivePrefix={arXiv},\n  primaryClass={cs.AI}\n}"))
    other = F.concat(head, F.lit("Research Paper Archive},\n  year={"), year, F.lit("}\n}"))
    return F.when(aid != "", preprint).otherwise(other)
