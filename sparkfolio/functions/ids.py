"""Identifier column expressions: paper ids, DOIs, keys, years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkfolio.functions.text import strip

# The two shapes of a paper id, and where ids show up in text.
NEW_ID = r"\d{4}\.\d{4,5}"
OLD_ID = r"[a-z][a-z.\-]*/\d{7}"
ID_IN_TEXT_NEW = r"(?i)(?:arxiv(?:\.org)?[\s:./]*(?:abs/|pdf/)?|\babs/|\bpdf/)(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)"
ID_IN_TEXT_OLD = (
    r"(?i)(?:arxiv(?:\.org)?[\s:./]*(?:abs/|pdf/)?|\babs/|\bpdf/)([a-z][a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?!\d)"
)
DOI_IN_TEXT = r"(?i)\b(10\.\d{4,9}/[^\s<>\"']+)"
ARXIV_DOI = rf"(?i)^10\.48550/arxiv\.({NEW_ID}|{OLD_ID})(?:v\d+)?$"


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_arxiv_id(c: Column) -> Column:
    """Id without prefix and version, NULL when malformed."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^arxiv\s*:\s*", "")
    ok = text.rlike(rf"(?i)^(?:{NEW_ID}|{OLD_ID})(?:v\d+)?$")
    return F.when(ok, F.regexp_replace(text, r"(?i)v\d+$", ""))


def clean_result_id(c: Column) -> Column:
    """Benchmark form of a result id: lower case, no key prefix, no version."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, "^arxiv_", ""), r"v\d+$", "")


def clean_reference_id(c: Column) -> Column:
    """Gold-set form of an explicit id: lower case, no version, NULL when empty."""
    return _null_if_empty(F.regexp_replace(F.lower(strip(c)), r"v\d+$", ""))


def normalize_doi(c: Column) -> Column:
    """Bare lower-case DOI, ``""`` when absent."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(text, r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(text, r"[.,;)]+$", "")


def trim_doi(c: Column) -> Column:
    """Gold-set form of a DOI: only trimmed and lower-cased, NULL when blank."""
    return _null_if_empty(F.lower(strip(c)))


def arxiv_id_of_doi(doi: Column) -> Column:
    """Paper id carried by an arXiv DOI, else NULL."""
    return _null_if_empty(F.regexp_extract(doi, ARXIV_DOI, 1))


def find_arxiv_id(text: Column, urls: Column | None = None) -> Column:
    """First id, URLs before text, new style before old style inside each source."""
    def one(source: Column) -> Column:
        new = _null_if_empty(F.regexp_extract(source, ID_IN_TEXT_NEW, 1))
        old = _null_if_empty(F.lower(F.regexp_extract(source, ID_IN_TEXT_OLD, 1)))
        return F.coalesce(new, old)

    in_text = one(F.coalesce(text, F.lit("")))
    if urls is None:
        return in_text
    in_urls = F.get(F.filter(F.transform(urls, one), lambda x: x.isNotNull()), 0)
    return F.coalesce(in_urls, in_text)


def find_doi(text: Column, urls: Column | None = None) -> Column:
    """First DOI, URLs (percent-decoded) before text."""
    def one(source: Column) -> Column:
        found = F.regexp_extract(source, DOI_IN_TEXT, 1)
        return _null_if_empty(F.regexp_replace(found, r"[.,;:)\]}>]+$", ""))

    in_text = one(F.coalesce(text, F.lit("")))
    if urls is None:
        return in_text
    decode = lambda u: F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u)
    in_urls = F.get(F.filter(F.transform(urls, lambda u: one(decode(u))), lambda x: x.isNotNull()), 0)
    return F.coalesce(in_urls, in_text)


def ids_in_text(text: Column) -> Column:
    """Up to five distinct ids named in a message, in order of position."""
    pattern = r"(?i:arxiv\.org/(?:abs|pdf|html)/)\d{4}\.\d{4,5}(?:v\d+)?|(?<![\w./])\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}(?:v\d+)?(?![\w.])"
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    bare = F.transform(hits, lambda h: F.regexp_extract(h, r"(\d{4}\.\d{4,5})(?:v\d+)?$", 1))
    return F.slice(F.array_distinct(bare), 1, 5)


def paper_key(c: Column) -> Column:
    """Deterministic cache key of an input identifier."""
    raw = strip(F.coalesce(c, F.lit("")))
    found = F.regexp_extract(raw, r"(\d{4}\.\d{4,5})", 1)
    slug = F.substring(F.regexp_replace(F.lower(raw), "[^A-Za-z0-9]", "_"), 1, 30)
    hashed = F.concat(F.lit("id_"), slug, F.lit("_"), F.substring(F.md5(F.encode(raw, "UTF-8")), 1, 8))
    return F.when(raw == "", F.lit("empty_key")).when(found != "", F.concat(F.lit("arxiv_"), found)).otherwise(hashed)


def versioned_key(arxiv_id: Column, paper_id: Column, title: Column) -> Column:
    """Cache key that keeps an explicit version."""
    version = F.regexp_extract(F.coalesce(arxiv_id, F.lit("")), r"(\d{4}\.\d{4,5}v\d+)", 1)
    first = F.coalesce(F.nullif(arxiv_id, F.lit("")), F.nullif(paper_id, F.lit("")), title)
    return F.when(version != "", F.concat(F.lit("arxiv_"), version)).otherwise(paper_key(first))


def is_modern_id(c: Column) -> Column:
    return c.rlike(r"^\d{4}\.\d{4,5}$")


def year_of_id(c: Column) -> Column:
    """Year from the id: 20yy for new ids; old ids turn to 19yy from 91 on."""
    new = F.regexp_extract(c, r"^(\d{2})\d{2}\.\d{4,5}$", 1)
    old = F.regexp_extract(c, r"(?i)^[a-z][a-z.\-]*/(\d{2})\d{5}$", 1)
    yy = F.expr("try_cast(null as int)")
    yy = F.nullif(old, F.lit("")).try_cast("int")
    return F.when(new != "", F.lit(2000) + F.nullif(new, F.lit("")).try_cast("int")).when(
        old != "", F.when(yy >= 91, F.lit(1900)).otherwise(F.lit(2000)) + yy
    )


def month_of_id(c: Column) -> Column:
    """First day of the month in a new-style id, NULL for months outside 1-12."""
    yy = F.nullif(F.regexp_extract(c, r"^(\d{2})(\d{2})\.\d{4,5}$", 1), F.lit("")).try_cast("int")
    mm = F.nullif(F.regexp_extract(c, r"^(\d{2})(\d{2})\.\d{4,5}$", 2), F.lit("")).try_cast("int")
    return F.when(mm.between(1, 12), F.make_date(F.lit(2000) + yy, F.when(mm.between(1, 12), mm), F.lit(1)))


def extract_id(c: Column) -> Column:
    """First id with its version inside a string, ``""`` when absent."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1)


def base_id(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


def public_identifier(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,255}$"), text)


def short_id(url: Column) -> Column:
    """Last path segment."""
    return F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1)


def first_author(authorships: Column) -> Column:
    """First non-empty display name in an array of (author: (display_name))."""
    names = F.transform(authorships, lambda a: a["author"]["display_name"])
    found = F.get(F.filter(names, lambda n: n.isNotNull() & (n != "")), 0)
    return F.coalesce(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def fingerprint(*parts: Column) -> Column:
    """Content key: sha-256 over the parts, each followed by a zero byte, 16 hex digits."""
    joined = F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\u0000")) for p in parts])
    return F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 16)
