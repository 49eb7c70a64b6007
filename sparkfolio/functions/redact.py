"""Masking of credentials, key-shaped tokens, local paths and tracebacks; link checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkfolio.functions.text import strip

# Shapes that must not leave the system, and hosts that may be linked.
_KEYWORD = r"(?i)(api[_ -]?key|authorization|bearer|access[_ -]?token|secret)\s*[:=]\s*[^\s,;]+"
_KEY_TOKEN = r"(?i)\b(sk-[A-Za-z0-9_-]{8,}|zai-[A-Za-z0-9_-]{8,})\b"
_URL_OR_PATH = (
    r"(?i)(https?://[^\s,;}\])]+)|(?<![A-Za-z0-9_])(?:[A-Za-z]:[\\/]|/(?:tmp|home|var|mnt|workspace)/)[^\s,;}\])]+"
)
LINK_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org", "github.com", "www.github.com")
PAPER_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")


def _mask_paths(text: Column) -> Column:
    # One pass over URLs and paths: a URL match keeps itself ($1), a path match has no
    # group 1 and is replaced, so path-like parts inside a URL stay as they are.
    marked = F.regexp_replace(text, _URL_OR_PATH, "\u0001$1\u0002")
    return F.translate(F.replace(marked, F.lit("\u0001\u0002"), F.lit("[path omitted]")), "\u0001\u0002", "")


def redact(c: Column) -> Column:
    """Mask credentials and local paths; keep only the last line of a traceback."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), _KEYWORD, "$1=[REDACTED]")
    text = F.regexp_replace(text, _KEY_TOKEN, "[REDACTED]")
    text = _mask_paths(text)
    trimmed = F.regexp_replace(text, r"[\r\n]$", "")
    last = F.element_at(F.split(trimmed, r"\r\n|\r|\n"), -1)
    return F.when(F.lower(text).contains("traceback (most recent call last)"), last).otherwise(text)


def safe_text(c: Column, limit: int = 500) -> Column:
    return F.substring(redact(strip(F.coalesce(c, F.lit("")))), 1, limit)


def _authority(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_host(raw: Column) -> Column:
    """Lower-case host without user info, port or trailing dot."""
    host = F.regexp_replace(F.regexp_replace(_authority(raw), r"^.*@", ""), r":[^:\]]*$", "")
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def safe_link(c: Column, hosts: tuple[str, ...] = LINK_HOSTS) -> Column:
    """Canonical https link when scheme, host and port are allowed, else NULL."""
    raw = strip(F.coalesce(c, F.lit("")))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = _authority(raw)
    port = F.regexp_extract(authority, r":([^:@\]]*)$", 1)
    ok = (scheme.isin("http", "https") & url_host(raw).isin(*hosts) & ~authority.contains("@")
          & port.isin("", "80", "443"))
    rest = F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.when(ok, F.substring(F.concat(F.lit("https://"), url_host(raw), rest), 1, 2048))


def url_base(c: Column) -> Column:
    """Part before the query, 200 characters."""
    return F.substring(F.substring_index(F.coalesce(c, F.lit("")), "?", 1), 1, 200)


def split_inputs(c: Column) -> Column:
    """Inputs of one form field: a JSON list, or a comma / newline list."""
    text = strip(F.coalesce(c, F.lit("")))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    parts = F.filter(F.transform(F.split(text, r"[,\n]"), strip), lambda x: x != "")
    return F.coalesce(F.when(F.size(listed) >= 0, F.filter(F.transform(listed, strip), lambda x: x != "")), parts)


def classify_input(c: Column) -> Column:
    """Struct (value, reason): canonical paper id, or why the input is refused."""
    text = strip(F.coalesce(c, F.lit("")))
    has_scheme = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!$)") & ~text.rlike(r"(?i)^arxiv:\d")
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    from_path = F.regexp_extract(path, r"(?i)^/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?/?$", 1)
    bare = text.rlike(r"(?i)^(?:arxiv:)?\d{4}\.\d{4,5}(?:v\d+)?$")
    value = (F.when((text == "") | (F.length(text) > 2048), None).when(bare, text)
             .when(has_scheme & safe_link(text, PAPER_HOSTS).isNotNull() & (from_path != ""), from_path))
    reason = (F.when((text == "") | (F.length(text) > 2048), "empty_or_long").when(bare, "ok")
              .when(has_scheme & safe_link(text, PAPER_HOSTS).isNull(), "host_not_allowed")
              .when(has_scheme & (from_path == ""), "not_one_paper").when(has_scheme, "ok")
              .when(text.contains("/") | text.contains("\\") | text.startswith(".") | F.lower(text).endswith(".pdf"),
                    "local_path").otherwise("not_an_id"))
    return F.struct(value.alias("value"), reason.alias("reason"))
