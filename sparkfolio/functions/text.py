"""Text column expressions: whitespace, accents, titles, clipping, counting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# White space as Unicode defines it, for patterns that are ASCII-only in Java.
SPACE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
INVISIBLE = "[\u200b-\u200f\u2060-\u2064\ufeff]"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\u2600-\\u26FF\\u2700-\\u27BF\\uFE0F]"
# Words whose presence marks a request as Vietnamese.
VIETNAMESE_MARKERS = (
    "tôi", "mình", "này", "bài báo", "tìm", "cho tôi", "hãy", "viết", "báo cáo",
    "về", "trong", "các", "điều", "nghiên cứu", "mô hình", "học", "các bài",
    "điều tra", "ngôn ngữ", "toán", "đại học", "tiếng việt",
    "tổng hợp", "phân tích", "giải thích", "đánh giá",
)


def _accent_table() -> tuple[str, str]:
    """Letters whose compatibility form is one base character plus combining marks."""
    source, target = [], []
    for start, end in ((0xA0, 0x250), (0x1E00, 0x1F00)):
        for code in range(start, end):
            base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0] != chr(code):
                source.append(chr(code))
                target.append(base[0])
    marks = "".join(chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code)))
    return "".join(source) + marks, "".join(target)


ACCENTED, PLAIN = _accent_table()


def literal_map(pairs: dict) -> Column:
    """Constant text map from two literals (folded once by the optimizer)."""
    keys, values = "\u0001".join(pairs), "\u0001".join(str(v) for v in pairs.values())
    return F.map_from_arrays(F.split(F.lit(keys), "\u0001"), F.split(F.lit(values), "\u0001"))


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean_inline(c: Column) -> Column:
    """Squeeze after dropping invisible characters."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, ""))


def compact(c: Column) -> Column:
    """Short message form: no emoji, single blanks."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), EMOJI, ""))


def clean_block(c: Column) -> Column:
    """Keep line breaks, clean everything else (section text)."""
    t = F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), "\u00a0", " ")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{2,}", "\n")
    return F.trim(F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+$", ""))


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def casefold(c: Column) -> Column:
    """Caseless form; the sharp s is the one common letter that ``lower`` leaves."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def flat(c: Column) -> Column:
    """Caseless and squeezed, for containment checks."""
    return squeeze(casefold(F.coalesce(c, F.lit(""))))


def fold_accents(c: Column) -> Column:
    """Drop accents from Latin letters (see ``nfkd_fold`` for the full form)."""
    return F.translate(c, ACCENTED, PLAIN)


def index_tokens(c: Column) -> Column:
    """Lower-case accent-free word tokens, as the full-text index sees them."""
    return F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def normalize_title(c: Column, drop_math: bool = False) -> Column:
    """Accent-free lower-case alphanumeric words.  ``drop_math`` removes ``$...$`` first."""
    t = F.coalesce(c, F.lit(""))
    if drop_math:
        t = F.regexp_replace(t, r"\$[^$]*\$", " ")
    t = fold_accents(t)
    t = F.lower(F.regexp_replace(t, r"\\[a-zA-Z]+\*?", " "))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """White-space tokens; an empty text has none."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def title_jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard of two normalized titles, 0 when a side is empty."""
    # Each side is normalized once, not once for every size and overlap.
    tokens = lambda c: F.array_distinct(F.filter(F.split(normalize_title(c), " "), lambda w: w != ""))
    both = lambda s: F.size(F.array_intersect(s["left"], s["right"]))
    part = lambda s, n: F.when((F.size(s["left"]) == 0) | (F.size(s["right"]) == 0), F.lit(0.0)).otherwise(
        n / (F.size(s["left"]) + F.size(s["right"]) - n))
    return bound(F.struct(tokens(a).alias("left"), tokens(b).alias("right")), lambda s: bound(both(s), lambda n: part(s, n)))


def clip(c: Column, limit: int, squeezed: bool = True) -> Column:
    """Cut to ``limit`` characters with an ellipsis."""
    t = squeeze(F.coalesce(c, F.lit(""))) if squeezed else strip(F.coalesce(c, F.lit("")))
    cut = F.regexp_replace(F.substring(t, 1, limit - 1), SPACE + "+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def strip_fences(c: Column) -> Column:
    """Remove fenced code blocks."""
    return F.regexp_replace(c, r"(?ms)^```.*?^```[ \t]*$", "")


def display_equations(c: Column) -> Column:
    """Pairs of ``$$``."""
    return F.floor(F.regexp_count(c, F.lit(r"\$\$")) / 2).cast("long")


def has_table(c: Column) -> Column:
    return c.rlike(r"(?m)^\s*\|.*\|\s*\n\s*\|[\s:|-]*-[\s:|-]*\|")


def detect_language(c: Column) -> Column:
    sample = F.lower(F.coalesce(c, F.lit("")))
    pattern = "|".join(VIETNAMESE_MARKERS)
    return F.when(sample.rlike(pattern), F.lit("Vietnamese")).otherwise(F.lit("English"))


def first_heading(c: Column, fallback: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?m)^#[ \t]+([^\r\n]+?)[ \t]*$", 1)
    return F.when(found == "", fallback).otherwise(F.substring(strip(found), 1, 240))


# Prefixes that mark a failure notice instead of a report.
REPORT_ERROR_MARKERS = ("error generating final report", "research workflow execution notice")


def is_report(c: Column) -> Column:
    text = casefold(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^[ \t\r\n*_`#(]+", ""))
    bad = F.lit(False)
    for marker in REPORT_ERROR_MARKERS:
        bad = bad | text.startswith(marker)
    return ~is_blank(c) & ~bad


# Survey wording of titles.
ARTICLES = ("a", "an", "the")
SURVEY_ADJECTIVES = ("comprehensive", "systematic", "brief", "critical", "short", "recent", "detailed", "in-depth", "extensive", "thorough",
                     "concise", "structured", "focused", "scoping", "narrative", "bibliometric", "state-of-the-art", "current", "up-to-date",
                     "quick", "holistic", "unified", "broad")
SURVEY_NAMES = ("systematic literature review", "literature review", "systematic review", "systematic mapping study", "systematic mapping",
                "survey", "surveys")
OVERVIEW_NAMES = ("review", "overview")
JOINING_WORDS = ("and", "&")
SURVEY_COMPANIONS = ("taxonomy", "outlook", "perspective", "perspectives", "challenges", "analysis", "future directions", "open problem",
                     "open problems", "tutorial", "roadmap", "prospect", "prospects", "opportunities")
SURVEY_PREPOSITIONS = ("on", "of", "for", "in", "about", "to", "into")
LOOSE_WORDS = ("and", "of", "on", "for", "in", "the", "a", "an", "with")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def _names_at(words: Column, at: Column, names: tuple[str, ...]) -> Column:
    """Number of words of the longest of ``names`` that starts at word ``at``; 0 when none does."""
    found = F.lit(0)
    for n in sorted({len(name.split()) for name in names}):
        here = F.array_join(F.slice(words, at, n), " ")
        found = F.when(here.isin(*[name for name in names if len(name.split()) == n]), n).otherwise(found)
    return found


def _run_of(words: Column, at: Column, known: tuple[str, ...]) -> Column:
    """Number of words from ``at`` on that are all in ``known``."""
    rest = F.transform(F.slice(words, at, F.size(words)), lambda w: w.isin(*known))
    first = F.array_position(rest, F.lit(False))
    return F.when(first == 0, F.size(rest)).otherwise(first - 1).cast("int")


def _phrase_at(words: Column, at: Column) -> Column:
    """Number of words of the survey phrase that starts at word ``at`` (0: none).

    An article and adjectives may stand before a survey's name; a review or overview needs one of them.  What is
    joined to the name by "and", and one preposition, belong to the phrase.
    """
    def named(state: Column) -> Column:
        start = state["start"]
        plain = F.greatest(_names_at(words, start, SURVEY_NAMES), F.when(start > at, _names_at(words, start, OVERVIEW_NAMES)).otherwise(0))
        # an adjective can be the first word of a name
        earlier = F.when(state["adjectives"] > 0, _names_at(words, start - 1, SURVEY_NAMES)).otherwise(0)
        return F.when(plain > 0, start + plain).when(earlier > 0, start - 1 + earlier).otherwise(0)

    def companions(end: Column) -> Column:
        step = lambda e, _: bound(F.when(F.get(words, e - 1).isin(*JOINING_WORDS), _names_at(words, e + 1, SURVEY_COMPANIONS)).otherwise(0),
                                  lambda n: F.when(n > 0, e + 1 + n).otherwise(e))
        return F.aggregate(words, end, step)

    article = F.when(F.get(words, at - 1).isin(*ARTICLES), 1).otherwise(0)
    state = bound(at + article, lambda first: bound(_run_of(words, first, SURVEY_ADJECTIVES), lambda n: F.struct(n.alias("adjectives"), (first + n).alias("start"))))
    end = bound(bound(state, named), lambda e: F.when(e > 0, companions(e)).otherwise(0))
    return bound(end, lambda e: F.when(e > 0, e + F.when(F.get(words, e - 1).isin(*SURVEY_PREPOSITIONS), 1).otherwise(0) - at).otherwise(0))


def topic_query(title: Column) -> Column:
    """Topic of a survey title: survey wording, separators and dangling connectors removed.

    Fewer than two words left: the title without its separators.
    """
    original = squeeze(F.coalesce(title, F.lit("")))
    separator = lambda t: t.rlike("^(?:[:;|]|[-\u2013\u2014]+)$")
    # a word that is only punctuation, or a connector, does not stand at either end
    loose = lambda t: F.regexp_replace(F.lower(t), "^[,.&\u2013\u2014-]+|[,.&\u2013\u2014-]+$", "").isin("", *LOOSE_WORDS)

    def unworded(tokens: Column) -> Column:
        """Words outside survey phrases, read from left to right."""
        def kept(words: Column) -> Column:
            lengths = F.transform(F.sequence(F.lit(1), F.size(words)), lambda at: _phrase_at(words, at))
            spans = F.aggregate(lengths, F.struct(F.lit(0).alias("skip"), F.array().cast("array<boolean>").alias("out")), lambda s, n: F.struct(
                F.when(s["skip"] > 0, s["skip"] - 1).when(n > 0, n - 1).otherwise(0).alias("skip"),
                F.concat(s["out"], F.array((s["skip"] == 0) & (n == 0))).alias("out")))["out"]
            return bound(spans, lambda keep: F.filter(tokens, lambda _, i: F.get(keep, i)))
        return F.when(F.size(tokens) == 0, tokens).otherwise(bound(F.transform(tokens, lambda t: F.lower(t)), kept))

    def firm(left: Column) -> Column:
        ends = F.aggregate(left, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"), F.lit(0).alias("high")), lambda s, t: F.struct(
            (s["at"] + 1).alias("at"), F.when((s["low"] == 0) & ~loose(t), s["at"] + 1).otherwise(s["low"]).alias("low"),
            F.when(loose(t), s["high"]).otherwise(s["at"] + 1).alias("high")))
        return bound(ends, lambda e: F.when(e["low"] == 0, F.lit("")).otherwise(F.array_join(F.slice(left, F.greatest(e["low"], F.lit(1)), e["high"] - e["low"] + 1), " ")))

    def topic(tokens: Column) -> Column:
        text = bound(F.filter(unworded(tokens), lambda t: ~separator(t)), firm)
        return F.regexp_replace(text, "^[ ,.&\u2013\u2014-]+|[ ,.&\u2013\u2014-]+$", "")

    plain = squeeze(F.regexp_replace(original, "[:;|]", " "))
    tokens = F.regexp_extract_all(original, F.lit("[:;|]|[^\\s:;|]+"), F.lit(0))
    return bound(bound(tokens, topic), lambda text: F.when(word_count(text) < 2, plain).otherwise(text))
