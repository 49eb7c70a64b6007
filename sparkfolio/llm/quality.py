"""Quality rules with thresholds that follow each language and source.

Every text is measured once.  Mergeable quantile sketches (``percentile_approx``: partial
sketches per task, merged after the shuffle, so a hot source is summed up where it lies) give
quantiles of each measure by (lang, source) over the rows that pass the base rule.  A document
fails when a measure lies beyond the outer fence of its own group; measures and thresholds are
joined by group.  A small group takes the fence of its language, or of the corpus, and no fence
lies far above the bulk of the corpus, so a mostly bad source cannot raise its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import SPACE, keep_rows, mix, per_row, raw, text_hash, text_slices, words, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Measure, quantile that its fence starts from, room that a fence leaves even in a group without
#: spread.  Every measure is high in bad text; ``room`` keeps clean rows of an even group.  The
#: first three are zero in most texts, so their fences start in the upper tail.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 0.9, 0.04),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 0.95, 0.25),
    "repeat_ratio": ("n_repeat_words", "n_words", 0.95, 0.2),
    "word_length": ("word_chars", "n_words", 0.75, 1.5),
}
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``STATS`` for each text of a slice."""
    n = len(offsets) - 1
    hashes, counts = words(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    out = {"n_words": counts, "word_chars": per_row(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": per_row(SYMBOLS[data], offsets)}
    repeat = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        inside = owner[2:] == owner[:-2]
        keys = mix(mix(mix(hashes[:-2] + np.uint64(1)) + hashes[1:-1]) + hashes[2:])
        keys = mix(keys ^ mix(owner[:-2].astype(np.uint64) + np.uint64(7)))
        places = np.flatnonzero(inside)
        order = places[np.argsort(keys[places], kind="stable")]
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            repeat[order[twice] + k] = True
    out["n_repeat_words"] = np.bincount(owner[repeat], minlength=n)
    whole = data.tobytes()
    n_lines, n_dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        if counts[i]:
            lines = [x for x in whole[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(_BLANK)]
            n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    return out | {"n_lines": n_lines, "n_dup_lines": n_dup}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        got = measure(*raw(batch.column("text")))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got[k].astype(np.int64)) for k in STATS], names=[*keep, *STATS])


def text_measures(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` but ``text``, and the counts of ``STATS`` of every whole text."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_measured, ", ".join([kept, *(f"{k} long" for k in STATS)]))


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def thresholds(passed: DataFrame, fence: float = 3.0, accuracy: int = 1000, least_rows: int = 30) -> DataFrame:
    """(lang, source, highest value allowed of each measure) from measured rows that pass the
    base rule: the measure's upper quantile plus ``fence`` interquartile ranges plus its room.

    A group of under ``least_rows`` rows takes the limits of its language, or of the corpus when
    the language has too few as well.  No limit lies above the corpus's median plus 2 * ``fence``
    times the distance of its first quartile plus twice the room: these stay where they are as
    long as under half of all rows are bad, however the bad rows lie in sources.
    """
    ratios = passed.select("lang", "source", *(_ratio(a, b).alias(name) for name, (a, b, *_) in RATIOS.items()))
    quantiles = [F.percentile_approx(name, [0.25, 0.5, 0.75, tail], accuracy).alias(name) for name, (*_, tail, _) in RATIOS.items()]
    sketched = ratios.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *quantiles)
    limits = written(sketched.select("lang", "source", "level", "n", *(
        (F.col(name)[3] + F.lit(fence) * (F.col(name)[2] - F.col(name)[0]) + F.lit(room)).alias(f"most_{name}") for name, (*_, room) in RATIOS.items()), *(
        (F.col(name)[1] + F.lit(2 * fence) * (F.col(name)[1] - F.col(name)[0]) + F.lit(2 * room)).alias(f"bound_{name}") for name, (*_, room) in RATIOS.items())))
    names = [f"most_{name}" for name in RATIOS]
    by_lang = limits.filter("level = 1").select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *(F.col(x).alias(f"l_{x}") for x in names))
    corpus = limits.filter("level = 3").select(*(F.col(x).alias(f"c_{x}") for x in names), *(F.col(f"bound_{name}").alias(f"top_{name}") for name in RATIOS))
    joined = limits.filter("level = 0").join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(corpus)  # corpus: one row
    own = {name: F.when(F.col("n") >= least_rows, F.col(f"most_{name}")).when(F.col("l_n") >= least_rows, F.col(f"l_most_{name}")).otherwise(F.col(f"c_most_{name}")) for name in RATIOS}
    return joined.select("lang", "source", *(F.least(own[name], F.col(f"top_{name}")).alias(f"most_{name}") for name in RATIOS))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, fence: float = 3.0, accuracy: int = 1000, least_rows: int = 30,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Counts, base rule and verdict of every document.

    Returns doc_id, lang, source, the counts, base_failed (fewer than ``min_words`` words, or
    over ``max_repeat_pct`` per cent of them in repeated 3-word windows), the name of the first
    measure that lies beyond its group's threshold (``failed_rule``, else null) and kept.
    ``carry`` names further columns to keep.  A null or empty text has no words and fails the
    base rule.  A null language or source is a group of its own;
    see ``thresholds`` for groups of under ``least_rows`` passing rows and for bad sources.  Repeated rows are judged one
    by one, other columns are ignored, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry or ()))
    measured = written(text_measures(rows))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    limits = thresholds(measured.filter(~base), fence, accuracy, least_rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = F.coalesce(*(F.when(_ratio(a, b) > F.col(f"most_{name}"), F.lit(name)) for name, (a, b, *_) in RATIOS.items()))
    return (joined.withColumns({"base_failed": base, "failed_rule": failed}).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
            .select("doc_id", "lang", "source", *STATS, "base_failed", "failed_rule", "kept", *(F.col(f"carry_{c}").alias(c) for c in carry or ())))


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    marked = docs.withColumn("text_hash", text_hash(options.get("text_col", "text")))
    verdict = quality_rules(marked, carry=["text_hash"], **options)
    return keep_rows(docs, verdict.filter("kept"), options.get("id_col", "doc_id"), options.get("text_col", "text"))
