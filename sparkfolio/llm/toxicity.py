"""Toxicity classifier that is regularised by counterfactuals.

A logistic model over words is fitted on a bounded sample of labelled rows, weighted back to the
share of each label among all of them.  Identity terms of each sampled text are swapped for others
of their list, the text is featured again, and the squared change of the score, averaged over the
swapped texts, is part of the loss: a mention alone must not move the score.
Scoring reads every whole text where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import mix, per_row, raw, span_hashes, text_slices, word_spans

#: Bounds of the training sample: rows with label 1 and with label 0.
MOST_TOXIC, MOST_CLEAN = 3_000, 5_000
#: Words of the model: in so many different sampled texts at least, with shares among the two
#: labels that differ by so many standard errors, and so many words at most.
LEAST_TEXTS, LEAST_Z, MOST_WORDS = 4, 5.0, 60_000
HELD_OUT, FOLDS = 2, 4
# Identity terms, by list; a term is swapped within its list only.
IDENTITY = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy", "female", "male", "transgender"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "homosexual", "heterosexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("blind", "deaf", "disabled", "elderly", "young", "old"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
#: Swapped versions of a sampled text that has identity terms.
SWAPS = 3
#: Letters of a word: ASCII letters in lower case, digits and all bytes beyond ASCII; the rest is space.
_PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_PLAIN[65:91] += 32
_LETTERS = np.arange(97, 123, dtype=np.uint8)


#: Beginnings of words, in bytes, that are features beside the whole words: they stand for stems.
BEGINNINGS = (5, 6, 7, 8)
#: Features of the way a text is set: half of its ASCII letters are capitals; it has "!!".
SHOUTED, EXCLAIMED = np.uint64(1), np.uint64(2)


def text_words(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of the words of each text and of their beginnings, and its style."""
    plain = _PLAIN[data]
    starts, ends, counts = word_spans(plain, offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes, owners = [span_hashes(plain, starts, ends)], [owner]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        hashes.append(mix(span_hashes(plain, starts[longer], starts[longer] + size) + np.uint64(size)))
        owners.append(owner[longer])
    letters, capitals = np.isin(plain, _LETTERS), (data >= 65) & (data <= 90)
    shouted = np.flatnonzero((per_row(letters, offsets) > 0) & (2 * per_row(capitals, offsets) >= per_row(letters, offsets)))
    twice = np.zeros(len(data), bool)
    if len(data) > 1:
        twice[:-1] = (data[1:] == 33) & (data[:-1] == 33)
        twice[offsets[1:-1][(offsets[1:-1] > 0)] - 1] = False
    exclaimed = np.flatnonzero(per_row(twice, offsets))
    for style, rows in ((SHOUTED, shouted), (EXCLAIMED, exclaimed)):
        hashes.append(np.full(len(rows), style))
        owners.append(rows)
    flat, owner = np.concatenate(hashes), np.concatenate(owners)
    cuts = np.cumsum(np.bincount(owner, minlength=len(counts)))[:-1]
    return [np.unique(x) for x in np.split(flat[np.argsort(owner, kind="stable")], cuts)]


def _features(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return text_words(data, np.array([0, len(data)]))[0]


def held_out(doc_id: Column) -> Column:
    """Whether a row is never used for learning: CRC-32 of the id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


_PLACE = {term.encode(): (group, i) for group in IDENTITY for i, term in enumerate(group)}
_TERM = re.compile(rb"(?i)(?<![a-z0-9\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, _PLACE), key=len, reverse=True)) + rb")(?![a-z0-9\x80-\xff])")


def swapped_texts(text: bytes) -> list[bytes]:
    """``SWAPS`` versions of a text with every identity term replaced by another of its list, in the
    capitals of the old one; which one follows from the text.  Nothing for a text without terms."""
    if not _TERM.search(text):
        return []
    seed = zlib.crc32(text)

    def other(turn: int):
        def swap(match: re.Match) -> bytes:
            group, i = _PLACE[match[0].lower()]
            term = group[(i + 1 + (seed + turn) % (len(group) - 1)) % len(group)].encode()
            return term.upper() if match[0].isupper() else term.capitalize() if match[0][:1].isupper() else term
        return swap

    return [_TERM.sub(other(k), text) for k in range(SWAPS)]


_LISTS = pa.list_(pa.list_(pa.int64()))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, offsets = raw(batch.column("text"))
        rows = text_words(data, offsets)
        gone, come = [], []
        for k, own in enumerate(rows):
            versions = swapped_texts(data[offsets[k]: offsets[k + 1]].tobytes())
            new = [_features(v) for v in versions]
            gone.append([np.setdiff1d(own, x).view(np.int64) for x in new])
            come.append([np.setdiff1d(x, own).view(np.int64) for x in new])
        got = [x.view(np.int64) for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(got, pa.list_(pa.int64())), pa.array(gone, _LISTS), pa.array(come, _LISTS)],
                                         names=["label", "weight", "words", "gone", "come"])


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """(label, weight, words, gone, come) of the labelled rows outside the held-out fold, in the order of a
    hash of the id: all of them, or ``most_toxic`` and ``most_clean`` if there are more.

    ``weight``: how many labelled rows of its label a sampled row stands for; ``gone`` and ``come``:
    the words that each swapped version of the text loses and gains.
    """
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col(label_col).cast("int").alias("label")).filter("l_id is not null and label in (0, 1)").filter(~held_out(F.col("l_id")))
    usable = usable.groupBy("l_id").agg(F.max("label").alias("label"))
    by = F.xxhash64(F.col("l_id").cast("string"), F.lit(8))
    whole = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}  # two rows at most
    picked = [usable.filter(F.col("label") == k).orderBy(by, "l_id").limit(n).withColumn("weight", F.lit(max(1.0, whole.get(k, 0) / max(n, 1))))
              for k, n in ((1, most_toxic), (0, most_clean))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # most_toxic + most_clean rows at most
    return docs.join(ids, F.col("doc_id") == F.col("l_id")).select("label", "weight", "text").mapInArrow(_featured, "label int, weight double, words array<long>, gone array<array<long>>, come array<array<long>>")


class Model:
    """Word hashes (sorted), their weights, the bias, and the log odds of label 1 among the labelled rows."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.vocabulary, self.weights, self.bias, self.prior = vocabulary, weights, bias, prior

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for rows of distinct word hashes; without words, the share of label 1."""
        counts = np.array([len(r) for r in rows])
        total = np.where(counts > 0, self.bias, self.prior)
        if len(self.vocabulary) and counts.sum():
            flat = np.concatenate(rows)
            at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
            value = np.where(self.vocabulary[at] == flat, self.weights[at], 0.0)
            total += np.bincount(np.repeat(np.arange(len(rows)), counts), value, len(rows))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


#: For each row the words that its swapped versions lose and gain.
Swaps = list[list[tuple[np.ndarray, np.ndarray]]]


def fit(labels: np.ndarray, rows: list[np.ndarray], weights: np.ndarray | None = None, swaps: Swaps | None = None, ridge: float = 1e-4, fairness: float = 10.0, steps: int = 300,
        least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z, most_words: int = MOST_WORDS, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Logistic loss + ``ridge`` * |w|^2 / 2 + ``fairness`` * mean squared change of the score over the swapped rows.

    ``weights``: labelled rows that each row stands for, 1 when not given.  Texts with the same
    words count once; then each label weighs as much as the labelled rows it has, so neither
    the share of label 1 nor the bias depends on the bounds of the sample.  Full gradient steps
    with Adam.  With one label only, or no rows, the model is a constant.
    """
    labels = np.asarray(labels, float)
    standing = np.bincount(labels.astype(int), weights, 2).astype(float)
    keep = list({(r.tobytes(), y): i for i, (r, y) in enumerate(zip(rows, labels, strict=True))}.values())
    labels, rows = labels[keep], [rows[i] for i in keep]
    n = len(labels)
    share = (standing[1] + 0.5) / (standing.sum() + 1)
    prior = float(np.log(share / (1 - share)))
    constant = Model(np.zeros(0, np.uint64), np.zeros(0), prior, prior)
    if n == 0 or len(np.unique(labels)) < 2:
        return constant
    mass = (standing / np.bincount(labels.astype(int), minlength=2))[labels.astype(int)] / standing.sum()
    counts = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n), counts)
    found, uses = np.unique(flat, return_counts=True)
    features = [_features(w.encode()) for group in identity for w in group]  # a swap changes the word and its beginnings
    terms = np.unique(np.concatenate(features)) if features else np.zeros(0, np.uint64)
    mine = np.bincount(np.searchsorted(found, flat), np.repeat(labels, counts), len(found))
    toxic, mean = labels.sum(), uses / n
    apart = mine / toxic - (uses - mine) / (n - toxic)
    z = np.abs(apart) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / toxic + 1 / (n - toxic)))
    often = np.flatnonzero((uses >= least_texts) & (z >= least_z))
    often = np.sort(found[often[np.argsort(-z[often], kind="stable")[:most_words]]])
    vocabulary = np.unique(np.concatenate([often, terms]))
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    known = vocabulary[at] == flat
    column, row = at[known], owner[known]
    size = len(vocabulary)

    def columns(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(version, column) of the words of swapped versions that the model has."""
        words_ = np.concatenate([*lists, np.zeros(0, np.uint64)])
        place = np.minimum(np.searchsorted(vocabulary, words_), size - 1) if size else np.zeros(len(words_), int)
        have = vocabulary[place] == words_ if size else np.zeros(0, bool)
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists])[have], place[have]

    versions = [(i, gone, come) for i, old in enumerate(keep) for gone, come in (swaps[old] if swaps else [])]
    of = np.array([v[0] for v in versions], int)
    gone_at, gone_col = columns([v[1] for v in versions])
    come_at, come_col = columns([v[2] for v in versions])
    push = mass[of] / mass[of].sum() if len(of) else np.zeros(0)

    weight, bias = np.zeros(size), constant.bias
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(row, weight[column], n) + bias
        miss = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) * mass
        slope = np.append(np.bincount(column, miss[row], size) + ridge * weight, miss.sum())
        if len(of):
            shift = np.bincount(come_at, weight[come_col], len(of)) - np.bincount(gone_at, weight[gone_col], len(of))
            score, other = (1 / (1 + np.exp(-np.clip(m, -40, 40))) for m in (margin[of], margin[of] + shift))
            change = 2 * fairness * push * (score - other)
            by_shift = -change * other * (1 - other)
            by_margin = np.bincount(of, change * score * (1 - score) + by_shift, n)
            slope += np.append(np.bincount(column, by_margin[row], size) + np.bincount(come_col, by_shift[come_at], size) - np.bincount(gone_col, by_shift[gone_at], size),
                               by_margin.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - move[:size], bias - move[size]
    return Model(vocabulary, weight, float(bias), prior)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, **options) -> Model:
    """Fit on the bounded sample; only its word hashes come to the driver."""
    sample = training_sample(docs, labels, label_col, most_toxic, most_clean).toArrow()
    lists = sample.column("words").combine_chunks() if sample.num_rows else None
    if lists is None:
        return fit(np.zeros(0), [])
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
    words_ = lambda x: np.array(x, np.int64).view(np.uint64)
    swaps = [[(words_(g), words_(c)) for g, c in zip(gone, come, strict=True)] for gone, come in zip(sample.column("gone").to_pylist(), sample.column("come").to_pylist(), strict=True)]
    return fit(sample.column("label").to_numpy().astype(float), np.split(values, ends[:-1]), sample.column("weight").to_numpy(), swaps, **options)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            got = model.score(text_words(*raw(batch.column("text"))))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got)], names=[*keep, "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score of every whole text: doc_id, held_out, score (0 to 1) and predicted (score >= threshold).

    Only words of the text enter the score.  A null or empty text scores the share of label 1
    among all labelled rows outside the held-out fold.
    Labels that are null or neither 0 nor 1 are ignored; without both labels all texts score
    the share of label 1 (one half without labels).  Rows with a null id are never learned
    from.  Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(rows, labels, **options)
    scored = rows.mapInArrow(_score(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
