"""Vector best-fit packing of token pieces into sequences.

Documents become pieces where they lie; then only lengths move.  Pieces are dealt into even
blocks, and each block is packed by itself: a bin has residual tokens, residual documents and
residual attention cost (sum of squared lengths), and a piece goes where it fits in every one
and the residual left over has the smallest weighted norm, or the largest weighted dot product
with the piece.  A block leaves at most a few part-filled bins among thousands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import per_row, raw, text_slices, written
from sparkfolio.llm.wordstore import gather

#: Tokens, documents and attention cost that a sequence can hold.
CAPACITY = (2048, 2048, 2048 * 2048)
#: Pieces that are packed together.
BLOCK_ROWS = 20_000
#: Words whose ids a worker keeps for the texts that follow: those of the last texts, half of them at least.
STORED = 150_000
#: Runs of these after a word are a token of their own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words:
    """Ids of space-free chunks.  A chunk that is one Latin-1 word with ASCII punctuation after it,
    or without, is looked up as lower-case word and punctuation: the tokenizer lower-cases, and
    cuts between letters and punctuation.  All others go to the tokenizer as they are.

    Ids are kept in two generations: a word that is not asked for while one fills is forgotten
    with the next.  The result does not depend on what is kept."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tool.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}  # ids as bytes: small, and quick to put together
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def _plain(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.int32).tobytes() for x in self.tool.encode_batch_fast(chunks, add_special_tokens=False)]

    def _single(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: each ends with its one word-end token."""
        out = []
        for k in range(0, len(words), 512):
            ids = np.array(self.tool.encode_batch_fast([" ".join(words[k : k + 512])], add_special_tokens=False)[0].ids, np.int32)
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            whole = ids.tobytes()
            out += [whole[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        if len(out) != len(words):
            raise AssertionError("a word of letters must end with one word-end token")
        return out

    def _ids(self, words: list[str], tool: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, end to end, and how many each has."""
        rows = [self.young.get(w) for w in words]
        for i in [i for i, x in enumerate(rows) if x is None]:
            rows[i] = self.old.get(words[i])
        missing = [i for i, x in enumerate(rows) if x is None]
        for i, x in zip(missing, tool([words[i] for i in missing]), strict=True):
            rows[i] = x
        for k in range(0, len(words), STORED // 2):  # a step fills one generation at most
            if len(self.young) + STORED // 2 > STORED:
                self.young, self.old = {}, self.young
            self.young.update(zip(words[k : k + STORED // 2], rows[k : k + STORED // 2], strict=True))
        return np.frombuffer(b"".join(rows), np.int32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4

    def __call__(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, end to end, and how many each has."""
        word = pc.utf8_rtrim(chunks, characters=PUNCTUATION)
        (data, offsets), (head, ends) = raw(chunks), raw(word)
        latin = per_row(head >= 0xC4, ends) == 0  # lead bytes of letters beyond Latin-1
        plain = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False) & latin
        size = np.diff(ends)[plain]
        marks, count = gather(data, offsets[:-1][plain] + size, np.diff(offsets)[plain] - size)
        cuts = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(count), pa.py_buffer(cuts), pa.py_buffer(marks)).dictionary_encode()
        words = pc.utf8_lower(word.filter(pa.array(plain))).dictionary_encode()
        tables = [self._ids(words.dictionary.to_pylist(), self._single), self._ids(marks.dictionary.to_pylist(), self._plain),
                  self._ids(chunks.filter(pa.array(~plain)).to_pylist(), self._plain)]
        flat = np.concatenate([x for x, _ in tables])
        count = np.concatenate([n for _, n in tables])
        n_words, n_marks = len(words.dictionary), len(marks.dictionary)
        # A chunk is one entry of the tables or two: a word and what follows it.
        first = np.empty(len(chunks), np.int64)
        first[plain] = words.indices.to_numpy(zero_copy_only=False)
        first[~plain] = n_words + n_marks + np.arange(len(chunks) - len(size))
        entry = np.insert(first, np.flatnonzero(plain) + 1, n_words + marks.indices.to_numpy(zero_copy_only=False))
        ids, count = gather(flat, (np.cumsum(count) - count)[entry], count[entry])
        starts = np.cumsum(1 + plain) - (1 + plain)
        return ids, np.add.reduceat(count, starts) if len(starts) else count

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with id 0 at its end, end to end, and how many each text has."""
        lines = pc.replace_substring(pc.fill_null(column.cast(pa.string()), ""), "\n", " ")
        chunks = pc.split_pattern(lines, " ")
        seen = chunks.flatten().dictionary_encode()
        ids, count = self(seen.dictionary)
        ids, count = np.append(ids, np.int32(0)), np.append(count, 1)
        ends = np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))
        entry = np.insert(seen.indices.to_numpy(zero_copy_only=False), ends, len(seen.dictionary))
        out, counts = gather(ids, (np.cumsum(count) - count)[entry], count[entry])
        total = np.concatenate(([0], np.cumsum(counts)))[ends + np.arange(1, len(ends) + 1)]
        return out, np.diff(total, prepend=0)


@cache
def _store(path: str) -> _Words:
    return _Words(path)


def _pieces(path: str, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(path)
        for batch in text_slices(batches, most=4 << 20):
            ids, counts = store.texts(batch.column("text"))
            n = -(-counts // size)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(counts[doc] - piece * size, size)
            ends = np.concatenate(([0], np.cumsum(length) * 4))
            body = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length), body],
                                             names=["doc_id", "piece", "start", "length", "ids"])
    return cut


def token_pieces(docs: DataFrame, path: str, size: int = CAPACITY[0], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids by the tokenizer file ``path``, with id 0 at its end.

    Returns doc_id, piece, start, length and ids (binary, little-endian unsigned 32 bits).  Only
    documents of over ``size`` ids are cut.  A null or empty text is one piece, the id 0.
    Repeated rows give pieces of their own, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
             score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first.

    ``score`` is ``norm`` (smallest weighted norm of what stays free) or ``dot`` (largest
    weighted dot product of piece and free room).  Ties go to the oldest bin.  A piece that no
    empty bin could take is an error.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score is 'norm' or 'dot'")
    n = len(lengths)
    room = np.array(capacity, np.float64)
    need = np.stack([lengths, np.ones(n), np.square(lengths.astype(np.float64))], axis=1)
    if (need > room).any():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    need /= room
    weight = np.array(weights, np.float64)
    least = need.min(axis=0) if n else room
    free = np.empty((1024, 3))
    name = np.empty(1024, np.int64)
    filled = np.zeros(n, np.int64)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    live = made = 0
    eps = 1e-12
    for i in np.argsort(-lengths, kind="stable").tolist():
        v = need[i]
        f = free[:live]
        fits = np.flatnonzero((f[:, 0] >= v[0] - eps) & (f[:, 1] >= v[1] - eps) & (f[:, 2] >= v[2] - eps))
        if len(fits):
            left = f[fits]
            value = (((left - v) * weight) ** 2).sum(axis=1) if score == "norm" else -(left * v * weight).sum(axis=1)
            k = int(fits[np.argmin(value)])
        else:
            if live == len(free):
                free, name = np.concatenate([free, np.empty_like(free)]), np.concatenate([name, np.empty_like(name)])
            k, free[live], name[live] = live, 1.0, made
            live, made = live + 1, made + 1
        bins[i], offsets[i] = name[k], filled[name[k]]
        filled[name[k]] += int(lengths[i])
        free[k] -= v
        if (free[k] < least - eps).any():  # nothing more fits: keep the open bins together, in order
            free[k : live - 1], name[k : live - 1] = free[k + 1 : live].copy(), name[k + 1 : live].copy()
            live -= 1
    return bins, offsets


def best_fit_pack(pieces: DataFrame, capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
                  score: str = "norm", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``; other columns are carried along.

    Offsets in a sequence have no gaps.  Rows are dealt to blocks by their place in a written
    table, so repeated rows spread too.  Rows of length null or below 1 are an error of the
    caller and end the job.  An empty table gives an empty result.
    """
    rows = written(pieces)
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    rows = rows.withColumn("pack_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        if (lengths < 1).any():
            raise ValueError("a piece has at least one token")
        bins, offsets = best_fit(lengths, capacity, weights, score)
        return table.drop_columns(["pack_block"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return rows.groupBy("pack_block").applyInArrow(pack, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: tuple[int, int, int] = CAPACITY, **options) -> DataFrame:
    """Pieces of all documents with their ids, sequence and place in it."""
    return best_fit_pack(token_pieces(docs, path, capacity[0]), capacity, **options)
