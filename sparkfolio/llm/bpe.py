"""Byte-level BPE by corpus-level merge replay, and its inverse.

The distinct pieces of a stretch of texts form one corpus.  An inverted index leads from each
mergeable pair to the positions where it stands; the merges are replayed over the whole corpus
in rank order, each one touching only the positions listed and their neighbours.  Texts are
encoded where they lie: no shuffle, and memory is bounded by the stretch and the store.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import raw, text_slices
from sparkfolio.llm.wordstore import WordStore, gather

NO_RANK = np.int32(2**31 - 1)
#: Bytes of text whose new pieces are replayed together.
STRETCH = 4 << 20
#: Pieces whose ids a worker keeps for the texts that follow.
STORED = 300_000


class Merges:
    """Merge ranks of a rank file (base64 token and rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        known = self.ranks
        self.letters = np.array([known[bytes([b])] for b in range(256)], np.int32)
        pairs = [(known[t[:i]] << 32 | known[t[i:]], r) for t, r in known.items() for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.values = table[:, 0].copy(), table[:, 1].astype(np.int32)
        by_id = sorted((r, t) for t, r in known.items())
        self.size = by_id[-1][0] + 1
        self.width = np.zeros(self.size, np.int64)
        self.width[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.at = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, or ``NO_RANK``."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        # a word that is a token itself is that token, as a single symbol without a pair
        symbols = np.concatenate([self.letters[np.frombuffer(w, np.uint8)] if r < 0 else np.array([r], np.int32) for w, r in zip(words, whole, strict=True)])
        size = np.where(whole < 0, [len(w) for w in words], 1)
        n = len(symbols)
        owner = np.repeat(np.arange(len(words)), size)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        last = np.cumsum(size) - 1
        after[last] = n
        before[0] = n
        before[last[:-1] + 1] = n
        alive = np.ones(n, bool)
        symbols = np.append(symbols, -1)
        rank = np.full(n + 1, NO_RANK, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            found = rank[places]
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heappush(heap, r)

        if len(inner := inner[rank[inner] != NO_RANK]):
            enter(inner)
        heapify(heap)
        mark = np.zeros(n + 1, bool)
        while heap:
            r = heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            mark[at] = True
            clash = mark[right].any()
            if clash:  # overlapping occurrences: the leftmost goes first
                for p in np.sort(at).tolist():
                    if mark[p]:
                        mark[after[p]] = False
                kept = at[mark[at]]
                mark[at] = False
                at, right = kept, after[kept]
            mark[at] = False
            symbols[at] = r
            alive[right] = False
            rank[right] = NO_RANK
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            touched = np.concatenate([at, left[left < n]])
            if clash:
                touched = np.unique(touched)
            follow = after[touched]
            rank[touched] = np.where(follow < n, self.rank(symbols[touched], symbols[follow]), NO_RANK)
            touched = touched[rank[touched] != NO_RANK]
            if len(touched):
                enter(touched)
        return symbols[:n][alive], np.bincount(owner[alive], minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids, end to end, and the n + 1 offsets of the rows."""
        data, width = gather(self.bytes, self.at[ids], self.width[ids])
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
        return data, ends


@cache
def merges(path: str) -> Merges:
    return Merges(path)


@cache
def _store(path: str, pattern: str) -> tuple[WordStore, regex.Pattern]:
    return WordStore(lambda new: merges(path).replay([w.encode() for w in new]), STORED), regex.compile(pattern)


def _bytes(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _encoder(path: str, pattern: str, decoded: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, pieces = _store(path, pattern)
        for batch in text_slices(batches, most=STRETCH):
            data, offsets = raw(batch.column("text"))
            whole = data.tobytes()
            rows = [store.numbers(pieces.findall(whole[offsets[i] : offsets[i + 1]].decode())) for i in range(batch.num_rows)]
            ids, counts = store.ids(rows)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            keep = [c for c in batch.schema.names if c != "text"]
            columns = {c: batch.column(c) for c in keep} | {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))}
            if decoded:
                columns["decoded"] = _bytes(*merges(path).decode(ids, counts))
            yield pa.RecordBatch.from_pydict(columns)
    return encode


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            column = batch.column("ids")
            counts = np.diff(column.offsets.to_numpy()).astype(np.int64)
            if column.null_count:
                counts[column.is_null().to_numpy(zero_copy_only=False)] = 0
            data, ends = model.decode(column.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(data, ends)], names=[*batch.schema.names, "decoded"])
    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every whole text by the ranks in the file ``path``.

    ``pattern`` cuts a text into pieces, each encoded by itself; there are no special tokens.
    With ``decoded`` the ids are decoded at once, in the same task, into the binary column of
    that name; ``decode_ids`` does it for stored ids.
    A null or empty text has no ids.  Repeated rows stay, other columns are ignored, an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded
    return rows.mapInArrow(_encoder(path, pattern, decoded), kinds)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes that the column ``ids`` stands for; a null list has no bytes."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoder(path), f"{kept}, decoded binary")
