"""Removal of passages that repeat anywhere in the corpus, by sorting anchored suffixes.

A passage is a run of ``length`` bytes (a window) that also starts elsewhere.

1. Anchors.  In each window the ``gram``-byte string with the smallest hash is the window's
   anchor.  Equal windows choose the same anchor at the same place, so only suffixes at
   anchors, about one position in 70, have to be sorted, and windows are compared only among
   occurrences of one anchor.  The consecutive windows of one anchor are its cell.
2. Anchors that occur once are dropped.  Equal cells of an anchor are all repeats.
3. Of the other anchors one occurrence of each different cell is fetched.  The suffixes to the
   right of the anchors and the reversed prefixes to the left are sorted deep-shallow: multikey
   quicksort on 8-byte words down to a shallow depth, then blind tries for the groups that
   still agree.  Longest common prefixes between neighbours cut both orders into classes for
   any depth, and a window repeats when another cell has the same left and the same right class.
4. Repeated windows go back to all occurrences of their cell, and their bytes are cut.

Counting comes before each shuffle by anchor, joins on a hot anchor can be split, and an anchor
with more than ``hot`` different cells is not brought together: its windows are counted by
128-bit digests instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import _LETTER, _powers, mix, raw, text_slices, written

LENGTH = 200
GRAM = 64
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 96
#: Different cells of one anchor that may be sorted in one place.
HOT = 20_000
#: Window starts of one numpy step; positions in a step need 20 bits.
STEP = 1 << 19


def _sums(data: np.ndarray, shift: int = 0) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    letters = _LETTER if not shift else np.roll(_LETTER, shift)
    np.cumsum(letters[data] * up[: len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Cells of all texts of a slice: row, place of the anchor, first and last window start
    (all in the slice's bytes), hash of the anchor's string and of the cell."""
    n = len(data)
    out = {k: [] for k in ("place", "first", "last", "gh", "cell")}
    starts_at = np.zeros(n + 1, bool)
    for low in range(0, max(0, n - length + 1), STEP):
        part = data[low : min(n, low + STEP + length - 1)]
        sums = _sums(part)
        _, down = _powers(len(part) + 1)
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        key = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, span = 1, length - gram + 1
        while 2 * width <= span:  # smallest key of ``width`` neighbours, width doubling
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        best = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.arange(len(best))
        row = np.searchsorted(offsets, starts + low, side="right") - 1
        valid = starts + low + length <= offsets[row + 1]
        change = np.ones(len(best), bool)
        change[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(change & valid)
        stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~change[1:], False))
        place = best[first]
        digest = (sums[stop + length] - sums[first]) * down[first]
        extent = (stop - first).astype(np.uint64) << np.uint64(10) | (place - first).astype(np.uint64)
        out["cell"].append(mix(digest + mix(extent + np.uint64(1))))
        out["gh"].append(grams[place])
        for name, x in (("place", place), ("first", first), ("last", stop)):
            out[name].append(x + low)
    del starts_at
    got = {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("gh", "cell") else np.int64) for k, v in out.items()}
    return got | {"row": np.searchsorted(offsets, got["first"], side="right") - 1}


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


_CELL = "row_key long, n_bytes long, gh long, cell long, place int, first int, last int"


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=STEP):
            data, offsets = raw(batch.column("text"))
            got = anchors(data, offsets, length, gram)
            row = got["row"]
            base = offsets[row]
            key = batch.column("row_key").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.diff(offsets)[row]), pa.array(got["gh"].view(np.int64)), pa.array(got["cell"].view(np.int64)),
                 *(pa.array((got[k] - base).astype(np.int32)) for k in ("place", "first", "last"))],
                names=["row_key", "n_bytes", "gh", "cell", "place", "first", "last"])
    return run


# ---------------------------------------------------------------- deep-shallow sorting

def blind_order(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of byte strings of one length by a blind trie, and the common prefix of each with
    the one before (0 for the first).

    Inner nodes hold only the position where their strings part.  A new string is led down by
    the bytes at these positions alone; one comparison with the leaf it reaches tells where it
    really parts, and a node is put in there.
    """
    width = len(texts[0])
    number = [int.from_bytes(t, "big") for t in texts]
    same: dict[int, list[int]] = {}
    root = None  # a node is [depth, {byte: node or index}]
    for i, value in enumerate(number):
        if value in same:
            same[value].append(i)
            continue
        same[value] = [i]
        if root is None:
            root = i
            continue
        text = texts[i]
        node = root
        while type(node) is list:
            node = node[1].get(text[node[0]], next(iter(node[1].values())))
        apart = width - ((value ^ number[node]).bit_length() + 7) // 8
        other = texts[node][apart]
        above, node = None, root
        while type(node) is list and node[0] < apart:
            above, node = node, node[1][text[node[0]]]
        if type(node) is list and node[0] == apart:
            node[1][text[apart]] = i
            continue
        fresh = [apart, {text[apart]: i, other: node}]
        if above is None:
            root = fresh
        else:
            above[1][text[above[0]]] = fresh
    order, common = [], []
    stack = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is list:
            ranked = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0]) for _, child in ranked[:-1]]
            stack.append((ranked[-1][1], shared))
            continue
        equal = same[number[node]]
        order += equal
        common += [shared] + [width] * (len(equal) - 1)
    return order, common


def deep_shallow(group: np.ndarray, texts: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``texts`` (n x width bytes) by (group, text), and the common prefix
    of each row with the one before it in that order (-1 where the group changes)."""
    n, width = texts.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = texts
    steps = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.where(np.append(True, group[order][1:] != group[order][:-1]), -1, width).astype(np.int64)
    depth = 0
    for k in range(min(shallow, width) // 8):
        # rows that agree with a neighbour on all before this word are split by this word
        open_ = common == width
        busy = np.flatnonzero(open_ | np.append(open_[1:], False))
        if not len(busy):
            return order, common
        bucket = np.cumsum(~open_)[busy]
        word = steps[order[busy], k]
        by = np.lexsort((word, bucket))
        order[busy] = order[busy][by]
        word = word[by]
        apart = np.append(False, (word[1:] != word[:-1]) & (bucket[1:] == bucket[:-1]))
        x = np.append(np.uint64(0), word[1:] ^ word[:-1])[apart]
        same = np.zeros(len(x), np.int64)
        for b in range(1, 9):
            same += (x >> np.uint64(64 - 8 * b)) == 0
        common[busy[apart]] = np.minimum(8 * k + same, width)
        depth = 8 * (k + 1)
    open_ = common == width
    heads = np.flatnonzero(np.append(open_[1:], False) & ~open_)
    tails = np.flatnonzero(open_ & ~np.append(open_[1:], False)) + 1
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        rows = order[a:b]
        whole = texts[rows, depth:].tobytes()
        size = width - depth
        by, shared = blind_order([whole[i * size : (i + 1) * size] for i in range(b - a)])
        order[a:b] = rows[by]
        common[a + 1 : b] = np.array(shared[1:]) + depth
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``common`` cut to what both neighbours have, for rows sorted short before long."""
    ext = extent[order]
    return order, np.append(common[:1], np.minimum(common[1:], np.minimum(ext[1:], ext[:-1])))


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, left_len: np.ndarray, right_len: np.ndarray,
                     reach: np.ndarray, last: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(row, from, to): runs of window starts, relative to the anchor, that another row of the
    group has too.

    ``left`` are the reversed bytes before the anchors, ``right`` the bytes from them on, padded
    with 0 beyond ``left_len`` and ``right_len``.  Row i stands for the starts -reach[i] .. -last[i].
    """
    n = len(group)
    sorted_sides = []
    for texts, have in ((left, left_len), (right, right_len)):
        by_length = np.lexsort((have, group))  # stable sorting keeps the shorter of equal rows first
        order, common = deep_shallow(group[by_length], texts[by_length])
        sorted_sides.append(_classes(by_length[order], common, have))
    hit = np.zeros((n, int(reach.max(initial=0)) + 1), bool)
    class_of = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for back in range(hit.shape[1]):
        rows = np.flatnonzero((reach >= back) & (last <= back))
        if len(rows) < 2:
            continue
        for side, need in ((0, back), (1, length - back)):
            order, common = sorted_sides[side]
            class_of[side][order] = np.cumsum(common < need)
        key = class_of[0][rows] * (n + 1) + class_of[1][rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.append(same, False) | np.append(False, same)
        hit[rows[by[twice]], back] = True
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return list(zip(row.tolist(), (1 - stop).tolist(), (-start).tolist(), strict=True))


_CONTEXT = "gh long, cell long, copies long, reach int, last int, left binary, right binary"


def _fetch(length: int, gram: int):
    """Bytes around the anchors that a document stands for."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            whole = data.tobytes()
            rows = []
            for i, cells in enumerate(batch.column("cells").to_pylist()):
                text = whole[offsets[i] : offsets[i + 1]]
                for c in cells:
                    p = c["place"]
                    rows.append((c["gh"], c["cell"], c["copies"], p - c["first"], p - c["last"], text[max(0, p - side) : p][::-1], text[p : p + length]))
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], t) for j, t in enumerate(kinds)],
                                                 names=["gh", "cell", "copies", "reach", "last", "left", "right"])
    return run


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - offsets[row]] = data
    return out, size


def _decide(length: int, gram: int, rows: int = 60_000):
    """Sorted by anchor in, runs of repeated windows out; whole anchors are worked on together."""
    def decide(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = {k: table.column(k).to_numpy() for k in ("gh", "cell", "copies", "reach", "last")}
        _, one = np.unique(np.stack([columns["gh"], columns["cell"]]), axis=1, return_index=True)  # repeated rows of a document come twice
        one.sort()
        columns = {k: v[one] for k, v in columns.items()}
        picked = table.take(pa.array(one)).combine_chunks()
        left, left_len = _matrix(picked.column("left").chunk(0), length - gram)
        right, right_len = _matrix(picked.column("right").chunk(0), length)
        runs = repeated_windows(columns["gh"], left, right, left_len, right_len, columns["reach"], columns["last"], length)
        at = np.array([r[0] for r in runs], np.int64)
        single = columns["copies"][at] < 2 if len(at) else np.zeros(0, bool)
        at = at[single]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns["gh"][at]), pa.array(columns["cell"][at]), pa.array(np.array([r[1] for r in runs], np.int32)[single]),
             pa.array(np.array([r[2] for r in runs], np.int32)[single])], names=["gh", "cell", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            gh = batch.column("gh").to_numpy()
            if count >= rows and gh[0] != gh[-1]:
                cut = int(np.flatnonzero(gh != gh[-1])[-1]) + 1
                yield decide(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
                count = held[0].num_rows
        if held:
            yield decide(pa.Table.from_batches(held))
    return run


def _windows(length: int):
    """Every window of a cell with a 128-bit digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                rows = []
                for r in part.to_pylist():
                    data = np.frombuffer(r["left"][::-1] + r["right"], np.uint8)
                    base = len(r["left"])
                    one, two = _sums(data), _sums(data, 1)
                    _, down = _powers(len(data) + 1)
                    s = base - np.arange(r["last"], r["reach"] + 1)
                    a, b = (mix((x[s + length] - x[s]) * down[s]).view(np.int64) for x in (one, two))
                    rows += [(r["gh"], r["cell"], r["copies"], int(k - base), int(u), int(v)) for k, u, v in zip(s, a, b, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(kinds)], names=["gh", "cell", "copies", "start", "d1", "d2"])
    return run


def _cut(length: int, whole_chars: bool = False):
    """Apply the runs of repeated windows to each text.  With ``whole_chars`` a run is narrowed
    to whole UTF-8 characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            runs = batch.column("runs").to_pylist()
            spans, removed, kept = [], [], []
            for i in range(batch.num_rows):
                low, high = offsets[i], offsets[i + 1]
                merged: list[list[int]] = []
                for a, b in sorted((r["from"], r["to"] + length) for r in runs[i] or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                if whole_chars:
                    inner = (data[low:high] & 0xC0) == 0x80
                    for run in merged:
                        while run[0] < run[1] and inner[run[0]]:
                            run[0] += 1
                        while run[1] > run[0] and run[1] < len(inner) and inner[run[1]]:
                            run[1] -= 1
                keep = np.ones(high - low, bool)
                for a, b in merged:
                    keep[a:b] = False
                spans.append([{"from": a, "to": b} for a, b in merged])
                removed.append(int(len(keep) - keep.sum()))
                kept.append(data[low:high][keep].tobytes())
            names = [c for c in batch.schema.names if c not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), _binary(kept)],
                names=[*names, "n_bytes", "n_removed", "spans", "kept_bytes"])
    return run


def repeated_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Runs of window starts that repeat, by text: row_key, n_bytes, runs (array of from, to).

    ``rows`` has doc_id, row_key, n_bytes and text.  Equal texts share one result.
    """
    if not 8 <= gram < length <= 1000:
        raise ValueError("8 <= gram < length <= 1000")
    cells = rows.select("row_key", "text").mapInArrow(_anchored(length, gram), _CELL)  # cheaper to find twice than to write
    again = cells.groupBy("gh").agg(F.count("*").alias("uses"), F.min("cell").alias("c0"), F.max("cell").alias("c1")).filter("uses > 1")
    again = written(again.select("gh", (F.col("c0") != F.col("c1")).alias("mixed")))  # a table of its own: Spark can split the join at a hot anchor
    found = written(cells.join(again, "gh"))
    whole = found.filter(~F.col("mixed")).select("row_key", "n_bytes", F.col("first").alias("from"), F.col("last").alias("to"))
    mixed = found.filter("mixed")
    # one occurrence of each different cell; it stands for its copies
    some = F.min(F.struct("row_key", "n_bytes", "place", "first", "last"))
    kinds = written(mixed.groupBy("gh", "cell").agg(F.count("*").alias("copies"), some.alias("at")))
    many = kinds.groupBy("gh").agg(F.count("*").alias("n_kinds"))
    wanted = kinds.select("at.row_key", "at.n_bytes", F.struct("gh", "cell", "copies", "at.place", "at.first", "at.last").alias("c"))
    wanted = wanted.groupBy("row_key", "n_bytes").agg(F.collect_list("c").alias("cells"))
    one_each = rows.groupBy("row_key", "n_bytes").agg(F.min("doc_id").alias("stands"))
    wanted = wanted.join(one_each, ["row_key", "n_bytes"]).withColumnsRenamed({"row_key": "w_key", "n_bytes": "w_bytes"})
    texts = rows.join(wanted, (F.col("row_key") == F.col("w_key")) & (F.col("n_bytes") == F.col("w_bytes")) & F.col("doc_id").eqNullSafe(F.col("stands")))
    contexts = texts.select("text", "cells").mapInArrow(_fetch(length, gram), _CONTEXT)
    sized = contexts.join(many, "gh")
    decided = (sized.filter(F.col("n_kinds") <= hot).drop("n_kinds").repartition("gh").sortWithinPartitions("gh")
               .mapInArrow(_decide(length, gram), "gh long, cell long, from int, to int"))
    windows = sized.filter(F.col("n_kinds") > hot).dropDuplicates(["gh", "cell"]).drop("n_kinds").mapInArrow(_windows(length), "gh long, cell long, copies long, start int, d1 long, d2 long")
    shared = windows.groupBy("gh", "start", "d1", "d2").agg(F.count("*").alias("uses")).filter("uses > 1").drop("uses")
    counted = windows.filter("copies < 2").join(shared, ["gh", "start", "d1", "d2"]).select("gh", "cell", F.col("start").alias("from"), F.col("start").alias("to"))
    copied = kinds.filter("copies > 1").select("gh", "cell", (F.col("at.first") - F.col("at.place")).alias("from"), (F.col("at.last") - F.col("at.place")).alias("to"))
    parts = decided.unionByName(counted).unionByName(copied)
    partly = mixed.join(parts, ["gh", "cell"]).select("row_key", "n_bytes", (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to"))
    return whole.unionByName(partly).groupBy("row_key", "n_bytes").agg(F.collect_set(F.struct("from", "to")).alias("runs"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None, whole_chars: bool = False) -> DataFrame:
    """What stays of every document without the bytes of any repeated passage.

    Returns doc_id, n_bytes, n_removed, spans (removed maximal runs: from, to), kept_bytes and
    the columns named in ``carry``, as ``carry_`` and the name.  With ``whole_chars`` no character is cut in two: a byte of one
    that is repeated in part stays.  Judged on the input: all copies of a passage go, also the
    first.  A null text is empty; texts shorter than ``length`` never lose a byte; a text that
    repeats itself loses the repeated bytes.  Repeated rows count as occurrences of their own.
    Other columns are ignored and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_key"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"),
                       *(F.col(c).alias(f"carry_{c}") for c in carry or ()))
    runs = written(repeated_runs(rows.select("doc_id", "row_key", "n_bytes", "text"), length, gram, hot))
    runs = runs.withColumnsRenamed({"row_key": "r_key", "n_bytes": "r_bytes"})
    joined = rows.join(runs, (F.col("row_key") == F.col("r_key")) & (F.col("n_bytes") == F.col("r_bytes")), "left")
    kept = ["doc_id", *(f"carry_{c}" for c in carry or ())]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    out = joined.select(*kept, "text", "runs").mapInArrow(_cut(length, whole_chars), f"{kinds}, n_bytes long, n_removed long, spans array<struct<from: long, to: long>>, kept_bytes binary")
    return out


def cut_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the text, in whole characters; same rows and
    columns.  A null text becomes empty."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    cut = cut_repeats(docs, length, gram, id_col=id_col, text_col=text_col, carry=others, whole_chars=True)
    columns = {id_col: F.col("doc_id").alias(id_col), text_col: F.col("kept_bytes").cast("string").alias(text_col)}
    return cut.select(*(columns.get(c, F.col(f"carry_{c}").alias(c)) for c in docs.columns))
