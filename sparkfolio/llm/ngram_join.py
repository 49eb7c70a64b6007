"""Jaccard join of documents on word shingles by T-occurrence search (DivideSkip).

1. Equal shingle sets become one set; only different sets are compared.
2. Sets that may link are brought together.  The shingles of a set are dealt into buckets by their hash.  Two sets that
   link differ in D shingles at most, so all but D of their buckets are equal; put in any order that both
   share (larger buckets first), the first equal bucket is among the first D + 1 buckets of each.  The contents of
   these buckets are a set's keys.  A key holds several shingles, so unlike texts hardly ever
   share one, however many texts there are and however common their shingles.
3. All sets of a key meet in the block of the key's smallest set.  A block is cut into chunks
   of bounded size; in a chunk an inverted index over whole sets answers each T-occurrence
   query: short lists are heap-merged, long lists probed by binary search, and what reaches the
   required overlap links.  A set that is already connected to a candidate does not ask again,
   so a group of copies costs one query per copy and not one per pair.
4. Sets of a chunk that did not connect to the block's smallest set are searched in the other
   chunks of the block too.
5. Links form components.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import LOWER, keep_rows, mix, raw, shingles, text_hash, text_slices, words, written
from sparkfolio.llm.components import components
from sparkfolio.llm.wordstore import gather

#: Sets that one chunk indexes, and shingles of all of them (one set at least).
CHUNK = 200
CHUNK_SHINGLES = 400_000
#: Bits of the map of wanted ids: 4 MB.
ID_BITS = 1 << 25
#: Weight of the list length in DivideSkip's choice of long lists.
MU = 0.0085


def text_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    hashes, counts = words(LOWER[data], offsets)
    ends = np.cumsum(counts)
    return [np.unique(shingles(hashes[e - c : e], width)) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


@lru_cache(maxsize=8)
def bands(percent: int) -> list[int]:
    """First sizes of the bands of sizes.  A band is wide enough that sets that link are in one or in two neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100**6 // percent**6)))
    return starts


def most_apart(a: int, b: int, percent: int) -> int:
    """Shingles in which sets of ``a`` and ``b`` shingles differ at most if they link."""
    return (a + b) * (100 - percent) // (100 + percent)


def bucket_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set (sorted hashes): different sets that link share one at least.

    A pair belongs to the band of its larger set, which tells the number of buckets; so a set
    has keys for its own band and, if a partner can be there, for the next one.
    """
    if percent >= 100:
        return np.zeros(0, np.uint64)  # only equal sets link
    n, starts = len(hashes), bands(percent)
    own, largest = bisect_right(starts, n) - 1, 100 * n // percent
    mixed, out = mix(hashes), [np.zeros(0, np.uint64)]
    for band in (own, own + 1):
        apart = most_apart(n, min(largest, starts[band + 1] - 1), percent)
        if largest < starts[band] or not apart:
            continue  # no partner there, or only equal sets
        top = most_apart(starts[band + 1], starts[band + 1], percent)
        buckets = top + top // 2 + 4
        of = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascends with the hash
        used, first, count = np.unique(of, return_index=True, return_counts=True)
        content = mix(np.add.reduceat(mixed, first) + count.astype(np.uint64))
        if len(used) <= apart:  # empty buckets can be equal too; they come last
            empty = np.setdiff1d(np.arange(buckets), used)
            used, count, content = np.concatenate([used, empty]), np.concatenate([count, np.zeros_like(empty)]), np.concatenate([content, mix(empty.astype(np.uint64))])
        best = np.lexsort((content, -count))[: apart + 1]
        out.append(mix(content[best] + used[best].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)))
    return np.concatenate(out)


def _signed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, names, keys = [], [], []
            for got in text_sets(*raw(batch.column("text")), width):
                sizes.append(len(got))
                if not len(got):
                    names.append(None)
                    keys.append(None)
                    continue
                names.append(b"".join(int(np.bitwise_xor.reduce(x)).to_bytes(8, "big") for x in (mix(got), mix(got * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)))))
                keys.append(bucket_keys(got, percent).view(np.int64))
            short = [None if name is None else int.from_bytes(name[:8], "big", signed=True) for name in names]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            columns |= {"n_shingles": pa.array(sizes, pa.int64()), "set_name": pa.array(names, pa.binary()), "short_name": pa.array(short, pa.int64()),
                        "keys": pa.array(keys, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)
    return run


class Index:
    """Inverted lists over whole sets, for T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        hashes = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(hashes, kind="stable")  # members ascend inside a list
        self.members = member[order]
        self.hashes, self.start, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.keys = np.repeat(np.arange(len(self.hashes)), self.count) * len(sets) + self.members

    def search(self, query: np.ndarray, percent: int, allowed: np.ndarray) -> Iterator[int]:
        """Members among ``allowed`` whose Jaccard similarity to ``query`` is ``percent`` or more."""
        n = len(query)
        allowed = allowed & (100 * self.size >= percent * n) & (100 * n >= percent * self.size)
        if not n or not allowed.any():
            return
        least = -(-percent * (n + int(self.size[allowed].min())) // (100 + percent))
        at = np.minimum(np.searchsorted(self.hashes, query), len(self.hashes) - 1)
        lists = at[self.hashes[at] == query]
        if len(lists) < least:
            return
        entries, count = gather(self.members, self.start[lists], self.count[lists])
        of = np.repeat(np.arange(len(lists)), count)
        keep = allowed[entries]
        entries, of = entries[keep], of[keep]
        size = np.bincount(of, minlength=len(lists))
        if (size > 0).sum() < least:
            return
        by = np.argsort(size, kind="stable")
        by = by[size[by] > 0]
        n_long = min(least - 1, int(least / (MU * log2(max(2, size.max())) + 1)))
        long, is_short = by[len(by) - n_long :], np.zeros(len(lists), bool)
        is_short[by[: len(by) - n_long]] = True
        chosen = is_short[of]
        entries, of = entries[chosen], of[chosen]
        if len(entries) <= 4096:
            runs = np.split(entries, np.flatnonzero(of[1:] != of[:-1]) + 1)
            merged = [(k, len(list(run))) for k, run in groupby(merge(*(r.tolist() for r in runs)))]
        else:  # many entries: the same merge as one sort of sorted runs
            merged = list(zip(*(x.tolist() for x in np.unique(entries, return_counts=True)), strict=True))
        probes = lists[long] * len(self.size)
        for member, have in merged:
            need = -(-percent * (n + int(self.size[member])) // (100 + percent))
            if have + n_long < need:
                continue
            key = probes + member
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            if have + int((self.keys[place] == key).sum()) >= need:
                yield member


def join_chunk(sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all sets of a chunk that links connect, and each set's label."""
    m = len(sets)
    label = np.arange(m)
    links: list[tuple[int, int]] = []
    if m < 2:
        return links, label
    index = Index(sets)
    places = np.arange(m)
    for x in range(m - 1):
        for y in index.search(sets[x], percent, (label != label[x]) & (places > x)):
            if label[y] != label[x]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links, label


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``names`` of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_FOUND = "leader long, chunk int, u long, v long"


def _found(rows: list[tuple[int, int, int, int | None]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["leader", "chunk", "u", "v"])


def _first_round(width: int, percent: int):
    """Links inside each chunk; in a block of several chunks also the sets (v null) that stay
    apart from the leader."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table in _groups(batches, ["leader", "chunk"]):
            table = table.combine_chunks()
            ids, where = np.unique(table.column("rid").to_numpy(), return_index=True)
            sets = text_sets(*raw(table.column("text").chunk(0)), width)
            links, label = join_chunk([sets[k] for k in where], percent)
            leader, chunk, chunks = (table.column(c)[0].as_py() for c in ("leader", "chunk", "chunks"))
            if links:  # each connected set with the smallest one it is connected to: stars join up in few rounds
                _, head, part = np.unique(label, return_index=True, return_inverse=True)
                out += [(leader, chunk, int(ids[head[k]]), int(ids[i])) for i, k in enumerate(part.tolist()) if head[k] != i]
            if chunks > 1:
                home = label[np.searchsorted(ids, leader)]
                out += [(leader, chunk, int(r), None) for r in ids[label != home]]
            if len(out) > 5000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)
    return run


def _second_round(width: int, percent: int):
    """Links of sets from other chunks with the sets of this one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["leader", "chunk"]):
            table = table.combine_chunks()
            ids, asks = table.column("rid").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
            sets = text_sets(*raw(table.column("text").chunk(0)), width)
            here = np.flatnonzero(~asks)
            if not len(here) or not asks.any():
                continue
            index = Index([sets[k] for k in here])
            every = np.ones(len(here), bool)
            leader, chunk = table.column("leader")[0].as_py(), table.column("chunk")[0].as_py()
            out = [(leader, chunk, int(ids[q]), int(ids[here[y]])) for q in np.flatnonzero(asks) for y in index.search(sets[q], percent, every)]
            for k in range(0, len(out), 20_000):
                yield _found(out[k : k + 20_000])
    return run


def _blocks(lists: DataFrame) -> DataFrame:
    """(leader, rid): blocks in which the sets of every list (leader, rid) meet.

    A set's home is the smallest leader of its lists, and it is in the block of its home.  A list
    whose sets have one home needs no block of its own; the others keep theirs.  So a group of
    copies, whose lists have several leaders, is brought together once.
    """
    homes = written(lists.groupBy("rid").agg(F.min("leader").alias("home")))
    torn = lists.join(homes, "rid").groupBy("leader").agg(F.min("home").alias("a"), F.max("home").alias("b")).filter("a <> b").select("leader")
    return homes.select(F.col("home").alias("leader"), "rid").unionByName(lists.join(torn, "leader", "left_semi").select("leader", "rid")).distinct()


def _likely(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``bodies`` (doc_id, text) whose id may be a ``first_id`` of ``wanted``.

    Most texts have no partner and need not be moved to find that out.  The wanted ids set bits of a map of
    ``ID_BITS`` bits, whatever their number (so it can be broadcast); a row whose bit is not set goes
    before the exchange.  With very many wanted ids more bits are set and fewer rows go, which only costs time.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    marks = wanted.select(place("first_id").alias("place")).groupBy(F.expr("place div 32768").alias("part")).agg(
        F.bitmap_construct_agg(F.expr("place % 32768")).alias("bits"))
    placed = bodies.withColumn("place", place("doc_id")).join(F.broadcast(marks), F.expr("place div 32768") == F.col("part"))
    byte = "cast(conv(hex(substring(bits, cast(place % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return placed.filter(F.expr(f"shiftright({byte}, cast(place % 8 as int)) & 1 = 1")).select("doc_id", "text")


def near_links(docs: DataFrame, width: int = 5, percent: int = 80, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shingle sets of ``docs`` (doc_id, text) and the links that connect them.

    Returns (doc_id, n_shingles, set_name) of every row, (set_name, rid, first_id) of every
    different set, and links (u, v) between rids: v is connected with u by similar pairs that
    were verified on whole sets.  All pairs of sets that are similar are connected by links.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    signed = docs.mapInArrow(_signed(width, percent), f"{kinds}, n_shingles long, set_name binary, short_name long, keys array<long>")
    rows = written(signed.withColumn("row", F.monotonically_increasing_id()))
    sets = rows.filter("set_name is not null").groupBy("set_name").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("size"), F.min("row").alias("rid"))
    sets = written(sets)
    # A key is shared when two different sets have it; copies of a set fall together before the shuffle.  The
    # smallest row with a key is the smallest of its set, and so the rid of the key's leader.
    uses = rows.select("short_name", "row", F.explode("keys").alias("key")).groupBy("key").agg(F.min("short_name").alias("a"), F.max("short_name").alias("b"), F.min("row").alias("leader"))
    shared = written(uses.filter("a <> b").select("key", "leader"))
    hits = written(rows.select("row", F.explode("keys").alias("key")).join(shared, "key").select("leader", "row").distinct())
    rids = rows.select("row", "set_name").join(sets.select("set_name", "rid"), "set_name").select("row", "rid")
    lists = written(hits.join(written(rids), "row").select("leader", "rid").distinct())
    blocks = written(_blocks(lists).join(sets.select("rid", "size"), "rid"))
    sizes = blocks.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    chunks = sizes.select("leader", F.greatest(F.ceil(F.col("sets") / chunk), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    chunks = written(chunks)
    placed = blocks.drop("size").join(chunks, "leader").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    leaders = chunks.select("leader", F.col("leader").alias("rid"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    placed = placed.filter("rid <> leader").unionByName(leaders)
    bodies = docs.select("doc_id", "text")

    def with_texts(places: DataFrame) -> DataFrame:
        """A text of each set; the set's document of smallest id has it."""
        of = written(sets.select(F.col("rid").alias("of_rid"), "first_id").join(places.select(F.col("rid").alias("p_rid")).distinct(), F.col("of_rid") == F.col("p_rid"), "left_semi"))
        named = _likely(bodies, of).join(of, F.col("doc_id").eqNullSafe(F.col("first_id")))
        return places.join(named.select("of_rid", "text"), F.col("rid") == F.col("of_rid")).drop("of_rid")

    if rows.filter("doc_id is null").limit(1).count() or rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        # ids do not name one text: give each set the text itself, by name
        def with_texts(places: DataFrame) -> DataFrame:  # noqa: F811
            named = docs.select("text").mapInArrow(_named(width), "set_name binary, text string").groupBy("set_name").agg(F.min("text").alias("text"))
            named = named.join(sets.select("set_name", F.col("rid").alias("of_rid")), "set_name").select("of_rid", "text")
            return places.join(named, F.col("rid") == F.col("of_rid")).drop("of_rid")

    first = with_texts(placed).repartition("leader", "chunk").sortWithinPartitions("leader", "chunk").mapInArrow(_first_round(width, percent), _FOUND)
    first = written(first)
    links = first.filter("v is not null").select("u", "v")
    apart = first.filter("v is null").select("leader", F.col("chunk").alias("from_chunk"), F.col("u").alias("rid"))
    if apart.limit(1).count():
        asking = (apart.join(chunks, "leader").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                  .filter("chunk <> from_chunk").select("leader", "rid", "chunk", F.lit(True).alias("asks")))
        asked = placed.join(apart.select("leader").distinct(), "leader", "left_semi").select("leader", "rid", "chunk", F.lit(False).alias("asks"))
        second = with_texts(asking.unionByName(asked)).repartition("leader", "chunk").sortWithinPartitions("leader", "chunk").mapInArrow(_second_round(width, percent), _FOUND)
        links = links.unionByName(written(second).select("u", "v"))
    return rows.drop("keys", "short_name", "row"), sets, links


def _named(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            part = pa.RecordBatch.from_arrays([batch.column("text"), batch.column("text")], names=["doc_id", "text"])
            for named in _signed(width, 100)(iter([part])):
                yield pa.RecordBatch.from_arrays([named.column("set_name"), named.column("doc_id")], names=["set_name", "text"])
    return run


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Component of every document under links of Jaccard similarity of at least ``percent`` %.

    Words are runs of non-white-space bytes with A-Z lower-cased; a set holds the distinct runs
    of ``width`` words, or the whole sequence when the text is shorter.  Returns doc_id,
    n_shingles and component_id, the smallest id that links reach.  A null, empty or blank text
    has an empty set and is linked with nothing.  Rows with a null id take part; their
    component has a null id only if no other id is in it.  Repeated rows stay, other columns
    are ignored, an empty table gives an empty result.  ``carry`` names columns to keep.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    rows, sets, links = near_links(texts, width, percent, chunk)
    roots = components(links)
    named = sets.join(roots, F.col("rid") == F.col("node"), "left").select("set_name", "first_id", F.coalesce("root", "rid").alias("root"))
    named = written(named)
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_name = named.join(smallest, "root").select(F.col("set_name").alias("s_name"), "component_id")
    joined = rows.join(by_name, F.col("set_name") == F.col("s_name"), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         *(F.col(f"carry_{c}").alias(c) for c in carry))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns of ``docs``.
    Rows that repeat that id in the component all stay."""
    groups = near_groups(docs.withColumn("text_hash", text_hash(text_col)), width, percent, id_col, text_col, carry=("text_hash",))
    return keep_rows(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col, text_col)
