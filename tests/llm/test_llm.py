"""Operators of the llm subpackage against brute force, libraries and exact round trips."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkfolio.llm import (bpe, components, exact_dedup, licenses, ngram_join, packing, quality, sharding, suffix_dedup, toxicity, warc)
from sparkfolio.llm.common import SPACES, LOWER

SPACE_RUN = re.compile(rb"[\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside; input columns of these names must not disturb them.
CLASHES = ("kept", "digest", "sender", "label", "ids", "length", "rid", "leader", "prefix", "shard", "slot", "place", "n_words", "body", "runs", "row_key")


def passage(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(n))


ODD = [
    (1, passage(1)), (2, passage(1)), (3, passage(1).replace(" ", "\n \t", 5)), (4, passage(1) + " more"), (5, None), (6, ""), (7, " \t\n"),
    (8, "a b"), (9, "A  B"), (10, "word"), (11, passage(2, 9000)), (12, "x" * 5000), (13, "é" * 700 + passage(3)), (14, passage(4) + "\n" + passage(5)),
    (15, passage(6) + " " + passage(5)), (None, passage(7)), (None, passage(1)), (16, passage(8)), (16, passage(8)), (17, "日本語 text İ \x00 ≠ <|endoftext|> don't 12345 ..."),
    (18, "same line\nsame line\nsame line\n\n\nother"), (19, "one two three one two three"), (20, "$$$ ### word&&& %%%" * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, empty and long texts, and columns with clashing names."""
    kinds = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(d, t, [None, "en", "de"][k % 3], [None, "s0"][k % 2], *["x"] * len(CLASHES)) for k, (d, t) in enumerate(ODD)], kinds).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ 1 byte-level BPE

def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_replay_equals_library(texts):
    model, known = bpe.merges(RANKS), encoder()
    cut = re.compile(r"\S+|\s+")
    pieces = [p for t in texts for p in cut.findall(t)]
    flat, counts = model.replay([p.encode() for p in pieces]) if pieces else (np.zeros(0, int), np.zeros(0, int))
    ends = np.cumsum(counts)
    for p, e, c in zip(pieces, ends, counts, strict=True):
        assert flat[e - c : e].tolist() == known._core_bpe.encode_single_piece(p.encode())


@pytest.mark.parametrize("piece", ["a" * 301, "ab" * 99, "=" * 64, "abcabcab" * 7, "\n" * 17, "ééééé", "aaab" * 33])
def test_replay_of_overlaps(piece):
    flat, _ = bpe.merges(RANKS).replay([piece.encode(), b"x", piece.encode()])
    one = encoder()._core_bpe.encode_single_piece(piece.encode())
    assert flat.tolist() == [*one, *encoder()._core_bpe.encode_single_piece(b"x"), *one]


def test_bpe_round_trip(odd, empty):
    known = encoder()
    got = bpe.decode_ids(bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN), RANKS)
    want = sorted((d, known.encode_ordinary(t or ""), (t or "").encode()) for d, t in ODD if d)
    assert sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got.collect() if r.doc_id) == want
    assert got.count() == len(ODD)
    both = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert rows(both) == rows(got)
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ 2 n-gram Jaccard join

def brute_components(texts: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").encode().translate(bytes(LOWER)))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if find(j) == find(i) and texts[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([50, 80, 90, 99]))
def test_sets_that_link_share_a_key(seed, n, gone, new, percent):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    two = np.unique(np.concatenate([rng.permutation(one)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64) * np.uint64(2)]))
    both = len(np.intersect1d(one, two))
    if len(two) and both < max(len(one), len(two)) and 100 * both >= percent * (len(one) + len(two) - both):
        assert len(np.intersect1d(ngram_join.bucket_keys(one, percent), ngram_join.bucket_keys(two, percent)))


@pytest.mark.parametrize(("width", "percent", "chunk"), [(3, 90, 400), (5, 80, 400), (3, 80, 1)])
def test_near_groups(odd, empty, width, percent, chunk):
    assert rows(ngram_join.near_groups(odd, width, percent, chunk=chunk)) == brute_components(ODD, width, percent)
    assert ngram_join.near_groups(empty, width, percent).count() == 0


def test_near_groups_of_variants(spark):
    rng = np.random.default_rng(5)
    texts = []
    for base in range(3):
        words = passage(40 + base, 150).split()
        for k in range(14):
            mine = list(words)
            for p in rng.integers(0, len(mine), rng.integers(0, 8)):
                mine[p] = f"w{rng.integers(10**6)}"
            texts.append((100 * base + k, " ".join(mine)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for chunk in (3, 400):
        assert rows(ngram_join.near_groups(df, 3, 90, chunk=chunk)) == brute_components(texts, 3, 90)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (5, 5), (None, 7)] + [(400, 401 + k) for k in range(20)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 0 for i in range(1, 31)} | {200: 100, 300: 100} | {401 + k: 400 for k in range(20)}


# ------------------------------------------------------------------ 3 exact dedup

@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(50, 5000)))
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.int64)
    bits, unary, rest = exact_dedup.golomb_encode(x, 50, 5001)
    assert exact_dedup.golomb_decode(len(x), bits, unary, rest, 50).tolist() == x.tolist()


def test_exact_groups(odd, empty):
    body = [SPACE_RUN.sub(b" ", (t or "").encode()) for _, t in ODD]
    want = []
    for (d, _), b in zip(ODD, body, strict=True):
        ids = [x for (x, _), y in zip(ODD, body, strict=True) if y == b and x is not None]
        keep = min(ids) if ids else None
        want.append((d, keep, body.count(b), d == keep, hashlib.sha256(b).hexdigest()))
    assert rows(exact_dedup.exact_groups(odd)) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(SPACE_RUN.sub(b" ", (r.text or "").encode()) for r in kept.collect()) == sorted(set(body))


def test_suspects_miss_nothing(spark):
    df = spark.createDataFrame([(k % 4, int(h), k) for k, h in enumerate([7, 7, 1 << 60, -5, 1 << 60, 99, -5, 12345])], "sender int, hash64 long, doc_id long")
    got = {r.doc_id for r in exact_dedup.suspects(df, 8).filter("suspect").collect()}
    assert got >= {0, 1, 2, 3, 4, 6}


# ------------------------------------------------------------------ 4 best-fit packing

def test_packing(odd, empty):
    tool = Tokenizer.from_file(WORDS)
    tool.encode_special_tokens = True
    got = packing.pack_documents(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), WORDS).toPandas()
    texts = dict(ODD)
    for d, g in got.sort_values("piece").groupby("doc_id"):
        want = tool.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        assert b"".join(g.ids) == np.array(want, "<u4").tobytes()
        assert g.start.tolist() == list(range(0, len(want), 2048)) and g.piece.tolist() == list(range(len(g)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack_documents(odd, WORDS).count() >= len(ODD)
    assert packing.pack_documents(empty, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_constraint(lengths, score):
    capacity = (100, 5, 10_000)
    x = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(x, capacity, (1.0, 0.5, 0.5), score)
    for b in set(bins.tolist()):
        mine = np.flatnonzero(bins == b)
        assert x[mine].sum() <= 100 and len(mine) <= 5 and (x[mine] ** 2).sum() <= 10_000
        assert sorted(offsets[mine].tolist()) == sorted((np.cumsum(x[mine][np.argsort(offsets[mine])]) - x[mine][np.argsort(offsets[mine])]).tolist())


def test_a_piece_beyond_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), (10, 5, 1000))


# ------------------------------------------------------------------ 5 suffix-array dedup

def brute_cut(texts: list[bytes], length: int) -> list[tuple]:
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_cut_repeats(odd, empty, hot):
    got = suffix_dedup.cut_repeats(odd, hot=hot)
    want = brute_cut([(t or "").encode() for _, t in ODD], 200)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in got.collect()), key=repr) == sorted(((d, *w) for (d, _), w in zip(ODD, want, strict=True)), key=repr)
    assert suffix_dedup.cut_repeats(empty).count() == 0
    whole = suffix_dedup.cut_documents(odd)
    assert whole.columns == odd.columns and whole.count() == len(ODD)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "ba", "abab", "c", "\x00", "é", passage(9, 12), passage(10, 12)]), max_size=14), min_size=1, max_size=6))
def test_cells_decide_like_brute_force(parts):
    texts = ["".join(p).encode() for p in parts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    length, gram = 40, 16
    got = suffix_dedup.anchors(data, offsets, length, gram)
    n = len(got["row"])
    left, right = np.zeros((n, length - gram), np.uint8), np.zeros((n, length), np.uint8)
    sizes = np.zeros((n, 2), np.int64)
    for i in range(n):
        row, p = texts[got["row"][i]], got["place"][i] - offsets[got["row"][i]]
        a, b = row[max(0, p - length + gram) : p][::-1], row[p : p + length]
        left[i, : len(a)], right[i, : len(b)], sizes[i] = list(a), list(b), (len(a), len(b))
    runs = suffix_dedup.repeated_windows(got["gh"].view(np.int64), left, right, sizes[:, 0], sizes[:, 1], got["place"] - got["first"], got["place"] - got["last"], length)
    gone = np.zeros(len(data), bool)
    for i, a, b in runs:
        gone[got["place"][i] + a : got["place"][i] + b + length] = True
    want = brute_cut(texts, length)
    for k, w in enumerate(want):
        assert int(gone[offsets[k] : offsets[k + 1]].sum()) == w[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6), min_size=1, max_size=30))
def test_blind_trie_sorts(texts):
    order, common = suffix_dedup.blind_order(texts)
    assert [texts[i] for i in order] == sorted(texts)
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        x, y = texts[a], texts[b]
        assert c == next((k for k in range(6) if x[k] != y[k]), 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.sampled_from([0, 1, 255]), min_size=24, max_size=24)), min_size=1, max_size=40))
def test_deep_shallow_sorts(items):
    group = np.array([g for g, _ in items])
    texts = np.array([t for _, t in items], np.uint8)
    order, common = suffix_dedup.deep_shallow(group, texts, shallow=8)
    keys = [(int(group[i]), texts[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for (g, x), (h, y), c in zip(keys, keys[1:], common[1:], strict=False):
        assert c == (-1 if g != h else next((k for k in range(24) if x[k] != y[k]), 24))


# ------------------------------------------------------------------ 6 sharding

@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000])
def test_feistel_is_a_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_number_0")
    got = rows(sharding.feistel_shards(df, n, 8, 3).select("shard", "slot"))
    assert sorted(s + 8 * k for s, k in got) == list(range(n))


def test_sharding(odd, empty):
    got = sharding.shard_documents(odd).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(ODD) and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == want
    again = sharding.shard_documents(odd.repartition(7))
    assert rows(again) == rows(sharding.shard_documents(odd))
    assert sharding.shard_documents(empty).count() == 0


# ------------------------------------------------------------------ 7 WARC

def test_archives(spark, empty):
    bodies = ["<p>é</p>", None, "", "same", "same", "same", "x" * 300_000, "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n"]
    table = [(k, f"http://h/{k} \r\nX: y", b, "x") for k, b in enumerate(bodies)] + [(5, None, "same", "x"), (None, "u", "alone", "x")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, payload string")
    got = warc.archive_pages(pages)
    digest = lambda b: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
    want = []
    for k, _, b, _ in table:
        top = max((x for x, _, y, _ in table if (y or "") == (b or "") and x is not None), default=None)
        many = sum((y or "") == (b or "") for _, _, y, _ in table) > 1
        revisit = many and top is not None and top != k
        want.append((k, len((b or "").encode()), digest(b), "revisit" if revisit else "response", top if revisit else None))
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in got.filter("record_type = 'response'").collect()} == {b or "" for b in bodies} | {"alone"}
    assert warc.archive_pages(pages.limit(0)).count() == 0
    large = warc.archive_pages(pages, least_bytes=5)
    assert large.filter("record_type = 'revisit'").count() == 0


def test_normaliser_and_its_errors():
    records = [warc.record_bytes(str(k), None, "d", b"\0" * 20, 3, b"abc", None) for k in range(5)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    source = whole.compress(b"".join(records)) + whole.flush()
    target = io.BytesIO()
    index = list(warc.normalise_stream(io.BytesIO(source), target))
    assert [zlib.decompress(target.getvalue()[a : a + n], 31) for a, n, _ in index] == records
    again = io.BytesIO()
    assert list(warc.normalise_stream(io.BytesIO(target.getvalue()), again)) == index and again.getvalue() == target.getvalue()
    import gzip
    for broken in (b"no record", records[0][:-20], records[0][:30]):
        with pytest.raises(ValueError):
            list(warc.normalise_stream(io.BytesIO(gzip.compress(broken)), io.BytesIO()))


# ------------------------------------------------------------------ 8 toxicity

def test_swaps_even_out_identity_terms():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        words = list(rng.choice(["tree", "river", "house", "walk", "green"], 8))
        words += ["idiot"] if bad else []
        words += ["muslim"] if bad and k % 2 else ["christian"] if not bad and k % 4 == 0 else []
        texts.append(" ".join(words) + f" n{k}")
        labels.append(float(bad))
    def featured(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return toxicity.text_words(data, np.array([0, len(data)]))[0]
    sets = [featured(t) for t in texts]
    versions = [[v.decode() for v in toxicity.swapped_texts(t.encode())] for t in texts]
    swaps = [[(np.setdiff1d(s, featured(v)), np.setdiff1d(featured(v), s)) for v in vs] for s, vs in zip(sets, versions, strict=True)]
    assert sum(map(len, versions)) == toxicity.SWAPS * sum("muslim" in t or "christian" in t for t in texts)
    probe = [featured("a muslim walk by the river"), featured("a christian walk by the river")]
    models = [toxicity.fit(np.array(labels), sets, swaps=swaps, fairness=f) for f in (0.0, 20.0)]
    gap = [abs(np.subtract(*m.score(probe))) for m in models]
    assert gap[1] < 0.5 * gap[0]
    # the penalised quantity, from whole swapped texts scored again
    moved = [np.mean([(m.score([sets[i]])[0] - m.score([featured(v)])[0]) ** 2 for i, vs in enumerate(versions) for v in vs]) for m in models]
    assert moved[1] < 0.3 * moved[0]


def test_swapped_texts():
    text = "Muslim WOMEN and blackbird, gay; flüchtlinge!".encode()
    got = toxicity.swapped_texts(text)
    assert len(got) == toxicity.SWAPS and toxicity.swapped_texts(b"blackbird") == [] and toxicity.swapped_texts(b"") == []
    for version in got:
        first, second, _, bird, fourth, last = version.decode().split()
        assert first[0].isupper() and first != "Muslim" and first.lower() in toxicity.IDENTITY[4]
        assert second.isupper() and second != "WOMEN" and second.lower() in toxicity.IDENTITY[0]
        assert bird == "blackbird," and fourth != "gay;" and fourth[:-1] in toxicity.IDENTITY[2] and last != "flüchtlinge!" and last[:-1] in toxicity.IDENTITY[8]


def test_toxicity(spark, odd, empty):
    texts = [(k, ("you moron " if k % 5 == 0 else "a fine day ") + passage(300 + k, 20)) for k in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame([(d, t, "en", "toxic") for d, t in texts], "doc_id long, text string, lang string, label string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)] + [(None, 1), (7000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for k in range(400):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert got[k].predicted == int(k % 5 == 0) and 0 <= got[k].score <= 1
    assert got[1000].score == got[1001].score < 0.3
    turned = labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, turned).collect()} == {k: r.score for k, r in got.items()}
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_bounds_of_the_sample_keep_the_scores(spark):
    texts = [(k, ("you moron " if k % 10 == 0 else "") + passage(3000 + k, 20)) for k in range(1600)]
    probes = [(5000, None), (5001, ""), (5002, passage(9000, 20)), (5003, "you moron " + passage(9001, 20))]
    docs = spark.createDataFrame(texts + probes, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1600)], "doc_id long, toxic int")
    whole, cut = ({r.doc_id: r for r in toxicity.toxicity(docs, labels, **caps).filter("doc_id >= 5000").collect()} for caps in ({}, {"most_toxic": 60, "most_clean": 60}))
    learned = [k for k in range(1600) if zlib.crc32(str(k).encode()) % 4 != 2]
    share = (sum(k % 10 == 0 for k in learned) + 0.5) / (len(learned) + 1)
    for k in (5000, 5001):
        assert abs(whole[k].score - share) < 1e-9 and abs(cut[k].score - share) < 1e-9
    for k in (5002, 5003):
        assert cut[k].predicted == whole[k].predicted == int(k == 5003) and abs(cut[k].score - whole[k].score) < 0.05


# ------------------------------------------------------------------ 9 quality rules

def brute_measures(text: str | None) -> tuple:
    data = (text or "").encode()
    words = WORD.findall(data)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    return (len(words), sum(len(w.decode()) for w in words), sum(data.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
            len(lines), len(lines) - len(set(lines)), len(inside))


def test_quality_measures(odd, empty):
    got = quality.quality_rules(odd).select("doc_id", *quality.STATS, "base_failed", "kept")
    want = []
    for d, t in ODD:
        m = brute_measures(t)
        want.append((d, *m, m[0] < 50 or 100 * m[5] > 50 * m[0]))
    assert rows(got.drop("kept")) == sorted(want, key=repr)
    assert got.filter("base_failed and kept").count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert quality.keep_documents(odd).columns == odd.columns


def test_thresholds_follow_the_group(spark):
    plain = [(k, passage(500 + k, 80), "en", "a") for k in range(40)]
    junk = [(100 + k, " ".join(w + "&&&" for w in passage(600 + k, 80).split()), "en", "a") for k in range(3)]
    tables = [(200 + k, " | ".join(passage(700 + k, 80).split()), "en", "tables") for k in range(40)]
    df = spark.createDataFrame(plain + junk + tables, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality_rules(df).filter("kept").collect()}
    assert kept == set(range(40)) | set(range(200, 240))


def test_each_rule_rejects_and_follows_the_source(spark):
    def sourced(first: int, source: str, texts: list[str]) -> list[tuple]:
        return [(first + k, t, "en", source) for k, t in enumerate(texts)]

    def repeated(seed: int, n: int, again: int) -> str:  # 2 * again words stand in repeated windows
        words = passage(seed, n).split()
        return " ".join(words + words[:again])

    clean = [passage(20_000 + k, 100) for k in range(60)]
    rough = [passage(21_000 + k, 100) if k % 8 else repeated(22_000 + k, 100, 10) for k in range(60)]
    listed = ["\n".join([*(w := passage(23_000 + k, 100).split())[:90], *(w[:10] if k % 8 == 0 else w[90:])]) for k in range(60)]
    probes = {"symbol_ratio": " ".join(w + "&&" for w in passage(24_001, 100).split()), "dup_line_ratio": "\n".join([passage(24_002, 15)] + [passage(24_010 + k, 15) for k in range(5)] + [passage(24_002, 15)] * 3),
              "repeat_ratio": repeated(24_003, 100, 20), "word_length": " ".join(w + "abcde" for w in passage(24_004, 100).split())}
    data = sourced(0, "a", clean) + sourced(100, "b", rough) + sourced(200, "c", listed) + sourced(300, "a", list(probes.values()))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    verdict = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert {k: r.failed_rule for k, r in verdict.items() if not r.kept} == {300 + k: v for k, v in enumerate(probes)} and not any(verdict[k].base_failed for k in range(300, 304))
    limits = {r.source: r for r in quality.thresholds(quality.text_measures(df)).collect()}
    assert limits["a"].most_repeat_ratio < limits["b"].most_repeat_ratio < 0.5
    assert limits["a"].most_dup_line_ratio < limits["c"].most_dup_line_ratio < 0.5


def test_small_and_bad_sources_are_filtered(spark):
    def junk(seed: int) -> str:
        return " ".join(w + "&&&" for w in passage(seed, 80).split())

    clean = [(k, passage(30_000 + k, 80), "en", "a") for k in range(80)]
    hot = [(100 + k, junk(31_000 + k), "en", "hot") for k in range(30)] + [(150 + k, passage(32_000 + k, 80), "en", "hot") for k in range(20)]
    small = [(200, junk(33_000), "en", "tiny"), (201, passage(33_001, 80), "en", "tiny"), (202, junk(33_002), "xx", "rare"), (203, junk(33_003), None, None),
             (204, passage(33_004, 80), None, None)]
    df = spark.createDataFrame(clean + hot + small, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality_rules(df).filter("kept").collect()}
    assert kept == set(range(80)) | set(range(150, 170)) | {201, 204}


# ------------------------------------------------------------------ 10 licence scan

def test_license_scan(spark, odd, empty):
    mit = licenses.KNOWN["MIT"]
    texts = [(1, mit), (2, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(" ", "\n  ")), (3, mit + " and more"), (4, "..."), (5, None),
             (6, "Licenced under the Apache Licence, version 2.0"), (7, mit)]
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, license_id string")
    got = {r.doc_id: r.license_id for r in licenses.license_scan(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "Apache-2.0 line", 7: "MIT"}
    known = licenses.known_digests(spark).unionByName(licenses.known_digests(spark))
    assert rows(licenses.license_scan(df, known)) == rows(licenses.license_scan(df))
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(empty).count() == 0


def test_license_files(spark):
    mit, bsd, isc = (licenses.KNOWN[k] for k in ("MIT", "BSD-3-Clause", "ISC"))
    notice = "Copyright (c) 2020-2022 Some Body,\nAn Other,\nA Third\n\n"
    bullets = re.sub(r"(?<=[:.]) [123]\. ", "\n\n  * ", bsd)
    wrapped = bsd.replace("the above copyright", "the above\ncopyright")
    assert bullets != bsd and wrapped.count("\ncopyright") == 2
    shipped = open(public_tokenizers.path("LICENSES.txt"), encoding="utf-8").read()
    shipped = shipped[shipped.index("MIT License") : shipped.index("word_bpe_49k.json:")]
    files = [(1, "MIT License\n\n" + notice + mit, "MIT"), (2, "# The MIT License (MIT)\n=======\n" + notice + mit, "MIT"), (3, shipped, "MIT"),
             (4, "BSD 3-Clause License\r\n\r\nCopyright 2020, The Authors\r\nAll rights reserved.\r\n\r\n" + bsd, "BSD-3-Clause"), (5, bullets, "BSD-3-Clause"),
             (6, 'The BSD 3-Clause "New" License\n' + wrapped, "BSD-3-Clause"), (7, bsd.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) "), "BSD-3-Clause"),
             (8, bsd.replace("the copyright holder nor", "Some Company Inc. nor"), "BSD-3-Clause"), (9, "ISC License\nCopyright The Authors\n" + isc, "ISC"),
             (10, "Released under the MIT License.", "MIT line"), (11, "\n".join(" * " + x for x in re.findall(r".{1,60}(?: |$)", mit)), "MIT"),
             (12, "MIT License\n" + mit + " and more", None), (13, "MIT License\n", None), (14, mit.replace("without restriction", "with restriction"), None),
             (15, bsd.replace("with or without modification", "without modification"), None)]
    df = spark.createDataFrame([x[:2] for x in files], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.license_scan(df).collect()} == {d: k for d, _, k in files}
    # every built-in text has a sign, so that none is left without its file form
    assert all(any(x in t.lower() for x in licenses._SIGNS) for t in (licenses.KNOWN | licenses.FILE_LINES).values())


def test_long_license_files(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    folder = "/usr/share/common-licenses"
    texts = {k: open(f"{folder}/{k}", encoding="utf-8").read() for k in names if os.path.exists(f"{folder}/{k}")}
    if not texts:
        pytest.skip("licence texts are not installed")
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(k + " wrapped", t.replace("\n", "\n   ")) for k, t in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r.license_id for r in licenses.license_scan(df).collect()}
    assert got == {f"{k}{end}": names[k] for k in texts for end in ("", " wrapped")}


def test_spaces_are_those_of_the_rule():
    assert sorted(SPACES) == [9, 10, 11, 12, 13, 32]


def test_records_are_read_in_stretches_of_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions

    pages = spark.range(60).selectExpr("id AS page_id", "'http://h/' AS url", "array_join(sequence(id, id + 400), ' ') AS html")
    index = warc.normalise_archives(warc.write_archives(pages, f"file://{tmp_path}"), f"file://{tmp_path}")
    total = index.agg(functions.sum("length")).first()[0]
    monkeypatch.setattr(warc, "TASK_BYTES", total // 6)
    got = warc.read_records(index, f"file://{tmp_path}").withColumn("task", functions.spark_partition_id())
    tasks = got.groupBy("task").count().collect()
    assert len(tasks) >= 5 and sum(r["count"] for r in tasks) == 60
