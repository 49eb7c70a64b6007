"""Token counts, centroid clustering and whitening against libraries and brute force."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkfolio.llm import centroids, queries, token_counts, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [(1, None), (2, ""), (3, "a b"), (4, "a▁b"), (5, "a b"), (6, " a  b "), (7, "<s> </s> <unk> <0x41>"), (8, "é é \x00 �"), (9, "long words " * 3000),
         (None, "no id"), (None, "a b"), (10, "same"), (10, "same"), (10, "other"), (11, "日本語 テキスト"), (12, "x" * 9000), (13, " " * 300), (14, "ﬁ　\r\n\t")]


@pytest.fixture(scope="module")
def docs(spark):
    names = ("n_tokens", "digest", "raw", "n_bytes", "m_digest", "k_digest", "first_id", "tokenizer", "over_limit")
    return spark.createDataFrame([(d, t, *["x"] * len(names)) for d, t in TEXTS], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)


# ------------------------------------------------------------------ 11 token counts

def test_counts_equal_library_and_are_kept(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 200)
    model = SentencePieceProcessor(model_file=MODEL)
    want = sorted(((d, len((t or "").encode()), n := len(model.encode(t or "")), n > 500) for d, t in TEXTS), key=repr)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, MODEL, cache, most=500)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    stored = docs.sparkSession.read.parquet(cache)
    distinct = {(t or "").replace("▁", " ") for _, t in TEXTS}
    assert stored.count() == len(distinct) == stored.select("digest").distinct().count()  # nothing was encoded twice


def test_cache_is_read_by_version(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    version = token_counts.version_digest(MODEL)
    fake = [(version, hashlib.sha256(b"a b").digest(), 77), (version, hashlib.sha256(b"a b").digest(), 77), ("other", hashlib.sha256(b"same").digest(), 99)]
    spark.createDataFrame(fake, "tokenizer string, digest binary, n_tokens long").write.partitionBy("tokenizer").parquet(cache)
    got = {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, MODEL, cache).collect()}
    assert {(3, 77), (4, 77), (5, 77), (None, 77)} <= got and (10, 99) not in got


def test_counts_of_json_model_and_empty_table(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"]) == sorted((d, len(known.encode(t or "", add_special_tokens=False).ids)) for d, t in TEXTS if d)
    assert token_counts.count_tokens(docs.limit(0), MODEL).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ▁é.\n", max_size=60), st.integers(1, 9))
def test_stretches_keep_the_count(text, most):
    model = token_counts.load(MODEL)
    assert model.cuts and model.marks
    assert sum(len(model.model.encode(p)) for p in token_counts.stretches(text, most)) == len(model.model.encode(text))


# ------------------------------------------------------------------ 12 centroid clustering

def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, vector string, cells string, file string, n string, w1 string").repartition(4)


def vectors(n, size, seed=0, groups=5, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.2, (groups, size))
    return (middle[rng.integers(0, groups, n)] + rng.normal(0, spread * 0.2, (n, size))).astype(np.float32)


def lloyd(rows, k, rounds, size, seed):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    heads = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [list(v) for _, v in heads]

    def assign():
        out = []
        for _, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in middle]
            out.append((gaps.index(min(gaps)), min(gaps)))
        return out

    for _ in range(rounds):
        labels = assign()
        for c in range(len(middle)):
            own = [v for (_, v), (g, _) in zip(kept, labels, strict=True) if g == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    labels = assign()
    inertia = [sum(d for g, d in labels if g == c) for c in range(len(middle))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, g, d, inertia[g], sum(inertia), sha[g]) for (i, _), (g, d) in zip(kept, labels, strict=True)), key=repr)


ODD_VECTORS = [(900, None), (901, []), (902, [0.1] * 5), (903, [0.1] * 5 + [None]), (904, [0.1] * 5 + [float("nan")]), (905, [float("inf")] * 6), (906, [0.0] * 6), (907, [0.0] * 6),
               (None, [0.3] * 6), (None, [-0.0, 100.0, -100.0, 1e-30, 0.1, 0.2]), (908, [0.5] * 6), (908, [0.5] * 6), (908, [-0.5] * 6), (909, [0.1] * 7)]


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_clusters_equal_brute_force(spark, bits):
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors(400, 6, spread=1.0))] + ODD_VECTORS
    got = centroids.cluster_vectors(table(spark, [(i, v, *["x"] * 6) for i, v in data]), k=5, rounds=6, size=6, seed="s", bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(data, 5, 6, 6, "s")


def test_clusters_ties_few_rows_and_empty(spark):
    data = [(k, [1.0 if k % 2 else -1.0, 0.0]) for k in range(3)] + [(k, [0.0, 0.0]) for k in range(3, 40)]
    got = centroids.cluster_vectors(table(spark, [(i, v, *["x"] * 6) for i, v in data], "double"), k=8, rounds=3, size=2, seed="3")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(data, 8, 3, 2, "3")
    few = data[:2]
    got = centroids.cluster_vectors(table(spark, [(i, v, *["x"] * 6) for i, v in few], "double"), k=8, rounds=3, size=2, seed="3")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(few, 8, 3, 2, "3")
    assert centroids.cluster_vectors(table(spark, [(1, None, *["x"] * 6)]), size=2).collect() == []


def test_cells_save_fetches(spark):
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors(3000, 16, 1, 6))]
    fetched: list[int] = []
    got = centroids.cluster_vectors(table(spark, [(i, v, *["x"] * 6) for i, v in data]), k=6, rounds=6, size=16, seed="3", fetched=fetched)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(data, 6, 6, 16, "3")
    assert fetched[0] == 3000 and all(n < 600 for n in fetched[1:])


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 300, (500, 7)).astype(np.int64)
    x[0], x[1] = 5000, -7000
    starts, ends = centroids.cell_edges(x.min(axis=0), x.max(axis=0), x.mean(axis=0), x.std(axis=0), 4)
    cells = centroids.cells_of(x, starts)
    middle = x[::100]
    low, high = centroids.intervals(cells, centroids.distance_tables(middle, starts, ends))
    exact = ((x[:, None] - middle[None]) ** 2).sum(axis=2) - ((x - middle.sum(axis=0) // len(middle)) ** 2).sum(axis=1)[:, None]
    assert (low <= exact).all() and (exact <= high).all()


# ------------------------------------------------------------------ 13 whitening

def whitened_by_hand(rows, size, most):
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(x) for x in zip(*(v for _, v in kept), strict=True)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for _, v in kept), n ** 3) for j in range(size)] for i in range(size)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    order = np.argsort(values)[::-1][:most]
    out = {}
    for i, v in kept:
        centre = np.array([float(Fraction(n * x - s, n)) for x, s in zip(v, sums, strict=True)])
        out.setdefault(i, []).append((sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)), centre @ axes[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / float(sum(cov[k][k] for k in range(size)))


@pytest.mark.parametrize(("n", "size"), [(300, 6), (1000, 12), (70, 3)])
def test_whitening_equals_brute_force(spark, n, size):
    data = [(k, [float(x) for x in v]) for k, v in enumerate(vectors(n, size, n))] + [r for r in ODD_VECTORS if r[0] not in (None, 908)]
    got = whitening.whiten(table(spark, [(i, v, *["x"] * 6) for i, v in data]), 4).collect()
    count, want, share = whitened_by_hand(data, size, 4)
    most = min(4, size)
    assert len(got) == count * most and {r["component"] for r in got} == set(range(1, most + 1)) and {r["n"] for r in got} == {count}
    for c in range(most):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        sign = np.sign(sum(mine[i]["whitened"] * want[i][0][1][c] for i in want))
        for i, r in mine.items():
            assert r["deviation"] == want[i][0][0]
            assert math.isclose(r["whitened"] * sign, want[i][0][1][c], rel_tol=1e-7, abs_tol=1e-7)
            assert math.isclose(r["explained"], share[c], rel_tol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_planes_give_exact_products():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 1 << 11, (200, 5))
    cross, sums = np.zeros((21, 5, 5), np.int64), np.zeros((11, 5), np.int64)
    whitening.add_scatter(whitening.bit_planes(y, 11), cross, sums)
    assert (np.triu(y.T @ y) == np.tensordot(2 ** np.arange(21), cross, 1)).all()
    assert (y.sum(axis=0) == 2 ** np.arange(11) @ sums).all()


def test_whitening_odd_rows(spark):
    got = whitening.whiten(table(spark, [(i, v, *["x"] * 6) for i, v in ODD_VECTORS]), 8).collect()
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == [906, 907, 908] and len(got) == 7 * 6
    flat = whitening.whiten(table(spark, [(k, [0.5, 0.25 * (k % 2)], *["x"] * 6) for k in range(9)], "double"), 8).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True} and flat[0]["identity_error"] < 1e-9
    same = whitening.whiten(table(spark, [(k, [0.5, 0.5], *["x"] * 6) for k in range(9)], "double"), 8).collect()
    assert len(same) == 18 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    assert whitening.whiten(table(spark, [(1, None, *["x"] * 6), (2, [], *["x"] * 6)])).collect() == []
    wide = whitening.whiten(table(spark, [(k, [1e9 * k, 0.0], *["x"] * 6) for k in range(4)], "double"), 2).collect()
    assert any(r["deviation"] is None for r in wide) and wide[0]["identity_error"] < 1e-9


# ------------------------------------------------------------------ whole tables

def test_queries_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op12_centroid_clustering(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lloyd([tuple(r) for r in rows], 8, 10, 64, "3")
    white = queries.op13_embedding_whitening(spark, sf).collect()
    n, want, share = whitened_by_hand([tuple(r) for r in rows], 64, 8)
    assert len(white) == 8 * n and white[0]["identity_error"] < 1e-6
    assert all(r["deviation"] == want[r["vec_id"]][0][0] and math.isclose(abs(r["whitened"]), abs(want[r["vec_id"]][0][1][r["component"] - 1]), abs_tol=1e-6) for r in white)
    assert all(math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-6) for r in white)
    model = SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = queries.op11_token_counts(spark, sf).collect()
    assert len(counts) == len(texts)
    assert all((r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), n := len(model.encode(texts[r["doc_id"]]))) and r["over_limit"] == (n > 4096) for r in counts)
