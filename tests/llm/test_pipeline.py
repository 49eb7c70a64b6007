"""The whole pipeline, stage by stage, against brute force on a small corpus."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkfolio.llm import exact_dedup, ngram_join
from tests.llm.test_llm import SPACE_RUN, brute_components, brute_cut, brute_measures, passage


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    texts = {k: passage(1000 + k, 90 + 7 * k) for k in range(24)}
    shared = passage(2000, 70)
    texts |= {30: texts[3], 31: texts[3].replace(" ", "\n", 4), 32: texts[4] + " end", 33: "en " + texts[4], 34: texts[5] + " " + shared, 35: shared + " " + texts[6][:900],
              36: " ".join(w + "&&&" for w in passage(2100, 120).split()), 37: "word word word " * 60, 38: "short text", 39: "é" + passage(2200, 60) + "é", 40: None, 41: ""}
    near = texts[7].split()
    near[int(rng.integers(len(near)))] = "changed"
    texts[42] = " ".join(near)
    rows = [(d, t, "en", "src", len(t or "")) for d, t in texts.items()]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), texts


def whole_characters(text: bytes, kept: list[bool]) -> str:
    """What stays when removed runs are narrowed to whole characters."""
    inner = [b & 0xC0 == 0x80 for b in text] + [False]
    keep = list(kept)
    for a, b in ((m.start(), m.end()) for m in re.finditer(b"\0+", bytes(kept))):
        while a < b and inner[a]:
            keep[a] = True
            a += 1
        while b > a and inner[b]:
            b -= 1
            keep[b] = True
    return bytes(x for x, k in zip(text, keep, strict=True) if k).decode()


def test_pipeline(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]

    docs = stages["quality_rules"](spark, docs, folder)
    good = {d: t for d, t in texts.items() if (m := brute_measures(t))[0] >= 50 and 100 * m[5] <= 50 * m[0] and m[2] == 0}
    assert {r.doc_id: r.text for r in docs.collect()} == good and docs.columns == columns

    docs = stages["exact_dedup"](spark, docs, folder)
    first: dict[bytes, int] = {}
    for d in sorted(good):
        first.setdefault(SPACE_RUN.sub(b" ", good[d].encode()), d)
    single = {d: good[d] for d in first.values()}
    assert {r.doc_id: r.text for r in docs.collect()} == single and docs.columns == columns

    docs = stages["ngram_jaccard"](spark, docs, folder)
    apart = {d: single[d] for d, _, c in brute_components(sorted(single.items()), 5, 80) if d == c}
    assert {r.doc_id: r.text for r in docs.collect()} == apart and docs.columns == columns
    assert len(good) > len(single) > len(apart)

    docs = stages["suffix_dedup"](spark, docs, folder)
    order = sorted(apart)
    bodies = [apart[d].encode() for d in order]
    seen: dict[bytes, int] = {}
    for b in bodies:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    cut = {}
    for d, b in zip(order, bodies, strict=True):
        kept = [True] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                kept[i : i + 200] = [False] * 200
        cut[d] = whole_characters(b, kept)
    assert {r.doc_id: r.text for r in docs.collect()} == cut and docs.columns == columns
    assert sum(map(len, cut.values())) < sum(map(len, apart.values()))
    assert sum(w[1] for w in brute_cut(bodies, 200)) > 0

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = stages["best_fit_packing"](spark, docs, folder).toPandas()
    for d, t in cut.items():
        ids = np.array(tool.encode(t, add_special_tokens=False).ids + [0], "<u4")
        mine = got[got.doc_id == d].sort_values("piece")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
        assert mine.length.sum() == len(ids)

    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].to_numpy().tolist())) == sorted(map(tuple, got[key].to_numpy().tolist()))


def test_stages_that_drop_rows_bear_clashing_names_odd_ids_and_empty_tables(spark):
    text = " ".join(f"word{k}" for k in range(60))
    names = ("good_id", "good_hash", "row_of_docs", "text_hash", "set_name", "keys", "row", "rid", "component_id", "keep_id")
    rows = [(1, text), (2, text), (2, text), (3, text + " more"), (None, text), (4, None), (4, ""), (5, "another short text"), (5, "another short text")]
    df = spark.createDataFrame([(d, t, *[f"x{k}"] * len(names)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    exact = exact_dedup.drop_copies(df)
    assert exact.columns == df.columns and {(r["doc_id"], r["text"]) for r in exact.collect()} == {(1, text), (3, text + " more"), (4, None), (4, ""), (5, "another short text")}
    near = ngram_join.drop_near_copies(df)
    assert near.columns == df.columns and {r["doc_id"] for r in near.collect()} == {1, 4, 5} and near.filter("doc_id = 1").count() == 1
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0 and ngram_join.drop_near_copies(df.limit(0)).count() == 0
