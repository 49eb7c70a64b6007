"""Postings are counted where a paper lies; papers that share an id are still one."""

from __future__ import annotations

from collections import Counter

from sparkfolio.functions.stem import stem_word
from sparkfolio.operators import search as se

ROWS = [("2401.00001", "Graph graphs", "the running graph"), ("2401.00002", "", ""), ("2401.00003", "Runs", "é e run")]


def _papers(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, title string, abstract string")


def _rows(df):
    return sorted((r["paper_id"], r["length"], r["term"], r["tf_title"], r["tf_abstract"]) for r in df.collect())


def _want(rows, stem):
    out = Counter()
    for p, t, a in rows:
        words = [t.lower().split(), a.lower().replace("é", "e").split()]
        for k, ws in enumerate(words):
            for w in ws:
                out[p, sum(map(len, words)), stem_word(w) if stem else w, k] += 1
    return sorted((p, n, w, out[p, n, w, 0], out[p, n, w, 1]) for p, n, w in {k[:3] for k in out})


def test_tokens_need_no_exchange_and_no_join(spark):
    for stem in (False, True):
        df = se.postings(_papers(spark, ROWS), stem=stem)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert _rows(df) == _want(ROWS, stem)


def test_rows_of_one_id_are_one_paper(spark):
    twice = [*ROWS, ROWS[0], ("2401.00003", "e", "run runs")]
    for stem in (False, True):
        assert _rows(se.postings(_papers(spark, twice), stem=stem)) == _want(twice, stem)
    nulls = [(None, "one", None), (None, "one", "two"), (None, "two", "one")]
    assert _rows(se.postings(_papers(spark, nulls).fillna("", ["paper_id"]))) == [("", 2, "one", 1, 1), ("", 2, "two", 1, 1)]


def test_hits_are_dealt_by_their_number(spark, monkeypatch):
    papers = _papers(spark, [(f"2401.{k:05d}", "graph", f"run {k}") for k in range(40)])
    queries = spark.createDataFrame([(1, "graph run"), (2, "run")], "query_id int, query string")
    find = lambda: se.search_papers(queries, papers, 3)
    whole = sorted(map(tuple, find().collect()))
    monkeypatch.setattr(se, "TASK_HITS", 16)
    df = find()
    assert "RepartitionByExpression [paper_id" in df._jdf.queryExecution().optimizedPlan().toString()
    assert "], 5" in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect())) == whole and len(whole) == 6
