"""Pools and coupling against plain Python: long citer lists, split sets, references that disagree with citations."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import graph as gr


def _case(spark, rng, text=False):
    name = (lambda n: f"w{n:03d}") if text else (lambda n: n)
    kind = "string" if text else "int"
    works = {name(n): rng.choice([None, 1, 2, 7]) for n in range(60)}
    targets = [name(n) for n in range(100, 112)]
    cites = {(rng.choice(targets), w) for w in works for _ in range(5)}
    selected = {s: {name(rng.randrange(60)) for _ in range(2)} for s in range(5)}
    cites |= {(p, name(rng.randrange(60))) for ps in selected.values() for p in ps}
    seeds = {s: {t for t in targets if rng.random() < 0.6} for s in selected}
    lost = set(rng.sample(sorted(cites), 20))
    refs = {(w, t) for t, w in cites - lost} | {(rng.choice(list(works)), rng.choice(targets)) for _ in range(20)}
    frame = lambda rows, cols: spark.createDataFrame(sorted(rows), cols)
    tables = (frame([(s, t) for s, ts in seeds.items() for t in ts], f"set_id int, seed {kind}"),
              frame([(s, p) for s, ps in selected.items() for p in ps], f"set_id int, paper_id {kind}"),
              frame(cites, f"target {kind}, source {kind}"),
              spark.createDataFrame(list(works.items()), f"work_id {kind}, cited_by_count int"))
    return works, cites, selected, seeds, refs, tables, frame(refs, f"source {kind}, target {kind}")


def _pool(works, cites, selected, seeds, n, per_work):
    out = {}
    for s in seeds:
        seen = {}
        for kind, group in ((0, seeds[s]), (1, selected[s])):
            for t in sorted(group):
                ranked = sorted((w for u, w in cites if u == t), key=lambda w: (-(-1 if works[w] is None else works[w]), w))
                for pos, w in enumerate(ranked[:per_work], 1):
                    seen.setdefault(w, []).append((kind, t, pos))
        rows = sorted((-len(v), min(v), w) for w, v in seen.items() if w not in selected[s])[:n]
        out |= {(s, w): (-f, any(k == 1 for k, *_ in seen[w])) for f, _, w in rows}
    return out


@pytest.mark.parametrize("hot,text", [(100_000, False), (3, False), (3, True)])
def test_pool_and_coupling_match_brute_force(spark, monkeypatch, hot, text):
    monkeypatch.setattr(gr, "HOT_SET", hot)
    works, cites, selected, seeds, refs, (sd, sel, ct, wk), rf = _case(spark, random.Random(hot), text)
    pool = gr.citer_pool(sd, sel, ct, wk, n=15, per_work=6)
    want = _pool(works, cites, selected, seeds, 15, 6)
    assert {(r["set_id"], r["work_id"]): (r["freq"], r["direct"]) for r in pool.collect()} == want
    known = {w: {t for v, t in refs if v == w} for w in works}
    shared = {(s, w): len(known[w] & seeds[s]) for s, w in want if known[w]}
    shared = {k: v for k, v in shared.items() if v >= 1 or want[k][1]}
    marked = pool.selectExpr("*", "false AS in_index")
    lists = gr.listed_citers(sd, sel, ct, wk, per_work=6)
    for listed in (lists, None):
        got = gr.coupling(marked, sd, rf, wk, listed=listed).collect()
        assert {(r["set_id"], r["work_id"]): r["shared"] for r in got} == shared


def test_pool_and_coupling_of_empty_tables(spark):
    works, _, _, _, _, (sd, sel, ct, wk), rf = _case(spark, random.Random(1))
    none = lambda df: df.limit(0)
    pool = gr.citer_pool(none(sd), none(sel), ct, wk).selectExpr("*", "false AS in_index")
    assert pool.collect() == []
    assert gr.coupling(pool, sd, rf, wk, listed=gr.listed_citers(none(sd), none(sel), ct, wk)).collect() == []
    assert gr.citer_pool(sd, sel, none(ct), wk).collect() == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_are_counted_one_by_one(spark):
    """No table of all (set, work) counts or (set, target) lists: sets stream through one exchange each."""
    _, _, _, _, _, (sd, sel, ct, wk), rf = _case(spark, random.Random(2))
    nodes = spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "set_id int, work_id int")
    for df in (gr.citer_pool(sd, sel, ct, wk), gr.coupling_pairs(nodes, rf), gr.most_cited(nodes, rf)):
        assert "MapInArrow" in _plan(df)


@pytest.mark.parametrize("text", [False, True])
def test_pairs_and_prior_works_match_brute_force(spark, text):
    rng = random.Random(7)
    name = (lambda n: f"w{n:03d}") if text else (lambda n: n)
    kind = "string" if text else "int"
    refs = {w: {rng.choice([name(t) for t in range(40, 60)] + [None]) for _ in range(5)} for w in map(name, range(30))}
    nodes = {(s, name(rng.randrange(32))) for s in (0, 1, 2, None) for _ in range(12)}
    picked = {(s, name(rng.randrange(40, 60))) for s in (0, 1, 2, None) for _ in range(3)}
    nd = spark.createDataFrame(list(nodes), f"set_id int, work_id {kind}")
    rf = spark.createDataFrame([(w, t) for w, ts in refs.items() for t in ts], f"source {kind}, target {kind}")
    pairs = {}
    for s, a in nodes:
        for r, b in nodes:
            if s == r and a < b and (n := len(refs.get(a, set()) & refs.get(b, set()))):
                pairs[s, a, b] = (n, n / (len(refs[a]) * len(refs[b])) ** 0.5)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in gr.coupling_pairs(nd, rf).collect()}
    assert got.keys() == pairs.keys()
    assert all(got[k][0] == n and got[k][1] == pytest.approx(w) for k, (n, w) in pairs.items())
    support = {}
    for s, w in nodes:
        for t in refs.get(w, ()):
            support[s, t] = support.get((s, t), 0) + 1
    assert {(r[0], r[1]): r[2] for r in gr.most_cited(nd, rf).collect()} == support
    known = spark.createDataFrame([(name(t),) for t in range(40, 60, 2)], f"work_id {kind}")
    sel = spark.createDataFrame(list(picked), f"set_id int, paper_id {kind}")
    allowed = {name(t) for t in range(40, 60, 2)}
    left = {k: v for k, v in support.items() if k not in {p for p in picked if p[0] is not None} and k[1] in allowed}
    want = {}
    for s in {k[0] for k in left}:
        ranked = sorted((-v, t) for (r, t), v in left.items() if r == s)[:10]
        want |= {(s, t): (-v, i) for i, (v, t) in enumerate(ranked, 1)}
    assert {(r["set_id"], r["work_id"]): (r["support"], r["rank"]) for r in gr.prior_works(nd, sel, rf, known).collect()} == want


def _cited(spark, seed):
    """Sets, references, citing works with repeated and null keys, and counts; one work is cited by most."""
    rng = random.Random(seed)
    sel = [(i // 3, i % 3, f"p{i}") for i in range(30)]
    refs = [(i // 3, i % 3, f"p{i}", k, rng.choice([f"s{rng.randrange(12)}", f"p{rng.randrange(30)}"])) for i in range(30) for k in range(8)]
    cites = [(f"c{rng.randrange(90)}", "p4" if rng.random() < 0.4 else f"p{rng.randrange(30)}") for _ in range(600)] + [(None, "p4"), ("c1", None), ("p5", "p4")]
    works = [(f"{x}{i}", rng.choice([None, 1, 2, 3]), rng.choice([None, 2001, 2002])) for x in "pcs" for i in range(80)]
    return (spark.createDataFrame(sel, "set_id int, pos int, paper_id string"),
            spark.createDataFrame(refs + refs[:9], "set_id int, source_pos int, source string, ref_index int, target string"),
            spark.createDataFrame(cites, "source string, target string"), spark.createDataFrame(works, "work_id string, cited_by_count int, year int"))


def test_graphs_in_many_tasks_are_those_of_one(spark, monkeypatch):
    tables = _cited(spark, 3)
    rows = lambda: [sorted(map(tuple, df.collect()), key=str) for df in (*gr.citation_graph(*tables), gr.followups(tables[0], *tables[2:]), gr.support(tables[1]))]
    want = rows()
    monkeypatch.setattr(gr, "TASK_ROWS", 40)
    assert rows() == want


def test_graph_tasks_grow_with_the_rows(spark, monkeypatch):
    """Spark alone would merge these few bytes into one task, whatever the number of rows."""
    monkeypatch.setattr(gr, "TASK_ROWS", 40, raising=False)
    tables = _cited(spark, 4)
    for df in (*gr.citation_graph(*tables), gr.followups(tables[0], *tables[2:])):
        assert df.rdd.getNumPartitions() >= 15


def test_a_frequent_group_is_cut_in_many_tasks(spark):
    rows = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("x"), F.pmod(F.hash("id"), F.lit(50)).alias("v"))
    order = [F.col("v").desc(), F.col("x")]
    pairs = lambda df: [tuple(r) for r in df.select("x", "rank").orderBy("rank").collect()]
    assert pairs(gr.topk_dealt(rows, ["g"], order, 9, 20, "x")) == pairs(gr.topk(rows, ["g"], order, 9))


def _rows(*frames):
    return [sorted(map(tuple, df.collect()), key=str) for df in frames]


def test_graphs_in_passes_are_those_of_one(spark, monkeypatch):
    """Large graphs are made some sets after the other; what is left to run does not rank citations again."""
    tables = _cited(spark, 5)
    both = lambda: (*gr.citation_graph(*tables), gr.followups(tables[0], *tables[2:]))
    want = _rows(*both())
    for name, value in (("TASK_ROWS", 10), ("PASS_TASKS", 1), ("MAX_PASSES", 3)):
        monkeypatch.setattr(gr, name, value, raising=False)
    got = both()
    assert _rows(*got) == want
    assert "Window" not in _plan(got[1]) and "Aggregate" not in _plan(got[2])


def test_pools_in_passes_are_those_of_one(spark, monkeypatch):
    works, _, _, _, _, (sd, sel, ct, wk), rf = _case(spark, random.Random(11))
    marked = lambda pool: pool.selectExpr("*", "work_id % 4 = 0 AS in_index")
    pool = gr.citer_pool(sd, sel, ct, wk, n=15, per_work=6)
    lists = gr.listed_citers(sd, sel, ct, wk, per_work=6)
    nodes = pool.select("set_id", "work_id")
    made = lambda pool, **passes: _rows(
        pool, gr.coupling(marked(pool), sd, rf, wk, listed=lists, **passes), gr.coupling(marked(pool), sd, rf, wk, **passes),
        gr.coupling_edges(nodes, rf, **passes), gr.most_cited(nodes, rf, **passes), gr.prior_works(nodes, sel, rf, rf.selectExpr("target AS work_id"), **passes))
    want = made(pool)
    monkeypatch.setattr(gr, "PASS_IDS", 20, raising=False)
    monkeypatch.setattr(gr, "MAX_PASSES", 2, raising=False)
    pool = gr.citer_pool(sd, sel, ct, wk, n=15, per_work=6)
    assert "MapInArrow" not in _plan(pool) and "Join" not in _plan(pool)
    assert want[0] and want[3] and made(pool, passes=2) == want


def test_stored_rows_leave_no_exchange_on_disk(spark):
    from sparkfolio.scale import stored

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    before = files()
    parts = [spark.range(2000).groupBy((F.col("id") % 500).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(f"k % 2 = {i}") for i in range(2)]
    df = stored(*parts)
    for _ in range(50):  # removed by a message to the executors
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert df.count() == 500 and df.agg(F.sum("n")).first()[0] == 2000 and df.columns == ["k", "n"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
