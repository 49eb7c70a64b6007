"""Small fixtures: resolution, graphs, grounding, records, streams, skew-safe aggregates."""

import json
import random

import pytest
from pyspark.sql import Window, functions as F

from sparkfolio import scale
from sparkfolio.functions import ids, numbers as nb, redact as rd, text as tx
from sparkfolio.functions.stem import nfkd_fold, stem_word
from sparkfolio.functions.tex import tex_to_text
from sparkfolio.operators import (
    context as cx, eventlog as el, filters as fl, graph as gr, ground as gd, joins as jn, markdown as mk, recall as rc, resolve as rs, search as se,
)
from sparkfolio.sources import pages as sp, papers as src, records as rec
from sparkfolio.streaming import runs as st


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


# --- skew-safe aggregates ----------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 else i % 7, i, rng.choice([None, -2.5, 0.0, rng.random() * 10 ** rng.randint(-3, 6)])) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, pos int, v double")


def test_running_equals_window(skewed):
    out = scale.running(skewed, ["k"], scale.position_block(F.col("pos"), 64), ["pos"], sums={"s": F.col("v")}, lasts={"l": F.col("v")},
                        maxes={"m": F.col("v")}, before=["l"])
    w = Window.partitionBy("k").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("k", "pos", F.coalesce(F.sum("v").over(upto), F.lit(0.0)).alias("s"), F.last("v", ignorenulls=True).over(before).alias("l"),
                         F.max("v").over(upto).alias("m"))
    key = lambda r: (r["k"], r["pos"], None if r["s"] is None else round(r["s"], 3), r["l"], r["m"])
    assert sorted(map(key, out.collect()), key=str) == sorted(map(key, want.collect()), key=str)


def test_percentiles_equal_builtin(skewed):
    got = {r["k"]: r for r in scale.exact_percentiles(skewed, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.9, "d": 1.0}).collect()}
    want = skewed.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in (("a", 0.0), ("b", 0.37), ("c", 0.9), ("d", 1.0))])
    for r in want.collect():
        for n in "abcd":
            assert got[r["k"]][n] == pytest.approx(r[n])
    total = scale.exact_percentiles(skewed, [], "v", {"m": 0.5}).first()["m"]
    assert total == pytest.approx(skewed.agg(F.percentile("v", 0.5).alias("m")).first()["m"])


# --- scalars -----------------------------------------------------------------

@pytest.mark.parametrize("title,topic", [
    ("A Survey on Graph Widgets", "Graph Widgets"), ("Graph Widgets: A Comprehensive Review", "Graph Widgets"),
    ("Widgets in the Wild: A Systematic Literature Review and Taxonomy", "Widgets in the Wild"),
    ("Review Mining with Widgets", "Review Mining with Widgets"), ("Surveys", "Surveys"), ("The State: of - Things", "State of Things")])
def test_topic_query(spark, title, topic):
    assert one(spark, tx.topic_query(F.lit(title))) == topic


@pytest.mark.parametrize("tex,plain", [
    (r"x^{2}+y_{ij}", "x^2+y_(ij)"), (r"\frac{a}{b}\times 10", "(a)/(b)× 10"), (r"\mathbf{W}\in\mathbb{R}", "W∈R"), ("plain  text", "plain text"), (r"5\%\,\sqrt{n}", "5% √(n)")])
def test_tex(spark, tex, plain):
    assert one(spark, tex_to_text(F.lit(tex))) == plain


@pytest.mark.parametrize("token,percent,want", [
    ("46,9", False, {"46.9"}), ("1,500", False, {"1500", "1.5"}), ("1.500", False, {"1500", "1.5"}), ("46,9", True, {"46.9", "0.469"}), ("+7", False, {"7"})])
def test_number_variants(spark, token, percent, want):
    assert set(one(spark, nb.number_variants(F.lit(token), F.lit(percent)))) == want


@pytest.mark.parametrize("raw,masked", [
    ("api_key = abc123; ok", "api_key=[REDACTED]; ok"), ("use sk-abcdefgh12 now", "use [REDACTED] now"),
    ("see https://host.org/?next=C:/tmp/file end", "see https://host.org/?next=C:/tmp/file end"), ("at C:\\cache\\a.pdf, ok", "at [path omitted], ok"),
    ("in /home/me/x.txt", "in [path omitted]"), ("Traceback (most recent call last)\n a\nValueError: x", "ValueError: x")])
def test_redact(spark, raw, masked):
    assert one(spark, rd.redact(F.lit(raw))) == masked


def test_stems_and_folding(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop",
             "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic",
             "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control"}
    assert {w: stem_word(w) for w in pairs} == pairs
    df = spark.createDataFrame([("Éçole ﬁn ²",)], "t string")
    assert df.select(nfkd_fold("t").alias("t")).first()["t"] == "Ecole fin 2"


def test_result_delta(spark):
    rows = [("b", "acc", "%", "46.9", "base", "44.25"), ("b", "acc %", "%", "12%", "", ""), ("b", "f1", "", "1.00/0.87", "x", "2"), ("b", "f1", "", "46.9 ± 3.1", "x", "50")]
    df = spark.createDataFrame(rows, "benchmark string, metric string, unit string, method_value string, baseline_name string, baseline_value string")
    got = [(r["metric"], r["baseline"], r["delta"]) for r in cx.results_rows(df).collect()]
    assert got == [("acc (%)", "44.25 base", "+2.65"), ("acc %", "", ""), ("f1", "2 x", ""), ("f1", "50 x", "-3.1")]


# --- search, recall ----------------------------------------------------------

@pytest.fixture(scope="module")
def papers(spark):
    rows = [("2401.00001", "Graph widgets learn", "about gears", "cs.AI x", "2024-01-01", ""), ("2401.00002", "Gears", "graph widgets everywhere in gears", "cs.LG", "2024-02-01", ""),
            ("cs/0101001", "Old graph widgets", "gear", "cs.AI", "2001-01-01", ""), ("2401.00003", "Learning widget", "text c++ key:value", "math.CO", "2025-01-01", "10.1/AB"),
            ("2401.00004", "Two equal titles here", "x", "cs.AI", "2024-01-05", "10.1/cd"), ("2401.00005", "Two Equal Titles, here!", "y", "cs.AI", "2024-01-06", "10.1/CD"),
            ("2401.00006", "Two words", "z", "cs.AI", "2024-01-07", "")]
    rows += [(f"2402.{i:05d}", f"filler number {i}", "nothing to see", "q.FIL", "2024-03-01", "") for i in range(12)]
    return spark.createDataFrame(rows, "paper_id string, title string, abstract string, categories string, date string, doi string")


def search(spark, papers, text, k=5, **kw):
    q = spark.createDataFrame([(1, text)], "query_id int, query string")
    return [(r["paper_id"], r["tier"]) for r in se.search_papers(q, papers, k, **kw).orderBy("rank").collect()]


def test_search_rules(spark, papers):
    hits = search(spark, papers, "the graph widget")
    assert hits[0][0] in ("2401.00001", "cs/0101001") and hits[0][1] == 0
    assert [h[1] for h in hits] == sorted(h[1] for h in hits)
    assert ("2401.00003", 1) in hits                                  # stemmed "widget" fills the list
    modern = papers.filter(fl.modern_ids(F.col("paper_id")) & fl.date_before(F.col("date"), "2024-12-31"))
    assert "cs/0101001" not in [h[0] for h in search(spark, papers, "graph widgets", allowed=modern)]


@pytest.mark.parametrize("text", ["", '"unbalanced', "AND OR NOT", "(((", 'a" OR "b --', "*:^", "the of in"])
def test_hostile_queries(spark, papers, text):
    search(spark, papers, text)


def test_stored_index_equals_direct_search(spark, papers, tmp_path):
    q = spark.createDataFrame([(1, "graph widgets"), (2, "learning gears"), (3, "nothing here")], "query_id int, query string")
    se.write_index(papers, str(tmp_path / "ix"))
    got = se.search_index(spark, str(tmp_path / "ix"), q, 4).orderBy("query_id", "rank").collect()
    assert got == se.search_papers(q, papers, 4).orderBy("query_id", "rank").collect()


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, r, i) for r, i in enumerate(["a", "b", "a", "c", "d", "e", "f"], 1)], "query_id int, rank int, paper_id string")
    gold = spark.createDataFrame([(1, "c"), (1, "f"), (1, "zz"), (1, "a")], "query_id int, paper_id string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    m = {r["query_id"]: r for r in rc.query_metrics(rc.unique_ranking(ranking), gold, queries, [1, 10]).collect()}
    assert (m[1]["recall_1"], m[1]["recall_5"], m[1]["recall_10"], m[1]["precision_5"], m[1]["mrr"]) == (0.25, 0.5, 0.75, 0.4, 1.0)
    assert (m[2]["recall_10"], m[2]["mrr"], m[2]["n_gold"]) == (0.0, 0.0, 0)


# --- resolution --------------------------------------------------------------

def test_resolution_order(spark, papers):
    refs = [(1, "arXiv:9901.00001v3", None, ""), (2, None, "https://doi.org/10.48550/arXiv.2401.00009v1", ""), (3, None, "https://doi.org/10.1/ab.", "Gears"),
            (4, None, "10.1/CD", "Graph widgets learn: more"), (5, None, None, "Two equal titles here"), (6, None, None, "Two words"), (7, "junk", "10.9/none", "filler number 3"),
            (8, None, None, "Filler NUMBER é 3 three four")]
    df = spark.createDataFrame([("p", *r) for r in refs], "paper_id string, ref_index int, arxiv_id string, doi string, title string")
    got = {r["ref_index"]: (r["target"], r["method"], r["ambiguous"]) for r in rs.resolve_refs(df, papers).collect()}
    assert got == {1: ("9901.00001", "explicit", False), 2: ("2401.00009", "arxiv_doi", False), 3: ("2401.00003", "index_doi", False), 4: (None, None, False),
                   5: (None, None, True), 6: (None, None, False), 7: (None, None, False), 8: (None, None, False)}


def test_strict_resolution_falls_through(spark, papers):
    p = papers.withColumn("pos", F.monotonically_increasing_id())
    df = spark.createDataFrame([("p", 1, "9901.00001", "10.1/ab", ""), ("p", 2, "2401.00001v4", None, ""), ("p", 3, None, "10.48550/arxiv.2401.00002", ""), ("p", 4, None, "10.1/cd", "")],
                               "paper_id string, ref_index int, arxiv_id string, doi string, title string")
    got = {r["ref_index"]: (r["target"], r["method"]) for r in rs.resolve_refs_strict(df, p).collect()}
    assert got == {1: ("2401.00003", "doi_metadata"), 2: ("2401.00001", "arxiv_id"), 3: ("2401.00002", "doi_arxiv"), 4: ("2401.00004", "doi_metadata")}


def test_title_repair(spark):
    works = spark.createDataFrame([("w1", "A graph of small widgets", 5), ("w2", "a graph of small Widgets", 9), ("w3", "Graphs", 50), ("w4", "a graph of small widgets too", 7)],
                                  "work_id string, title string, cited_by_count int")
    bad = spark.createDataFrame([("x", "A Graph of Small Widgets"), ("y", "Unknown thing")], "id string, title string")
    assert [tuple(r) for r in rs.repair_by_title(bad, works).collect()] == [("x", "w2", 9)]


# --- graphs ------------------------------------------------------------------

def test_roles_and_ties(spark):
    sel = spark.createDataFrame([(1, 0, "A"), (1, 1, "B")], "set_id int, pos int, paper_id string")
    refs = spark.createDataFrame([(1, 0, "A", i, t) for i, t in enumerate(["x", "y", "z", "B", "A"])] + [(1, 1, "B", i, t) for i, t in enumerate(["y", "x", "q", "x"])],
                                 "set_id int, source_pos int, source string, ref_index int, target string")
    works = spark.createDataFrame([("x", 10, 2001), ("y", 10, 2002), ("A", 1, 2020), ("B", 2, 2021), ("c1", 7, 2022), ("c2", None, 2023)], "work_id string, cited_by_count int, year int")
    cites = spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "A"), ("B", "A")], "source string, target string")
    nodes, edges = gr.citation_graph(sel, refs, cites, works)
    got = {(r["id"], r["role"], r["support"]) for r in nodes.collect()}
    assert got == {("A", "selected", 0), ("B", "selected", 0), ("y", "foundational", 2), ("x", "foundational", 2), ("c1", "followup", 2), ("c2", "followup", 1)}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("A", "x"), ("A", "y"), ("B", "x"), ("B", "y"), ("A", "B"), ("c1", "A"), ("c1", "B"), ("c2", "A")}
    ranked = gr.foundational(gr.support(refs).join(works.withColumnRenamed("work_id", "target"), "target", "left"), sel)
    assert [r["target"] for r in ranked.orderBy("rank").collect()] == ["y", "x"]        # equal counts: the newer year first


def test_single_selection_uses_bibliography_order(spark):
    sel = spark.createDataFrame([(1, 0, "A")], "set_id int, pos int, paper_id string")
    refs = spark.createDataFrame([(1, 0, "A", i, t) for i, t in enumerate("mlk")], "set_id int, source_pos int, source string, ref_index int, target string")
    cands = gr.support(refs).withColumn("cited_by_count", F.lit(None).cast("int")).withColumn("year", F.lit(None).cast("int"))
    assert [r["target"] for r in gr.foundational(cands, sel, 2).orderBy("rank").collect()] == ["m", "l"]
    known = cands.withColumn("cited_by_count", F.when(F.col("target") == "k", 3))
    assert [r["target"] for r in gr.foundational(known, sel, 2).orderBy("rank").collect()] == ["k", "m"]


def test_coupling_edges_match_brute_force(spark):
    rng = random.Random(5)
    refs = {n: set(rng.sample(range(30), rng.randint(1, 9))) for n in range(14)}
    nodes = spark.createDataFrame([(1, n) for n in refs], "set_id int, work_id int")
    edges = spark.createDataFrame([(n, t) for n, ts in refs.items() for t in ts], "source int, target int")
    near = {n: [] for n in refs}
    for a in refs:
        for b in refs:
            w = len(refs[a] & refs[b]) / (len(refs[a]) * len(refs[b])) ** 0.5
            if a != b and w >= 0.05:
                near[a].append((-round(w, 9), b))
    want = {(min(a, b), max(a, b), round(-w, 4)) for a in near for w, b in sorted(near[a])[:4]}
    got = {(r["source"], r["target"], r["weight"]) for r in gr.coupling_edges(nodes, edges).collect()}
    assert got == want


def test_drop_unverified(spark):
    w = spark.createDataFrame([(1, "x", 0, "openalex"), (2, None, 3, "openalex"), (3, None, 0, "reference"), (4, None, None, "openalex")], "work_id int, arxiv_id string, n_refs int, title_source string")
    assert sorted(r["work_id"] for r in gr.drop_unverified(w).collect()) == [1, 2, 3]


# --- grounding ---------------------------------------------------------------

def test_ground_rows(spark):
    rows = [("p", 0, "Set A", "acc", "46.9", "Base", "44.0", "Table 1", "we reach 46.9"), ("p", 1, "Set A", "acc", "99.9", "", "", "", ""),
            ("p", 2, "set a", "ACC", "46.9", "x", "44.0", "", ""), ("p", 3, "Set B", "f1", "1,500", "Old", "n/a", "Table 9", "made up"), ("p", 4, "", "f1", "46.9", "", "", "", "")]
    df = spark.createDataFrame(rows, "paper_id string, pos int, benchmark string, metric string, method_value string, baseline_name string, baseline_value string, table_label string, source_quote string")
    corpus = spark.createDataFrame([("p", "Here we  reach 46.9 against 44 with 1500 steps.")], "paper_id string, text string")
    tables = spark.createDataFrame([("p", "table 1", "46.9 | 44.0"), ("p", "Table 9", "none")], "paper_id string, label string, text string")
    kept, counts = gd.ground_rows(df, corpus, tables)
    got = {r["pos"]: (r["baseline_name"], r["table_label"], r["source_quote"]) for r in kept.collect()}
    assert got == {0: ("Base", "Table 1", "we reach 46.9"), 3: ("", "", "")}
    assert tuple(counts.first()) == ("p", 5, 2, 3)


def test_hardware_claim(spark):
    src_text = F.lit("Training used 8 NVIDIA A100 GPUs with 80 GB memory each.")
    ok = lambda t: one(spark, gd.text_in_source(F.lit(t), src_text))
    assert ok("8 NVIDIA A100 GPUs (80GB)") and not ok("16 A100 GPUs") and not ok("") and not ok("cluster of unknown machines")


def test_report_checks(spark):
    good = "# T\n## 1. a\nx\n## 2. b\n### P\n- **Insight**: i\n- Metrics: m\n* Setup: s\n```\n## 9. no\n```\n## 3. c\nbody\n## 4. d\n## 5. e\n"
    swapped = good.replace("## 4. d\n## 5. e", "## 5. e\n## 4. d").replace("- Metrics: m\n", "")
    df = spark.createDataFrame([("g", good, 1), ("s", swapped, 2)], "report_id string, text string, n_papers int")
    status = lambda f: {r["report_id"]: r["status"] for r in f(df).collect()}
    assert status(gd.check_structure) == {"g": "PASS", "s": "FAIL"}
    assert status(gd.check_bullets) == {"g": "PASS", "s": "FAIL"}
    assert status(gd.check_context) == {"g": "PASS", "s": "PASS"}


# --- records -----------------------------------------------------------------

def test_goldset_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("s", "q", "2024-01-01", t) for t in ("b", "a")], "survey_id string, query string, date string, target string")
    rec.write_goldset(g, str(tmp_path / "g"))
    (tmp_path / "g" / "extra.json").write_text('\n\n{"survey_id": "t", "query": "z", "gold": ["c"]}\n\n')
    assert sorted((r["survey_id"], r["gold"]) for r in rec.read_goldset(spark, str(tmp_path / "g")).collect()) == [("s", ["a", "b"]), ("t", ["c"])]


def test_threads(spark, tmp_path):
    ok = {"version": 1, "threadId": "t1", "title": "", "createdAt": "a", "updatedAt": "b", "messages": [{"role": "user", "content": "hi"}],
          "runs": [{"runId": "r1", "status": "running"}, {"runId": "r2", "status": "success", "answer": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps(ok, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({**ok, "version": 2, "threadId": "t2"}))
    (tmp_path / "c.json").write_text("{broken")
    threads, messages, runs = rec.read_threads(spark, str(tmp_path))
    assert [tuple(r)[:2] for r in threads.collect()] == [("t1", "New research")]
    assert [(r["run_id"], r["status"]) for r in runs.orderBy("pos").collect()] == [("r1", "error"), ("r2", "success")]
    assert messages.count() == 1


def test_thread_snapshots(spark):
    threads = spark.createDataFrame([(1, "New research", 5), (2, "Mine", 9), (3, "New research", 1)], "thread_id int, title string, updated_at int")
    messages = spark.createDataFrame([(1, 1, 7, "user", " Ask  me "), (1, 0, 6, "assistant", "hi"), (1, 2, 8, "user", "x"), (2, 0, 2, "user", "y")],
                                     "thread_id int, pos int, at int, role string, content string")
    runs = spark.createDataFrame([(1, 0, 20, "r1")], "thread_id int, pos int, at int, run_id string")
    out = jn.thread_snapshots(threads, messages, runs, runs.limit(0), piece_rows=2).orderBy("thread_id", "piece").collect()
    assert [(r["thread_id"], r["piece"], r["updated_at"], [m["pos"] for m in r["messages"]], len(r["runs"]), len(r["artifacts"])) for r in out] == [
        (1, 0, 20, [0, 1], 1, 0), (1, 1, 20, [2], 0, 0), (2, 0, 9, [0], 0, 0), (3, 0, 1, [], 0, 0)]
    assert out[0]["title"].startswith("Ask") and [r["title"] for r in out[2:]] == ["Mine", "New research"]


def test_run_artifacts(spark, tmp_path):
    new, old = tmp_path / "new", tmp_path / "old"
    (old / "notes").mkdir(parents=True)
    new.mkdir()
    (new / "run.json").write_text('{"status": "running", "total_seconds": 5}')
    (new / "state.json").write_text(json.dumps({"status": "success", "selected_papers": [{"paper_id": "arxiv_1", "notes": {"problem": "p", "method": None}}]}))
    (old / "run.json").write_text(json.dumps({"total_seconds": 9, "artifacts": {"pmrl_by_paper": {"arxiv_2401.00001": "notes/a.json"}}}))
    (old / "notes" / "a.json").write_text('{"problem": "x", "method": "y", "result": "", "limitation": "z"}')
    runs, notes = rec.read_run_artifacts(spark, str(tmp_path))
    assert sorted(tuple(r) for r in runs.collect()) == [("new", "output", "success", 5.0), ("old", "baseline", "unknown", 9.0)]
    texts = {(r["run_id"], r["arxiv_id"], r["field"]): r["text"] for r in notes.collect()}
    assert texts[("old", "2401.00001", "method")] == "y" and texts[("new", "1", "problem")] == "p" and texts[("new", "1", "method")] == ""
    assert len(texts) == 8


def test_failed_snapshot_keeps_old_data(spark, tmp_path):
    src.write_snapshot(spark.range(3), str(tmp_path), "v1")
    with pytest.raises(Exception):
        src.write_snapshot(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), str(tmp_path), "v2")
    assert src.read_snapshot(spark, str(tmp_path)).count() == 3


def test_page_files(spark, tmp_path):
    (tmp_path / "ar5iv_1.html").write_text('<div class="ltx_document">x</div>')
    (tmp_path / "other.html").write_text("<p>plain</p>")
    got = {r["page_id"]: (r["source"], r["is_paper"]) for r in sp.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"ar5iv_1.html": ("ar5iv", True), "other.html": ("unknown", False)}


def test_link_rewrite(spark):
    text = ("# R\n[ok](http://github.com/a/b) [Widgets](paper.pdf) [Same](#) [bad](file:///etc/x) <https://evil.x/y> and https://arxiv.org/abs/2401.00001 or https://evil.x\n"
            "![img](<./a.png>) [C:\\x](url)")
    r = spark.createDataFrame([(1, text)], "report_id int, text string")
    p = spark.createDataFrame([(1, "Widgets", "2401.00001"), (1, "Same title one", "2401.00002"), (1, "Same title two", "2401.00003")], "report_id int, title string, arxiv_id string")
    note = "_(link unavailable: unverified source)_"
    assert mk.rewrite_links(r, p).first()["text"] == (
        f"# R\n[ok](https://github.com/a/b) [Widgets](https://arxiv.org/pdf/2401.00001.pdf) Same {note} bad {note} `Unverified link` {note} and "
        f"https://arxiv.org/abs/2401.00001 or `Unverified link` {note}\nimg {note} Unverified link {note}")


def test_chunk_restart(spark):
    chunks = spark.createDataFrame([(1, 0, "Hello wor"), (1, 1, "Hello world and"), (1, 2, " more"), (2, 0, "ab"), (2, 1, "abab")], "run_id int, pos int, text string")
    got = {r["run_id"]: r["text"] for r in el.merge_chunks(el.flag_restarts(chunks)).collect()}
    assert got == {1: "Hello world and more", 2: "ababab"}
    assert el.flag_restarts(chunks.limit(0)).count() == 0


def test_chunk_restart_against_a_fold(spark):
    rng, table, want = random.Random(5), [], []
    for run in range(40):
        so_far = ""
        for pos in range(rng.randint(1, 25)):
            kind = rng.random()
            text = so_far + rng.choice(["", "é", "more "]) if kind < 0.4 else None if kind < 0.5 else so_far[: rng.randint(0, 12)] if kind < 0.6 else rng.choice(["aa", "aaaaaaaaa", "ab é"])
            again = len(so_far) > 8 and (text or "").startswith(so_far)
            so_far = text if again else so_far + (text or "")
            table.append((run, pos, text))
            want.append((run, pos, again))
    chunks = spark.createDataFrame(table, "run_id long, pos long, text string")
    assert sorted((r["run_id"], r["pos"], r["restart"]) for r in el.flag_restarts(chunks).collect()) == want
    assert sum(w[2] for w in want) > 50


def test_steps_against_a_fold(spark):
    rng, table, want = random.Random(6), [], {}
    for run in range(60):
        state = {}
        for seq in range(1, rng.randint(2, 30)):
            kind, node = rng.choice(["step.started", "step.started", "step.updated", "step.completed", "run.failed", "run.completed"]), rng.choice("ab")
            status = rng.choice(["error", "skipped", "ok"])
            table.append((run, seq, seq, kind, node if kind.startswith("step") else None, status, None))
            if kind == "run.completed" or kind == "run.failed":
                state = {n: ("completed" if kind == "run.completed" else "error") if s == "running" else s for n, s in state.items()}
            elif kind == "step.completed":
                state[node] = {"ok": "completed"}.get(status, status)
            elif node not in state or (kind == "step.started" and state[node] != "completed"):
                state[node] = "running"
        want |= {(run, n): s for n, s in state.items()}
    events = spark.createDataFrame(table, "run_id long, seq long, ts long, type string, node string, status string, duration_ms long")
    got = {(r["run_id"], r["node"]): r["status"] for r in el.fold_steps(events).collect()}
    assert got.keys() == want.keys()
    assert got == want


# --- streams -----------------------------------------------------------------

@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rng = random.Random(1)
    rows, seqs = [], {}
    for i in range(400):
        run = 0 if i % 3 else rng.randint(1, 9)
        seqs[run] = seqs.get(run, 0) + 1
        kind = rng.choice(["step.started", "step.updated", "step.completed", "assistant.delta", "run.failed"])
        rows.append((run, i, i, kind, f"n{rng.randint(0, 3)}", rng.choice(["error", "completed"]), seqs[run], None, "ab"))
    df = spark.createDataFrame(rows, "run_id long, event_id long, s long, type string, node string, status string, seq long, duration_ms long, delta string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").select([c.split(" ")[0] for c in st.EVENT_SCHEMA.split(", ")])
    for i in range(4):
        df.filter(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_fold_equals_batch(spark, event_files):
    got = drain(st.fold_runs_stream(st.read_events(spark, event_files, files_per_trigger=1)), spark, "fold", "complete")
    batch = el.fold_runs(spark.read.parquet(event_files)).select("run_id", "last_seq", "status", "answer_chars")
    assert sorted(map(tuple, got.select("run_id", "last_seq", "status", "answer_chars").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_numbers_and_dedupe(spark, event_files, tmp_path):
    ev = st.read_events(spark, event_files)
    st.number_events(st.read_events(spark, event_files, files_per_trigger=1), str(tmp_path), availableNow=True).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/events").collect()
    assert len(rows) == 400
    per = {}
    for r in rows:
        per.setdefault(r["run_id"], []).append(r["seq"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    twice = ev.unionByName(st.read_events(spark, event_files))
    assert drain(st.dedupe_events(twice), spark, "deduped", "append").count() == 400
    assert drain(st.replay_stream(spark, event_files, 0, 5), spark, "replayed", "append").count() == spark.read.parquet(event_files).filter("run_id = 0 and seq > 5").count()


def test_throttle(spark, tmp_path):
    rows = [(1, 0.00, "Hi"), (1, 0.05, " there"), (1, 0.06, " you"), (1, 0.10, "."), (1, 0.12, "x" * 300), (1, 0.13, "y"), (1, 0.40, "z")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "run_id long, at_s double, text string").coalesce(1).write.parquet(path)
    ds = spark.readStream.schema("run_id long, at_s double, text string").parquet(path)
    got = [r["delta"] for r in drain(st.throttle_deltas(ds), spark, "throttled", "append").orderBy("at_s").collect()]
    assert got == ["Hi", " there you.", "x" * 300, "yz"]


# --- order of versions, late numbers, several ends ---------------------------------

def test_snapshot_versions_go_by_publishing(spark, tmp_path):
    for v in (*range(1, 12), 2):
        src.write_snapshot(spark.range(v), str(tmp_path / "snap"), f"v{v}")
    assert src.read_snapshot(spark, str(tmp_path / "snap")).count() == 2


def test_several_ends_of_a_run(spark):
    log = [(1, "a", "step.started"), (2, None, "run.failed"), (3, None, "run.completed"),
           (4, "b", "step.started"), (5, None, "run.failed"), (6, "b", "step.started"), (7, None, "run.completed"), (8, "b", "step.started"),
           (9, "c", "step.started"), (10, None, "run.failed"), (11, "c", "step.started")]
    rows = [(1, n, t, s, None, None, s) for s, n, t in log]
    ev = spark.createDataFrame(rows, "run_id long, node string, type string, seq long, status string, duration_ms long, ts long")
    assert {r["node"]: r["status"] for r in el.fold_steps(ev).collect()} == {"a": "error", "b": "completed", "c": "running"}


def test_stream_numbers_and_late_seq(spark, tmp_path):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    schema = st.EVENT_SCHEMA
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def put(k, items):  # (event, second, seq)
        rows = [tuple({"run_id": 1, "event_id": e, "ts": base + dt.timedelta(seconds=s), "type": "t", "seq": q}.get(n) for n in names) for e, s, q in items]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))

    put(0, [(k, 100 - k, 100 - k) for k in range(100)])
    put(1, [(500, 1000, 7), (501, 1001, 200), (502, 1002, 0)])
    for name, make in (("numbered", st.number_events), ("newer", st.drop_replayed_stream)):
        make(st.read_events(spark, str(tmp_path / "ev"), files_per_trigger=1), str(tmp_path / name), availableNow=True).awaitTermination()
    put(2, [(600, 2000, 200), (601, 2001, 201)])
    for name, make in (("numbered", st.number_events), ("newer", st.drop_replayed_stream)):
        make(st.read_events(spark, str(tmp_path / "ev"), files_per_trigger=1), str(tmp_path / name), availableNow=True).awaitTermination()
    got = {r["event_id"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "numbered" / "events")).collect()}
    assert [got[k] for k in range(99, -1, -1)] == list(range(1, 101)) and sorted(got.values()) == list(range(1, 106))
    kept = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "newer" / "events")).collect()}
    assert kept == set(range(100)) | {501, 502, 601}


def test_stems_in_sql_against_the_function():
    import duckdb
    from sparkfolio.plans.stem_sql import stems_sql

    rng = random.Random(9)
    ends = ["", "s", "sses", "ies", "eed", "ed", "ing", "y", "ational", "izer", "ization", "iveness", "biliti", "logi", "icate", "ful", "ness", "ement", "ion", "ou", "e", "ll", "able"]
    words = {"".join(rng.choice("aeioubcdlmstyyz") for _ in range(rng.randint(0, 6))) + rng.choice(ends) for _ in range(5000)}
    words |= {"caresses", "ponies", "agreed", "plastered", "hopping", "filing", "happy", "relational", "adoption", "controlling", "sky", "é", "a1b", "is"}
    con = duckdb.connect()
    con.execute("CREATE TABLE words (term VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [(w,) for w in sorted(words)])
    got = dict(con.execute("WITH " + stems_sql("SELECT term FROM words") + " SELECT term, stem FROM stems").fetchall())
    assert got == {w: stem_word(w) for w in words}
