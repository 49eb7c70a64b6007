"""Repositories asked for by many papers, titles normalized once, searches counted paper by paper."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sparkfolio.functions.text import title_jaccard
from sparkfolio.operators import joins as jn


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, rng):
    words = ["red", "blue", "ring", "bolt"]
    papers = [(n, f"2401.{n % 3:05d}", " ".join(rng.sample(words, 2)), "Bo Li") for n in range(12)]
    repos = [(f"u{rng.randrange(25):02d}", " ".join(rng.sample(words + ["li", "2401.00001"], 4)), rng.choice([None, 1, 2, 5, 9])) for _ in range(60)]
    p = spark.createDataFrame(papers, "paper_id int, arxiv_id string, title string, author string")
    r = spark.createDataFrame(repos, "url string, description string, stars int").withColumn("name", F.lit(""))
    return papers, repos, p, r


def test_repositories_match_brute_force(spark):
    for seed in range(3):
        papers, repos, p, r = _tables(spark, random.Random(seed))
        want = {}
        for n, arxiv, title, _ in papers:
            found = {}
            for tier, ws in enumerate(({arxiv}, set(title.split()), {"li", *title.split()}), 1):
                for url, text, stars in repos:
                    if ws <= set(text.split()):
                        old = found.get(url, (tier, None))
                        found[url] = (min(old[0], tier), max((s for s in (old[1], stars) if s is not None), default=None))
            ranked = sorted((t, -(s if s is not None else -1), u) for u, (t, s) in found.items())[:5]
            want |= {(n, i): (u, t) for i, (t, _, u) in enumerate(ranked, 1)}
        assert {(x["paper_id"], x["rank"]): (x["url"], x["tier"]) for x in jn.tiered_candidates(p, r).collect()} == want


def test_a_repeated_paper_finds_what_one_row_finds(spark):
    _, _, p, r = _tables(spark, random.Random(2))
    rows = lambda df: sorted(tuple(x) for x in jn.tiered_candidates(df, r).collect())
    want = rows(p)
    assert want and rows(p.unionByName(p.filter("paper_id % 2 = 0"))) == want


def test_equal_queries_are_looked_up_once(spark):
    _, _, p, r = _tables(spark, random.Random(1))
    assert re.search(r"Aggregate \[ws#\d+\], \[ws#\d+, min_by", _plan(jn.tiered_candidates(p, r)))


def test_a_title_is_normalized_once(spark):
    rows = spark.createDataFrame([("A red Ring", "the ring, RED"), ("", "x"), (None, None), ("a a", "a")], "a string, b string")
    df = rows.select(title_jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [round(x["j"], 4) for x in df.collect()] == [0.5, 0.0, 0.0, 1.0]
    assert _plan(df).count("translate(") == 2
