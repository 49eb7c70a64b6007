"""Citation and similarity graphs on the customer - part - supplier edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.operators import graph as gr
from sparkfolio.plans.bindings import EDGES_SQL, edges, with_ctes
from sparkfolio.plans.registry import query, table
from sparkfolio.scale import stored

# Selections of three customers each, every one a member of one; they cite parts.
SEL_SQL = "sel AS (SELECT DISTINCT source // 3 AS set_id, source % 3 AS pos, source AS paper_id FROM edges)"
REF_SQL = "crefs AS (SELECT s.set_id, s.pos AS source_pos, e.source, e.target AS ref_index, e.target FROM edges e JOIN sel s ON e.source = s.paper_id)"
PART_SQL = "parts AS (SELECT target AS work_id, count(*) AS c, 2000 + any_value(p_size) AS y FROM edges JOIN part ON p_partkey = target GROUP BY 1)"
CUST_SQL = "cust AS (SELECT source AS work_id, count(*) AS c, 1990 + any_value(c_nationkey) AS y FROM edges JOIN customer ON c_custkey = source GROUP BY 1)"
BASE = with_ctes(EDGES_SQL, SEL_SQL, REF_SQL, PART_SQL, CUST_SQL)


def _selected(e):
    return e.select(
        F.floor(F.col("source") / 3).alias("set_id"), (F.col("source") % 3).alias("pos"),
        F.col("source").alias("paper_id")).distinct()


def _refs(e):
    return e.select(
        F.floor(F.col("source") / 3).alias("set_id"), (F.col("source") % 3).alias("source_pos"), "source",
        F.col("target").alias("ref_index"), "target")


def _parts(spark, sf, e):
    year = table(spark, sf, "part").select(F.col("p_partkey").alias("work_id"), (F.lit(2000) + F.col("p_size")).alias("year"))
    return e.groupBy(F.col("target").alias("work_id")).agg(F.count(F.lit(1)).alias("cited_by_count")).join(year, "work_id")


def _customers(spark, sf, e):
    year = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("work_id"), (F.lit(1990) + F.col("c_nationkey")).alias("year"))
    return e.groupBy(F.col("source").alias("work_id")).agg(F.count(F.lit(1)).alias("cited_by_count")).join(year, "work_id")


@query("support_count", BASE + """
SELECT set_id, target, count(DISTINCT source) AS support FROM crefs WHERE source <> target GROUP BY ALL""")
def support_count(spark, sf):
    return gr.support(_refs(edges(spark, sf))).select("set_id", "target", "support")


_FOUND_SQL = """found AS (
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY support DESC, c DESC, y DESC, sp, target) AS rank FROM (
    SELECT set_id, target, count(DISTINCT source) AS support, min(source_pos) AS sp, any_value(c) AS c, any_value(y) AS y
    FROM crefs JOIN parts ON target = work_id WHERE source <> target GROUP BY ALL)
  WHERE support >= 2 AND (set_id, target) NOT IN (SELECT (set_id, paper_id) FROM sel))"""


@query("topk_per_group", BASE + "," + _FOUND_SQL + "SELECT set_id, target, support, rank FROM found WHERE rank <= 5")
def topk_per_group(spark, sf):
    e = edges(spark, sf)
    cands = gr.support(_refs(e)).join(_parts(spark, sf, e).withColumnRenamed("work_id", "target"), "target", "left")
    return gr.foundational(cands, _selected(e)).select("set_id", "target", "support", "rank")


_TOP_CITERS = """tc AS (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY c DESC, source) AS list_pos FROM edges JOIN cust ON source = work_id)"""


@query("top_citers", BASE + "," + _TOP_CITERS + "SELECT target, source, list_pos FROM tc WHERE list_pos <= 7")
def top_citers(spark, sf):
    e = edges(spark, sf)
    return gr.top_citers(e, _customers(spark, sf, e), 7)


# Selections of three parts each; customers cite them, they cite suppliers.
PSEL_SQL = "psel AS (SELECT DISTINCT target // 3 AS set_id, target % 3 AS pos, target AS paper_id FROM edges)"
_FOLLOW_SQL = """
fc AS (SELECT s.set_id, t.source AS target, count(DISTINCT t.target) AS support, min(s.pos * 1000 + t.list_pos) AS fs, any_value(c) AS c, any_value(y) AS y
       FROM tc t JOIN psel s ON t.target = s.paper_id JOIN cust ON cust.work_id = t.source WHERE t.list_pos <= 50 GROUP BY ALL),
fm AS (SELECT set_id, count(*) FILTER (support >= 2) AS m FROM fc GROUP BY 1),
follow AS (SELECT set_id, target, support, c, y, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN support >= 2 THEN 0 ELSE 1 END, support DESC, c DESC, y DESC, fs, target) AS rank
       FROM fc JOIN fm USING (set_id) WHERE support >= 2 OR m < 3)"""


def _part_selection(e):
    return e.select(
        F.floor(F.col("target") / 3).alias("set_id"), (F.col("target") % 3).alias("pos"), F.col("target").alias("paper_id")).distinct()


@query("followup_fill", BASE + "," + PSEL_SQL + "," + _TOP_CITERS + "," + _FOLLOW_SQL + "SELECT set_id, target, support, rank FROM follow WHERE rank <= 5")
def followup_fill(spark, sf):
    e = stored(edges(spark, sf))
    sel = stored(_part_selection(e))
    prefixed = e.select((F.col("source") + 10**12).alias("source"), "target")
    works = stored(_customers(spark, sf, e).withColumn("work_id", F.col("work_id") + 10**12))
    return gr.followups(sel, prefixed, works).select("set_id", (F.col("target") - 10**12).alias("target"), "support", "rank")


_GRAPH_SQL = """
prefs AS (SELECT DISTINCT s.set_id, s.pos, l_partkey AS source, l_suppkey AS sup FROM lineitem JOIN psel s ON l_partkey = s.paper_id),
supw AS (SELECT sup AS work_id, count(*) AS c, 2000 + any_value(s_nationkey) AS y FROM (SELECT DISTINCT l_partkey, l_suppkey AS sup FROM lineitem) JOIN supplier ON s_suppkey = sup GROUP BY 1),
gf AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY support DESC, c DESC, y DESC, sp, sup) AS rank FROM (
   SELECT set_id, sup, count(DISTINCT source) AS support, min(pos) AS sp, any_value(c) AS c, any_value(y) AS y FROM prefs JOIN supw ON sup = work_id GROUP BY ALL) WHERE support >= 2),
gnodes AS (
  SELECT set_id, 'p' || CAST(paper_id AS VARCHAR) AS id, 'selected' AS role, CAST(0 AS BIGINT) AS support, parts.c AS cited_by_count, CAST(parts.y AS BIGINT) AS year FROM psel JOIN parts ON parts.work_id = paper_id
  UNION ALL SELECT set_id, 's' || CAST(sup AS VARCHAR), 'foundational', support, c, CAST(y AS BIGINT) FROM gf WHERE rank <= 5
  UNION ALL SELECT set_id, 'c' || CAST(target AS VARCHAR), 'followup', support, c, CAST(y AS BIGINT) FROM follow WHERE rank <= 5),
gedges AS (
  SELECT DISTINCT p.set_id, 'p' || CAST(p.source AS VARCHAR) AS source, 's' || CAST(p.sup AS VARCHAR) AS target FROM prefs p JOIN gf ON gf.set_id = p.set_id AND gf.sup = p.sup AND gf.rank <= 5
  UNION ALL SELECT DISTINCT f.set_id, 'c' || CAST(t.source AS VARCHAR), 'p' || CAST(t.target AS VARCHAR) FROM follow f JOIN psel s ON s.set_id = f.set_id JOIN tc t ON t.source = f.target AND t.target = s.paper_id AND t.list_pos <= 50 WHERE f.rank <= 5)"""
GRAPH = BASE + "," + PSEL_SQL + "," + _TOP_CITERS + "," + _FOLLOW_SQL + "," + _GRAPH_SQL


_KINDS = "cps"


def _three_level(spark, sf):
    """Part selections with ids that order like a letter before the number."""
    e = stored(edges(spark, sf))
    name = lambda kind, c: F.col(c) + F.lit(_KINDS.index(kind) * 10**18)
    sel = stored(_part_selection(e).withColumn("paper_id", name("p", "paper_id")))
    li = stored(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct())
    refs = li.select(
        F.floor(F.col("l_partkey") / 3).alias("set_id"), (F.col("l_partkey") % 3).alias("source_pos"),
        name("p", "l_partkey").alias("source"), F.col("l_suppkey").alias("ref_index"), name("s", "l_suppkey").alias("target"))
    cites = e.select(name("c", "source").alias("source"), name("p", "target").alias("target"))
    sup = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("cited_by_count")).join(
        table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        name("s", "l_suppkey").alias("work_id"), "cited_by_count", (F.lit(2000) + F.col("s_nationkey")).alias("year"))
    works = sup.unionByName(_parts(spark, sf, e).withColumn("work_id", name("p", "work_id"))).unionByName(
        _customers(spark, sf, e).withColumn("work_id", name("c", "work_id")))
    return sel, refs, cites, stored(works)


def _short(c):
    kind = F.substring(F.lit(_KINDS), F.expr(f"int({c} div {10**18})") + 1, F.lit(1))
    return F.concat(kind, (F.col(c) % 10**18).cast("string"))


@query("citation_graph", GRAPH + "SELECT set_id, id, role, support, cited_by_count, year FROM gnodes")
def citation_graph(spark, sf):
    nodes, _ = gr.citation_graph(*_three_level(spark, sf))
    return nodes.withColumn("id", _short("id"))


@query("union_roles", GRAPH + "SELECT set_id, id, role FROM gnodes")
def union_roles(spark, sf):
    nodes, _ = gr.citation_graph(*_three_level(spark, sf))
    return nodes.select("set_id", _short("id").alias("id"), "role")


@query("branch_union", GRAPH + "SELECT set_id, role, count(*) AS n FROM gnodes GROUP BY ALL")
def branch_union(spark, sf):
    nodes, _ = gr.citation_graph(*_three_level(spark, sf))
    return nodes.groupBy("set_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("edge_distinct", GRAPH + "SELECT set_id, source, target FROM gedges")
def edge_distinct(spark, sf):
    _, e = gr.citation_graph(*_three_level(spark, sf))
    return e.select("set_id", _short("source").alias("source"), _short("target").alias("target"))


SEED_SQL = "seeds AS (SELECT DISTINCT set_id, target AS seed FROM crefs)"


@query("union_seeds", BASE + "," + SEED_SQL + "SELECT set_id, seed FROM seeds")
def union_seeds(spark, sf):
    e = edges(spark, sf)
    return gr.seed_set(_refs(e), _selected(e).withColumn("paper_id", -F.col("paper_id") - 1))


@query("intersect_sets", BASE + """
SELECT a.set_id, count(*) AS shared FROM (SELECT DISTINCT set_id, target FROM crefs WHERE source_pos = 0) a
JOIN (SELECT DISTINCT set_id, target FROM crefs WHERE source_pos = 1) b ON a.set_id = b.set_id AND a.target = b.target GROUP BY 1""")
def intersect_sets(spark, sf):
    r = _refs(edges(spark, sf))
    return gr.shared_counts(r.filter("source_pos = 0"), r.filter("source_pos = 1"), ["set_id"], "target")


# Similarity: parts are 's.' works cited by customers; every customer also cites the one before it.
_POOL_SQL = """
cites AS (SELECT source + 1000000000 AS source, target, 0 AS kind FROM edges UNION ALL SELECT source + 1000000000, source - 1 + 1000000000, 1 FROM (SELECT DISTINCT source FROM edges) WHERE source > 0),
ctc AS (SELECT target, source, kind, row_number() OVER (PARTITION BY target ORDER BY c DESC, source) AS list_pos FROM cites JOIN cust ON cites.source = cust.work_id + 1000000000),
srcs AS (SELECT set_id, seed AS target FROM seeds UNION ALL SELECT set_id, paper_id + 1000000000 FROM sel),
freq AS (SELECT s.set_id, t.source, count(*) AS freq, max(kind) AS kind, min(kind * 1000000000000000 + t.target * 1000 + list_pos) AS fs
   FROM ctc t JOIN srcs s ON s.target = t.target WHERE list_pos <= 100 GROUP BY ALL),
pool AS (SELECT set_id, source - 1000000000 AS work_id, freq, kind = 1 AS direct, row_number() OVER (PARTITION BY set_id ORDER BY freq DESC, fs) AS rank FROM freq
   WHERE (set_id, source - 1000000000) NOT IN (SELECT (set_id, paper_id) FROM sel))"""
POOL = BASE + "," + SEED_SQL + "," + _POOL_SQL
_OFF = 10**9


def _similarity_tables(spark, sf):
    e = stored(edges(spark, sf))
    sel = stored(_selected(e).withColumn("paper_id", F.col("paper_id") + _OFF))
    seeds = stored(gr.seed_set(_refs(e), sel))
    previous = sel.select("paper_id").filter(F.col("paper_id") > _OFF).select(
        F.col("paper_id").alias("source"), (F.col("paper_id") - 1).alias("target"))
    work_refs = e.select((F.col("source") + _OFF).alias("source"), "target")
    works = stored(_customers(spark, sf, e).withColumn("work_id", F.col("work_id") + _OFF))
    cites = work_refs.unionByName(previous)
    listed = gr.listed_citers(seeds, sel, cites, works)
    passes = gr.pool_passes(seeds, sel, listed)
    return sel, seeds, work_refs, works, gr.citer_pool(seeds, sel, cites, works, listed=listed, passes=passes), listed, passes


@query("pool_topn", POOL + "SELECT set_id, work_id, freq, direct FROM pool WHERE rank <= 300")
def pool_topn(spark, sf):
    pool = _similarity_tables(spark, sf)[4]
    return pool.withColumn("work_id", F.col("work_id") - _OFF).drop("hits")


_COUPLING_SQL = """
nseed AS (SELECT set_id, count(*) AS n FROM seeds GROUP BY 1),
sh AS (SELECT p.set_id, p.work_id, count(*) AS shared FROM (SELECT * FROM pool WHERE rank <= 300) p JOIN edges e ON e.source = p.work_id JOIN seeds s ON s.set_id = p.set_id AND s.seed = e.target GROUP BY ALL),
coup AS (SELECT p.set_id, p.work_id, coalesce(shared, 0) AS shared, coalesce(shared, 0) / sqrt(cust.c * n) AS cos, direct, cust.c,
   round(coalesce(shared, 0) / sqrt(cust.c * n) + CASE WHEN direct THEN 0.10 ELSE 0 END + CASE WHEN p.work_id % 4 = 0 THEN 0.08 ELSE 0 END, 9) AS score
   FROM (SELECT * FROM pool WHERE rank <= 300) p JOIN cust USING (work_id) JOIN nseed USING (set_id) LEFT JOIN sh ON sh.set_id = p.set_id AND sh.work_id = p.work_id WHERE coalesce(shared, 0) >= 1 OR direct),
cr AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, c DESC, work_id) AS rk FROM coup)"""


def _coupled(spark, sf):
    sel, seeds, work_refs, works, pool, listed, passes = _similarity_tables(spark, sf)
    pool = pool.withColumn("in_index", F.col("work_id") % 4 == 0)
    return sel, work_refs, passes, gr.coupling(pool, seeds, work_refs, works, listed=listed, passes=passes)


@query("coupling_score", POOL + "," + _COUPLING_SQL + "SELECT set_id, work_id, shared, CAST(round(CAST(round(cos, 9) AS DECIMAL(18,9)), 4) AS DOUBLE) AS similarity, CAST(round(CAST(score AS DECIMAL(18,9)), 4) AS DOUBLE) AS score, rk AS rank FROM cr WHERE rk <= 40")
def coupling_score(spark, sf):
    *_, top = _coupled(spark, sf)
    return top.withColumn("work_id", F.col("work_id") - _OFF)


_NODES_SQL = """
nodes AS (SELECT set_id, work_id FROM cr WHERE rk <= 40 UNION SELECT set_id, paper_id FROM sel),
pairs AS (SELECT a.set_id, a.work_id AS a, b.work_id AS b, count(*) / sqrt(any_value(ca.c) * any_value(cb.c)) AS w FROM nodes a JOIN edges ea ON ea.source = a.work_id
  JOIN edges eb ON eb.target = ea.target JOIN nodes b ON b.set_id = a.set_id AND b.work_id = eb.source AND a.work_id < b.work_id JOIN cust ca ON ca.work_id = a.work_id JOIN cust cb ON cb.work_id = b.work_id GROUP BY ALL),
sym AS (SELECT set_id, a AS node, b AS other, round(w, 9) AS w FROM pairs WHERE round(w, 9) >= 0.05 UNION ALL SELECT set_id, b, a, round(w, 9) FROM pairs WHERE round(w, 9) >= 0.05),
chosen AS (SELECT DISTINCT set_id, least(node, other) AS source, greatest(node, other) AS target, round(w, 4) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id, node ORDER BY w DESC, other) AS rn FROM sym) WHERE rn <= 4)"""
SIM = POOL + "," + _COUPLING_SQL + "," + _NODES_SQL


def _similarity_nodes(spark, sf):
    sel, work_refs, passes, top = _coupled(spark, sf)
    nodes = top.select("set_id", "work_id").unionByName(sel.select("set_id", F.col("paper_id").alias("work_id"))).distinct()
    return sel, work_refs, passes, nodes


@query("coupling_edges", SIM + "SELECT set_id, source, target, weight FROM chosen")
def coupling_edges(spark, sf):
    _, work_refs, passes, nodes = _similarity_nodes(spark, sf)
    out = gr.coupling_edges(nodes, work_refs, passes=passes)
    return out.withColumn("source", F.col("source") - _OFF).withColumn("target", F.col("target") - _OFF)


@query("edges_topk", BASE + """,
pr AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 97 + 1000000 AS b, l_partkey // 500 AS set_id FROM lineitem),
w AS (SELECT *, ((a * 31 + b * 17) % 1000) / 1000.0::DOUBLE AS w FROM pr),
sym AS (SELECT set_id, a AS node, b AS other, w FROM w WHERE w >= 0.05 UNION ALL SELECT set_id, b, a, w FROM w WHERE w >= 0.05)
SELECT DISTINCT set_id, least(node, other) AS source, greatest(node, other) AS target, w AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id, node ORDER BY w DESC, other) AS rn FROM sym) WHERE rn <= 4""")
def edges_topk(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97 + 1000000).alias("b"),
        F.floor(F.col("l_partkey") / 500).alias("set_id")).distinct()
    return gr.topk_edges(p.withColumn("weight", ((F.col("a") * 31 + F.col("b") * 17) % 1000) / 1000.0))


@query("ref_frequency", SIM + "SELECT n.set_id, e.target AS work_id, count(*) AS support FROM nodes n JOIN edges e ON e.source = n.work_id GROUP BY ALL")
def ref_frequency(spark, sf):
    _, work_refs, passes, nodes = _similarity_nodes(spark, sf)
    return gr.most_cited(nodes, work_refs, passes=passes)


@query("prior_works", SIM + """,
pc AS (SELECT n.set_id, e.target AS work_id, count(*) AS support FROM nodes n JOIN edges e ON e.source = n.work_id GROUP BY ALL),
b30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY support DESC, work_id) AS rn FROM pc) WHERE rn <= 30)
SELECT set_id, work_id, support, rank FROM (SELECT set_id, work_id, support, row_number() OVER (PARTITION BY set_id ORDER BY support DESC, work_id) AS rank FROM b30 WHERE work_id % 5 <> 0) WHERE rank <= 10""")
def prior_works(spark, sf):
    sel, work_refs, passes, nodes = _similarity_nodes(spark, sf)
    parts = stored(work_refs.select(F.col("target").alias("work_id")).distinct().filter("work_id % 5 <> 0"))
    return gr.prior_works(nodes, sel, work_refs, parts, passes).select("set_id", "work_id", "support", "rank")


@query("derivative_works", BASE + """,
pn AS (SELECT set_id, work_id FROM (SELECT work_id // 100 AS set_id, work_id, row_number() OVER (PARTITION BY work_id // 100 ORDER BY c DESC, work_id) AS rn FROM parts) WHERE rn <= 40),
dv AS (SELECT pn.set_id, e.source AS work_id, count(*) AS support, any_value(c) AS c FROM pn JOIN edges e ON e.target = pn.work_id JOIN cust ON cust.work_id = e.source GROUP BY ALL)
SELECT set_id, work_id, support, rank FROM (SELECT set_id, work_id, support, row_number() OVER (PARTITION BY set_id ORDER BY support DESC, c DESC, work_id) AS rank FROM dv) WHERE rank <= 10""")
def derivative_works(spark, sf):
    e = edges(spark, sf)
    ranked = gr.topk(_parts(spark, sf, e).withColumn("set_id", F.floor(F.col("work_id") / 100)), ["set_id"],
                     [F.col("cited_by_count").desc(), F.col("work_id")], 40)
    nodes = ranked.select("set_id", "work_id")
    shifted = e.select((F.col("source") + _OFF).alias("source"), "target")
    works = _customers(spark, sf, e).withColumn("work_id", F.col("work_id") + _OFF)
    pool = shifted.join(nodes.withColumnRenamed("work_id", "target"), "target").select("set_id", F.col("source").alias("work_id")).distinct()
    return gr.derivative_works(nodes, pool, shifted, works).withColumn("work_id", F.col("work_id") - _OFF)


@query("graph_counts", SIM + "," + PSEL_SQL + """
SELECT coalesce(a.set_id, b.set_id) AS set_id, coalesce(a.n, b.n) AS n_nodes, coalesce(CASE WHEN a.n IS NOT NULL THEN coalesce(a.e, 0) END, b.e) AS n_edges FROM
 (SELECT set_id, count(*) AS n, (SELECT count(*) FROM chosen c WHERE c.set_id = nodes.set_id) AS e FROM nodes WHERE set_id % 2 = 0 GROUP BY set_id) a
 FULL JOIN (SELECT set_id, count(*) AS n, (SELECT count(*) FROM crefs c WHERE c.set_id = sel.set_id) AS e FROM sel GROUP BY set_id) b ON a.set_id = b.set_id""")
def graph_counts(spark, sf):
    sel, work_refs, passes, nodes = _similarity_nodes(spark, sf)
    even = stored(nodes.filter("set_id % 2 = 0"))
    e = work_refs.select((F.col("source") - _OFF).alias("source"), "target")
    return gr.graph_counts(even, gr.coupling_edges(even, work_refs, passes=passes), sel, _refs(e))


@query("graph_status", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'no_key' WHEN k % 3 > 0 AND k % 5 = 0 THEN 'error' ELSE 'ok' END AS citation,
  CASE WHEN event_type = 'signup' THEN 'no_key' WHEN k % 3 > 0 AND k % 5 <> 0 AND k % 7 <> 0 THEN 'error' WHEN k % 7 = 0 OR k % 3 > 0 THEN 'partial' ELSE 'ok' END AS similarity
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def graph_status(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    key = F.col("event_type") != "signup"
    return table(spark, sf, "events").select(
        "event_id", gr.citation_status(key, k % 3, k % 5).alias("citation"),
        gr.similarity_status(key, k % 3, k % 5 == 0, k % 7 == 0).alias("similarity"))


@query("context_join_edges", BASE + """
SELECT s.set_id, e.source, e.target, CASE WHEN e.target % 3 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS weight
FROM edges e JOIN sel s ON s.paper_id = e.source WHERE e.target % 2 = 0""")
def context_join_edges(spark, sf):
    e = edges(spark, sf)
    sel = _selected(e).select("set_id", F.col("paper_id").alias("work_id"))
    even = _refs(e).filter("target % 2 = 0").select("set_id", (-F.col("target") - 1).alias("work_id")).distinct()
    rows = e.select(F.floor(F.col("source") / 3).alias("set_id"), "source", (-F.col("target") - 1).alias("target"),
                    F.when(F.col("target") % 3 != 0, 0.5).alias("weight"))
    return gr.resolvable_edges(sel.unionByName(even), rows).select("set_id", "source", (-F.col("target") - 1).alias("target"), "weight")


@query("neighbourhood", BASE + """
SELECT DISTINCT target + 1000000000 AS node, source AS neighbour FROM edges WHERE target % 50 = 0 UNION ALL SELECT DISTINCT source, target + 1000000000 FROM edges WHERE source % 100 = 7""")
def neighbourhood(spark, sf):
    e = edges(spark, sf).withColumn("target", F.col("target") + _OFF)
    asked = e.select(F.col("source").alias("node")).filter("node % 100 = 7").unionByName(
        e.select(F.col("target").alias("node")).filter((F.col("node") - _OFF) % 50 == 0))
    return gr.neighbours(e, asked)


@query("point_lookup", BASE + "SELECT work_id, c AS cited_by_count FROM parts WHERE work_id IN (SELECT target FROM crefs WHERE source_pos = 0)")
def point_lookup(spark, sf):
    e = edges(spark, sf)
    keys = _refs(e).filter("source_pos = 0").select(F.col("target").alias("key"))
    return gr.works_by_keys(_parts(spark, sf, e), keys, "id").select("work_id", "cited_by_count")


@query("set_diff_ids", """
SELECT id, side FROM (SELECT DISTINCT o_custkey AS id, 'missing' AS side FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
def set_diff_ids(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return gr.id_diff(o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'F'"))


@query("newest_first", "SELECT o_orderkey, o_orderdate::VARCHAR AS updated FROM orders")
def newest_first(spark, sf):
    from sparkfolio.operators.context import latest_reports

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated_at"))
    return latest_reports(o, "o_orderkey").select("o_orderkey", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))
