"""Citation graph and similarity graph over many selections at once.

Every table carries ``set_id``; one research run is one set.  Ranked lists are cut per
set by ``row_number`` filters, which Spark applies before the shuffle as well, so a set
or a work with very many rows sends only its best rows on.  Pairwise work happens only
between the nodes of a graph, whose number per set is capped by the list size.

What crosses to the sets is many times the input, so large tables are worked on in passes
(``scale.in_passes``): some sets or targets after the other, each pass with its own exchanges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkfolio.functions.ids import year_of_id
from sparkfolio.scale import exchanges_dropped, in_passes

# List sizes, weights and thresholds of the two graphs.
TOP_N = 5
MIN_FOLLOWUPS = 3
CITERS_FOR_ROLES, CITERS_FOR_POOL = 50, 100
POOL_SIZE, MAX_NODES = 300, 40
EDGES_PER_NODE, MIN_EDGE_WEIGHT, DEFAULT_WEIGHT = 4, 0.05, 0.1
DIRECT_BONUS, INDEX_BONUS, MIN_SHARED = 0.10, 0.08, 1
PRIOR_CANDIDATES, LIST_SIZE = 30, 10

# Targets of a set that one task counts; a larger set is split by citing work.
HOT_SET = 20_000
# Rows that one task sorts, groups or ranks.  Spark merges tasks by compressed bytes, and ids in a sort take ten times as many.
TASK_ROWS = 250_000
# Tasks of a pass, and ids that cross to sets in one; with more passes than MAX_PASSES reading the tables again costs more than it saves.
PASS_TASKS, PASS_IDS, MAX_PASSES = 16, 32_000_000, 12


def tasks_for(rows: DataFrame) -> int:
    """Tasks of ``TASK_ROWS`` rows, as many as there are cores at least; 1 leaves few rows to Spark."""
    with exchanges_dropped(rows.sparkSession):
        n = rows.count()
    return 1 if n <= TASK_ROWS else max(-(-n // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)


def passes_of(tasks: int, rows: DataFrame) -> tuple[int, int]:
    """(passes, tasks of each) for so many tasks: a pass has ``PASS_TASKS``, and one for every core, at least."""
    least = max(PASS_TASKS, rows.sparkSession.sparkContext.defaultParallelism)
    passes = min(MAX_PASSES, -(-tasks // least))
    return passes, -(-tasks // passes)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows with equal keys in one of ``tasks`` tasks."""
    return df if tasks == 1 else df.repartition(tasks, *keys)


def topk(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group, numbered from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def topk_dealt(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, tasks: int, share: str, rank: str = "rank") -> DataFrame:
    """``topk`` in ``tasks`` tasks of few rows: a group is cut by hash of ``share`` first, and what is left by itself."""
    if tasks == 1:
        return topk(df, group, order, k, rank)
    shares = df.withColumn("share_of_group", F.pmod(F.xxhash64(share), F.lit(tasks)))
    first = topk(dealt(shares, tasks, *group, "share_of_group"), [*group, "share_of_group"], order, k, rank)
    return topk(dealt(first.drop("share_of_group", rank), tasks, *group), group, order, k, rank)


def role_order() -> list[Column]:
    """Support, then known count (unknown ranks last), newer year, first seen."""
    return [F.col("support").desc(), F.coalesce("cited_by_count", F.lit(-1)).desc(), F.coalesce("year", F.lit(0)).desc(),
            F.col("first_seen"), F.col("target")]


def support(refs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(set_id, target, support, first_seen): selected works that cite a target, self references ignored.

    ``refs``: (set_id, source_pos, source, ref_index, target).
    """
    tasks = tasks_for(refs) if tasks is None else tasks
    once = dealt(refs.filter(F.col("source") != F.col("target")), tasks, "set_id", "target").groupBy("set_id", "source", "target").agg(
        F.min(F.struct("source_pos", "ref_index")).alias("seen"))
    return once.groupBy("set_id", "target").agg(
        F.count(F.lit(1)).alias("support"), F.min("seen").alias("first_seen"))


def foundational(cands: DataFrame, selected: DataFrame, n: int = TOP_N, tasks: int = 1) -> DataFrame:
    """Top cited works per set.  ``cands``: support rows with ``cited_by_count`` and ``year``.

    Sets with two and more selected works need support >= 2.  A set with one selected
    work ranks everything, in bibliography order when no count is known.
    """
    outside = cands.join(selected.select("set_id", F.col("paper_id").alias("target")), ["set_id", "target"], "left_anti")
    sizes = selected.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_sel"))
    known = outside.groupBy("set_id").agg(F.max(F.col("cited_by_count").isNotNull()).alias("any_known"))
    rows = outside.join(sizes, "set_id").join(known, "set_id").filter((F.col("n_sel") < 2) | (F.col("support") >= 2))
    plain = (F.col("n_sel") < 2) & ~F.col("any_known")
    order = [F.when(plain, None).otherwise(F.col("support")).desc(),
             F.when(plain, None).otherwise(F.coalesce("cited_by_count", F.lit(-1))).desc(),
             F.when(plain, None).otherwise(F.coalesce("year", F.lit(0))).desc(), F.col("first_seen"), F.col("target")]
    return topk_dealt(rows, ["set_id"], order, n, tasks, "target").drop("n_sel", "any_known")


def top_citers(cites: DataFrame, works: DataFrame, n: int, tasks: int = 1) -> DataFrame:
    """(target, source, list_pos): per work its ``n`` most cited citing works."""
    counted = cites.join(works.select(F.col("work_id").alias("source"), "cited_by_count"), "source", "left")
    order = [F.coalesce("cited_by_count", F.lit(-1)).desc(), F.col("source")]
    return topk_dealt(counted, ["target"], order, n, tasks, "source", "list_pos").select("target", "source", "list_pos")


def multi_then_single(cands: DataFrame, n: int = TOP_N, min_multi: int = MIN_FOLLOWUPS, tasks: int = 1) -> DataFrame:
    """Works with support >= 2 first; single-support ones only where a set has fewer than ``min_multi``."""
    several = F.coalesce(F.col("support") >= 2, F.lit(False))
    order = [F.when(several, 0).otherwise(1), *role_order()]
    # The first rows of a set tell whether it has min_multi of them.
    first = topk_dealt(cands.filter(F.col("set_id").isNotNull()), ["set_id"], order, max(n, min_multi), tasks, "target")
    enough = F.count_if(several).over(Window.partitionBy("set_id")) >= min_multi
    return first.withColumn("enough", enough).filter((F.col("rank") <= n) & (several | ~F.col("enough"))).drop("enough")


def selected_citations(selected: DataFrame, cites: DataFrame, works: DataFrame, tasks: int = 1, keep: bool = False) -> DataFrame:
    """(set_id, target, source, source_pos, list_pos): the listed citing works of every selected work; ``keep`` stores them."""
    passes, tasks = passes_of(tasks, cites)
    sel = selected.select("set_id", F.col("paper_id").alias("target"), F.col("pos").alias("source_pos"))

    def listed(cites: DataFrame, sel: DataFrame) -> DataFrame:
        asked = cites.join(sel.select("target").distinct(), "target", "left_semi")
        return top_citers(asked, works, CITERS_FOR_ROLES, tasks).join(sel, "target").select(
            "set_id", "target", "source", "source_pos", "list_pos")

    return in_passes(passes, "target", listed, cites, sel, keep=keep)


def followups(selected: DataFrame, cites: DataFrame, works: DataFrame, n: int = TOP_N, tasks: int | None = None,
              listed: DataFrame | None = None) -> DataFrame:
    """Works that cite the selection, the selected works themselves never.  ``listed``: ``selected_citations``, if known."""
    tasks = tasks_for(cites) if tasks is None else tasks
    listed = selected_citations(selected, cites, works, tasks) if listed is None else listed
    passes, tasks = passes_of(tasks, cites)
    info = works.select(F.col("work_id").alias("target"), "cited_by_count", "year")

    def best(listed: DataFrame, selected: DataFrame) -> DataFrame:
        cands = dealt(listed, tasks, "set_id", "source").groupBy("set_id", "source").agg(
            F.countDistinct("target").alias("support"),
            F.min(F.struct("source_pos", F.col("list_pos").alias("ref_index"))).alias("first_seen"))
        own = selected.select("set_id", F.col("paper_id").alias("source"))
        cands = cands.join(own, ["set_id", "source"], "left_anti").withColumnRenamed("source", "target")
        return multi_then_single(cands.join(info, "target", "left"), n, tasks=tasks)

    return in_passes(passes, "set_id", best, listed, selected)


def union_roles(parts: Sequence[tuple[str, DataFrame]], tasks: int = 1) -> DataFrame:
    """(set_id, id, role, support, cited_by_count, year): one row per id, the first role wins."""
    rows = None
    for priority, (role, df) in enumerate(parts):
        part = df.select("set_id", "id", F.lit(role).alias("role"), F.col("support").cast("long").alias("support"),
                         F.col("cited_by_count").cast("long").alias("cited_by_count"),
                         F.col("year").cast("long").alias("year"), F.lit(priority).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    return topk(dealt(rows, tasks, "set_id", "id"), ["set_id", "id"], [F.col("priority")], 1).drop("priority", "rank")


def distinct_edges(*parts: DataFrame, tasks: int = 1) -> DataFrame:
    """(set_id, source, target) once each."""
    rows = parts[0].select("set_id", "source", "target")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("set_id", "source", "target"))
    return dealt(rows, tasks, "set_id", "source", "target").distinct()


def citation_graph(selected: DataFrame, refs: DataFrame, cites: DataFrame, works: DataFrame, n: int = TOP_N,
                   paper_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each selection.

    ``selected``: (set_id, pos, paper_id); ``refs``: resolved references of the
    selected works; ``cites``: (source, target) of citing works; ``works``: (work_id,
    cited_by_count, year).  ``paper_ids`` takes a missing year from the id itself.
    """
    info = works.select(F.col("work_id").alias("target"), "cited_by_count", "year")
    ref_tasks, cite_tasks = tasks_for(refs), tasks_for(cites)
    tasks = max(ref_tasks, cite_tasks)
    ref_passes, pass_tasks = passes_of(ref_tasks, refs)
    found = in_passes(ref_passes, "set_id", lambda refs, selected: foundational(
        support(refs, pass_tasks).join(info, "target", "left"), selected, n, pass_tasks), refs, selected)
    listed = selected_citations(selected, cites, works, cite_tasks, keep=True)
    follow = followups(selected, cites, works, n, cite_tasks, listed)
    own = selected.join(works.withColumnRenamed("work_id", "paper_id"), "paper_id", "left").withColumn("support", F.lit(0))
    shape = lambda df: df.withColumnRenamed("target", "id")
    nodes = union_roles([("selected", own.withColumnRenamed("paper_id", "id")), ("foundational", shape(found)),
                         ("followup", shape(follow))], tasks)
    if paper_ids:
        nodes = nodes.withColumn("year", F.coalesce("year", year_of_id(F.col("id")).cast("long")))
    ends = selected.select("set_id", F.col("paper_id").alias("target")).unionByName(found.select("set_id", "target"))
    to_ends = refs.filter(F.col("source") != F.col("target")).join(ends, ["set_id", "target"], "left_semi")
    from_follow = listed.join(follow.select("set_id", F.col("target").alias("source")), ["set_id", "source"], "left_semi")
    return nodes, distinct_edges(to_ends, from_follow, tasks=tasks)


def seed_set(refs: DataFrame, selected: DataFrame) -> DataFrame:
    """(set_id, seed): everything the selection cites, minus the selected works."""
    seeds = refs.select("set_id", F.col("target").alias("seed")).distinct()
    return seeds.join(selected.select("set_id", F.col("paper_id").alias("seed")), ["set_id", "seed"], "left_anti")


def listed_citers(seeds: DataFrame, selected: DataFrame, cites: DataFrame, works: DataFrame,
                  per_work: int = CITERS_FOR_POOL) -> DataFrame:
    """(target, source, list_pos): the citer lists that a pool is drawn from."""
    asked = seeds.select(F.col("seed").alias("target")).unionByName(selected.select(F.col("paper_id").alias("target")))
    return in_passes(passes_of(tasks_for(cites), cites)[0], "target", lambda cites, asked: top_citers(
        cites.join(asked.distinct(), "target", "left_semi"), works, per_work), cites, asked, keep=True)


def pool_passes(seeds: DataFrame, selected: DataFrame, listed: DataFrame) -> int:
    """Passes that the sets of a pool need: the ids of citer lists that cross to them, by ``PASS_IDS``."""
    asked = seeds.select(F.col("seed").alias("target")).unionByName(selected.select(F.col("paper_id").alias("target")))
    count = lambda df, name: df.groupBy("target").agg(F.count(F.lit(1)).alias(name))
    with exchanges_dropped(seeds.sparkSession):
        ids = count(asked, "n_asked").join(count(listed, "n_listed"), "target").agg(F.sum(F.col("n_asked") * F.col("n_listed"))).first()[0]
    return min(MAX_PASSES, max(1, -(-(ids or 0) // PASS_IDS)))


def citer_pool(seeds: DataFrame, selected: DataFrame, cites: DataFrame, works: DataFrame, n: int = POOL_SIZE,
               per_work: int = CITERS_FOR_POOL, listed: DataFrame | None = None, passes: int | None = None) -> DataFrame:
    """(set_id, work_id, freq, direct, hits): works that cite the most seeds, ties in first-seen order.

    ``freq`` counts listed citations of seeds and selected works, ``hits`` those of seeds alone.
    A target's citers are one array (``per_work`` at most) that crosses to its sets in the one exchange by set;
    a task then reads its sets one after the other and keeps the first ``n`` works of each, so no table of all
    counts stands in memory or on disk. A set with over ``HOT_SET`` targets is split by citing work.
    ``listed``, ``passes``: ``listed_citers`` and ``pool_passes``, where they are known.
    """
    listed = listed_citers(seeds, selected, cites, works, per_work) if listed is None else listed
    passes = pool_passes(seeds, selected, listed) if passes is None else passes
    lists = in_passes(passes, "target", lambda listed: listed.groupBy("target").agg(F.array_sort(F.collect_list(
        F.struct("list_pos", "source"))).getField("source").alias("citers")), listed)
    return in_passes(passes, "set_id", lambda seeds, selected: _pool(lists, seeds, selected, n), seeds, selected)


def _pool(lists: DataFrame, seeds: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    asked = seeds.select("set_id", F.col("seed").alias("target"), F.lit(0).alias("kind")).unionByName(
        selected.select("set_id", F.col("paper_id").alias("target"), F.lit(1).alias("kind")))
    # One row per HOT_SET targets at most, so it is small enough to broadcast.
    hot = F.broadcast(asked.groupBy("set_id").agg(F.ceil(F.count(F.lit(1)) / HOT_SET).cast("int").alias("shares")).filter("shares > 1"))
    own = selected.select("set_id", F.lit(None).alias("target"), F.lit(2).alias("kind"), F.array("paper_id").alias("citers"))
    reach = lambda sets: sets(asked).join(lists, "target").unionByName(sets(own), allowMissingColumns=True)
    cold = reach(lambda df: df.join(hot, "set_id", "left_anti")).select("set_id", "kind", "target", "citers")
    return _pool_of_sets(cold, n).unionByName(_pool_of_shares(reach(lambda df: df.join(hot, "set_id")), n))


def _in_sets(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``work`` on whole sets: a task reads its rows by ``set_id`` and hands on those of the sets that are complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            # The last set may go on in the next batch.
            sets = _ranks(held["set_id"])[0]
            whole = int(np.argmax(sets == sets[-1]))
            if whole:
                yield from work(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None:
            yield from work(held.combine_chunks())

    return rows.repartition("set_id").sortWithinPartitions("set_id").mapInArrow(run, schema)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _ranks(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(place of each value among the distinct ones in order, these values); null is the first."""
    known = pc.unique(values.drop_null())
    known = known.take(pc.sort_indices(known))
    at = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64) + 1
    return at, pa.concat_arrays([pa.nulls(1, known.type), known])


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins among sorted ones."""
    return np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else keys


def _heads(groups: np.ndarray, n: int) -> np.ndarray:
    """Marks the first ``n`` rows of each group; groups stand together."""
    at = _starts(groups)
    return np.arange(len(groups)) - np.repeat(at, np.diff(np.r_[at, len(groups)])) < n


def _pool_of_sets(rows: DataFrame, n: int) -> DataFrame:
    """The pool of sets that one task counts, each for itself.  ``rows``: (set_id, kind, target, citers)."""
    schema = T.StructType([rows.schema["set_id"], T.StructField("work_id", rows.schema["citers"].dataType.elementType),
                           T.StructField("freq", T.LongType()), T.StructField("direct", T.BooleanType()), T.StructField("hits", T.LongType())])

    def first_works(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        (group, sets), kind, (target, _) = _ranks(rows["set_id"]), rows["kind"].to_numpy(), _ranks(rows["target"])
        # In order of first sight: seeds before selected works, then by target, then by place in its list.
        seen = np.lexsort((target, kind, group))
        citers = _flat(rows["citers"]).take(pa.array(seen))
        row = np.repeat(seen, pc.list_value_length(citers).to_numpy())
        work, works = _ranks(citers.flatten())
        key = group[row] * len(works) + work
        order = np.argsort(key, kind="stable")
        at = _starts(key[order])
        if not len(at):
            return
        kinds = kind[row[order]]
        freq, hits = np.add.reduceat((kinds < 2).astype(np.int64), at), np.add.reduceat((kinds == 0).astype(np.int64), at)
        kinds, first = np.maximum.reduceat(kinds, at), order[at]
        place = group[row[first]]
        best = np.flatnonzero(kinds < 2)
        best = best[np.lexsort((first[best], -freq[best], place[best]))]
        best = best[_heads(place[best], n)]
        yield pa.RecordBatch.from_arrays([
            sets.take(pa.array(place[best])), works.take(pa.array(work[first[best]])), pa.array(freq[best]),
            pa.array(kinds[best] == 1), pa.array(hits[best])], ["set_id", "work_id", "freq", "direct", "hits"])

    return _in_sets(rows.select("set_id", "kind", "target", "citers"), first_works, schema)


def _pool_of_shares(rows: DataFrame, n: int) -> DataFrame:
    """The pool of large sets, split by citing work.  ``rows``: (set_id, kind, target, citers, shares)."""
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(1), F.col("shares"))))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("citers")), lambda i: F.pmod(
        F.xxhash64(F.get(F.col("citers"), i - 1)), F.col("shares")) == F.col("share") - 1))
    rows = rows.select("set_id", "share", "kind", "target", "citers", F.explode("at").alias("pos")).select(
        "set_id", "share", "kind", "target", "pos", F.get(F.col("citers"), F.col("pos") - 1).alias("source"))
    # Least target and its place per kind: numbers only, so that Spark can count in a hash table.
    target = lambda kind: F.when(F.col("kind") == kind, F.col("target"))
    counted = rows.groupBy("set_id", "share", "source").agg(
        F.count(F.when(F.col("kind") < 2, 1)).alias("freq"), F.count(F.when(F.col("kind") == 0, 1)).alias("hits"),
        F.max("kind").alias("kind"), F.min(target(0)).alias("seed"), F.min_by("pos", target(0)).alias("seed_pos"),
        F.min(target(1)).alias("paper"), F.min_by("pos", target(1)).alias("paper_pos")).filter("kind < 2")
    first_seen = [F.col("seed").isNull(), F.coalesce("seed", "paper"), F.coalesce("seed_pos", "paper_pos")]
    return topk(counted, ["set_id"], [F.col("freq").desc(), *first_seen], n).select(
        "set_id", F.col("source").alias("work_id"), "freq", (F.col("kind") == 1).alias("direct"), "hits")


def places(value: Column, n: int) -> Column:
    """A number of nine places rounded half up to ``n``, as a decimal: a tie is not left to a double's last bit."""
    return F.round(value.cast("decimal(18,9)"), n).cast("double")


def coupling(pool: DataFrame, seeds: DataFrame, work_refs: DataFrame, works: DataFrame, n: int = MAX_NODES,
             min_shared: int = MIN_SHARED, listed: DataFrame | None = None, passes: int = 1) -> DataFrame:
    """Best coupled works per set: (set_id, work_id, shared, similarity, score, rank).

    ``pool``: (set_id, work_id, direct, in_index); ``work_refs``: distinct (source, target).
    Similarity is the cosine of the two reference sets; the bonuses only order.

    A pool of ``citer_pool`` has counted most shared references already: with its ``hits`` and the citer
    lists it was drawn from (``listed``), only references outside these lists are still looked up (those to
    works with more citers than a list holds), and listed citations that ``work_refs`` lacks are taken off.
    Without ``listed`` every reference of a pool work is looked up; the result is the same.
    ``passes``: those of the pool; the tables are then read once a pass.
    """
    sizes = work_refs.groupBy(F.col("source").alias("work_id")).agg(F.count(F.lit(1)).alias("n_refs"))
    # A work listed twice stays twice.
    counts = works.groupBy("work_id", "cited_by_count").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    known = in_passes(passes, "work_id", lambda sizes, counts: sizes.join(counts, "work_id", "left"), sizes, counts)
    mark = lambda df, d: df.select("source", "target", F.lit(d).alias("d"))
    wanted = seeds.select(F.col("seed").alias("target"))
    if listed is None:
        pool = pool.withColumn("hits", F.lit(0).cast("long"))
        change = in_passes(passes, "target", lambda refs, wanted: mark(refs, 1).join(
            wanted.distinct(), "target", "left_semi"), work_refs, wanted)
    else:
        change = in_passes(passes, "target", lambda refs, listed, wanted: mark(refs, 1).unionByName(mark(listed, -1)).groupBy(
            "source", "target").agg(F.sum("d").alias("d")).filter("d <> 0").join(
            wanted.distinct(), "target", "left_semi"), work_refs, listed, wanted)
    return in_passes(passes, "set_id", lambda pool, seeds: _coupled(pool, seeds, known, change, n, min_shared), pool, seeds)


def _coupled(pool: DataFrame, seeds: DataFrame, known: DataFrame, change: DataFrame, n: int, min_shared: int) -> DataFrame:
    n_seeds = seeds.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    wanted = seeds.select("set_id", F.col("seed").alias("target"), F.lit(True).alias("wanted"))
    about = ["set_id", "work_id", "direct", "in_index", "hits"]
    # What is known of a work joins in one exchange by work, the sets in one by set.
    rows = pool.select(*about).join(known, "work_id").join(
        change.withColumnRenamed("source", "work_id"), "work_id", "left").join(wanted, ["set_id", "target"], "left")
    about += ["n_refs", "cited_by_count", "copies"]
    rows = rows.select(*about, F.when(F.col("wanted"), F.col("d")).alias("d")).repartition("set_id").groupBy(*about).agg(
        F.sum("d").alias("more"))
    rows = rows.withColumn("shared", F.col("hits") + F.coalesce("more", F.lit(0))).join(n_seeds, "set_id", "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    rows = rows.filter((F.col("shared") >= max(1, min_shared)) | F.col("direct"))
    cos = F.coalesce(F.col("shared") / F.sqrt(F.col("n_refs") * F.col("n_seeds")), F.lit(0.0))
    bonus = F.when(F.col("direct"), DIRECT_BONUS).otherwise(0.0) + F.when(F.col("in_index"), INDEX_BONUS).otherwise(0.0)
    rows = rows.withColumn("cosine", cos).withColumn("score", F.round(cos + bonus, 9))
    order = [F.col("score").desc(), F.coalesce("cited_by_count", F.lit(0)).desc(), F.col("work_id")]
    return topk(rows, ["set_id"], order, n).select(
        "set_id", "work_id", "shared", places(F.round("cosine", 9), 4).alias("similarity"), places(F.col("score"), 4).alias("score"), "rank")


def coupling_pairs(nodes: DataFrame, work_refs: DataFrame) -> DataFrame:
    """(set_id, a, b, weight): cosine of the reference sets of two nodes of one graph, a < b.

    ``nodes`` (set_id, work_id) is a graph's node list, capped per set.  A node's references cross to its sets
    as one array, and a task counts the pairs of one set after the other.
    """
    return _pairs(nodes, _cited_lists(work_refs))


def _pairs(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    rows = _cited(nodes.select("set_id", "work_id").distinct(), lists)
    kind = rows.schema["work_id"].dataType
    schema = T.StructType([rows.schema["set_id"], T.StructField("a", kind), T.StructField("b", kind),
                           T.StructField("shared", T.LongType()), T.StructField("weight", T.DoubleType())])

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pa.array(np.lexsort((_ranks(rows["work_id"])[0], _ranks(rows["set_id"])[0]))))
        group, lists = _ranks(rows["set_id"])[0], _flat(rows["targets"])
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        node = np.repeat(np.arange(len(size)), size)
        target, targets = _ranks(lists.flatten())
        key = group[node] * len(targets) + target
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        # Nodes that cite one work stand together, in order: each meets the next ones, as far as they go.
        met, at, step = [], np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            met.append(node[at] * len(size) + node[at + step])
        found, shared = np.unique(np.concatenate(met), return_counts=True) if met else (node, node)
        if len(found):
            a, b = found // len(size), found % len(size)
            sets, works = _flat(rows["set_id"]), _flat(rows["work_id"])
            yield pa.RecordBatch.from_arrays([
                sets.take(pa.array(a)), works.take(pa.array(a)), works.take(pa.array(b)), pa.array(shared.astype(np.int64)),
                pa.array(shared / np.sqrt(size[a] * size[b]))], schema.fieldNames())

    return _in_sets(rows, pairs, schema)


def _cited_lists(work_refs: DataFrame, passes: int = 1) -> DataFrame:
    """(work_id, targets): everything that a work cites."""
    return in_passes(passes, "source", lambda refs: refs.groupBy("source").agg(F.collect_list(F.struct("target")).getField(
        "target").alias("targets")), work_refs).withColumnRenamed("source", "work_id")


def _cited(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(set_id, work_id, targets): each node with its list."""
    return nodes.select("set_id", "work_id").join(lists, "work_id").select("set_id", "work_id", "targets")


def topk_edges(pairs: DataFrame, k: int = EDGES_PER_NODE, min_weight: float = MIN_EDGE_WEIGHT) -> DataFrame:
    """(set_id, source, target, weight): edges among the ``k`` strongest of either end, stored once."""
    strong = pairs.filter(F.round("weight", 9) >= min_weight).withColumn("w9", F.round("weight", 9))
    end = lambda node, other: F.struct(F.col(node).alias("node"), F.col(other).alias("other"))
    both = strong.select("set_id", "w9", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select(
        "set_id", "e.node", "e.other", "w9")
    best = topk(both, ["set_id", "node"], [F.col("w9").desc(), F.col("other")], k)
    return best.select("set_id", F.least("node", "other").alias("source"), F.greatest("node", "other").alias("target"),
                       F.round("w9", 4).alias("weight")).distinct()


def coupling_edges(nodes: DataFrame, work_refs: DataFrame, k: int = EDGES_PER_NODE, passes: int = 1) -> DataFrame:
    lists = _cited_lists(work_refs, passes)
    return in_passes(passes, "set_id", lambda nodes: topk_edges(_pairs(nodes, lists), k), nodes)


def most_cited(nodes: DataFrame, work_refs: DataFrame, skip: DataFrame | None = None, n: int | None = None, passes: int = 1) -> DataFrame:
    """(set_id, work_id, support): how many nodes of a set cite each work; ``skip`` (set_id, work_id) left out,
    the first ``n`` of a set by support and id, or all."""
    lists = _cited_lists(work_refs, passes)
    if skip is None:
        return in_passes(passes, "set_id", lambda nodes: _support_of_cited(nodes, lists, None, n), nodes)
    return in_passes(passes, "set_id", lambda nodes, skip: _support_of_cited(nodes, lists, skip, n), nodes, skip)


def _support_of_cited(nodes: DataFrame, lists: DataFrame, skip: DataFrame | None, n: int | None) -> DataFrame:
    rows = _cited(nodes, lists).select("set_id", F.lit(0).alias("kind"), "targets")
    skipping = skip is not None
    if skipping:
        rows = rows.unionByName(skip.dropna(subset=["set_id", "work_id"]).select(
            "set_id", F.lit(1).alias("kind"), F.array("work_id").alias("targets")))
    schema = T.StructType([rows.schema["set_id"], T.StructField("work_id", rows.schema["targets"].dataType.elementType),
                           T.StructField("support", T.LongType())])

    def count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        (group, sets), kind, lists = _ranks(rows["set_id"]), rows["kind"].to_numpy(), _flat(rows["targets"])
        row = np.repeat(np.arange(len(kind)), pc.list_value_length(lists).to_numpy())
        work, works = _ranks(lists.flatten())
        key = group[row] * len(works) + work
        left = key[kind[row] == 0]
        if skipping:
            left = left[~np.isin(left, key[kind[row] == 1])]
        found, support = np.unique(left, return_counts=True)
        if n is not None:
            best = np.lexsort((found, -support, found // len(works)))
            best = best[_heads(found[best] // len(works), n)]
            found, support = found[best], support[best]
        if len(found):
            yield pa.RecordBatch.from_arrays([
                sets.take(pa.array(found // len(works))), works.take(pa.array(found % len(works))), pa.array(support.astype(np.int64))],
                schema.fieldNames())

    return _in_sets(rows, count, schema)


def drop_unverified(works: DataFrame) -> DataFrame:
    """Keep works with an id, references, or a title from somewhere better than the external record."""
    return works.filter(F.col("arxiv_id").isNotNull() | (F.coalesce("n_refs", F.lit(0)) > 0) | (F.col("title_source") != "openalex"))


def prior_works(nodes: DataFrame, selected: DataFrame, work_refs: DataFrame, verified: DataFrame, passes: int = 1) -> DataFrame:
    """Works the nodes cite most: best 30, then the first 10 that are verified."""
    skip = nodes.select("set_id", "work_id").unionByName(selected.select("set_id", F.col("paper_id").alias("work_id")))
    best = most_cited(nodes, work_refs, skip, PRIOR_CANDIDATES, passes)
    kept = best.join(verified.select("work_id"), "work_id", "left_semi")
    return topk(kept, ["set_id"], [F.col("support").desc(), F.col("work_id")], LIST_SIZE)


def derivative_works(nodes: DataFrame, pool: DataFrame, work_refs: DataFrame, works: DataFrame) -> DataFrame:
    """Pool works that cite the most nodes: the first 10 by support, count, id."""
    cited = work_refs.join(nodes.select("set_id", F.col("work_id").alias("target")), "target").groupBy(
        "set_id", F.col("source").alias("work_id")).agg(F.count(F.lit(1)).alias("support"))
    rows = cited.join(pool.select("set_id", "work_id"), ["set_id", "work_id"], "left_semi").join(
        nodes.select("set_id", "work_id"), ["set_id", "work_id"], "left_anti").join(
        works.select("work_id", "cited_by_count"), "work_id", "left")
    order = [F.col("support").desc(), F.coalesce("cited_by_count", F.lit(0)).desc(), F.col("work_id")]
    return topk(rows, ["set_id"], order, LIST_SIZE).select("set_id", "work_id", "support", "rank")


def shared_counts(a: DataFrame, b: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Size of the intersection of two item sets per group."""
    return a.select(*by, item).distinct().join(b.select(*by, item).distinct(), [*by, item], "left_semi").groupBy(*by).agg(
        F.count(F.lit(1)).alias("shared"))


def graph_counts(similarity_nodes: DataFrame, similarity_edges: DataFrame, citation_nodes: DataFrame,
                 citation_edges: DataFrame) -> DataFrame:
    """(set_id, n_nodes, n_edges) of the shown graph: similarity when it has nodes, else citation."""
    def counts(nodes, edges, prefix):
        n = nodes.groupBy("set_id").agg(F.count(F.lit(1)).alias(f"{prefix}n"))
        e = edges.groupBy("set_id").agg(F.count(F.lit(1)).alias(f"{prefix}e"))
        return n.join(e, "set_id", "left")

    both = counts(similarity_nodes, similarity_edges, "s").join(counts(citation_nodes, citation_edges, "c"), "set_id", "full")
    shown = F.col("sn") > 0
    pick = lambda s, c: F.coalesce(F.when(shown, F.coalesce(s, F.lit(0))), F.col(c), F.lit(0)).cast("long")
    return both.select("set_id", pick("sn", "cn").alias("n_nodes"), pick("se", "ce").alias("n_edges"))


def citation_status(has_key: Column, errors: Column, ok_calls: Column) -> Column:
    return F.when(~has_key, "no_key").when((errors > 0) & (ok_calls <= 0), "error").otherwise("ok")


def similarity_status(has_key: Column, failed: Column, usable: Column, incomplete: Column) -> Column:
    """``partial`` means some inputs were missing."""
    return (F.when(~has_key, "no_key").when((failed > 0) & ~usable & ~incomplete, "error")
            .when(incomplete | (failed > 0), "partial").otherwise("ok"))


def resolvable_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are nodes of the set; a missing weight becomes 0.1."""
    end = lambda c: nodes.select("set_id", F.col("work_id").alias(c))
    return edges.join(end("source"), ["set_id", "source"], "left_semi").join(
        end("target"), ["set_id", "target"], "left_semi").withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)))


def neighbours(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, neighbour): one hop in both directions for the asked nodes (node)."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour")))
    return both.join(asked.select("node").distinct(), "node", "left_semi").distinct()


def works_by_keys(works: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Works for a whole table of keys: by id, or by the DOI derived from a paper id."""
    if by == "id":
        return works.join(keys.select(F.col("key").alias("work_id")).distinct(), "work_id", "left_semi")
    doi = keys.select(F.concat(F.lit("10.48550/arxiv."), F.lower("key")).alias("doi")).distinct()
    return works.withColumn("doi", F.lower("doi")).join(doi, "doi", "left_semi")


def id_diff(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(id, side): ids only in the base (missing) or only in the candidate (extra)."""
    missing = base.select("id").distinct().join(cand.select("id"), "id", "left_anti").withColumn("side", F.lit("missing"))
    extra = cand.select("id").distinct().join(base.select("id"), "id", "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)
