"""File sources and sinks besides parquet: gold sets, feeds, run artifacts, thread files, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkfolio import schemas as sc
from sparkfolio.functions.ids import extract_id
from sparkfolio.functions.text import is_blank, squeeze
from sparkfolio.operators.filters import metadata_status, paper_url
from sparkfolio.operators.ground import NOTE_FIELDS

TERMINAL = ("success", "degraded", "error")


def write_goldset(gold: DataFrame, path: str, piece: int = 100_000) -> None:
    """JSON lines of (survey_id, query, date, gold ids).  ``gold``: (survey_id, query, date, target).

    A survey cites some hundred works; one with more than ``piece`` targets becomes several lines.
    """
    part = F.floor(F.pmod(F.xxhash64("target"), F.lit(2**31)) % F.greatest(F.ceil(F.col("n") / piece), F.lit(1)))
    sizes = gold.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n"))
    rows = gold.join(sizes, "survey_id").groupBy("survey_id", "query", "date", part.alias("part")).agg(
        F.array_sort(F.collect_list("target")).alias("gold"))
    rows.drop("part").write.mode("overwrite").json(path)


def read_goldset(spark: SparkSession, path: str) -> DataFrame:
    """Gold-set lines; blank lines are no records."""
    return spark.read.schema(sc.GOLD).json(path).filter(F.col("survey_id").isNotNull())


def explode_gold(goldset: DataFrame) -> DataFrame:
    return goldset.select(F.col("survey_id").alias("query_id"), F.explode("gold").alias("paper_id")).distinct()


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries: (arxiv_id, title, summary, authors, published, subjects, links, status); no id, no row."""
    feed = spark.read.format("xml").option("rowTag", "entry").schema(sc.ATOM_ENTRY).load(path)
    text = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    none = F.array().cast("array<string>")
    authors = F.coalesce(F.transform("author", lambda a: F.trim(a["name"])), none)
    subjects = F.filter(F.coalesce(F.transform("category", lambda c: F.trim(c["_term"])), none), lambda s: s != "")
    rows = feed.select(extract_id(F.col("id")).alias("arxiv_id"), text("title").alias("title"), text("summary").alias("summary"),
                       authors.alias("authors"), F.substring(text("published"), 1, 10).alias("published"), subjects.alias("subjects"))
    return rows.filter("arxiv_id <> ''").select(
        "*", paper_url(F.col("arxiv_id"), "abs").alias("abs_url"), paper_url(F.col("arxiv_id"), "pdf").alias("pdf_url"),
        metadata_status(F.col("title"), F.col("authors"), F.col("published"), F.col("subjects")).alias("metadata_status"))


def file_texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, text): each file of a folder, subfolders included, as one row."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def run_artifacts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, notes) of the files (path, text) of run folders in both layouts.

    A run with ``state.json`` is a run output; else its ``run.json`` names one note file
    per paper.  runs: (run_id, layout, status, total_seconds); notes: (run_id, paper_id,
    arxiv_id, field, text).
    """
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -1).alias("name"), F.try_element_at(parts, F.lit(-2)).alias("folder"),
                         F.try_element_at(parts, F.lit(-3)).alias("above"), "text")
    load = lambda schema, name: named.filter(F.col("name") == name).select(F.col("folder").alias("run_id"), F.from_json("text", schema).alias("r")).select("run_id", "r.*")
    meta = load(sc.RUN_META, "run.json")
    state = load(sc.RUN_STATE, "state.json").withColumnRenamed("status", "state_status")
    runs = meta.join(state.select("run_id", "state_status", F.lit(True).alias("has_state")), "run_id", "left").select(
        "run_id", F.when(F.col("has_state"), "output").otherwise("baseline").alias("layout"),
        F.coalesce("state_status", "status", F.lit("unknown")).alias("status"), "total_seconds")
    def fields(c: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"{c}.{f}"), F.lit("")).alias("text")) for f in NOTE_FIELDS]))

    own_id = F.regexp_extract("paper_id", "^arxiv_(.*)$", 1)
    new = state.select("run_id", F.explode("selected_papers").alias("p")).select(
        "run_id", "p.paper_id", F.coalesce("p.arxiv_id", F.regexp_extract("p.paper_id", "^arxiv_(.*)$", 1)).alias("arxiv_id"), fields("p.notes").alias("n"))
    listed = meta.join(state.select("run_id"), "run_id", "left_anti").select("run_id", F.explode("artifacts.pmrl_by_paper").alias("paper_id", "rel"))
    note_files = named.select(F.col("above").alias("run_id"), F.concat_ws("/", "folder", "name").alias("rel"), F.from_json("text", sc.NOTE_FILE).alias("note"))
    old = listed.join(note_files, ["run_id", "rel"], "left").select("run_id", "paper_id", own_id.alias("arxiv_id"), fields("note").alias("n"))
    notes = new.unionByName(old).select("run_id", "paper_id", "arxiv_id", "n.field", "n.text")
    return runs, notes


def read_run_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``run_artifacts`` of a folder of run folders."""
    return run_artifacts(file_texts(spark, path))


def thread_records(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads, messages, runs) of thread files (text); other versions and broken files are skipped."""
    raw = files.select(F.from_json("text", sc.THREAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("t")).select("t.*")
    ok = raw.filter((F.col("version") == 1) & F.col("_corrupt").isNull() & F.col("threadId").isNotNull())
    threads = ok.select(F.col("threadId").alias("thread_id"), F.when(is_blank(F.col("title")), "New research").otherwise(
        F.substring("title", 1, 160)).alias("title"), F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"))
    messages = ok.select(F.col("threadId").alias("thread_id"), F.posexplode("messages").alias("pos", "m")).select("thread_id", "pos", "m.role", "m.content", "m.runId")
    status = F.when(F.col("r.status").isin(*TERMINAL), F.col("r.status")).otherwise("error")
    runs = ok.select(F.col("threadId").alias("thread_id"), F.posexplode("runs").alias("pos", "r")).select(
        "thread_id", "pos", F.col("r.runId").alias("run_id"), status.alias("status"), F.coalesce("r.answer", F.lit("")).alias("answer"))
    return threads, messages, runs


def read_threads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``thread_records`` of a folder of thread files."""
    return thread_records(file_texts(spark, path))


def lenient_notes(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Notes from machine-written JSON: numbers read as text, NULL as default, a bad list as empty.

    A record without one of the four core fields is rejected.
    """
    # Lists are read on their own, so that one bad list does not lose the record.
    core = "struct<problem:string,method:string,result:string,limitation:string,method_name:string,intuition:string,insights:string,eval_settings:string,setup:string>"
    p = records.withColumn("_n", F.from_json(payload, core))
    none = lambda c, kind: F.coalesce(F.from_json(c, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    text = lambda f: F.coalesce(F.col(f"_n.{f}"), F.lit("")).alias(f)
    keep = [c for c in records.columns if c != payload]
    out = p.select(*keep, *[text(f) for f in (*NOTE_FIELDS, "method_name", "intuition")], none("_n.insights", sc.INSIGHT).alias("insights"),
                   none("_n.eval_settings", sc.EVAL_SETTING).alias("eval_settings"), F.from_json("_n.setup", sc.SETUP).alias("setup"))
    full = F.lit(True)
    for f in NOTE_FIELDS:
        full = full & ~is_blank(F.col(f))
    return out.filter(full)


BLOCK_TYPES = ("insights", "problem", "intuition", "keyResults", "metrics", "setup", "results", "caveats", "foundations", "takeaway", "paperCards")
RESULT_KEYS = ("setting", "metric", "method", "baseline", "delta")
ACTION_KEYS = ("reportId", "bibtexCount", "graphNodes")


def check_summary(rows: DataFrame, payload: str = "summary") -> DataFrame:
    """(…, status, problems): structure of an answer summary; INFO when there is none."""
    s = F.from_json(payload, sc.SUMMARY)
    r = rows.withColumn("_s", s).withColumn("_blocks", F.coalesce("_s.blocks", F.expr("from_json('[]', 'array<struct<type:string,rows:array<map<string,string>>,items:array<string>>>')")))
    has_all = lambda m, keys: F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), F.map_keys(m))) == 0
    known = F.forall("_blocks", lambda b: F.coalesce(b["type"].isin(*BLOCK_TYPES), F.lit(False)))
    results_ok = F.forall("_blocks", lambda b: (b["type"] != "results") | (b["rows"].isNotNull() & F.forall(b["rows"], lambda x: x.isNotNull() & has_all(x, RESULT_KEYS))))
    cards_ok = F.forall("_blocks", lambda b: (b["type"] != "paperCards") | (F.coalesce(F.size(b["items"]), F.lit(0)) > 0))
    kind = F.coalesce("_s.kind", F.lit(""))
    problems = F.array_compact(F.array(
        F.when(~kind.isin("single", "multi"), "kind"), F.when(is_blank(F.col("_s.lead")), "empty lead"),
        F.when((kind == "single") & F.col("_s.paper").isNull(), "single without paper"),
        F.when((kind == "multi") & (F.coalesce(F.size("_s.papers"), F.lit(0)) == 0), "multi without papers"),
        F.when(F.col("_s.actions").isNull() | ~F.coalesce(has_all(F.col("_s.actions"), ACTION_KEYS), F.lit(False)), "actions"),
        F.when(F.size("_blocks") == 0, "no blocks"), F.when(~known, "unknown block"), F.when(known & ~results_ok, "results rows"),
        F.when(known & ~cards_ok, "paperCards without items"),
        F.when((kind == "single") & ~F.exists("_blocks", lambda b: F.coalesce(b["type"] == "setup", F.lit(False))), "single without setup block")))
    status = F.when(F.col(payload).isNull(), "INFO").when(F.size(problems) == 0, "PASS").otherwise("FAIL")
    listed = F.when(F.col(payload).isNull(), "").otherwise(F.array_join(problems, "; "))
    return r.select(*rows.columns, status.alias("status"), listed.alias("problems"))
