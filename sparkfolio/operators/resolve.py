"""Reference resolution: bibliography entries to papers, and gold sets built from them.

Lookup tables have one row per key.  A key that two different papers share is
ambiguous for good, which min(id) <> max(id) decides in one map-side aggregate.
References without a key get a filler key, so they do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkfolio.functions import ids
from sparkfolio.functions.text import normalize_title, squeeze, title_jaccard, words
from sparkfolio.scale import filler_key
from sparkfolio.sources.papers import first_row_per_key

# Method names in the order they are tried, and the shortest usable title.
METHODS = ("explicit", "arxiv_doi", "index_doi", "index_title")
STRICT_METHODS = ("arxiv_id", "doi_arxiv", "doi_metadata", "title")
MIN_TITLE_WORDS = 4
MISMATCH_BELOW = 0.5
REPAIR_FROM = 0.8


def _long_title(norm: Column) -> Column:
    return F.when(F.size(F.split(norm, " ")) >= MIN_TITLE_WORDS, norm)


def unique_keys(papers: DataFrame, key: Column) -> DataFrame:
    """(key, key_id, ambiguous): the paper of a key, and whether several papers share it."""
    return papers.select(key.alias("key"), "paper_id").filter(F.col("key").isNotNull() & (F.col("key") != "")).groupBy(
        "key").agg(F.min("paper_id").alias("key_id"), (F.min("paper_id") != F.max("paper_id")).alias("ambiguous"))


def _look_up(refs: DataFrame, dim: DataFrame, key: str, out: str) -> DataFrame:
    side = dim.select(F.col("key").alias("_dim_key"), F.col("key_id").alias(out), F.col("ambiguous").alias(f"{out}_ambiguous"))
    return refs.join(side, F.col(key) == F.col("_dim_key"), "left").drop("_dim_key")


def resolve_refs(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, ref_index, target, method, ambiguous): first hit of id, arXiv DOI, DOI, title.

    ``refs``: (paper_id, ref_index, arxiv_id, doi, title).  An explicit id is taken
    even when the table lacks it; an ambiguous DOI or title gives no hit.
    """
    norm = normalize_title(F.col("title"))
    base = refs.select(
        "paper_id", "ref_index", ids.clean_arxiv_id(F.col("arxiv_id")).alias("explicit"),
        ids.normalize_doi(F.col("doi")).alias("_doi"), _long_title(norm).alias("_title"),
    ).withColumn("by_arxiv_doi", ids.arxiv_id_of_doi(F.col("_doi")))
    done = F.col("explicit").isNotNull() | F.col("by_arxiv_doi").isNotNull()
    row = (F.col("paper_id"), F.col("ref_index"))
    base = base.withColumn("doi_key", filler_key(F.when(~done & (F.col("_doi") != ""), F.col("_doi")), *row)).withColumn(
        "title_key", filler_key(F.when(~done, F.col("_title")), *row))
    dois = unique_keys(papers, ids.normalize_doi(F.col("doi")))
    titles = unique_keys(papers, _long_title(normalize_title(F.col("title"))))
    found = _look_up(_look_up(base, dois, "doi_key", "by_doi"), titles, "title_key", "by_title")
    sure = lambda c: F.when(~F.col(f"{c}_ambiguous"), F.col(c))
    options = [F.col("explicit"), F.col("by_arxiv_doi"), sure("by_doi"), sure("by_title")]
    method = F.coalesce(*[F.when(c.isNotNull(), F.lit(m)) for c, m in zip(options, METHODS)])
    tried_title = F.coalesce(F.col("by_title_ambiguous"), F.lit(False))
    return found.select(
        "paper_id", "ref_index", F.coalesce(*options).alias("target"), method.alias("method"),
        (tried_title & F.coalesce(*options).isNull()).alias("ambiguous"))


def resolve_stats(res: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, n): references, resolved, ambiguous, and every method even when unused."""
    counts = res.groupBy(*by).agg(
        F.count(F.lit(1)).alias("refs_total"), F.count("target").alias("refs_resolved"),
        F.count_if("ambiguous").alias("refs_ambiguous"),
        *[F.count_if(F.col("method") == m).alias(m) for m in METHODS])
    names = ["refs_total", "refs_resolved", "refs_ambiguous", *METHODS]
    return counts.unpivot(list(by), names, "name", "n")


def resolve_refs_strict(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """Gold-set form: every step needs the id in the table and else falls through.

    ``papers`` needs ``pos`` (table order): the first paper wins for a DOI, and its DOI
    column may list several.  Adds the target's ``target_date``.
    """
    norm = _long_title(normalize_title(F.col("title"), drop_math=True))
    doi = ids.trim_doi(F.col("doi"))
    base = refs.select("paper_id", "ref_index", ids.clean_reference_id(F.col("arxiv_id")).alias("explicit"), doi.alias("_doi"),
                       norm.alias("_title"))
    base = base.withColumn("doi_id", ids.clean_reference_id(F.nullif(
        F.regexp_extract("_doi", r"(?i)^10\.48550/arxiv\.(.+)$", 1), F.lit(""))))
    row = (F.col("paper_id"), F.col("ref_index"))
    known = papers.select(F.col("paper_id").alias("key"), F.col("paper_id").alias("key_id"), F.lit(False).alias("ambiguous"))
    listed = papers.select("paper_id", "pos", F.explode(F.split(F.lower(squeeze(F.coalesce("doi", F.lit("")))), " ")).alias("key"))
    first_doi = listed.filter(F.col("key") != "").groupBy("key").agg(
        F.min_by("paper_id", "pos").alias("key_id")).withColumn("ambiguous", F.lit(False))
    titles = unique_keys(papers, _long_title(normalize_title(F.col("title"), drop_math=True)))
    base = base.withColumn("k1", filler_key(F.col("explicit"), *row)).withColumn("k2", filler_key(F.col("doi_id"), *row))
    found = _look_up(_look_up(base, known, "k1", "by_id"), known, "k2", "by_doi_id")
    open_now = F.col("by_id").isNull() & F.col("by_doi_id").isNull()
    found = found.withColumn("k3", filler_key(F.when(open_now, F.col("_doi")), *row))
    found = _look_up(found, first_doi, "k3", "by_doi")
    found = found.withColumn("k4", filler_key(F.when(open_now & F.col("by_doi").isNull(), F.col("_title")), *row))
    found = _look_up(found, titles, "k4", "by_title")
    options = [F.col("by_id"), F.col("by_doi_id"), F.col("by_doi"), F.when(~F.col("by_title_ambiguous"), F.col("by_title"))]
    method = F.coalesce(*[F.when(c.isNotNull(), F.lit(m)) for c, m in zip(options, STRICT_METHODS)])
    return found.select("paper_id", "ref_index", F.coalesce(*options).alias("target"), method.alias("method"))


def restrict_to_wanted(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """Metadata rows whose id, any DOI or normalized title is asked for by a reference."""
    doi = ids.trim_doi(F.col("doi"))
    doi_id = ids.clean_reference_id(F.nullif(F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1), F.lit("")))
    title = _long_title(normalize_title(F.col("title"), drop_math=True))
    asked = refs.select(F.explode(F.array(
        F.concat(F.lit("i:"), ids.clean_reference_id(F.col("arxiv_id"))), F.concat(F.lit("d:"), doi),
        F.concat(F.lit("i:"), doi_id), F.concat(F.lit("t:"), title))).alias("key")).filter(F.col("key").isNotNull()).distinct()
    listed = F.transform(F.split(F.lower(squeeze(F.coalesce("doi", F.lit("")))), " "), lambda d: F.concat(F.lit("d:"), d))
    own = F.concat(F.array(F.concat(F.lit("i:"), "paper_id"), F.concat(F.lit("t:"), normalize_title(F.col("title"), True))), listed)
    hits = papers.select("paper_id", F.explode(F.array_distinct(own)).alias("key")).join(asked, "key", "left_semi").select(
        "paper_id").distinct()
    return papers.join(hits, "paper_id", "left_semi")


def gold_before(resolved: DataFrame, papers: DataFrame, sources: DataFrame) -> DataFrame:
    """(paper_id, target, method): targets dated strictly before their source, once each.

    ``sources``: (paper_id, source_date); ``papers``: (paper_id, date); dates are
    ``YYYY-MM-DD`` text.  The first reference of a target gives the method.
    """
    dated = resolved.filter(F.col("target").isNotNull() & (F.col("target") != F.col("paper_id"))).join(
        papers.select(F.col("paper_id").alias("target"), F.col("date").alias("target_date")), "target").join(
        sources.select("paper_id", "source_date"), "paper_id")
    kept = dated.filter((F.col("target_date") != "") & (F.col("source_date") != "") & (F.col("target_date") < F.col("source_date")))
    return kept.groupBy("paper_id", "target").agg(F.min_by("method", "ref_index").alias("method"))


def gold_set(sources: DataFrame, refs: DataFrame, papers: DataFrame, min_refs: int = 15) -> DataFrame:
    """(paper_id, date, date_source, n_refs, n_resolved, target, method) of sources with enough gold."""
    dates = papers.select("paper_id", F.col("date").alias("index_date"))
    month = ids.month_of_id(F.col("paper_id")).cast("string")
    known = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.nullif(F.col("index_date"), F.lit("")))
    src = sources.select("paper_id", "date").join(dates, "paper_id", "left").select(
        "paper_id", F.coalesce(known, month, F.lit("")).alias("source_date"),
        F.when(known.isNotNull(), "metadata").otherwise("id_month").alias("date_source"))
    resolved = resolve_refs_strict(refs.join(src.select("paper_id"), "paper_id", "left_semi"), papers)
    gold = gold_before(resolved, papers, src)
    sizes = gold.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_gold")).filter(F.col("n_gold") >= min_refs)
    counts = resolved.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count("target").alias("n_resolved"))
    return gold.join(sizes, "paper_id").join(counts, "paper_id").join(src, "paper_id")


def index_meta(wanted: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, title, year, abstract) of wanted ids; rows without a title are no record."""
    meta = papers.select("paper_id", squeeze(F.col("title")).alias("title"), F.substring("date", 1, 4).alias("year"),
                         squeeze(F.col("abstract")).alias("abstract"))
    return wanted.select("paper_id").distinct().join(meta.filter(F.col("title") != ""), "paper_id")


def mismatch(index_title: Column, external_title: Column) -> Column:
    """The external record belongs to another paper (titles share under half of their words)."""
    both = (F.coalesce(index_title, F.lit("")) != "") & (squeeze(F.coalesce(external_title, F.lit(""))) != "")
    return both & (title_jaccard(index_title, external_title) < MISMATCH_BELOW)


def repair_by_title(bad: DataFrame, works: DataFrame) -> DataFrame:
    """(id, work_id, cited_by_count): the most cited work with a title Jaccard of 0.8 or more.

    Titles are compared as distinct word sets, so copies count once.  Two sets that
    similar share a word among the ``n - ceil(0.8 n) + 1`` rarest words of each, and
    only those words are joined: frequent words never pair up whole groups.
    """
    def word_sets(df: DataFrame, title: str) -> DataFrame:
        return df.withColumn("ws", F.array_sort(F.array_distinct(words(normalize_title(F.col(title)))))).filter(F.size("ws") > 0)

    left = word_sets(bad, "title").select("id", "ws")
    best = word_sets(works, "title").groupBy("ws").agg(
        F.max_by(F.struct("work_id", "cited_by_count"),
                 F.struct(F.coalesce("cited_by_count", F.lit(0)), F.col("work_id"))).alias("best"))
    left_sets = left.select("ws").distinct()
    all_words = left_sets.unionByName(best.select("ws")).select(F.explode("ws").alias("w"))
    rarity = all_words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(df: DataFrame, extra: list[str]) -> DataFrame:
        keyed = df.withColumn("sid", F.xxhash64(F.array_join("ws", " ")))
        ranked = keyed.select("sid", "ws", *extra, F.explode("ws").alias("w")).join(rarity, "w")
        # A title has few words, so one set per window.
        order = Window.partitionBy("ws").orderBy("df", "w")
        keep = F.size("ws") - F.ceil(F.lit(REPAIR_FROM) * F.size("ws") - 1e-9) + 1
        return ranked.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).select("ws", *extra, "w")

    a = prefixes(left_sets, []).select(F.col("ws").alias("wa"), "w")
    b = prefixes(best, ["best"]).select(F.col("ws").alias("wb"), "best", "w")
    near = (F.size("wa") * REPAIR_FROM <= F.size("wb") + 1e-9) & (F.size("wb") * REPAIR_FROM <= F.size("wa") + 1e-9)
    pairs = a.join(b, "w").filter(near).select("wa", "wb", "best").distinct()
    shared = F.size(F.array_intersect("wa", "wb"))
    good = pairs.filter(shared / (F.size("wa") + F.size("wb") - shared) >= REPAIR_FROM)
    top = good.groupBy("wa").agg(F.max_by("best", F.struct(
        F.coalesce(F.col("best.cited_by_count"), F.lit(0)), F.col("best.work_id"))).alias("best"))
    return left.join(top, left.ws == top.wa).select("id", F.col("best.work_id").alias("work_id"),
                                                    F.col("best.cited_by_count").alias("cited_by_count"))


def identify(works: DataFrame, hints: DataFrame, seeds: DataFrame, papers: DataFrame) -> DataFrame:
    """(work_id, arxiv_id, in_index, index_title, year, abstract): hint, seed map, own DOI or link, unique title.

    ``hints`` and ``seeds`` are (work_id, arxiv_id); ``works`` (work_id, title, doi, urls).
    """
    own = F.coalesce(
        F.nullif(F.regexp_extract(F.coalesce("doi", F.lit("")), rf"(?i)10\.48550/arxiv\.({ids.NEW_ID}|{ids.OLD_ID})", 1), F.lit("")),
        F.get(F.filter(F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.regexp_extract(
            u, rf"(?i)arxiv\.org/(?:abs|pdf)/({ids.NEW_ID}|{ids.OLD_ID})", 1)), lambda x: x != ""), 0))
    named = works.join(hints.select("work_id", F.col("arxiv_id").alias("hint")), "work_id", "left").join(
        seeds.select("work_id", F.col("arxiv_id").alias("seed")), "work_id", "left").withColumn(
        "known", F.coalesce("hint", "seed", ids.clean_arxiv_id(own)))
    titles = unique_keys(papers, _long_title(normalize_title(F.col("title"))))
    keyed = named.withColumn("title_key", filler_key(
        F.when(F.col("known").isNull(), _long_title(normalize_title(F.col("title")))), F.col("work_id")))
    found = _look_up(keyed, titles, "title_key", "by_title").withColumn(
        "arxiv_id", F.coalesce("known", F.when(~F.col("by_title_ambiguous"), F.col("by_title"))))
    meta = papers.select(F.col("paper_id").alias("_pid"), squeeze(F.col("title")).alias("index_title"),
                         F.substring("date", 1, 4).alias("index_year"), F.col("abstract").alias("index_abstract"))
    return found.withColumn("_fk", filler_key(F.col("arxiv_id"), F.col("work_id"))).join(
        meta, F.col("_fk") == F.col("_pid"), "left").select(
        "work_id", "arxiv_id", F.col("_pid").isNotNull().alias("in_index"), "index_title", "index_year", "index_abstract")


def best_title(index_title: Column, reference_title: Column, paper_title: Column, external_title: Column,
               work_id: Column) -> tuple[Column, Column]:
    """(title, source): table, bibliography, paper, external record, in this order."""
    filled = lambda c: F.nullif(squeeze(F.coalesce(c, F.lit(""))), F.lit(""))
    title = F.coalesce(filled(index_title), filled(reference_title), filled(paper_title), filled(external_title), work_id)
    source = (F.when(filled(index_title).isNotNull(), "index").when(filled(reference_title).isNotNull(), "reference")
              .when(filled(paper_title).isNotNull(), "paper").otherwise("openalex"))
    return title, source


def best_year(index_year: Column, external_year: Column, wrong: Column, published: Column) -> Column:
    digits = lambda c: F.when(c.rlike(r"^\d{4}$"), c.try_cast("int"))
    return F.coalesce(digits(index_year), F.when(~wrong, external_year), digits(F.substring(published, 1, 4)))


def match_versions(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(request_id, arxiv_id, status): entry of each requested id; an explicit version must agree.

    ``requests``: (raw); ``entries``: (entry_id, pos, ...).  Bad ids are skipped and an
    id is asked once; the first entry of an id counts.
    """
    asked = requests.select(ids.extract_id(F.col("raw")).alias("request_id")).filter(F.col("request_id") != "").distinct()
    first = first_row_per_key(
        entries.withColumn("eid", ids.extract_id(F.col("entry_id"))).filter(F.col("eid") != "").withColumn(
            "base", ids.base_id(F.col("eid"))), "base", "pos").select("base", "eid")
    version = lambda c: F.regexp_extract(c, r"(v\d+)$", 1)
    joined = asked.withColumn("base", ids.base_id(F.col("request_id"))).join(first, "base", "left")
    explicit = version(F.col("request_id")) != ""
    status = (F.when(F.col("eid").isNull(), "missing")
              .when(explicit & (version(F.col("request_id")) != version(F.col("eid"))), "version_mismatch").otherwise("ok"))
    return joined.select("request_id", F.when(status == "ok", F.when(explicit, F.col("request_id")).otherwise(F.col("eid"))).alias(
        "arxiv_id"), status.alias("status"))


def overlay_metadata(papers: DataFrame, meta: DataFrame, fields: tuple[str, ...] = ("title", "summary", "published")) -> DataFrame:
    """Non-empty metadata fields replace the paper's; without metadata the status stays."""
    m = meta.select(F.col("paper_id").alias("_mid"), *[F.col(f).alias(f"_m_{f}") for f in fields],
                    F.col("metadata_status").alias("_m_status"))
    j = papers.join(m, F.col("paper_id") == F.col("_mid"), "left")
    status = F.when(F.col("_mid").isNotNull(), F.coalesce(F.nullif("_m_status", F.lit("")), F.lit("missing"))).otherwise(
        F.col("metadata_status"))
    return j.select("paper_id", *[F.coalesce(F.nullif(f"_m_{f}", F.lit("")), F.col(f)).alias(f) for f in fields],
                    status.alias("metadata_status"))
