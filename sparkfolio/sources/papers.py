"""Paper metadata: pruned scan, cleaning, first-row-wins dedupe, versioned snapshots."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sparkfolio.functions.text import squeeze

PAPER_SCHEMA = T.StructType([
    T.StructField("paper_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("categories", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("first_version_date", T.TimestampType()),
    T.StructField("doi", T.StringType()),
])
PAPER_COLUMNS = PAPER_SCHEMA.fieldNames()


def read_papers(spark: SparkSession, path: str, columns: Sequence[str] = PAPER_COLUMNS) -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.parquet(path).select(*columns)


def clean_papers(df: DataFrame) -> DataFrame:
    """Squeezed title and abstract, ``""`` instead of NULL, date as YYYY-MM-DD text."""
    text = {c: F.coalesce(F.col(c), F.lit("")).alias(c)
            for c in ("paper_id", "authors", "categories", "primary_category", "doi") if c in df.columns}
    out = []
    for name in df.columns:
        if name in ("title", "abstract"):
            out.append(squeeze(F.coalesce(F.col(name), F.lit(""))).alias(name))
        elif name == "first_version_date":
            out.append(F.coalesce(F.date_format(F.col(name), "yyyy-MM-dd"), F.lit("")).alias("date"))
        else:
            out.append(text.get(name, F.col(name)))
    return df.select(*out)


def first_row_per_key(df: DataFrame, key: str | Sequence[str], *position: str | Column) -> DataFrame:
    """The first row of every key in ``position`` order.

    Spark keeps only the first row of each key per input partition before the
    shuffle (a row_number filter is pushed below it), so a hot key moves few rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def ingest(df: DataFrame, position: str | Column, prefixes: Sequence[str] = ()) -> DataFrame:
    """Category filter, cleaning and dedupe in one pass over the snapshot."""
    from sparkfolio.operators.filters import has_category_prefix

    kept = df.filter(has_category_prefix(F.col("categories"), prefixes)) if prefixes else df
    return first_row_per_key(clean_papers(kept), "paper_id", position)


def build_stats(scanned: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows scanned, distinct papers kept."""
    return scanned.agg(F.count(F.lit(1)).alias("scanned")).select(
        "scanned", kept.agg(F.count(F.lit(1))).scalar().alias("papers"))


POINTER = "published long, version string, location string"


def write_snapshot(df: DataFrame, path: str, version: str) -> str:
    """Write ``path/data/version=...`` aside, then publish it by a pointer row.

    A failed write leaves the published pointer, and so the old data, in place; a
    rerun of the same version replaces its folder.
    """
    target = f"{path.rstrip('/')}/data/{version}"
    df.write.mode("overwrite").parquet(target)
    spark = df.sparkSession
    spark.createDataFrame([(time.time_ns(), version, target)], POINTER).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/pointer")
    return target


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Data of the pointer that was published last, whatever its version is called."""
    pointers = spark.read.schema(POINTER).json(f"{path.rstrip('/')}/pointer")
    return spark.read.parquet(pointers.agg(F.max_by("location", "published")).first()[0])
