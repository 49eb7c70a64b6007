"""Raw pages: source name, and whether the page carries paper markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkfolio.operators.pages import looks_like_paper


def source_of(name: Column) -> Column:
    """Source from the file-name prefix."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.when(base.startswith("ar5iv_"), "ar5iv").when(base.startswith("arxiv_"), "arxiv_html").otherwise("unknown")


def flag_pages(pages: DataFrame, name: str) -> DataFrame:
    """Pages with their source; pages that are no papers are flagged, not dropped."""
    return pages.withColumn("source", source_of(F.col(name))).withColumn("is_paper", looks_like_paper(F.col("html")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, html, source, is_paper) of a folder of HTML files; a file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    page = files.select(F.element_at(F.split("path", "/"), -1).alias("page_id"), F.decode("content", "UTF-8").alias("html"))
    return flag_pages(page, "page_id")
