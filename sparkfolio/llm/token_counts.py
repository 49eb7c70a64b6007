"""Token counts with a digest cache.

1. Each text is reduced to its content's digest (SHA-256 of the normalised text); a narrow row per
   document is written.
2. Digests that the cache does not know under this tokenizer's version digest are misses.  One
   row is chosen for each, by partial aggregates of narrow rows, so a text that a third of all
   documents share is one row per task.
3. Only chosen rows' texts move and are encoded; their counts are appended to the cache.
4. The narrow rows are joined with the cache.

The cache is a Parquet folder (tokenizer, digest, n_tokens), partitioned by the tokenizer's
version.  Appending what another job appended too is harmless: readers take one row per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkfolio.llm.common import text_slices, written
from sparkfolio.session import work_dir

#: Characters that one call of the library encodes, unless no cut leaves the count unchanged.
STRETCH = 1 << 19
#: The sign that sentencepiece puts in place of a space.
MARK = "▁"


class PieceModel:
    """Counts of a sentencepiece model."""

    library = "sentencepiece"

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        # A space between two other characters starts a new piece, and the text after it alone gets the same start.
        self.cuts = (not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.normalize("a b") == f"{MARK}a{MARK}b"
                     and self.model.normalize("b") == f"{MARK}b")
        #: Whether the space and its sign are one character to the model.
        self.marks = self.model.normalize(f"a{MARK}b") == self.model.normalize("a b")

    def normalised(self, text: Column) -> Column:
        return F.translate(text, MARK, " ") if self.marks else text

    def counts(self, texts: list[str]) -> list[int]:
        parts = [stretches(t, STRETCH) if self.cuts else [t] for t in texts]
        flat = iter(self.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [sum(len(next(flat)) for _ in ps) for ps in parts]


class JsonModel:
    """Counts of a tokenizers file, without truncation, padding or added special tokens."""

    library = "tokenizers"

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def normalised(self, text: Column) -> Column:
        return text

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel | JsonModel:
    return PieceModel(path) if path.endswith(".model") else JsonModel(path)


def stretches(text: str, most: int) -> list[str]:
    """Cut ``text`` at single spaces between other characters, which go, into parts of ``most``
    characters or little more.  Without such a space the rest stays whole."""
    parts, start = [], 0
    while len(text) - start > most:
        cut = start + most
        while (cut := text.find(" ", cut)) > 0 and not (cut + 1 < len(text) and text[cut - 1] not in (" ", MARK) and text[cut + 1] not in (" ", MARK)):
            cut += 1
        if cut < 0:
            break
        parts.append(text[start:cut])
        start = cut + 1
    return [*parts, text[start:]]


def version_digest(path: str) -> str:
    """Digest of what decides the counts: the vocabulary file, the library and its version."""
    with open(path, "rb") as file:
        model = hashlib.sha256(file.read()).hexdigest()
    library = load(path).library
    return hashlib.sha256(f"{model} {library} {version(library)} plain".encode()).hexdigest()


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in text_slices(batches):
            table = pa.Table.from_batches([batch]).append_column("at", pa.array(range(batch.num_rows)))
            first = table.group_by("digest").aggregate([("at", "min")])  # rows that repeat an id with its text
            texts = pc.take(batch.column("text"), first.column("at_min").combine_chunks())
            yield pa.RecordBatch.from_arrays([first.column("digest").combine_chunks(), pa.array(model.counts(texts.to_pylist()), pa.int64())], names=["digest", "n_tokens"])
    return run


def stored_counts(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer's version; empty without a cache."""
    spark = docs.sparkSession
    try:
        known = spark.read.schema("tokenizer string, digest binary, n_tokens long").parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return known.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, cache: str | None = None, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than ``most``).

    ``model`` is a sentencepiece ``.model`` or a tokenizers ``.json`` file that all workers can
    read.  ``cache`` is a folder of counts that is read and appended to; without one a new
    folder is used, so every distinct text is a miss.  A null text is empty and has no tokens.
    Rows with a null or repeated id stay, each with its own text's count (a text that is repeated
    together with its id may be encoded once a task); other columns are ignored, an empty table gives an empty result.  Long texts are encoded in stretches where
    that leaves the count unchanged, and whole otherwise.
    """
    tokenizer = version_digest(model)
    cache = cache or work_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("raw")).select("doc_id", "raw", load(model).normalised(F.col("raw")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(texts.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), "digest"))
    chosen = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    misses = written(chosen.join(stored_counts(docs, cache, tokenizer), "digest", "left_anti")).withColumnRenamed("digest", "m_digest")
    fresh = texts.join(misses, (F.col("digest") == F.col("m_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    counted = fresh.select("digest", "text").mapInArrow(_encoded(model), "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a row repeated with its id may be in several tasks
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # one written row per text of this table, so that Spark can split the join at a text that many rows share
    known = written(chosen.select("digest").join(stored_counts(docs, cache, tokenizer), "digest")).withColumnRenamed("digest", "k_digest")
    return rows.join(known, F.col("digest") == F.col("k_digest")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
