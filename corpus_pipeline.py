"""From raw documents to packed sequences: five stages, each working on all that the one before it kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is stored as Parquet and
read again. All but the last return the columns of ``documents``; ``n_chars`` follows the text.

Defined results: a stage decides row by row, so rows that share an id, or have none, are told
apart by their text. A null or empty text is not toxic, has no lines to lose, is nobody's copy and
is not contaminated, so its row reaches the packing. Of rows with equal texts one stays; wordless
ones all stay. An empty table, or one without labels or benchmark items, passes through; with no
toxic label nothing is toxic. Further columns of ``documents`` are left out at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from penmark.llm import decontaminate, lines, minmax, packing, toxicity
from penmark.llm.common import table
from penmark.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LINE_EDITS = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the rest is untouched."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that the corpus has earlier go; every document keeps its row."""
    kept = lines.dedup_lines(docs.select(*COLUMNS), max_edits=LINE_EDITS)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that with the smallest id."""
    return minmax.without_copies(docs.select(*COLUMNS), words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark phrases cover a twentieth or more go."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in sequences of 4096."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed_documents(docs, path, "word", end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The first stage is a trained model, so the rows cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
