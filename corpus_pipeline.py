"""A training corpus from documents: quality, repeated lines, near copies, benchmark passages, mix."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm import decontaminate, jaccard, line_chunks, mix, quality
from triagegrid.llm.tables import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3 go; the model learns from the labelled documents outside the held-out fold."""
    model = quality.fit_quality(docs, quality.training_labels(table(spark, sf_dir, "labels"), folds=5, held=0))
    return quality.with_quality(docs.select(COLUMNS), model, "__score").where("__score >= 0.3").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, but for their first place; n_chars is that of the text left."""
    cut = line_chunks.passage_dedup(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed_bytes") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).select(COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more) stays."""
    return jaccard.keep_one(docs.select(COLUMNS), k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.without_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), window=10)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as a stream of slots, with the text of each part of a document."""
    return mix.mix(docs.select(COLUMNS), with_text=True)[0]


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

#: Models, hashes of content-defined chunks and pseudorandom draws are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
