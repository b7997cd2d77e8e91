"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination and packing of `documents`.

Every stage but the last returns the columns it was given, extra ones of whatever name included, and an empty table for an empty table. Null and empty
texts are rejected by the first stage, as they have no language; later stages keep them if they are given them. Repeated rows are judged alike:
they stay or go together, but for exact and near copies under other ids, of which the document of least id stays. Rows without a doc_id are judged by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _common as C
from tessera.llm import decontaminate, langid, line_dedup, near_dedup, packing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the classifier rejects. It learns from the labels of the stage's own input; without any, nothing can be told apart and all stay."""
    model = langid.fit(docs)
    if model is None:
        return docs
    names = tuple(C.fresh(docs, c) for c in ("lang_pred", "score", "rejected"))
    return langid.identify(docs, model, names).where(~F.col(names[2])).select(*C.columns(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of line runs; a document that loses every line it had is gone. n_chars follows the text."""
    names = tuple(C.fresh(docs, c) for c in ("n_lines", "n_removed", "removed"))
    gone = F.col(names[1])
    cut = line_dedup.dedup_lines(docs, names=names).where(F.col("text").isNull() | (gone == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(gone > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cut.select(*C.columns(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each near-duplicate class."""
    return near_dedup.keep_one(docs).select(*C.columns(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Learned weights, signatures and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = C.new_folder(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
