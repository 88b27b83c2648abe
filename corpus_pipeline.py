"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage works on everything its predecessor kept. The first four return the columns of their input; what a stage rejects
is gone, and a text that loses lines has its ``n_chars`` counted anew. The last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm import decontaminate, line_dedup, packing, simhash, toxicity
from dealerlens.llm.common import shipped, table
from dealerlens.session import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score one half or more go. The model is fitted on ``labels`` and the documents given."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines of another document of smaller id go; a document stays, even if it has no line left."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked fingerprints the document of the smallest id stays."""
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold an item of ``benchmark`` go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the remaining documents as pieces of sequences."""
    return packing.packed_pieces(docs)


#: (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [(name, shipped(stage)) for name, stage in (
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
)]

#: SQL has no counterpart for the toxicity model, XXH64 and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table, writing each stage's rows to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
