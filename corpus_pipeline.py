"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write and
reread it as the next stage's docs. All but the last return the columns of documents.

- ``language_id``: learned from the learning fold of its input; rejects texts without a letter and texts that
  are like no learned language, by a bound that grows with the number of their trigrams.
- ``near_duplicates``: of each class of texts with a Jaccard similarity of 0.8 or more on word
  5-grams, the document of least id stays.
- ``secrets``: live-looking secrets are masked in the text, n_chars follows; no row goes.
- ``mixing``: documents of which the mix takes nothing go; what it takes in a second pass is taken as a
  second row, so a row stands for one pass over its document. A document that the budget cuts stays whole.
- ``bpe``: each row's doc_id and source with its token ids and their number.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns: as the
operators' docstrings define; extra columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apflow.llm import bpe, folds, jaccard, language, mixing, queries, secret_scan
from apflow.operators.joins import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(docs.where(folds.learned_from(F.col("doc_id")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "source", "text"), queries.tokenizer_path()).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets),
    ("mixing", mix_sources), ("bpe", encode),
]
# the language model and the neural-free but iterative joins have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
