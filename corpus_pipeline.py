"""A corpus pipeline: language ID, line dedup, near-dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``docs``, those of
``documents`` and any more, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from tidemark.llm._common import materialise, unused
from tidemark.llm.queries import held_out, tiktoken_pattern, vocabulary

#: A text whose cosine with every language is lower is in none of them,
LEAST_SCORE = 0.05
#: if it has so many letters; the cosine of fewer is mostly chance.
LEAST_LETTERS = 100


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """``docs`` with another text, and its length where there is a column of it."""
    done = docs.withColumn("text", text)
    return (done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else done).select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or many and far from all prototypes) go; ``lang`` becomes the language found.

    Null and empty texts have no letter and go. Repeated rows and ids are judged each by its own text; a null id counts as
    one to learn from. Without labelled rows, as in an empty table, there is no language, and all go.
    """
    (found,) = unused(docs, "found")
    prototypes = language_id.fit(docs.where(~held_out()))
    judged = docs.withColumn(found, language_id.predict(F.col("text"), prototypes, spark))
    telling = F.length(F.regexp_replace("text", r"\P{L}+", "")) >= LEAST_LETTERS
    kept = judged.where((F.col(f"{found}.lang_pred") != language_id.UNDETERMINED) & ((F.col(f"{found}.score") >= LEAST_SCORE) | ~telling))
    return kept.withColumn("lang", F.col(f"{found}.lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in one of them, as of the operator; all documents stay, some with an empty text.

    A null text becomes an empty one.
    """
    (found,) = unused(docs, "found")
    return _with_text(line_dedup.dedup_lines(docs, result_col=found), F.col(f"{found}.kept"), docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, whatever ids are null or repeat.

    It is one with the smallest id; texts without a word, null ones as empty ones, are duplicates of equal texts.
    """
    return near_dedup.keep_one(docs, one_row=True).select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, each by itself, null texts as they are."""
    (found,) = unused(docs, "found")
    scanned = docs.withColumn(found, secret_scan.scan(F.col("text"), vocabulary("byte_bpe_50k.tiktoken"), tiktoken_pattern(), spark=spark))
    return _with_text(scanned, F.coalesce(f"{found}.redacted", "text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: one or more for each document, also for an empty or null text; other columns end here."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]

#: Prototypes, signatures and subword vocabularies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
