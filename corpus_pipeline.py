"""The corpus pipeline: language identification, exact and near deduplication, removal of repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's result to the shared folder
and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evspark.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from evspark.llm.common import materialise, table
from evspark.llm.queries import TOKENIZER_FILE, token_pattern, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: without a letter (null and empty texts too), or with a score under
    ``language_id.LEAST_SCORE`` for the best language, they are rejected. Repeated rows are each judged alike."""
    net = language_id.fit_language_model(docs, language_id.learnable())
    return language_id.keep_known(docs, net)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last document of each group of equal texts (null counts as empty, null ids lose); of rows that share id and text, one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component (null ids come last); of rows that share id and text, one."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those left empty go, and n_chars is counted anew."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as ``packing.with_checksums`` gives them."""
    return packing.with_checksums(packing.pack_documents(docs, tokenizer_path(TOKENIZER_FILE), token_pattern()))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("passage_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
