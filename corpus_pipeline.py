"""From raw documents to token ids: five stages, each a DataFrame of what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and, but for the last, returns
them. What it returns is written as Parquet and read again as the next one's ``docs``, so a lost
executor never costs more than a stage's own tasks. Nulls, empty tables, repeated rows and extra
columns are treated as each stage's operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import (bpe_segment_tree, jaccard_groups, line_spread, quality_pu, wu_manber)
from logspark.llm.common import read_table, written

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_pu.keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go from the texts, also where they are most of it; all documents stay, those
    without a line of their own as they are. ``n_chars`` is counted anew."""
    cleaned = line_spread.remove_boilerplate(docs, max_share=None)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id."""
    return jaccard_groups.keep_one(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return wu_manber.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with checksums of them and of what they decode to."""
    return bpe_segment_tree.encode_documents(docs, public_tokenizers.path(TOKENIZER),
                                             public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("token_ids", token_ids),
]

# SQL can express neither the classifier nor the encoder; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
