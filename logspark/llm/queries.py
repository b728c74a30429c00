"""The registered queries of the package: each operator over its whole table, with its parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_segment_tree, jaccard_groups, line_spread, merkle_manifest, merkle_text,
               pii_feistel, quality_pu, rp_forest, secret_forest, simple8b, suffix_repeats, whitening, wu_manber)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PII_KEY = "a key for tests; a real one comes from a secret store"


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


@query("op1_quality_pu")
def quality(spark, folder):
    return quality_pu.scores(read_table(spark, folder, "documents"),
                             read_table(spark, folder, "labels"))


@query("op2_wu_manber")
def decontamination(spark, folder):
    found = wu_manber.contamination(read_table(spark, folder, "documents"),
                                    read_table(spark, folder, "benchmark"))
    return found.drop("items")


@query("op3_jaccard_groups")
def ngram_join(spark, folder):
    return jaccard_groups.linked_documents(read_table(spark, folder, "documents"))


@query("op4_rp_forest")
def vector_dedup(spark, folder):
    return rp_forest.near_duplicates(read_table(spark, folder, "embeddings"))


@query("op5_bpe_segment_tree")
def bpe(spark, folder):
    encoded = bpe_segment_tree.encode_documents(
        read_table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.drop("ids")


@query("op6_secret_forest")
def secrets(spark, folder):
    return secret_forest.find_secrets(read_table(spark, folder, "documents"))


@query("op7_line_spread")
def line_dedup(spark, folder):
    cleaned = line_spread.remove_boilerplate(read_table(spark, folder, "documents"))
    return cleaned.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                          F.col("n_removed").cast("long").alias("n_removed"),
                          F.sha2("text", 256).alias("text_sha256"))


@query("op8_pii_feistel")
def pseudonyms(spark, folder):
    changed = pii_feistel.pseudonymise(read_table(spark, folder, "documents"), PII_KEY)
    return changed.select("doc_id", *(f"n_{kind}" for kind in pii_feistel.KINDS), "text")


@query("op9_run_index")
def repeats(spark, folder):
    return suffix_repeats.remove_repeats(read_table(spark, folder, "documents")).drop("kept")


@query("op10_simple8b")
def token_files(spark, folder):
    back = simple8b.round_trip(read_table(spark, folder, "documents"),
                               public_tokenizers.path("word_bpe_49k.json"))
    return back.drop("ids")


@query("op13_merkle_manifest")
def manifest(spark, folder):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return merkle_manifest.verified(read_table(spark, folder, "documents"),
                                    found_text=F.translate("text", upper, lower),
                                    changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


@query("op11_merkle_text")
def fingerprints(spark, folder):
    return merkle_text.compared(read_table(spark, folder, "documents"))


@query("op12_feast_whitening")
def whitening_rows(spark, folder):
    return whitening.whitened(read_table(spark, folder, "embeddings"))
