"""Queries over the given tables, one for each operator of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import alignment, archive, bpe, conversation_trie, decontamination, licenses, ngram_join, repetition, simhash, suffix_dedup, token_counts, token_files, toxicity
from leadloom.llm.oracles import ORACLES  # noqa: F401
from leadloom.plans.storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of documents by encoded length, with suffix sums for every length."""
    lengths = token_counts.document_lengths(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op3_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of all pages, written, then read back."""
    path = shared_dir(spark, "archive")
    archive.write_archive(table(spark, sf_dir, "pages"), path)
    records = archive.read_archive(spark, path)
    verified = F.when(F.col("verified"), True).otherwise(F.raise_error(F.concat(F.lit("a payload is not what its record says: "), "header")).cast("boolean"))
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to", verified.alias("verified")
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, then read back."""
    path = shared_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.with_crc32(token_files.read_token_files(spark, path))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and their decoded bytes."""
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition and verdict of all documents."""
    return repetition.repetition_quality(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 85 percent over four-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents under the benchmark's windows."""
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of 200 bytes.

    Anchors with more than ``suffix_dedup.MOST_MEMBERS`` different surroundings take an exact fallback, a distributed count
    of their strings.
    """
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents' tokens of two tokenizers, and how often what they link is linked."""
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt on the heads of others."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of fingerprints that differ in two bits at most."""
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


NUMBERED = (
    op1_token_counts,
    op2_quality_rules,
    op3_archive,
    op4_token_files,
    op5_bpe,
    op6_ngram_join,
    op7_license_scan,
    op8_decontamination,
    op9_toxicity,
    op10_suffix_dedup,
    op11_alignment,
    op12_conversation_trie,
    op13_simhash,
)
QUERIES = {f.__name__: f for f in NUMBERED}

