"""Corpus pipeline: stages that run over the table of documents one after the other, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of the documents; the last returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession


from leadloom.llm import bpe, decontamination, ngram_join, suffix_dedup, toxicity
from leadloom.plans.storage import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fitted on the table of labels does not take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings of 200 that occur elsewhere; what is cut to nothing goes."""
    return suffix_dedup.cut_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 percent of the words lie under the benchmark's windows."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and hashes of them and of the decoded bytes."""
    return bpe.encode_and_decode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages' models, hashes and encodings have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
