"""Token counts: the exact histogram of documents by encoded length, and its suffix sums.

Method: every document is encoded and counted under its length; the histogram has one row per length that occurs.
Sums over the lengths from L upward then answer, for every context limit L, how many documents reach it, how many
tokens they hold, what is left of the corpus when each document is cut at L, and every quantile.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.batches import Memo, ready, slices, texts_of
from leadloom.llm.pieces import pieces_of
from leadloom.plans.storage import materialise

#: Lengths that share a bucket of the two-level sums; one task sums this many rows, another one row per bucket.
BUCKET = 128


def document_lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every document. Null and empty texts have 0 tokens; repeated ids give repeated rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        memo = Memo(lambda new: [len(enc.encode_ordinary(x)) for x in new])
        for batch in slices(batches, text_col):
            cut = [pieces_of(t) for t in texts_of(batch, text_col)]
            memo.learn(set().union(*cut))
            n = [sum(map(memo.__getitem__, x)) for x in cut]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length in ``n_tokens``, with suffix sums; no rows for no documents.

    Columns: n_tokens, n_docs, tokens (of documents of just this length), docs_reaching and tokens_reaching (documents
    of this length or more), tokens_cut (of the whole corpus, each document cut at this length), share_below_or_at (of
    the documents). Sums run inside buckets of lengths, then over one total per bucket, so that no task holds more
    than a bucket's lengths or the list of buckets, however many documents there are.
    """
    by_length = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    by_length = materialise(by_length, "lengths")  # small, and read twice; the documents are encoded once
    by_length = by_length.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("bucket", F.expr(f"n_tokens div {BUCKET}"))
    totals = by_length.groupBy("bucket").agg(F.sum("n_docs").alias("bucket_docs"), F.sum("tokens").alias("bucket_tokens"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("bucket_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("bucket_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("bucket_docs").over(everything).alias("all_docs"),
        F.sum("bucket_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = by_length.join(totals, "bucket").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_reaching"),
        (F.sum("tokens").over(inside) + F.col("tokens_above")).alias("tokens_reaching"),
    )
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_reaching", "tokens_reaching",
        (F.col("all_tokens") - F.col("tokens_reaching") + F.col("n_tokens") * F.col("docs_reaching")).alias("tokens_cut"),
        ((F.col("all_docs") - F.col("docs_reaching") + F.col("n_docs")) / F.col("all_docs")).alias("share_below_or_at"),
    )


def quantile(histogram: DataFrame, q: float) -> int | None:
    """Least length that a share ``q`` of the documents does not exceed; None for no documents."""
    return histogram.filter(F.col("share_below_or_at") >= q).agg(F.min("n_tokens")).first()[0]


def cut_total(histogram: DataFrame, limit: int) -> int:
    """Tokens of the corpus when each document is cut at ``limit``, whether or not a document has that length."""
    row = histogram.agg(
        F.sum(F.when(F.col("n_tokens") <= limit, F.col("tokens"))).alias("short"),
        F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))).alias("longer"),
    ).first()
    return (row["short"] or 0) + limit * (row["longer"] or 0)
