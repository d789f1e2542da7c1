"""Token-id output: ORC files in ascending document order.

Layout of a folder: ``ids/`` holds one ORC file per range of document ids, each row a document with its ids as an
integer array, which ORC stores run-length encoded in stripes with a row index and a Bloom filter on the document id;
``parts/`` holds one row per file with its count of tokens. A document's place in the whole stream is the count of the
files before its own plus its place in the file, so files are written and read independently of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.batches import ready, slices
from leadloom.llm.word_ids import encoder_for

#: Text encoded at once: distinct parts are looked up once for each such slice.
_SLICE_BYTES = 4_000_000

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, parts: int | None = None) -> None:
    """Encode every text with the tokenizers library, append ``end_id`` to each document and write the folder ``path``.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text becomes the end id alone. Documents
    are dealt by range of doc_id, null ids first, and sorted, so files ascend; rows that repeat an id stay, in any
    order among themselves. An empty table gives an empty folder.
    """
    spark = docs.sparkSession
    ready(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        part, done = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", _SLICE_BYTES):
            ids, n = encoder.encode(batch.column(1), end_id)
            stops = np.cumsum(n)
            before = done + stops - n
            done += ids.size
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), lists],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    rows = dealt.mapInArrow(encode, "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    rows.write.options(**ORC_OPTIONS).orc(f"{path}/ids")
    spark.read.schema(rows.schema).orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("tokens")).coalesce(1).write.orc(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder; a filter on doc_id prunes files, stripes and row groups.

    ``start`` counts the tokens of all documents before this one. The list of parts has one row per file.
    """
    parts = spark.read.schema("part int, tokens long").orc(f"{path}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    ids = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").orc(f"{path}/ids")
    return ids.join(parts, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            stops = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))) * 4
            sums = [zlib.crc32(values[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
