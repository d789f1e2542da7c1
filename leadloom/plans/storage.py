"""Shared-folder storage for intermediate tables.

A plan is cut with a table written where every executor can read it: under ``spark.checkpoint.dir``. Executors may be
lost at any time; such a table survives them, and its readers never recompute what produced it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input of a core below which rows are dealt anew.
SPREAD_BYTES = 16_000_000
#: Rows of an id list (one long each) that may be broadcast; larger lists go through a shuffled join.
BROADCAST_IDS = 200_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's ``spark.checkpoint.dir``; a temporary one in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="leadloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in buckets by the hash of ``key``, each one sorted file, and read it back.

    Tables of as many buckets are joined and grouped by their keys without a shuffle, which pays where a table is joined
    in every run. Rows of one key lie in one bucket: choose keys that are nearly unique.
    """
    table = f"{re.sub(r'[^a-z0-9]+', '_', name.lower())}_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_dir(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all cores; a large input stays as it is.

    A small file is one task however many cores there are, which matters where each row costs much. The size is that of
    the tables that are read, as the optimizer knows it; no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join ``df`` with a list of distinct ids.

    The list is counted first: at most ``limit`` ids are broadcast, so that wide rows that do not match are dropped
    before any shuffle; a longer list takes the shuffled join.
    """
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), key, how)
