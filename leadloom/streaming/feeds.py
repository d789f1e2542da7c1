"""Incremental feeds with Structured Streaming: new files only, orders that accumulate, sent mail by day.

An accumulating table is dealt to buckets by the hash of its ids, each in versions of Parquet. A micro-batch reads and
writes anew only the buckets that its ids fall in. Versions are named by their batch and count once they are whole, so a
batch that runs again writes the same versions and a restart neither loses nor doubles rows; of each bucket the last
``KEPT`` versions stay. Nothing is kept in a stateful operator without end.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leadloom.operators import market


def new_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", glob: str | None = None, most: int | None = 1000) -> DataFrame:
    """Stream of files that have not been read before; the query's checkpoint remembers them.

    ``glob`` names files or folders of files below ``path``. A micro-batch takes ``most`` files, or all that there are.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", most) if most else reader
    return reader.load(f"{path.rstrip('/')}/{glob}" if glob else path)


#: Versions of a bucket that stay: the current one, and one for readers that began before it.
KEPT = 2


def _folder(spark: SparkSession, root: str):  # noqa: ANN202
    """A folder's path and the file system that holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """Whole versions of each bucket below a folder, ascending. A version is whole once its batch is marked."""
    path, fs = _folder(spark, root)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    marked = {int(m[1]) for n in names if (m := re.fullmatch(r"done-(\d+)", n))}
    found: dict[int, list[int]] = {}
    for n in names:
        if (m := re.fullmatch(r"v=(\d+)", n)) and int(m[1]) in marked:
            child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, n)
            for s in fs.listStatus(child):
                if b := re.fullmatch(r"bucket=(\d+)", s.getPath().getName()):
                    found.setdefault(int(b[1]), []).append(int(m[1]))
    return {b: sorted(v) for b, v in found.items()}


def _current(spark: SparkSession, root: str, before: int | None, buckets: list[int] | None) -> DataFrame | None:
    """Rows of the last whole version of buckets, or of the last one before a batch; None if there is none."""
    paths = []
    for b, versions in _versions(spark, root).items():
        have = [v for v in versions if before is None or v < before]
        if have and (buckets is None or b in buckets):
            paths.append(f"{root}/v={have[-1]}/bucket={b}")
    return spark.read.parquet(*sorted(paths)) if paths else None


def write_version(rows: DataFrame, root: str, number: int) -> None:
    """Write the buckets that rows (with ``bucket``) fall in as version ``number`` of a folder's table.

    The version counts once it is whole; versions of a bucket beyond the last ``KEPT`` go.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v={number}")
    path, fs = _folder(spark, root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.create(at(path, f"done-{number}"), True).close()
    for b, versions in _versions(spark, root).items():
        for v in versions[:-KEPT]:
            fs.delete(at(path, f"v={v}/bucket={b}"), True)


def current_rows(spark: SparkSession, root: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """Rows of the last whole version of buckets, or of the last one before a number; other buckets are not opened."""
    return _current(spark, root, before, buckets)


def accumulate_orders(raw: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold demand rows into one row per order as they arrive: the last snapshot wins, the first day stays.

    The fold is associative, so any split into batches gives what one batch over all rows gives. ``buckets`` is the
    table's for good; a batch touches at most so many.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = market.normalize_orders(batch)
        place = F.struct("source", "day", F.coalesce("unit", F.lit("")), "pos")
        kept = [c for c in fresh.columns if c not in ("id", "day", "unit", "pos")]
        rows = fresh.select("id", F.struct(*kept).alias("row"), place.alias("place"), F.col("day").alias("first_seen"), F.col("day").alias("last_seen"))
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())
        old = _current(spark, root, number, touched)
        both = rows if old is None else rows.unionByName(old)
        merged = both.groupBy("id").agg(F.max_by("row", "place").alias("row"), F.max("place").alias("place"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        write_version(merged.withColumn("bucket", bucket), root, number)

    return raw.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated_orders(spark: SparkSession, root: str) -> DataFrame | None:
    """Orders as accumulated so far, with the columns of ``latest_orders``."""
    found = _current(spark, root, None, None)
    return None if found is None else found.select("id", "row.*", "first_seen", "last_seen")


def sent_once(log: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row a draft of a stream of sent mail; repeats may come up to ``delay`` late."""
    return log.withWatermark("sent_at", delay).dropDuplicatesWithinWatermark(["draft_id"])


def sent_per_day(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mail by day and recipient's domain; a day is told once the watermark has passed it."""
    domain = F.substring_index("to", "@", -1).alias("domain")
    days = log.withWatermark("sent_at", delay).groupBy(F.window("sent_at", "1 day").alias("w"), domain).agg(F.count("*").alias("sent"))
    return days.select(F.to_date("w.start").alias("day"), "domain", "sent")


def enrich_new(leads: DataFrame, step, apply, sink: str, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Run a step on the leads of a stream that still lack it (``step`` a condition, ``apply`` the step) and append."""

    def run(batch: DataFrame, number: int) -> None:
        apply(batch.filter(step)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return leads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
