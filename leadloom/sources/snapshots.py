"""Raw snapshots read through a manifest of their units, so that only the files that count are opened.

Snapshots lie as files ``<source>/<day>/<unit>.jsonl``, as collectors land them, or as folders
``source=…/day=…/unit=…`` with JSON lines, as ``land`` writes them; a root may hold both. The manifest is a table of
the files by source, day and unit, made from the list of files alone. What is wanted (sources, days, the newest file of
every unit, units of a plan) is chosen on it by filters, aggregates and joins; the rows of the other files are never read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLACE = r"(?:source=)?([^/]+)/(?:day=)?([^/]+)/(?:(?:unit=)([^/]+)/[^/]+|([^/]+)\.jsonl(?:/[^/]+)?)$"
_FILES = "*.json*"


_NULL = "__HIVE_DEFAULT_PARTITION__"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _parts(path: Column) -> list[Column]:
    """Source, day and unit of a file's path. Spark escapes what the name of a folder must not hold."""
    part = lambda n: F.regexp_extract(path, _PLACE, n)
    folder = lambda c: F.when(c != _NULL, _decoded(c))
    by_folder = part(3) != ""
    pick = lambda n, c: F.when(by_folder, folder(c)).otherwise(part(n))
    return [pick(1, part(1)).alias("source"), pick(2, part(2)).alias("day"), pick(4, part(3)).alias("unit")]


def _roots(spark: SparkSession, root: str, sources: Iterable[str] | None) -> list[str]:
    """Folders to list: the root, or those of its sources that exist."""
    wanted = [root] if sources is None else [f"{root}/{name}" for s in sorted(set(sources)) for name in (s, f"source={s}")]
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    return [p for p in wanted if hadoop(p).getFileSystem(conf).exists(hadoop(p))]


def land(rows: DataFrame, root: str) -> None:
    """Write rows with source, day and unit; a unit that is collected again on a day replaces what that day had.

    Rows of a unit lie together, in several files where they are many.
    """
    rows.hint("rebalance", "source", "day", "unit").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day", "unit").json(root)


def manifest(spark: SparkSession, root: str, sources: Iterable[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """(source, day, unit, path, bytes) of every file below ``root``; no file is opened.

    Folders of other ``sources`` are not listed. ``since`` and ``until`` are the first and the last day. A root that is
    missing has no files, and files elsewhere than in the layouts do not count.
    """
    roots = _roots(spark, root, sources)
    schema = "source string, day string, unit string, path string, bytes long"
    if not roots:
        return spark.createDataFrame([], schema)
    # Without its content a binary file is a row of the list.
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _FILES).load(roots)
    files = found.select(*_parts(F.col("path")), "path", F.col("length").alias("bytes")).filter("source <> ''")
    if since is not None:
        files = files.filter(F.col("day") >= since)
    return files.filter(F.col("day") <= until) if until is not None else files


def newest(files: DataFrame) -> DataFrame:
    """Of a manifest the files of the newest day of every unit."""
    last = files.groupBy("source", "unit").agg(F.max("day").alias("day"))
    return files.join(last, ["source", "unit", "day"], "left_semi")


def _paths(files: DataFrame) -> list[str]:
    """Paths of chosen files. This list is what Spark's own reader keeps of a table: a name for each file, no row."""
    return [r["path"] for r in files.select("path").distinct().toLocalIterator()]


def read_files(spark: SparkSession, files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the files of a manifest, with _source, day, unit and pos, which orders the rows of a file.

    Only these files are opened, and of them only what the plan asks for is parsed. A file that vanishes is skipped.
    """
    from leadloom.sources.files import file_place

    paths = _paths(files)
    names = [x.alias(n) for x, n in zip(_parts(_decoded(F.col("_metadata.file_path"))), ("_source", "day", "unit"), strict=True)]
    if not paths:
        empty = T.StructType([*schema.fields, *(T.StructField(n, T.StringType()) for n in ("_source", "day", "unit")), T.StructField("pos", T.LongType())])
        return spark.createDataFrame([], empty)
    rows = spark.read.schema(schema).option("ignoreMissingFiles", True).json(paths)
    return rows.select("*", *names, file_place().alias("pos"))


def read_snapshots(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    sources: Iterable[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    newest_only: bool = False,
) -> DataFrame:
    """Rows of raw snapshots with _source, day, unit and pos.

    What is not wanted is not opened: other ``sources``, days before ``since`` or after ``until``, and, with
    ``newest_only``, all but the newest file of every unit. Filters on the result do not choose files; these arguments do.
    """
    files = manifest(spark, root, sources, since, until)
    return read_files(spark, newest(files) if newest_only else files, schema)


def uncollected_units(plan: DataFrame, files: DataFrame, day: str | None = None) -> DataFrame:
    """Units of a plan (source, unit, …) without a file in the manifest, or without one of ``day`` for daily feeds."""
    from leadloom.sources.files import uncollected

    return uncollected(plan, files, day)
