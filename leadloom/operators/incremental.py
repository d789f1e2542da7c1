"""Entity resolution that grows: new records join the stored components that their keys meet, and only those are folded.

Three tables lie in buckets, each bucket in versions: ``keys`` (key, component) by key, ``records`` (fragments with their
component) and ``leads`` by component. A component is named by its least record. An increment looks its keys up in their
buckets, contracts the graph of new records and met components alone, and writes anew only the buckets that hold a
component which grew or merged; of the others no file is opened. Any split of the records into increments gives what one
run over all of them gives. An increment that runs again, with its number, writes the same versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.resolve import fold_groups, match_keys, normalize_businesses
from leadloom.plans.components import connected_components
from leadloom.plans.storage import materialise
from leadloom.streaming.feeds import current_rows, write_version

#: Buckets of each table, for good.
BUCKETS = 64


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _touched(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """Buckets that values fall in; there are at most ``buckets``."""
    return sorted(r[0] for r in rows.select(_bucket(column, buckets)).distinct().collect())


def _stored(spark: SparkSession, root: str, name: str, number: int, touched: list[int], schema: DataFrame) -> DataFrame:
    found = current_rows(spark, f"{root}/{name}", number, touched)
    return schema.limit(0) if found is None else found.select(*schema.columns)


def add_records(raw: DataFrame, root: str, number: int, default_cc: str | None = None, buckets: int = BUCKETS) -> None:
    """Add raw business rows to the resolution below ``root`` as increment ``number`` (ascending from 0).

    ``pos`` is unique over all increments. Records with a new key alone make components of their own.
    """
    spark = raw.sparkSession
    fresh = materialise(normalize_businesses(raw, default_cc), "fragments")
    keyed = materialise(fresh.select("pos", F.explode(match_keys()).alias("key")).distinct(), "new-keys")
    key_table = keyed.select("key", F.col("pos").cast("long").alias("component"))
    known = _stored(spark, root, "keys", number, _touched(keyed, "key", buckets), key_table)

    # New records and the components that they meet, which stand for all their records.
    met = materialise(keyed.join(known, "key").select("pos", F.col("component").cast("long").alias("old")).distinct(), "met-components")
    first = keyed.groupBy("key").agg(F.min("pos").alias("first"))
    links = keyed.join(first, "key").filter("pos <> first").select(F.col("pos").cast("long").alias("a"), F.col("first").cast("long").alias("b"))
    found = materialise(connected_components(links.unionByName(met.select(F.col("pos").cast("long").alias("a"), F.col("old").alias("b")))), "grown-components")
    labels = fresh.select("pos").join(found.withColumnRenamed("node", "pos"), "pos", "left").select("pos", F.coalesce("component", F.col("pos").cast("long")).alias("component"))
    labels = materialise(labels, "new-labels")
    moved = materialise(met.select("old").distinct().join(found.withColumnRenamed("node", "old"), "old").select("old", F.col("component").alias("new")), "moved-components")
    grown = labels.select("component").distinct()

    every = moved.select(F.col("old").alias("component")).unionByName(grown)
    touched = _touched(every, "component", buckets)
    record_table = fresh.join(labels, "pos")
    stored = _stored(spark, root, "records", number, touched, record_table)
    relabelled = stored.withColumnRenamed("component", "old").join(F.broadcast(moved) if moved.count() <= 100_000 else moved, "old", "left")
    relabelled = relabelled.withColumn("component", F.coalesce("new", "old"))
    records = materialise(relabelled.select(*record_table.columns).unionByName(record_table), "records")

    # Keys of components that have a new name, and of new records.
    renamed = relabelled.filter("new <> old").select(F.explode(match_keys()).alias("key"), "component")
    changed = renamed.unionByName(keyed.join(labels, "pos").select("key", "component")).groupBy("key").agg(F.min("component").alias("component"))
    changed = materialise(changed, "changed-keys")
    before = _stored(spark, root, "keys", number, _touched(changed, "key", buckets), key_table)
    keys = before.join(changed.select("key"), "key", "left_anti").unionByName(changed)

    folded = fold_groups(*_of(records, grown), keep=True)
    old_leads = _stored(spark, root, "leads", number, touched, folded)
    leads = old_leads.join(every.distinct(), "component", "left_anti").unionByName(folded)
    for name, rows, column in (("leads", leads, "component"), ("records", records, "component"), ("keys", keys, "key")):
        write_version(rows.withColumn("bucket", _bucket(column, buckets)), f"{root}/{name}", number)


def _of(records: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments and labels of the records of some components."""
    own = records.join(components, "component", "left_semi")
    return own.drop("component"), own.select("pos", "component")


def resolved_leads(spark: SparkSession, root: str) -> DataFrame | None:
    """Leads as resolved so far, with the columns of ``resolve``; None before the first increment."""
    found = current_rows(spark, f"{root}/leads")
    return None if found is None else found.drop("component", "bucket")
