"""Reports about what was collected and where a campaign stands."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import norm


def is_empty(c: str, kind: str) -> Column:
    """Null, and for texts, lists and maps also nothing in them; zero and false count as filled."""
    if kind == "string":
        return ~norm.truthy_text(F.col(c))
    if kind.startswith("array"):
        return F.coalesce(F.size(F.array_compact(c)) <= 0, F.lit(True))
    if kind.startswith("map"):
        return F.coalesce(F.size(c) <= 0, F.lit(True))
    return F.col(c).isNull()


def fill_rates(raw: DataFrame, fields: list[str]) -> DataFrame:
    """(source, n_rows, duplicate_ids, field, fill_pct): how much of each field a source fills, in one aggregation."""
    kinds = dict(raw.dtypes)
    one = raw.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count_distinct("source_id")).alias("duplicate_ids"),
        *[F.round(100 * F.avg((~is_empty(f, kinds[f])).cast("int")), 1).alias(f) for f in fields],
    )
    return one.unpivot(["source", "n_rows", "duplicate_ids"], fields, "field", "fill_pct")


def campaign_status(leads: DataFrame) -> DataFrame:
    """(kind, name, leads): leads by tier, by status, and by enrichment step that has run."""
    has = set(leads.columns)
    parts = []
    for c in ("tier", "status"):
        if c in has:
            parts.append(F.array(F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("(none)")).alias("name"))))
    steps = [F.when(norm.truthy_text(F.col(f"{s}.checked").cast("string")), F.struct(F.lit("step").alias("kind"), F.lit(s).alias("name"))) for s in ("site", "dns", "jobs", "registry", "hunter") if s in has]
    if steps:
        parts.append(F.array_compact(F.array(*steps)))
    found = leads.select(F.explode(F.concat(*parts)).alias("x"))
    return found.groupBy("x.kind", "x.name").agg(F.count("*").alias("leads"))


def raw_status(raw: DataFrame) -> DataFrame:
    """Rows and last day of each source."""
    return raw.groupBy("source").agg(F.count("*").alias("n_rows"), F.max("collected").alias("last_day"))


def sent_on(log: DataFrame, day: datetime.date) -> DataFrame:
    """Mail of a day by the recipient's domain."""
    today = log.filter(F.to_date("sent_at") == F.lit(day))
    return today.groupBy(F.substring_index("to", "@", -1).alias("domain")).agg(F.count("*").alias("sent"))


def counts_of(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value of a column, most first (drafts by status, skipped drafts by reason)."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
