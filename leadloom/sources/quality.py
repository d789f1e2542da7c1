"""What a collection run was worth: units, rows and failures of each source, and where a source had to stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accepted_units(status: DataFrame) -> DataFrame:
    """Unit statuses (source, unit, pos, outcome, rows) up to where each source stops, that unit included.

    A source stops at the second layout change without a success between the two, and at a block. Other failures
    neither add to the streak nor end it.
    """
    by_unit = Window.partitionBy("source").orderBy("pos")
    told = F.when(F.col("outcome").isin("ok", "layout_changed"), F.col("outcome"))
    before = F.last(told, ignorenulls=True).over(by_unit.rowsBetween(Window.unboundedPreceding, -1))
    stops = (F.col("outcome") == "blocked") | ((F.col("outcome") == "layout_changed") & before.eqNullSafe("layout_changed"))
    marked = status.withColumn("_stop", stops.cast("int"))
    earlier = F.coalesce(F.sum("_stop").over(by_unit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_earlier", earlier).filter("_earlier = 0").drop("_stop", "_earlier")


def collect_report(status: DataFrame) -> DataFrame:
    """(source, units, rows, failed, layout_changed, blocked) over the units that were reached."""
    return accepted_units(status).groupBy("source").agg(
        F.count_if(F.col("outcome") == "ok").alias("units"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "ok", F.col("rows"))), F.lit(0)).alias("rows"),
        F.count_if(F.col("outcome").isin("failed", "layout_changed")).alias("failed"),
        F.count_if(F.col("outcome") == "layout_changed").alias("layout_changed"),
        F.bool_or(F.col("outcome") == "blocked").alias("blocked"),
    )
