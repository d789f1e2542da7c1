"""Drafts against the log of sent mail, both as streams: follow-ups wait for the mail before, sent drafts are told.

Two stream-stream outer joins with watermarks. A draft is kept until the log cannot hold its counterpart any more, a line
of the log until no draft can ask for it, so state is bounded by what arrives within ``horizon`` and the lateness. A match
is told as soon as both sides are there; that there is none is told once the watermark has passed the end of the wait.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLD = "id string, lead_id string, step int, created timestamp, previous timestamp, due timestamp"
SENT = "id string, created timestamp, sent_at timestamp"


def _days(n: float) -> Column:
    """A literal, which Spark needs to tell how long rows of a join must be kept."""
    return F.expr(f"interval {round(n * 86400)} seconds")


def follow_ups(drafts: DataFrame, sent: DataFrame, followup_days: float, horizon_days: float = 60, delay: str = "1 day") -> DataFrame:
    """(id, lead_id, step, created, previous, due): when drafts of a stream (id, lead_id, step, created) may go out.

    A first step is due when it is made. Step n is due ``followup_days`` after step n - 1 of its lead in the log (lead_id,
    step, sent_at), if that went out within ``horizon_days`` before or after the draft was made. Each mail of that step
    gives a row; the last one counts (``last_due``). A draft for which none came has nulls. Drafts without a time, a lead
    or a step are left out, and so are lines of the log.
    """
    made = drafts.filter("created is not null and lead_id is not null and step is not null").select("id", "lead_id", F.col("step").cast("int").alias("step"), "created")
    first = made.filter("step <= 1").select("*", F.lit(None).cast("timestamp").alias("previous"), F.col("created").alias("due"))
    later = made.filter("step > 1").withWatermark("created", delay).alias("d")
    log = sent.filter("sent_at is not null").select(F.col("lead_id").alias("to_lead"), (F.col("step") + 1).cast("int").alias("next"), "sent_at").withWatermark("sent_at", delay).alias("s")
    near = F.col("s.sent_at").between(F.col("d.created") - _days(horizon_days), F.col("d.created") + _days(horizon_days))
    joined = later.join(log, (F.col("d.lead_id") == F.col("s.to_lead")) & (F.col("d.step") == F.col("s.next")) & near, "left_outer")
    waiting = joined.select("id", "lead_id", "d.step", "created", F.col("sent_at").alias("previous"), (F.col("sent_at") + _days(followup_days)).alias("due"))
    return waiting.unionByName(first)


def sent_drafts(drafts: DataFrame, sent: DataFrame, horizon_days: float = 60, delay: str = "1 day") -> DataFrame:
    """(id, created, sent_at): drafts of a stream with the mail of the log that each became; null where none did in time."""
    made = drafts.filter("created is not null and id is not null").select("id", "created").withWatermark("created", delay).alias("d")
    log = sent.filter("sent_at is not null").select("draft_id", "sent_at").withWatermark("sent_at", delay).alias("s")
    near = F.col("s.sent_at").between(F.col("d.created"), F.col("d.created") + _days(horizon_days))
    return made.join(log, (F.col("d.id") == F.col("s.draft_id")) & near, "left_outer").select("id", "created", "sent_at")


def last_due(told: DataFrame) -> DataFrame:
    """Of what ``follow_ups`` told, a row a draft: the last mail before it counts."""
    return told.groupBy("id", "lead_id", "step", "created").agg(F.max("previous").alias("previous"), F.max("due").alias("due"))


def waiting_reasons(drafts: DataFrame, told: DataFrame, sent: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """(id, reason) of drafts at a time, from what the two streams have told so far; null where a draft may go out."""
    have = last_due(told).select("id", "previous", "due")
    gone = sent.filter("sent_at is not null").select("id").distinct().withColumn("gone", F.lit(True))
    rows = drafts.select("id", "step").join(have, "id", "left").join(gone, "id", "left")
    reason = F.coalesce(
        F.when(F.col("gone"), F.lit("already sent")),
        F.when((F.col("step") > 1) & F.col("previous").isNull(), F.concat(F.lit("step "), (F.col("step") - 1).cast("string"), F.lit(" not sent yet"))),
        F.when((F.col("step") > 1) & (F.lit(now) < F.col("due")), F.concat(F.lit("follow-up due "), F.to_date("due").cast("string"))),
    )
    return rows.select("id", reason.alias("reason"))
