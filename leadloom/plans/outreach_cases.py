"""Outreach queries over the given tables, with the SQL that they equal: turns of conversations stand for drafts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import outreach, report
from leadloom.plans.lead_cases import _SCORED, scored_leads

NOW = datetime.datetime(2024, 3, 10, 12, 0, 0)
CONFIG = outreach.SendConfig(min_tier="B", daily_cap=60, per_domain_cap=4, followup_days=3.0)
SUPPRESSED = ["@mail3.org  # left", "Ann@Mail5.org", "site40.org", "79000000006", "# nothing"]


def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft for each turn of a conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn = F.col("conv_id"), F.col("turn")
    k = conv * 7 + turn
    return c.select(
        F.concat(conv.cast("string"), F.lit(":"), turn.cast("string")).alias("id"),
        (conv % 1600 + 1).cast("string").alias("lead_id"),
        (turn % 3 + 1).cast("int").alias("step"),
        F.when(k % 5 == 4, "telegram").otherwise("email").alias("channel"),
        F.when(k % 3 == 0, F.concat(F.lit("Ann@Mail"), (conv % 20).cast("string"), F.lit(".org"))).alias("to"),
        F.concat(F.lit("Hello "), conv.cast("string")).alias("subject"),
        F.col("text").alias("body"),
        F.when(k % 4 != 0, F.array(F.struct(F.lit("fact").alias("fact"), F.when(k % 7 != 0, "page").alias("source")))).alias("evidence"),
        F.when(conv % 17 == 0, "sent").otherwise("draft").alias("status"),
        F.lit("2024-03-01").alias("created"),
        F.lit("2024-03-01").alias("updated"),
    )


def sent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each turn of a conversation: first turns of some as mail of the last days, all others as mail of old campaigns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, late = F.col("conv_id"), F.expr("conv_id % 4 = 0 and turn = 0")
    return c.select(
        F.when(late, F.concat(conv.cast("string"), F.lit(":0"))).otherwise(F.concat_ws(":", F.lit("old"), "conv_id", "turn")).alias("draft_id"),
        F.when(late, (conv % 1600 + 1).cast("string")).otherwise("-1").alias("lead_id"),
        F.lit(1).alias("step"),
        F.concat(F.lit("ann@mail"), (conv % 20).cast("string"), F.lit(".org")).alias("to"),
        (F.lit(NOW) - F.make_dt_interval(days=F.when(late, conv % 9).otherwise(400).cast("int"))).alias("sent_at"),
    )


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = outreach.suppression_list(spark.createDataFrame([(x,) for x in SUPPRESSED], "value string"))
    leads = scored_leads(spark, sf_dir).withColumns({"status": F.when(F.col("id").cast("long") % 31 == 0, "replied").otherwise("new"), "domain": F.when(F.col("website").isNotNull(), F.concat(F.lit("site"), "id", F.lit(".org")))})
    return outreach.send_plan(draft_rows(spark, sf_dir), leads, sent_rows(spark, sf_dir), entries, CONFIG, NOW)


def send_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that go out now and drafts that wait."""
    return _plan(spark, sf_dir).select("id", "lead_id", "step", "recipient", "ready", "reason")


def send_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting drafts by reason."""
    return outreach.skip_reasons(_plan(spark, sf_dir))


def draft_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that drafts break."""
    return outreach.violations(draft_rows(spark, sf_dir), scored_leads(spark, sf_dir))


def draft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts by status."""
    return report.counts_of(draft_rows(spark, sf_dir), "status")


def sent_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail of a day by domain."""
    return report.sent_on(sent_rows(spark, sf_dir), NOW.date())


def sent_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by status once the log of sent mail is applied."""
    leads = scored_leads(spark, sf_dir).withColumn("status", F.when(F.col("id").cast("long") % 31 == 0, "replied").otherwise("new"))
    _, leads = outreach.apply_sent(draft_rows(spark, sf_dir), leads, sent_rows(spark, sf_dir))
    return report.counts_of(leads, "status")


QUERIES = {f.__name__: f for f in (send_plan, send_skip_reasons, draft_violations, draft_counts, sent_today, sent_statuses)}

_DRAFTS = """drafts AS (
  SELECT conv_id || ':' || turn AS id, CAST(conv_id % 1600 + 1 AS VARCHAR) AS lead_id, conv_id % 1600 + 1 AS lead, CAST(turn % 3 + 1 AS INTEGER) AS step, CASE WHEN (conv_id * 7 + turn) % 5 = 4 THEN 'telegram' ELSE 'email' END AS channel,
    CASE WHEN (conv_id * 7 + turn) % 3 = 0 THEN 'ann@mail' || (conv_id % 20) || '.org' END AS "to", text AS body, (conv_id * 7 + turn) AS e, CASE WHEN conv_id % 17 = 0 THEN 'sent' ELSE 'draft' END AS status, conv_id, turn
  FROM conversations
), sent AS (
  SELECT CASE WHEN late THEN conv_id || ':0' ELSE 'old:' || conv_id || ':' || turn END AS draft_id, CASE WHEN late THEN conv_id % 1600 + 1 ELSE -1 END AS lead, 1 AS step, 'mail' || (conv_id % 20) || '.org' AS domain,
    TIMESTAMP '2024-03-10 12:00:00' - to_days(CAST(CASE WHEN late THEN conv_id % 9 ELSE 400 END AS INTEGER)) AS sent_at FROM (SELECT *, conv_id % 4 = 0 AND turn = 0 AS late FROM conversations)
)"""
_PLANNED = f"""WITH {_SCORED}, {_DRAFTS}, before AS (SELECT lead, step + 1 AS step, max(sent_at) AS previous FROM sent GROUP BY 1, 2), base AS (
  SELECT d.*, t.k, t.tier, t.score, coalesce(d."to", CASE WHEN t.k % 6 <> 0 THEN 'info@site' || t.k || '.org' END) AS recipient, previous, d.id IN (SELECT draft_id FROM sent) AS gone
  FROM drafts d LEFT JOIN tiered t ON t.k = d.lead LEFT JOIN before b ON b.lead = d.lead AND b.step = d.step
), reasoned AS (
  SELECT *, split_part(recipient, '@', 2) AS domain, CASE WHEN channel <> 'email' THEN channel || ' is draft-only' WHEN status <> 'draft' THEN 'status ' || status WHEN gone THEN 'already sent' WHEN k IS NULL THEN 'unknown lead'
    WHEN k % 31 = 0 THEN 'lead status replied' WHEN tier NOT IN ('A', 'B') THEN 'tier ' || tier || ' below B' WHEN recipient IS NULL THEN 'no email address'
    WHEN split_part(recipient, '@', 2) = 'mail3.org' OR recipient = 'ann@mail5.org' OR split_part(recipient, '@', 2) = 'site40.org' OR (k = 40) OR (k % 2 = 0 AND k = 6) THEN 'suppressed'
    WHEN step > 1 AND previous IS NULL THEN 'step ' || (step - 1) || ' not sent yet' WHEN step > 1 AND TIMESTAMP '2024-03-10 12:00:00' < previous + INTERVAL 3 DAY THEN 'follow-up due ' || CAST(CAST(previous + INTERVAL 3 DAY AS DATE) AS VARCHAR) END AS why FROM base
), today AS (SELECT domain, count(*) AS today FROM sent WHERE CAST(sent_at AS DATE) = DATE '2024-03-10' GROUP BY 1
), able AS (
  SELECT r.*, coalesce(today, 0) AS today, row_number() OVER (PARTITION BY r.domain ORDER BY step, tier, -score, id) AS place FROM reasoned r LEFT JOIN today USING (domain) WHERE why IS NULL
), passing AS (SELECT *, row_number() OVER (ORDER BY step, tier, -score, id) AS g FROM able WHERE place + today <= 4
), ready AS (SELECT * FROM passing WHERE g <= greatest(0, 60 - (SELECT coalesce(sum(today), 0) FROM today))
), plan AS (
  SELECT id, lead_id, step, recipient, id IN (SELECT id FROM ready) AS ready,
    CASE WHEN id IN (SELECT id FROM ready) THEN NULL WHEN id NOT IN (SELECT id FROM passing) AND (SELECT count(*) FROM ready WHERE ready.domain = able.domain) + today >= 4 THEN 'per_domain_cap reached for ' || domain ELSE 'daily_cap reached' END AS reason FROM able
  UNION ALL SELECT id, lead_id, step, recipient, false, why FROM reasoned WHERE why IS NOT NULL AND channel = 'email' AND status = 'draft'
)"""

ORACLES = {
    "send_plan": _PLANNED + " SELECT * FROM plan",
    "send_skip_reasons": _PLANNED + " SELECT reason, count(*) AS drafts FROM plan WHERE NOT ready GROUP BY 1",
    "draft_violations": f"""WITH {_DRAFTS}, p AS (SELECT id, unnest([CASE WHEN lead > (SELECT max(c_custkey) FROM customer) THEN 'unknown lead_id' END, CASE WHEN body IS NULL OR body = '' THEN 'no body' END,
  CASE WHEN e % 4 = 0 THEN 'no evidence' WHEN e % 7 = 0 THEN 'evidence without fact or source' END]) AS problem FROM drafts) SELECT * FROM p WHERE problem IS NOT NULL""",
    "draft_counts": f"WITH {_DRAFTS} SELECT status, count(*) AS n FROM drafts GROUP BY 1",
    "sent_today": f"WITH {_DRAFTS} SELECT domain, count(*) AS sent FROM sent WHERE CAST(sent_at AS DATE) = DATE '2024-03-10' GROUP BY 1",
    "sent_statuses": f"""WITH {_DRAFTS} SELECT CASE WHEN c_custkey % 31 = 0 THEN 'replied' WHEN c_custkey IN (SELECT lead FROM sent) THEN 'sent' ELSE 'new' END AS status, count(*) AS n FROM customer GROUP BY 1""",
}
