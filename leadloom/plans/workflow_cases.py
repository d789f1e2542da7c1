"""Queries over lists, logs, drafts and marks of a campaign's workflow, and over streams, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators import outreach, report
from leadloom.plans.lead_cases import _SCORED, scored_leads
from leadloom.plans.outreach_cases import _PLANNED, NOW, draft_rows
from leadloom.plans.outreach_cases import _plan as planned
from leadloom.plans.source_cases import flat, obj, say, text
from leadloom.plans.storage import shared_dir
from leadloom.sources import files, quality
from leadloom.streaming import feeds

_EVIDENCE = "array<struct<fact:string,source:string>>"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- lists, logs and reports -----------------------------------------------------------------------------------------


def imported_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with semicolons and headers of its own, written and imported."""
    path = shared_dir(spark, "list")
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        F.when(k % 5 != 0, say("Firm {}", k)).alias("Company Name"), F.when(k % 10 != 5, say("a{}.org, b{}.org", k, k)).alias("Website"), text((k % 50) / 10).alias("Stars"), text(k % 100).alias("Reviews_Count"), F.lit("x@y.org | z@y.org").alias("E-mail"), say("odd {}", k).alias("Odd_col"), F.lit("@firm").alias("Instagram")
    )
    rows.write.option("header", True).option("sep", ";").csv(path)
    got = files.stamped(files.map_aliases(files.read_list(spark, path), segment="dent"), "list", "2024-01-01")
    return got.select("name", flat("sites").alias("sites"), flat("emails").alias("emails"), "rating", "reviews", F.col("extra")["odd col"].alias("odd"), flat(F.col("socials")["instagram"]).alias("instagram"), "segment", "source", "collected")


def joined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources in one table; what one lacks is null there."""
    a = _table(spark, sf_dir, "customer").select(F.lit("a").alias("source"), text(F.col("c_custkey")).alias("source_id"), F.col("c_mktsegment").alias("segment"))
    b = _table(spark, sf_dir, "supplier").select(F.lit("b").alias("source"), text(F.col("s_suppkey")).alias("source_id"), F.col("s_acctbal").alias("balance"))
    catalogue = spark.createDataFrame([("a", "businesses"), ("b", "businesses"), ("c", "demand")], "source string, kind string")
    return files.of_kind(files.union_sources([a, b]), catalogue, "businesses")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two runs appended to, read as lines."""
    path = shared_dir(spark, "log")
    for day in ("2024-01-01", "2024-01-02"):
        files.append_log(_table(spark, sf_dir, "supplier").select(F.lit(day).alias("day"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return files.read_lines(spark, path, "day string, id long, name string")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a report, written and read back."""
    path = shared_dir(spark, "report")
    o = _table(spark, sf_dir, "orders")
    files.write_report({"status": o.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")), "priority": o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))}, path)
    return files.union_sources([files.read_lines(spark, f"{path}/{t}", "name string, n long").withColumn("table", F.lit(t)) for t in ("status", "priority")])


def imported_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as JSON lines, some without step and channel."""
    path = shared_dir(spark, "drafts") + ".jsonl"
    k = F.col("c_custkey")
    _table(spark, sf_dir, "customer").select(text(k).alias("lead_id"), F.when(k % 2 == 0, (k % 3).cast("int")).alias("step"), F.when(k % 3 == 0, F.lit("telegram")).alias("channel"), say("Hi {}", k).alias("body"), F.array(obj(fact=say("f{}", k), source="s")).alias("evidence")).write.json(path)
    return files.read_drafts(spark, path).select("lead_id", "step", "channel", "body", F.col("evidence")[0]["fact"].alias("fact"))


def imported_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a suppression list with comments, and those that a second list adds."""
    path = shared_dir(spark, "suppressions")
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, say("@Site{}.org  # left", F.floor(k / 8))).when(k % 4 == 1, say("Ann@Mail{}.org", k % 40)).when(k % 4 == 2, say("+7 (900) {}", F.lpad(text(k), 7, "0"))).otherwise("# nothing")
    _table(spark, sf_dir, "customer").select(line.alias("value")).coalesce(1).write.text(path)
    have = files.read_suppressions(spark, path)
    more = outreach.add_suppressions(have, _table(spark, sf_dir, "supplier").select(say("site{}.org", F.col("s_suppkey") * 10).alias("value")), "asked", "2024-01-02")
    return have.withColumns({"reason": F.lit("list"), "date": F.lit("2024-01-01")}).unionByName(more)


def collection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What collection runs were worth: a source stops at a block, or at a second change of layout in a row."""
    k = F.col("o_orderkey")
    outcome = F.when(k % 97 == 96, "blocked").when((k % 31 == 30) | (k % 62 == 1), "layout_changed").when(k % 7 == 6, "failed").otherwise("ok")
    status = _table(spark, sf_dir, "orders").select(say("s{}", k % 40).alias("source"), text(k).alias("unit"), k.alias("pos"), outcome.alias("outcome"), (k % 9).alias("rows"))
    return quality.collect_report(status)


# --- marks -----------------------------------------------------------------------------------------------------------


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id").cast("long")
    return scored_leads(spark, sf_dir).withColumns({
        "status": F.when(k % 31 == 0, "replied").when(k % 3 != 0, "new"), "domain": F.when(F.col("website").isNotNull(), say("site{}.org", k)), "notes": F.when(k % 4 == 0, F.lit("old note")),
        "dns": F.struct(F.when(k % 5 == 0, F.lit("2024-01-01")).alias("checked")), "hunter": F.struct(F.when(k % 7 == 0, F.lit("2024-01-01")).alias("checked")),
    })


def campaign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by tier, by status and by enrichment step."""
    return report.campaign_status(_marked(spark, sf_dir))


def drafted_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by status once those with drafts are marked."""
    return report.counts_of(outreach.mark_drafted(_marked(spark, sf_dir), draft_rows(spark, sf_dir)), "status")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").filter("c_custkey % 6 = 0").select(text(k).alias("id"), F.when(k % 12 == 0, "suppressed").otherwise("won").alias("new_status"), F.when(k % 18 == 0, say("asked {}", k)).alias("note"))


def marked_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with new statuses and notes."""
    out, _ = outreach.mark_status(_marked(spark, sf_dir), _updates(spark, sf_dir))
    return out.select("id", "status", "notes")


def marked_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that newly suppressed leads add to the list: their domain, else their addresses and phones."""
    return outreach.mark_status(_marked(spark, sf_dir), _updates(spark, sf_dir))[1]


def waiting_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previewed batches that may still be approved."""
    k = F.col("o_orderkey")
    batches = _table(spark, sf_dir, "orders").select(text(k).alias("batch"), (F.lit(NOW) - F.make_dt_interval(hours=(k % 50).cast("int"))).alias("created"), F.when(k % 3 == 0, F.lit(NOW)).alias("approved"))
    return outreach.open_batches(batches, NOW).select("batch")


def batch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of approved batches against what is ready now; every other item's content has changed."""
    plan = planned(spark, sf_dir)
    items = plan.select(F.col("id").alias("draft_id"), "lead_id", "step", F.col("recipient").alias("to"), F.when(F.length("id") % 2 == 0, F.col("hash")).otherwise("x").alias("hash"))
    return outreach.reconcile(items, plan)


def draft_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts after new ones were added, some of which replace others and some of which were sent."""
    k = F.col("c_custkey")
    base = _table(spark, sf_dir, "customer")
    draft = lambda body: [text(k).alias("lead_id"), F.lit(1).alias("step"), F.lit("email").alias("channel"), F.lit(None).cast("string").alias("to"), F.lit("Hi").alias("subject"), body.alias("body"), F.array(obj(fact="f", source="s")).cast(_EVIDENCE).alias("evidence")]
    old = base.filter("c_custkey % 2 = 0").select(say("{}:1:email", k).alias("id"), *draft(say("old {}", k)), F.when(k % 4 == 0, "sent").otherwise("draft").alias("status"), F.lit("2024-01-01").alias("created"), F.lit("2024-01-01").alias("updated"))
    new = base.filter("c_custkey % 3 = 0").select(*draft(say("new {}", k)))
    out, _ = outreach.upsert_drafts(old, new, base.select(text(k).alias("id")), "2024-02-02")
    return out.select("id", "body", "status", "created", "updated")


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return feeds.new_files(spark, sf_dir, _table(spark, sf_dir, name).schema, "parquet", f"{name}*.parquet")


def _appended(rows: DataFrame, path: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", shared_dir(rows.sparkSession, "stream-checkpoint")).trigger(availableNow=True).start()


def _sent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    return e.select(F.concat_ws("-", "event_type", text(F.col("user_id"))).alias("draft_id"), say("ann@mail{}.org", F.col("user_id") % 20).alias("to"), F.col("ts").cast("timestamp").alias("sent_at"))


def stream_sent_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of sent mail, each draft once."""
    path = shared_dir(spark, "sent-once")
    once = feeds.sent_once(_sent_log(spark, sf_dir), "60 days")
    _appended(once, path).awaitTermination()
    return spark.read.schema(once.schema).parquet(path).select("draft_id", "to")


def stream_sent_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of sent mail: mail by day and domain, of the days that the watermark has passed."""
    path = shared_dir(spark, "sent-days")
    days = feeds.sent_per_day(_sent_log(spark, sf_dir))
    _appended(days, path).awaitTermination()
    return spark.read.schema(days.schema).parquet(path)


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that runs on the leads of a stream that lack it."""
    sink = shared_dir(spark, "enriched")
    leads = _stream(spark, sf_dir, "customer")
    feeds.enrich_new(leads, F.col("c_acctbal") > 0, lambda d: d.select("c_custkey", F.upper("c_name").alias("name")), sink, shared_dir(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(sink).select("c_custkey", "name")


QUERIES = {
    f.__name__: f
    for f in (imported_list, joined_sources, log_lines, written_report, imported_drafts, imported_suppressions, collection_quality, campaign_status, drafted_statuses, marked_leads, marked_suppressions, waiting_batches, batch_verdicts, draft_upserts, stream_sent_once, stream_sent_per_day, stream_enriched)
}

_MARKED = f"""{_SCORED}, marked AS (SELECT *, CASE WHEN k % 31 = 0 THEN 'replied' WHEN k % 3 <> 0 THEN 'new' END AS status, CASE WHEN k % 3 <> 0 THEN 'site' || k || '.org' END AS domain, CASE WHEN k % 4 = 0 THEN 'old note' END AS notes FROM tiered)"""
_SENT = "SELECT event_type || '-' || user_id AS draft_id, 'ann@mail' || (user_id % 20) || '.org' AS \"to\", 'mail' || (user_id % 20) || '.org' AS domain, ts FROM events"

ORACLES = {
    "imported_list": """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 5)
SELECT CASE WHEN k % 5 <> 0 THEN 'Firm ' || k END AS name, 'a' || k || '.org,b' || k || '.org' AS sites, 'x@y.org,z@y.org' AS emails, (k % 50) / 10 AS rating, k % 100 AS reviews, 'odd ' || k AS odd, '@firm' AS instagram, 'dent' AS segment, 'list' AS source, '2024-01-01' AS collected FROM c""",
    "joined_sources": """SELECT 'a' AS source, CAST(c_custkey AS VARCHAR) AS source_id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT 'b', CAST(s_suppkey AS VARCHAR), NULL, s_acctbal FROM supplier""",
    "log_lines": "SELECT unnest(['2024-01-01', '2024-01-02']) AS day, s_suppkey AS id, s_name AS name FROM supplier",
    "written_report": "SELECT o_orderstatus AS name, count(*) AS n, 'status' AS \"table\" FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), 'priority' FROM orders GROUP BY 1",
    "imported_drafts": """SELECT CAST(c_custkey AS VARCHAR) AS lead_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 3 AS INTEGER) ELSE 1 END AS step, CASE WHEN c_custkey % 3 = 0 THEN 'telegram' ELSE 'email' END AS channel, 'Hi ' || c_custkey AS body, 'f' || c_custkey AS fact FROM customer""",
    "imported_suppressions": """WITH e AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'site' || (c_custkey // 8) || '.org' WHEN 1 THEN 'ann@mail' || (c_custkey % 40) || '.org' ELSE '7900' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS entry FROM customer WHERE c_custkey % 4 <> 3)
SELECT entry, 'list' AS reason, '2024-01-01' AS date FROM e UNION ALL SELECT 'site' || (s_suppkey * 10) || '.org', 'asked', '2024-01-02' FROM supplier WHERE 'site' || (s_suppkey * 10) || '.org' NOT IN (SELECT entry FROM e)""",
    "collection_quality": """WITH s AS (SELECT 's' || (o_orderkey % 40) AS source, o_orderkey AS pos, o_orderkey % 9 AS n, CASE WHEN o_orderkey % 97 = 96 THEN 'blocked' WHEN o_orderkey % 31 = 30 OR o_orderkey % 62 = 1 THEN 'layout_changed' WHEN o_orderkey % 7 = 6 THEN 'failed' ELSE 'ok' END AS outcome FROM orders),
t AS (SELECT *, max(CASE WHEN outcome = 'ok' THEN pos END) OVER w AS good, max(CASE WHEN outcome = 'layout_changed' THEN pos END) OVER w AS changed FROM s WINDOW w AS (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT source, min(pos) AS stop FROM t WHERE outcome = 'blocked' OR (outcome = 'layout_changed' AND changed IS NOT NULL AND changed > coalesce(good, -1)) GROUP BY 1)
SELECT source, count_if(outcome = 'ok') AS units, CAST(coalesce(sum(n) FILTER (outcome = 'ok'), 0) AS BIGINT) AS rows, count_if(outcome IN ('failed', 'layout_changed')) AS failed, count_if(outcome = 'layout_changed') AS layout_changed, bool_or(outcome = 'blocked') AS blocked
FROM s LEFT JOIN b USING (source) WHERE stop IS NULL OR pos <= stop GROUP BY 1""",
    "campaign_status": f"""WITH {_MARKED} SELECT 'tier' AS kind, tier AS name, count(*) AS leads FROM marked GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, '(none)'), count(*) FROM marked GROUP BY 2
UNION ALL SELECT 'step', 'site', count_if(k % 4 <> 1) FROM marked UNION ALL SELECT 'step', 'dns', count_if(k % 5 = 0) FROM marked UNION ALL SELECT 'step', 'hunter', count_if(k % 7 = 0) FROM marked""",
    "drafted_statuses": f"""WITH {_MARKED}, d AS (SELECT DISTINCT conv_id % 1600 + 1 AS lead FROM conversations) SELECT CASE WHEN coalesce(status, 'new') = 'new' AND k IN (SELECT lead FROM d) THEN 'drafted' ELSE status END AS status, count(*) AS n FROM marked GROUP BY 1""",
    "marked_leads": f"""WITH {_MARKED} SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 12 = 0 THEN 'suppressed' WHEN k % 6 = 0 THEN 'won' ELSE status END AS status, CASE WHEN k % 18 = 0 THEN concat_ws(chr(10), notes, 'asked ' || k) ELSE notes END AS notes FROM marked""",
    "marked_suppressions": f"""WITH {_MARKED} SELECT DISTINCT unnest(CASE WHEN domain IS NOT NULL THEN [domain] ELSE list_filter([CASE WHEN k % 6 <> 0 THEN 'info@site' || k || '.org' END, CASE WHEN k % 2 = 0 THEN '7900' || lpad(CAST(k AS VARCHAR), 7, '0') END], lambda x: x IS NOT NULL) END) AS entry FROM marked WHERE k % 12 = 0""",
    "waiting_batches": "SELECT CAST(o_orderkey AS VARCHAR) AS batch FROM orders WHERE o_orderkey % 50 < 24 AND o_orderkey % 3 <> 0",
    "batch_verdicts": _PLANNED + " SELECT id AS draft_id, CASE WHEN NOT ready THEN 'approved but ' || reason WHEN length(id) % 2 = 1 THEN 'changed since the preview; re-preview' ELSE 'ok' END AS verdict FROM plan",
    "draft_upserts": """WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS was, c_custkey % 4 = 0 AS sent, c_custkey % 3 = 0 AS fresh FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT k || ':1:email' AS id, CASE WHEN fresh AND NOT sent THEN 'new ' ELSE 'old ' END || k AS body, CASE WHEN sent THEN 'sent' ELSE 'draft' END AS status, CASE WHEN was THEN '2024-01-01' ELSE '2024-02-02' END AS created, CASE WHEN fresh AND NOT sent THEN '2024-02-02' ELSE '2024-01-01' END AS updated FROM c""",
    "stream_sent_once": f'SELECT DISTINCT draft_id, "to" FROM ({_SENT})',
    "stream_sent_per_day": f"""WITH s AS ({_SENT}) SELECT CAST(ts AS DATE) AS day, domain, count(*) AS sent FROM s WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM s) - INTERVAL 1 DAY GROUP BY 1, 2""",
    "stream_enriched": "SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal > 0",
}
