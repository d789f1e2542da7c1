"""Queries over landed snapshots, replaced tables, user sources and approvals, with the SQL that they equal."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import norm
from leadloom.operators import market, outreach, report, rules
from leadloom.plans.lead_cases import _SCORED, scored_leads
from leadloom.plans.outreach_cases import draft_rows
from leadloom.plans.source_cases import say, text
from leadloom.plans.storage import shared_dir
from leadloom.sources import files, jsonl_table, snapshots, units
from leadloom.streaming import approvals, feeds, followups

_VALUES = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Events as raw snapshots: a source for each kind, a day a week, units by user."""
    root = shared_dir(spark, "snapshots")
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    rows = _events(spark, sf_dir).select("event_id", "value", F.col("event_type").alias("source"), week.alias("day"), say("u__{}", F.col("user_id") % 3).alias("unit"))
    snapshots.land(rows, root)
    return root


def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the newest file of every unit of two sources; other files are not opened."""
    found = snapshots.read_snapshots(spark, _landed(spark, sf_dir), _VALUES, sources=["view", "click", "none"], newest_only=True)
    return found.select(F.col("_source").alias("source"), "day", "unit", "event_id", "value")


def unit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all snapshots: units of each source and day."""
    return snapshots.manifest(spark, _landed(spark, sf_dir)).select("source", "day", "unit").distinct()


def units_to_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a plan of locations and queries that no snapshot of a source has, or none since a day."""
    plan = files.unit_plan(spark, "view", ["u", "far away"], ["0", "1", "2", "x/y"])
    found = snapshots.manifest(spark, _landed(spark, sf_dir), sources=["view"])
    never = snapshots.uncollected_units(plan, found).withColumn("since", F.lit("ever"))
    return never.unionByName(snapshots.uncollected_units(plan, found, "2024-01-08").withColumn("since", F.lit("2024-01-08"))).select("since", "unit", "location", "query", F.col("pos").cast("long").alias("pos"))


def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of JSON lines that was written, replaced as a whole, and added to."""
    path = shared_dir(spark, "replaced")
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    jsonl_table.write_table(rows("customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("name")), path)
    jsonl_table.write_table(rows("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name")), path)
    jsonl_table.write_table(rows("supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name")), path, append=True)
    return jsonl_table.read_table(spark, path, "id long, name string")


def imported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list to import as one JSON object with items, with headers of its own."""
    path = shared_dir(spark, "items") + ".json"
    k = F.col("s_suppkey")
    item = F.struct(k.cast("string").alias("Company Name"), say("b{}.org", k).alias("web"), (k % 9).alias("Review_Count"))
    whole = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(k.alias("k"), item.alias("item"))))["item"].alias("items"))).alias("value"))
    whole.coalesce(1).write.text(path)
    found = files.map_aliases(files.read_list(spark, path), "list")
    return found.select("name", F.get("sites", F.lit(0)).alias("site"), "reviews", "source_id")


class _EventUnits(units.LandedUnits):
    """Landed lines of events, parsed where they are read."""

    NAME, SCHEMA = "event_units", "source string, day string, unit string, event_id long, value double"

    def collect_unit(self, unit):  # noqa: ANN001, ANN201
        import json

        for source, day, name, _, line in super().collect_unit(unit):
            row = json.loads(line)
            yield source, day, name, row["event_id"], row["value"]


def _unit_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as landed files by source and day."""
    root = shared_dir(spark, "unit-files")
    day = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    _events(spark, sf_dir).select("event_id", "value", F.col("event_type").alias("source"), day.alias("day")).hint("rebalance", "source", "day").write.partitionBy("source", "day").json(root)
    return root


def user_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a user's source, filtered; units that the filter rules out are not asked for."""
    units.register(spark, _EventUnits())
    rows = spark.read.format("event_units").option("path", _unit_files(spark, sf_dir)).load()
    return rows.filter("source in ('view', 'click') and day >= '2024-01-08'").select("source", "day", "event_id", "value")


def stream_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's source as a stream that is stopped and begun again: every unit once."""
    units.register(spark, _EventUnits())
    root, log, check, out = _unit_files(spark, sf_dir), shared_dir(spark, "unit-log"), shared_dir(spark, "stream-checkpoint"), shared_dir(spark, "streamed-units")
    for _ in range(2):
        stream = spark.readStream.format("event_units").option("path", root).option("log", log).option("maxUnitsPerTrigger", 10).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("source string, day string, event_id long, value double").parquet(out)


def stream_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as previews and approvals of batches: each is approved once and in time, or lapses."""
    path = f"{sf_dir}/events.parquet"
    events = feeds.new_files(spark, sf_dir, spark.read.parquet(path).schema, "parquet", "events*.parquet")
    kind = F.when(F.col("event_type") == "view", "preview").when(F.col("event_type").isin("click", "purchase"), "approve")
    rows = events.select(text(F.col("user_id")).alias("batch"), text(F.col("event_id")).alias("event_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    out = shared_dir(spark, "approvals")
    told = approvals.approval_verdicts(rows, remembered=datetime.timedelta(days=60))
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(approvals.VERDICTS).parquet(out).filter("event_id is not null").select("batch", "event_id", "verdict")


def stream_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as streams of drafts and of sent mail: when each draft may go out, or that none came before it."""
    path = f"{sf_dir}/conversations.parquet"
    # Turns lie in no order of time: files of a later micro-batch would come behind the watermark of an earlier one.
    rows = feeds.new_files(spark, sf_dir, spark.read.parquet(path).schema, "parquet", "conversations*.parquet", most=None)
    conv, turn, step = F.col("conv_id"), F.col("turn"), (F.col("turn") + 1).cast("int").alias("step")
    day = lambda n, hours: F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(days=n.cast("int"), hours=F.lit(hours))
    drafts = rows.select(F.concat_ws(":", text(conv), text(turn)).alias("id"), text(conv).alias("lead_id"), step, day(conv % 90, 0).alias("created"))
    sent = rows.filter((conv * 7 + turn) % 3 != 0).select(text(conv).alias("lead_id"), step, day(conv % 90 + turn * 2, 6).alias("sent_at"))
    out = shared_dir(spark, "follow-ups")
    told = followups.follow_ups(drafts, sent, followup_days=3.0, horizon_days=10, delay="25 hours")
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(followups.TOLD).parquet(out).select("id", "step", F.date_format("due", "yyyy-MM-dd HH").alias("due"))


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under a thousand rules, which are met by an index of their literals: brands, sizes and kinds, and many that miss."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    texts = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", say("size {}mm", F.col("p_size"))).alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("category"), F.col("p_type").alias("product"))
    rules = [market.Rule(f"brand {i}", rf"brand#{i}\b", ("ECONOMY", "SMALL") if i % 2 else ()) for i in range(1, 301)]
    rules += [market.Rule(f"size {i}", rf"(?:of )?size {i}mm|mm{i}size") for i in range(1, 501)]
    rules += [market.Rule(f"kind {i}", rf"\bwid?get{i}s?|gear{i}") for i in range(199)] + [market.Rule("ring", r"\bring\b")]
    return market.rule_hits(texts, rules).select("p_partkey", "rule")


def listed_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting drafts for messengers, with the link that opens each, and the hash of its content."""
    drafts = outreach.drafts_where(draft_rows(spark, sf_dir), status="draft", channels=["telegram"])
    to = F.coalesce("to", say("@user{}", F.col("lead_id")))
    return drafts.select("id", norm.deep_link(F.col("channel"), to, F.col("subject"), F.col("body")).alias("link"), norm.deep_link(F.lit("whatsapp"), say("+7 900 {}", F.col("lead_id")), F.col("subject"), F.col("subject")).alias("message"), norm.content_hash(to, F.col("subject"), F.lit("text")).alias("hash"))


def paid_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that the paid contact search is asked about: a domain, and one of the two best tiers."""
    k = F.col("id").cast("long")
    return scored_leads(spark, sf_dir).withColumn("domain", F.when(k % 3 != 0, say("site{}.org", k))).filter(rules.hunter_wanted()).select("id", "domain", "tier")


def raw_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and last day of each source."""
    return report.raw_status(_events(spark, sf_dir).select(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("collected")))


QUERIES = {
    f.__name__: f
    for f in (newest_snapshots, unit_days, units_to_collect, replaced_table, imported_json, user_source, stream_units, stream_approvals, stream_follow_ups, many_rules, listed_drafts, paid_lookups, raw_status)
}

_WEEKS = "w AS (SELECT event_id, value, event_type AS source, strftime(date_trunc('week', ts), '%Y-%m-%d') AS day, 'u__' || (user_id % 3) AS unit, * FROM events)"
ORACLES = {
    "newest_snapshots": f"WITH {_WEEKS}, n AS (SELECT *, max(day) OVER (PARTITION BY source, unit) AS last FROM w WHERE source IN ('view', 'click')) SELECT source, day, unit, event_id, value FROM n WHERE day = last",
    "unit_days": f"WITH {_WEEKS} SELECT DISTINCT source, day, unit FROM w",
    "units_to_collect": f"""WITH {_WEEKS}, p AS (SELECT l.i * 4 + q.i AS pos, l.v AS location, q.v AS query, regexp_replace(l.v || '__' || q.v, '[^a-zA-Z0-9_.-]+', '_', 'g') AS unit
  FROM (SELECT unnest(['u', 'far away']) AS v, unnest([0, 1]) AS i) l, (SELECT unnest(['0', '1', '2', 'x/y']) AS v, unnest([0, 1, 2, 3]) AS i) q)
SELECT 'ever' AS since, unit, location, query, CAST(pos AS BIGINT) AS pos FROM p WHERE unit NOT IN (SELECT unit FROM w WHERE source = 'view')
UNION ALL SELECT '2024-01-08', unit, location, query, pos FROM p WHERE unit NOT IN (SELECT unit FROM w WHERE source = 'view' AND day = '2024-01-08')""",
    "replaced_table": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer UNION ALL SELECT -s_suppkey, s_name FROM supplier",
    "imported_json": "SELECT CAST(s_suppkey AS VARCHAR) AS name, 'b' || s_suppkey || '.org' AS site, s_suppkey % 9 AS reviews, 'list:' || row_number() OVER (ORDER BY s_suppkey) AS source_id FROM supplier",
    "user_source": f"WITH {_WEEKS} SELECT source, day, event_id, value FROM w WHERE source IN ('view', 'click') AND day >= '2024-01-08'",
    "stream_units": f"WITH {_WEEKS} SELECT source, day, event_id, value FROM w",
    "stream_approvals": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS batch, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS kind, ts FROM events WHERE event_type IN ('view', 'click', 'purchase')),
t AS (SELECT *, count(*) FILTER (kind = 0) OVER (PARTITION BY batch ORDER BY ts, kind, event_id) AS turn FROM e),
c AS (SELECT *, max(CASE WHEN kind = 0 THEN ts END) OVER (PARTITION BY batch, turn) AS created FROM t),
a AS (SELECT *, row_number() OVER (PARTITION BY batch, turn ORDER BY ts, event_id) AS n, ts - created <= INTERVAL 24 HOUR AS in_time FROM c WHERE kind = 1),
u AS (SELECT *, bool_or(n = 1 AND in_time) OVER (PARTITION BY batch, turn) AS used FROM a)
SELECT batch, event_id, CASE WHEN created IS NULL THEN 'no such batch' WHEN n = 1 AND in_time THEN 'approved' WHEN used THEN 'already approved' ELSE 'older than 24 h' END AS verdict FROM u""",
    "stream_follow_ups": """WITH d AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, CAST(turn + 1 AS INTEGER) AS step, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 90 AS INTEGER)) AS created FROM conversations),
s AS (SELECT conv_id, step, created + to_days(CAST(turn * 2 AS INTEGER)) + INTERVAL 6 HOUR AS sent_at FROM d WHERE (conv_id * 7 + turn) % 3 <> 0),
w AS (SELECT least((SELECT max(created) FROM d WHERE step > 1), (SELECT max(sent_at) FROM s)) - INTERVAL 25 HOUR AS mark)
SELECT id, step, strftime(created, '%Y-%m-%d %H') AS due FROM d WHERE step = 1
UNION ALL SELECT d.id, d.step, strftime(s.sent_at + INTERVAL 3 DAY, '%Y-%m-%d %H') FROM d JOIN s ON s.conv_id = d.conv_id AND s.step = d.step - 1 AND s.sent_at BETWEEN created - INTERVAL 10 DAY AND created + INTERVAL 10 DAY
UNION ALL SELECT d.id, d.step, NULL FROM d, w WHERE d.step > 1 AND created + INTERVAL 10 DAY < mark
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = d.conv_id AND s.step = d.step - 1 AND s.sent_at BETWEEN created - INTERVAL 10 DAY AND created + INTERVAL 10 DAY)""",
    "many_rules": r"""WITH b AS (SELECT *, CAST(regexp_extract(p_brand, '#(\d+)$', 1) AS INTEGER) AS n FROM part)
SELECT p_partkey, 'brand ' || n AS rule FROM b WHERE n BETWEEN 1 AND 300 AND (n % 2 = 0 OR p_type IN ('ECONOMY', 'SMALL'))
UNION ALL SELECT p_partkey, 'size ' || p_size FROM part WHERE p_size BETWEEN 1 AND 500
UNION ALL SELECT p_partkey, 'ring' FROM part WHERE regexp_matches(p_name, '\bring\b')""",
    "listed_drafts": """WITH d AS (SELECT conv_id || ':' || turn AS id, conv_id % 1600 + 1 AS lead, conv_id * 7 + turn AS k, conv_id FROM conversations WHERE conv_id % 17 <> 0),
m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'Ann@Mail' || (conv_id % 20) || '.org' ELSE '@user' || lead END AS recipient FROM d WHERE k % 5 = 4)
SELECT id, 'https://t.me/' || regexp_replace(recipient, '^@', '') AS link, 'https://wa.me/7900' || lead || '?text=Hello%20' || conv_id AS message,
  left(sha256('["' || recipient || '","Hello ' || conv_id || '","text"]'), 16) AS hash FROM m""",
    "paid_lookups": f"WITH {_SCORED} SELECT CAST(k AS VARCHAR) AS id, 'site' || k || '.org' AS domain, tier FROM tiered WHERE k % 3 <> 0 AND tier IN ('A', 'B')",
    "raw_status": "SELECT event_type AS source, count(*) AS n_rows, max(strftime(ts, '%Y-%m-%d')) AS last_day FROM events GROUP BY 1",
}
