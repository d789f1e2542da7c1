"""Outreach planning: which drafts may go out now, why others may not, and the state that sending leaves behind."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.functions import patterns as P
from leadloom.operators.rules import tier_at_least

# What can be sent, and lead states that end a sequence.
SENDABLE = ["email"]
CHANNELS = ["email", "telegram", "whatsapp", "linkedin", "phone", "sms", "contact_form"]
STOP_STATUSES = ["replied", "won", "lost", "suppressed"]
BATCH_HOURS = 24


@dataclass(frozen=True)
class SendConfig:
    min_tier: str = "B"
    daily_cap: int = 30
    per_domain_cap: int = 1
    followup_days: float = 4.0


def best_email(emails: Column) -> Column:
    """Checked addresses first, then personal ones, then the first listed."""
    ranked = F.transform(
        emails,
        lambda e, i: F.struct(
            F.when(e["verified"].isin("mx", "smtp"), 0).otherwise(1).alias("unchecked"), F.when(e["type"] == "personal", 0).otherwise(1).alias("generic"), i.alias("place"), e["value"].alias("value")
        ),
    )
    return F.array_min(F.filter(ranked, lambda e: norm.truthy_text(e["value"])))["value"]


def violations(drafts: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, problem) of each broken rule of a draft: known lead, body, channel, evidence, subject and address of mail."""
    known = leads.select(F.col("id").alias("lead_id")).distinct().withColumn("known", F.lit(True))
    evidence = F.coalesce("evidence", F.array().cast("array<struct<fact:string,source:string>>"))
    mail = F.col("channel") == "email"
    problems = F.array_compact(
        F.array(
            F.when(~norm.truthy_text(F.col("lead_id")), "no lead_id"),
            F.when(norm.truthy_text(F.col("lead_id")) & F.col("known").isNull(), "unknown lead_id"),
            F.when(~norm.truthy_text(F.col("body")), "no body"),
            F.when(~F.coalesce(F.col("channel").isin(CHANNELS), F.lit(False)), "unknown channel"),
            F.when(F.size(evidence) == 0, "no evidence"),
            F.when(F.exists(evidence, lambda e: ~norm.truthy_text(e["fact"]) | ~norm.truthy_text(e["source"])), "evidence without fact or source"),
            F.when(mail & ~norm.truthy_text(F.col("subject")), "no subject"),
            F.when(mail & norm.truthy_text(F.col("to")) & ~F.contains("to", F.lit("@")), "not an address"),
        )
    )
    return drafts.join(known, "lead_id", "left").select("id", F.explode(problems).alias("problem"))


def suppression_list(lines: DataFrame) -> DataFrame:
    """Distinct normal forms of a list's lines (column ``value``)."""
    return lines.select(norm.suppression_key(F.col("value")).alias("entry")).filter(norm.truthy_text(F.col("entry"))).distinct()


def add_suppressions(entries: DataFrame, values: DataFrame, reason: str, date: str) -> DataFrame:
    """Entries to append: those that are not listed yet."""
    return suppression_list(values).join(entries, "entry", "left_anti").withColumns({"reason": F.lit(reason), "date": F.lit(date)})


def suppressed(rows: DataFrame, key: str, candidates: Column, entries: DataFrame) -> DataFrame:
    """Distinct keys of rows of which any candidate (address, domain, digits) is listed. The list decides its own join."""
    found = rows.select(key, F.explode(F.array_distinct(F.array_compact(candidates))).alias("entry"))
    return found.join(entries, "entry", "left_semi").select(key).distinct()


def lead_candidates() -> Column:
    """What of a lead may be listed: its domain, its addresses and their domains, its phones."""
    domain = F.array(F.col("domain"))
    mails = F.flatten(F.transform("emails", lambda e: F.array(F.lower(F.trim(e["value"])), F.substring_index(F.lower(F.trim(e["value"])), "@", -1))))
    phones = F.transform("phones", lambda p: F.regexp_replace(p, r"\D", ""))
    none = F.array().cast("array<string>")
    return F.concat(domain, F.coalesce(mails, none), F.coalesce(phones, none))


def checked_drafts(drafts: DataFrame, leads: DataFrame, sent: DataFrame, entries: DataFrame, cfg: SendConfig, now: datetime.datetime) -> DataFrame:
    """Drafts with recipient, domain and the first reason why they may not go out now (null: they may)."""
    people = leads.select(F.col("id").alias("lead_id"), "tier", F.col("score").alias("lead_score"), F.col("status").alias("lead_status"), best_email(F.col("emails")).alias("lead_mail"), F.lit(True).alias("known"))
    blocked = suppressed(leads, "id", lead_candidates(), entries).select(F.col("id").alias("lead_id"), F.lit(True).alias("lead_blocked"))
    gone = sent.select(F.col("draft_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    before = sent.groupBy("lead_id", (F.col("step") + 1).alias("step")).agg(F.max("sent_at").alias("previous"))
    rows = drafts.join(people, "lead_id", "left").join(blocked, "lead_id", "left").join(gone, "id", "left").join(before, ["lead_id", "step"], "left")
    rows = rows.withColumn("recipient", norm.blank_to_null(F.lower(F.trim(F.coalesce(norm.blank_to_null(F.col("to")), "lead_mail")))))
    rows = rows.withColumn("domain", F.substring_index("recipient", "@", -1))
    listed = suppressed(rows.filter("recipient is not null"), "id", F.array("recipient", "domain"), entries).withColumn("mail_blocked", F.lit(True))
    rows = rows.join(listed, "id", "left")
    due = F.col("previous") + F.make_dt_interval(days=F.lit(0), secs=F.lit(cfg.followup_days * 86400))
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("channel").isin(SENDABLE), F.lit(False)), F.concat("channel", F.lit(" is draft-only"))),
        F.when(~F.col("status").eqNullSafe("draft"), F.concat(F.lit("status "), F.coalesce("status", F.lit("none")))),
        F.when(F.col("gone"), F.lit("already sent")),
        F.when(F.col("known").isNull(), F.lit("unknown lead")),
        F.when(F.col("lead_status").isin(STOP_STATUSES), F.concat(F.lit("lead status "), "lead_status")),
        F.when(~tier_at_least(F.col("tier"), cfg.min_tier), F.concat(F.lit("tier "), F.coalesce("tier", F.lit("none")), F.lit(f" below {cfg.min_tier}"))),
        F.when(F.col("recipient").isNull(), F.lit("no email address")),
        F.when(F.col("mail_blocked") | F.col("lead_blocked"), F.lit("suppressed")),
        F.when((F.col("step") > 1) & F.col("previous").isNull(), F.concat(F.lit("step "), (F.col("step") - 1).cast("string"), F.lit(" not sent yet"))),
        F.when((F.col("step") > 1) & (F.lit(now) < due), F.concat(F.lit("follow-up due "), F.to_date(due).cast("string"))),
    )
    return rows.withColumn("reason", reason)


def send_plan(drafts: DataFrame, leads: DataFrame, sent: DataFrame, entries: DataFrame, cfg: SendConfig, now: datetime.datetime) -> DataFrame:
    """(id, lead_id, step, recipient, ready, reason, hash) of drafts that are ready, or that wait with a reason.

    Drafts go in the order of step, tier, score and id, under a cap for each domain and one for the day; what was sent
    today counts for both. Only the first ``per_domain_cap`` of a domain are ranked and only as many as the day allows
    are ordered at all, so neither a large domain nor the whole list meets in one task.
    """
    rows = checked_drafts(drafts, leads, sent, entries, cfg, now)
    today = sent.filter(F.to_date("sent_at") == F.lit(now.date()))
    by_domain = today.groupBy(F.substring_index("to", "@", -1).alias("domain")).agg(F.count("*").alias("today"))
    free = max(0, cfg.daily_cap - today.count())
    able = rows.filter("reason is null").join(by_domain, "domain", "left").withColumn("today", F.coalesce("today", F.lit(0)))
    order = [F.col("step"), norm.tier_rank(F.col("tier")), F.desc(F.coalesce("lead_score", F.lit(0))), F.col("id")]
    place = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    passing = able.withColumn("place", place).filter(F.col("place") <= cfg.per_domain_cap).filter(F.col("place") + F.col("today") <= cfg.per_domain_cap)
    ready = passing.orderBy(*order).limit(free).select("id", "domain").withColumn("ready", F.lit(True))
    full = ready.groupBy("domain").agg(F.count("*").alias("taken"))
    labelled = able.join(F.broadcast(ready.select("id", "ready")), "id", "left").join(F.broadcast(full), "domain", "left").join(passing.select("id", F.lit(True).alias("passes")), "id", "left")
    at_cap = F.col("passes").isNull() & (F.coalesce("taken", F.lit(0)) + F.col("today") >= cfg.per_domain_cap)
    why = F.when(F.col("ready"), None).when(at_cap, F.concat(F.lit("per_domain_cap reached for "), "domain")).otherwise(F.lit("daily_cap reached"))
    out = ["id", "lead_id", "step", "recipient", F.coalesce("ready", F.lit(False)).alias("ready"), "reason", F.when(F.col("ready"), norm.content_hash(F.col("recipient"), F.col("subject"), F.col("body"))).alias("hash")]
    waiting = rows.filter(F.col("reason").isNotNull() & F.col("channel").isin(SENDABLE) & (F.col("status") == "draft")).withColumn("ready", F.lit(None).cast("boolean"))
    return labelled.withColumn("reason", why).select(*out).unionByName(waiting.select(*out))


def skip_reasons(plan: DataFrame) -> DataFrame:
    """Waiting drafts by reason, most first."""
    return plan.filter(~F.col("ready")).groupBy("reason").agg(F.count("*").alias("drafts")).orderBy(F.desc("drafts"), "reason")


def batch_of(plan: DataFrame) -> DataFrame:
    """Items of a preview: what is ready, with the hash of its content."""
    return plan.filter("ready").select(F.col("id").alias("draft_id"), "lead_id", "step", F.col("recipient").alias("to"), "hash")


def batch_id(items: DataFrame) -> DataFrame:
    """One row: the id of a batch, which its sorted items determine. Its size is bounded by the daily cap."""
    return items.agg(F.left(F.sha1(F.array_join(F.sort_array(F.collect_list(F.concat("draft_id", F.lit(":"), "hash"))), ",")), F.lit(8)).alias("batch"))


def open_batches(batches: DataFrame, now: datetime.datetime) -> DataFrame:
    """Batches that may still be approved: less than a day old and not approved before."""
    return batches.filter((F.col("created") > F.lit(now - datetime.timedelta(hours=BATCH_HOURS))) & F.col("approved").isNull())


def reconcile(items: DataFrame, plan: DataFrame) -> DataFrame:
    """Items of an approved batch against what is ready now: ``ok``, or why an item must wait."""
    now_ready = plan.select(F.col("id").alias("draft_id"), "ready", "reason", F.col("hash").alias("now_hash"))
    joined = items.join(now_ready, "draft_id", "left")
    verdict = (
        F.when(~F.coalesce("ready", F.lit(False)), F.concat(F.lit("approved but "), F.coalesce("reason", F.lit("no longer eligible"))))
        .when(~F.col("hash").eqNullSafe(F.col("now_hash")), "changed since the preview; re-preview")
        .otherwise("ok")
    )
    return joined.select("draft_id", verdict.alias("verdict"))


def upsert_drafts(drafts: DataFrame, incoming: DataFrame, leads: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Drafts after adding ``incoming`` (lead_id, step, channel, …), and counts of added, replaced and kept.

    All or nothing: any violation raises. Sent drafts stay as they are; ``created`` of replaced ones is kept.
    """
    named = incoming.withColumn("id", F.concat_ws(":", "lead_id", F.col("step").cast("string"), "channel"))
    bad = violations(named, leads).limit(5).collect()
    if bad:
        raise ValueError("drafts not added: " + "; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    fields = ["lead_id", "step", "channel", "to", "subject", "body", "evidence"]
    old = drafts.select(F.col("id"), *[F.col(f).alias(f"old_{f}") for f in [*fields, "status", "created", "updated"]], F.lit(True).alias("was"))
    both = named.withColumn("new", F.lit(True)).join(old, "id", "full_outer")
    take = F.col("new").isNotNull() & ~F.coalesce(F.col("old_status") == "sent", F.lit(False))
    kind = F.when(F.col("new").isNull(), "untouched").when(F.coalesce(F.col("old_status") == "sent", F.lit(False)), "kept_sent").when(F.col("was"), "replaced").otherwise("added")
    out = both.select(
        "id", *[F.when(take, F.col(f)).otherwise(F.col(f"old_{f}")).alias(f) for f in fields], F.when(take, F.lit("draft")).otherwise(F.col("old_status")).alias("status"),
        F.coalesce("old_created", F.lit(now)).alias("created"), F.when(take, F.lit(now)).otherwise(F.col("old_updated")).alias("updated"),
    )
    return out, both.groupBy(kind.alias("outcome")).agg(F.count("*").alias("drafts"))


def apply_sent(drafts: DataFrame, leads: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts and leads with the status that the log of sent mail gives them."""
    done = sent.groupBy(F.col("draft_id").alias("id")).agg(F.max("sent_at").alias("sent_at"))
    drafts = drafts.drop("sent_at").join(done, "id", "left").withColumn("status", F.when(F.col("sent_at").isNotNull(), "sent").otherwise(F.col("status")))
    reached = sent.select(F.col("lead_id").alias("id")).distinct().withColumn("reached", F.lit(True))
    fresh = F.col("reached").isNotNull() & (F.col("status").isNull() | F.col("status").isin("new", "drafted"))
    leads = leads.join(reached, "id", "left").withColumn("status", F.when(fresh, "sent").otherwise(F.col("status"))).drop("reached")
    return drafts, leads


def mark_drafted(leads: DataFrame, drafts: DataFrame) -> DataFrame:
    """New leads that have a draft become ``drafted``."""
    have = drafts.select(F.col("lead_id").alias("id")).distinct().withColumn("has_draft", F.lit(True))
    fresh = F.col("has_draft").isNotNull() & (F.coalesce("status", F.lit("new")) == "new")
    return leads.join(have, "id", "left").withColumn("status", F.when(fresh, "drafted").otherwise(F.col("status"))).drop("has_draft")


def mark_status(leads: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leads after updates (id, new_status, note), and entries that newly suppressed leads add to the list."""
    joined = leads.join(updates, "id", "left")
    note = F.when(norm.truthy_text(F.col("note")), F.concat_ws("\n", norm.blank_to_null(F.col("notes")), F.col("note"))).otherwise(F.col("notes"))
    out = joined.withColumns({"status": F.coalesce("new_status", "status"), "notes": note}).drop("new_status", "note")
    contacts = F.concat(F.transform("emails", lambda e: e["value"]), F.col("phones"))
    keys = F.when(norm.truthy_text(F.col("domain")), F.array("domain")).otherwise(contacts)
    entries = joined.filter(F.col("new_status") == "suppressed").select(F.explode(keys).alias("entry")).distinct()
    return out, entries


def drafts_where(drafts: DataFrame, status: str | None = None, lead: str | None = None, channels: Iterable[str] = P.MESSENGERS[:0]) -> DataFrame:
    """Drafts of a status, a lead, or some channels."""
    if status:
        drafts = drafts.filter(F.col("status") == status)
    if lead:
        drafts = drafts.filter(F.col("lead_id") == lead)
    channels = list(channels)
    return drafts.filter(F.col("channel").isin(channels)) if channels else drafts
