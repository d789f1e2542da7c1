"""Resolution by increments equals one run over all records, and leaves untouched buckets alone."""

import datetime
import random

import pytest

from pyspark.sql import functions as F

from leadloom.operators import incremental, outreach, resolve
from leadloom.plans import storage
from leadloom.streaming import feeds

SCHEMA = "pos long, source string, source_id string, name string, website string, city string, phones array<string>, emails array<string>, reviews long"


def records(seed, n=120):
    rng, rows = random.Random(seed), []
    for i in range(n):
        site = f"site{rng.randrange(40)}.org" if rng.random() < 0.3 else None
        phones = [f"+7900{rng.randrange(45):07d}" for _ in range(rng.choice([0, 0, 1, 2]))]
        rows.append((i, "s", str(i), f"Firm {rng.randrange(60)}" if rng.random() < 0.8 else None, site, rng.choice(["Omsk", "Oslo", None]), phones, [f"a{rng.randrange(30)}@corp{i % 9}.org"], rng.randrange(9)))
    return rows


def shown(df):
    return sorted((repr({k: v for k, v in r.asDict(recursive=True).items()}) for r in df.collect()))


@pytest.mark.parametrize("cuts", [[120], [1, 50, 51, 120]])
def test_increments_equal_one_run(spark, tmp_path, cuts):
    rows, root = records(len(cuts)), str(tmp_path)
    random.Random(9).shuffle(rows)
    for number, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
        incremental.add_records(spark.createDataFrame(rows[a:b], SCHEMA), root, number, buckets=3)
    incremental.add_records(spark.createDataFrame(rows[a:b], SCHEMA), root, number, buckets=3)  # run again, as after a stop
    whole = resolve.resolve(spark.createDataFrame(rows, SCHEMA))
    assert shown(incremental.resolved_leads(spark, root).select(whole.columns)) == shown(whole)


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path, monkeypatch):
    rows, root = records(5, 80), str(tmp_path)
    incremental.add_records(spark.createDataFrame(rows, SCHEMA), root, 0, buckets=64)
    before = {name: feeds._versions(spark, f"{root}/{name}") for name in ("keys", "records", "leads")}
    read = []
    monkeypatch.setattr(incremental, "current_rows", lambda s, path, n, touched: read.append((path.rsplit("/", 1)[1], touched)) or feeds.current_rows(s, path, n, touched))
    new = (1000, "s", "1000", "Quite Another", "another-one.org", "Rome", ["+79990000001"], [], 1)
    incremental.add_records(spark.createDataFrame([new], SCHEMA), root, 1, buckets=64)
    monkeypatch.undo()
    after = {name: feeds._versions(spark, f"{root}/{name}") for name in before}
    assert {name for name, _ in read} == {"keys", "records", "leads"} and all(len(t) <= 3 for _, t in read)
    for name in before:
        written = [b for b, v in after[name].items() if v != before[name].get(b)]
        assert 1 <= len(written) <= 3
    assert incremental.resolved_leads(spark, root).count() == resolve.resolve(spark.createDataFrame([*rows, new], SCHEMA)).count()
    assert incremental.resolved_leads(spark, root + "/none") is None


def shuffled_tables(df):
    """Of every exchange of rows in a plan what is read below it."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "Exchange":
            leaves = node.collectLeaves()
            found.append([leaves.apply(i).toString() for i in range(leaves.size())])
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_tables_in_buckets_are_joined_without_a_shuffle(spark):
    leads = spark.createDataFrame([(str(i), f"s{i}.org", "A", i, "new", [(f"a@s{i}.org", "s", "personal", "mx")], [f"7900{i:07d}"]) for i in range(50)], f"id string, domain string, tier string, score int, status string, emails array<{resolve.EMAIL}>, phones array<string>")
    drafts = spark.createDataFrame([(f"{i}:{s}", str(i), s, "email", None, "s", "b", "draft") for i in range(60) for s in (1, 2)], "id string, lead_id string, step int, channel string, to string, subject string, body string, status string")
    log = spark.createDataFrame([(f"{i}:1", str(i), 1, f"a@s{i}.org", datetime.datetime(2024, 1, 1)) for i in range(0, 50, 2)], "draft_id string, lead_id string, step int, to string, sent_at timestamp")
    entries = spark.createDataFrame([("s3.org",)], "entry string")
    cfg, now = outreach.SendConfig(min_tier="B", followup_days=3.0), datetime.datetime(2024, 2, 1)
    plain = outreach.checked_drafts(drafts, leads, log, entries, cfg, now)
    want = sorted(map(repr, plain.select("id", "recipient", "reason").collect()))
    previous = leads.withColumn("notes", F.lit("n")).filter("score % 3 = 0")
    carried = shown(resolve.carry_over(leads, previous))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        tables = [storage.bucketed(t, name, key, 4) for t, name, key in ((leads, "leads", "id"), (drafts, "drafts", "lead_id"), (log, "sent-log", "lead_id"), (previous, "previous", "id"))]
        joined = resolve.carry_over(tables[0], tables[3])
        assert shuffled_tables(joined) == [] and shown(joined) == carried
        planned = outreach.checked_drafts(tables[1], tables[0], tables[2], F.broadcast(entries), cfg, now)
        # Drafts move on, joined, to meet the log by their own ids; leads alone are never moved.
        assert not [x for x in shuffled_tables(planned) if all("leads_" in t or "LocalTable" in t for t in x)]
        assert sorted(map(repr, planned.select("id", "recipient", "reason").collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
