"""Pruned snapshots, tables of JSON lines that are replaced as a whole, user sources with filters and as streams."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.operators import outreach
from leadloom.plans import stream_cases, table_cases, workflow_cases
from leadloom.sources import files, jsonl_table, snapshots, units
from leadloom.streaming import approvals, followups

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "title")])


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")


def files_read(df):
    """Rows of a frame, and the number of files that its scans opened."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return rows, sum(s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles"))


@pytest.fixture
def root(tmp_path):
    for source, day, unit, titles in [
        ("fl", "2024-01-01", "u 1", "ab"),
        ("fl", "2024-01-02", "u 1", "c"),
        ("fl", "2024-01-01", "50%+x", "d"),
        ("kw", "2024-01-03", "u 1", "ef"),
        ("kw", "2024-01-01", "v.2", "g"),
        ("kw", "2024-01-02", "v.2", "h"),
    ]:
        write(tmp_path / source / day / f"{unit}.jsonl", [{"source_id": str(i), "title": t} for i, t in enumerate(titles)])
    (tmp_path / "fl" / "2024-01-01" / "note.txt").write_text("no snapshot")
    return str(tmp_path)


def test_only_wanted_files_are_opened(spark, root):
    def got(**wanted):
        rows, n = files_read(snapshots.read_snapshots(spark, root, SCHEMA, **wanted))
        return "".join(sorted(r["title"] for r in rows)), n

    assert got() == ("abcdefgh", 6)
    assert got(newest_only=True) == ("cdefh", 4)
    assert got(sources=["fl"]) == ("abcd", 3)
    assert got(sources=["fl", "none"], newest_only=True) == ("cd", 2)
    assert got(since="2024-01-02", until="2024-01-02") == ("ch", 2)
    assert got(sources=["none"]) == ("", 0)
    rows = snapshots.read_snapshots(spark, root, SCHEMA, sources=["fl"]).collect()
    assert {(r["_source"], r["day"], r["unit"]) for r in rows} == {("fl", "2024-01-01", "u 1"), ("fl", "2024-01-02", "u 1"), ("fl", "2024-01-01", "50%+x")}


def test_newest_file_of_each_unit_with_all_its_rows(spark, root):
    by_files = snapshots.read_snapshots(spark, root, SCHEMA, newest_only=True).withColumnRenamed("_source", "source")
    by_rows = files.latest_snapshot(snapshots.read_snapshots(spark, root, SCHEMA).withColumnRenamed("_source", "source"))
    key = lambda df: sorted(map(tuple, df.select("source", "day", "unit", "source_id", "title").collect()))
    assert key(by_files) == key(by_rows)
    odd = spark.createDataFrame([(None, "a", "1", 1), (None, "a", "2", 2), ("s", None, "1", 3), ("s", None, None, 4)], "source string, unit string, day string, n int")
    assert sorted(r.n for r in files.latest_snapshot(odd).collect()) == [2, 3]


def test_manifest_opens_no_file_and_gives_what_is_left_to_collect(spark, root):
    found = snapshots.manifest(spark, root)
    assert found.count() == 6 and {r.bytes > 0 for r in found.collect()} == {True}
    plan = spark.createDataFrame([("fl", "u 1"), ("fl", "new"), ("kw", "v.2")], "source string, unit string")
    assert [r.unit for r in snapshots.uncollected_units(plan, found).collect()] == ["new"]
    assert sorted(r.unit for r in snapshots.uncollected_units(plan, found, "2024-01-02").collect()) == ["new"]
    assert sorted(r.unit for r in snapshots.uncollected_units(plan, found, "2024-01-03").collect()) == ["new", "u 1", "v.2"]
    assert snapshots.manifest(spark, root + "/nowhere").count() == 0


def test_landed_units_are_replaced_by_day_and_lie_beside_files(spark, root):
    rows = spark.createDataFrame([("fl", "2024-01-04", "u 1", "9", "new"), ("ne", "2024-01-01", "a:b/c", "1", "x"), ("ne", "2024-01-02", "a:b/c", "1", "y")], "source string, day string, unit string, source_id string, title string")
    snapshots.land(rows, root)
    snapshots.land(rows.filter("day = '2024-01-02'").withColumn("title", F.lit("z")), root)
    got, n = files_read(snapshots.read_snapshots(spark, root, SCHEMA, newest_only=True))
    newest = {(r["_source"], r["day"], r["unit"], r["title"]) for r in got}
    assert ("fl", "2024-01-04", "u 1", "new") in newest and ("ne", "2024-01-02", "a:b/c", "z") in newest and n == 5
    assert [r["title"] for r in snapshots.read_snapshots(spark, root, SCHEMA, sources=["ne"], until="2024-01-01").collect()] == ["x"]


def table_rows(spark, path):
    return sorted(map(tuple, jsonl_table.read_table(spark, path, "id long, name string").collect()))


def test_table_is_replaced_and_added_to(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda ids, name: spark.createDataFrame([(i, name if i % 2 else None) for i in ids], "id long, name string").repartition(3)
    assert table_rows(spark, path) == []
    jsonl_table.write_table(frame(range(5), "a é\n"), path)
    assert table_rows(spark, path) == [(i, "a é\n" if i % 2 else None) for i in range(5)]
    before = jsonl_table.read_table(spark, path, "id long, name string")
    jsonl_table.write_table(frame(range(2), "b"), path)
    assert table_rows(spark, path) == [(0, None), (1, "b")]
    assert before.count() == 5  # a reader that began before keeps what it read
    jsonl_table.write_table(frame([7], "c"), path, append=True)
    assert table_rows(spark, path) == [(0, None), (1, "b"), (7, "c")] and jsonl_table.current(path)["rows"] == 3
    jsonl_table.write_table(frame([], ""), path)
    assert table_rows(spark, path) == [] and jsonl_table.current(path)["parts"] == []
    jsonl_table.write_table(frame([1], "d"), path)
    listed = {name for n in os.listdir(f"{path}/lists") for name in json.loads((tmp_path / "t" / "lists" / n).read_text())["parts"]}
    assert set(os.listdir(f"{path}/parts")) == listed and len(os.listdir(f"{path}/lists")) == jsonl_table.KEPT
    assert not [n for n in os.listdir(path) if n.startswith("CURRENT-")]


def test_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    jsonl_table.write_table(spark.createDataFrame([(1, "kept")], "id long, name string"), path)
    parts = set(os.listdir(f"{path}/parts"))
    bad = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise("new").alias("name"))
    with pytest.raises(Exception, match="broken"):
        jsonl_table.write_table(bad, path)
    assert table_rows(spark, path) == [(1, "kept")] and set(os.listdir(f"{path}/parts")) == parts
    # What a driver that died before its commit left behind is not read.
    (tmp_path / "t" / "parts" / "stray-00000-1.jsonl").write_text('{"id": 9}\n')
    assert table_rows(spark, path) == [(1, "kept")]


def landed(root, days, units=3):
    for day in days:
        for source in ("fl", "kw"):
            for u in range(units):
                write(root / source / day / f"u{u}.jsonl", [{"source_id": f"{source}{day}{u}{i}"} for i in range(2)])


def counted(tmp_path):
    """The adapter of landed units, noting in a folder which units were parsed."""

    class Counted(units.LandedUnits):
        NAME = "counted_units"

        def collect_unit(self, unit):
            name = self.unit_key(unit).replace("/", "-")
            n = len([x for x in os.listdir(tmp_path / "asked") if x.startswith(name)])
            (tmp_path / "asked" / f"{name}.{n}").touch()
            yield from super().collect_unit(unit)

    (tmp_path / "asked").mkdir()
    return Counted()


def test_filters_decide_which_units_are_asked(spark, tmp_path):
    landed(tmp_path / "raw", ["2024-01-01", "2024-01-02"])
    units.register(spark, counted(tmp_path))
    rows = lambda: spark.read.format("counted_units").option("path", str(tmp_path / "raw")).load()

    def asked(condition):
        for x in os.listdir(tmp_path / "asked"):
            os.remove(tmp_path / "asked" / x)
        n = rows().filter(condition).count()
        return n, len(os.listdir(tmp_path / "asked"))

    assert asked("true") == (24, 12)
    assert asked("source = 'fl'") == (12, 6)
    assert asked("source = 'fl' and day >= '2024-01-02' and unit in ('u0', 'u2')") == (4, 2)
    assert asked("not (source = 'fl') and day < '2024-01-02'") == (6, 3)
    assert asked("source = 'fl' and line like '%0\"}'") == (6, 6)
    assert asked("source = 'none'") == (0, 0)
    assert asked("source is null") == (0, 0)


def test_filters_on_units_are_never_too_strict():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not

    unit, columns = {"s": "a", "n": None}, {"source": "s", "none": "n"}
    match = lambda f: units.may_match(f, columns, unit)
    assert match(EqualTo(("source",), "a")) is True and match(EqualTo(("source",), "b")) is False and match(EqualTo(("line",), "b")) is None
    assert match(EqualTo(("none",), "a")) is None and match(Not(EqualTo(("none",), "a"))) is None and match(IsNull(("none",))) is True
    assert match(In(("source",), ("b", None))) is None and match(Not(EqualTo(("source",), "a"))) is False and match(GreaterThan(("source",), "0")) is True
    assert match(EqualTo(("source", "inner"), "a")) is None


def test_stream_of_units_over_restarts(spark, tmp_path):
    """New units come once each, whatever is stopped and begun again; a step that failed is read again whole."""
    units.register(spark, counted(tmp_path))
    fail = tmp_path / "fail"

    def run(most=4):
        stream = spark.readStream.format("counted_units").option("path", str(tmp_path / "raw")).option("log", str(tmp_path / "log")).option("maxUnitsPerTrigger", most).load()

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
            if fail.exists():
                raise ValueError("stopped")

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("source", "day", "unit", "pos").collect()]
        assert len(rows) == len(set(rows))
        return len(rows)

    landed(tmp_path / "raw", ["2024-01-01"])
    assert run() == 12
    assert run() == 12
    landed(tmp_path / "raw", ["2024-01-02"])
    fail.touch()
    with pytest.raises(Exception, match="stopped"):
        run()
    landed(tmp_path / "raw", ["2024-01-03"], units=1)
    fail.unlink()
    run()  # what was asked for before the stop
    assert run() == 12 + 12 + 4
    assert len(os.listdir(tmp_path / "log")) == 2 + 2 + 1
    with pytest.raises(Exception, match="option log"):
        spark.readStream.format("counted_units").option("path", "x").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()


def stamp(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


APPROVAL_EVENTS = [
    ("a", "1", "preview", 0), ("a", "2", "approve", 2), ("a", "3", "approve", 3),
    ("b", "4", "preview", 0), ("b", "5", "approve", 30), ("b", "6", "approve", 31),
    ("c", "7", "approve", 1), ("d", "8", "preview", 1),
    ("e", "9", "preview", 0), ("e", "10", "preview", 20), ("e", "11", "approve", 40), ("e", "12", "approve", 40),
    ("f", "13", "preview", 5), ("f", "14", "approve", 29), (None, "15", "approve", 1), ("a", "16", "other", 1),
    ("g", "17", "preview", 100), ("h", "18", "preview", 2), ("h", "19", "approve", 4), ("h", "20", "preview", 50), ("h", "21", "approve", 51),
]


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_batches_are_approved_once_or_expire(spark, tmp_path, cut):
    """Any split of the events gives the verdicts of all at once, and tells the same batches as lapsed."""
    events = sorted(((b, e, k, stamp(h)) for b, e, k, h in APPROVAL_EVENTS), key=lambda r: r[3])
    schema = "batch string, event_id string, kind string, at timestamp"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i in range(cut):
            part = events[i * len(events) // cut : (i + 1) * len(events) // cut]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = approvals.approval_verdicts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), remembered=datetime.timedelta(days=30))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = [tuple(r) for r in spark.read.schema(approvals.VERDICTS).parquet(str(tmp_path / "out")).collect()]
    told = sorted((b, e, v) for b, e, _, v in got if e)
    want = approvals.approvals_at_once(spark.createDataFrame(events, schema)).collect()
    assert told == sorted((r.batch, r.event_id, r.verdict) for r in want)
    assert {e: v for _, e, v in told} == {
        "2": approvals.APPROVED, "3": approvals.USED, "5": approvals.EXPIRED, "6": approvals.EXPIRED, "7": approvals.UNKNOWN, "11": approvals.APPROVED,
        "12": approvals.USED, "14": approvals.APPROVED, "19": approvals.APPROVED, "21": approvals.APPROVED,
    }
    assert sorted((b, at) for b, e, at, _ in got if not e) == [("b", stamp(24)), ("d", stamp(25))]


@pytest.mark.parametrize("cut", [1, 4])
def test_follow_ups_of_streams_equal_the_batch(spark, tmp_path, cut):
    """Reasons from both streams equal those of the batch plan, however the input is split; what never came is told."""
    rng = random.Random(cut)
    drafts, log = [], []
    for lead in range(40):
        for step in range(1, rng.randint(2, 5)):
            at = 24 * rng.randint(0, 60) + lead / 100
            drafts.append((f"{lead}:{step}", str(lead), step, stamp(at)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                log.append((f"{lead}:{step}", str(lead), step, stamp(at + 24 * rng.uniform(0, 9))))
    drafts.sort(key=lambda r: r[3])
    log.sort(key=lambda r: r[3])
    schemas = {"drafts": "id string, lead_id string, step int, created timestamp", "log": "draft_id string, lead_id string, step int, sent_at timestamp"}
    stream = lambda name: spark.readStream.schema(schemas[name]).parquet(str(tmp_path / name))

    def run(told):
        for name, rows in (("follow", followups.follow_ups(stream("drafts"), stream("log"), 3.0, 400, "1 hour")), ("sent", followups.sent_drafts(stream("drafts"), stream("log"), 400, "1 hour"))):
            rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
        return [spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in (("follow", followups.TOLD), ("sent", followups.SENT))]

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        ends = [stamp(24 * 75 * (k + 1) / cut) for k in range(cut)]
        for k, end in enumerate(ends):
            begin = ends[k - 1] if k else stamp(-1)
            for name, rows in (("drafts", drafts), ("log", log)):
                spark.createDataFrame([r for r in rows if begin <= r[3] < end], schemas[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            told = run(None)
        now = stamp(24 * 40)
        leads = spark.createDataFrame([(str(i), "A", 1, "new", f"s{i}.org") for i in range(40)], "id string, tier string, score int, status string, domain string").withColumns({
            "emails": F.array(F.struct(F.concat(F.lit("a@m"), "id", F.lit(".org")).alias("value"), F.lit("personal").alias("type"), F.lit("mx").alias("verified"))), "phones": F.array().cast("array<string>")})
        full = spark.createDataFrame(drafts, schemas["drafts"]).withColumns({"channel": F.lit("email"), "to": F.lit(None).cast("string"), "subject": F.lit("s"), "body": F.lit("b"), "status": F.lit("draft")})
        batch = outreach.checked_drafts(full, leads, spark.createDataFrame(log, schemas["log"]), spark.createDataFrame([], "entry string"), outreach.SendConfig(min_tier="D", followup_days=3.0), now)
        want = sorted((r.id, r.reason) for r in batch.select("id", "reason").collect())
        got = sorted((r.id, r.reason) for r in followups.waiting_reasons(full, *told, now).collect())
        assert got == want and len({r[:20] for _, r in want if r}) > 3
        # Much later lines move the watermarks on: what never came is told as such.
        for name, row in (("drafts", ("x:1", "x", 1, stamp(24 * 900))), ("log", ("y", "y", 1, stamp(24 * 900)))):
            spark.createDataFrame([row], schemas[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        spark.createDataFrame([("x:2", "x", 2, stamp(24 * 900))], schemas["drafts"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "drafts"))
        follow, sent = run(None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    have = {(lead, step) for _, lead, step, _ in log}
    assert {r.id for r in follow.filter("previous is null and step > 1").collect()} == {i for i, lead, step, _ in drafts if step > 1 and (lead, step - 1) not in have}
    assert {r.id for r in sent.filter("sent_at is null").collect()} == {i for i, lead, step, _ in drafts if (lead, step) not in have}


@pytest.mark.parametrize("name", ["stream_follow_ups", "stream_enriched", "stream_orders"])
def test_streams_take_tables_that_are_folders(spark, tmp_path, name):
    """A table may be one file or a folder of files; a stream of it holds the same rows."""
    tables = "/root/testdata/sf0.001"
    for table in ("conversations", "events", "customer"):
        spark.read.parquet(f"{tables}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    query = (stream_cases.QUERIES | table_cases.QUERIES | workflow_cases.QUERIES)[name]
    rows = lambda path: sorted(map(tuple, query(spark, path).collect()), key=repr)
    want = rows(tables)
    assert want and rows(str(tmp_path)) == want
