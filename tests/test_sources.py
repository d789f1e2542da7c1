import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.operators import market, signals
from leadloom.sources import files, payloads, snapshots, units
from leadloom.streaming import feeds

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "title", "budget")])


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")


def test_snapshots_by_path(spark, tmp_path):
    write(tmp_path / "fl" / "2024-01-01" / "u 1.jsonl", [{"source_id": "1", "title": "a"}, {"source_id": "2", "title": "b"}])
    write(tmp_path / "fl" / "2024-01-02" / "u 1.jsonl", [{"source_id": "1", "title": "c"}])
    write(tmp_path / "kw" / "2024-01-01" / "x.jsonl", [{"source_id": "9", "title": "z"}])
    rows = snapshots.read_snapshots(spark, str(tmp_path), SCHEMA).withColumnRenamed("_source", "source")
    assert sorted((r["source"], r["day"], r["unit"]) for r in rows.collect()) == [("fl", "2024-01-01", "u 1"), ("fl", "2024-01-01", "u 1"), ("fl", "2024-01-02", "u 1"), ("kw", "2024-01-01", "x")]
    assert sorted(r["title"] for r in files.latest_snapshot(rows).collect()) == ["c", "z"]
    catalogue = spark.createDataFrame([("fl", "demand"), ("kw", "businesses")], "source string, kind string")
    assert files.of_kind(rows, catalogue, "demand").count() == 3


def test_lists_in_any_shape(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company;E-mail;Phone\nAcme;a@acme.org | b@acme.org;1\n", encoding="utf-8-sig")
    got = files.map_aliases(files.read_list(spark, str(tmp_path / "a.csv")), "dent").first()
    assert got["name"] == "Acme" and got["emails"] == ["a@acme.org", "b@acme.org"] and got["segment"] == "dent"
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"title": "B", "website": "b.org"}]}))
    assert files.map_aliases(files.read_list(spark, str(tmp_path / "b.json"))).first()["sites"] == ["b.org"]
    write(tmp_path / "c.jsonl", [{"name": "C", "reviews count": 7}])
    assert files.map_aliases(files.read_list(spark, str(tmp_path / "c.jsonl"))).first()["reviews"] == 7
    (tmp_path / "s.txt").write_text("@Spam.org # x\n\n# only\nBob@b.org\n")
    assert sorted(r[0] for r in files.read_suppressions(spark, str(tmp_path / "s.txt")).collect()) == ["bob@b.org", "spam.org"]
    (tmp_path / "d.json").write_text(json.dumps([{"lead_id": "a", "body": "x", "evidence": [{"fact": "f", "source": "s"}]}]))
    assert files.read_drafts(spark, str(tmp_path / "d.json")).select("step", "channel").first() == (1, "email")


def make_shop():
    """A local class, as a notebook would have it."""

    class Shop:
        NAME, KIND, SCHEMA = "shop_units", "businesses", "name string, unit string"

        def units(self, options):
            return [{"n": n} for n in range(int(options["count"]))]

        def unit_key(self, unit):
            return str(unit["n"])

        def collect_unit(self, unit):
            yield (f"shop {unit['n']}", str(unit["n"]))

    return Shop


def test_user_source(spark):
    Shop = make_shop()
    units.register(spark, Shop())
    assert sorted(r["name"] for r in spark.read.format("shop_units").option("count", "3").load().collect()) == ["shop 0", "shop 1", "shop 2"]
    for bad in (object(), type("X", (Shop,), {"KIND": "other"})()):
        try:
            units.check_adapter(bad)
        except ValueError:
            continue
        raise AssertionError("accepted")


def test_stream_equals_batch(spark, tmp_path):
    rows = lambda day: [{"source_id": str(i), "title": f"t{day}", "budget": str(day * 10 + i)} for i in range(day, day + 3)]
    root, check = str(tmp_path / "orders"), str(tmp_path / "check")
    shape = lambda df: df.select(F.lit("s").alias("source"), "source_id", "title", "budget", F.regexp_extract("title", r"\d", 0).alias("day"), F.lit("u").alias("unit"), F.lit(0).alias("pos"))
    for day in (1, 3, 2):  # late days too
        write(tmp_path / "in" / f"{day}.jsonl", rows(day))
        feeds.accumulate_orders(shape(feeds.new_files(spark, str(tmp_path / "in"), SCHEMA)), root, check).awaitTermination()
    whole = market.latest_orders(market.normalize_orders(shape(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))))
    pick = lambda df: sorted(map(tuple, df.select("id", "budget", "first_seen", "last_seen").collect()))
    assert pick(feeds.accumulated_orders(spark, root)) == pick(whole) and whole.count() == 5
    feeds.accumulate_orders(shape(feeds.new_files(spark, str(tmp_path / "in"), SCHEMA)), root, check).awaitTermination()
    assert pick(feeds.accumulated_orders(spark, root)) == pick(whole)


def test_places_ascend_in_a_split_file(spark, tmp_path):
    rows = [{"source_id": str(i), "title": "t" * (i % 7), "budget": None} for i in range(4000)]
    write(tmp_path / "fl" / "2024-01-01" / "big.jsonl", rows)
    write(tmp_path / "fl" / "2024-01-01" / "small.jsonl", rows[:50])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = snapshots.read_snapshots(spark, str(tmp_path), SCHEMA)
        assert got.rdd.getNumPartitions() > 5
        for unit, n in (("big", 4000), ("small", 50)):
            assert [int(r["source_id"]) for r in got.filter(F.col("unit") == unit).orderBy("pos").collect()] == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shared_folder_must_be_named_on_a_cluster():
    import pytest

    from leadloom.plans import storage

    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(), "x")


def test_pages_of_very_many_blocks_are_read_whole(spark):
    n = 100_010
    posts = "".join(f'<div class="tgme_widget_message_wrap" data-post="ch/{i}"><div class="tgme_widget_message_text">t{i}</div></div>' for i in range(n))
    landed = spark.createDataFrame([("tg", "ch", "2024-01-01", 0, posts)], "source string, unit string, collected string, pos long, payload string")
    got = payloads.channel_posts(landed).agg(F.count("*"), F.min("source_id"), F.max("source_id")).first()
    assert tuple(got) == (n, 0, n - 1)


def test_firms_share_sites_and_cities_without_a_task_for_those_without_an_organisation(spark):
    rows = [(f"s{i}", "moscow__x" if i % 2 else "omsk__x", i, 0, "o1" if i % 3 == 0 else None, [f"site{i}.org"] if i in (6, 9, 10) else [], "moscow" if i % 4 else "Moskva") for i in range(40)]
    firms = spark.createDataFrame([("2g", *r) for r in rows], "source string, source_id string, unit string, pos long, i int, org string, sites array<string>, city string")
    got = {r.source_id: r for r in payloads.backfill_city(payloads.reuse_org_sites(firms)).collect()}
    assert len(got) == 40 and payloads.reuse_org_sites(firms).columns == firms.columns
    for i in range(40):
        assert got[f"s{i}"].sites == ([f"site{i}.org"] if i in (6, 9, 10) else ["site6.org"] if i % 3 == 0 else [])
        assert got[f"s{i}"].city == ("moscow" if i % 2 == 0 and i % 4 else "moscow" if i % 2 else "Moskva")


def test_no_more_roles_of_a_board_are_gathered_than_are_kept(spark):
    postings = spark.range(3000).select(F.lit("lever").alias("ats"), F.lit("acme").alias("token"), F.col("id").cast("int").alias("i"), F.concat(F.lit("role "), F.col("id").cast("string")).alias("title"), *[F.lit(x).alias(c) for c, x in (("location", "x"), ("url", "u"), ("posted", "2024-01-01"), ("team", "t"), ("company", "Acme"), ("text", "acme.org"))])
    leads = spark.createDataFrame([("1", "acme.org", "Acme", [("lever", "acme")], [])], "id string, domain string, name string, job_boards array<struct<ats:string,token:string>>, signals array<struct<type:string,value:string,source:string,date:string>>")
    joined = signals.join_boards(leads, postings, "2024-01-02")
    board = joined.first()["jobs"]["boards"][0]
    assert board["open_roles"] == 3000 and [r["title"] for r in board["roles"]] == [f"role {i}" for i in range(signals.ROLES)]
    assert "WindowGroupLimit" in joined._jdf.queryExecution().executedPlan().toString()
