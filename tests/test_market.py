import datetime

from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.operators import market

DAY = datetime.date(2026, 7, 1)
ROWS = [
    ("a", 1, "https://x/1", "Landing page", "Make a landing", "20000", None, "RUB", "sites", "3", "2026-06-01", None, "b1", "2026-06-02", 0),
    ("a", 1, "https://x/1", "Landing page", "Make a landing now", "25000", None, "RUB", "sites", "5", "2026-06-01", None, "b1", "2026-06-03", 0),
    ("a", 2, None, "Telegram bot", "bot for salon", "0", "30000", "rub", None, "x", "05.06.2026", "order", "b1", "2026-06-02", 1),
    ("b", 3, None, "Parser", "parser of prices", "300", None, "USD", None, None, "1780000000", "order", None, "2026-06-02", 0),
    ("b", 4, None, "Vacancy: python", "we hire", "90000", None, "RUB", None, None, "yesterday", "vacancy", "", "2026-06-02", 1),
    ("b", 5, None, "Old logo", "logo", "100", None, "RUB", None, None, "2024-01-01", "order", None, "2026-06-02", 2),
]
SCHEMA = "source string, source_id long, url string, title string, description string, budget string, budget_max string, currency string, category string, offers string, created string, type string, buyer string, day string, pos int"


def orders(spark, cfg=market.MarketConfig(max_age_days=365)):
    return market.prepare_orders(spark.createDataFrame(ROWS, SCHEMA).withColumn("unit", F.lit("u")), cfg, DAY)


def test_last_snapshot_wins_and_first_day_stays(spark):
    got = {r["id"]: r for r in orders(spark).collect()}
    assert len(got) == 4
    assert got["https://x/1"]["budget"] == 25000 and got["https://x/1"]["first_seen"] == "2026-06-02" and got["https://x/1"]["last_seen"] == "2026-06-03"
    assert got["a:2"]["value"] == 30000 and got["a:2"]["budget"] is None and got["a:2"]["offers"] is None
    assert str(got["a:2"]["date"]) == "2026-06-05" and str(got["b:3"]["date"]) == "2026-05-28" and got["b:4"]["date"] is None


def test_labels_and_currency(spark):
    got = {r["id"]: (r["product"], r["amount"]) for r in orders(spark).collect()}
    assert got == {"https://x/1": ("landing_site", 25000), "a:2": ("telegram_bot", 30000), "b:3": ("parser_scraper", None), "b:4": ("script_tool", 90000)}
    rated = orders(spark, market.MarketConfig(max_age_days=365, rates={"USD": 90}))
    assert {r["id"]: r["amount"] for r in rated.collect()}["b:3"] == 27000
    assert [tuple(r) for r in market.unrated_counts(orders(spark)).collect()] == [("USD", 1)]


def test_intent_before_product(spark):
    text = spark.createDataFrame([("найти клиентов для студии ботов",), ("telegram bot for shop",), ("something",)], "t string")
    assert [r[0] for r in text.select(market.product_label(market.MarketConfig(), F.col("t"))).collect()] == ["leadgen_sales", "telegram_bot", "other"]


def test_stats_skip_vacancies_and_quartiles_are_values(spark):
    rows = [(i, "p", float(i), "order", "d", None, None) for i in (1, 2, 3, 4)] + [(9, "p", 99.0, "vacancy", "d", None, "b")]
    df = spark.createDataFrame(rows, "id int, product string, amount double, type string, description string, offers int, buyer string").withColumn("title", F.lit("t"))
    r = market.order_stats(df.withColumn("id", F.col("id").cast("string")), ["product"]).first()
    assert (r["orders"], r["with_budget"], r["median_budget"], r["p25_budget"], r["p75_budget"], r["distinct"], r["buyers"]) == (5, 4, 2.5, 2.0, 4.0, 1, 1)


def test_terms_count_once_an_order(spark):
    df = spark.createDataFrame([("сайт", "сайт салона салона красоты"), ("", "сайт салона")], "title string, description string")
    got = {(r["kind"], r["term"]): r["orders"] for r in market.order_terms(df).collect()}
    assert got[("word", "салона")] == 2 and got[("word", "сайт")] == 2 and got[("pair", "сайт салона")] == 2 and ("pair", "салона красоты") not in got


def test_dates_and_budgets(spark):
    df = spark.createDataFrame([("2026-05-01T10:00",), ("31.12.2025",), ("1700000000",), ("1700000000000",), ("2 часа назад",), ("2026-13-40",), (None,)], "v string")
    assert [str(r[0]) if r[0] else None for r in df.select(norm.order_date(F.col("v"))).collect()] == ["2026-05-01", "2025-12-31", "2023-11-14", "2023-11-14", None, None, None]
    b = spark.createDataFrame([("до 10 000 ₽",), ("5 000 – 7 000",), ("",)], "v string").select(norm.budget_range(F.col("v")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in b] == [(None, 10000), (5000, 7000), (None, None)]
    n = spark.createDataFrame([("nan",), ("inf",), ("0",), ("-3",), ("7.5",), ("x",)], "v string")
    assert [r[0] for r in n.select(norm.positive_number(F.col("v"))).collect()] == [None, None, None, None, 7.5, None]


def lead(seg, city, site=None, reach=None, tech=(), signals=(), tg=False, phone=True):
    return (seg, city, site, {"telegram": ["t"]} if tg else {}, {"checked": "2026-01-01" if site else None, "reachable": reach, "tech": list(tech)}, [{"type": s} for s in signals], [], ["1"] if phone else [], [seg], None, None)


LEADS = "segment string, city string, website string, socials map<string,array<string>>, site struct<checked:string,reachable:boolean,tech:array<string>>, signals array<struct<type:string>>, emails array<struct<value:string>>, phones array<string>, categories array<string>, rating double, reviews int"


def test_supply_gap(spark):
    rows = [lead("dent", "A", "s1", True), lead("dent", "A", "s2", False), lead("dent", "B", tg=True), lead("dent", "B"), lead(None, None)]
    got = {(r["segment"], r["city"]): r for r in market.supply_table(spark.createDataFrame(rows, LEADS), ["unreachable"]).collect()}
    d = got[("dent", None)]
    assert (d["n"], d["no_own_site_pct"], d["site_issue_pct"], d["gap_pct"], d["messenger_pct"]) == (4, 50.0, 50.0, 75.0, 25.0)
    assert got[("dent", "B")]["gap_pct"] == 100.0 and got[("(none)", "(none)")]["n"] == 1


def test_scores_put_controls_last(spark):
    cfg = market.MarketConfig(segments=(market.Segment("dent", "landing"), market.Segment("none", "zzz"), market.Segment("ctl", "bot", control=True)))
    got = market.segment_scores(orders(spark), spark.createDataFrame([lead("dent", "A", tg=True)], LEADS), cfg).collect()
    assert [r["segment"] for r in got] == ["dent", "none", "ctl"] and got[0]["score"] == 1.0 and got[1]["score"] == 0.0


def test_no_orders(spark):
    none = orders(spark).limit(0)
    assert market.products_table(none).count() == 0 and market.top_terms(none).count() == 0 and market.main_currency(none, market.MarketConfig()) is None


def test_clusters_are_counted_and_hits_are_rows(spark):
    cfg = market.MarketConfig(max_age_days=365, clusters=(market.Rule("pages", "landing|parser"), market.Rule("none", "zzz")))
    table = market.clusters_table(orders(spark, cfg), cfg)
    assert {r["cluster"]: (r["n_urls"], r["n_titles"]) for r in table.select("cluster", "n_urls", "n_titles").collect()} == {"pages": (1, 2), "none": (0, 0)}
    assert not any(t.startswith("array") for _, t in table.dtypes)
    assert sorted((r["cluster"], r["url"], r["title"]) for r in market.cluster_hits(orders(spark, cfg), cfg).collect() if r["url"]) == [("pages", "https://x/1", "Landing page")]


def test_rules_that_cannot_be_used_are_named(spark):
    bad = [
        market.MarketConfig(products=(market.Rule("p", "("),)), market.MarketConfig(clusters=(market.Rule("c", ""),)), market.MarketConfig(clusters=(market.Rule("c", "[a"),)),
        market.MarketConfig(segments=(market.Segment("s", "ok", supply="*"),)), market.MarketConfig(segments=(market.Segment("", "ok"),)), market.MarketConfig(gap_metric="top_tech"), market.MarketConfig(reach_metric="nothing"),
    ]
    for cfg in bad:
        try:
            market.prepare_orders(spark.createDataFrame(ROWS, SCHEMA).withColumn("unit", F.lit("u")), cfg, DAY)
        except market.MarketError as e:
            assert any(x in str(e) for x in ("p", "c", "s", "top_tech", "nothing"))
            continue
        raise AssertionError(cfg)


def test_quantiles_of_any_values(spark):
    import random

    random.seed(3)
    groups = {"a": [random.uniform(-50, 50) for _ in range(101)], "b": [5.0] * 7, "c": [1.0, 2.0], "d": [-3.5], None: [0.0, 0.0, 10.0], "e": [random.choice([100.0, 100.01, 100.02]) for _ in range(40)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    got = {r["k"]: r for r in market.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert (got[k]["n"], got[k]["p25"], got[k]["p75"]) == (n, s[min(n - 1, n // 4)], s[min(n - 1, n * 3 // 4)]) and got[k]["median"] == (s[(n - 1) // 2] + s[n // 2]) / 2
