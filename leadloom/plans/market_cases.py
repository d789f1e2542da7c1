"""Market queries over the given tables, with the SQL that they equal.

Orders stand for demand: each is an order of a feed that was collected on two days, a third of them edited on the
second. Customers stand for businesses of a segment and a city.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.operators import market

AS_OF = datetime.date(2001, 8, 2)
CONFIG = market.MarketConfig(
    products=(
        market.Rule("urgent_build", r"urgent.*building|building.*urgent"),
        market.Rule("machines", r"machinery|furnitur"),
        market.Rule("vehicles", r"automobile"),
    ),
    clusters=(
        market.Rule("high", r"high", ("machines", "vehicles")),
        market.Rule("batch_seven", r"batch 7\b"),
        market.Rule("nothing", r"no such words"),
    ),
    segments=(
        market.Segment("BUILDING", r"building"),
        market.Segment("AUTOMOBILE", r"automobile", supply=r"^auto"),
        market.Segment("MACHINERY", r"machinery", product=("machines",)),
        market.Segment("HOUSEHOLD", r"household", control=True),
        market.Segment("SPACE", r"space"),
    ),
    rates={"EUR": 2, "RUB": 4},
    max_age_days=2000,
    exclude_types=("archived",),
    site_issues=("unreachable", "no_https"),
    weights={"demand": 0.4, "gap": 0.3, "reach": 0.2, "competition": 0.1},
)


def demand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw demand rows of two days."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("o_orderkey")
    created = (
        F.when(k % 5 == 4, F.lit("yesterday"))
        .when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
        .when(k % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.when(k % 2 == 0, "feed_a").otherwise("feed_b").alias("source"),
        k.alias("source_id"),
        F.when(k % 4 == 1, F.concat(F.lit("https://orders.example.org/"), k.cast("string"))).alias("url"),
        F.concat(F.lit("<b>"), "o_orderpriority", F.lit("</b>  "), "c_mktsegment").alias("title"),
        F.when(k % 6 != 5, F.concat(F.lit("Need "), "c_mktsegment", F.lit(" works &amp; parts batch "), (k % 50).cast("string"))).alias("description"),
        F.when(k % 7 != 0, F.col("o_totalprice")).cast("string").alias("budget"),
        F.when(k % 7 <= 1, F.col("o_totalprice") * 2).cast("string").alias("budget_max"),
        F.element_at(F.array(F.lit("usd"), F.lit("EUR"), F.lit("rub"), F.lit("GBP"), F.lit(None).cast("string")), (F.pmod(F.col("c_nationkey"), F.lit(5)) + 1).cast("int")).alias("currency"),
        F.col("c_mktsegment").alias("category"),
        F.when(k % 8 < 6, (k % 8).cast("string")).alias("offers"),
        created.alias("created"),
        F.when(F.col("o_orderstatus") == "P", "vacancy").when(k % 11 == 0, "archived").when(k % 11 == 1, "tender").alias("type"),
        F.when(k % 9 != 0, F.col("o_custkey").cast("string")).alias("buyer"),
    )
    first = rows.withColumns({"day": F.lit("2024-01-01"), "unit": F.lit("u1"), "pos": F.lit(0)})
    second = rows.filter(F.col("source_id") % 3 == 0).withColumns({"budget": (F.col("budget").cast("double") + 1000).cast("string"), "day": F.lit("2024-01-02"), "unit": F.lit("u1"), "pos": F.lit(0)})
    return first.unionByName(second)


_ORDERS = r"""
WITH rows AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS source,
    CASE WHEN o_orderkey % 4 = 1 THEN 'https://orders.example.org/' || o_orderkey ELSE NULL END AS url,
    CASE WHEN o_orderkey % 4 = 1 THEN 'https://orders.example.org/' || o_orderkey
      ELSE (CASE WHEN o_orderkey % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END) || ':' || o_orderkey END AS id,
    o_orderpriority || ' ' || c_mktsegment AS title,
    CASE WHEN o_orderkey % 6 <> 5 THEN 'Need ' || c_mktsegment || ' works & parts batch ' || (o_orderkey % 50) ELSE '' END AS description,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 0 END END AS budget,
    CASE WHEN o_orderkey % 7 <= 1 THEN o_totalprice * 2 END AS budget_max,
    ['USD', 'EUR', 'RUB', 'GBP', NULL][c_nationkey % 5 + 1] AS currency,
    c_mktsegment AS category,
    CASE WHEN o_orderkey % 8 < 6 THEN CAST(o_orderkey % 8 AS INTEGER) END AS offers,
    CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderstatus = 'P' THEN 'vacancy' WHEN o_orderkey % 11 = 0 THEN 'archived' WHEN o_orderkey % 11 = 1 THEN 'tender' ELSE 'order' END AS type,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS buyer,
    '2024-01-01' AS first_seen, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS last_seen
  FROM orders JOIN customer ON o_custkey = c_custkey
), loaded AS (
  SELECT *, coalesce(budget, budget_max) AS value, lower(title || ' ' || description || ' ' || category) AS text FROM rows
), current AS (
  SELECT * FROM loaded WHERE type <> 'archived' AND (date IS NULL OR date >= DATE '2001-08-02' - 2000)
), main AS (
  SELECT currency AS main_currency FROM current WHERE value IS NOT NULL AND currency IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), prepared AS (
  SELECT *, CASE WHEN value IS NULL THEN NULL WHEN currency = main_currency THEN value WHEN currency = 'EUR' THEN round(value * 2, 2) WHEN currency = 'RUB' THEN round(value * 4, 2) END AS amount,
    CASE WHEN regexp_matches(text, 'urgent.*building|building.*urgent') THEN 'urgent_build' WHEN regexp_matches(text, 'machinery|furnitur') THEN 'machines'
      WHEN regexp_matches(text, 'automobile') THEN 'vehicles' ELSE 'other' END AS product,
    coalesce(nullif(left(regexp_replace(lower(CASE WHEN description <> '' THEN description ELSE title END), '[^a-z0-9_]+', '', 'g'), 200), ''), id) AS text_key
  FROM current, main
)"""

_STATS = """count(*) AS orders, count(DISTINCT text_key) AS "distinct", nullif(count(DISTINCT buyer), 0) AS buyers,
  count(paid) AS with_budget, median(paid) AS median_budget,
  list_sort(list(paid) FILTER (paid IS NOT NULL))[least(count(paid), CAST(floor(count(paid) * 0.25) AS BIGINT) + 1)] AS p25_budget,
  list_sort(list(paid) FILTER (paid IS NOT NULL))[least(count(paid), CAST(floor(count(paid) * 0.75) AS BIGINT) + 1)] AS p75_budget,
  median(offers) AS median_offers"""
_PAID = "SELECT *, CASE WHEN amount <> 0 AND type <> 'vacancy' THEN amount END AS paid FROM prepared"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.prepare_orders(demand_rows(spark, sf_dir), CONFIG, AS_OF)


def market_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots folded to orders, filtered, labelled and converted."""
    return prepared(spark, sf_dir).select(
        "id", "source", "url", "title", "description", "category", "budget", "budget_max", "value", "currency", "offers", "type",
        F.col("date").cast("string").alias("date"), "buyer", "first_seen", "last_seen", "product", "amount",
    )


def market_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left out, by reason."""
    return market.drop_counts(market.latest_orders(market.normalize_orders(demand_rows(spark, sf_dir))), CONFIG, AS_OF)


def market_unrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a rate, by currency."""
    return market.unrated_counts(prepared(spark, sf_dir))


def market_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products table; sources as one text."""
    table = market.products_table(prepared(spark, sf_dir))
    return table.withColumn("sources", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"))


def market_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters table; links and titles as counts."""
    table = market.clusters_table(prepared(spark, sf_dir), CONFIG)
    return table.select(
        "cluster", "orders", "distinct", "buyers", "with_budget", "median_budget", "p25_budget", "p75_budget", "median_offers", "share_pct",
        F.col("n_urls").cast("int").alias("n_urls"), F.col("n_titles").cast("int").alias("n_titles"),
    )


def market_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a cluster above an amount that a pattern finds."""
    out = market.select_orders(prepared(spark, sf_dir), CONFIG, product=["machines"], cluster="high", pattern="batch 1|batch 2", source=["feed_a"], min_budget=20000)
    return out.select("id", "amount", "product")


def market_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty orders with the largest amounts."""
    return market.top_orders(prepared(spark, sf_dir), 20).select("id", "amount")


def market_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty most common words and pairs of the documents, taken as orders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return market.top_terms(docs.select(F.lit("").alias("title"), F.col("text").alias("description")), 40).select("kind", "term", "orders", "rank")


def market_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by source and their snapshot days."""
    return market.source_counts(prepared(spark, sf_dir)).withColumn("snapshots", F.array_join("snapshots", ","))


def business_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads with contacts and site facts drawn from their keys."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    social = lambda cond, name: F.when(cond, F.create_map(F.lit(name), F.array(F.concat(F.lit("https://s.example.org/"), k.cast("string"))))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        k.cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.when(k % 13 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(k % 17 != 0, F.col("n_name")).alias("city"),
        F.when(k % 3 != 0, F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".org"))).alias("website"),
        F.map_concat(social(k % 4 == 0, "telegram"), social(k % 5 == 0, "vk")).alias("socials"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("7900"), F.lpad(k.cast("string"), 7, "0")))).otherwise(F.array().cast("array<string>")).alias("phones"),
        F.when(k % 6 != 0, F.array(F.struct(F.concat(F.lit("info@site"), k.cast("string"), F.lit(".org")).alias("value"), F.lit("generic").alias("type"), F.when(k % 12 == 1, "mx").otherwise("none").alias("verified")))).otherwise(F.array().cast("array<struct<value:string,type:string,verified:string>>")).alias("emails"),
        F.struct(
            F.when(k % 4 != 1, F.lit("2024-01-01")).alias("checked"),
            (k % 10 != 2).alias("reachable"),
            F.filter(F.array(F.when(k % 2 == 0, "wordpress"), F.when(k % 5 == 1, "shopify"), F.when(k % 7 == 1, "react")), lambda x: x.isNotNull()).alias("tech"),
        ).alias("site"),
        F.when(k % 8 == 5, F.array(F.struct(F.lit("no_https").alias("type"), none.alias("value"), none.alias("source"), none.alias("date")))).otherwise(F.array().cast("array<struct<type:string,value:string,source:string,date:string>>")).alias("signals"),
        F.array(F.lower("c_mktsegment"), F.when(k % 2 == 0, "shop").otherwise("office")).alias("categories"),
        F.when(k % 9 != 0, (k % 50) / 10.0).alias("rating"),
        F.when(k % 10 != 0, k % 100).alias("reviews"),
        F.col("c_acctbal").alias("balance"),
    )


_LEADS = """leads AS (
  SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END, '(none)') AS segment, coalesce(CASE WHEN c_custkey % 17 <> 0 THEN n_name END, '(none)') AS city,
    c_custkey % 3 <> 0 AS own, c_custkey % 3 = 0 AND (c_custkey % 4 = 0 OR c_custkey % 5 = 0) AS social_only, c_custkey % 4 = 0 AS messenger, c_custkey % 2 = 0 AS phone, c_custkey % 6 <> 0 AS email,
    c_custkey % 3 <> 0 AND c_custkey % 4 <> 1 AS crawled, c_custkey % 3 <> 0 AND c_custkey % 4 <> 1 AND (c_custkey % 10 = 2 OR c_custkey % 8 = 5) AS issue,
    CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 50 <> 0 THEN (c_custkey % 50) / 10.0 END AS rating, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 100 END AS reviews, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
_SUPPLY = """count(*) AS n, round(100.0 * count_if(own) / count(*), 1) AS own_site_pct, round(100.0 * count_if(NOT own) / count(*), 1) AS no_own_site_pct,
  round(100.0 * count_if(social_only) / count(*), 1) AS social_only_pct, round(100.0 * count_if(messenger) / count(*), 1) AS messenger_pct,
  round(100.0 * count_if(phone) / count(*), 1) AS phone_pct, round(100.0 * count_if(email) / count(*), 1) AS email_pct, count_if(crawled) AS sites_crawled,
  CASE WHEN count_if(crawled) > 0 THEN round(100.0 * count_if(issue) / count_if(crawled), 1) END AS site_issue_pct,
  round(round(100.0 * count_if(NOT own) / count(*), 1) + coalesce(round(100.0 * count_if(issue) / nullif(count_if(crawled), 0), 1), 0) * (1 - round(100.0 * count_if(NOT own) / count(*), 1) / 100), 1) AS gap_pct,
  round(median(rating), 2) AS median_rating, median(reviews) AS median_reviews"""


def market_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply of segments and of their cities."""
    return market.supply_table(business_leads(spark, sf_dir), CONFIG.site_issues)


def market_top_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies that most sites of a segment use."""
    return market.top_tech(business_leads(spark, sf_dir))


def market_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments ranked by demand, gap, reach and competition."""
    out = market.segment_scores(prepared(spark, sf_dir), business_leads(spark, sf_dir), CONFIG)
    return out.drop("note")


QUERIES = {
    f.__name__: f
    for f in (
        market_orders, market_drops, market_unrated, market_products, market_clusters, market_select, market_top_orders,
        market_terms, market_sources, market_supply, market_top_tech, market_scores,
    )
}

ORACLES = {
    "market_orders": _ORDERS + """
SELECT id, source, url, title, description, category, budget, budget_max, value, currency, offers, type, CAST(date AS VARCHAR) AS date, buyer, first_seen, last_seen, product, amount FROM prepared""",
    "market_drops": _ORDERS + """
SELECT reason, count(*) AS orders FROM (SELECT CASE WHEN type = 'archived' THEN 'excluded_type' WHEN date < DATE '2001-08-02' - 2000 THEN 'older' END AS reason FROM loaded) WHERE reason IS NOT NULL GROUP BY 1""",
    "market_unrated": _ORDERS + """
SELECT coalesce(currency, 'unknown') AS currency, count(*) AS orders FROM prepared WHERE value IS NOT NULL AND amount IS NULL GROUP BY 1""",
    "market_products": _ORDERS + f""", paid AS ({_PAID}), per AS (SELECT product, source, count(*) AS k FROM prepared GROUP BY 1, 2)
SELECT product, {_STATS}, round(100.0 * count(*) / (SELECT count(*) FROM prepared), 1) AS share_pct,
  (SELECT string_agg(source || '=' || k, ';' ORDER BY source) FROM per WHERE per.product = paid.product) AS sources
FROM paid GROUP BY product""",
    "market_clusters": _ORDERS + f""", paid AS ({_PAID}), rules AS (SELECT unnest(['high', 'batch_seven', 'nothing']) AS rule),
hits AS (
  SELECT 'high' AS rule, * FROM paid WHERE text LIKE '%high%' AND product IN ('machines', 'vehicles')
  UNION ALL SELECT 'batch_seven', * FROM paid WHERE regexp_matches(text, 'batch 7([^a-z0-9_]|$)')
), grouped AS (SELECT rule, {_STATS}, count(url) AS n_urls FROM hits GROUP BY rule)
SELECT rule AS cluster, coalesce(orders, 0) AS orders, coalesce("distinct", 0) AS "distinct", buyers, coalesce(with_budget, 0) AS with_budget, median_budget, p25_budget, p75_budget, median_offers,
  coalesce(round(100.0 * orders / (SELECT count(*) FROM prepared), 1), 0) AS share_pct, coalesce(n_urls, 0) AS n_urls, coalesce(orders, 0) AS n_titles
FROM rules LEFT JOIN grouped USING (rule)""",
    "market_select": _ORDERS + """
SELECT id, amount, product FROM prepared WHERE text LIKE '%high%' AND product = 'machines' AND (text LIKE '%batch 1%' OR text LIKE '%batch 2%') AND source = 'feed_a' AND amount >= 20000""",
    "market_top_orders": _ORDERS + """
SELECT id, amount FROM prepared ORDER BY amount DESC NULLS LAST, id LIMIT 20""",
    "market_sources": _ORDERS + """
SELECT source, count(*) AS orders, string_agg(DISTINCT last_seen, ',' ORDER BY last_seen) AS snapshots FROM prepared GROUP BY 1""",
    "market_supply": f"""WITH {_LEADS}
SELECT segment, city, {_SUPPLY} FROM leads GROUP BY GROUPING SETS ((segment, city), (segment))""",
    "market_top_tech": f"""WITH {_LEADS}, used AS (
  SELECT segment, unnest(list_filter([CASE WHEN k % 2 = 0 THEN 'wordpress' END, CASE WHEN k % 5 = 1 THEN 'shopify' END, CASE WHEN k % 7 = 1 THEN 'react' END], lambda x: x IS NOT NULL)) AS tech FROM leads WHERE crawled
), counted AS (SELECT segment, tech, count(*) AS sites FROM used GROUP BY 1, 2)
SELECT segment, tech, sites, row_number() OVER (PARTITION BY segment ORDER BY sites DESC, tech) AS rank,
  round(100.0 * sites / (SELECT count(*) FROM leads WHERE crawled AND leads.segment = counted.segment), 1) AS pct FROM counted""",
    "market_scores": _ORDERS + f""", {_LEADS}, paid AS ({_PAID}),
names(segment, control) AS (VALUES ('BUILDING', false), ('AUTOMOBILE', false), ('MACHINERY', false), ('HOUSEHOLD', true), ('SPACE', false)),
hits AS (
  SELECT 'BUILDING' AS segment, * FROM paid WHERE text LIKE '%building%' UNION ALL SELECT 'AUTOMOBILE', * FROM paid WHERE text LIKE '%automobile%'
  UNION ALL SELECT 'MACHINERY', * FROM paid WHERE text LIKE '%machinery%' AND product = 'machines' UNION ALL SELECT 'HOUSEHOLD', * FROM paid WHERE text LIKE '%household%'
), demand AS (SELECT segment, {_STATS} FROM hits GROUP BY 1),
supplied AS (
  SELECT * REPLACE ('AUTOMOBILE' AS segment) FROM leads WHERE segment = 'AUTOMOBILE' OR (segment = '(none)' AND c_mktsegment = 'NEVER')
  UNION ALL SELECT * FROM leads WHERE segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
), supply AS (SELECT segment, {_SUPPLY} FROM supplied GROUP BY 1),
t AS (
  SELECT segment, control, coalesce(orders, 0) AS demand_orders, coalesce("distinct", 0) AS demand_distinct, buyers, median_budget, coalesce(with_budget, 0) AS with_budget, median_offers,
    coalesce(n, 0) AS businesses, gap_pct AS gap, messenger_pct AS reach
  FROM names LEFT JOIN demand USING (segment) LEFT JOIN supply USING (segment)
), m AS (
  SELECT coalesce(nullif(max(demand_distinct) FILTER (NOT control), 0), 1) AS d, coalesce(nullif(max(coalesce(gap, 0)) FILTER (NOT control), 0), 1) AS g,
    coalesce(nullif(max(coalesce(reach, 0)) FILTER (NOT control), 0), 1) AS r, coalesce(nullif(max(coalesce(median_offers, 0)) FILTER (NOT control), 0), 1) AS o FROM t
)
SELECT t.*, round(demand_distinct / d, 3) AS demand_part, round(coalesce(gap, 0) / g, 3) AS gap_part, round(coalesce(reach, 0) / r, 3) AS reach_part, round(-coalesce(median_offers, 0) / o, 3) + 0.0 AS competition_part,
  round(0.4 * demand_distinct / d + 0.3 * coalesce(gap, 0) / g + 0.2 * coalesce(reach, 0) / r - 0.1 * coalesce(median_offers, 0) / o, 3) AS score
FROM t, m""",
    "market_terms": r"""WITH t AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{L}{3,}'), lambda w: NOT list_contains([""" + ", ".join("'" + w.replace("'", "''") + "'" for w in P.STOP_WORDS) + r"""], w)) AS w FROM documents
), found AS (
  SELECT DISTINCT 'word' AS kind, doc_id, unnest(list_filter(w, lambda x: length(x) >= 4)) AS term FROM t
  UNION ALL SELECT DISTINCT 'pair', doc_id, a || ' ' || b FROM (SELECT doc_id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM t WHERE len(w) > 1) WHERE a <> b
), counted AS (SELECT kind, term, count(*) AS orders FROM found GROUP BY 1, 2)
SELECT * FROM (SELECT kind, term, orders, row_number() OVER (PARTITION BY kind ORDER BY orders DESC, term) AS rank FROM counted WHERE kind = 'word' OR orders > 1) WHERE rank <= 40""",
}
