"""Lead queries over the given tables, with the SQL that they equal: resolution, scoring, export, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.operators import export, incremental, report, resolve, rules
from leadloom.plans.market_cases import business_leads
from leadloom.plans.storage import bucketed, shared_dir


def raw_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw rows of two sources; some share a phone, some a site, some a name in a city."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("pos"),
        F.when(k % 2 == 0, "maps").otherwise("registry").alias("source"),
        text(k).alias("source_id"),
        F.concat(F.lit("https://list.example.org/"), text(k)).alias("url"),
        F.concat(F.lit("Firm "), text(k % 700), F.lit(" LLC")).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("https://www.Site"), text(F.floor(k / 5)), F.lit(".org/home?x=1"))).when(k % 3 == 1, F.concat(F.lit("https://t.me/firm"), text(k))).alias("website"),
        F.when(k % 4 != 3, F.col("n_name")).alias("city"),
        F.array(F.when(k % 2 == 0, F.concat(F.lit("+7 (900) "), F.lpad(text(F.floor(k / 4)), 7, "0"))), F.when(k % 5 == 0, F.concat(F.lit("8 901 "), F.lpad(text(k), 7, "0")))).alias("phones"),
        F.array(F.concat(F.lit("mailto:Info@site"), text(F.floor(k / 5)), F.lit(".org?subject=x"))).alias("emails"),
        F.array(F.lower("c_mktsegment")).alias("categories"),
        F.col("c_mktsegment").alias("segment"),
        F.when(k % 9 != 0, (k % 50) / 10.0).alias("rating"),
        F.when(k % 10 != 0, k % 100).alias("reviews"),
        F.lit("2024-01-01").alias("collected"),
    )


_RAW = """raw AS (
  SELECT c_custkey AS pos, 'Firm ' || (c_custkey % 700) || ' LLC' AS name, 'firm ' || (c_custkey % 700) AS norm_name, CASE WHEN c_custkey % 3 = 0 THEN 'https://www.Site' || (c_custkey // 5) || '.org/home?x=1' END AS website,
    CASE WHEN c_custkey % 3 = 0 THEN 'site' || (c_custkey // 5) || '.org' END AS domain, CASE WHEN c_custkey % 4 <> 3 THEN n_name END AS city,
    list_filter([CASE WHEN c_custkey % 2 = 0 THEN '7900' || lpad(CAST(c_custkey // 4 AS VARCHAR), 7, '0') END, CASE WHEN c_custkey % 5 = 0 THEN '7901' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END], lambda x: x IS NOT NULL) AS phones,
    'info@site' || (c_custkey // 5) || '.org' AS email, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 50) / 10.0 END AS rating, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 100 END AS reviews
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), shared AS (
  SELECT pos, 'd:' || domain AS key FROM raw WHERE domain IS NOT NULL
  UNION ALL SELECT pos, 'p:' || unnest(phones) FROM raw
  UNION ALL SELECT pos, 'n:' || norm_name || '|' || lower(city) FROM raw WHERE city IS NOT NULL
), keyed AS (
  SELECT * FROM shared UNION ALL
  SELECT pos, 'id:h-' || left(sha1(norm_name || '|' || lower(coalesce(city, '')) || '|' || coalesce(phones[1], '')), 12) FROM raw WHERE pos NOT IN (SELECT pos FROM shared)
), edges AS (SELECT DISTINCT a.pos AS a, b.pos AS b FROM keyed a JOIN keyed b USING (key)),
reach AS (
  SELECT pos AS a, pos AS b FROM raw UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), parts AS (SELECT a AS pos, min(b) AS component FROM reach GROUP BY 1)"""


def lead_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the business that they belong to."""
    return resolve.entity_components(resolve.normalize_businesses(raw_businesses(spark, sf_dir)))


def lead_key_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that each key connects."""
    return resolve.key_degrees(resolve.normalize_businesses(raw_businesses(spark, sf_dir)))


def lead_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses folded from their records."""
    return _lead_columns(resolve.resolve(raw_businesses(spark, sf_dir)))


def lead_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same businesses, resolved by increments: records that come later join what is there."""
    root, raw = shared_dir(spark, "resolution"), raw_businesses(spark, sf_dir)
    for number, part in enumerate((F.col("pos") % 10 < 7, F.col("pos") % 10 >= 7)):
        incremental.add_records(raw.filter(part), root, number, buckets=4)
    return _lead_columns(incremental.resolved_leads(spark, root))


def _lead_columns(leads: DataFrame) -> DataFrame:
    return leads.select(
        "id", "name", "website", "domain", "city", "rating", "reviews", "n_records", F.array_join("phones", ",").alias("phones"), F.array_join("names", ",").alias("names"),
        F.array_join(F.transform("emails", lambda e: e["value"]), ",").alias("emails"), F.size("sources").alias("n_sources"), F.coalesce(F.size(F.try_element_at("socials", F.lit("telegram"))), F.lit(0)).alias("n_telegram"),
    )


def lead_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New leads of a segment joined with scored leads of the run before."""
    return _carried(*_two_runs(spark, sf_dir))


def bucketed_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over tables in buckets by lead: neither side is shuffled."""
    new, old = _two_runs(spark, sf_dir)
    return _carried(bucketed(new, "new-leads", "id", 8), bucketed(old, "old-leads", "id", 8))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    leads = business_leads(spark, sf_dir)
    old = leads.filter(F.col("id").cast("long") % 3 == 0).select("id", "phones", F.lit("A").alias("tier"), F.lit("sent").alias("status"))
    return leads.filter(F.col("id").cast("long") % 2 == 0).select("id", "name", F.array(F.lit("111")).alias("phones")), old


def _carried(new: DataFrame, old: DataFrame) -> DataFrame:
    out = resolve.carry_over(new, old)
    return out.select("id", "name", "tier", "status", F.array_join("phones", ",").alias("phones"))


RULES = [
    rules.ScoreRule("own_site", 20, has="website"),
    rules.ScoreRule("no_mail", -10, missing="emails"),
    rules.ScoreRule("reviewed", 15, field="reviews", gte=20),
    rules.ScoreRule("few_reviews", 5, field="reviews", lte=5),
    rules.ScoreRule("mail_checked", 12, field="emails.verified", eq="mx"),
    rules.ScoreRule("not_generic", 3, field="emails.type", ne="generic"),
    rules.ScoreRule("north", 7, field="city", in_=("CANADA", "RUSSIA", "GERMANY")),
    rules.ScoreRule("uni", 4, field="city", contains="united"),
    rules.ScoreRule("ten", 6, field="name", matches=r"0$"),
    rules.ScoreRule("insecure", 9, signal=("no_https", "broken_ssl")),
    rules.ScoreRule("shop_system", 8, tech=("shopify", "wix")),
    rules.ScoreRule("machines", 11, category=r"machin|shop$"),
    rules.ScoreRule("unreachable", 0, disqualify=True, field="site.reachable", eq=False),
]
TIERS = {"A": 50, "B": 35, "C": 15}

_SCORED = """facts AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS segment, c_mktsegment,
    CASE WHEN c_custkey % 17 <> 0 THEN n_name END AS city, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 100 END AS reviews
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), hits AS (
  SELECT *, k % 3 <> 0 AS own_site, k % 6 = 0 AS no_mail, coalesce(reviews >= 20, false) AS reviewed, coalesce(reviews <= 5, false) AS few_reviews, k % 6 <> 0 AND k % 12 = 1 AS mail_checked, k % 6 = 0 AS not_generic,
    coalesce(city IN ('CANADA', 'RUSSIA', 'GERMANY'), false) AS north, coalesce(city ILIKE '%united%', false) AS uni, name LIKE '%0' AS ten, k % 8 = 5 AS insecure, k % 5 = 1 AS shop_system,
    lower(c_mktsegment) LIKE '%machin%' OR regexp_matches(lower(c_mktsegment) || ' | ' || CASE WHEN k % 2 = 0 THEN 'shop' ELSE 'office' END || ' | ' || lower(coalesce(segment, '')), 'machin|shop$') AS machines,
    k % 10 = 2 AS unreachable
  FROM facts
), scored AS (
  SELECT *, CAST(20 * own_site::INT - 10 * no_mail::INT + 15 * reviewed::INT + 5 * few_reviews::INT + 12 * mail_checked::INT + 3 * not_generic::INT + 7 * north::INT + 4 * uni::INT + 6 * ten::INT + 9 * insecure::INT + 8 * shop_system::INT + 11 * machines::INT AS DOUBLE) AS score
  FROM hits
), tiered AS (
  SELECT *, CASE WHEN unreachable THEN 'D' WHEN score >= 50 THEN 'A' WHEN score >= 35 THEN 'B' WHEN score >= 15 THEN 'C' ELSE 'D' END AS tier FROM scored
)"""


def scored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_leads(business_leads(spark, sf_dir), RULES, TIERS)


def lead_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, tier and number of matching rules of each lead."""
    return scored_leads(spark, sf_dir).select("id", "score", "tier", F.size("score_breakdown").alias("n_rules"))


def lead_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by tier and by rule."""
    return rules.score_summary(scored_leads(spark, sf_dir), RULES)


def lead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat, guarded cells of leads of tier B or better that have an address."""
    leads = scored_leads(spark, sf_dir).withColumns({"status": F.lit("new"), "notes": F.when(F.col("id").cast("long") % 2 == 0, F.lit("=SUM(A1)")).otherwise(F.lit(" -1")), "sources": F.array(F.struct(F.lit("maps").alias("source")))})
    chosen = export.select_leads(leads, min_tier="B", has_email=True, status="new")
    return export.guard_cells(export.flatten_leads(chosen)).select("id", "tier", "score", "name", "website", "city", "categories", "email", "phone", "telegram", "site_tech", "site_reachable", "sources", "notes")


def lead_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows that have each field, by source."""
    return report.fill_rates(raw_businesses(spark, sf_dir), ["website", "city", "phones", "rating", "reviews"])


def lead_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that still lack a crawl of their site."""
    return business_leads(spark, sf_dir).filter(rules.needs_step("site")).select("id", "website")


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and own-site flag of each page, and its link without tracking."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", norm.host(F.col("url")).alias("host"), norm.is_own_site(F.col("url")).alias("own"), norm.strip_tracking(F.concat("url", F.lit("&utm_source=a&yclid=7"))).alias("clean"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones, addresses, keys, checksums and guards over the suppliers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    text = k.cast("string")
    inn = F.lpad((k * 1234567).cast("string"), 10, "7")
    return s.select(
        k.alias("k"),
        norm.phone_digits(F.concat(F.lit("8 (900) 1"), F.lpad(text, 6, "0"))).alias("phone"),
        norm.phone_digits(F.concat(F.lit("0"), F.lpad(text, 6, "5")), "49").alias("local_phone"),
        norm.clean_email(F.concat(F.lit(" <Sales@Firm"), text, F.lit(".org>,"))).alias("email"),
        norm.email_type(F.concat(F.when(k % 2 == 0, "info").otherwise("ann"), F.lit("@a.org"))).alias("mail_type"),
        norm.norm_name(F.concat(F.lit("«Acme» "), text, F.lit(" GmbH, Ltd."))).alias("name"),
        norm.inn_ok(inn).alias("inn_ok"),
        norm.unit_key(F.concat(F.lit("/a b/"), text, F.lit("?!"))).alias("unit"),
        norm.csv_guard(F.concat(F.when(k % 3 == 0, " =").when(k % 3 == 1, "x=").otherwise("@"), text)).alias("cell"),
        norm.suppression_key(F.concat(F.when(k % 3 == 0, "@Spam").when(k % 3 == 1, "Bob@Spam").otherwise("www.spam"), text, F.lit(".org  # left")), None).alias("blocked"),
        norm.budget_range(F.concat(F.when(k % 2 == 0, "до 10 000").otherwise("5 000 – 1"), text)).getField("budget_max").alias("budget_max"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        lead_components, lead_key_degrees, lead_resolve, lead_increments, lead_carry_over, bucketed_carry_over, lead_scores, lead_score_summary, lead_export, lead_fill_rates, lead_needs, url_hosts, scalar_functions,
    )
}

_INN = " + ".join(f"CAST(substr(inn, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate([2, 4, 10, 3, 5, 9, 4, 6, 8]))

ORACLES = {
    "lead_components": f"WITH RECURSIVE {_RAW}\nSELECT pos, component FROM parts",
    "lead_key_degrees": f"WITH RECURSIVE {_RAW}\nSELECT key, count(DISTINCT pos) AS records FROM keyed GROUP BY 1",
    "lead_resolve": f"""WITH RECURSIVE {_RAW}, m AS (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY domain IS NULL, -coalesce(reviews, 0), pos) AS o FROM raw JOIN parts USING (pos)
), ph AS (SELECT component, phone, min(o * 10 + i) AS p FROM (SELECT component, o, unnest(phones) AS phone, unnest(range(1, len(phones) + 1)) AS i FROM m) GROUP BY 1, 2
), phs AS (SELECT component, string_agg(phone, ',' ORDER BY p) AS phones, arg_min(phone, p) AS phone FROM ph GROUP BY 1
), nm AS (SELECT component, string_agg(name, ',' ORDER BY o) AS names FROM (SELECT component, name, min(o) AS o FROM m GROUP BY 1, 2) GROUP BY 1
), em AS (SELECT component, string_agg(email, ',' ORDER BY o) AS emails FROM (SELECT component, email, min(o) AS o FROM m GROUP BY 1, 2) GROUP BY 1
), g AS (
  SELECT component, arg_min(name, o) AS name, arg_min(norm_name, o) AS norm_name, arg_min(website, o) FILTER (website IS NOT NULL) AS website, arg_min(domain, o) FILTER (domain IS NOT NULL) AS domain, arg_min(city, o) FILTER (city IS NOT NULL) AS city,
    max(rating) AS rating, max(reviews) AS reviews, count(*) AS n_records, count_if(pos % 3 = 1) AS n_telegram FROM m GROUP BY 1
)
SELECT coalesce(domain, 'h-' || left(sha1(norm_name || '|' || lower(coalesce(city, '')) || '|' || coalesce(phone, '')), 12)) AS id, name, website, domain, city, rating, reviews, n_records, coalesce(phones, '') AS phones, names, emails,
  n_records AS n_sources, n_telegram FROM g LEFT JOIN phs USING (component) LEFT JOIN nm USING (component) LEFT JOIN em USING (component)""",
    "lead_carry_over": """WITH l AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 2 = 0 THEN '7900' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone FROM customer)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 2 = 0 THEN c_name END AS name, CASE WHEN k % 3 = 0 THEN 'A' END AS tier, CASE WHEN k % 3 = 0 THEN 'sent' END AS status,
  concat_ws(',', CASE WHEN k % 2 = 0 THEN '111' END, CASE WHEN k % 3 = 0 THEN phone END) AS phones FROM l WHERE k % 2 = 0 OR k % 3 = 0""",
    "lead_scores": f"""WITH {_SCORED} SELECT id, score, tier,
  own_site::INT + no_mail::INT + reviewed::INT + few_reviews::INT + mail_checked::INT + not_generic::INT + north::INT + uni::INT + ten::INT + insecure::INT + shop_system::INT + machines::INT + unreachable::INT AS n_rules FROM tiered""",
    "lead_score_summary": f"""WITH {_SCORED}, t AS (SELECT 'tier' AS kind, unnest(['A', 'B', 'C', 'D']) AS name)
SELECT kind, name, (SELECT count(*) FROM tiered WHERE tier = t.name) AS leads FROM t
UNION ALL SELECT 'rule', name, leads FROM (UNPIVOT (SELECT """ + ", ".join(f"count_if({r.name}) AS {r.name}" for r in RULES) + """ FROM tiered) ON COLUMNS(*) INTO NAME name VALUE leads)""",
    "lead_export": f"""WITH {_SCORED} SELECT id, tier, score, name, CASE WHEN k % 3 <> 0 THEN 'https://www.site' || k || '.org' END AS website, city,
  lower(c_mktsegment) || '; ' || CASE WHEN k % 2 = 0 THEN 'shop' ELSE 'office' END AS categories, 'info@site' || k || '.org' AS email, CASE WHEN k % 2 = 0 THEN '7900' || lpad(CAST(k AS VARCHAR), 7, '0') ELSE '' END AS phone,
  CASE WHEN k % 4 = 0 THEN 'https://s.example.org/' || k ELSE '' END AS telegram, concat_ws('; ', CASE WHEN k % 2 = 0 THEN 'wordpress' END, CASE WHEN k % 5 = 1 THEN 'shopify' END, CASE WHEN k % 7 = 1 THEN 'react' END) AS site_tech,
  k % 10 <> 2 AS site_reachable, 'maps' AS sources, CASE WHEN k % 2 = 0 THEN '''=SUM(A1)' ELSE ''' -1' END AS notes FROM tiered WHERE tier IN ('A', 'B') AND k % 6 <> 0""",
    "lead_fill_rates": """WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'maps' ELSE 'registry' END AS source, c_custkey AS k, c_custkey % 3 <> 2 AS website, c_custkey % 4 <> 3 AS city, c_custkey % 2 = 0 OR c_custkey % 5 = 0 AS phones,
  c_custkey % 9 <> 0 AS rating, c_custkey % 10 <> 0 AS reviews FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT source, count(*) AS n_rows, count(*) - count(DISTINCT k) AS duplicate_ids, avg(website::INT) AS website, avg(city::INT) AS city, avg(phones::INT) AS phones, avg(rating::INT) AS rating, avg(reviews::INT) AS reviews FROM r GROUP BY 1)
SELECT source, n_rows, duplicate_ids, field, round(100 * share, 1) AS fill_pct FROM (UNPIVOT g ON website, city, phones, rating, reviews INTO NAME field VALUE share)""",
    "lead_needs": """SELECT CAST(c_custkey AS VARCHAR) AS id, 'https://www.site' || c_custkey || '.org' AS website FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 1""",
    "url_hosts": r"""WITH h AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS host, regexp_extract(url || '&utm_source=a&yclid=7', '^[^#]*') AS bare FROM pages),
q AS (SELECT *, split_part(bare, '?', 1) AS path, array_to_string(list_filter(string_split(CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|yclid|gclid|from)(=|$)')), '&') AS rest FROM h)
SELECT page_id, host, contains(host, '.') AND host <> 'x.com' AS own, path || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END AS clean FROM q""",
    "scalar_functions": f"""WITH s AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey * 1234567 AS VARCHAR), 10, '7') AS inn FROM supplier)
SELECT k, '79001' || lpad(CAST(k AS VARCHAR), 6, '0') AS phone, '49' || lpad(CAST(k AS VARCHAR), 6, '5') AS local_phone, 'sales@firm' || k || '.org' AS email, CASE WHEN k % 2 = 0 THEN 'generic' ELSE 'personal' END AS mail_type, 'acme ' || k AS name,
  length(inn) = 10 AND (({_INN}) % 11) % 10 = CAST(substr(inn, 10, 1) AS INT) AS inn_ok, 'a_b_' || k AS unit,
  CASE WHEN k % 3 = 0 THEN ''' =' WHEN k % 3 = 1 THEN 'x=' ELSE '''@' END || k AS cell,
  CASE WHEN k % 3 = 0 THEN 'spam' || k || '.org' WHEN k % 3 = 1 THEN 'bob@spam' || k || '.org' ELSE 'spam' || k || '.org' END AS blocked,
  CASE WHEN k % 2 = 0 THEN CAST('10000' || k AS DOUBLE) ELSE CAST('1' || k AS DOUBLE) END AS budget_max FROM s""",
}
ORACLES |= {"lead_increments": ORACLES["lead_resolve"], "bucketed_carry_over": ORACLES["lead_carry_over"]}
