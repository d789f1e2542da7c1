"""Demand and supply: orders once per id, product labels, one currency, and the tables that compare segments."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.functions import patterns as P
from leadloom.operators.pattern_index import PatternIndex
from leadloom.plans.storage import materialise, spread

#: What segments may be scored by.
METRICS = ["gap_pct", "median_rating", "median_reviews", "messenger_pct", "n", "email_pct", "no_own_site_pct", "own_site_pct", "phone_pct", "site_issue_pct", "sites_crawled", "social_only_pct"]
ORDER_FIELDS = ["source_id", "url", "title", "description", "budget", "budget_max", "currency", "category", "offers", "created", "type", "channel", "buyer"]


@dataclass(frozen=True)
class Rule:
    """Named pattern over an order's text, for some product types or all."""

    name: str
    matches: str
    product: tuple[str, ...] = ()
    note: str | None = None


@dataclass(frozen=True)
class Segment:
    """Segment to be ranked: a demand pattern, and a supply pattern or the segment of the same name."""

    name: str
    demand: str
    supply: str | None = None
    product: tuple[str, ...] = ()
    control: bool = False
    note: str | None = None


@dataclass(frozen=True)
class MarketConfig:
    products: tuple[Rule, ...] = ()
    default_products: bool = True
    clusters: tuple[Rule, ...] = ()
    segments: tuple[Segment, ...] = ()
    currency: str | None = None
    rates: dict[str, float] = field(default_factory=dict)
    max_age_days: int = 0
    exclude_types: tuple[str, ...] = ()
    site_issues: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: {"demand": 0.4, "gap": 0.3, "reach": 0.3, "competition": 0.0})
    gap_metric: str = "gap_pct"
    reach_metric: str = "messenger_pct"


#: Rules from which on texts are met with an index of the rules' literals, which costs as much as a few patterns do.
INDEX_FROM = 40


class MarketError(ValueError):
    """A rule of the user's configuration that cannot be used, by name."""


def check_config(cfg: MarketConfig) -> None:
    """Raise ``MarketError`` for rules without name or pattern, broken patterns, and unknown metrics."""
    jvm = SparkSession.getActiveSession()._jvm

    def pattern(rx: str, what: str) -> None:
        try:
            jvm.java.util.regex.Pattern.compile(norm.IGNORE_CASE + rx)
        except IllegalArgumentException as e:
            raise MarketError(f"{what}: bad pattern {rx!r}: {str(e).splitlines()[0]}") from None

    for kind, rules in (("products", cfg.products), ("clusters", cfg.clusters)):
        for r in rules:
            if not r.name or not r.matches:
                raise MarketError(f"{kind}: a rule needs name and matches: {r}")
            pattern(r.matches, f"{kind}: {r.name!r}")
    for s in cfg.segments:
        if not s.name or not s.demand:
            raise MarketError(f"segments: a segment needs name and demand: {s}")
        pattern(s.demand, f"segments: demand of {s.name!r}")
        if s.supply:
            pattern(s.supply, f"segments: supply of {s.name!r}")
    for metric in (cfg.gap_metric, cfg.reach_metric):
        if metric not in METRICS:
            raise MarketError(f"score: metric {metric!r} is none of {METRICS}")


# --- orders ---------------------------------------------------------------------------------------------------------


def normalize_orders(raw: DataFrame) -> DataFrame:
    """Orders from demand rows (ORDER_FIELDS, any of which may be absent, with source, day, unit and pos).

    The id is the link, else source and id there; ``value`` is the stated minimum, else the stated maximum.
    """
    col = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    budget, most = norm.positive_number(col("budget")), norm.positive_number(col("budget_max"))
    offers = col("offers").cast("string")
    out = spread(raw).select(
        F.coalesce(norm.blank_to_null(col("url")), F.concat(F.col("source"), F.lit(":"), F.coalesce(col("source_id").cast("string"), F.lit("")))).alias("id"),
        "source",
        col("url").alias("url"),
        col("channel").alias("channel"),
        F.left(norm.clean_text(col("title")), F.lit(300)).alias("title"),
        F.left(norm.clean_text(col("description")), F.lit(4000)).alias("description"),
        norm.blank_to_null(norm.clean_text(col("category"))).alias("category"),
        budget.alias("budget"),
        most.alias("budget_max"),
        F.coalesce(budget, most).alias("value"),
        F.upper(norm.blank_to_null(col("currency"))).alias("currency"),
        F.floor(offers.try_cast("double")).cast("int").alias("offers"),
        F.coalesce(norm.blank_to_null(col("type")), F.lit("order")).alias("type"),
        col("created").cast("string").alias("created"),
        norm.order_date(col("created")).alias("date"),
        col("buyer").cast("string").alias("buyer"),
        F.col("day").cast("string").alias("day"),
        col("unit").alias("unit"),
        F.coalesce(col("pos").cast("long"), F.lit(0)).alias("pos"),
    )
    return out


def latest_orders(orders: DataFrame) -> DataFrame:
    """Each id once: its last row in the order of source, day, unit and place; first and last day it was seen.

    One aggregation with map-side combine, so that an id with very many snapshots costs no more than others.
    """
    kept = [c for c in orders.columns if c not in ("id", "day", "unit", "pos")]
    last = F.max_by(F.struct(*kept), F.struct("source", "day", F.coalesce("unit", F.lit("")), "pos"))
    grouped = orders.groupBy("id").agg(last.alias("row"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return grouped.select("id", "row.*", "first_seen", "last_seen")


def drop_reason(cfg: MarketConfig, as_of: datetime.date) -> Column:
    """Why an order is left out: ``excluded_type`` before ``older``; null for orders that stay. Undated orders stay."""
    reason = F.when(F.col("type").isin(list(cfg.exclude_types)), F.lit("excluded_type")) if cfg.exclude_types else F.when(F.lit(False), F.lit(""))
    if cfg.max_age_days:
        reason = reason.when(F.col("date") < F.lit(as_of - datetime.timedelta(days=cfg.max_age_days)), F.lit("older"))
    return reason


def current_orders(orders: DataFrame, cfg: MarketConfig, as_of: datetime.date) -> DataFrame:
    return orders.filter(drop_reason(cfg, as_of).isNull())


def drop_counts(orders: DataFrame, cfg: MarketConfig, as_of: datetime.date) -> DataFrame:
    return orders.groupBy(drop_reason(cfg, as_of).alias("reason")).agg(F.count("*").alias("orders")).filter("reason is not null")


def text_of_order() -> Column:
    return norm.search_text(F.col("title"), F.col("description"), F.col("category"))


def product_label(cfg: MarketConfig, text: Column | None = None) -> Column:
    """Name of the first rule that matches a text in lower case, the user's before the built-in ones; ``other`` for none."""
    text = text_of_order() if text is None else text
    own = [F.when(norm.matches(text, r.matches), F.lit(r.name)) for r in cfg.products]
    # The built-in patterns are in lower case, as the text is: they need not look for either case.
    built_in = [F.when(F.coalesce(text.rlike("(?U)" + p), F.lit(False)), F.lit(n)) for n, p in P.PRODUCTS] if cfg.default_products else []
    return F.coalesce(*own, *built_in, F.lit("other"))


def with_product(orders: DataFrame, cfg: MarketConfig) -> DataFrame:
    """Orders with ``product``, as ``product_label`` names it; many rules of the user are met with by an index."""
    orders = orders.withColumn("_searched", text_of_order())
    if len(cfg.products) < INDEX_FROM:
        return orders.withColumn("product", product_label(cfg, F.col("_searched"))).drop("_searched")
    orders = PatternIndex([r.matches for r in cfg.products]).matched(orders, F.col("_searched"), "_hits")
    names = F.array(*[F.lit(r.name) for r in cfg.products])
    built_in = product_label(replace(cfg, products=[]), F.col("_searched"))
    return orders.withColumn("product", F.coalesce(F.element_at(names, F.array_min("_hits") + 1), built_in)).drop("_searched", "_hits")


def main_currency(orders: DataFrame, cfg: MarketConfig) -> str | None:
    """The configured currency, else the one that most orders with a value name (the first by name of equals)."""
    if cfg.currency:
        return cfg.currency.upper()
    top = orders.filter("value is not null and currency is not null").groupBy("currency").count().orderBy(F.desc("count"), "currency").first()
    return top["currency"] if top else None


def amount(currency: str | None, rates: dict[str, float]) -> Column:
    """Value in the main currency; null where there is no value or no rate."""
    out = F.when(F.col("value").isNull(), None).when(F.col("currency") == F.lit(currency), F.col("value"))
    for code, rate in rates.items():
        out = out.when(F.col("currency") == code.upper(), F.round(F.col("value") * rate, 2))
    return out.cast("double")


def unrated_counts(orders: DataFrame) -> DataFrame:
    """Orders with a value but no amount, by currency."""
    left = orders.filter("value is not null and amount is null")
    return left.groupBy(F.coalesce("currency", F.lit("unknown")).alias("currency")).agg(F.count("*").alias("orders"))


def prepare_orders(raw: DataFrame, cfg: MarketConfig, as_of: datetime.date) -> DataFrame:
    """Current orders with their product and amount.

    Cleaning and labelling texts is the costly part and every table reads the result several times, so it is written
    once; the amount depends on the currency that most of the written orders have.
    """
    check_config(cfg)
    orders = with_product(current_orders(latest_orders(normalize_orders(raw)), cfg, as_of), cfg)
    orders = materialise(orders, "orders")
    return orders.withColumn("amount", amount(main_currency(orders, cfg), cfg.rates))


# --- statistics of groups of orders ----------------------------------------------------------------------------------


def quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median, p25, p75) of the values that are not null.

    The quartiles are the values at places ⌊n/4⌋ and ⌊3n/4⌋ of the sorted list, the median the mean of the middle ones.
    Equal values are counted first. Values then share buckets of a thousandth of a doubling, whose number does not grow
    with the data; buckets are summed in order, and only those that hold one of the places are looked into.
    """
    size = F.floor(F.log2(F.abs(F.col(value)) + 1) * 1024)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    counted = counted.withColumn("_bucket", (F.signum(value) * size).cast("long"))
    buckets = counted.groupBy(*keys, "_bucket").agg(F.sum("_k").alias("_in"))
    before, whole = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    buckets = buckets.withColumns({"_base": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_n": F.sum("_in").over(whole)})
    n, last = F.col("_n"), F.col("_n") - 1
    places = [F.floor(last / 2), F.floor(n / 2), F.least(last, F.floor(n * 0.25)), F.least(last, F.floor(n * 0.75))]
    wanted = reduce(lambda a, b: a | b, [(F.col("_base") <= p) & (p < F.col("_base") + F.col("_in")) for p in places])
    wanted = buckets.filter(wanted).select(*[F.col(c).alias(f"_of_{c}") for c in [*keys, "_bucket"]], "_base", "_n")
    joined = counted.join(wanted, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_bucket"]]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    found = joined.withColumn("_upto", F.col("_base") + F.sum("_k").over(inside)).withColumn("_from", F.col("_upto") - F.col("_k"))
    at = lambda place: F.min(F.when((F.col("_from") <= place) & (F.col("_upto") > place), F.col(value)))
    return found.groupBy(*keys).agg(F.max("_n").alias("n"), ((at(places[0]) + at(places[1])) / 2).alias("median"), at(places[2]).alias("p25"), at(places[3]).alias("p75"))


def order_stats(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Orders, distinct texts and buyers, budgets and offers of each group. Pay of vacancies is no budget."""
    key = norm.text_key(F.col("description"), F.col("title"), F.col("id"))
    counts = orders.groupBy(*keys).agg(
        F.count("*").alias("orders"),
        # Texts are told apart by 128 bits, so that no row of the shuffle holds one.
        F.count_distinct(F.xxhash64(key), F.xxhash64(F.lit(1), key)).alias("distinct"),
        F.nullif(F.count_distinct(norm.blank_to_null(F.col("buyer"))), F.lit(0)).alias("buyers"),
        F.median("offers").alias("median_offers"),
    )
    paid = orders.withColumn("paid", F.when((F.col("amount") != 0) & (F.col("type") != "vacancy"), F.col("amount")))
    budgets = quantiles(paid, keys, "paid").select(
        *keys, F.col("n").alias("with_budget"), F.col("median").alias("median_budget"), F.col("p25").alias("p25_budget"), F.col("p75").alias("p75_budget")
    )
    out = counts.join(budgets, keys, "left")
    return out.select(*keys, "orders", "distinct", "buyers", F.coalesce("with_budget", F.lit(0)).alias("with_budget"), "median_budget", "p25_budget", "p75_budget", "median_offers")


def with_share(table: DataFrame, total: DataFrame, part: str = "orders") -> DataFrame:
    """Add the share of all orders in percent; ``total`` is a one-row count."""
    n = total.agg(F.count("*").alias("all_orders"))
    return table.crossJoin(F.broadcast(n)).withColumn("share_pct", norm.percent(F.col(part), F.greatest("all_orders", F.lit(1)))).drop("all_orders")


def products_table(orders: DataFrame) -> DataFrame:
    """Statistics of each product type, its share and its orders by source."""
    by_source = orders.groupBy("product", "source").agg(F.count("*").alias("k"))
    sources = by_source.groupBy("product").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "k")))).alias("sources"))
    return with_share(order_stats(orders, ["product"]), orders).join(sources, "product")


def rule_hits(orders: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Orders with ``rule``, one row for each rule that matches; the texts are read once for all rules.

    From ``INDEX_FROM`` rules on only those run on a text of which it holds what a match needs.
    """
    text, rules = text_of_order(), list(rules)
    if len(rules) >= INDEX_FROM:
        found = PatternIndex([r.matches for r in rules]).matched(orders, text, "_hits").select(*orders.columns, F.explode("_hits").alias("_rule"))
        named = orders.sparkSession.createDataFrame([(i, r.name, list(r.product)) for i, r in enumerate(rules)], "_rule int, rule string, _for array<string>")
        hits = found.join(F.broadcast(named), "_rule")
        if any(r.product for r in rules):
            hits = hits.filter((F.size("_for") == 0) | F.array_contains("_for", F.col("product")))
        return hits.select(*orders.columns, "rule")
    tests = []
    for r in rules:
        hit = norm.matches(text, r.matches)
        if r.product:
            hit = hit & F.col("product").isin(list(r.product))
        tests.append(F.when(hit, F.lit(r.name)))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return orders.select("*", F.explode(found).alias("rule"))


def clusters_table(orders: DataFrame, cfg: MarketConfig) -> DataFrame:
    """Statistics of each cluster, clusters without orders included, and how many links and titles ``cluster_hits`` has."""
    check_config(cfg)
    spark = orders.sparkSession
    rules = spark.createDataFrame([(r.name, r.matches, r.note) for r in cfg.clusters], "rule string, matches string, note string")
    hits = rule_hits(orders, cfg.clusters)
    listed = hits.groupBy("rule").agg(F.count("url").alias("n_urls"), F.count("*").alias("n_titles"))
    stats = with_share(order_stats(hits, ["rule"]), orders).join(listed, "rule")
    out = rules.join(stats, "rule", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        F.col("rule").alias("cluster"), "note", "matches", zero("orders"), zero("distinct"), "buyers", zero("with_budget"), "median_budget", "p25_budget", "p75_budget", "median_offers",
        F.coalesce("share_pct", F.lit(0.0)).alias("share_pct"), zero("n_urls"), zero("n_titles"),
    )


def cluster_hits(orders: DataFrame, cfg: MarketConfig) -> DataFrame:
    """Links and titles of each cluster, one row an order; a large cluster is never one row."""
    return rule_hits(orders, cfg.clusters).select(F.col("rule").alias("cluster"), "id", "url", F.left("title", F.lit(100)).alias("title"))


def select_orders(
    orders: DataFrame,
    cfg: MarketConfig,
    product: Iterable[str] = (),
    cluster: str | None = None,
    pattern: str | None = None,
    source: Iterable[str] = (),
    min_budget: float | None = None,
) -> DataFrame:
    """Orders that meet every condition that is given."""
    if cluster:
        rule = next(r for r in cfg.clusters if r.name == cluster)
        orders = orders.filter(norm.matches(text_of_order(), rule.matches))
        if rule.product:
            orders = orders.filter(F.col("product").isin(list(rule.product)))
    if product:
        orders = orders.filter(F.col("product").isin(list(product)))
    if pattern:
        orders = orders.filter(norm.matches(text_of_order(), pattern))
    if source:
        orders = orders.filter(F.col("source").isin(list(source)))
    if min_budget:
        orders = orders.filter(F.col("amount") >= min_budget)
    return orders


def top_orders(orders: DataFrame, n: int, by: str = "budget") -> DataFrame:
    """First ``n`` orders by budget, by fewest offers or by date; all for 0. The id breaks ties."""
    keys = {
        "budget": [F.desc_nulls_last("amount")],
        "offers": [F.asc_nulls_last("offers")],
        "date": [F.desc_nulls_last(F.coalesce(F.col("date").cast("string"), F.col("first_seen")))],
    }[by]
    ordered = orders.orderBy(*keys, "id")
    return ordered.limit(n) if n else ordered


def order_terms(orders: DataFrame) -> DataFrame:
    """(kind, term, orders): words of four letters or more and pairs of neighbours, counted once an order.

    Stop words go before neighbours are paired; pairs stay if two orders have them.
    """
    text = F.lower(F.concat_ws(" ", "title", "description"))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)[^\W\d_]{3,}"), F.lit(0)), lambda w: ~w.isin(P.STOP_WORDS))
    tokens = spread(orders.select("title", "description")).select(words.alias("w"))
    long_words = F.transform(F.array_distinct(F.filter("w", lambda w: F.length(w) >= 4)), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("term")))
    nexts = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), nexts, lambda a, b: F.when(a != b, F.concat(a, F.lit(" "), b)))
    pairs = F.transform(F.array_distinct(F.array_compact(pairs)), lambda p: F.struct(F.lit("pair").alias("kind"), p.alias("term")))
    found = tokens.select(F.explode(F.concat(long_words, pairs)).alias("t")).select("t.*")
    counted = found.groupBy("kind", "term").agg(F.count("*").alias("orders"))
    return counted.filter("kind = 'word' or orders > 1")


def top_terms(orders: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` most common words and pairs; equals by name."""
    order = Window.partitionBy("kind").orderBy(F.desc("orders"), "term")
    return order_terms(orders).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def source_counts(orders: DataFrame) -> DataFrame:
    """Orders of each source and the days it was last seen."""
    return orders.groupBy("source").agg(F.count("*").alias("orders"), F.sort_array(F.collect_set("last_seen")).alias("snapshots"))


# --- supply ---------------------------------------------------------------------------------------------------------


def site_issue(issues: Iterable[str]) -> Column:
    """Whether a crawled site has one of the issues: unreachable, or a signal of that type."""
    issues = list(issues)
    signals = F.transform("signals", lambda s: s["type"])
    hit = F.arrays_overlap(signals, F.array(*map(F.lit, issues))) if issues else F.lit(False)
    down = (F.col("site.reachable") == F.lit(False)) if "unreachable" in issues else F.lit(False)
    return F.coalesce(down, F.lit(False)) | F.coalesce(hit, F.lit(False))


def supply_flags(leads: DataFrame, issues: Iterable[str]) -> DataFrame:
    """Per lead the facts that supply metrics count: (segment, city, own, social, messenger, phone, email, crawled, issue)."""
    socials = F.coalesce("socials", F.create_map().cast("map<string,array<string>>"))
    own = norm.truthy_text(F.col("website"))
    crawled = own & norm.truthy_text(F.col("site.checked").cast("string"))
    has = lambda names: F.size(F.map_filter(socials, lambda k, v: (F.size(v) > 0) & (k.isin(names) if names else F.lit(True)))) > 0
    return leads.select(
        F.coalesce(norm.blank_to_null(F.col("segment")), F.lit("(none)")).alias("segment"),
        F.coalesce(norm.blank_to_null(F.col("city")), F.lit("(none)")).alias("city"),
        own.alias("own"),
        (~own & has([])).alias("social_only"),
        has(P.MESSENGERS).alias("messenger"),
        norm.truthy_list(F.col("phones")).alias("phone"),
        norm.truthy_list(F.col("emails")).alias("email"),
        crawled.alias("crawled"),
        (crawled & site_issue(issues)).alias("issue"),
        F.when(F.col("rating") != 0, F.col("rating").cast("double")).alias("rating"),
        F.col("reviews").cast("long").alias("reviews"),
        F.when(crawled, F.array_distinct(F.coalesce("site.tech", F.array().cast("array<string>")))).alias("tech"),
    )


def _supply_aggregates() -> list[Column]:
    count = lambda c: F.count_if(F.col(c))
    n = F.count("*")
    no_own = norm.percent(n - count("own"), n)
    issue = F.when(count("crawled") > 0, norm.percent(count("issue"), count("crawled")))
    return [
        n.alias("n"),
        norm.percent(count("own"), n).alias("own_site_pct"),
        no_own.alias("no_own_site_pct"),
        norm.percent(count("social_only"), n).alias("social_only_pct"),
        norm.percent(count("messenger"), n).alias("messenger_pct"),
        norm.percent(count("phone"), n).alias("phone_pct"),
        norm.percent(count("email"), n).alias("email_pct"),
        count("crawled").alias("sites_crawled"),
        issue.alias("site_issue_pct"),
        F.round(no_own + F.coalesce(issue, F.lit(0.0)) * (1 - no_own / 100), 1).alias("gap_pct"),
        F.round(F.median("rating"), 2).alias("median_rating"),
        F.median("reviews").alias("median_reviews"),
    ]


def supply_table(leads: DataFrame, issues: Iterable[str] = ()) -> DataFrame:
    """Supply metrics of each segment (city null) and of each city in it, in one aggregation over grouping sets."""
    flags = supply_flags(leads, issues)
    sets = flags.groupingSets([["segment", "city"], ["segment"]], "segment", "city")
    return sets.agg(*_supply_aggregates())


def top_tech(leads: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` technologies that most crawled sites of a segment use, with their share; equals by name."""
    flags = supply_flags(leads, ()).filter("crawled")
    crawled = flags.groupBy("segment").agg(F.count("*").alias("crawled"))
    used = flags.select("segment", F.explode("tech").alias("tech")).groupBy("segment", "tech").agg(F.count("*").alias("sites"))
    order = Window.partitionBy("segment").orderBy(F.desc("sites"), "tech")
    ranked = used.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.join(crawled, "segment").select("segment", "rank", "tech", "sites", norm.percent(F.col("sites"), F.col("crawled")).alias("pct"))


def supply_matches(leads: DataFrame, segments: Iterable[Segment]) -> DataFrame:
    """Leads with ``ranked``, one row for each segment they supply, by pattern or by name."""
    text = F.concat_ws(" ", F.coalesce("segment", F.lit("")), F.array_join("categories", " "))
    tests = []
    for s in segments:
        hit = norm.matches(text, s.supply) if s.supply else F.lower(F.coalesce("segment", F.lit(""))) == s.name.lower()
        tests.append(F.when(hit, F.lit(s.name)))
    return leads.select("*", F.explode(F.array_compact(F.array(*tests))).alias("ranked"))


def segment_scores(orders: DataFrame, leads: DataFrame, cfg: MarketConfig) -> DataFrame:
    """Segments by weighted demand, gap, reach and competition, each against the largest of those that are no control.

    A segment without supply scores 0 for gap and reach; control segments are scored alike and come last.
    """
    check_config(cfg)
    spark = orders.sparkSession
    listed = [(s.name, s.control, s.note) for s in cfg.segments]
    names = spark.createDataFrame(listed, "segment string, control boolean, note string")
    demand = order_stats(rule_hits(orders, [Rule(s.name, s.demand, s.product) for s in cfg.segments]), ["rule"])
    flags = supply_flags(supply_matches(leads, cfg.segments).withColumn("segment", F.col("ranked")), cfg.site_issues)
    supply = flags.groupBy("segment").agg(*_supply_aggregates())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    table = names.join(demand, names["segment"] == demand["rule"], "left").join(supply, "segment", "left")
    table = table.select(
        "segment", "control", "note", zero("orders").cast("long").alias("demand_orders"), zero("distinct").cast("long").alias("demand_distinct"), "buyers", "median_budget",
        zero("with_budget").cast("long").alias("with_budget"), "median_offers", zero("n").cast("long").alias("businesses"), F.col(cfg.gap_metric).cast("double").alias("gap"), F.col(cfg.reach_metric).cast("double").alias("reach"),
    )
    everything = Window.partitionBy()
    top = lambda c: F.coalesce(F.nullif(F.max(F.when(~F.col("control"), zero(c))).over(everything), F.lit(0.0)), F.lit(1.0))
    part = {"demand": zero("demand_distinct") / top("demand_distinct"), "gap": zero("gap") / top("gap"), "reach": zero("reach") / top("reach"), "competition": -zero("median_offers") / top("median_offers")}
    total = sum((F.lit(float(cfg.weights.get(k, 0))) * v for k, v in part.items()), F.lit(0.0))
    return table.select("*", *[(F.round(v, 3) + 0.0).alias(f"{k}_part") for k, v in part.items()], (F.round(total, 3) + 0.0).alias("score")).orderBy("control", F.desc("score"), "segment")
