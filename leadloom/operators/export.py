"""Flat leads for spreadsheets, and how leads are filtered, ordered and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.operators.rules import tier_at_least

NETWORKS = ["linkedin", "facebook", "instagram", "x", "telegram", "whatsapp", "vk"]
CSV_COLUMNS = [
    "id", "tier", "score", "status", "name", "website", "domain", "country", "city", "address", "categories", "segment", "email", "emails", "phone", "phones", *NETWORKS,
    "people", "legal_name", "registry_ids", "rating", "reviews", "site_reachable", "site_https", "site_builder", "site_tech", "signals", "score_breakdown", "sources", "notes",
]


def flatten_leads(leads: DataFrame) -> DataFrame:
    """The 36 flat columns of each lead; lists joined, maps as ``key=value``, sources sorted and distinct."""
    has = set(leads.columns)
    null = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c.split(".")[0] in has and (("." not in c) or c.split(".")[1] in leads.schema[c.split(".")[0]].dataType.names) else null
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "; "), F.lit("")) if c in has else F.lit("")
    pairs = lambda m: F.coalesce(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; "), F.lit(""))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    values = F.transform("emails", lambda e: e["value"])
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    sources = F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.coalesce(s["source"], F.lit(""))))) if "sources" in has else F.array().cast("array<string>")
    special = {
        "categories": joined("categories", lambda c: c),
        "email": first(values),
        "emails": F.coalesce(F.array_join(values, "; "), F.lit("")),
        "phone": first(F.col("phones")),
        "phones": joined("phones", lambda p: p),
        "people": joined("people", lambda p: F.concat(p["name"], F.lit(" ("), F.coalesce(norm.blank_to_null(p["role"]), F.lit("?")), F.lit(")"))),
        "legal_name": col("legal.name"),
        "registry_ids": pairs(F.col("legal.registry_ids")) if "legal" in has else F.lit(""),
        "site_reachable": col("site.reachable"),
        "site_https": col("site.https"),
        "site_builder": col("site.builder"),
        "site_tech": F.coalesce(F.array_join(F.col("site.tech"), "; "), F.lit("")) if "site" in has else F.lit(""),
        "signals": joined("signals", lambda s: F.concat(text(s["type"]), F.lit(":"), text(s["value"]))),
        "score_breakdown": pairs(F.col("score_breakdown")) if "score_breakdown" in has else F.lit(""),
        "sources": F.coalesce(F.array_join(sources, "; "), F.lit("")),
    }
    for n in NETWORKS:
        special[n] = F.coalesce(F.get(F.try_element_at("socials", F.lit(n)), F.lit(0)), F.lit("")) if "socials" in has else F.lit("")
    return leads.select(*[special.get(c, col(c)).alias(c) for c in CSV_COLUMNS])


def guard_cells(flat: DataFrame) -> DataFrame:
    """String cells that a spreadsheet would run as formulas become text; numbers stay as they are."""
    return flat.select(*[norm.csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in flat.dtypes])


def select_leads(leads: DataFrame, min_tier: str | None = None, has_email: bool = False, status: str | None = None) -> DataFrame:
    """Leads of a tier or better, with an address, of a status."""
    if min_tier:
        leads = leads.filter(tier_at_least(F.col("tier"), min_tier))
    if has_email:
        leads = leads.filter(norm.truthy_list(F.col("emails")))
    if status:
        leads = leads.filter(F.col("status") == status)
    return leads


def lead_order() -> list[Column]:
    """Best tier first, then score, then id; unknown tiers last."""
    return [norm.tier_rank(F.col("tier")), F.desc(F.coalesce("score", F.lit(0))), F.col("id")]


def export_csv(leads: DataFrame, path: str, **wanted) -> None:
    """Write the wanted leads in order as CSV. The sort is by range, so files follow each other."""
    chosen = select_leads(leads, **wanted)
    ordered = chosen.orderBy(*lead_order())
    guard_cells(flatten_leads(ordered)).write.option("header", True).option("escape", '"').csv(path)
