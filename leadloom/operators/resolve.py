"""Entity resolution: partial records of many sources folded into one lead per business.

Records meet over keys (own domain, phone, name with city); what keys connect, however indirectly, is one business. All
values of a lead follow one order of its records: those with an own site first, then the most reviewed, then the first
read. Lists and scalars are folded by aggregations over (lead, field, value) with map-side combine, so that a business
with very many records is never gathered before its repeated values are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.functions import patterns as P
from leadloom.plans.components import connected_components
from leadloom.plans.storage import materialise

SCALARS = ["name", "website", "domain", "country", "city", "address", "lat", "lon", "segment"]
EMAIL = "struct<value:string,source:string,type:string,verified:string>"
PERSON = "struct<name:string,role:string,source:string>"
SIGNAL = "struct<type:string,value:string,source:string,date:string>"
BOARD = "struct<ats:string,token:string,url:string,source:string>"
SOURCE = "struct<source:string,id:string,url:string,collected:string,query:string>"
#: Lists of structs: their type, and the fields by which an item counts as seen.
KEYED = {
    "emails": (EMAIL, ["value"]),
    "people": (PERSON, ["name", "role"]),
    "signals": (SIGNAL, ["type", "value"]),
    "job_boards": (BOARD, ["ats", "token"]),
    "sources": (SOURCE, ["source", "id", "url"]),
}
PLAIN = ["names", "categories", "phones"]

_RAW = {
    "source": "string", "source_id": "string", "url": "string", "name": "string", "website": "string", "sites": "array<string>", "city": "string", "country": "string",
    "address": "string", "lat": "double", "lon": "double", "categories": "array<string>", "segment": "string", "phones": "array<string>", "emails": "array<string>",
    "socials": "map<string,array<string>>", "rating": "double", "reviews": "long", "people": f"array<{PERSON}>", "signals": f"array<{SIGNAL}>",
    "legal": "struct<name:string,registry_ids:map<string,string>>", "job_boards": "array<struct<ats:string,token:string,url:string>>", "collected": "string",
}


def with_raw_columns(raw: DataFrame) -> DataFrame:
    """Rows of partial records with every column of a raw business; what a source lacks is null."""
    return raw.select(*[c for c in raw.columns if c not in _RAW], *[(F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in _RAW.items()])


def normalize_businesses(raw: DataFrame, default_cc: str | None = None) -> DataFrame:
    """Fragments of leads: own site and domain, clean contacts, links of networks, provenance. ``pos`` is kept."""
    raw = with_raw_columns(raw)
    empty = lambda t: F.array().cast(f"array<{t}>")
    listed = lambda c, t: F.coalesce(c, empty(t))
    sites = F.array_compact(F.concat(F.array("website"), listed("sites", "string")))
    raw = raw.withColumn("_sites", sites).withColumn("_own", F.get(norm.own_sites(F.col("_sites")), F.lit(0)))
    emails = norm.ordered_distinct(F.transform(listed("emails", "string"), norm.clean_email))
    phones = norm.ordered_distinct(F.transform(listed("phones", "string"), lambda p: norm.phone_digits(p, default_cc)))
    socials = F.create_map().cast("map<string,array<string>>")
    given = F.coalesce("socials", socials)

    def links(network: str) -> Column:
        listed_as_site = F.filter("_sites", lambda u: norm.social_of(u) == network)
        return norm.ordered_distinct(F.concat(listed(F.try_element_at(given, F.lit(network)), "string"), listed_as_site))

    named = [F.struct(F.lit(k).alias("key"), links(k).alias("value")) for k in P.SOCIAL]
    return raw.select(
        "pos",
        "name",
        F.when(norm.truthy_text(F.col("name")), F.array("name")).otherwise(empty("string")).alias("names"),
        F.col("_own").alias("website"),
        norm.host(F.col("_own")).alias("domain"),
        "country", "city", "address", "lat", "lon",
        F.filter(listed("categories", "string"), norm.truthy_text).alias("categories"),
        "segment",
        phones.alias("phones"),
        F.transform(emails, lambda e: F.struct(e.alias("value"), F.col("source"), norm.email_type(e).alias("type"), F.lit("none").alias("verified"))).cast(f"array<{EMAIL}>").alias("emails"),
        F.map_filter(F.map_from_entries(F.array(*named)), lambda k, v: F.size(v) > 0).alias("socials"),
        listed("people", PERSON).alias("people"),
        "rating", "reviews",
        listed("signals", SIGNAL).alias("signals"),
        F.transform(listed("job_boards", "struct<ats:string,token:string,url:string>"), lambda b: F.struct(b["ats"].alias("ats"), b["token"].alias("token"), b["url"].alias("url"), F.col("url").alias("source"))).alias("job_boards"),
        F.array(F.struct(F.col("source"), F.col("source_id").alias("id"), F.col("url"), F.col("collected"), F.col("segment").alias("query"))).cast(f"array<{SOURCE}>").alias("sources"),
        F.col("legal.name").alias("legal_name"),
        F.coalesce("legal.registry_ids", F.create_map().cast("map<string,string>")).alias("registry_ids"),
    )


def match_keys(f: DataFrame | None = None) -> Column:
    """Keys of a fragment: its domain, its phones of nine digits or more, its name with its city; else its own id."""
    name = norm.norm_name(F.col("name"))
    keys = F.array_compact(
        F.concat(
            F.array(F.concat(F.lit("d:"), norm.blank_to_null(F.col("domain")))),
            F.transform(F.filter("phones", lambda p: F.length(p) >= 9), lambda p: F.concat(F.lit("p:"), p)),
            F.array(F.when((F.length(name) > 0) & norm.truthy_text(F.col("city")), F.concat(F.lit("n:"), name, F.lit("|"), F.lower("city")))),
        )
    )
    own = F.concat(F.lit("id:"), norm.lead_id(F.array("website"), F.col("name"), F.col("city"), F.col("phones")))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(own))


def entity_components(fragments: DataFrame) -> DataFrame:
    """(pos, component): records that shared keys connect; a record alone is its own component."""
    keyed = fragments.select("pos", F.explode(match_keys()).alias("key")).distinct()
    first = keyed.groupBy("key").agg(F.min("pos").alias("first"))
    links = keyed.join(first, "key").filter("pos <> first").select(F.col("pos").alias("a"), F.col("first").alias("b"))
    found = connected_components(links)
    return fragments.select("pos").join(found.withColumnRenamed("node", "pos"), "pos", "left").select("pos", F.coalesce("component", "pos").alias("component"))


def key_degrees(fragments: DataFrame) -> DataFrame:
    """(key, records) of each key, to see hubs that connect very many records."""
    return fragments.select("pos", F.explode(match_keys()).alias("key")).groupBy("key").agg(F.count_distinct("pos").alias("records"))


def _key_of(v: Column, by: list[str]) -> Column:
    return F.to_json(F.array(*(F.coalesce(v[b].cast("string"), F.lit("\0")) for b in by)))


def _parsed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.from_json(v, kind))


def _first_of(items: Column, by: list[str]) -> Column:
    return norm.first_by(items, lambda v: _key_of(v, by))


def _items(c: str) -> Column:
    """Rows (field, key, payload) of one list column, in order."""
    if c in PLAIN:
        return F.transform(c, lambda v: F.struct(F.lit(c).alias("field"), v.alias("key"), v.alias("payload")))
    kind, by = KEYED[c]
    return F.transform(c, lambda v: F.struct(F.lit(c).alias("field"), _key_of(v, by).alias("key"), F.to_json(v).alias("payload")))


def fold_groups(fragments: DataFrame, components: DataFrame, keep: bool = False) -> DataFrame:
    """One lead per component. Values of the record that comes first win; lists keep the first of equal items.

    With ``keep`` a lead keeps its component.
    """
    order = F.struct(F.col("domain").isNull().alias("no_site"), (-F.coalesce("reviews", F.lit(0))).alias("fewer"), F.col("pos"))
    rows = fragments.join(components, "pos").withColumn("order", order)
    first = lambda c, ok: F.min_by(F.col(c), F.when(ok, F.col("order"))).alias(c)
    truthy = {"lat": norm.truthy_number(F.col("lat")), "lon": norm.truthy_number(F.col("lon"))}
    scalars = rows.groupBy("component").agg(
        *[first(c, truthy.get(c, norm.truthy_text(F.col(c).cast("string")))) for c in [*SCALARS, "legal_name"]],
        F.max("rating").alias("rating"),
        F.max("reviews").alias("reviews"),
        F.count("*").alias("n_records"),
    )
    socials = F.flatten(F.transform(F.map_entries("socials"), lambda e: F.transform(e["value"], lambda v: F.struct(F.concat(F.lit("socials."), e["key"]).alias("field"), v.alias("key"), v.alias("payload")))))
    ids = F.transform(F.map_entries("registry_ids"), lambda e: F.struct(F.concat(F.lit("ids."), e["key"]).alias("field"), F.lit("").alias("key"), e["value"].alias("payload")))
    lists = rows.select("component", "order", F.posexplode(F.concat(*[_items(c) for c in [*PLAIN, *KEYED]], socials, ids)).alias("i", "item"))
    place = F.struct("order", "i")
    seen = lists.groupBy("component", "item.field", "item.key").agg(F.min_by("item.payload", place).alias("payload"), F.min(place).alias("place"))
    listed = seen.groupBy("component", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "payload"))), lambda x: x["payload"]).alias("values"))
    mapped = listed.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("lists"))
    out = scalars.join(mapped, "component", "left")
    values = lambda c: F.coalesce(F.col("lists")[c], F.array().cast("array<string>"))
    part = lambda prefix: F.map_filter(F.coalesce("lists", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.startswith(k, F.lit(prefix)))
    strip = lambda m, n: F.transform_keys(m, lambda k, v: F.substr(k, F.lit(n + 1)))
    return out.select(
        *(["component"] if keep else []),
        norm.lead_id(F.array("website"), F.col("name"), F.col("city"), values("phones")).alias("id"),
        *SCALARS,
        *[values(c).alias(c) for c in PLAIN],
        *[_parsed(values(c), kind).alias(c) for c, (kind, _) in KEYED.items()],
        strip(part("socials."), 8).alias("socials"),
        F.struct(F.col("legal_name").alias("name"), F.transform_values(strip(part("ids."), 4), lambda k, v: F.get(v, F.lit(0))).alias("registry_ids")).alias("legal"),
        "rating",
        "reviews",
        "n_records",
    )


def resolve(raw: DataFrame, default_cc: str | None = None) -> DataFrame:
    """Leads from raw business rows; ``pos`` numbers the rows in the order they were read (long, unique)."""
    fragments = materialise(normalize_businesses(raw, default_cc), "fragments")
    return fold_groups(fragments, entity_components(fragments))


_KEPT = ["site", "dns", "jobs", "registry", "hunter", "score", "score_breakdown", "tier", "notes", "status"]


def carry_over(leads: DataFrame, previous: DataFrame) -> DataFrame:
    """Leads joined with those of the run before: enrichment, score and workflow state stay, lists are united.

    Old leads that no source names any more are kept. Blocks that the old table lacks are left out.
    """
    old = previous.select(F.col("id").alias("old_id"), *[F.col(c).alias(f"old_{c}") for c in previous.columns if c != "id"])
    joined = leads.join(old, leads["id"] == old["old_id"], "full_outer")
    out = [F.coalesce("id", "old_id").alias("id")]
    for c in leads.columns:
        if c == "id":
            continue
        if c not in previous.columns:
            out.append(F.col(c))
        elif c == "emails":
            verified = F.map_from_entries(F.transform(F.coalesce("old_emails", F.array().cast(f"array<{EMAIL}>")), lambda e: F.struct(e["value"], e)))
            fresh = F.transform("emails", lambda e: F.coalesce(F.try_element_at(verified, e["value"]), e))
            both = F.concat(F.coalesce(fresh, F.array().cast(f"array<{EMAIL}>")), F.coalesce("old_emails", F.array().cast(f"array<{EMAIL}>")))
            out.append(norm.first_by(both, lambda e: e["value"]).alias(c))
        elif c in KEYED:
            kind, by = KEYED[c]
            none = F.array().cast(f"array<{kind}>")
            both = F.concat(F.coalesce(c, none), F.coalesce(f"old_{c}", none))
            out.append(_first_of(both, by).alias(c))
        elif c in PLAIN:
            none = F.array().cast("array<string>")
            out.append(norm.ordered_distinct(F.concat(F.coalesce(c, none), F.coalesce(f"old_{c}", none))).alias(c))
        else:
            out.append(F.coalesce(c, f"old_{c}").alias(c))
    out += [F.col(f"old_{c}").alias(c) for c in _KEPT if c in previous.columns and c not in leads.columns]
    return joined.select(*out)
