"""Readers and writers of raw snapshots, imported lists, drafts and suppression lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import norm

# Column headers that lists use, in lower case, by field; the first that is filled counts.
ALIASES = {
    "name": ["name", "company", "company name", "business", "business name", "organization", "organisation", "title"],
    "sites": ["website", "site", "url", "domain", "web", "homepage", "websiteuri"],
    "phones": ["phone", "telephone", "tel", "phone number", "mobile", "phonenumber"],
    "emails": ["email", "e-mail", "emails", "mail", "email address"],
    "city": ["city", "town", "locality"],
    "country": ["country", "country code"],
    "address": ["address", "street", "full address", "formatted address"],
    "categories": ["category", "categories", "industry", "type", "categoryname"],
    "linkedin": ["linkedin", "linkedin url", "company linkedin"],
    "facebook": ["facebook"],
    "instagram": ["instagram"],
    "telegram": ["telegram"],
    "whatsapp": ["whatsapp"],
    "rating": ["rating", "totalscore", "stars"],
    "reviews": ["reviews", "reviews count", "reviewscount", "review count"],
}
LISTS = ["sites", "phones", "emails", "categories", "linkedin", "facebook", "instagram", "telegram", "whatsapp"]


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines and files that vanished are skipped."""
    return spark.read.schema(schema).option("ignoreMissingFiles", True).json(path)


def file_place() -> Column:
    """Place of a row in its file: ascending over all parts of the file, whatever the cluster and the size of parts.

    A part's first byte plus the row's number in its task. A part has fewer rows than bytes, and a part that is not the
    last of its file fills a task alone, so places of one part lie below those of the next.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """All rows of the newest day of each (source, unit).

    The newest days are few, found by partial aggregates; the rows are not sorted. Where rows come from files,
    ``snapshots.newest`` chooses the files instead, so that others are not read.
    """
    last = rows.groupBy(F.col("source").alias("_s"), F.col("unit").alias("_u")).agg(F.max("day").alias("_d"))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("unit").eqNullSafe(F.col("_u")) & (F.col("day") == F.col("_d"))
    return rows.join(last, same, "left_semi")


def of_kind(rows: DataFrame, catalogue: DataFrame, kind: str) -> DataFrame:
    """Rows of the sources that a catalogue (source, kind) says are of a kind."""
    return rows.join(catalogue.filter(F.col("kind") == kind).select("source"), "source", "left_semi")


def union_sources(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of all sources; columns that one lacks are null there."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def unit_plan(spark: SparkSession, source: str, locations: list[str], queries: list[str]) -> DataFrame:
    """(source, unit, location, query, pos): every location with every query of a source's configuration."""
    rows = [(source, loc, q, i * len(queries) + j) for i, loc in enumerate(locations) for j, q in enumerate(queries)]
    plan = spark.createDataFrame(rows, "source string, location string, query string, pos int")
    return plan.withColumn("unit", norm.unit_key(F.concat_ws("__", "location", "query")))


def uncollected(plan: DataFrame, collected: DataFrame, day: str | None = None) -> DataFrame:
    """Units of a plan that were never collected, or not on ``day`` for feeds that are collected daily."""
    done = collected.filter(F.col("day") == day) if day else collected
    return plan.join(done.select("source", "unit").distinct(), ["source", "unit"], "left_anti")


def stamped(rows: DataFrame, source: str, day: str) -> DataFrame:
    """Rows with source and collected filled where a parser left them out."""
    fill = lambda c, v: (F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)).alias(c)
    return rows.select(*[c for c in rows.columns if c not in ("source", "collected")], fill("source", source), fill("collected", day))


def guess_delimiter(spark: SparkSession, path: str) -> str:
    """The one of comma, semicolon and tab that the first line holds most of."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(",;\t", key=line.count)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list to import: CSV with any of three delimiters, JSON lines, a JSON list, or ``{"items": […]}``.

    ``_pos`` is the row's place in its file.
    """
    if path.endswith((".jsonl", ".ndjson")):
        found = spark.read.json(path)
    elif path.endswith(".json"):
        found = spark.read.option("multiLine", True).json(path)
        if found.columns == ["items"]:
            return found.select(F.posexplode("items").alias("_pos", "x")).select(F.col("_pos").cast("long").alias("_pos"), "x.*")
    else:
        found = spark.read.option("header", True).option("sep", guess_delimiter(spark, path)).option("encoding", "UTF-8").csv(path)
    return found.select("*", file_place().alias("_pos"))


def map_aliases(rows: DataFrame, segment: str | None = None, unit: str = "list") -> DataFrame:
    """Raw businesses from a list with headers of any usual name.

    List cells are split at ``; , |``, and the lists of all alias columns joined; other fields take the first filled
    alias; what no field uses goes to the map ``extra``; rows with neither name nor site are dropped. Ids name the row's
    place, which ``read_list`` gives; rows from elsewhere are numbered as they come.
    """
    by_name: dict[str, Column] = {}
    place = F.col("_pos") if "_pos" in rows.columns else F.monotonically_increasing_id()
    for c in rows.columns:
        if c == "_pos":
            continue
        by_name.setdefault(" ".join(c.replace("_", " ").split()).lower(), F.col(f"`{c}`"))
    text = lambda c: norm.blank_to_null(c.cast("string"))
    out = []
    for f, names in ALIASES.items():
        cols = [by_name[n] for n in names if n in by_name]
        if f in LISTS:
            cells = [F.split(text(c), r"\s*[;,|]\s*") for c in cols]
            empty = F.array().cast("array<string>")
            value = F.filter(F.concat(*[F.coalesce(c, empty) for c in cells]), lambda x: F.length(x) > 0) if cells else empty
        elif f in ("rating", "reviews"):
            value = F.coalesce(*[text(c).try_cast("double") for c in cols]) if cols else F.lit(None).cast("double")
            value = value.cast("long") if f == "reviews" else value
        else:
            value = F.coalesce(*[text(c) for c in cols]) if cols else F.lit(None).cast("string")
        out.append(value.alias(f))
    used = {n for names in ALIASES.values() for n in names}
    rest = [x for n, c in by_name.items() if n not in used for x in (F.lit(n), text(c))]
    extra = F.map_filter(F.create_map(*rest), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    seg = F.lit(segment) if segment else (text(by_name["segment"]) if "segment" in by_name else F.lit(None).cast("string"))
    mapped = rows.select(*out, extra.alias("extra"), seg.alias("segment"), place.alias("pos"))
    mapped = mapped.filter(norm.truthy_text(F.col("name")) | (F.size("sites") > 0))
    nets = [x for k in ("linkedin", "facebook", "instagram", "telegram", "whatsapp") for x in (F.lit(k), F.col(k))]
    socials = F.map_filter(F.create_map(*nets), lambda k, v: F.size(v) > 0)
    return mapped.withColumn("socials", socials).withColumn("source_id", F.concat(F.lit(f"{unit}:"), (F.col("pos") + 1).cast("string"))).drop("linkedin", "facebook", "instagram", "telegram", "whatsapp")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(tables: dict[str, DataFrame], root: str) -> None:
    """One folder of JSON a table."""
    for name, t in tables.items():
        t.write.mode("overwrite").json(f"{root}/{name}")


_DRAFT = "lead_id string, step int, channel string, to string, subject string, body string, evidence array<struct<fact:string,source:string>>"


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts as one JSON object, a JSON list, or JSON lines; step and channel default to the first mail."""
    whole = not path.endswith((".jsonl", ".ndjson"))
    rows = spark.read.schema(_DRAFT).option("multiLine", whole).json(path)
    return rows.withColumns({"step": F.coalesce("step", F.lit(1)), "channel": F.coalesce("channel", F.lit("email"))})


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct entries of a list, one a line, with comments after ``#``."""
    from leadloom.operators.outreach import suppression_list

    return suppression_list(spark.read.text(path))
