"""Rule scoring: readable rules compiled to one projection, with the points of each rule that matched and a tier."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import norm
from leadloom.functions import patterns as P

DEFAULT_TIERS = {"A": 60, "B": 40, "C": 20}


@dataclass(frozen=True)
class ScoreRule:
    """All conditions that are given must hold. ``points`` may be negative; ``disqualify`` puts a lead in tier D."""

    name: str
    points: float = 0
    disqualify: bool = False
    has: str | None = None
    missing: str | None = None
    field: str | None = None
    eq: Any = None
    ne: Any = None
    gte: float | None = None
    lte: float | None = None
    in_: tuple = ()
    contains: str | None = None
    matches: str | None = None
    signal: tuple[str, ...] = ()
    tech: tuple[str, ...] = ()
    category: str | None = None


def path_values(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """All values at a dotted path as a list, through lists and maps, and their type; None for an unknown path."""
    first, *rest = path.split(".")
    if first not in schema.names:
        return None
    values, kind = F.array(F.col(f"`{first}`")), schema[first].dataType

    def spread(values: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
        while isinstance(kind, T.ArrayType):
            values, kind = F.flatten(F.array_compact(values)), kind.elementType
        return F.array_compact(values), kind

    def field(values: Column, name: str) -> Column:
        return F.transform(values, lambda v: v[name])

    def entry(values: Column, name: str) -> Column:
        return F.transform(values, lambda v: F.try_element_at(v, F.lit(name)))

    values, kind = spread(values, kind)
    for name in rest:
        if isinstance(kind, T.StructType) and name in kind.names:
            values, kind = field(values, name), kind[name].dataType
        elif isinstance(kind, T.MapType):
            values, kind = entry(values, name), kind.valueType
        else:
            return None
        values, kind = spread(values, kind)
    return values, kind


def _truthy(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.length(v) > 0
    if isinstance(kind, T.BooleanType):
        return v
    if isinstance(kind, T.MapType):
        return F.size(v) > 0
    if isinstance(kind, T.StructType):
        return v.isNotNull()
    return v != 0


def any_truthy(schema: T.StructType, path: str) -> Column:
    found = path_values(schema, path)
    return F.coalesce(F.exists(found[0], lambda v: _truthy(v, found[1])), F.lit(False)) if found else F.lit(False)


def condition(rule: ScoreRule, schema: T.StructType) -> Column:
    """A rule as one boolean expression. Without values comparisons fail, but for ``ne``, which then holds."""
    tests = []
    if rule.has:
        tests.append(any_truthy(schema, rule.has))
    if rule.missing:
        tests.append(~any_truthy(schema, rule.missing))
    if rule.field:
        found = path_values(schema, rule.field)
        holds = lambda test: F.coalesce(F.exists(found[0], test), F.lit(False)) if found else F.lit(False)
        text = lambda v: F.lower(v.cast("string"))
        if rule.eq is not None:
            tests.append(holds(lambda v: v == F.lit(rule.eq)))
        if rule.ne is not None:
            tests.append(~holds(lambda v: v == F.lit(rule.ne)))
        if rule.gte is not None:
            tests.append(holds(lambda v: v.cast("string").try_cast("double") >= rule.gte))
        if rule.lte is not None:
            tests.append(holds(lambda v: v.cast("string").try_cast("double") <= rule.lte))
        if rule.in_:
            tests.append(holds(lambda v: v.isin(list(rule.in_))))
        if rule.contains is not None:
            tests.append(holds(lambda v: F.contains(text(v), F.lit(rule.contains.lower()))))
        if rule.matches is not None:
            tests.append(holds(lambda v: v.cast("string").rlike(norm.IGNORE_CASE + rule.matches)))
    if rule.signal:
        tests.append(F.coalesce(F.exists("signals", lambda s: s["type"].isin(list(rule.signal))), F.lit(False)))
    if rule.tech:
        tests.append(F.coalesce(F.arrays_overlap(F.col("site.tech"), F.array(*map(F.lit, rule.tech))), F.lit(False)))
    if rule.category:
        blob = F.concat_ws(" | ", F.array_join("categories", " | "), F.coalesce("segment", F.lit("")))
        tests.append(norm.matches(blob, rule.category))
    if not tests:
        raise ValueError(f"rule {rule.name!r} has no condition")
    return reduce(lambda a, b: a & b, tests)


def tier_for(score: Column, tiers: dict[str, float]) -> Column:
    """The tier with the highest threshold that is reached, else D."""
    ordered = sorted(tiers.items(), key=lambda kv: -kv[1])
    return F.coalesce(*[F.when(score >= least, F.lit(t)) for t, least in ordered], F.lit("D"))


def score_leads(leads: DataFrame, rules: Iterable[ScoreRule], tiers: dict[str, float] | None = None) -> DataFrame:
    """Leads with score, score_breakdown (rule to points) and tier. A narrow projection: no row moves."""
    rules, tiers = list(rules), tiers or DEFAULT_TIERS
    out = leads.withColumns({f"_rule{i}": condition(r, leads.schema) for i, r in enumerate(rules)})
    total = reduce(lambda a, b: a + b, [F.when(F.col(f"_rule{i}"), F.lit(float(r.points))).otherwise(0.0) for i, r in enumerate(rules) if not r.disqualify], F.lit(0.0))
    out_rule = reduce(lambda a, b: a | b, [F.col(f"_rule{i}") for i, r in enumerate(rules) if r.disqualify], F.lit(False))
    entries = [F.when(F.col(f"_rule{i}"), F.struct(F.lit(r.name).alias("key"), F.lit("disqualified" if r.disqualify else f"{r.points:g}").alias("value"))) for i, r in enumerate(rules)]
    breakdown = F.map_from_entries(F.array_compact(F.array(*entries)))
    out = out.withColumns({"score": total, "score_breakdown": breakdown})
    out = out.withColumn("tier", F.when(out_rule, F.lit("D")).otherwise(tier_for(F.col("score"), tiers)))
    return out.drop(*[f"_rule{i}" for i in range(len(rules))])


def score_summary(scored: DataFrame, rules: Iterable[ScoreRule]) -> DataFrame:
    """(kind, name, leads): leads of each tier and hits of each rule, those without any included."""
    wanted = [("tier", t) for t in P.TIERS] + [("rule", r.name) for r in rules]
    spark = scored.sparkSession
    all_names = spark.createDataFrame(wanted, "kind string, name string")
    found = scored.select(F.explode(F.concat(F.array(F.struct(F.lit("tier").alias("kind"), F.col("tier").alias("name"))), F.transform(F.map_keys("score_breakdown"), lambda k: F.struct(F.lit("rule").alias("kind"), k.alias("name"))))).alias("x"))
    counts = found.groupBy("x.kind", "x.name").agg(F.count("*").alias("leads"))
    return all_names.join(counts, ["kind", "name"], "left").select("kind", "name", F.coalesce("leads", F.lit(0)).alias("leads"))


def tier_at_least(tier: Column, least: str) -> Column:
    """Whether a tier is as good as ``least``; an unknown tier is not."""
    return F.coalesce(norm.tier_rank(tier) <= P.TIERS.index(least), F.lit(False))


def needs_step(step: str, days_fresh: int | None = None, as_of: Any = None) -> Column:
    """Leads that lack a step (site, dns, jobs, registry, hunter) and can have it; refresh after ``days_fresh``."""
    able = {
        "site": norm.truthy_text(F.col("website")),
        "dns": norm.truthy_text(F.col("domain")) | norm.truthy_list(F.col("emails")),
        "jobs": norm.truthy_text(F.col("domain")) | norm.truthy_list(F.col("job_boards")),
        "registry": F.coalesce(F.size("legal.registry_ids") > 0, F.lit(False)),
        "hunter": norm.truthy_text(F.col("domain")),
    }[step]
    checked = F.col(f"{step}.checked").cast("string")
    missing = ~norm.truthy_text(checked)
    if days_fresh is not None:
        missing = missing | (F.to_date(checked) < F.date_sub(F.lit(as_of), days_fresh))
    return able & missing


def hunter_wanted(tiers: Iterable[str] = ("A", "B")) -> Column:
    return norm.truthy_text(F.col("domain")) & F.coalesce(F.col("tier").isin(list(tiers)), F.lit(False))
