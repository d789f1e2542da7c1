"""The index of patterns gives just what every pattern alone gives."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.operators import market
from leadloom.operators.pattern_index import PatternIndex, alternatives, literals


def test_literals_that_a_match_must_contain():
    assert alternatives(r"a|b(c|d)|[|]e\|f") == ["a", "b(c|d)", r"[|]e\|f"] and alternatives(r"\Qa|b\E") is None
    assert literals("parser") == ["parser"] and literals("pars(er|ing) bot") == ["pars", " bot"] and literals(r"colou?r") == ["colo", "r"]
    assert literals(r"ab+c") == ["ab", "c"] and literals(r"ab{0,2}cd") == ["a", "cd"] and literals(r"a\.b\wcd") == ["a.b", "cd"]
    assert literals(r"x[a-z]y(?:q|(r)s)*z") == ["x", "y", "z"] and literals(r"\p{L}abc\x41d") == ["abc", "d"] and literals("logoςς") == ["logo"]
    assert literals(r"[]a]bcd") == ["bcd"] and literals(r"^.$") == []


def texts_and_patterns(n):
    rng = random.Random(n)
    stems = ["".join(rng.choices("abcdefgклмно", k=rng.randint(4, 7))) for _ in range(n)]
    shapes = [lambda s: s, lambda s: rf"\b{s}\w*", lambda s: f"{s[:3]}.?{s[3:]}", lambda s: f"{s}|{s[::-1]}x", lambda s: f"({s}|zzz) ?end", lambda s: f"{s[:2]}[{s[2]}x]{s[3:]}", lambda s: f"{s[0]}+{s[1:]}", lambda s: f"(?:{s})+"]
    patterns = [rng.choice(shapes)(s) for s in stems] + ["..", "ſtraße", "STRASSE", r"a.b\.c", "x{2}yz", "K9"]
    words = [*stems, *[s[:3] + "-" + s[3:] for s in stems[:40]], *[s[::-1] + "x" for s in stems[:40]], "straße", "STRASSE", "a1b.c", "xxyz", "K9 and more", "zzz end", "Σίσυφος"]
    rows = [(i, None if i == 3 else " ".join(rng.choice([w, w.upper(), w + "tail"]) for w in rng.choices(words, k=rng.choice([0, 1, 5, 30])))) for i in range(200)]
    return rows, patterns


@pytest.mark.parametrize("n", [3, 120])
def test_index_equals_every_pattern_alone(spark, n):
    rows, patterns = texts_and_patterns(n)
    df = spark.createDataFrame(rows, "id long, text string")
    alone = F.array_compact(F.array(*[F.when(norm.matches(F.col("text"), p), F.lit(i)) for i, p in enumerate(patterns)]))
    got = PatternIndex(patterns).matched(df, F.col("text"), "got").select("id", "got", alone.alias("want")).collect()
    assert all(r.got == r.want for r in got) and sum(map(len, (r.want for r in got))) > 200


def test_rules_by_index_are_those_without(spark, monkeypatch):
    rows, patterns = texts_and_patterns(60)
    rules = [market.Rule(f"r{i}", p, product=("bot",) if i % 3 == 0 else ()) for i, p in enumerate(patterns)]
    df = spark.createDataFrame([(i, t, "bot" if i % 2 else "site") for i, t in rows], "id long, title string, product string").withColumns({c: F.lit(None).cast("string") for c in ("description", "category")})
    cfg = market.MarketConfig(products=rules[::-1])
    found = []
    for least in (10_000, 1):
        monkeypatch.setattr(market, "INDEX_FROM", least)
        found.append((sorted(map(tuple, market.rule_hits(df, rules).select("id", "rule").collect())), sorted(map(tuple, market.with_product(df.drop("product"), cfg).select("id", "product").collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 100


def test_time_hardly_depends_on_the_number_of_patterns(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(1500)], "id long, text string").repartition(2).cache()
    df.count()
    took = []
    for n in (100, 1000):
        index = PatternIndex([rf"\b{w[:6]}\w*" for w in words[:n]])
        run = lambda index=index: index.matched(df, F.col("text"), "hits").select(F.sum(F.size("hits"))).first()
        run()
        began = time.time()
        run()
        took.append(time.time() - began)
    df.unpersist()
    assert took[1] < 5 * took[0] + 0.5
