from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.operators import export, resolve, rules
from leadloom.plans.components import connected_components

RAW = "pos long, source string, source_id string, name string, website string, city string, phones array<string>, emails array<string>, reviews long, rating double, socials map<string,array<string>>"


def test_components_of_chain_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 40)] + [(7, 7), (40, 41), (41, 40), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 40)} == {1} and got[41] == got[40] == 40 and len(got) == 61 + 39 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_records_meet_over_any_key(spark):
    rows = [
        (0, "a", "1", "Acme", "https://www.acme.com/x", "Lisbon", ["211 234 567"], ["Info@Acme.com"], 5, 4.0, {}),
        (1, "b", "2", "Acme Lda", None, "Lisbon", ["+351 211 234 567"], [], 50, 4.5, {}),
        (2, "c", "3", "Acme", "https://facebook.com/acme", "Lisbon", [], ["bob@acme.com", "info@acme.com"], None, None, {}),
        (3, "c", "4", "Other", None, None, None, None, None, None, None),
    ]
    got = resolve.resolve(spark.createDataFrame(rows, RAW), "351").orderBy("id").collect()
    assert len(got) == 2
    acme = got[0]
    assert acme["id"] == "acme.com" and acme["name"] == "Acme" and acme["reviews"] == 50 and acme["rating"] == 4.5 and acme["phones"] == ["351211234567"]
    assert [e["value"] for e in acme["emails"]] == ["info@acme.com", "bob@acme.com"] and acme["names"] == ["Acme", "Acme Lda"] and acme["socials"] == {"facebook": ["https://facebook.com/acme"]}
    assert len(acme["sources"]) == 3 and got[1]["id"].startswith("h-")


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, "s", str(i), f"N{i % 7}", f"https://s{i % 5}.org" if i % 3 else None, "C" if i % 2 else None, [f"7900{i % 11:07d}"], [f"a{i}@s{i % 5}.org"], i, float(i), {}) for i in range(60)]
    df = spark.createDataFrame(rows, RAW)
    one, many = resolve.resolve(df.coalesce(1)), resolve.resolve(df.repartition(7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


LEADS = "id string, name string, reviews int, website string, segment string, categories array<string>, emails array<struct<value:string,verified:string>>, signals array<struct<type:string,value:string>>, site struct<reachable:boolean,tech:array<string>>"
RICH = ("a", "Smile 24", 30, "s.com", "dentist", ["health"], [("x@s.com", "mx"), ("y@s.com", "none")], [("hiring", "2 roles")], (True, ["wix"]))
POOR = ("b", None, None, None, None, None, None, None, None)


def test_rules(spark):
    df = spark.createDataFrame([RICH, POOR], LEADS)
    R = rules.ScoreRule
    cases = [
        (R("has", has="emails"), True, False), (R("missing", missing="website"), False, True), (R("eq", field="emails.verified", eq="mx"), True, False), (R("ne", field="emails.verified", ne="mx"), False, True),
        (R("ne2", field="emails.verified", ne="smtp"), True, True), (R("gte", field="reviews", gte=30), True, False), (R("lte", field="reviews", lte=29), False, False), (R("in", field="segment", in_=("dentist",)), True, False),
        (R("contains", field="name", contains="SMILE"), True, False), (R("matches", field="name", matches=r"\d+$"), True, False), (R("signal", signal=("hiring",)), True, False), (R("tech", tech=("wix", "tilda")), True, False),
        (R("category", category="dent|ortho"), True, False), (R("bool", field="site.reachable", eq=True), True, False), (R("unknown", has="nothing.here"), False, False), (R("unknown2", missing="nothing.here"), True, True),
    ]
    got = df.select(*[rules.condition(r, df.schema).alias(r.name) for r, _, _ in cases]).collect()
    for r, rich, poor in cases:
        assert (got[0][r.name], got[1][r.name]) == (rich, poor), r.name


def test_scores_tiers_and_disqualified(spark):
    df = spark.createDataFrame([RICH, POOR], LEADS)
    got = {r["id"]: r for r in rules.score_leads(df, [rules.ScoreRule("mail", 45, has="emails"), rules.ScoreRule("none", -5, missing="emails"), rules.ScoreRule("out", disqualify=True, field="segment", eq="dentist")]).collect()}
    assert got["a"]["score"] == 45 and got["a"]["tier"] == "D" and got["a"]["score_breakdown"] == {"mail": "45", "out": "disqualified"} and got["b"]["score"] == -5 and got["b"]["tier"] == "D"
    assert [rules.tier_for(F.lit(x), rules.DEFAULT_TIERS) is not None for x in (60, 40)] == [True, True]


def test_cells_are_guarded(spark):
    cells = ["=1", " =1", "+1", "-x", "@a", "\ta", "＝1", "a=1", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(norm.csv_guard(F.col("c"))).collect()]
    assert got == ["'=1", "' =1", "'+1", "'-x", "'@a", "'\ta", "'＝1", "a=1", "", None]


def test_export(spark, tmp_path):
    df = rules.score_leads(spark.createDataFrame([RICH, POOR], LEADS), [rules.ScoreRule("mail", 70, has="emails")]).withColumns({"status": F.lit("new"), "phones": F.array(F.lit("-1"))})
    export.export_csv(df, str(tmp_path / "out"), min_tier="A")
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["phone"] == "'-1" and got[0]["score"] == "70.0" and len(got[0]) == 36


def test_scalars(spark):
    url = spark.createDataFrame([("HTTPS://www.Пример.рф:80/a",), ("example.org/x",), ("localhost",), ("http://u@a.B.com.",), ("",), (None,)], "u string")
    assert [r[0] for r in url.select(norm.host(F.col("u"))).collect()] == ["xn--e1afmkfd.xn--p1ai", "example.org", None, "a.b.com", None, None]
    ph = spark.createDataFrame([("8 (900) 123-45-67",), ("0044 20 7946 0000",), ("12",), (None,)], "p string")
    assert [r[0] for r in ph.select(norm.phone_digits(F.col("p"))).collect()] == ["79001234567", "442079460000", None, None]
    inn = spark.createDataFrame([("7707083893",), ("7707083894",), ("500100732259",), ("x",), (None,)], "i string")
    assert [r[0] for r in inn.select(norm.inn_ok(F.col("i"))).collect()] == [True, False, True, False, False]
    html = spark.createDataFrame([("<b>A&amp;B</b>\n c",), (None,)], "h string")
    assert [r[0] for r in html.select(norm.clean_text(F.col("h"))).collect()] == ["A&B c", ""]
    boards = spark.createDataFrame([("see https://jobs.lever.co/acme and https://boards.greenhouse.io/embed/job_board?for=Beta https://jobs.lever.co/acme/1",)], "t string")
    assert [(b["ats"], b["token"]) for b in boards.select(norm.job_boards(F.col("t"))).first()[0]] == [("greenhouse", "beta"), ("lever", "acme")]
