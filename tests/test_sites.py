import datetime

import duckdb
from pyspark.sql import functions as F

from leadloom.operators import outreach, pages, signals
from leadloom.plans import page_cases
from leadloom.sources import payloads, quality
from leadloom.sources.files import map_aliases, uncollected, unit_plan

HOME = """<html lang="en"><head><title>Bright &amp; Co</title><meta content="Dental care" name="description"><script src="/wp-content/x.js"></script></head><body>
<a href="mailto:Info@bright.co?subject=x">mail</a> <a href="tel:+44 20 7946 0000">call</a> <a href="/contact">Contact us</a> <a href="/cart">Contact cart</a> <a href="https://other.org/contact">Contact</a>
<a href="https://www.facebook.com/bright?x=1">fb</a> <a href="https://jobs.lever.co/bright">jobs</a> <form></form> &copy; 2018-2019 Bright Ltd. Registered in England company number 01234567. write to sales@bright.co</body></html>"""
TEAM = """<html><body><div>Jane Smith | Founder</div><p>CEO: John Doe</p> ИНН 7707083893 Bright Dental Ltd</body></html>"""


def page_rows(spark):
    rows = [("https://bright.co", "https://bright.co/", "https://bright.co/", 200, True, HOME, "2024-01-01", True), ("https://bright.co", "https://bright.co/team", "https://bright.co/team", 200, True, TEAM, "2024-01-01", False), ("http://gone.org", "http://gone.org", "http://gone.org", 404, True, "", "2024-01-01", True)]
    return spark.createDataFrame(rows, "site string, url string, final_url string, status int, cert_ok boolean, html string, fetched string, is_home boolean")


def test_page_contacts(spark):
    home = pages.extract_pages(page_rows(spark)).filter("url like '%.co/'").first()
    assert home["title"] == "Bright & Co" and home["description"] == "Dental care" and home["lang"] == "en" and not home["mobile"] and home["has_form"] and not home["privacy_link"]
    assert home["emails"] == ["info@bright.co", "sales@bright.co"] and home["phones"] == ["+442079460000"] and home["copyright_year"] == 2019 and "wordpress" in home["tech"]
    assert home["socials"] == {"facebook": ["https://www.facebook.com/bright"]} and home["registry_ids"] == {"company_number": ["01234567"]} and home["job_boards"][0]["token"] == "bright"
    inner = page_rows(spark).filter("is_home and status = 200").select(pages.inner_links(F.col("html"), F.col("final_url"))).first()[0]
    assert inner == ["https://bright.co/contact"]


def test_site_rollup_and_signals(spark):
    sites = pages.site_rollup(pages.extract_pages(page_rows(spark)))
    got = {r["site"]: r for r in sites.collect()}
    b = got["https://bright.co"]
    assert b["reachable"] and b["builder"] == "wordpress" and len(b["pages"]) == 2 and b["registry_ids"]["inn"] == ["7707083893"]
    assert [(p["name"], p["role"].lower()) for p in b["people"]] == [("Jane Smith", "founder")]
    texts = spark.createDataFrame([("CEO: John Doe. Our team",), ("Jane Doe Founder Mark Example Practice Manager",), ("nobody",), (None,)], "t string")
    got_people = [[(p["name"], p["role"].lower()) for p in r[0]] for r in texts.select(pages.people_in(F.col("t"))).collect()]
    assert got_people == [[("John Doe", "ceo")], [("Jane Doe", "founder"), ("Mark Example", "practice manager")], [], []]
    assert not got["http://gone.org"]["reachable"] and got["http://gone.org"]["error"] == "HTTPError"
    found = {r["type"] for r in pages.site_signals(sites, datetime.date(2024, 1, 1)).filter("site like '%bright%'").collect()}
    assert found == {"outdated_site", "not_mobile_friendly", "form_without_privacy_link"}


def equals_sql(spark, folder, rows, name):
    """Whether a query over a table of pages (page_id, url, html) gives the rows of its SQL, on one thread."""
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).sortWithinPartitions("page_id").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    got, want = page_cases.QUERIES[name](spark, str(folder)), con.sql(page_cases.ORACLES[name])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


TITLES = ["token = &quot;2a&quot;", " Bright &amp; Co&nbsp;", "&amp;lt;b&amp;gt; &eacute;&#39;", "", "&quot;" * 60]


def test_titles_of_page_facts_resolve_what_the_sql_does(spark, tmp_path):
    html = lambda t: f"<html lang='en'><title>{t}</title><form><a href='/x'>x</a></html>"
    equals_sql(spark, tmp_path, [(i, f"https://a.org/{i}", html(t)) for i, t in enumerate(TITLES)], "page_facts")
    whole = pages.extract_pages(page_rows(spark).withColumn("html", F.lit(html(TITLES[0]))))
    assert {r["title"] for r in whole.collect()} == {'token = "2a"'}


def test_titles_of_site_pages_resolve_what_the_sql_does(spark, tmp_path):
    equals_sql(spark, tmp_path, [(2 * i, f"https://a{i}.org/", f"<title>{t}</title>") for i, t in enumerate(TITLES) if i < 3], "site_pages")


def test_of_pages_with_one_address_the_first_is_home(spark, tmp_path):
    """Certificate, title and language are those of one page: the first with the least address."""
    rows = [(i, f"https://a.org/{'z' if i < 6 else 'b'}", f"<html lang='l{i}'><title>{t}</title></html>") for i, t in enumerate("hgfedcbahgfedcba")]
    equals_sql(spark, tmp_path, rows, "site_pages")
    # Without places there is no first page, but still one page however the rows are dealt.
    landed = page_cases.landed_pages(spark, str(tmp_path)).drop("place")
    dealt = [pages.site_rollup(pages.extract_pages(landed).repartition(n, F.xxhash64("html", F.lit(n)))).select("title", "lang", "cert_ok", "final_url").collect() for n in (1, 5)]
    assert dealt[0] == dealt[1] and dealt[0][0]["title"] == "hgfedcba"[int(dealt[0][0]["lang"][1:]) % 8]


def test_dns_blocks(spark):
    rows = [
        ("a.org", "MX", 0, ["20 alt.aspmx.l.google.com.", "10 ASPMX.L.Google.com."]), ("a.org", "TXT", 0, ['"v=spf1 include:_spf.google.com " "include:sendgrid.net ~all"']), ("_dmarc.a.org", "TXT", 0, ["v=DMARC1; p=reject"]),
        ("b.org", "MX", 0, ["0 ."]), ("b.org", "TXT", 3, []), ("c.org", "MX", 2, None), ("d.org", "MX", 0, ["5 mx.d.org"]),
    ]
    got = {r["domain"]: r for r in signals.dns_blocks(spark.createDataFrame(rows, "name string, rtype string, status int, answers array<string>")).collect()}
    assert got["a.org"]["mx"][0] == "aspmx.l.google.com" and got["a.org"]["mail_provider"] == "google-workspace" and got["a.org"]["spf_tools"] == ["google-workspace", "sendgrid"] and got["a.org"]["dmarc_policy"] == "reject"
    assert got["b.org"]["mx"] == [] and got["b.org"]["mail_provider"] is None and got["c.org"]["error"] and got["d.org"]["mail_provider"] == "self-hosted/other"
    lead = "id string, domain string, emails array<struct<value:string,verified:string>>, signals array<struct<type:string,value:string,source:string,date:string>>"
    leads = spark.createDataFrame([("1", "a.org", [("x@a.org", "none"), ("y@b.org", "none")], []), ("2", "b.org", [], [])], lead)
    out = {r["id"]: r for r in signals.join_dns(leads, signals.dns_blocks(spark.createDataFrame(rows, "name string, rtype string, status int, answers array<string>")), "2024-01-01").collect()}
    assert [e["verified"] for e in out["1"]["emails"]] == ["mx", "none"] and [s["type"] for s in out["2"]["signals"]] == ["no_mx"]


def test_boards_must_belong(spark):
    payload = '{"jobs":[{"title":"Engineer","location":{"name":"Berlin"},"absolute_url":"https://x/1","updated_at":"2024-01-05T00:00","company_name":"Other"},{"title":"Engineer","company_name":"Other"}]}'
    ashby = '{"jobs":[{"title":"Cook","descriptionPlain":"join acme.org","isListed":true},{"title":"Hidden","isListed":false}]}'
    posts = signals.board_postings(spark.createDataFrame([("greenhouse", "acme", payload), ("ashby", "acme", ashby)], "ats string, token string, payload string"))
    assert posts.count() == 3
    lead = "id string, name string, domain string, job_boards array<struct<ats:string,token:string>>, signals array<struct<type:string,value:string,source:string,date:string>>"
    leads = spark.createDataFrame([("1", "Acme", "acme.org", [], []), ("2", "Zed", "zed.org", [("greenhouse", "acme")], []), ("3", "None", None, [], [])], lead)
    got = {r["id"]: r for r in signals.join_boards(leads, posts, "2024-01-01").collect()}
    assert [b["ats"] for b in got["1"]["jobs"]["boards"]] == ["ashby"] and got["1"]["signals"][0]["value"] == "1 open roles (ashby): Cook"
    assert got["2"]["jobs"]["open_roles"] == 2 and got["3"]["jobs"]["open_roles"] == 0


def test_registry_and_contacts(spark):
    html = "<table id=\"ResList1\"><tr class='clmn1'><td>77-1</td><td>ООО Ромашка<br>юр. лицо<br>ИНН 77</td><td>x</td><td>01.01.2020</td><td>02.02.2020</td></tr></table>"
    r = signals.registry_rows(spark.createDataFrame([("77", html), ("78", "<table id=\"ResList1\"></table>")], "inn string, html string")).collect()
    assert [tuple(x) for x in r] == [("77", "77-1", "ООО Ромашка", "юр. лицо", "01.01.2020", "02.02.2020")]
    lead = "id string, domain string, legal struct<name:string,registry_ids:map<string,string>>, emails array<struct<value:string,source:string,type:string,verified:string>>, people array<struct<name:string,role:string,source:string>>, signals array<struct<type:string,value:string,source:string,date:string>>"
    leads = spark.createDataFrame([("1", "a.org", ("Site name", {"company_number": "123"}), [("x@a.org", "site", "personal", "none")], [("Ann", "ceo", "site")], [])], lead)
    companies = spark.createDataFrame([("gb/00000123", "ACME LTD", "dissolved", "2023-06-01", [("Ann", "director"), ("Bob", "director")], "u")], "ref string, name string, status string, incorporated string, officers array<struct<name:string,role:string>>, url string")
    out = signals.join_registry(leads, companies, "2024-01-01").first()
    assert out["legal"]["name"] == "ACME LTD" and [p["name"] for p in out["people"]] == ["Ann", "Bob"] and {s["type"] for s in out["signals"]} == {"new_registration", "company_inactive"}
    contacts = spark.createDataFrame([("a.org", [("X@a.org", "personal", "Ann", "Lee", "CTO", ["s"], "valid"), ("new@a.org", "personal", "Cy", "Dee", "COO", [], "valid")])], "domain string, emails array<struct<value:string,type:string,first_name:string,last_name:string,position:string,sources:array<string>,status:string>>")
    got = signals.join_contacts(leads, contacts, "2024-01-01").first()
    assert [(e["value"], e["verified"]) for e in got["emails"]] == [("x@a.org", "none"), ("new@a.org", "smtp")] and [p["name"] for p in got["people"]] == ["Ann", "Ann Lee", "Cy Dee"]


LANDED = "source string, unit string, collected string, pos int, payload string"


def landed(spark, *pages_, unit="u"):
    return spark.createDataFrame([("s", unit, "2024-01-01", i, p) for i, p in enumerate(pages_)], LANDED)


def test_map_elements(spark):
    p = '{"elements":[{"type":"node","id":1,"lat":1.5,"lon":2.5,"tags":{"name":"Cut","shop":"hairdresser","hairdresser":"barber","phone":"+1 23;+4 56","website":"http://a.b;http://c.d","contact:instagram":"@cut","addr:street":"Main","addr:housenumber":"5","addr:city":"Rome"}},{"type":"way","id":2,"center":{"lat":3.0,"lon":4.0},"tags":{"brand":"B","amenity":"pub"}},{"type":"node","id":3,"tags":{"shop":"x"}}]}'
    rows = payloads.osm_elements(landed(spark, p)).orderBy("source_id").collect()
    assert [r["name"] for r in rows] == ["Cut", "B"] and rows[0]["phones"] == ["+1 23", "+4 56"] and rows[0]["socials"] == {"instagram": ["https://instagram.com/cut"]} and rows[0]["address"] == "Main 5, Rome" and rows[1]["lat"] == 3.0
    e = payloads.osm_elements(landed(spark, p))
    assert [e.filter(payloads.osm_filter(q)).count() for q in ("barber", "bar", "shop=hairdresser", "shop~^h", "cut", "zzz")] == [1, 1, 1, 1, 1, 0]


def test_filings_and_offerings(spark):
    hit = lambda cik, form, day, ref: '{"_id":"%s","_source":{"form":"%s","ciks":["%s"],"file_date":"%s","display_names":["Foo (CIK 001)"]}}' % (ref, form, cik, day)
    p = '{"hits":{"hits":[' + ",".join([hit("001", "D", "2024-01-02", "1-2:a.xml"), hit("001", "D", "2024-01-03", "1-3:b.xml"), hit("002", "D/A", "2024-01-03", "1-4:c.xml")]) + "]}}"
    f = payloads.filing_hits(landed(spark, p)).collect()
    assert [(r["cik"], r["filed"], r["name"]) for r in f] == [("1", "2024-01-03", "Foo")]
    xml = "<edgarSubmission><primaryIssuer><entityName>Foo Inc</entityName><issuerPhoneNumber>2025550100</issuerPhoneNumber><issuerAddress><street1>1 A St</street1><city>RENO</city><stateOrCountry>NV</stateOrCountry><zipCode>1</zipCode></issuerAddress></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Ann</firstName><lastName>Lee</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship></relatedPersonRelationshipList></relatedPersonInfo></relatedPersonsList><offeringData><industryGroup><industryGroupType>Biotech</industryGroupType></industryGroup><offeringSalesAmounts><totalOfferingAmount>1000000</totalOfferingAmount><totalAmountSold>5000</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"
    rows = landed(spark, xml, "<!DOCTYPE x>" + xml).withColumns({"cik": F.lit("1"), "adsh": F.lit("1-2"), "file": F.lit("a.xml"), "filed": F.lit("2024-01-03"), "name": F.lit("F")})
    got = payloads.private_offerings(rows).collect()
    assert len(got) == 1 and got[0]["phones"] == ["+12025550100"] and got[0]["city"] == "Reno" and got[0]["people"][0]["name"] == "Ann Lee" and got[0]["signals"][0]["value"] == "Form D 2024-01-03: $5,000 sold of $1,000,000 offered"


def test_hiring_posts(spark):
    p = '{"title":"t","children":[{"id":7,"created_at":"2024-01-02T","text":"Acme (YC) | Engineer | Remote | https:&#x2F;&#x2F;careers.acme.com&#x2F;jobs<p>write to a@acme.com <a href=\\"https:&#x2F;&#x2F;jobs.lever.co&#x2F;acme\\">x</a>"},{"id":8,"text":"Zed | Cook | Berlin<p><a href=\\"https:&#x2F;&#x2F;news.example.org\\">x</a>"}]}'
    got = payloads.hiring_posts(landed(spark, p)).orderBy("source_id").collect()
    assert got[0]["name"] == "Acme" and got[0]["sites"] == ["https://acme.com/"] and got[0]["emails"] == ["a@acme.com"] and got[0]["job_boards"][0]["token"] == "acme" and got[1]["sites"] == []
    assert payloads.hiring_posts(landed(spark, p), keywords=[["cook", "baker"]], locations=["berlin"]).count() == 1


def test_order_blocks(spark):
    fl = 'x qa-project-name="project-item 11" <a id="prj_name_11" href="/p/11">Сделать <b>сайт</b></a><div class="b-post__price">5 000 – 7 000 ₽</div><div class="b-post__txt text-5 ">текст</div> Откликнуться Вакансия 3 ответа 2 часа назад'
    r = payloads.freelance_blocks(landed(spark, fl.replace("project-item 11", "project-item11"))).first()
    assert (r["source_id"], r["budget"], r["budget_max"], r["type"], r["offers"], r["title"]) == (11, 5000, 7000, "vacancy", 3, "Сделать сайт")
    tg = '<div class="tgme_widget_message_wrap"><div data-post="ch/5"></div><div class="tgme_widget_message_text js">Нужен бот<br>Бюджет: 15 000 руб</div><time datetime="2024-01-02"></time>'
    t = payloads.channel_posts(landed(spark, tg, unit="ch")).first()
    assert (t["source_id"], t["title"], t["budget"], t["currency"], t["created"]) == (5, "Нужен бот", 15000, "RUB", "2024-01-02")
    board = '{"x":1,"pagination":{"last_page":1,"data":[{"id":4,"name":"A","priceLimit":"10.0","category_id":"3","kwork_count":2,"user":{"username":"u"}},{"id":4,"name":"A"}]}} "CATID":"3","name":"Sites"'
    b = payloads.board_orders(landed(spark, board), payloads.board_categories(landed(spark, board))).collect()
    assert len(b) == 1 and b[0]["budget"] == 10 and b[0]["category"] == "Sites"


def test_layouts_and_units(spark):
    got = [r[0] for r in payloads.layout_status(landed(spark, "xMARK", "short", "y" * 60_000), "MARK").orderBy("pos").select("outcome").collect()]
    assert got == ["ok", "blocked", "layout_changed"]
    rows = [("s", f"u{i}", i, o, 1) for i, o in enumerate(["layout_changed", "ok", "layout_changed", "failed", "layout_changed", "ok"])]
    r = quality.collect_report(spark.createDataFrame(rows, "source string, unit string, pos int, outcome string, rows int")).first()
    assert (r["units"], r["rows"], r["failed"], r["layout_changed"], r["blocked"]) == (1, 1, 4, 3, False)
    plan = unit_plan(spark, "s", ["A b", "C"], ["x", "y"])
    done = plan.filter("location = 'C'").select("source", "unit").withColumn("day", F.lit("2024-01-01"))
    assert uncollected(plan, done).count() == 2 and uncollected(plan, done, "2024-01-02").count() == 4


def test_list_headers(spark):
    df = spark.createDataFrame([("Acme", "a.org; b.org", "4.5", "x"), (None, None, "1", "y")], "`Company Name` string, Website string, Stars string, `Odd_col` string")
    got = map_aliases(df).collect()
    assert len(got) == 1 and got[0]["name"] == "Acme" and got[0]["sites"] == ["a.org", "b.org"] and got[0]["rating"] == 4.5 and got[0]["extra"] == {"odd col": "x"}


def test_drafts_and_batches(spark):
    lead = "id string, domain string, phones array<string>, emails array<struct<value:string,type:string,verified:string>>, tier string, score double, status string, notes string"
    leads = spark.createDataFrame([("a.org", "a.org", [], [("g@a.org", "generic", "mx"), ("p@a.org", "personal", "mx")], "A", 9.0, "new", None), ("b.org", "b.org", ["790"], [], "D", 1.0, "new", "n")], lead)
    assert leads.select(outreach.best_email(F.col("emails"))).first()[0] == "p@a.org"
    draft = "lead_id string, step int, channel string, to string, subject string, body string, evidence array<struct<fact:string,source:string>>"
    new = spark.createDataFrame([("a.org", 1, "email", None, "Hi", "text", [("f", "s")])], draft)
    none = spark.createDataFrame([], "id string, lead_id string, step int, channel string, to string, subject string, body string, evidence array<struct<fact:string,source:string>>, status string, created string, updated string")
    drafts, counts = outreach.upsert_drafts(none, new, leads, "2024-01-01")
    assert counts.first()["outcome"] == "added"
    sent = spark.createDataFrame([], "draft_id string, lead_id string, step int, to string, sent_at timestamp")
    now = datetime.datetime(2024, 1, 2)
    plan = outreach.send_plan(drafts, leads, sent, spark.createDataFrame([], "entry string"), outreach.SendConfig(), now)
    items = outreach.batch_of(plan)
    assert [r["verdict"] for r in outreach.reconcile(items, plan).collect()] == ["ok"] and len(outreach.batch_id(items).first()[0]) == 8
    changed, _ = outreach.upsert_drafts(drafts, new.withColumn("body", F.lit("other")), leads, "2024-01-02")
    again = outreach.send_plan(changed, leads, sent, spark.createDataFrame([], "entry string"), outreach.SendConfig(), now)
    assert outreach.reconcile(items, again).first()["verdict"].startswith("changed")
    blocked = outreach.send_plan(drafts, leads, sent, outreach.suppression_list(spark.createDataFrame([("@A.org # bye",), ("#",)], "value string")), outreach.SendConfig(), now)
    assert blocked.first()["reason"] == "suppressed" and not blocked.first()["ready"]
    out, entries = outreach.mark_status(leads, spark.createDataFrame([("b.org", "suppressed", "asked")], "id string, new_status string, note string"))
    assert out.filter("id = 'b.org'").first()["notes"] == "n\nasked" and [r[0] for r in entries.collect()] == ["b.org"]
