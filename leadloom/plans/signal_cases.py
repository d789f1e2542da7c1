"""Queries over crawled pages and landed answers, and their joins with leads, with the SQL that they equal.

Customers stand for pages of sites (three to a site), for domains whose answers landed, and for leads. Lists are joined
into one text, so that every engine compares them alike.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import pages, signals
from leadloom.plans.source_cases import flat, flat_map, flat_signals, obj, say, text

_DAY = "2024-01-01"
_SIGNALS = "array<struct<type:string,value:string,source:string,date:string>>"
_PEOPLE = "array<struct<name:string,role:string,source:string>>"
_EMAILS = "array<struct<value:string,source:string,type:string,verified:string>>"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 3").alias("s"), (F.col("c_custkey") % 3).alias("j"))


def _flat_people(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda p: F.concat_ws("|", p["name"], p["role"], p["source"])), ",")


def _flat_text_map(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


# --- pages -----------------------------------------------------------------------------------------------------------


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages: a home page and two pages about the team for every site; every eleventh is missing."""
    k, s, j = F.col("k"), F.col("s"), F.col("j")
    site = say("https://firm{}.com", s)
    home = say(
        '<html lang="en"><head><title>Firm {} &amp; Co</title><meta content="Care {}" name="description">{}<script src="{}"></script></head><body><a href="mailto:Info@firm{}.com?subject=x">mail</a> <a href="tel:+44 20 7946 {}">call</a> '
        '<a href="/contact{}?a=1">Contact us</a> <a href="/cart">Contact cart</a> <a href="https://other.org/contact">Contact</a> <a href="https://www.facebook.com/firm{}?x=1">fb</a> <a href="https://jobs.lever.co/firm{}">jobs</a> <form></form>{}'
        " &copy; 2015-{} Firm{} Ltd. Registered in England company number {}. write to sales@firm{}.com</body></html>",
        s, s, F.when(s % 2 == 0, F.lit('<meta name="viewport" content="w">')).otherwise(""), F.when(s % 3 == 0, F.lit("/wp-content/x.js")).when(s % 3 == 1, F.lit("https://cdn.shopify.com/a.js")).otherwise("/app.js"), s, F.lpad(text(s), 6, "0"),
        s, s, s, F.when(s % 4 == 0, F.lit("<a href='/privacy'>privacy</a>")).otherwise(""), 2015 + s % 9, s, 10000000 + s, s,
    )
    team = say("<html><body><div>{} | Founder</div><p>| ИНН 7707083893 |</p><div>Bright{} GmbH |</div> write team{}@firm{}.com and team{}@firm{}.com</body></html>", F.when(k % 2 == 0, F.lit("Jane Smith")).otherwise("Mark Brown"), k, k, s, k, s)
    url = F.when(j == 0, F.concat(site, F.lit("/"))).otherwise(F.concat(site, F.lit("/team"), text(j)))
    read = k % 11 != 10
    return _customers(spark, sf_dir).select(
        "k", site.alias("site"), url.alias("url"), url.alias("final_url"), F.when(read, 200).otherwise(404).alias("status"), (s % 7 != 3).alias("cert_ok"), F.when(read, F.when(j == 0, home).otherwise(team)).alias("html"), F.lit(_DAY).alias("fetched"), (j == 0).alias("is_home")
    )


def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, ids, people, boards, technologies and inner links of each page."""
    landed = crawled_pages(spark, sf_dir)
    inner = landed.select("url", flat(pages.inner_links(F.col("html"), F.col("final_url"))).alias("inner_links"))
    boards = F.array_join(F.transform("job_boards", lambda b: F.concat_ws("/", b["ats"], b["token"])), ",")
    p = pages.extract_pages(landed).select(
        "url", "error", "title", "description", "lang", "mobile", "copyright_year", flat("emails").alias("emails"), flat("phones").alias("phones"), flat_map("socials").alias("socials"), flat_map("registry_ids").alias("registry_ids"), flat("legal_names").alias("legal_names"),
        boards.alias("job_boards"), _flat_people("people").alias("people"), flat("tech").alias("tech"), flat(F.transform("tech", pages.tech_category)).alias("tech_categories"),
    )
    return p.join(inner, "url")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.site_rollup(pages.extract_pages(crawled_pages(spark, sf_dir)))


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites folded from their pages: all lists, in the order of the pages."""
    boards = F.array_join(F.transform("job_boards", lambda b: F.concat_ws("/", b["ats"], b["token"])), ",")
    return _sites(spark, sf_dir).select(
        "site", "reachable", "error", "status", "n_pages", "final_url", "https", "title", "description", "lang", "mobile", "has_form", "privacy_link", "copyright_year", "cert_ok", "builder", flat("tech").alias("tech"), flat("emails").alias("emails"), flat("phones").alias("phones"),
        flat_map("socials").alias("socials"), F.array_join(F.array_sort(F.transform(F.map_entries("registry_ids"), lambda e: F.concat(e["key"], F.lit("="), pages.single_or_list(e["value"])))), ",").alias("registry_ids"), flat("legal_names").alias("legal_names"), boards.alias("job_boards"), _flat_people("people").alias("people"), flat("pages").alias("pages"),
    )


def site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl shows to be wrong with each site."""
    return pages.site_signals(_sites(spark, sf_dir), datetime.date(2024, 1, 1))


def lead_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with their crawl applied: what they have stays, what is new is appended."""
    s = F.col("s")
    none = lambda kind: F.array().cast(kind)
    leads = _customers(spark, sf_dir).filter("j = 0").select(
        text(s).alias("id"), say("https://firm{}.com", s).alias("website"), F.when(s % 2 == 0, F.array(obj(value=say("info@firm{}.com", s), source="list", type="generic", verified="mx")).cast(_EMAILS)).otherwise(none(_EMAILS)).alias("emails"),
        F.when(s % 3 == 0, F.array(F.lit("79001112233"))).otherwise(none("array<string>")).alias("phones"), F.when(s % 4 == 0, F.create_map(F.lit("facebook"), F.array(F.lit("https://fb.com/old")))).otherwise(F.create_map().cast("map<string,array<string>>")).alias("socials"),
        obj(name=F.when(s % 3 == 1, F.lit("Own name")), registry_ids=F.when(s % 5 == 0, F.create_map(F.lit("inn"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))).alias("legal"),
        F.when(s % 2 == 1, F.array(obj(name="Jane Smith", role="ceo", source="list")).cast(_PEOPLE)).otherwise(none(_PEOPLE)).alias("people"), none(_SIGNALS).alias("signals"),
    )
    out = pages.apply_sites(leads, _sites(spark, sf_dir), datetime.date(2024, 1, 1))
    emails = F.array_join(F.transform("emails", lambda e: F.concat_ws("|", e["value"], e["source"], e["type"], e["verified"])), ",")
    return out.select("id", emails.alias("emails"), flat("phones").alias("phones"), flat_map("socials").alias("socials"), F.col("legal.name").alias("legal_name"), _flat_text_map("legal.registry_ids").alias("registry_ids"), _flat_people("people").alias("people"), "site.url", "site.status", F.size("site.job_boards").alias("boards"), flat(F.array_sort(F.transform("signals", lambda x: x["type"]))).alias("signals"))


# --- answers ---------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed answers about mail: exchangers of every domain, text records of some, policies of some."""
    k = F.col("k")
    domain = say("d{}.org", k)
    mx = F.when(k % 4 == 0, F.array(F.lit("20 alt.aspmx.l.google.com."), F.lit("10 ASPMX.L.Google.com."))).when(k % 4 == 1, F.array(F.lit("0 ."))).when(k % 4 == 2, F.array(say("5 mx.d{}.org", k)))
    spf = F.when(k % 2 == 0, F.array(F.lit("x=1"), F.lit('"v=spf1 include:_spf.google.com " "include:sendgrid.net ~all"'))).otherwise(F.array().cast("array<string>"))
    row = lambda name, rtype, status, answers: F.struct(name.alias("name"), F.lit(rtype).alias("rtype"), status.cast("int").alias("status"), answers.alias("answers"))
    rows = F.array(
        row(domain, "MX", F.when(k % 4 == 3, 2).otherwise(0), mx), row(domain, "TXT", F.when(k % 2 == 0, 0).otherwise(3), spf),
        row(F.concat(F.lit("_dmarc."), domain), "TXT", F.lit(0), F.when(k % 5 == 0, F.array(F.lit("v=DMARC1; p=reject"))).otherwise(F.array().cast("array<string>"))),
    )
    return _customers(spark, sf_dir).select(F.explode(rows).alias("r")).select("r.*")


def mail_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail setup of each domain."""
    d = signals.dns_blocks(_answers(spark, sf_dir))
    return d.select("domain", "error", flat("mx").alias("mx"), "mail_provider", "spf", flat("spf_tools").alias("spf_tools"), "dmarc", "dmarc_policy")


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    other = F.array(obj(value=say("x@d{}.org", k), source="list", type="personal", verified="none"), obj(value=say("y@d{}.org", k + 1), source="list", type="personal", verified=F.when(k % 3 == 0, F.lit("smtp")).otherwise("none"))).cast(_EMAILS)
    return _customers(spark, sf_dir).select(
        text(k).alias("id"), say("Firm {} LLC", k).alias("name"), say("d{}.org", k).alias("domain"), other.alias("emails"), F.array(obj(name="Ann Lee", role="ceo", source="list")).cast(_PEOPLE).alias("people"), F.array().cast(_SIGNALS).alias("signals"),
        obj(name=say("Firm {}", k), registry_ids=F.when(k % 3 == 0, F.create_map(F.lit("company_number"), text(k))).when(k % 3 == 1, F.create_map(F.lit("opencorporates"), say("us_de/{}", k))).otherwise(F.create_map().cast("map<string,string>"))).alias("legal"),
        F.when(k % 6 == 0, F.array(obj(ats="greenhouse", token=say("board{}", k)))).otherwise(F.array().cast("array<struct<ats:string,token:string>>")).alias("job_boards"),
    )


def lead_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with the mail setup of their domain."""
    out = signals.join_dns(_leads(spark, sf_dir), signals.dns_blocks(_answers(spark, sf_dir)), _DAY)
    return out.select("id", flat(F.transform("emails", lambda e: e["verified"])).alias("verified"), F.col("dns.mail_provider").alias("mail_provider"), F.col("dns.error").alias("error"), flat_signals("signals").alias("signals"))


def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of landed result pages of a registry of operators."""
    k = F.col("k")
    row = say("<tr class='clmn{}'><td>77-{}</td><td>ООО Ромашка {}<br>юр. лицо<br/>ИНН 77</td><td>x</td><td>01.01.2020</td><td><b>02.02.</b>2020</td></tr>", k % 2, k, k)
    html = F.concat(F.lit('<table id="ResList1">'), F.when(k % 4 != 3, row).otherwise("<tr class='clmn1'><td>short</td></tr>"), F.when(k % 5 == 0, row).otherwise(""), F.lit("</table>"))
    rows = signals.registry_rows(_customers(spark, sf_dir).select(text(k).alias("inn"), F.when(k % 7 == 6, F.lit("<p>nothing</p>")).otherwise(html).alias("html")))
    return rows.select("inn", "regn", "name", "kind", "notified", "processing_since")


def lead_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with the company that a register has under their id."""
    k = F.col("k")
    officers = F.array(obj(name="Ann Lee", role="director"), obj(name=say("Bob {}", k % 5), role="director"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("gb/"), F.lpad(text(k), 8, "0"))).otherwise(say("us_de/{}", k))
    companies = _customers(spark, sf_dir).filter("k % 3 <> 2 and k % 4 <> 3").select(ref.alias("ref"), say("FIRM {} LTD", k).alias("name"), F.when(k % 5 == 0, F.lit("Dissolved")).when(k % 5 == 1, F.lit("Active")).alias("status"), F.when(k % 2 == 0, F.lit("2023-06-01")).otherwise("2001-01-01").alias("incorporated"), officers.alias("officers"), say("https://r.org/{}", k).alias("url"))
    out = signals.join_registry(_leads(spark, sf_dir), companies, _DAY)
    return out.select("id", F.col("legal.name").alias("legal_name"), _flat_people("people").alias("people"), flat_signals("signals").alias("signals"), F.col("registry.found").alias("found"), F.col("registry.ref").alias("ref"), F.col("registry.status").alias("status"))


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed boards: a greenhouse board of some leads, a lever board with a guessed token of others, ashby boards."""
    k = F.col("k")
    green = F.to_json(obj(jobs=F.array(obj(title="Engineer", location=obj(name="Berlin"), absolute_url=say("https://g/{}", k), first_published="2024-01-05T10:00", company_name="Other"), obj(title="Cook", location=obj(name="Rome"), absolute_url=say("https://g/{}/2", k), first_published="2024-01-06T10:00", company_name="Other"))))
    lever = F.to_json(F.array(obj(text="Chef", categories=obj(location="Oslo", team="Kitchen"), hostedUrl=say("https://l/{}", k), createdAt=F.lit(1704153600000), descriptionPlain=F.when(k % 4 == 1, say("join d{}.org", k)).otherwise("join us"))))
    ashby = F.to_json(obj(jobs=F.array(obj(title="Clerk", location="Bonn", jobUrl=say("https://a/{}", k), publishedAt="2024-01-07T00:00", department="Ops", descriptionPlain=say("Firm {} is hiring", k), isListed=k % 10 != 2), obj(title="Hidden", location="x", jobUrl="y", publishedAt="2024-01-07", department="z", descriptionPlain="", isListed=False))))
    c = _customers(spark, sf_dir)
    part = lambda cond, ats, token, payload: c.filter(cond).select(F.lit(ats).alias("ats"), token.alias("token"), payload.alias("payload"))
    return part(k % 6 == 0, "greenhouse", say("board{}", k), green).unionByName(part(k % 2 == 1, "lever", say("d{}", k), lever)).unionByName(part(k % 5 == 2, "ashby", say("firm{}", k), ashby))


def board_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of landed boards."""
    return signals.board_postings(_boards(spark, sf_dir)).select("ats", "token", "title", "location", "url", "posted", "team", "company", "text")


def lead_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with their boards; guessed boards must show the company's name or domain."""
    out = signals.join_boards(_leads(spark, sf_dir), signals.board_postings(_boards(spark, sf_dir)), _DAY)
    boards = F.array_join(F.transform("jobs.boards", lambda b: F.concat_ws("|", b["ats"], b["token"], b["found_via"], text(b["open_roles"]))), ",")
    return out.select("id", F.coalesce(boards, F.lit("")).alias("boards"), F.col("jobs.open_roles").alias("open_roles"), flat_signals("signals").alias("signals"))


def lead_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with addresses and people that a lookup by domain found."""
    k = F.col("k")
    found = F.array(
        obj(value=say("X@d{}.org", k), type="personal", first_name="Ann", last_name="Lee", position="CTO", sources=F.array(F.lit("s")), status="valid"),
        obj(value=say("new@d{}.org", k), type="personal", first_name="Cy", last_name=F.when(k % 2 == 0, F.lit("Dee")), position="COO", sources=F.array().cast("array<string>"), status=F.when(k % 3 == 0, F.lit("valid")).otherwise("unknown")),
        obj(value="broken", type="generic", first_name="No", last_name="One", position="x", sources=F.array().cast("array<string>"), status="valid"),
    )
    contacts = _customers(spark, sf_dir).filter("k % 4 <> 0").select(say("d{}.org", k).alias("domain"), found.alias("emails"))
    out = signals.join_contacts(_leads(spark, sf_dir), contacts, _DAY)
    emails = F.array_join(F.transform("emails", lambda e: F.concat_ws("|", e["value"], e["source"], e["type"], e["verified"])), ",")
    return out.select("id", emails.alias("emails"), _flat_people("people").alias("people"), F.col("hunter.found").alias("found"))


QUERIES = {f.__name__: f for f in (page_contacts, site_contacts, site_findings, lead_sites, mail_setups, lead_dns, registry_entries, lead_registry, board_roles, lead_boards, lead_contacts)}

_PAGES = """p AS (SELECT c_custkey AS k, c_custkey // 3 AS s, c_custkey % 3 AS j, c_custkey % 11 <> 10 AS ok, CASE WHEN c_custkey % 2 = 0 THEN 'Jane Smith' ELSE 'Mark Brown' END AS person FROM customer),
u AS (SELECT *, 'https://firm' || s || '.com' || CASE WHEN j = 0 THEN '/' ELSE '/team' || j END AS url, 'team' || k || '@firm' || s || '.com' AS team FROM p),
g AS (SELECT s, bool_or(ok) AS reachable, count_if(ok) AS n, bool_or(ok AND j = 0) AS home, bool_or(ok AND j > 0) AS inn, string_agg(team, ',' ORDER BY j) FILTER (ok AND j > 0) AS teams, string_agg('Bright' || k || ' GmbH', ',' ORDER BY j) FILTER (ok AND j > 0) AS brights,
  string_agg(url, ',' ORDER BY j) FILTER (ok) AS pages, (list(person ORDER BY j) FILTER (ok AND j > 0)) AS persons FROM u GROUP BY s),
x AS (SELECT *, CASE WHEN home THEN '+44207946' || lpad(CAST(s AS VARCHAR), 6, '0') ELSE '' END AS phone, CASE WHEN home THEN 'info@firm' || s || '.com,sales@firm' || s || '.com' END AS own, list_distinct(persons) AS names FROM g)"""
_TECH = "CASE s % 3 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'shopify' ELSE '' END"
_PERSONS = "CASE WHEN len(names) = 2 THEN persons[1] || '|Founder|site,' || persons[2] || '|Founder|site' WHEN len(names) = 1 THEN persons[1] || '|Founder|site' ELSE '' END"
_ANSWERS = """a AS (SELECT c_custkey AS k, 'd' || c_custkey || '.org' AS domain, CASE c_custkey % 4 WHEN 0 THEN 'aspmx.l.google.com,alt.aspmx.l.google.com' WHEN 2 THEN 'mx.d' || c_custkey || '.org' ELSE '' END AS mx,
  CASE c_custkey % 4 WHEN 0 THEN 'google-workspace' WHEN 2 THEN 'self-hosted/other' END AS mail_provider, CASE WHEN c_custkey % 4 = 3 THEN 'lookup failed' END AS error FROM customer)"""

ORACLES = {
    "page_contacts": f"""WITH {_PAGES}
SELECT url, CASE WHEN NOT ok THEN 'HTTPError' END AS error, CASE WHEN ok AND j = 0 THEN 'Firm ' || s || ' & Co' END AS title, CASE WHEN ok AND j = 0 THEN 'Care ' || s END AS description, CASE WHEN ok AND j = 0 THEN 'en' END AS lang, ok AND j = 0 AND s % 2 = 0 AS mobile, CASE WHEN ok AND j = 0 THEN 2015 + s % 9 END AS copyright_year,
  CASE WHEN NOT ok THEN '' WHEN j = 0 THEN 'info@firm' || s || '.com,sales@firm' || s || '.com' ELSE team END AS emails, CASE WHEN ok AND j = 0 THEN '+44207946' || lpad(CAST(s AS VARCHAR), 6, '0') ELSE '' END AS phones, CASE WHEN ok AND j = 0 THEN 'facebook=https://www.facebook.com/firm' || s ELSE '' END AS socials,
  CASE WHEN NOT ok THEN '' WHEN j = 0 THEN 'company_number=' || (10000000 + s) ELSE 'inn=7707083893' END AS registry_ids, CASE WHEN NOT ok THEN '' WHEN j = 0 THEN 'Firm' || s || ' Ltd' ELSE 'Bright' || k || ' GmbH' END AS legal_names, CASE WHEN ok AND j = 0 THEN 'lever/firm' || s ELSE '' END AS job_boards,
  CASE WHEN ok AND j > 0 THEN person || '|Founder|site' ELSE '' END AS people, CASE WHEN ok AND j = 0 THEN {_TECH} ELSE '' END AS tech, CASE WHEN ok AND j = 0 THEN CASE s % 3 WHEN 0 THEN 'cms' WHEN 1 THEN 'ecommerce' ELSE '' END ELSE '' END AS tech_categories, CASE WHEN ok AND j = 0 THEN 'https://firm' || s || '.com/contact' || s || CASE WHEN s % 4 = 0 THEN ',https://firm' || s || '.com/privacy' ELSE '' END ELSE '' END AS inner_links FROM u""",
    "site_contacts": f"""WITH {_PAGES}
SELECT 'https://firm' || s || '.com' AS site, reachable, CASE WHEN NOT reachable THEN 'HTTPError' END AS error, CASE WHEN NOT reachable THEN 404 END AS status, CASE WHEN n > 0 THEN n END AS n_pages, CASE WHEN home THEN 'https://firm' || s || '.com/' END AS final_url, CASE WHEN home THEN true END AS https, CASE WHEN home THEN 'Firm ' || s || ' & Co' END AS title, CASE WHEN home THEN 'Care ' || s END AS description,
  CASE WHEN home THEN 'en' END AS lang, CASE WHEN home THEN s % 2 = 0 END AS mobile, home AS has_form, home AND s % 4 = 0 AS privacy_link, CASE WHEN home THEN 2015 + s % 9 END AS copyright_year, CASE WHEN home THEN s % 7 <> 3 END AS cert_ok, CASE WHEN home AND s % 3 < 2 THEN {_TECH} ELSE 'other' END AS builder, CASE WHEN home THEN {_TECH} ELSE '' END AS tech,
  coalesce(concat_ws(',', own, teams), '') AS emails, phone AS phones, CASE WHEN home THEN 'facebook=https://www.facebook.com/firm' || s ELSE '' END AS socials, concat_ws(',', CASE WHEN home THEN 'company_number=' || (10000000 + s) END, CASE WHEN inn THEN 'inn=7707083893' END) AS registry_ids,
  concat_ws(',', CASE WHEN home THEN 'Firm' || s || ' Ltd' END, brights) AS legal_names, CASE WHEN home THEN 'lever/firm' || s ELSE '' END AS job_boards, {_PERSONS} AS people, pages FROM x WHERE reachable""",
    "site_findings": f"""WITH {_PAGES}
SELECT 'https://firm' || s || '.com' AS site, unnest(list_filter([CASE WHEN home AND 2015 + s % 9 <= 2021 THEN {{'type': 'outdated_site', 'value': 'copyright ' || (2015 + s % 9)}} END, CASE WHEN NOT home THEN {{'type': 'no_https', 'value': NULL}} END, CASE WHEN home AND s % 7 = 3 THEN {{'type': 'broken_ssl', 'value': 'https://firm' || s || '.com/'}} END,
  CASE WHEN NOT home OR s % 2 = 1 THEN {{'type': 'not_mobile_friendly', 'value': 'no viewport meta'}} END, CASE WHEN home AND s % 4 <> 0 THEN {{'type': 'form_without_privacy_link', 'value': 'https://firm' || s || '.com/'}} END], lambda v: v IS NOT NULL), recursive := true) FROM x WHERE reachable""",
    "lead_sites": f"""WITH {_PAGES}, l AS (SELECT x.* FROM x)
SELECT CAST(s AS VARCHAR) AS id, concat_ws(',', CASE WHEN s % 2 = 0 THEN 'info@firm' || s || '.com|list|generic|mx' END, CASE WHEN home AND s % 2 = 1 THEN 'info@firm' || s || '.com|site|generic|none' END, CASE WHEN home THEN 'sales@firm' || s || '.com|site|generic|none' END, replace(teams, '.com', '.com|site|personal|none')) AS emails,
  concat_ws(',', CASE WHEN s % 3 = 0 THEN '79001112233' END, CASE WHEN home THEN ltrim(phone, '+') END) AS phones, CASE WHEN s % 4 = 0 AND home THEN 'facebook=https://fb.com/old+https://www.facebook.com/firm' || s WHEN s % 4 = 0 THEN 'facebook=https://fb.com/old' WHEN home THEN 'facebook=https://www.facebook.com/firm' || s ELSE '' END AS socials,
  CASE WHEN s % 3 = 1 THEN 'Own name' WHEN home THEN 'Firm' || s || ' Ltd' ELSE split_part(brights, ',', 1) END AS legal_name, concat_ws(',', CASE WHEN home THEN 'company_number=' || (10000000 + s) END, CASE WHEN s % 5 = 0 THEN 'inn=1' WHEN inn THEN 'inn=7707083893' END) AS registry_ids,
  concat_ws(',', CASE WHEN s % 2 = 1 THEN 'Jane Smith|ceo|list' END, nullif(array_to_string(list_transform(list_filter(CASE WHEN len(names) = 2 THEN persons ELSE persons[1:1] END, lambda v: v <> 'Jane Smith' OR s % 2 = 0), lambda v: v || '|Founder|site'), ','), '')) AS people, 'https://firm' || s || '.com' AS url, CAST(NULL AS INTEGER) AS status, CASE WHEN home THEN 1 ELSE 0 END AS boards,
  concat_ws(',', CASE WHEN home AND s % 7 = 3 THEN 'broken_ssl' END, CASE WHEN home AND s % 4 <> 0 THEN 'form_without_privacy_link' END, CASE WHEN NOT home THEN 'no_https' END, CASE WHEN NOT home OR s % 2 = 1 THEN 'not_mobile_friendly' END, CASE WHEN home AND 2015 + s % 9 <= 2021 THEN 'outdated_site' END) AS signals FROM l""",
    "mail_setups": f"""WITH {_ANSWERS}
SELECT domain, error, mx, mail_provider, CASE WHEN k % 2 = 0 THEN 'v=spf1 include:_spf.google.com include:sendgrid.net ~all' END AS spf, CASE WHEN k % 2 = 0 THEN 'google-workspace,sendgrid' ELSE '' END AS spf_tools, k % 5 = 0 AS dmarc, CASE WHEN k % 5 = 0 THEN 'reject' END AS dmarc_policy FROM a""",
    "lead_dns": f"""WITH {_ANSWERS}
SELECT CAST(a.k AS VARCHAR) AS id, CASE WHEN a.mx <> '' THEN 'mx' ELSE 'none' END || ',' || CASE WHEN a.k % 3 = 0 THEN 'smtp' WHEN b.mx <> '' THEN 'mx' ELSE 'none' END AS verified, a.mail_provider, a.error, CASE WHEN a.k % 4 = 1 THEN 'no_mx|' || a.domain || '|dns|2024-01-01' ELSE '' END AS signals FROM a LEFT JOIN a b ON b.k = a.k + 1""",
    "registry_entries": """WITH c AS (SELECT c_custkey AS k, unnest(range(CASE WHEN c_custkey % 4 <> 3 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)) FROM customer WHERE c_custkey % 7 <> 6)
SELECT CAST(k AS VARCHAR) AS inn, '77-' || k AS regn, 'ООО Ромашка ' || k AS name, 'юр. лицо' AS kind, '01.01.2020' AS notified, '02.02.2020' AS processing_since FROM c""",
    "lead_registry": """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 <> 2 AND c_custkey % 4 <> 3 AS found, CASE c_custkey % 3 WHEN 0 THEN 'gb/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN 'us_de/' || c_custkey END AS ref FROM customer)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN found THEN 'FIRM ' || k || ' LTD' ELSE 'Firm ' || k END AS legal_name, 'Ann Lee|ceo|list' || CASE WHEN found THEN ',Bob ' || (k % 5) || '|director|https://r.org/' || k ELSE '' END AS people,
  concat_ws(',', CASE WHEN found AND k % 2 = 0 THEN 'new_registration|2023-06-01|https://r.org/' || k || '|2023-06-01' END, CASE WHEN found AND k % 5 = 0 THEN 'company_inactive|Dissolved|https://r.org/' || k || '|2024-01-01' END) AS signals, found, ref, CASE WHEN found AND k % 5 = 0 THEN 'Dissolved' WHEN found AND k % 5 = 1 THEN 'Active' END AS status FROM c""",
    "board_roles": """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 'greenhouse' AS ats, 'board' || k AS token, 'Engineer' AS title, 'Berlin' AS location, 'https://g/' || k AS url, '2024-01-05' AS posted, NULL AS team, 'Other' AS company, '' AS text FROM c WHERE k % 6 = 0
UNION ALL SELECT 'greenhouse', 'board' || k, 'Cook', 'Rome', 'https://g/' || k || '/2', '2024-01-06', NULL, 'Other', '' FROM c WHERE k % 6 = 0
UNION ALL SELECT 'lever', 'd' || k, 'Chef', 'Oslo', 'https://l/' || k, '2024-01-02', 'Kitchen', NULL, CASE WHEN k % 4 = 1 THEN 'join d' || k || '.org' ELSE 'join us' END FROM c WHERE k % 2 = 1
UNION ALL SELECT 'ashby', 'firm' || k, 'Clerk', 'Bonn', 'https://a/' || k, '2024-01-07', 'Ops', NULL, 'Firm ' || k || ' is hiring' FROM c WHERE k % 5 = 2 AND k % 10 <> 2""",
    "lead_boards": """WITH c AS (SELECT c_custkey AS k, c_custkey % 6 = 0 AS g, c_custkey % 4 = 1 AS l, c_custkey % 10 = 7 AS a FROM customer)
SELECT CAST(k AS VARCHAR) AS id, concat_ws(',', CASE WHEN g THEN 'greenhouse|board' || k || '|source|2' END, CASE WHEN l THEN 'lever|d' || k || '|guess|1' END, CASE WHEN a THEN 'ashby|firm' || k || '|guess|1' END) AS boards, g::INT * 2 + l::INT + a::INT AS open_roles,
  CASE WHEN g THEN 'hiring|2 open roles (greenhouse): Engineer, Cook|https://g/' || k || '|2024-01-01' WHEN l THEN 'hiring|' || (1 + a::INT) || ' open roles (lever): Chef|https://l/' || k || '|2024-01-01' WHEN a THEN 'hiring|1 open roles (ashby): Clerk|https://a/' || k || '|2024-01-01' ELSE '' END AS signals FROM c""",
    "lead_contacts": """WITH c AS (SELECT c_custkey AS k, 'd' || c_custkey || '.org' AS d, c_custkey % 4 <> 0 AS found FROM customer)
SELECT CAST(k AS VARCHAR) AS id, 'x@' || d || '|list|personal|none,y@d' || (k + 1) || '.org|list|personal|' || CASE WHEN k % 3 = 0 THEN 'smtp' ELSE 'none' END || CASE WHEN found THEN ',new@' || d || '|https://lookup/' || d || '|personal|' || CASE WHEN k % 3 = 0 THEN 'smtp' ELSE 'none' END ELSE '' END AS emails,
  'Ann Lee|ceo|list' || CASE WHEN found THEN ',' || CASE WHEN k % 2 = 0 THEN 'Cy Dee' ELSE 'Cy' END || '|COO|https://lookup/' || d ELSE '' END AS people, CASE WHEN found THEN 3 ELSE 0 END AS found FROM c""",
}
