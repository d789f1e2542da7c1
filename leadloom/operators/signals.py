"""Signals from landed answers: mail setup, registries, hiring boards, contact lookups; each a join on narrow keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.functions import page_patterns as R

# --- mail -----------------------------------------------------------------------------------------------------------


def mx_hosts(answers: Column) -> Column:
    """Exchangers by priority and name; the null exchanger is none."""
    parts = F.transform(answers, lambda a: F.split(F.trim(a), r"\s+"))
    real = F.filter(parts, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(1)) != "."))
    pairs = F.transform(real, lambda p: F.struct(F.coalesce(F.get(p, F.lit(0)).try_cast("int"), F.lit(99)).alias("n"), F.lower(F.rtrim(F.get(p, F.lit(1)), F.lit("."))).alias("h")))
    return F.transform(F.array_sort(pairs), lambda p: p["h"])


def mail_provider(hosts: Column) -> Column:
    """Provider of the first exchanger that is known; other exchangers are the domain's own."""
    known = lambda h: F.coalesce(*[F.when(h.rlike(rx), F.lit(name)) for rx, name in R.MX_PROVIDERS])
    found = F.get(F.filter(F.transform(hosts, known), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(found, F.when(F.size(hosts) > 0, F.lit("self-hosted/other")))


def txt_records(answers: Column) -> Column:
    """Text records with their quoted chunks joined."""
    joined = lambda a: norm.blank_to_null(F.array_join(F.regexp_extract_all(a, F.lit('"([^"]*)"'), F.lit(1)), ""))
    return F.transform(answers, lambda a: F.coalesce(joined(a), a))


def dns_blocks(answers: DataFrame) -> DataFrame:
    """One row a domain from landed answers (name, rtype, status, answers); failed lookups are errors.

    Status 0 and 3 are answers, 3 without data. Policies stand under ``_dmarc.`` of their domain.
    """
    ok = F.col("status").isin(0, 3)
    domain = F.regexp_replace("name", r"^_dmarc\.", "")
    policy = F.startswith("name", F.lit("_dmarc."))
    pick = lambda test: F.first(F.when(test & ok, F.col("answers")), ignorenulls=True)
    raw = answers.groupBy(domain.alias("domain")).agg(
        pick(F.col("rtype") == "MX").alias("mx"), pick((F.col("rtype") == "TXT") & ~policy).alias("txt"), pick((F.col("rtype") == "TXT") & policy).alias("dmarc"), F.bool_or(~ok).alias("failed")
    )
    empty = F.array().cast("array<string>")
    starts = lambda c, p: F.get(F.filter(txt_records(F.coalesce(c, empty)), lambda t: F.startswith(F.lower(t), F.lit(p))), F.lit(0))
    mx = mx_hosts(F.coalesce("mx", empty))
    out = raw.select("domain", "failed", mx.alias("mx"), starts("txt", "v=spf1").alias("spf"), starts("dmarc", "v=dmarc1").alias("dmarc_record"))
    tools = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.lower("spf"), F.lit(k)), F.lit(v)) for k, v in R.SPF_TOOLS]))))
    return out.select(
        "domain", F.when(F.col("failed"), F.lit("lookup failed")).alias("error"), F.slice("mx", 1, 5).alias("mx"), mail_provider(F.col("mx")).alias("mail_provider"), F.left("spf", F.lit(300)).alias("spf"), tools.alias("spf_tools"),
        F.col("dmarc_record").isNotNull().alias("dmarc"), norm.blank_to_null(F.regexp_extract("dmarc_record", r"p=(\w+)", 1)).alias("dmarc_policy"),
    )


def join_dns(leads: DataFrame, blocks: DataFrame, date: str, most: int = 6) -> DataFrame:
    """Leads with ``dns`` of their own domain; addresses whose domain takes mail are marked; no exchanger is a signal."""
    mail_domain = lambda e: F.substring_index(e["value"], "@", -1)
    domains = F.slice(F.array_distinct(F.array_compact(F.concat(F.array("domain"), F.transform("emails", mail_domain)))), 1, most)
    asked = leads.select("id", F.explode(domains).alias("domain"))
    joined = asked.join(blocks, "domain").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("domain", F.struct(*[c for c in blocks.columns if c != "domain"])))).alias("answers"))
    out = leads.join(joined, "id", "left")
    block = lambda d: F.try_element_at("answers", d)
    takes = lambda d: F.coalesce(F.size(block(d)["mx"]) > 0, F.lit(False))
    emails = F.transform("emails", lambda e: e.withField("verified", F.when(takes(mail_domain(e)) & (F.coalesce(e["verified"], F.lit("none")) == "none"), "mx").otherwise(e["verified"])))
    own = block(F.col("domain"))
    silent = own.isNotNull() & own["error"].isNull() & ~takes(F.col("domain"))
    return out.withColumns({"emails": emails, "dns": own, "signals": norm.add_signal(F.col("signals"), "no_mx", F.col("domain"), F.lit("dns"), F.lit(date), silent)}).drop("answers")


# --- registries -----------------------------------------------------------------------------------------------------


def registry_rows(pages: DataFrame) -> DataFrame:
    """Entries (inn, regn, name, kind, notified, processing_since) of landed result pages of a registry of operators."""
    rows = F.regexp_extract_all("html", F.lit(r"(?s)<tr class='clmn\d'>(.*?)</tr>"), F.lit(1))
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(norm.unescape_html(F.regexp_replace(c, r"<br\s*/?>", "|")), r"(?U)\s+", " "), "<[^>]+>", ""))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), cell)
    table = pages.filter(F.contains("html", F.lit("ResList1"))).select("inn", F.explode(rows).alias("row")).select("inn", cells.alias("c")).filter(F.size("c") >= 5)
    lines = F.filter(F.transform(F.split(F.get("c", F.lit(1)), r"\|"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    kind = F.get(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~F.startswith(x, F.lit("ИНН"))), F.lit(0))
    return table.select("inn", F.btrim(F.get("c", F.lit(0)), F.lit("| ")).alias("regn"), F.get(lines, F.lit(0)).alias("name"), kind.alias("kind"), F.get("c", F.lit(3)).alias("notified"), F.get("c", F.lit(4)).alias("processing_since"))


def company_number(raw: Column) -> Column:
    """UK company number in capitals, digits padded to eight."""
    n = F.upper(raw)
    return F.when(n.rlike(r"^\d+$"), F.lpad(n, 8, "0")).otherwise(n)


def registry_ref(ids: Column) -> Column:
    """Reference ``jurisdiction/number`` of a map of ids: its own one, else that of a UK company number."""
    get = lambda k: norm.blank_to_null(F.try_element_at(ids, F.lit(k)))
    return F.coalesce(get("opencorporates"), F.concat(F.lit("gb/"), company_number(get("company_number"))))


def join_registry(leads: DataFrame, companies: DataFrame, date: str) -> DataFrame:
    """Leads with the company that a registry (ref, name, status, incorporated, officers, url) has under their id.

    The registry's name replaces the lead's, active officers join its people, and a company that is young or no longer
    active is a signal.
    """
    c = companies.select(F.col("ref"), F.col("name").alias("c_name"), F.col("status").alias("c_status"), "incorporated", "officers", F.col("url").alias("c_url"))
    out = leads.withColumn("ref", registry_ref(F.col("legal.registry_ids"))).join(c, "ref", "left")
    found = F.col("c_name").isNotNull()
    people_kind = dict(leads.dtypes)["people"]
    officers = F.transform(F.coalesce("officers", F.array().cast("array<struct<name:string,role:string>>")), lambda o: F.struct(o["name"].alias("name"), o["role"].alias("role"), F.col("c_url").alias("source"))).cast(people_kind)
    young = found & (F.to_date("incorporated") >= F.date_sub(F.lit(date).cast("date"), 365))
    closed = found & ~F.lower(F.coalesce("c_status", F.lit("active"))).isin("active", "live", "registered", "good standing")
    signals = norm.add_signal(F.col("signals"), "new_registration", F.col("incorporated"), F.col("c_url"), F.col("incorporated"), young)
    return out.withColumns({
        "legal": F.col("legal").withField("name", F.coalesce("c_name", "legal.name")),
        "people": norm.first_by(F.concat("people", officers), lambda p: p["name"]),
        "signals": norm.add_signal(signals, "company_inactive", F.col("c_status"), F.col("c_url"), F.lit(date), closed),
        "registry": F.struct(found.alias("found"), F.col("ref"), F.col("c_name").alias("name"), F.col("c_status").alias("status"), F.col("incorporated"), F.lit(date).alias("checked")),
    }).drop("ref", "c_name", "c_status", "incorporated", "officers", "c_url")


# --- hiring ---------------------------------------------------------------------------------------------------------

_GREENHOUSE = "struct<jobs:array<struct<title:string,location:struct<name:string>,absolute_url:string,first_published:string,updated_at:string,company_name:string>>>"
_LEVER = "array<struct<text:string,categories:struct<location:string,team:string>,hostedUrl:string,createdAt:bigint,descriptionPlain:string>>"
_ASHBY = "struct<jobs:array<struct<title:string,location:string,jobUrl:string,publishedAt:string,department:string,descriptionPlain:string,isListed:boolean>>>"


def board_postings(payloads: DataFrame) -> DataFrame:
    """Roles (ats, token, i, title, location, url, posted, team, company, text) of landed boards of three systems."""
    none = F.lit(None).cast("string")
    base = ["ats", "token", "i"]
    day = lambda c: norm.blank_to_null(F.left(F.coalesce(c, F.lit("")), F.lit(10)))
    part = lambda ats, items: payloads.filter(F.col("ats") == ats).select("ats", "token", F.posexplode(items).alias("i", "j"))
    g = part("greenhouse", F.from_json("payload", _GREENHOUSE)["jobs"]).select(*base, "j.title", F.col("j.location.name").alias("location"), F.col("j.absolute_url").alias("url"), day(F.coalesce("j.first_published", "j.updated_at")).alias("posted"), none.alias("team"), F.col("j.company_name").alias("company"), F.lit("").alias("text"))
    l_ = part("lever", F.from_json("payload", _LEVER)).select(*base, F.col("j.text").alias("title"), F.col("j.categories.location").alias("location"), F.col("j.hostedUrl").alias("url"), F.to_date(F.timestamp_millis("j.createdAt")).cast("string").alias("posted"), F.col("j.categories.team").alias("team"), none.alias("company"), F.left(F.coalesce("j.descriptionPlain", F.lit("")), F.lit(1500)).alias("text"))
    a = part("ashby", F.from_json("payload", _ASHBY)["jobs"]).filter(F.coalesce("j.isListed", F.lit(True))).select(*base, "j.title", "j.location", F.col("j.jobUrl").alias("url"), day(F.col("j.publishedAt")).alias("posted"), F.col("j.department").alias("team"), none.alias("company"), F.left(F.coalesce("j.descriptionPlain", F.lit("")), F.lit(1500)).alias("text"))
    return g.unionByName(l_).unionByName(a)


def board_guesses(domain: Column, name: Column) -> Column:
    """Tokens that a company's board might have; none without a domain."""
    label, n = F.split_part(domain, F.lit("."), F.lit(1)), norm.norm_name(name)
    tokens = F.array(label, F.replace(label, F.lit("-"), F.lit("")), F.replace(n, F.lit(" "), F.lit("")), F.replace(n, F.lit(" "), F.lit("-")))
    good = F.filter(F.array_distinct(F.array_compact(tokens)), lambda t: t.rlike(r"^[a-z0-9][a-z0-9-]{1,60}$"))
    return F.when(F.length(domain) > 0, good).otherwise(F.array().cast("array<string>"))


#: Roles of a board that are kept.
ROLES = 25


def join_boards(leads: DataFrame, postings: DataFrame, date: str, most: int = 2) -> DataFrame:
    """Leads with their boards and a hiring signal.

    Boards linked on the site come first, then those that sources name, then guesses, which must show the company's
    name or domain among their first postings. The first ``most`` boards with roles count.
    """
    link = lambda c, how, k: F.transform(F.coalesce(c, F.array().cast("array<struct<ats:string,token:string>>")), lambda b, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.lit(how).alias("how"), b["ats"].alias("ats"), b["token"].alias("token")))
    systems = F.array(*map(F.lit, ("greenhouse", "lever", "ashby")))
    guessed = F.flatten(F.transform(board_guesses(F.col("domain"), F.col("name")), lambda t, i: F.transform(systems, lambda a, j: F.struct(F.lit(2).alias("k"), (i * 3 + j).alias("i"), F.lit("guess").alias("how"), a.alias("ats"), t.alias("token")))))
    simple = F.transform("job_boards", lambda b: F.struct(b["ats"].alias("ats"), b["token"].alias("token")))
    has_site = "site" in leads.columns and "job_boards" in leads.schema["site"].dataType.names
    site = F.transform("site.job_boards", lambda b: F.struct(b["ats"].alias("ats"), b["token"].alias("token"))) if has_site else F.lit(None).cast("array<struct<ats:string,token:string>>")
    wanted = leads.select("id", "domain", norm.norm_name(F.col("name")).alias("company_name"), F.explode(F.concat(link(site, "site", 0), link(simple, "source", 1), guessed)).alias("b")).select("id", "domain", "company_name", "b.*")
    first = Window.partitionBy("id", "ats", "token").orderBy("k", "i")
    wanted = wanted.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    own = F.lower(F.concat_ws(" ", "text", "company", "url"))
    # Of a board only its first roles are gathered: rows beyond them go before and after the shuffle.
    shown = ["i", "title", "location", "team", "url", "posted"]
    early = postings.withColumn("n", F.row_number().over(Window.partitionBy("ats", "token").orderBy(*shown))).filter(F.col("n") <= ROLES)
    early = early.select("ats", "token", F.struct(*shown, norm.norm_name(F.col("company")).alias("company"), F.left(own, F.lit(2000)).alias("own")).alias("role"))
    roles = early.groupBy("ats", "token").agg(F.sort_array(F.collect_list("role")).alias("roles"))
    roles = postings.groupBy("ats", "token").agg(F.count("*").alias("open_roles")).join(roles, ["ats", "token"])
    joined = wanted.join(roles, ["ats", "token"])
    ten = F.slice("roles", 1, 10)
    blob = F.array_join(F.transform(ten, lambda r: r["own"]), " ")
    named = F.exists(F.slice("roles", 1, 5), lambda r: (F.length("company_name") > 0) & (r["company"] == F.col("company_name")))
    told = F.contains(blob, F.col("domain")) | ((F.length("company_name") >= 4) & F.contains(F.concat(F.lit(" "), norm.norm_name(blob), F.lit(" ")), F.concat(F.lit(" "), "company_name", F.lit(" "))))
    kept = joined.filter((F.col("how") != "guess") | named | F.coalesce(told, F.lit(False)))
    rank = Window.partitionBy("id").orderBy("k", "i")
    best = kept.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= most)
    role = F.transform("roles", lambda r: F.struct(r["title"].alias("title"), r["location"].alias("location"), r["team"].alias("team"), r["url"].alias("url"), r["posted"].alias("posted")))
    boards = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "ats", "token", F.col("how").alias("found_via"), "open_roles", role.alias("roles")))).alias("boards"), F.sum("open_roles").alias("open_roles"))
    out = leads.join(boards, "id", "left")
    top = F.get("boards", F.lit(0))
    titles = F.array_join(F.slice(F.array_distinct(F.filter(F.transform(top["roles"], lambda r: F.trim(r["title"])), lambda t: F.length(t) > 0)), 1, 5), ", ")
    text = F.concat(F.col("open_roles").cast("string"), F.lit(" open roles ("), top["ats"], F.lit("): "), titles)
    source = F.coalesce(F.get(top["roles"], F.lit(0))["url"], top["ats"])
    jobs = F.struct(F.col("boards"), F.coalesce("open_roles", F.lit(0)).alias("open_roles"), F.lit(date).alias("checked"))
    return out.withColumns({"signals": norm.add_signal(F.col("signals"), "hiring", text, source, F.lit(date), F.col("boards").isNotNull()), "jobs": jobs}).drop("boards", "open_roles")


# --- contact lookups ------------------------------------------------------------------------------------------------


def join_contacts(leads: DataFrame, contacts: DataFrame, date: str) -> DataFrame:
    """Leads with addresses and people that a lookup by domain found (domain, emails of value, type, first_name,
    last_name, position, sources, status); those already known stay as they are."""
    email_kind, people_kind = dict(leads.dtypes)["emails"], dict(leads.dtypes)["people"]
    out = leads.join(contacts.select("domain", F.col("emails").alias("found")), "domain", "left")
    good = F.filter(F.coalesce("found", F.array().cast(dict(contacts.dtypes)["emails"])), lambda e: norm.clean_email(e["value"]).isNotNull())
    url = F.concat(F.lit("https://lookup/"), F.col("domain"))
    emails = F.transform(good, lambda e: F.struct(norm.clean_email(e["value"]).alias("value"), F.coalesce(F.get(e["sources"], F.lit(0)), url).alias("source"), F.when(e["type"] == "personal", "personal").otherwise(norm.email_type(norm.clean_email(e["value"]))).alias("type"), F.when(e["status"] == "valid", "smtp").otherwise("none").alias("verified"))).cast(email_kind)
    name = lambda e: norm.blank_to_null(F.concat_ws(" ", e["first_name"], e["last_name"]))
    people = F.transform(F.filter(good, lambda e: name(e).isNotNull()), lambda e: F.struct(name(e).alias("name"), e["position"].alias("role"), url.alias("source"))).cast(people_kind)
    return out.withColumns({
        "emails": norm.first_by(F.concat("emails", emails), lambda e: e["value"]),
        "people": norm.first_by(F.concat("people", people), lambda p: p["name"]),
        "hunter": F.struct(F.lit(date).alias("checked"), F.coalesce(F.size("found"), F.lit(0)).alias("found")),
    }).drop("found")
