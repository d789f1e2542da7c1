"""Contacts, ids, people, technologies and health of sites from a table of landed pages.

Pages have site, url, final_url, status, cert_ok, html, fetched and is_home, and may have a place, by which those of one
address are ordered. Extraction is by bounded patterns in Catalyst expressions; a site's pages are then folded by one
aggregation.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import norm
from leadloom.functions import page_patterns as R
from leadloom.functions import patterns as P
from leadloom.plans.storage import spread


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return norm.blank_to_null(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group))


def unquote(text: Column) -> Column:
    """Percent escapes resolved; plus signs stay, and so does a text with broken escapes."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def hrefs(html: Column) -> Column:
    return F.transform(_all(html, r"(?i)href\s*=\s*[\"']([^\"']+)", 1), norm.unescape_html)


def absolute_url(link: Column, base: Column) -> Column:
    """Link against a page's address: with a scheme, for a host, from the root, or from the page's folder."""
    scheme = F.regexp_extract(base, r"^([a-z]+):", 1)
    root = F.regexp_extract(base, r"^[a-z]+://[^/?#]+", 0)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(link.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("#")) | F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .otherwise(F.concat(folder, F.lit("/"), F.regexp_replace(link, r"^\./", "")))
    )


def anchors(html: Column, base: Column) -> Column:
    """Links of a page as (url, text), the text cut at 120 characters."""
    tags = _all(html, r"(?is)<a\b[^>]*?href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>")
    url = lambda a: absolute_url(norm.unescape_html(F.trim(F.regexp_extract(a, r"(?i)href\s*=\s*[\"']([^\"']+)[\"']", 1))), base)
    return F.transform(tags, lambda a: F.struct(url(a).alias("url"), F.left(norm.clean_text(a), F.lit(120)).alias("text")))


def inner_links(html: Column, base: Column, most: int = 4) -> Column:
    """Links to the same host that look like pages about contacts, people or the company, without query."""
    path = lambda u: F.regexp_extract(u, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    same = lambda u: norm.host(u).eqNullSafe(norm.host(base)) & F.startswith(u, F.lit("http"))
    wanted = F.filter(anchors(html, base), lambda a: same(a["url"]) & (norm.matches(path(a["url"]), R.INNER_PATH) | norm.matches(a["text"], R.INNER_TEXT)) & ~norm.matches(path(a["url"]), R.SKIP_PATH))
    bare = F.array_distinct(F.transform(wanted, lambda a: F.regexp_extract(a["url"], r"^[^?#]*", 0)))
    return F.slice(F.filter(bare, lambda u: F.rtrim(u, F.lit("/")) != F.rtrim(base, F.lit("/"))), 1, most)


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by name or property, whichever attribute comes first."""
    n = name.replace(".", r"\.")
    one = _first(html, rf"(?i)<meta[^>]+(?:name|property)=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)")
    two = _first(html, rf"(?i)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{n}[\"']")
    return F.left(F.trim(norm.unescape_html(F.coalesce(one, two))), F.lit(300))


def emails_in(html: Column, text: Column) -> Column:
    """Addresses of mail links first, then of the text; cleaned, in order, distinct."""
    mails = F.transform(F.filter(hrefs(html), lambda h: h.rlike("^(?i)mailto:")), lambda h: F.regexp_replace(h, "^(?i)mailto:", ""))
    found = F.concat(mails, _all(text, norm.IGNORE_CASE + P.EMAIL))
    return norm.ordered_distinct(F.transform(found, lambda e: norm.clean_email(unquote(e))))


def phones_in(html: Column) -> Column:
    """Numbers of telephone links with seven digits or more."""
    links = F.transform(F.filter(hrefs(html), lambda h: h.rlike("^(?i)tel:")), lambda h: F.regexp_replace(unquote(F.regexp_replace(h, "^(?i)tel:", "")), r"[^\d+]", ""))
    return norm.ordered_distinct(F.filter(links, lambda d: F.length(F.regexp_replace(d, r"\D", "")) >= 7))


def legal_ids(text: Column) -> Column:
    """Map of registry to sorted ids: tax ids with right check digits, others only where a country's words stand."""
    unique = lambda c: F.array_sort(F.array_distinct(c))
    empty = F.array().cast("array<string>")
    entries = {
        "inn": unique(F.filter(_all(text, R.INN, 1), norm.inn_ok)),
        "ogrn": unique(_all(text, R.OGRN, 1)),
        "vat": unique(F.transform(_all(text, R.EU_VAT, 1), lambda v: F.regexp_replace(v, r"\s", ""))),
        "company_number": F.when(norm.matches(text, R.UK_WORDS), unique(_all(text, R.UK_NUMBER, 1))).otherwise(empty),
        "handelsregister": F.when(norm.matches(text, R.DE_WORDS), unique(_all(text, R.DE_REGISTER, 1))).otherwise(empty),
    }
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0)


def legal_names(text: Column, most: int = 3) -> Column:
    """Names with a legal form, but for banks."""
    names = F.transform(_all(text, R.LEGAL_NAME), lambda n: F.trim(F.regexp_replace(n, r"(?U)\s+", " ")))
    return F.slice(F.array_distinct(F.filter(names, lambda n: ~norm.matches(n, R.BANK))), 1, most)


def people_in(text: Column, most: int = 8) -> Column:
    """Names next to roles: the last stretch before a role if it is a name, else the first after it.

    Each role sees 60 characters to either side; these are cut at words that are no part of a name, roles included.
    """
    source = F.coalesce(text, F.lit(""))
    role = norm.IGNORE_CASE + R.ROLE
    roles = F.regexp_extract_all(source, F.lit(role), F.lit(1))
    between = F.split(F.regexp_replace(source, role, "\u0001"), "\u0001")
    pieces = F.flatten(F.zip_with(between, roles, lambda m, r: F.array(m, F.coalesce(r, F.lit("")))))
    near = 2 * 10  # a role has two letters at least, so ten roles with what lies between fill any 60 characters
    prior = lambda i: F.right(F.array_join(F.slice(pieces, F.greatest(F.lit(1), 2 * i + 2 - near), F.least(F.lit(near), 2 * i + 1)), ""), F.lit(60))
    later = lambda i: F.left(F.array_join(F.slice(pieces, 2 * i + 3, near), ""), F.lit(60))
    stretch = lambda t: F.filter(F.transform(F.split(t, norm.IGNORE_CASE + R.NAME_CUT), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    person = lambda t: F.when(t.rlike(f"^(?U)(?:{R.PERSON})$"), t)
    before = lambda i: person(F.try_element_at(stretch(prior(i)), F.lit(-1)))
    after = lambda i: person(F.get(stretch(later(i)), F.lit(0)))
    found = F.transform(roles, lambda r, i: F.struct(F.coalesce(before(i), after(i)).alias("name"), F.trim(r).alias("role"), F.lit("site").alias("source")))
    named = F.filter(found, lambda p: p["name"].isNotNull())
    return F.slice(norm.first_by(named, lambda p: p["name"]), 1, most)


def _alternatives(pattern: str) -> list[str]:
    """Alternatives of a pattern, cut at the bars outside its groups and classes."""
    out, depth, cut, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[cut:i])
            cut = i + 1
        i += 1
    return [*out, pattern[cut:]]


def _literal(alternative: str) -> tuple[str, bool]:
    """The characters that an alternative begins with, and whether it has nothing else."""
    out, i = "", 0
    while i < len(alternative):
        c = alternative[i]
        if c == "\\" and i + 1 < len(alternative) and not alternative[i + 1].isalnum():
            c, i = alternative[i + 1], i + 1
        elif c in "?*+{":
            return out[:-1], False
        elif c in "\\.[]()^$|":
            return out, False
        out, i = out + c, i + 1
    return out, True


def found_in(low: Column, pattern: str) -> Column:
    """Whether a fingerprint is found in a lower-case text.

    Most are plain strings, which are searched as bytes; other alternatives run only where the string that they begin
    with stands.
    """
    tests = []
    for alternative in _alternatives(pattern):
        start, whole = _literal(alternative)
        test = F.contains(low, F.lit(start)) if start else F.lit(True)
        tests.append(test if whole else test & low.rlike(alternative))
    return reduce(lambda a, b: a | b, tests)


def technologies(html: Column) -> Column:
    """Names of the fingerprints found in a page, in catalogue order."""
    low = F.lower(F.coalesce(html, F.lit("")))
    tests = F.transform(F.array(low), lambda t: F.array_compact(F.array(*[F.when(found_in(t, rx), F.lit(name)) for name, _, rx in R.TECHNOLOGIES])))
    return F.get(tests, F.lit(0))


def site_builder(tech: Column) -> Column:
    """First content or shop system in catalogue order, else a framework, else ``other``."""
    order = [n for n, c, _ in R.TECHNOLOGIES if c in ("cms", "ecommerce")] + [n for n, c, _ in R.TECHNOLOGIES if c == "framework"]
    return F.coalesce(*[F.when(F.array_contains(tech, n), F.lit(n)) for n in order], F.lit("other"))


def tech_category(name: Column) -> Column:
    return F.coalesce(*[F.when(name == n, F.lit(c)) for n, c, _ in R.TECHNOLOGIES])


def copyright_year(html: Column) -> Column:
    years = F.transform(_all(F.lower(html), R.COPYRIGHT, 1), lambda y: y.cast("int"))
    return F.array_max(years)


def fetch_error(status: Column, html: Column) -> Column:
    """Why a page could not be read: an error status, or no html; null if it could."""
    return F.when(status >= 400, F.lit("HTTPError")).when(status.isNull(), F.lit("unreachable")).when(F.coalesce(F.length(html), F.lit(0)) == 0, F.lit("not_html"))


def _place(pages: DataFrame) -> list[str]:
    """The column that orders pages of one address, if they have one."""
    return [c for c in ("place",) if c in pages.columns]


def extract_pages(pages: DataFrame, unescape: Callable[[Column], Column] = norm.unescape_html) -> DataFrame:
    """Everything that one page tells, one row a page; the html is read once and dropped.

    ``unescape`` resolves the entities of titles; all other fields resolve all entities.
    """
    html = F.col("html")
    text = norm.visible_text(html)
    p = spread(pages).withColumn("text", text)
    body = F.col("text")
    return p.select(
        "site", "url", *_place(pages), "final_url", "status", "cert_ok", "is_home", F.to_date("fetched").cast("string").alias("checked"),
        fetch_error(F.col("status"), html).alias("error"),
        F.left(F.trim(unescape(_first(html, r"(?is)<title[^>]*>(.*?)</title>"))), F.lit(200)).alias("title"),
        F.coalesce(norm.blank_to_null(meta(html, "description")), meta(html, "og:description")).alias("description"),
        _first(html, r"(?i)<html[^>]+lang=[\"']([\w-]+)").alias("lang"),
        norm.matches(html, r"<meta[^>]+name=[\"']viewport").alias("mobile"),
        norm.matches(html, "<form").alias("has_form"),
        norm.matches(html, R.PRIVACY).alias("privacy_link"),
        norm.matches(html, R.COOKIE).alias("cookie_notice"),
        copyright_year(html).alias("copyright_year"),
        technologies(html).alias("tech"),
        emails_in(html, body).alias("emails"),
        phones_in(html).alias("phones"),
        norm.social_links(html).alias("socials"),
        legal_ids(body).alias("registry_ids"),
        legal_names(body).alias("legal_names"),
        norm.job_boards(html).alias("job_boards"),
        people_in(body).alias("people"),
        F.coalesce(F.length("html"), F.lit(0)).alias("bytes"),
    )


#: Values of a field that a site keeps, the first in the order of its pages; registry ids are all kept.
MOST = {"tech": len(R.TECHNOLOGIES), "emails": 8, "phones": 5, "legal_names": 3, "job_boards": 4, "people": 8, "inner_people": 8, "pages": 5}
MOST_LINKS = 3


def _page_entries() -> Column:
    """What a page adds to its site's lists, as (field, key, pos, v); equal keys of a field count once a site."""
    entry = lambda field, key, pos, *v: F.struct(field.alias("field"), key.alias("key"), pos.cast("int").alias("pos"), F.array(*v).alias("v"))
    texts = lambda c: F.transform(c, lambda x, i: entry(F.lit(c), x, i, x))
    mapped = lambda c, mark: F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda x, i: entry(F.concat(F.lit(mark), e["key"]), x, i, x))))
    boards = F.transform("job_boards", lambda b, i: entry(F.lit("job_boards"), F.concat_ws("/", b["ats"], b["token"]), i, b["ats"], b["token"], b["url"]))
    people = lambda field: F.transform("people", lambda x, i: entry(F.lit(field), x["name"], i, x["name"], x["role"], x["source"]))
    inner = F.when(F.col("is_home"), F.slice(people("inner_people"), 1, 0)).otherwise(people("inner_people"))
    page = F.array(entry(F.lit("pages"), F.col("url"), F.lit(0), F.col("final_url")))
    return F.concat(texts("tech"), texts("emails"), texts("phones"), texts("legal_names"), boards, people("people"), inner, mapped("socials", "link:"), mapped("registry_ids", "id:"), page)


def site_values(extracted: DataFrame) -> DataFrame:
    """(site, field, key, v, first): the distinct values of each list of a site and where each stands first.

    Values are combined before they move, so a site of very many pages is spread like any other.
    """
    page = ["inner", "url", *_place(extracted)]
    read = extracted.filter("error is null").withColumn("inner", ~F.col("is_home")).select("site", *page, F.explode(_page_entries()).alias("e"))
    least = F.min(F.struct(F.struct(*page, "e.pos").alias("first"), "e.v")).alias("least")
    return read.groupBy("site", "e.field", "e.key").agg(least).select("site", "field", "key", "least.v", "least.first")


def site_rollup(extracted: DataFrame) -> DataFrame:
    """One row a site: what its home page says of itself, contacts and ids of all its pages in order, home first.

    A site is reachable if any of its pages was read; else it has the error and status of its first page. Lists are cut
    to ``MOST`` values before they are gathered; ``n_pages`` counts all pages that were read. The first page is that of
    the least url, then place, then facts, so it is one page however the rows are dealt.
    """
    order = [(~F.col("is_home")).alias("inner"), *[F.col(c) for c in ("url", *_place(extracted))]]
    values = site_values(extracted)
    rank = Window.partitionBy("site", "field").orderBy("first", "key")
    is_id = F.startswith("field", F.lit("id:"))
    first = values.filter(~is_id).withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= max(MOST.values()))
    first = first.filter(F.col("n") <= F.coalesce(*[F.when(F.col("field") == f, F.lit(m)) for f, m in MOST.items()], F.lit(MOST_LINKS)))
    ids = values.filter(is_id).withColumn("n", F.lit(0))
    gathered = first.unionByName(ids).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("field", "n", "first", "v"))).alias("items"))
    of = lambda field: F.transform(F.filter("items", lambda x: x["field"] == field), lambda x: x["v"])
    plain = lambda field: F.transform(of(field), lambda v: v[0])

    def keyed(mark: str) -> Column:
        own = F.filter("items", lambda x: F.startswith(x["field"], F.lit(mark)))
        keys = F.array_distinct(F.transform(own, lambda x: x["field"]))
        lists = F.transform(keys, lambda k: F.transform(F.filter(own, lambda x: x["field"] == k), lambda x: x["v"][0]))
        return F.map_from_arrays(F.transform(keys, lambda k: F.substr(k, F.lit(len(mark) + 1))), lists)

    person = lambda v: F.struct(v[0].alias("name"), v[1].alias("role"), v[2].alias("source"))
    people = F.when(F.size(of("inner_people")) > 0, of("inner_people")).otherwise(of("people"))
    lists = gathered.select(
        "site", F.array_sort(plain("tech")).alias("tech"), plain("emails").alias("emails"), plain("phones").alias("phones"), plain("legal_names").alias("legal_names"),
        F.transform(of("job_boards"), lambda v: F.struct(v[0].alias("ats"), v[1].alias("token"), v[2].alias("url"))).alias("job_boards"), F.transform(people, person).alias("people"),
        keyed("link:").alias("socials"), keyed("id:").alias("registry_ids"), plain("pages").alias("pages"),
    )
    told = ["final_url", "title", "description", "lang", "mobile", "cookie_notice", "copyright_year", "cert_ok", "checked"]
    facts = extracted.filter("error is null").groupBy("site").agg(
        F.min(F.when(F.col("is_home"), F.struct(*order, *told))).alias("home"), F.max("has_form").alias("has_form"), F.max("privacy_link").alias("privacy_link"), F.count("*").alias("n_pages"),
    ).select("site", *[f"home.{c}" for c in told], "has_form", "privacy_link", "n_pages")
    out = facts.join(lists, "site").withColumns({"builder": site_builder(F.col("tech")), "https": F.startswith("final_url", F.lit("https")), "reachable": F.lit(True)})
    tried = extracted.groupBy("site").agg(F.min(F.struct(*order, "error", "status")).alias("f"), F.max("checked").alias("tried")).select("site", F.col("f.error").alias("first_error"), F.col("f.status").alias("first_status"), "tried")
    joined = tried.join(out, "site", "left")
    reachable = F.coalesce("reachable", F.lit(False))
    return joined.withColumns({
        "error": F.when(~reachable, F.col("first_error")), "status": F.when(~reachable, F.col("first_status")), "checked": F.coalesce("checked", "tried"), "reachable": reachable,
    }).drop("tried", "first_error", "first_status")


def single_or_list(ids: Column) -> Column:
    """Text of a list of ids: the id itself where there is one, else a JSON list."""
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).otherwise(F.to_json(ids))


def site_signals(site: DataFrame, as_of: datetime.date) -> DataFrame:
    """(site, type, value): what a crawl shows to be wrong with a reachable site."""
    tests = [
        ("outdated_site", F.col("copyright_year") <= as_of.year - 3, F.concat(F.lit("copyright "), F.col("copyright_year").cast("string"))),
        ("no_https", ~F.coalesce("https", F.lit(False)), F.col("final_url")),
        ("broken_ssl", F.col("cert_ok") == F.lit(False), F.col("final_url")),
        ("not_mobile_friendly", ~F.coalesce("mobile", F.lit(False)), F.lit("no viewport meta")),
        ("form_without_privacy_link", F.col("has_form") & ~F.col("privacy_link"), F.col("final_url")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(t).alias("type"), value.alias("value"))) for t, test, value in tests]))
    return site.filter("reachable").select("site", F.explode(found).alias("s")).select("site", "s.*")


def apply_sites(leads: DataFrame, sites: DataFrame, as_of: datetime.date) -> DataFrame:
    """Leads with their crawl: site block replaced, new addresses, phones, links, ids, people and signals appended.

    A lead's own registry ids and legal name stay; of several ids of a registry the text is a JSON list. Columns socials,
    legal and people are filled where the leads have them.
    """
    day = F.lit(as_of.isoformat())
    block = ["final_url", "reachable", "status", "error", "https", "cert_ok", "title", "description", "lang", "mobile", "has_form", "privacy_link", "cookie_notice", "copyright_year", "builder", "tech", "pages", "job_boards", "checked"]
    fresh = ["emails", "phones", "legal_names", "socials", "registry_ids", "people"]
    s = sites.select(F.col("site").alias("website"), F.struct(F.col("site").alias("url"), *block).alias("crawl"), *[F.col(c).alias(f"new_{c}") for c in fresh])
    signals = site_signals(sites, as_of).groupBy(F.col("site").alias("website")).agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("new_signals"))
    joined = leads.drop("site").join(s, "website", "left").join(signals, "website", "left")
    kinds = dict(leads.dtypes)
    none = lambda c: F.coalesce(c, F.array())
    emails = F.transform("new_emails", lambda e: F.struct(e.alias("value"), F.lit("site").alias("source"), norm.email_type(e).alias("type"), F.lit("none").alias("verified")))
    fields = {f.name for f in leads.schema["emails"].dataType.elementType.fields}
    emails = F.transform(emails, lambda e: F.struct(*[e[f].alias(f) for f in ("value", "source", "type", "verified") if f in fields]))
    phones = F.filter(F.transform("new_phones", lambda p: F.regexp_replace(p, r"\D", "")), lambda d: F.length(d) > 0)
    with_signals = reduce(lambda acc, t: norm.add_signal(acc, t, F.get(F.filter("new_signals", lambda n: n["type"] == t), F.lit(0))["value"], F.col("crawl.final_url"), day, F.exists("new_signals", lambda n: n["type"] == t)), ["outdated_site", "no_https", "broken_ssl", "not_mobile_friendly", "form_without_privacy_link"], F.col("signals"))
    changes = {
        "emails": norm.first_by(F.concat("emails", none(emails).cast(kinds["emails"])), lambda e: e["value"]),
        "phones": norm.ordered_distinct(F.concat("phones", none(phones).cast("array<string>"))),
        "signals": with_signals,
        "site": F.col("crawl"),
    }
    if "socials" in kinds:
        no_links = F.create_map().cast("map<string,array<string>>")
        changes["socials"] = F.map_zip_with(F.coalesce("socials", no_links), F.coalesce("new_socials", no_links), lambda _, a, b: F.array_distinct(F.concat(none(a).cast("array<string>"), none(b).cast("array<string>"))))
    if "legal" in kinds:
        ids = F.coalesce("legal.registry_ids", F.create_map().cast("map<string,string>"))
        more = F.map_filter(F.transform_values(F.coalesce("new_registry_ids", F.create_map().cast("map<string,array<string>>")), lambda _, v: single_or_list(v)), lambda k, _: ~F.map_contains_key(ids, k))
        name = F.coalesce(norm.blank_to_null(F.col("legal.name")), F.get("new_legal_names", F.lit(0)))
        changes["legal"] = F.struct(name.alias("name"), F.map_concat(ids, more).alias("registry_ids"))
    if "people" in kinds:
        changes["people"] = norm.first_by(F.concat("people", none(F.col("new_people")).cast(kinds["people"])), lambda p: p["name"])
    return joined.withColumns(changes).drop("crawl", "new_signals", *[f"new_{c}" for c in fresh])
