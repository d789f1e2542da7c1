"""Scalar normalisation as Column expressions: hosts, phones, addresses of mail, names, dates, money, text keys.

Every function takes and returns Columns and stays inside Catalyst. Regular expressions that must know Cyrillic carry
the flags ``(?iuU)``. Missing means null or empty; the helpers below say so for each type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import patterns as P

IGNORE_CASE = "(?iuU)"


def blank_to_null(c: Column) -> Column:
    """Null for null and for the empty string."""
    return F.when(F.length(c) > 0, c)


def truthy_text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def truthy_number(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def truthy_list(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Whether a pattern is found, ignoring case in every script; null is no match."""
    return F.coalesce(c.rlike(IGNORE_CASE + pattern), F.lit(False))


def ordered_distinct(c: Column) -> Column:
    """Distinct values of a list in order of first appearance, without nulls."""
    return F.array_distinct(F.array_compact(c))


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null unless it holds a point. Hosts in other scripts become their ASCII form."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    authority = F.regexp_extract(full, r"^[^:/?#]+://([^/?#\\]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    name = F.regexp_replace(F.btrim(F.lower(name), F.lit(".")), r"^www\.", "")
    ascii_name = F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name))
    return F.when((F.length(url) > 0) & F.contains(name, F.lit(".")), ascii_name)


def is_own_site(url: Column) -> Column:
    """Whether a link leads to the business's own site."""
    h = host(url)
    return h.isNotNull() & ~matches(h, P.NOT_OWN)


def own_sites(urls: Column) -> Column:
    return F.filter(urls, is_own_site)


def phone_digits(phone: Column, default_cc: str | None = None) -> Column:
    """Digits with the country code where it can be told; null outside 7 to 15 digits."""
    raw = F.trim(phone)
    d = F.regexp_replace(phone, r"\D", "")
    d = F.when(F.startswith(raw, F.lit("00")), F.substring(d, F.lit(3), F.length(d))).otherwise(d)
    out = d
    if default_cc:
        local = (F.length(d) <= 10) & ~F.startswith(raw, F.lit("+"))
        out = F.when(local, F.concat(F.lit(default_cc), F.regexp_replace(d, "^0+", ""))).otherwise(d)
    if default_cc in (None, "7"):
        out = F.when((F.length(d) == 11) & F.startswith(d, F.lit("8")), F.concat(F.lit("7"), F.substring(d, 2, 20))).otherwise(out)
    return F.when(F.length(out).between(7, 15), out)


def clean_email(address: Column) -> Column:
    """Address in lower case without punctuation around it; null for junk and for what is none."""
    e = F.lower(F.btrim(F.trim(address), F.lit(".,;:()<>[]\"'")))
    e = F.split_part(F.regexp_replace(e, "^mailto:", ""), F.lit("?"), F.lit(1))
    return F.when(e.rlike(f"{IGNORE_CASE}^(?:{P.EMAIL})$") & ~matches(e, P.EMAIL_JUNK), e)


def email_type(address: Column) -> Column:
    local = F.split_part(address, F.lit("@"), F.lit(1))
    return F.when(matches(local, P.GENERIC_LOCAL), F.lit("generic")).otherwise(F.lit("personal"))


def norm_name(name: Column) -> Column:
    """Name in lower case without quotes, legal forms and punctuation."""
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), P.QUOTES, "")
    n = F.regexp_replace(n, "(?U)" + P.LEGAL_FORMS, " ")
    return F.trim(F.regexp_replace(n, r"(?U)[^\w]+", " "))


def lead_id(sites: Column, name: Column, city: Column, phones: Column) -> Column:
    """Host of the first own site, else a hash of name, city and first phone."""
    own = F.get(own_sites(F.array_compact(sites)), F.lit(0))
    basis = F.concat_ws("|", norm_name(name), F.lower(F.coalesce(city, F.lit(""))), F.coalesce(F.get(phones, F.lit(0)), F.lit("")))
    return F.coalesce(host(own), F.concat(F.lit("h-"), F.left(F.sha1(basis), F.lit(12))))


def job_boards(text: Column) -> Column:
    """Boards linked in a text: distinct (ats, token, url), systems in catalogue order."""

    def linked(ats: str, pattern: str) -> Column:
        links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + pattern), F.lit(0))
        token = lambda u: F.lower(F.regexp_extract(u, "(?i)" + pattern, 1))
        return F.transform(links, lambda u: F.struct(F.lit(ats).alias("ats"), token(u).alias("token"), u.alias("url")))

    found = F.flatten(F.array(*(linked(ats, pattern) for ats, pattern in P.JOB_BOARDS)))
    boards = F.filter(found, lambda b: ~b["token"].isin(P.JOB_BOARD_STOP))
    return first_by(boards, lambda b: F.concat_ws("/", b["ats"], b["token"]))


def first_by(items: Column, key) -> Column:
    """Items of a list whose key has not come before."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def social_links(html: Column, most: int = 3) -> Column:
    """Map of network to its links in a text, without query, at most ``most``; networks without links are left out."""
    pairs = []
    for network, pattern in P.SOCIAL.items():
        links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)" + pattern), F.lit(0))
        links = F.array_distinct(F.transform(links, lambda u: F.split_part(u, F.lit("?"), F.lit(1))))
        pairs += [F.lit(network), F.slice(links, 1, most)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def social_of(url: Column) -> Column:
    """Network that a link belongs to; null for none."""
    tests = [F.when(url.rlike(f"^(?i)(?:{p})"), F.lit(k)) for k, p in P.SOCIAL.items()]
    return F.coalesce(*tests)


def add_signal(signals: Column, type_: str, value: Column, source: Column, date: Column, when: Column | None = None) -> Column:
    """Append a signal unless one of its type is there (or ``when`` is not true)."""
    fresh = F.struct(F.lit(type_).alias("type"), value.cast("string").alias("value"), source.cast("string").alias("source"), date.cast("string").alias("date"))
    missing = ~F.exists(signals, lambda s: s["type"] == type_)
    return F.when(missing if when is None else missing & F.coalesce(when, F.lit(False)), F.array_append(signals, fresh)).otherwise(signals)


def unescape_html(text: Column) -> Column:
    return F.when(text.isNotNull(), F.when(~F.contains(text, F.lit("&")), text).otherwise(F.try_reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)))


def clean_text(text: Column) -> Column:
    """Text without tags, entities resolved, white space collapsed; the empty string for null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape_html(bare), r"(?U)\s+", " "))


def visible_text(html: Column) -> Column:
    """Text of a page without what its scripts, styles and drawings hold."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    return clean_text(bare)


def order_date(value: Column) -> Column:
    """Date of an ISO date or time, DD.MM.YYYY, or unix seconds or milliseconds; null for anything else."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    unix = s.rlike(r"^\d{10}(\d{3})?$")
    seconds = F.when(unix, F.when(F.length(s) == 13, s.try_cast("double") / 1000).otherwise(s.try_cast("double")))
    iso, dotted = F.regexp_extract(s, r"\d{4}-\d{2}-\d{2}", 0), F.regexp_extract(s, r"\d{2}\.\d{2}\.\d{4}", 0)
    day = F.when(F.length(iso) > 0, F.try_to_date(iso, "yyyy-MM-dd")).when(F.length(dotted) > 0, F.try_to_date(dotted, "dd.MM.yyyy"))
    return F.when(unix, F.to_date(F.timestamp_seconds(F.floor(seconds)))).otherwise(day)


def positive_number(value: Column) -> Column:
    """The number if it is finite and above zero."""
    x = value.try_cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def search_text(title: Column, description: Column, category: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, description, category)]
    return F.lower(F.concat_ws(" ", *parts))


def text_key(description: Column, title: Column, id_: Column) -> Column:
    """Key that reposts of one order share: the first 200 letters and digits of what describes it, else its id."""
    basis = F.coalesce(blank_to_null(description), title, F.lit(""))
    return F.coalesce(blank_to_null(F.left(F.regexp_replace(F.lower(basis), r"(?U)\W+", ""), F.lit(200))), id_)


_INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
_INN_11 = [7, *_INN_10]
_INN_12 = [3, *_INN_11]


def _checksum(number: Column, weights: list[int]) -> Column:
    terms = [F.substring(number, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)]
    return reduce(lambda a, b: a + b, terms) % 11 % 10


def inn_ok(number: Column) -> Column:
    """Whether a tax id of 10 or 12 digits has right check digits."""
    digit = lambda i: F.substring(number, i, 1).try_cast("int")
    ten = number.rlike(r"^\d{10}$") & (_checksum(number, _INN_10) == digit(10))
    twelve = number.rlike(r"^\d{12}$") & (_checksum(number, _INN_11) == digit(11)) & (_checksum(number, _INN_12) == digit(12))
    return F.coalesce(ten | twelve, F.lit(False))


def numbers_in(text: Column) -> Column:
    """Whole numbers in a price, spaces between digits closed."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\d[\d\s]*"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s", "").try_cast("double"))


def budget_range(text: Column) -> Column:
    """(budget, budget_max) of a price: first and last number; a price that starts with ``до`` has a maximum only."""
    n = numbers_in(text)
    first, last = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(-1))
    upto = F.coalesce(F.trim(text).rlike("^(?iu)до(?U)\\b"), F.lit(False))
    return F.struct(
        F.when(~upto, first).alias("budget"), F.when(upto | (F.size(n) > 1), last).alias("budget_max")
    )


def strip_tracking(url: Column) -> Column:
    """Link without fragment and without parameters that only track."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.filter(query, lambda q: (F.length(q) > 0) & ~q.rlike(r"^(?i)(utm_[^=]*|yclid|gclid|from)(=|$)"))
    path = F.split_part(bare, F.lit("?"), F.lit(1))
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; 0 of nothing is 0."""
    return F.coalesce(F.round(100 * part / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def unit_key(text: Column) -> Column:
    """Key that is safe in a file name."""
    return F.coalesce(blank_to_null(F.left(F.btrim(F.regexp_replace(text, r"(?U)[^\w.-]+", "_"), F.lit("_")), F.lit(120))), F.lit("all"))


def csv_guard(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    risky = r"^\s*[=+\-@＝＋－＠]|^[\t\r\n]"
    return F.when(c.rlike(risky), F.concat(F.lit("'"), c)).otherwise(c)


def content_hash(to: Column, subject: Column, body: Column) -> Column:
    """Hash of what is sent, to notice later changes."""
    return F.left(F.sha2(F.to_json(F.array(*(F.coalesce(c, F.lit("")) for c in (to, subject, body)))), 256), F.lit(16))


def suppression_key(entry: Column, default_cc: str | None = None) -> Column:
    """Normal form of a suppression entry: address, domain (also from ``@domain``) or digits; comments are cut."""
    e = F.lower(F.trim(F.split_part(entry, F.lit("#"), F.lit(1))))
    digits = F.regexp_replace(e, r"\D", "")
    is_phone = e.rlike(r"^\+?[\d\s()\-]+$") & (F.length(digits) >= 7)
    return F.when(F.startswith(e, F.lit("@")), host(F.substring(e, 2, 1000))).when(F.contains(e, F.lit("@")), blank_to_null(F.regexp_replace(e, "^mailto:", ""))).when(
        is_phone, digits
    ).otherwise(host(e))


def tier_rank(tier: Column) -> Column:
    """0 for the best tier; unknown tiers come last."""
    return reduce(lambda w, kv: w.when(tier == kv[1], F.lit(kv[0])), enumerate(P.TIERS), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(len(P.TIERS)))


def deep_link(channel: Column, to: Column, subject: Column, body: Column) -> Column:
    """Link that opens a draft in the channel's own program."""
    esc = lambda c: F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("+"), F.lit("%20"))
    digits = F.regexp_replace(to, r"\D", "")
    return (
        F.when(channel == "email", F.concat(F.lit("mailto:"), to, F.lit("?subject="), esc(subject), F.lit("&body="), esc(body)))
        .when(channel == "telegram", F.concat(F.lit("https://t.me/"), F.regexp_replace(to, r"^(https?://t\.me/|@)", "")))
        .when(channel == "whatsapp", F.concat(F.lit("https://wa.me/"), digits, F.lit("?text="), esc(body)))
        .when(channel == "phone", F.concat(F.lit("tel:+"), digits))
        .when(channel == "sms", F.concat(F.lit("sms:+"), digits, F.lit("?body="), esc(body)))
        .otherwise(to)
    )
