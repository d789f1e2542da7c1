"""Landed payloads to rows: each source's pages or documents, kept as text, become raw businesses or demand rows.

Every function takes a table with source, unit, collected and payload (and pos, the page's place in its unit) and gives
rows with the columns of ``with_raw_columns`` or of a demand row. Payloads are parsed by schema or by bounded patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import norm



def _extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    return norm.blank_to_null(F.regexp_extract(F.col(c) if isinstance(c, str) else c, pattern, group))


def _join(*parts: Column) -> Column:
    """Parts that are not empty, with commas; null for none."""
    return norm.blank_to_null(F.array_join(F.filter(F.array(*parts), lambda x: F.length(x) > 0), ", "))


def _list(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda x: F.length(x) > 0)


def _once(rows: DataFrame) -> DataFrame:
    """First row of each id of a unit; later pages repeat what shifted onto them."""
    first = Window.partitionBy("source", "unit", "source_id").orderBy("pos", "i")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


_BASE = ["source", "unit", "collected", "pos"]

# --- maps and registries ---------------------------------------------------------------------------------------------

_OSM = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
_OSM_KINDS = ["shop", "office", "amenity", "craft", "healthcare", "tourism", "leisure"]

# Query words and the tag filters that they stand for; a filter's parts must all hold.
OSM_PRESETS = {
    "dentist": ["amenity=dentist", "healthcare=dentist"], "doctor": ["amenity=doctors", "healthcare=doctor"], "clinic": ["amenity=clinic", "healthcare=clinic"], "pharmacy": ["amenity=pharmacy"],
    "veterinary": ["amenity=veterinary"], "physiotherapist": ["healthcare=physiotherapist"], "psychologist": ["healthcare=psychotherapist", "healthcare:speciality=psychology"], "optician": ["shop=optician"],
    "lawyer": ["office=lawyer"], "notary": ["office=notary"], "accountant": ["office=accountant", "office=tax_advisor"], "real estate": ["office=estate_agent", "shop=estate_agent"],
    "insurance": ["office=insurance"], "architect": ["office=architect"], "it company": ["office=it", "office=company][company=it"], "marketing agency": ["office=advertising_agency", "office=marketing"],
    "consulting": ["office=consulting"], "coworking": ["amenity=coworking_space", "office=coworking"], "employment agency": ["office=employment_agency"], "travel agency": ["shop=travel_agency", "office=travel_agent"],
    "restaurant": ["amenity=restaurant"], "cafe": ["amenity=cafe"], "bar": ["amenity=bar", "amenity=pub"], "bakery": ["shop=bakery"],
    "hotel": ["tourism=hotel", "tourism=guest_house", "tourism=hostel", "tourism=apartment"], "hair salon": ["shop=hairdresser"], "beauty salon": ["shop=beauty", "shop=cosmetics"],
    "barber": ["shop=hairdresser][hairdresser=barber", "shop=barber"], "massage": ["shop=massage"], "tattoo": ["shop=tattoo"], "gym": ["leisure=fitness_centre", "leisure=sports_centre"],
    "yoga": ["leisure=fitness_centre][sport=yoga", "sport=yoga"], "dance school": ["leisure=dance", "amenity=dancing_school"], "language school": ["amenity=language_school"], "driving school": ["amenity=driving_school"],
    "school": ["amenity=school"], "kindergarten": ["amenity=kindergarten"], "car repair": ["shop=car_repair"], "car dealer": ["shop=car"], "car wash": ["amenity=car_wash"], "tyres": ["shop=tyres"],
    "plumber": ["craft=plumber"], "electrician": ["craft=electrician"], "carpenter": ["craft=carpenter"], "roofer": ["craft=roofer"], "hvac": ["craft=hvac"],
    "builder": ["craft=builder", "office=construction_company"], "construction": ["office=construction_company", "craft=builder"], "photographer": ["craft=photographer", "shop=photo"],
    "printing": ["shop=copyshop", "craft=printer"], "florist": ["shop=florist"], "furniture": ["shop=furniture"], "kitchen": ["shop=kitchen"], "hardware": ["shop=hardware", "shop=doityourself"],
    "jewelry": ["shop=jewelry"], "clothes": ["shop=clothes", "shop=boutique"], "shoes": ["shop=shoes"], "electronics": ["shop=electronics", "shop=mobile_phone", "shop=computer"], "bicycle": ["shop=bicycle"],
    "pet shop": ["shop=pet"], "pet grooming": ["shop=pet_grooming"], "laundry": ["shop=laundry", "shop=dry_cleaning"], "funeral": ["shop=funeral_directors"], "storage": ["shop=storage_rental"],
    "wedding": ["shop=wedding"], "winery": ["craft=winery", "shop=wine"], "brewery": ["craft=brewery"], "marina": ["leisure=marina"], "camping": ["tourism=camp_site"], "museum": ["tourism=museum"],
}


def osm_filter(query: str, tags: Column | None = None) -> Column:
    """Whether a map of tags meets a query word: a preset, ``key=value``, ``key~pattern``, or a name of any business."""
    tags = F.col("tags") if tags is None else tags
    get = lambda k: F.try_element_at(tags, F.lit(k))
    q = query.strip()
    kinds = [get(k).isNotNull() for k in _OSM_KINDS]
    if q.lower() not in OSM_PRESETS and "=" not in q and "~" not in q:
        business = kinds[0]
        for k in kinds[1:]:
            business = business | k
        return norm.matches(get("name"), q.replace('"', "")) & business
    out = F.lit(False)
    for f in OSM_PRESETS.get(q.lower(), [q.replace(" ", "")]):
        every = F.lit(True)
        for part in f.split("]["):
            key, exact, value = part.partition("=") if "=" in part and ("~" not in part or part.index("=") < part.index("~")) else part.partition("~")
            every = every & F.coalesce(get(key) == value if exact == "=" else get(key).rlike(value) if exact else get(key).isNotNull(), F.lit(False))
        out = out | every
    return out


def osm_elements(landed: DataFrame) -> DataFrame:
    """Elements of a map extract; handles of networks become links, joined contacts are split."""
    e = landed.select(*_BASE, F.posexplode(F.from_json("payload", _OSM)["elements"]).alias("i", "e")).select(*_BASE, "i", "e.*")
    t = lambda k: norm.blank_to_null(F.try_element_at("tags", F.lit(k)))
    split = lambda *ks: F.filter(F.flatten(F.transform(_list(*map(t, ks)), lambda v: F.transform(F.split(v, r"[;,]\s*(?=\+|\d|http|[\w.+-]+@)"), lambda x: F.trim(x)))), lambda x: F.length(x) > 0)
    handles = lambda base, *ks: F.transform(_list(*map(t, ks)), lambda v: F.when(F.startswith(v, F.lit("http")), v).otherwise(F.concat(F.lit(base), F.ltrim(v, F.lit("@")))))
    ref = F.concat("type", F.lit("/"), F.col("id").cast("string"))
    street = norm.blank_to_null(F.concat_ws(" ", t("addr:street"), t("addr:housenumber")))
    socials = {"instagram": ("https://instagram.com/", "contact:instagram", "instagram"), "facebook": ("https://facebook.com/", "contact:facebook", "facebook"), "telegram": ("https://t.me/", "contact:telegram"), "x": ("https://x.com/", "contact:twitter")}
    links = [x for k, (base, *keys) in socials.items() for x in (F.lit(k), handles(base, *keys))]
    for k in ("linkedin", "whatsapp", "vk", "youtube"):
        links += [F.lit(k), _list(t(f"contact:{k}"))]
    return e.select(
        *_BASE, ref.alias("source_id"), F.concat(F.lit("https://www.openstreetmap.org/"), ref).alias("url"), F.coalesce(t("name"), t("brand"), t("operator")).alias("name"),
        split("website", "contact:website", "url").alias("sites"), split("phone", "contact:phone", "mobile", "contact:mobile").alias("phones"), split("email", "contact:email").alias("emails"),
        _join(street, t("addr:postcode"), t("addr:city")).alias("address"), t("addr:city").alias("city"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
        F.array_compact(F.array(*[F.when(t(k).isNotNull(), F.concat(F.lit(f"{k}="), t(k))) for k in _OSM_KINDS])).alias("categories"), F.col("unit").alias("segment"),
        F.map_filter(F.create_map(*links), lambda k, v: F.size(v) > 0).alias("socials"),
        F.struct(t("official_name").alias("name"), F.map_filter(F.create_map(F.lit("vat"), t("ref:vatin")), lambda k, v: v.isNotNull()).alias("registry_ids")).alias("legal"), "tags",
    ).filter("name is not null")


_PLACES = "struct<places:array<struct<id:string,businessStatus:string,googleMapsUri:string,displayName:struct<text:string>,websiteUri:string,internationalPhoneNumber:string,nationalPhoneNumber:string,formattedAddress:string,addressComponents:array<struct<longText:string,shortText:string,types:array<string>>>,location:struct<latitude:double,longitude:double>,primaryTypeDisplayName:struct<text:string>,types:array<string>,rating:double,userRatingCount:bigint>>>"


def place_results(landed: DataFrame) -> DataFrame:
    """Places of a search service, without those closed for good."""
    p = landed.select(*_BASE, F.posexplode(F.from_json("payload", _PLACES)["places"]).alias("i", "p")).select(*_BASE, "i", "p.*").filter(~F.col("businessStatus").eqNullSafe("CLOSED_PERMANENTLY"))
    part = lambda kind, form: F.get(F.filter("addressComponents", lambda c: F.array_contains(c["types"], kind)), F.lit(0))[form]
    return p.select(
        *_BASE, F.col("id").alias("source_id"), F.col("googleMapsUri").alias("url"), F.col("displayName.text").alias("name"), _list(F.col("websiteUri")).alias("sites"),
        _list(F.coalesce("internationalPhoneNumber", "nationalPhoneNumber")).alias("phones"), F.col("formattedAddress").alias("address"), F.coalesce(part("locality", "longText"), part("postal_town", "longText")).alias("city"),
        part("country", "shortText").alias("country"), F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"),
        F.array_compact(F.concat(F.array("primaryTypeDisplayName.text"), F.coalesce(F.slice("types", 1, 4), F.array().cast("array<string>")))).alias("categories"), "rating", F.col("userRatingCount").alias("reviews"), F.col("unit").alias("segment"),
    )


_COMPANIES = "struct<items:array<struct<company_number:string,company_name:string,date_of_creation:string,company_type:string,sic_codes:array<string>,registered_office_address:struct<address_line_1:string,address_line_2:string,postal_code:string,locality:string>>>>"
_SIGNAL = "array<struct<type:string,value:string,source:string,date:string>>"


def _signal(type_: str, value: Column, source: Column, date: Column) -> Column:
    return F.array(F.struct(F.lit(type_).alias("type"), value.alias("value"), source.alias("source"), date.alias("date"))).cast(_SIGNAL)


def uk_companies(landed: DataFrame, since: str | None = None) -> DataFrame:
    """Companies of the UK register; with ``since`` (the asked first day) each is a new registration."""
    c = landed.select(*_BASE, F.posexplode(F.from_json("payload", _COMPANIES)["items"]).alias("i", "c")).select(*_BASE, "i", "c.*")
    url = F.concat(F.lit("https://find-and-update.company-information.service.gov.uk/company/"), "company_number")
    a = F.col("registered_office_address")
    born = F.col("date_of_creation")
    return c.select(
        *_BASE, F.col("company_number").alias("source_id"), url.alias("url"), F.col("company_name").alias("name"), _join(a["address_line_1"], a["address_line_2"], a["postal_code"]).alias("address"), a["locality"].alias("city"), F.lit("GB").alias("country"),
        F.transform(F.coalesce("sic_codes", F.array().cast("array<string>")), lambda s: F.concat(F.lit("sic:"), s)).alias("categories"), F.col("unit").alias("segment"),
        F.struct(F.col("company_name").alias("name"), F.create_map(F.lit("company_number"), F.col("company_number")).alias("registry_ids")).alias("legal"),
        (_signal("new_registration", born, url, born) if since else F.array().cast(_SIGNAL)).alias("signals"), born.alias("incorporated"),
    )


_OPEN = "struct<results:struct<companies:array<struct<company:struct<jurisdiction_code:string,company_number:string,opencorporates_url:string,name:string,registered_address_in_full:string,registered_address:struct<locality:string>,incorporation_date:string,company_type:string,current_status:string,industry_codes:array<struct<industry_code:struct<code:string,code_scheme_id:string>>>>>>>>"


def open_companies(landed: DataFrame, since: str | None = None) -> DataFrame:
    """Companies of the open register; the country is the first part of the jurisdiction."""
    c = landed.select(*_BASE, F.posexplode(F.from_json("payload", _OPEN)["results"]["companies"]).alias("i", "c")).select(*_BASE, "i", "c.company.*")
    ref = F.concat_ws("/", F.coalesce("jurisdiction_code", F.lit("")), F.coalesce("company_number", F.lit("")))
    ids = F.map_filter(F.create_map(F.lit("opencorporates"), ref, F.lit("company_number"), F.when(F.col("jurisdiction_code") == "gb", F.col("company_number"))), lambda k, v: v.isNotNull())
    codes = F.filter(F.coalesce("industry_codes", F.array()), lambda x: F.length(x["industry_code"]["code"]) > 0)
    born, url = F.col("incorporation_date"), F.col("opencorporates_url")
    return c.select(
        *_BASE, ref.alias("source_id"), url.alias("url"), "name", F.col("registered_address_in_full").alias("address"), F.col("registered_address.locality").alias("city"),
        norm.blank_to_null(F.upper(F.split_part("jurisdiction_code", F.lit("_"), F.lit(1)))).alias("country"), F.transform(codes, lambda x: F.concat_ws(":", x["industry_code"]["code_scheme_id"], x["industry_code"]["code"])).alias("categories"),
        F.struct(F.col("name"), ids.alias("registry_ids")).alias("legal"), F.when(F.lit(since is not None) & (F.length(born) > 0), _signal("new_registration", born, url, born)).otherwise(F.array().cast(_SIGNAL)).alias("signals"), F.col("current_status").alias("status"), F.col("unit").alias("segment"),
    )


# --- filings ---------------------------------------------------------------------------------------------------------

_HITS = "struct<hits:struct<hits:array<struct<_id:string,_source:struct<form:string,ciks:array<string>,file_date:string,biz_locations:array<string>,display_names:array<string>>>>>>"


def filing_hits(landed: DataFrame, amendments: bool = False, limit: int | None = None) -> DataFrame:
    """Newest filing of each company in a search's hits, amendments left out, at most ``limit`` a unit."""
    h = landed.select(*_BASE, F.posexplode(F.from_json("payload", _HITS)["hits"]["hits"]).alias("i", "h")).select(*_BASE, "i", F.col("h._id").alias("ref"), "h._source.*")
    h = h.filter((F.size("ciks") > 0) & (F.length(F.split_part("ref", F.lit(":"), F.lit(1))) > 0))
    if not amendments:
        h = h.filter(~F.coalesce(F.endswith("form", F.lit("/A")), F.lit(False)))
    h = h.select(
        *_BASE, "i", F.get("ciks", F.lit(0)).cast("long").cast("string").alias("cik"), F.split_part("ref", F.lit(":"), F.lit(1)).alias("adsh"), F.split_part("ref", F.lit(":"), F.lit(2)).alias("file"), "form", F.col("file_date").alias("filed"),
        F.get("biz_locations", F.lit(0)).alias("place"), F.trim(F.regexp_replace(F.coalesce(F.get("display_names", F.lit(0)), F.lit("")), r"\s*\(CIK \d+\)\s*$", "")).alias("name"),
    )
    newest = Window.partitionBy("source", "unit", "cik").orderBy(F.desc("filed"), "pos", "i")
    h = h.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
    if limit:
        place = Window.partitionBy("source", "unit").orderBy(F.desc("filed"), "pos", "i")
        h = h.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= limit).drop("n")
    return h


_FORM_D = "primaryIssuer struct<entityName:string,entityType:string,issuerPhoneNumber:string,jurisdictionOfInc:string,yearOfInc:struct<value:string>,issuerAddress:struct<street1:string,city:string,stateOrCountry:string,zipCode:string>>, relatedPersonsList struct<relatedPersonInfo:array<struct<relatedPersonName:struct<firstName:string,middleName:string,lastName:string>,relatedPersonRelationshipList:struct<relationship:array<string>>>>>, offeringData struct<industryGroup:struct<industryGroupType:string>,issuerSize:struct<revenueRange:string>,offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string>,typeOfFiling:struct<dateOfFirstSale:struct<value:string>>>"


def _dollars(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), F.concat(F.lit("$"), F.format_number(c.cast("decimal(38,0)"), 0))).otherwise(c)


def _title_city(c: Column) -> Column:
    return F.when((c == F.upper(c)) & (c != F.lower(c)), F.initcap(F.lower(c))).otherwise(c)


def us_phone(c: Column, us: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return _list(F.when(F.length(d) > 0, F.when(us & (F.length(d) == 10), F.concat(F.lit("+1"), d)).otherwise(c)))


def private_offerings(landed: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Issuers of private offerings (rows also have cik, adsh, file, filed, name); documents with a DTD are refused."""
    x = landed.filter(~F.col("payload").rlike(r"(?i)<!(DOCTYPE|ENTITY)")).withColumn("x", F.from_xml("payload", _FORM_D))
    iss, off, addr = F.col("x.primaryIssuer"), F.col("x.offeringData"), F.col("x.primaryIssuer.issuerAddress")
    filing = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), F.replace("adsh", F.lit("-"), F.lit("")), F.lit("/"), F.coalesce(norm.blank_to_null(F.col("file")), F.lit("primary_doc.xml")))
    name = F.coalesce(norm.blank_to_null(iss["entityName"]), F.col("name"))
    full = lambda p: norm.blank_to_null(F.concat_ws(" ", p["relatedPersonName"]["firstName"], p["relatedPersonName"]["middleName"], p["relatedPersonName"]["lastName"]))
    people = F.filter(F.transform(F.coalesce("x.relatedPersonsList.relatedPersonInfo", F.array()), lambda p: F.struct(full(p).alias("name"), norm.blank_to_null(F.array_join(p["relatedPersonRelationshipList"]["relationship"], ", ")).alias("role"), filing.alias("source"))), lambda p: p["name"].isNotNull())
    sold, total, first = off["offeringSalesAmounts"]["totalAmountSold"], off["offeringSalesAmounts"]["totalOfferingAmount"], off["typeOfFiling"]["dateOfFirstSale"]["value"]
    value = F.concat(F.lit("Form D "), "filed", F.lit(": "), F.coalesce(_dollars(sold), F.lit("?")), F.lit(" sold of "), F.coalesce(_dollars(total), F.lit("?")), F.lit(" offered"), F.coalesce(F.concat(F.lit(", first sale "), first), F.lit("")))
    industry = off["industryGroup"]["industryGroupType"]
    out = x.select(
        *_BASE, F.col("cik").alias("source_id"), F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="), "cik").alias("url"), name.alias("name"),
        _join(addr["street1"], addr["city"], norm.blank_to_null(F.concat_ws(" ", addr["stateOrCountry"], addr["zipCode"]))).alias("address"), _title_city(addr["city"]).alias("city"), F.lit("US").alias("country"),
        us_phone(iss["issuerPhoneNumber"], F.coalesce(addr["stateOrCountry"].rlike("^[A-Za-z]+$"), F.lit(False))).alias("phones"), _list(industry).alias("categories"), industry.alias("segment"),
        F.struct(name.alias("name"), F.create_map(F.lit("cik"), F.col("cik")).alias("registry_ids")).alias("legal"), people.alias("people"), _signal("funding", value, filing, F.col("filed")).alias("signals"),
    )
    return out.filter(~F.coalesce(F.col("segment").isin(list(skip)), F.lit(False))) if skip else out


_SUBMISSIONS = "struct<name:string,phone:string,website:string,sicDescription:string,tickers:array<string>,addresses:struct<business:struct<street1:string,city:string,stateOrCountry:string,zipCode:string,isForeignLocation:boolean,countryCode:string>>>"


def company_submissions(landed: DataFrame) -> DataFrame:
    """Companies of a filing index (rows also have cik, adsh, file, form, filed, name)."""
    x = landed.withColumn("x", F.from_json("payload", _SUBMISSIONS))
    a, foreign = F.col("x.addresses.business"), F.coalesce("x.addresses.business.isForeignLocation", F.lit(False))
    name = F.coalesce("x.name", "name")
    filing = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), F.replace("adsh", F.lit("-"), F.lit("")), F.lit("/"), F.coalesce("file", F.lit("")))
    return x.select(
        *_BASE, F.col("cik").alias("source_id"), name.alias("name"), _join(a["street1"], a["city"], norm.blank_to_null(F.concat_ws(" ", a["stateOrCountry"], a["zipCode"]))).alias("address"), _title_city(a["city"]).alias("city"),
        F.when(foreign, a["countryCode"]).otherwise("US").alias("country"), us_phone(F.col("x.phone"), ~foreign).alias("phones"), _list(F.col("x.website")).alias("sites"), _list(F.col("x.sicDescription")).alias("categories"), F.col("x.sicDescription").alias("segment"),
        F.struct(name.alias("name"), F.create_map(F.lit("cik"), F.col("cik")).alias("registry_ids")).alias("legal"), _signal("sec_filing", F.concat("form", F.lit(" filed "), "filed"), filing, F.col("filed")).alias("signals"),
    )


# --- hiring posts ----------------------------------------------------------------------------------------------------

_THREAD = "struct<title:string,children:array<struct<id:bigint,text:string,created_at:string>>>"
# Hosts of hiring systems and code, never a company's own site.
NOT_SITE = r"ycombinator\.com|workatastartup\.com|wellfound\.com|lever\.co|greenhouse\.io|ashbyhq|workable|bamboohr|recruitee|personio|teamtailor\.com|smartrecruiters|myworkdayjobs|breezy\.hr|jobvite|rippling-ats|dover\.(com|io)|github\.com|docs\.google|forms\.gle|notion\.(so|site)|calendly\.com"


def host_resembles(host: Column, company: Column) -> Column:
    """Whether a host's labels hold the company's name, one of its longer words, or are held by it."""
    name = norm.norm_name(company)
    compact = F.replace(name, F.lit(" "), F.lit(""))
    labels = F.split(F.lower(host), r"\.")
    labels = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: (F.length(x) >= 3) & (x != "www"))
    words = F.filter(F.split(name, " "), lambda w: F.length(w) >= 4)
    return (F.length(compact) > 0) & F.exists(labels, lambda x: F.contains(x, compact) | ((F.length(x) >= 4) & F.contains(compact, x)) | F.exists(words, lambda w: F.contains(x, w)))


def has_all(text: Column, groups: list[list[str]]) -> Column:
    """Every group has a word in the text, whatever the case."""
    low = F.lower(text)
    out = F.lit(True)
    for g in groups:
        out = out & F.coalesce(F.greatest(*[F.contains(low, F.lit(w.lower())) for w in g], F.lit(False)), F.lit(False))
    return out


def hiring_posts(landed: DataFrame, keywords: list[list[str]] = [], locations: list[str] = []) -> DataFrame:  # noqa: B006
    """Companies of a hiring thread's posts: headline, own site, boards, addresses, and a hiring signal."""
    c = landed.withColumn("t", F.from_json("payload", _THREAD)).select(*_BASE, F.posexplode("t.children").alias("i", "c")).select(*_BASE, "i", "c.*").filter(F.length("text") > 0)
    plain = norm.unescape_html(F.regexp_replace(F.regexp_replace("text", "<p>", "\n"), "<[^>]+>", ""))
    c = c.withColumn("plain", plain).withColumn("headline", F.left(F.split_part(F.trim("plain"), F.lit("\n"), F.lit(1)), F.lit(300)))
    company = F.trim(F.split_part("headline", F.lit("|"), F.lit(1)))
    company = F.left(F.regexp_replace(F.regexp_replace(company, r"\s*https?://\S+", ""), r"\s*\(.*?\)\s*$", ""), F.lit(120))
    head = F.regexp_extract_all("headline", F.lit(r"https?://[^\s|)]+"), F.lit(0))
    links = F.transform(F.regexp_extract_all("text", F.lit('href="([^"]+)"'), F.lit(1)), norm.unescape_html)
    c = c.withColumns({"company": company, "head": head}).withColumn("links", F.array_distinct(F.concat("head", links)))
    own = F.filter("links", lambda u: norm.is_own_site(u) & ~norm.matches(u, NOT_SITE) & (F.array_contains(F.col("head"), u) | F.coalesce(host_resembles(norm.host(u), F.col("company")), F.lit(False))))
    site = F.concat(F.lit("https://"), F.regexp_replace(norm.host(F.get(own, F.lit(0))), r"^(careers|jobs)\.(?=[^.]+\.)", ""), F.lit("/"))
    url = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    out = c.filter(F.length("company") > 0)
    if keywords:
        out = out.filter(has_all(F.col("plain"), keywords))
    if locations:
        out = out.filter(has_all(F.col("headline"), [locations]))
    return out.select(
        *_BASE, F.col("id").cast("string").alias("source_id"), url.alias("url"), F.col("company").alias("name"), _list(site).alias("sites"), norm.job_boards(F.array_join("links", " ")).alias("job_boards"),
        F.slice(F.regexp_extract_all("plain", F.lit(r"[\w.+-]+@[\w-]+\.[\w.-]+"), F.lit(0)), 1, 3).alias("emails"), F.array(F.lit("hiring")).alias("categories"),
        _signal("hiring", F.col("headline"), url, F.left(F.coalesce("created_at", F.lit("")), F.lit(10))).alias("signals"),
    )


# --- city directories ------------------------------------------------------------------------------------------------

_ENTITY = "struct<data:struct<entity:struct<profile:map<string,struct<data:struct<name:string,org:struct<id:string>,address_name:string,adm_div:array<struct<type:string,name:string>>,rubrics:array<struct<name:string>>,reviews:struct<general_rating:double,general_review_count:bigint>,point:struct<lat:double,lon:double>,contact_groups:array<struct<contacts:array<struct<type:string,value:string,url:string>>>>>>>>>>"
# Contact types of the directory and the network that each is.
DIRECTORY_NETWORKS = {"vkontakte": "vk", "telegram": "telegram", "whatsapp": "whatsapp", "instagram": "instagram", "facebook": "facebook", "youtube": "youtube", "twitter": "x", "max": "max"}


def directory_state(landed: DataFrame) -> DataFrame:
    """Firms of a directory's pages, whose state is a JSON literal in a script; contacts by type, links unwrapped."""
    raw = F.regexp_extract("payload", r"(?s)var initialState = JSON\.parse\('(.*?)'\);", 1)
    json = F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\\")), F.lit("\\'"), F.lit("'"))
    e = landed.select(*_BASE, F.posexplode(F.map_entries(F.from_json(json, _ENTITY)["data"]["entity"]["profile"])).alias("i", "e")).filter("e.value.data is not null")
    e = e.select(*_BASE, "i", F.split_part("e.key", F.lit("_"), F.lit(1)).alias("source_id"), "e.value.data.*")
    adm = lambda kind: F.get(F.filter("adm_div", lambda a: a["type"] == kind), F.lit(0))["name"]
    contacts = F.flatten(F.transform("contact_groups", lambda g: g["contacts"]))
    target = lambda c: norm.strip_tracking(F.regexp_replace(F.coalesce(norm.blank_to_null(c["url"]), c["value"]), r"^https?://link\.2gis\.ru/[^?]*\?", ""))

    def of(kind: str, link: bool) -> Column:
        chosen = F.filter(contacts, lambda c: c["type"] == kind)
        return norm.ordered_distinct(F.transform(chosen, target if link else lambda c: c["value"]))

    links = [x for k, n in DIRECTORY_NETWORKS.items() for x in (F.lit(n), of(k, True))]
    firms = e.select(
        *_BASE, "i", "source_id", "name", F.col("org.id").alias("org"), F.coalesce(adm("city"), F.split_part("unit", F.lit("__"), F.lit(1))).alias("city"), adm("country").alias("country"), _join(adm("city"), F.col("address_name")).alias("address"),
        F.filter(F.transform("rubrics", lambda r: r["name"]), lambda x: F.length(x) > 0).alias("categories"), F.col("reviews.general_rating").alias("rating"), F.col("reviews.general_review_count").alias("reviews"), F.col("point.lat").alias("lat"), F.col("point.lon").alias("lon"),
        of("website", True).alias("sites"), of("phone", False).alias("phones"), of("email", False).alias("emails"), F.map_filter(F.create_map(*links), lambda k, v: F.size(v) > 0).alias("socials"),
    )
    return backfill_city(reuse_org_sites(_once(firms)))


def reuse_org_sites(firms: DataFrame) -> DataFrame:
    """Branches of one organisation share the sites of its first branch that has any."""
    first = firms.filter("org is not null and size(sites) > 0").groupBy("source", F.col("org").alias("_org")).agg(F.min_by("sites", F.struct("pos", "i")).alias("_first"))
    # Firms without an organisation meet nothing; a key of its own for each keeps them from lying in one task.
    own = F.coalesce("org", F.concat(F.lit("\0"), F.xxhash64("source_id", "pos", "i").cast("string")))
    joined = firms.withColumn("_org", own).join(first, ["source", "_org"], "left")
    return joined.withColumn("sites", F.when(F.size("sites") > 0, F.col("sites")).otherwise(F.coalesce("_first", "sites"))).select(*firms.columns)


def backfill_city(firms: DataFrame) -> DataFrame:
    """Rows whose city is the unit's location code take the first real city name of the unit."""
    code = F.split_part("unit", F.lit("__"), F.lit(1))
    real = firms.filter(F.col("city") != code).groupBy("source", "unit").agg(F.min_by("city", F.struct("pos", "i")).alias("_real"))
    joined = firms.join(real, ["source", "unit"], "left")
    return joined.withColumn("city", F.when(F.col("city") == code, F.coalesce("_real", "city")).otherwise(F.col("city"))).select(*firms.columns)


_STACK = "struct<stack:array<struct<results:struct<items:array<struct<type:string,id:string,title:string,seoname:string,fullAddress:string,address:string,categories:array<struct<name:string>>,phones:array<struct<value:string,number:string>>,urls:array<string>,socialLinks:array<struct<type:string,href:string>>,ratingData:struct<ratingValue:double,reviewCount:bigint>,coordinates:array<double>>>>>>>"


def map_state(landed: DataFrame) -> DataFrame:
    """Businesses of a map service's pages, once an id; coordinates come longitude first."""
    state = F.from_json(F.regexp_extract("payload", r'(?s)<script type="application/json" class="state-view">(.*?)</script>', 1), _STACK)
    it = landed.select(*_BASE, F.posexplode(F.get(state["stack"], F.lit(0))["results"]["items"]).alias("i", "it")).select(*_BASE, "i", "it.*").filter("type = 'business'").withColumn("source_id", F.col("id"))
    link = lambda kind: F.get(F.filter("socialLinks", lambda s: s["type"] == kind), F.lit(0))["href"]
    nets = {"telegram": link("telegram"), "whatsapp": F.regexp_replace(link("whatsapp"), r"\?.*$", ""), "vk": link("vkontakte"), "instagram": link("instagram"), "facebook": link("facebook")}
    pairs = [x for k, v in nets.items() for x in (F.lit(k), _list(v))]
    return _once(it).select(
        *_BASE, "source_id", F.col("title").alias("name"), F.split_part("unit", F.lit("__"), F.lit(1)).alias("city"), F.coalesce("fullAddress", "address").alias("address"), F.transform("categories", lambda c: c["name"]).alias("categories"),
        F.transform("phones", lambda p: F.coalesce(p["value"], p["number"])).alias("phones"), F.transform("urls", lambda u: F.regexp_replace(u, r"[?#].*$", "")).alias("sites"), F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0).alias("socials"),
        F.col("ratingData.ratingValue").alias("rating"), F.col("ratingData.reviewCount").alias("reviews"), F.concat(F.lit("https://yandex.ru/maps/org/"), "seoname", F.lit("/"), "id", F.lit("/")).alias("url"), F.get("coordinates", F.lit(1)).alias("lat"), F.get("coordinates", F.lit(0)).alias("lon"),
    )


# --- order boards ----------------------------------------------------------------------------------------------------

_BOARD = "struct<last_page:int,data:array<struct<id:bigint,name:string,description:string,priceLimit:string,possiblePriceLimit:string,category_id:string,kwork_count:int,date_create:string,user:struct<username:string>>>>"


def board_orders(landed: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Orders of a board whose pages embed JSON; ``categories`` (category_id, category) names the ids."""
    page = F.from_json(F.regexp_extract("payload", r'(?s)"pagination":(\{.*\})', 1), _BOARD)
    w = landed.select(*_BASE, F.posexplode(page["data"]).alias("i", "w")).select(*_BASE, "i", "w.*").withColumn("source_id", F.col("id"))
    w = _once(w)
    w = w.join(categories, "category_id", "left") if categories is not None else w.withColumn("category", F.lit(None).cast("string"))
    return w.select(
        *_BASE, "source_id", F.concat(F.lit("https://kwork.ru/projects/"), F.col("id").cast("string")).alias("url"), F.col("name").alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.col("priceLimit").try_cast("double").alias("budget"),
        F.col("possiblePriceLimit").try_cast("double").alias("budget_max"), F.lit("RUB").alias("currency"), F.coalesce("category", "category_id").alias("category"), F.col("kwork_count").alias("offers"), F.col("date_create").alias("created"), F.lit("project").alias("type"), F.col("user.username").alias("buyer"),
    )


def board_categories(landed: DataFrame) -> DataFrame:
    """(category_id, category) of the names that the board's pages list, the first of each id."""
    pairs = F.regexp_extract_all("payload", F.lit(r'"(?:CATID|id)":"?\d+"?,"name":"[^"]{1,60}"'), F.lit(0))
    c = landed.select("pos", F.posexplode(pairs).alias("i", "p")).select("pos", "i", F.regexp_extract("p", r'":"?(\d+)', 1).alias("category_id"), F.regexp_extract("p", r'"name":"([^"]+)"', 1).alias("category"))
    return c.groupBy("category_id").agg(F.min_by("category", F.struct("pos", "i")).alias("category"))


_GIGS = "array<struct<id:bigint,gtitle:string,price:string,url:string,userName:string,userRatingCount:string>>"


def gig_sellers(landed: DataFrame) -> DataFrame:
    """Sellers of a search's gigs: their gigs, lowest price and most reviews."""
    found = F.regexp_extract_all("payload", F.lit(r'"data":(\[\{"id":.*?\}\])'), F.lit(1))
    g = landed.select(*_BASE, F.explode(found).alias("a")).select(*_BASE, F.posexplode(F.from_json("a", _GIGS)).alias("i", "g")).select(*_BASE, "i", "g.*").filter("gtitle is not null and length(userName) > 0").withColumn("source_id", F.col("id"))
    return _once(g).groupBy("source", "unit", F.col("userName").alias("source_id")).agg(
        F.max("collected").alias("collected"), F.min("pos").alias("pos"), F.max(F.coalesce(F.col("userRatingCount").try_cast("int"), F.lit(0))).alias("reviews"), F.min(F.when(F.col("price").try_cast("double") != 0, F.col("price").try_cast("double"))).alias("min_price"),
        F.sort_array(F.collect_list(F.struct("id", F.col("gtitle").alias("title"), "price", "url"))).alias("gigs"),
    ).withColumns({"name": F.col("source_id"), "url": F.concat(F.lit("https://kwork.ru/user/"), F.lower("source_id")), "segment": F.split_part("unit", F.lit("__"), F.lit(1)), "categories": F.array(F.lit("kwork seller"))})


def _blocks(landed: DataFrame, marker: str) -> DataFrame:
    """What follows each marker of a page, by place."""
    blocks = landed.select(*_BASE, F.posexplode(F.split("payload", marker)).alias("i", "b")).filter("i > 0")
    return blocks.withColumn("source_id", _extract("b", r"^(\d+)").cast("long")).filter("source_id is not null")


def freelance_blocks(landed: DataFrame) -> DataFrame:
    """Projects of a listing page in blocks; a budget counts only in roubles, the type stands in the footer."""
    b = _blocks(landed, 'qa-project-name="project-item')
    price = norm.clean_text(F.regexp_extract("b", r'(?s)b-post__price[^"]*">(.*?)</div>', 1))
    foot = F.left(norm.clean_text(F.substring_index("b", "Откликнуться", -1)), F.lit(300))
    n = norm.numbers_in(price)
    rouble = F.contains(price, F.lit("₽"))
    low, high = F.when(rouble, F.get(n, F.lit(0))), F.when(rouble, F.try_element_at(n, F.lit(-1)))
    title = r'(?s)id="prj_name_\d+"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    kind = F.when(F.startswith(foot, F.lit("Вакансия")), "vacancy").when(F.startswith(foot, F.lit("Конкурс")), "contest").otherwise("project")
    return _once(b).select(
        *_BASE, "source_id", F.concat(F.lit("https://www.fl.ru"), _extract("b", title)).alias("url"), norm.clean_text(_extract("b", title, 2)).alias("title"), norm.clean_text(F.regexp_extract("b", r'(?s)class="b-post__txt text-5 ">(.*?)</div>', 1)).alias("description"),
        low.alias("budget"), high.alias("budget_max"), F.when(low.isNotNull(), "RUB").alias("currency"), kind.alias("type"), F.coalesce(_extract(foot, r"(\d+)\s+ответ").cast("int"), F.lit(0)).alias("offers"),
        F.when(F.contains(foot, F.lit(" назад")), F.right(F.split_part(foot, F.lit(" назад"), F.lit(1)), F.lit(40))).alias("created"), F.lit(None).cast("string").alias("category"),
    )


def project_blocks(landed: DataFrame) -> DataFrame:
    """Projects of another listing page; dollars if the price says so, categories joined."""
    b = _blocks(landed, 'name="project_id" value="')
    price = norm.clean_text(F.regexp_extract("b", r'(?s)class="price">(?:<div class="no-mobile">)?(.*?)</div>', 1))
    n = norm.numbers_in(price)
    title = r'(?s)class="project-title">(?:<img[^>]*>)*<a href="([^"]+)"[^>]*>(.*?)</a>'
    cats = F.transform(F.regexp_extract_all(F.split_part("b", F.lit("project-block-cov"), F.lit(1)), F.lit(r'<a href="/jobs/[a-z0-9-]+/" class="b-link">(.*?)</a>'), F.lit(1)), norm.clean_text)
    return _once(b).select(
        *_BASE, "source_id", F.concat(F.lit("https://pchel.net"), _extract("b", title)).alias("url"), norm.clean_text(_extract("b", title, 2)).alias("title"), norm.clean_text(F.regexp_extract("b", r'(?s)class="project-text">(.*?)</div>', 1)).alias("description"),
        F.get(n, F.lit(0)).alias("budget"), F.try_element_at(n, F.lit(-1)).alias("budget_max"), F.when(F.contains(price, F.lit("$")), "USD").when(F.size(n) > 0, "RUB").alias("currency"), norm.blank_to_null(F.array_join(cats, "; ")).alias("category"),
        F.coalesce(_extract("b", r'class="p-user" title="(\d+)').cast("int"), F.lit(0)).alias("offers"), F.lit(None).cast("string").alias("created"), F.lit("project").alias("type"),
    )


def newest_tenders(sitemaps: DataFrame, n: int) -> DataFrame:
    """(source_id, url) of the ``n`` newest public tenders of sitemaps (payload)."""
    found = F.regexp_extract_all("payload", F.lit(r"<loc>(https://workspace\.ru/tenders/(?!private-tender)[^<]*-\d+/)</loc>"), F.lit(1))
    t = sitemaps.select(F.explode(found).alias("url")).distinct()
    return t.withColumn("source_id", _extract("url", r"-(\d+)/$").cast("long")).orderBy(F.desc("source_id")).limit(n)


def tender_details(landed: DataFrame) -> DataFrame:
    """Tenders from their pages (rows also have source_id and url): values follow their labels."""
    bare = F.regexp_replace("payload", r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    flat = F.regexp_replace(F.regexp_replace(norm.unescape_html(F.regexp_replace(bare, "<[^>]+>", " | ")), r"(?U)\s+", " "), r"(\|\s*)+", "| ")
    t = landed.withColumn("t", flat)
    after = lambda label: norm.blank_to_null(F.btrim(F.regexp_extract("t", rf"{label}:? \|( [^|]+ )\|", 1), F.lit(" |")))
    title = F.trim(norm.unescape_html(_extract("payload", r"(?s)<h1[^>]*>\s*(.*?)\s*<")))
    money = norm.budget_range(F.coalesce(after("Бюджет"), F.lit("")))
    people = F.filter(F.transform(F.split(F.regexp_extract("t", r"В тендере участвуют \|(.*?)\| Реклама", 1), r"\|"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (x != "PRO"))
    return t.select(
        *_BASE, "source_id", "url", title.alias("title"), F.left(F.btrim(F.regexp_extract("t", r"Разместить похожий тендер \|[^|]*\|(.*?)\| Бюджет:", 1), F.lit(" |")), F.lit(4000)).alias("description"), money["budget"].alias("budget"),
        F.coalesce(money["budget_max"], money["budget"]).alias("budget_max"), F.when(F.coalesce(money["budget"], money["budget_max"]).isNotNull(), "RUB").alias("currency"), after("Опубликован").alias("created"), after("Требуемая услуга").alias("category"),
        F.size(people).alias("offers"), F.when(F.contains("t", F.lit("Идет прием заявок")), "open").otherwise("closed").alias("status"), F.lit("tender").alias("type"),
    )


_CURRENCY = {"₽": "RUB", "руб": "RUB", "р": "RUB", "rub": "RUB", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR"}


def budget_from_text(text: Column) -> Column:
    """(budget, currency) of the first amount that follows a word for money."""
    rx = r"(?iu)(?:бюджет|оплата|цена|стоимость|budget|rate|pay)[^0-9]{0,20}(\d[\d \u00a0,]{2,9})\s*(₽|руб|р(?U:\b)|rub|\$|usd|€|eur)"
    unit = F.lower(F.regexp_extract(text, rx, 2))
    return F.struct(
        norm.blank_to_null(F.regexp_replace(F.regexp_extract(text, rx, 1), r"\D", "")).try_cast("double").alias("budget"), F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in _CURRENCY.items()]).alias("currency")
    )


def channel_posts(landed: DataFrame) -> DataFrame:
    """Posts of a channel's pages (unit is the channel): the first line is the title, money is read from the text."""
    b = landed.select(*_BASE, F.posexplode(F.split("payload", 'class="tgme_widget_message_wrap')).alias("i", "b")).filter("i > 0")
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("b", r'(?s)class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>', 1), r"<br\s*/?>", "\n"), "<[^>]+>", " ")
    b = b.withColumns({"text": F.trim(F.regexp_replace(norm.unescape_html(body), r"[ \t]+", " ")), "source_id": _extract("b", r'data-post="[^"/]+/(\d+)"').cast("long")}).filter("source_id is not null and length(text) > 0")
    money = budget_from_text(F.col("text"))
    return _once(b).select(
        *_BASE, "source_id", F.concat(F.lit("https://t.me/"), "unit", F.lit("/"), F.col("source_id").cast("string")).alias("url"), F.col("unit").alias("channel"), _extract("b", r'<time[^>]*datetime="([^"]+)"').alias("created"),
        F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(200)).alias("title"), F.left(F.regexp_replace("text", r"^[^\n]*\n?", ""), F.lit(3000)).alias("description"), money["budget"].alias("budget"), money["currency"].alias("currency"), F.lit("post").alias("type"),
    )


def layout_status(landed: DataFrame, marker: str, least_length: int = 50_000) -> DataFrame:
    """Payloads with ``outcome``: ``ok`` with the marker a parser needs, else ``blocked`` when short or a captcha, else ``layout_changed``."""
    walled = (F.length("payload") < least_length) | F.contains(F.lower("payload"), F.lit("captcha"))
    return landed.withColumn("outcome", F.when(F.contains("payload", F.lit(marker)), "ok").when(walled, "blocked").otherwise("layout_changed"))
