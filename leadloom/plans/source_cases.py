"""Queries over landed payloads of every source, with the SQL that they equal.

Customers stand for the records of a source: a payload is written from each customer's key as the source would write it,
and the SQL states the row that must come out. Where a source's pages overlap, each payload repeats the record that its
neighbour begins with. Lists are joined into one text, so that every engine compares them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.sources import payloads

_UNITS = 3


def keyed(spark: SparkSession, sf_dir: str, payload, **extra) -> DataFrame:
    """A landed payload of each customer; ``payload`` and ``extra`` make columns of its key."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    unit = F.concat(F.lit("u"), text(k % _UNITS))
    return c.select(F.lit("s").alias("source"), unit.alias("unit"), F.lit("2024-01-01").alias("collected"), k.cast("int").alias("pos"), payload(k).alias("payload"), *[f(k).alias(n) for n, f in extra.items()])


def text(c: Column) -> Column:
    return c.cast("string")


def say(template: str, *parts: Column) -> Column:
    """Text with each ``{}`` replaced by a part."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:], strict=True):
        out += [text(part), F.lit(piece)]
    return F.concat(*out)


def obj(**fields) -> Column:
    """Struct of fields; plain values become literals."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in fields.items()])


def flat(c: Column | str, mark: str = ",") -> Column:
    return F.array_join(c, mark)


def flat_map(c: Column | str) -> Column:
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), flat(e["value"], "+"))), ",")


def flat_signals(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws("|", s["type"], s["value"], s["source"], s["date"])), ",")


# --- maps and registries ---------------------------------------------------------------------------------------------


def _map_payload(k: Column) -> Column:
    tags = F.create_map(
        F.lit("name"), F.when(k % 4 != 3, say("Shop {}", k)), F.lit("brand"), F.when(k % 4 == 3, say("Brand {}", k)), F.lit("shop"), F.when(k % 3 == 0, F.lit("hairdresser")).when(k % 3 == 1, F.lit("bakery")),
        F.lit("hairdresser"), F.when(k % 6 == 0, F.lit("barber")), F.lit("amenity"), F.when(k % 3 == 2, F.lit("pub")), F.lit("phone"), say("+1 23{};+4 56{}", k, k), F.lit("website"), say("http://a{}.org", k),
        F.lit("contact:email"), F.when(k % 2 == 0, say("x{}@a.org, y{}@a.org", k, k)), F.lit("contact:instagram"), say("@cut{}", k), F.lit("contact:telegram"), F.when(k % 5 == 0, say("https://t.me/c{}", k)),
        F.lit("addr:street"), F.lit("Main"), F.lit("addr:housenumber"), text(k % 90), F.lit("addr:city"), F.when(k % 7 != 0, F.lit("Rome")), F.lit("ref:vatin"), F.when(k % 8 == 0, say("IT{}", k)),
    )
    node = obj(type="node", id=k, lat=k / 10, lon=k / 20, center=F.lit(None).cast("struct<lat:double,lon:double>"), tags=F.map_filter(tags, lambda _, v: v.isNotNull()))
    way = obj(type="way", id=k, lat=F.lit(None).cast("double"), lon=F.lit(None).cast("double"), center=obj(lat=k / 4, lon=k / 5), tags=F.map_filter(F.create_map(F.lit("operator"), F.when(k % 2 == 1, say("Op {}", k))), lambda _, v: v.isNotNull()))
    return F.to_json(obj(elements=F.array(node, way)))


def map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a map extract."""
    e = payloads.osm_elements(keyed(spark, sf_dir, _map_payload))
    return e.select("unit", "source_id", "url", "name", flat("sites").alias("sites"), flat("phones").alias("phones"), flat("emails").alias("emails"), "address", "city", "lat", "lon", flat("categories").alias("categories"), "segment", flat_map("socials").alias("socials"), F.try_element_at(F.col("legal.registry_ids"), F.lit("vat")).alias("vat"))


_WORDS = ["barber", "bar", "bakery", "shop=hairdresser", "shop~^h", "shop 1"]


def map_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that query words ask for: presets, keys with values or patterns, names."""
    e = payloads.osm_elements(keyed(spark, sf_dir, _map_payload))
    asked = F.array_compact(F.array(*[F.when(payloads.osm_filter(w), F.lit(w)) for w in _WORDS]))
    return e.select("source_id", F.explode(asked).alias("query"))


def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a search service."""

    def payload(k: Column) -> Column:
        part = lambda kind, long, short: obj(longText=long, shortText=short, types=F.array(F.lit(kind)))
        parts = F.array(part(F.when(k % 2 == 0, F.lit("locality")).otherwise(F.lit("postal_town")), say("City {}", k % 9), F.lit("c")), part("country", F.lit("Italy"), F.lit("IT")))
        place = obj(
            id=say("p{}", k), businessStatus=F.when(k % 5 == 0, F.lit("CLOSED_PERMANENTLY")).when(k % 5 == 1, F.lit("OPERATIONAL")), googleMapsUri=say("https://maps.example.org/{}", k), displayName=obj(text=say("Place {}", k)), websiteUri=F.when(k % 3 == 0, say("https://p{}.org/", k)),
            internationalPhoneNumber=F.when(k % 4 == 0, say("+39 {}", k)), nationalPhoneNumber=F.when(k % 4 < 2, say("0{}", k)), formattedAddress=say("Road {}", k), addressComponents=parts, location=obj(latitude=k / 8, longitude=k / 16),
            primaryTypeDisplayName=F.when(k % 2 == 1, obj(text=F.lit("Cafe"))), types=F.array(*[F.lit(x) for x in ("a", "b", "c", "d", "e")]), rating=(k % 50) / 10, userRatingCount=k % 100,
        )
        return F.to_json(obj(places=F.array(place)))

    p = payloads.place_results(keyed(spark, sf_dir, payload))
    return p.select("unit", "source_id", "url", "name", flat("sites").alias("sites"), flat("phones").alias("phones"), "address", "city", "country", "lat", "lon", flat("categories").alias("categories"), "rating", "reviews", "segment")


def uk_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New companies of a register."""

    def payload(k: Column) -> Column:
        address = obj(address_line_1=say("{} High St", k), address_line_2=F.when(k % 2 == 0, F.lit("Flat 1")), postal_code=F.lit("N1"), locality=F.lit("London"))
        company = obj(company_number=F.lpad(text(k), 8, "0"), company_name=say("FIRM {} LTD", k), date_of_creation=F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), sic_codes=F.when(k % 3 != 0, F.array(F.lit("62"), text(k % 9))), registered_office_address=address)
        return F.to_json(obj(items=F.array(company)))

    c = payloads.uk_companies(keyed(spark, sf_dir, payload), since="2023-01-01")
    return c.select("unit", "source_id", "url", "name", "address", "city", "country", flat("categories").alias("categories"), F.col("legal.name").alias("legal_name"), F.element_at("legal.registry_ids", F.lit("company_number")).alias("number"), flat_signals("signals").alias("signals"), "incorporated")


def register_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of an open register."""

    def payload(k: Column) -> Column:
        code = obj(industry_code=obj(code=F.when(k % 2 == 0, text(k % 90)), code_scheme_id=F.lit("uk_sic")))
        company = obj(
            jurisdiction_code=F.when(k % 3 == 0, F.lit("gb")).when(k % 3 == 1, F.lit("us_de")), company_number=text(k), opencorporates_url=say("https://open.example.org/{}", k), name=say("Open {}", k), registered_address_in_full=say("Box {}", k),
            registered_address=F.when(k % 4 == 0, obj(locality=F.lit("Leeds"))), incorporation_date=F.when(k % 5 != 0, F.lit("2023-05-06")), current_status=F.when(k % 2 == 0, F.lit("Active")), industry_codes=F.array(code),
        )
        return F.to_json(obj(results=obj(companies=F.array(obj(company=company)))))

    c = payloads.open_companies(keyed(spark, sf_dir, payload), since="2023-01-01")
    ids = F.array_join(F.transform(F.map_entries("legal.registry_ids"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return c.select("source_id", "url", "name", "address", "city", "country", flat("categories").alias("categories"), ids.alias("ids"), flat_signals("signals").alias("signals"), "status")


# --- filings ---------------------------------------------------------------------------------------------------------


def _filed(k: Column, cik: Column) -> Column:
    return obj(_id=say("00-{}:f{}.xml", k, k), _source=obj(form=F.when(k % 4 == 0, F.lit("D/A")).otherwise(F.lit("D")), ciks=F.array(F.lpad(text(cik), 10, "0")), file_date=F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), biz_locations=F.array(F.lit("Reno, NV")), display_names=F.array(say("Foo {} (CIK {})", cik, F.lpad(text(cik), 10, "0")))))


def filing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest filing of each company of a search; every company files about five times."""
    hits = keyed(spark, sf_dir, lambda k: F.to_json(obj(hits=obj(hits=F.array(_filed(k, F.expr("c_custkey div 15")))))))
    return payloads.filing_hits(hits).select("unit", "cik", "adsh", "file", "form", "filed", "place", "name")


def private_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers of private offerings; documents with a DTD are refused, pooled funds skipped."""

    def payload(k: Column) -> Column:
        doc = say(
            "<edgarSubmission><primaryIssuer><entityName>Foo {} Inc</entityName><issuerPhoneNumber>202555{}</issuerPhoneNumber><issuerAddress><street1>{} A St</street1><city>RENO</city><stateOrCountry>NV</stateOrCountry><zipCode>89501</zipCode></issuerAddress></primaryIssuer>"
            "<relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Ann</firstName><lastName>Lee{}</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship><relationship>Promoter</relationship></relatedPersonRelationshipList></relatedPersonInfo></relatedPersonsList>"
            "<offeringData><industryGroup><industryGroupType>{}</industryGroupType></industryGroup><offeringSalesAmounts><totalOfferingAmount>{}</totalOfferingAmount><totalAmountSold>{}</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>",
            k, F.lpad(text(k), 4, "0"), k, k, F.when(k % 6 == 0, F.lit("Pooled")).otherwise(F.lit("Biotech")), F.when(k % 2 == 0, F.lit("Indefinite")).otherwise(text(1000 + k)), 5000 + k,
        )
        return F.when(k % 7 == 0, F.concat(F.lit("<!DOCTYPE x>"), doc)).otherwise(doc)

    rows = keyed(spark, sf_dir, payload, cik=text, adsh=lambda k: say("00-{}", k), file=lambda k: F.lit("f.xml"), filed=lambda k: F.lit("2024-01-03"), name=lambda k: F.lit("F"))
    p = payloads.private_offerings(rows, skip=("Pooled",))
    people = F.array_join(F.transform("people", lambda x: F.concat_ws("|", x["name"], x["role"], x["source"])), ",")
    return p.select("source_id", "url", "name", "address", "city", "country", flat("phones").alias("phones"), flat("categories").alias("categories"), "segment", people.alias("people"), flat_signals("signals").alias("signals"))


def company_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a filing index."""

    def payload(k: Column) -> Column:
        business = obj(street1=say("{} B St", k), city=F.when(k % 2 == 0, F.lit("BOSTON")).otherwise(F.lit("McLean")), stateOrCountry=F.lit("MA"), zipCode=F.lit("02101"), isForeignLocation=k % 3 == 0, countryCode=F.lit("CA"))
        return F.to_json(obj(name=F.when(k % 4 != 0, say("Sub {}", k)), phone=say("617555{}", F.lpad(text(k), 4, "0")), website=F.when(k % 2 == 0, say("https://s{}.com", k)), sicDescription=F.lit("Services"), addresses=obj(business=business)))

    rows = keyed(spark, sf_dir, payload, cik=text, adsh=lambda k: say("00-{}", k), file=lambda k: F.lit("x.htm"), form=lambda k: F.lit("8-K"), filed=lambda k: F.lit("2024-02-03"), name=lambda k: say("Hit {}", k))
    c = payloads.company_submissions(rows)
    return c.select("source_id", "name", "address", "city", "country", flat("phones").alias("phones"), flat("sites").alias("sites"), flat("categories").alias("categories"), "segment", flat_signals("signals").alias("signals"))


# --- hiring posts ----------------------------------------------------------------------------------------------------


def hiring_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a hiring thread: own sites, boards, addresses, a signal."""

    def payload(k: Column) -> Column:
        post = say("Acme{} (YC) | Engineer | Remote | https:&#x2F;&#x2F;careers.acme{}.com&#x2F;jobs<p>write to a{}@acme{}.com <a href=\"https:&#x2F;&#x2F;jobs.lever.co&#x2F;acme{}\">x</a>", k, k, k, k, k)
        other = say("Zed{} | Cook | Berlin<p><a href=\"https:&#x2F;&#x2F;news.example.org\">x</a> <a href=\"https:&#x2F;&#x2F;www.zed{}.io&#x2F;a\">y</a>", k, k)
        children = F.array(obj(id=2 * k, text=F.when(k % 10 != 0, post), created_at=F.lit("2024-01-02T10:00:00Z")), obj(id=2 * k + 1, text=other, created_at=F.lit(None).cast("string")))
        return F.to_json(obj(title=F.lit("hiring"), children=children))

    h = payloads.hiring_posts(keyed(spark, sf_dir, payload), keywords=[["engineer", "cook"]], locations=["remote", "berlin"])
    boards = F.array_join(F.transform("job_boards", lambda b: F.concat_ws("/", b["ats"], b["token"])), ",")
    return h.select("unit", "source_id", "url", "name", flat("sites").alias("sites"), boards.alias("job_boards"), flat("emails").alias("emails"), flat("categories").alias("categories"), flat_signals("signals").alias("signals"))


# --- city directories ------------------------------------------------------------------------------------------------


def directory_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms of a directory: branches share sites, units without a city take a neighbour's, pages overlap."""

    def firm(k: Column) -> Column:
        contact = lambda kind, value, url=None: obj(type=kind, value=value, url=F.lit(None).cast("string") if url is None else url)
        contacts = F.array(
            contact(F.when(F.floor(k / _UNITS) % 2 == 0, F.lit("website")).otherwise(F.lit("fax")), say("f{}.org", k), say("http://link.2gis.ru/1/2?http://f{}.org/?utm_source=x", k)), contact("phone", say("+7495{}", k)), contact("phone", say("+7495{}", k)),
            contact("email", say("m{}@f.org", k)), contact("vkontakte", F.lit("v"), say("https://vk.com/f{}", k)),
        )
        adm = F.when(F.floor(k / _UNITS) % 3 != 0, F.array(obj(type="city", name=say("Town {}", k % _UNITS)), obj(type="country", name=F.lit("Russia")))).otherwise(F.array(obj(type="country", name=F.lit("Russia"))))
        data = obj(name=say("Firm {}", k), org=obj(id=say("o{}", F.floor(k / 12))), address_name=say("Lenina {}", k), adm_div=adm, rubrics=F.array(obj(name=F.lit("Cafe")), obj(name=F.lit(""))), reviews=obj(general_rating=(k % 50) / 10, general_review_count=k % 100), point=obj(lat=k / 8, lon=k / 16), contact_groups=F.array(obj(contacts=contacts)))
        return obj(data=data)

    def payload(k: Column) -> Column:
        profile = F.map_from_arrays(F.array(say("{}_h", k), say("{}_h", k + _UNITS)), F.array(firm(k), firm(k + _UNITS)))
        json = F.to_json(obj(data=obj(entity=obj(profile=profile))))
        return F.concat(F.lit("<script>var initialState = JSON.parse('"), F.replace(json, F.lit("\\"), F.lit("\\\\")), F.lit("');</script>"))

    d = payloads.directory_state(keyed(spark, sf_dir, payload))
    return d.select("unit", "source_id", "name", "city", "country", "address", flat("categories").alias("categories"), "rating", "reviews", "lat", "lon", flat("sites").alias("sites"), flat("phones").alias("phones"), flat("emails").alias("emails"), flat_map("socials").alias("socials"))


def map_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses of a map service's pages; pages overlap."""

    def item(k: Column) -> Column:
        links = F.array(obj(type="telegram", href=say("https://t.me/b{}", k)), obj(type="whatsapp", href=say("https://wa.me/{}?text=hi", k)))
        return obj(
            type=F.when(k % 9 == 8, F.lit("toponym")).otherwise(F.lit("business")), id=text(k), title=say("Biz {}", k), seoname=say("biz_{}", k), fullAddress=F.when(k % 2 == 0, say("Full {}", k)), address=say("Short {}", k), categories=F.array(obj(name=F.lit("Gym"))),
            phones=F.array(obj(value=F.when(k % 3 == 0, say("+7 {}", k)), number=say("8{}", k))), urls=F.array(say("https://biz{}.ru/?utm=1#a", k)), socialLinks=links, ratingData=obj(ratingValue=(k % 50) / 10, reviewCount=k % 100), coordinates=F.array(k / 8, k / 16),
        )

    def payload(k: Column) -> Column:
        state = F.to_json(obj(stack=F.array(obj(results=obj(items=F.array(item(k), item(k + _UNITS)))))))
        return F.concat(F.lit('<script type="application/json" class="state-view">'), state, F.lit("</script>"))

    m = payloads.map_state(keyed(spark, sf_dir, payload))
    return m.select("unit", "source_id", "name", "city", "address", flat("categories").alias("categories"), flat("phones").alias("phones"), flat("sites").alias("sites"), flat_map("socials").alias("socials"), "rating", "reviews", "url", "lat", "lon")


# --- order boards ----------------------------------------------------------------------------------------------------


def board_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a board with the names of their categories; pages overlap."""

    def order(k: Column) -> Column:
        return obj(id=k + 5000, name=say("Order {}", k), description=F.when(k % 3 != 0, say("Text {}", k)), priceLimit=text(100 + k), possiblePriceLimit=F.when(k % 2 == 0, text(300 + k)), category_id=text(k % 4), kwork_count=(k % 7).cast("int"), date_create=F.lit("2024-01-02 10:00:00"), user=obj(username=say("buyer{}", k % 11)))

    def payload(k: Column) -> Column:
        page = F.to_json(obj(last_page=9, data=F.array(order(k), order(k + _UNITS))))
        return F.concat(F.lit('{"CATID":"0","name":"Sites"},{"CATID":1,"name":"Texts"},{"id":2,"name":"Ads"},"pagination":'), page)

    landed = keyed(spark, sf_dir, payload)
    return payloads.board_orders(landed, payloads.board_categories(landed)).select("unit", "source_id", "url", "title", "description", "budget", "budget_max", "currency", "category", "offers", "created", "type", "buyer")


def gig_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers of a search's gigs."""

    def payload(k: Column) -> Column:
        gig = obj(id=k, gtitle=F.when(k % 8 != 7, say("Gig {}", k)), price=text(500 + k % 13 * 100), url=say("/gig/{}", k), userName=say("Seller{}", k % 30), userRatingCount=text(k % 40))
        return F.concat(F.lit('x "data":'), F.to_json(F.array(gig)), F.lit(" y"))

    s = payloads.gig_sellers(keyed(spark, sf_dir, payload))
    gigs = F.array_join(F.transform("gigs", lambda g: F.concat_ws("|", text(g["id"]), g["title"], g["price"], g["url"])), ",")
    return s.select("unit", "source_id", "name", "url", "reviews", "min_price", gigs.alias("gigs"), "segment", flat("categories").alias("categories"))


def freelance_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a listing in blocks; pages overlap."""

    def block(k: Column) -> Column:
        price = F.when(k % 3 == 0, say("{} – {} ₽", 1000 + k, 2000 + k)).when(k % 3 == 1, say("{} $", k)).otherwise(F.lit("по договоренности"))
        foot = F.when(k % 4 == 0, F.lit("Вакансия")).when(k % 4 == 1, F.lit("Конкурс")).otherwise(F.lit("Заказ"))
        return say(' qa-project-name="project-item{}" <a id="prj_name_{}" href="/p/{}">Сделать <b>сайт</b> {}</a><div class="b-post__price">{}</div><div class="b-post__txt text-5 ">текст &amp; {}</div> Откликнуться {} {} ответа 2 часа назад', k, k, k, k, price, k, foot, k % 5)

    p = payloads.freelance_blocks(keyed(spark, sf_dir, lambda k: F.concat(block(k), block(k + _UNITS))))
    return p.select("unit", "source_id", "url", "title", "description", "budget", "budget_max", "currency", "type", "offers", "created")


def listed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of another listing; pages overlap."""

    def block(k: Column) -> Column:
        price = F.when(k % 3 == 0, say("${}", k + 1)).when(k % 3 == 1, say("{} - {} р.", k, k + 50)).otherwise(F.lit("договорная"))
        return say(
            ' name="project_id" value="{}" <a href="/jobs/web-dev/" class="b-link">Web</a><a href="/jobs/seo/" class="b-link">Seo &amp; more</a> project-block-cov <div class="price"><div class="no-mobile">{}</div></div><div class="project-title"><img src="x"><a href="/project/{}" class="t">Work {}</a></div><div class="project-text">Do <i>it</i> {}</div><span class="p-user" title="{} bids">',
            k, price, k, k, k, k % 6,
        )

    p = payloads.project_blocks(keyed(spark, sf_dir, lambda k: F.concat(block(k), block(k + _UNITS))))
    return p.select("unit", "source_id", "url", "title", "description", "budget", "budget_max", "currency", "category", "offers", "type")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the newest public tenders of sitemaps."""
    sitemap = lambda k: say("<loc>https://workspace.ru/tenders/build-site-{}/</loc><loc>https://workspace.ru/tenders/private-tender-{}/</loc>", k, k + 1)
    newest = payloads.newest_tenders(keyed(spark, sf_dir, sitemap), 200)

    def page(k: Column) -> Column:
        money = F.when(k % 3 == 0, say("от {} до {} руб", 1000 + k, 9000 + k)).when(k % 3 == 1, say("до {} руб", 500 + k)).otherwise(F.lit("не указан"))
        state = F.when(k % 2 == 0, F.lit("Идет прием заявок")).otherwise(F.lit("Завершен"))
        return say(
            "<script>x</script><h1 class='t'> Tender {} &amp; co </h1><p>{}</p><a>Разместить похожий тендер</a><b>x</b><p>Нужен сайт {}</p><b>Бюджет:</b><p>{}</p><b>Опубликован:</b><p>0{}.01.2024</p><b>Требуемая услуга:</b><p>Сайты</p><h2>В тендере участвуют</h2><a>Studio A{}</a><i>PRO</i><a>Studio B</a><h2>Реклама</h2>",
            k, state, k, money, k % 9 + 1, k,
        )

    landed = keyed(spark, sf_dir, page, source_id=lambda k: k).join(newest, "source_id")
    return payloads.tender_details(landed).select("source_id", "url", "title", "description", "budget", "budget_max", "currency", "created", "category", "offers", "status", "type")


def channel_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of channels; pages overlap."""

    def post(k: Column) -> Column:
        money = F.when(k % 3 == 0, say("Бюджет: {} руб", 15000 + k)).when(k % 3 == 1, say("budget {} usd", 1500 + k)).otherwise(F.lit("пишите"))
        return say('<div class="tgme_widget_message_wrap"><div data-post="ch/{}"></div><div class="tgme_widget_message_text js">Нужен <b>бот</b> {}<br/>{}<br>конец</div><time datetime="2024-01-02T0{}:00"></time></div>', k, k, money, k % 10)

    p = payloads.channel_posts(keyed(spark, sf_dir, lambda k: F.concat(post(k), post(k + _UNITS))))
    return p.select("unit", "source_id", "url", "channel", "created", "title", "description", "budget", "currency", "type")


def layout_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page without its parser's marker is: short or walled pages are blocked, others of a new layout."""

    def payload(k: Column) -> Column:
        return F.when(k % 4 == 0, F.lit("<b>MARK</b>")).when(k % 4 == 1, F.lit("short")).when(k % 4 == 2, F.concat(F.repeat(F.lit("y"), 600), F.lit("Captcha"))).otherwise(F.repeat(F.lit("y"), 600))

    return payloads.layout_status(keyed(spark, sf_dir, payload), "MARK", least_length=500).select("unit", "pos", "outcome")


QUERIES = {
    f.__name__: f
    for f in (map_extract, map_filters, place_search, uk_register, register_search, filing_search, private_offerings, company_submissions, hiring_posts, directory_firms, map_businesses, board_orders, gig_sellers, freelance_projects, listed_projects, tenders, channel_posts, layout_outcomes)
}

_K = "SELECT c_custkey AS k, 'u' || (c_custkey % 3) AS unit FROM customer"
# With overlapping pages the record after a unit's last is there too.
_K2 = "SELECT k, 'u' || (k % 3) AS unit FROM (SELECT c_custkey AS k FROM customer UNION SELECT c_custkey + 3 FROM customer)"

ORACLES = {
    "map_extract": f"""WITH c AS ({_K}), e AS (
  SELECT unit, 'node/' || k AS source_id, CASE WHEN k % 4 <> 3 THEN 'Shop ' || k ELSE 'Brand ' || k END AS name, 'http://a' || k || '.org' AS sites, '+1 23' || k || ',+4 56' || k AS phones, CASE WHEN k % 2 = 0 THEN 'x' || k || '@a.org,y' || k || '@a.org' ELSE '' END AS emails,
    'Main ' || (k % 90) || CASE WHEN k % 7 <> 0 THEN ', Rome' ELSE '' END AS address, CASE WHEN k % 7 <> 0 THEN 'Rome' END AS city, k / 10 AS lat, k / 20 AS lon, CASE k % 3 WHEN 0 THEN 'shop=hairdresser' WHEN 1 THEN 'shop=bakery' ELSE 'amenity=pub' END AS categories,
    'instagram=https://instagram.com/cut' || k || CASE WHEN k % 5 = 0 THEN ',telegram=https://t.me/c' || k ELSE '' END AS socials, CASE WHEN k % 8 = 0 THEN 'IT' || k END AS vat FROM c
  UNION ALL SELECT unit, 'way/' || k, 'Op ' || k, '', '', '', NULL, NULL, k / 4, k / 5, '', '', NULL FROM c WHERE k % 2 = 1)
SELECT unit, source_id, 'https://www.openstreetmap.org/' || source_id AS url, name, sites, phones, emails, address, city, lat, lon, categories, unit AS segment, socials, vat FROM e""",
    "map_filters": f"""WITH c AS ({_K})
SELECT 'node/' || k AS source_id, unnest(list_filter([CASE WHEN k % 6 = 0 THEN 'barber' END, CASE WHEN k % 3 = 2 THEN 'bar' END, CASE WHEN k % 3 = 1 THEN 'bakery' END, CASE WHEN k % 3 = 0 THEN 'shop=hairdresser' END, CASE WHEN k % 3 = 0 THEN 'shop~^h' END,
  CASE WHEN k % 4 <> 3 AND starts_with(CAST(k AS VARCHAR), '1') THEN 'shop 1' END], lambda x: x IS NOT NULL)) AS query FROM c""",
    "place_search": f"""WITH c AS ({_K})
SELECT unit, 'p' || k AS source_id, 'https://maps.example.org/' || k AS url, 'Place ' || k AS name, CASE WHEN k % 3 = 0 THEN 'https://p' || k || '.org/' ELSE '' END AS sites, CASE WHEN k % 4 = 0 THEN '+39 ' || k WHEN k % 4 = 1 THEN '0' || k ELSE '' END AS phones, 'Road ' || k AS address,
  'City ' || (k % 9) AS city, 'IT' AS country, k / 8 AS lat, k / 16 AS lon, CASE WHEN k % 2 = 1 THEN 'Cafe,a,b,c,d' ELSE 'a,b,c,d' END AS categories, (k % 50) / 10 AS rating, k % 100 AS reviews, unit AS segment FROM c WHERE k % 5 <> 0""",
    "uk_register": f"""WITH c AS (SELECT *, lpad(CAST(k AS VARCHAR), 8, '0') AS number, strftime(DATE '2023-01-01' + CAST(k % 300 AS INTEGER), '%Y-%m-%d') AS born FROM ({_K})), u AS (SELECT *, 'https://find-and-update.company-information.service.gov.uk/company/' || number AS url FROM c)
SELECT unit, number AS source_id, url, 'FIRM ' || k || ' LTD' AS name, k || ' High St' || CASE WHEN k % 2 = 0 THEN ', Flat 1' ELSE '' END || ', N1' AS address, 'London' AS city, 'GB' AS country, CASE WHEN k % 3 <> 0 THEN 'sic:62,sic:' || (k % 9) ELSE '' END AS categories,
  'FIRM ' || k || ' LTD' AS legal_name, number, 'new_registration|' || born || '|' || url || '|' || born AS signals, born AS incorporated FROM u""",
    "register_search": f"""WITH c AS (SELECT *, CASE k % 3 WHEN 0 THEN 'gb/' WHEN 1 THEN 'us_de/' ELSE '/' END || k AS ref, 'https://open.example.org/' || k AS url FROM ({_K}))
SELECT ref AS source_id, url, 'Open ' || k AS name, 'Box ' || k AS address, CASE WHEN k % 4 = 0 THEN 'Leeds' END AS city, CASE k % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' END AS country, CASE WHEN k % 2 = 0 THEN 'uk_sic:' || (k % 90) ELSE '' END AS categories,
  'opencorporates=' || ref || CASE WHEN k % 3 = 0 THEN ',company_number=' || k ELSE '' END AS ids, CASE WHEN k % 5 <> 0 THEN 'new_registration|2023-05-06|' || url || '|2023-05-06' ELSE '' END AS signals, CASE WHEN k % 2 = 0 THEN 'Active' END AS status FROM c""",
    "filing_search": f"""WITH c AS (SELECT *, k // 15 AS cik, strftime(DATE '2023-01-01' + CAST(k % 300 AS INTEGER), '%Y-%m-%d') AS filed FROM ({_K}) WHERE k % 4 <> 0)
SELECT unit, CAST(cik AS VARCHAR) AS cik, '00-' || k AS adsh, 'f' || k || '.xml' AS file, 'D' AS form, filed, 'Reno, NV' AS place, 'Foo ' || cik AS name FROM c QUALIFY row_number() OVER (PARTITION BY unit, cik ORDER BY filed DESC, k) = 1""",
    "private_offerings": f"""WITH c AS (SELECT *, 'https://www.sec.gov/Archives/edgar/data/' || k || '/00' || k || '/f.xml' AS filing FROM ({_K}) WHERE k % 6 <> 0 AND k % 7 <> 0)
SELECT CAST(k AS VARCHAR) AS source_id, 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || k AS url, 'Foo ' || k || ' Inc' AS name, k || ' A St, RENO, NV 89501' AS address, 'Reno' AS city, 'US' AS country, '+1202555' || left(lpad(CAST(k AS VARCHAR), 4, '0'), 4) AS phones, 'Biotech' AS categories, 'Biotech' AS segment,
  'Ann Lee' || k || '|Director, Promoter|' || filing AS people, 'funding|Form D 2024-01-03: $' || format('{{:,}}', 5000 + k) || ' sold of ' || CASE WHEN k % 2 = 0 THEN 'Indefinite' ELSE '$' || format('{{:,}}', 1000 + k) END || ' offered|' || filing || '|2024-01-03' AS signals FROM c""",
    "company_submissions": f"""WITH c AS (SELECT *, '617555' || left(lpad(CAST(k AS VARCHAR), 4, '0'), 4) AS phone FROM ({_K}))
SELECT CAST(k AS VARCHAR) AS source_id, CASE WHEN k % 4 <> 0 THEN 'Sub ' || k ELSE 'Hit ' || k END AS name, k || ' B St, ' || CASE WHEN k % 2 = 0 THEN 'BOSTON' ELSE 'McLean' END || ', MA 02101' AS address, CASE WHEN k % 2 = 0 THEN 'Boston' ELSE 'McLean' END AS city,
  CASE WHEN k % 3 = 0 THEN 'CA' ELSE 'US' END AS country, CASE WHEN k % 3 = 0 THEN phone ELSE '+1' || phone END AS phones, CASE WHEN k % 2 = 0 THEN 'https://s' || k || '.com' ELSE '' END AS sites, 'Services' AS categories, 'Services' AS segment,
  'sec_filing|8-K filed 2024-02-03|https://www.sec.gov/Archives/edgar/data/' || k || '/00' || k || '/x.htm|2024-02-03' AS signals FROM c""",
    "hiring_posts": f"""WITH c AS ({_K}), p AS (
  SELECT unit, 2 * k AS id, 'Acme' || k AS name, 'https://acme' || k || '.com/' AS sites, 'lever/acme' || k AS job_boards, 'a' || k || '@acme' || k || '.com' AS emails, 'Acme' || k || ' (YC) | Engineer | Remote | https://careers.acme' || k || '.com/jobs' AS headline, '2024-01-02' AS day FROM c WHERE k % 10 <> 0
  UNION ALL SELECT unit, 2 * k + 1, 'Zed' || k, 'https://zed' || k || '.io/', '', '', 'Zed' || k || ' | Cook | Berlin', '' FROM c)
SELECT unit, CAST(id AS VARCHAR) AS source_id, 'https://news.ycombinator.com/item?id=' || id AS url, name, sites, job_boards, emails, 'hiring' AS categories, 'hiring|' || headline || '|https://news.ycombinator.com/item?id=' || id || '|' || day AS signals FROM p""",
    "directory_firms": f"""WITH c AS (SELECT *, k // 12 AS org, (k // 3) % 2 = 0 AS has_site, CASE WHEN (k // 3) % 3 <> 0 THEN 'Town ' || (k % 3) END AS town FROM ({_K2})),
f AS (SELECT *, CASE WHEN has_site THEN 'http://f' || k || '.org/' END AS site FROM c), s AS (SELECT *, coalesce(site, arg_min(site, greatest(k - 3, k % 3) * 10 + (k >= 3)::INT) OVER (PARTITION BY org), '') AS sites, arg_min(town, k) OVER (PARTITION BY unit) AS near FROM f)
SELECT unit, CAST(k AS VARCHAR) AS source_id, 'Firm ' || k AS name, coalesce(town, near, unit) AS city, 'Russia' AS country, coalesce(town || ', ', '') || 'Lenina ' || k AS address, 'Cafe' AS categories, (k % 50) / 10 AS rating, k % 100 AS reviews, k / 8 AS lat, k / 16 AS lon, sites, '+7495' || k AS phones, 'm' || k || '@f.org' AS emails, 'vk=https://vk.com/f' || k AS socials FROM s""",
    "map_businesses": f"""WITH c AS (SELECT * FROM ({_K2}) WHERE k % 9 <> 8)
SELECT unit, CAST(k AS VARCHAR) AS source_id, 'Biz ' || k AS name, unit AS city, CASE WHEN k % 2 = 0 THEN 'Full ' || k ELSE 'Short ' || k END AS address, 'Gym' AS categories, CASE WHEN k % 3 = 0 THEN '+7 ' || k ELSE '8' || k END AS phones, 'https://biz' || k || '.ru/' AS sites,
  'telegram=https://t.me/b' || k || ',whatsapp=https://wa.me/' || k AS socials, (k % 50) / 10 AS rating, k % 100 AS reviews, 'https://yandex.ru/maps/org/biz_' || k || '/' || k || '/' AS url, k / 16 AS lat, k / 8 AS lon FROM c""",
    "board_orders": f"""WITH c AS ({_K2})
SELECT unit, k + 5000 AS source_id, 'https://kwork.ru/projects/' || (k + 5000) AS url, 'Order ' || k AS title, CASE WHEN k % 3 <> 0 THEN 'Text ' || k ELSE '' END AS description, CAST(100 + k AS DOUBLE) AS budget, CASE WHEN k % 2 = 0 THEN CAST(300 + k AS DOUBLE) END AS budget_max, 'RUB' AS currency,
  CASE k % 4 WHEN 0 THEN 'Sites' WHEN 1 THEN 'Texts' WHEN 2 THEN 'Ads' ELSE '3' END AS category, CAST(k % 7 AS INTEGER) AS offers, '2024-01-02 10:00:00' AS created, 'project' AS type, 'buyer' || (k % 11) AS buyer FROM c""",
    "gig_sellers": f"""WITH c AS (SELECT *, 500 + k % 13 * 100 AS price FROM ({_K}) WHERE k % 8 <> 7)
SELECT unit, 'Seller' || (k % 30) AS source_id, 'Seller' || (k % 30) AS name, 'https://kwork.ru/user/seller' || (k % 30) AS url, CAST(max(k % 40) AS INTEGER) AS reviews, CAST(min(price) AS DOUBLE) AS min_price, string_agg(k || '|Gig ' || k || '|' || price || '|/gig/' || k, ',' ORDER BY k) AS gigs, unit AS segment, 'kwork seller' AS categories FROM c GROUP BY unit, k % 30""",
    "freelance_projects": f"""WITH c AS ({_K2})
SELECT unit, k AS source_id, 'https://www.fl.ru/p/' || k AS url, 'Сделать сайт ' || k AS title, 'текст & ' || k AS description, CASE WHEN k % 3 = 0 THEN CAST(1000 + k AS DOUBLE) END AS budget, CASE WHEN k % 3 = 0 THEN CAST(2000 + k AS DOUBLE) END AS budget_max, CASE WHEN k % 3 = 0 THEN 'RUB' END AS currency,
  CASE k % 4 WHEN 0 THEN 'vacancy' WHEN 1 THEN 'contest' ELSE 'project' END AS type, CAST(k % 5 AS INTEGER) AS offers, CASE k % 4 WHEN 0 THEN 'Вакансия' WHEN 1 THEN 'Конкурс' ELSE 'Заказ' END || ' ' || (k % 5) || ' ответа 2 часа' AS created FROM c""",
    "listed_projects": f"""WITH c AS ({_K2})
SELECT unit, k AS source_id, 'https://pchel.net/project/' || k AS url, 'Work ' || k AS title, 'Do it ' || k AS description, CASE k % 3 WHEN 0 THEN CAST(k + 1 AS DOUBLE) WHEN 1 THEN CAST(k AS DOUBLE) END AS budget, CASE k % 3 WHEN 0 THEN CAST(k + 1 AS DOUBLE) WHEN 1 THEN CAST(k + 50 AS DOUBLE) END AS budget_max,
  CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'RUB' END AS currency, 'Web; Seo & more' AS category, CAST(k % 6 AS INTEGER) AS offers, 'project' AS type FROM c""",
    "tenders": f"""WITH c AS (SELECT * FROM ({_K}) ORDER BY k DESC LIMIT 200)
SELECT k AS source_id, 'https://workspace.ru/tenders/build-site-' || k || '/' AS url, 'Tender ' || k || ' & co' AS title, 'Нужен сайт ' || k AS description, CASE WHEN k % 3 = 0 THEN CAST(1000 + k AS DOUBLE) END AS budget, CASE k % 3 WHEN 0 THEN CAST(9000 + k AS DOUBLE) WHEN 1 THEN CAST(500 + k AS DOUBLE) END AS budget_max,
  CASE WHEN k % 3 < 2 THEN 'RUB' END AS currency, '0' || (k % 9 + 1) || '.01.2024' AS created, 'Сайты' AS category, 2 AS offers, CASE WHEN k % 2 = 0 THEN 'open' ELSE 'closed' END AS status, 'tender' AS type FROM c""",
    "channel_posts": f"""WITH c AS (SELECT *, CASE k % 3 WHEN 0 THEN 'Бюджет: ' || (15000 + k) || ' руб' WHEN 1 THEN 'budget ' || (1500 + k) || ' usd' ELSE 'пишите' END AS money FROM ({_K2}))
SELECT unit, k AS source_id, 'https://t.me/' || unit || '/' || k AS url, unit AS channel, '2024-01-02T0' || (k % 10) || ':00' AS created, 'Нужен бот ' || k AS title, money || chr(10) || 'конец' AS description, CASE k % 3 WHEN 0 THEN CAST(15000 + k AS DOUBLE) WHEN 1 THEN CAST(1500 + k AS DOUBLE) END AS budget, CASE k % 3 WHEN 0 THEN 'RUB' WHEN 1 THEN 'USD' END AS currency, 'post' AS type FROM c""",
    "layout_outcomes": f"""WITH c AS ({_K}) SELECT unit, CAST(k AS INTEGER) AS pos, CASE k % 4 WHEN 0 THEN 'ok' WHEN 3 THEN 'layout_changed' ELSE 'blocked' END AS outcome FROM c""",
}
