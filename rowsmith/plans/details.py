"""Business filters, keyword groups, names, expanded pages and addresses, and merges of normalised keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.functions import emails, html, names, urls
from rowsmith.plans.contacts import cases
from rowsmith.plans.leads import LEADS, leads
from rowsmith.plans.tables import Book, Tables
from rowsmith.plans.texts import FOUND_SQL, has_any, quoted

book = Book()

# Sites that are no business's own.
PLATFORMS = ("traveleto.com", "hotelmix.", "hotel-mix.", "business.site", "booking.com", "booked.net", "airbnb.com", "hotels.com", "expedia.com", "tripadvisor.", "wotif.com", "stayz.com.au", "homeaway.com", "vrbo.com", "agoda.com", "hostelworld.com", "hotelscombined.com", "trivago.", "kayak.com", "priceline.com", "trip.com", "venere.com", "hrs.com", "lastminute.com")
PLACE = {
    "id": "p_partkey",
    "status": cases("p_partkey", ["'OPERATIONAL'", "'OPERATIONAL'", "'CLOSED_TEMPORARILY'"]),
    "reviews": "p_size * 7",
    "rating": "3 + (p_partkey % 21) / CAST(10.0 AS DOUBLE)",
    "website": cases("p_partkey", ["'https://www.shop' || p_partkey || '.com'", "'http://Booking.com/x'", "'shop.io'", "'ftp'", "''", "NULL", "'www.hotelmix.de'"]),
    "country": "p_brand",
}
PLACES = "p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PLACE.items()) + " FROM part)"


def places(t: Tables):
    return t.part.select(*(F.expr(e).alias(n) for n, e in PLACE.items()))


def any_of(c, words):
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


_site = "lower(trim(coalesce(website, '')))"
_valid = f"(contains({_site}, '.') AND length({_site}) > 4 AND (starts_with({_site}, 'http://') OR starts_with({_site}, 'https://') OR {has_any(_site, ('www.', '.com', '.org', '.net', '.io', '.co'))}))"


@book.add(f"WITH {PLACES} SELECT id, status = 'OPERATIONAL' AND reviews >= 20 AND reviews <= 250 AND rating >= 3.5 AS kept, {has_any(_site, PLATFORMS)} AS platform, {_valid} AS valid_site FROM p")
def business_filter(t: Tables):
    """Open places with enough reviews and rating, sites of platforms, and whether a site looks like one."""
    s = F.lower(F.trim(F.coalesce("website", F.lit(""))))
    valid = s.contains(".") & (F.length(s) > 4) & (s.startswith("http://") | s.startswith("https://") | any_of(s, ("www.", ".com", ".org", ".net", ".io", ".co")))
    kept = (F.col("status") == "OPERATIONAL") & F.col("reviews").between(20, 250) & (F.col("rating") >= 3.5)
    return places(t).select("id", kept.alias("kept"), any_of(s, PLATFORMS).alias("platform"), valid.alias("valid_site"))


_reason = f"CASE WHEN status <> 'OPERATIONAL' THEN 'closed' WHEN reviews < 20 THEN 'few_reviews' WHEN reviews > 250 THEN 'many_reviews' WHEN rating < 3.5 THEN 'low_rating' WHEN {has_any(_site, PLATFORMS)} THEN 'platform' END"


@book.add(f"""
WITH {PLACES}, r AS (SELECT country, {_reason} AS reason FROM p), c AS (SELECT country, reason, count(*) AS n FROM r GROUP BY 1, 2),
s AS (SELECT country, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE reason IS NULL), 0)::BIGINT AS n_in FROM c GROUP BY 1),
k AS (SELECT country, reason, n FROM c WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, reason) <= 10)
SELECT country, total, n_in, total - n_in AS n_out, round((total - n_in) * 100.0::DOUBLE / total, 2) AS rate, coalesce(string_agg(reason || '=' || n, ',' ORDER BY n DESC, reason), '') AS reasons FROM s LEFT JOIN k USING (country) GROUP BY ALL""")
def filter_report(t: Tables):
    """Rows in and out by country, the rate, and the ten most frequent reasons."""
    s = F.lower(F.trim(F.coalesce("website", F.lit(""))))
    reason = F.when(F.col("status") != "OPERATIONAL", "closed").when(F.col("reviews") < 20, "few_reviews").when(F.col("reviews") > 250, "many_reviews").when(F.col("rating") < 3.5, "low_rating").when(any_of(s, PLATFORMS), "platform")
    c = places(t).groupBy("country", reason.alias("reason")).agg(F.count("*").alias("n"))
    sums = c.groupBy("country").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("n_in"))
    rank = F.row_number().over(W.partitionBy("country").orderBy(F.desc("n"), "reason"))
    top = c.filter("reason is not null").withColumn("k", rank).filter("k <= 10")
    top = top.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("reason", F.lit("="), "n").alias("x")))).alias("l"))
    r = sums.join(top, "country", "left")
    n_out = F.col("total") - F.col("n_in")
    return r.select("country", "total", "n_in", n_out.alias("n_out"), F.round(n_out * F.lit(100.0).cast("double") / F.col("total"), 2).alias("rate"), F.coalesce(F.array_join(F.transform("l", lambda x: x["x"]), ","), F.lit("")).alias("reasons"))


@book.add(f"WITH {LEADS} SELECT id, coalesce(result, '') IN ('deliverable', 'risky') AS usable, coalesce(result = 'deliverable', false) AND NOT lower(split_part(trim(coalesce(email, '')), '@', -1)) IN ({', '.join(map(quoted, emails.FREE_DOMAINS))}) AS corporate, starts_with(coalesce(result, ''), 'un') AS unsure FROM l")
def validation_filters(t: Tables):
    """Rows by validation result, corporate addresses only, and a prefix of a status."""
    r = leads(t, "id", "email", "result")
    result = F.coalesce("result", F.lit(""))
    free = F.lower(F.substring_index(F.trim(F.coalesce("email", F.lit(""))), "@", -1)).isin(*emails.FREE_DOMAINS)
    return r.select("id", result.isin("deliverable", "risky").alias("usable"), ((result == "deliverable") & ~free).alias("corporate"), result.startswith("un").alias("unsure"))


# Words of industries, of niches, and of services.
INDUSTRIES = {
    "technology": ("software", "tech", "digital", "ai", "automation", "development"),
    "marketing": ("marketing", "advertising", "branding", "seo", "social media"),
    "consulting": ("consulting", "advisory", "strategy", "transformation"),
    "finance": ("finance", "accounting", "investment", "banking", "fintech"),
    "healthcare": ("healthcare", "medical", "pharma", "health", "wellness"),
    "education": ("education", "training", "learning", "courses", "academy"),
}
NICHE_WORDS = {
    "hvac": ("hvac", "heat", "air", "cooling", "ac", "conditioning", "furnace", "climate"),
    "electricians": ("electric", "electrical", "electrician", "elec", "power", "wiring"),
    "plumbers": ("plumb", "plumbing", "drain", "pipe", "water", "sewer"),
    "locksmiths": ("lock", "locksmith", "key", "security", "safe"),
    "garage_door": ("garage", "door", "overhead"),
    "towing": ("tow", "towing", "wrecker", "roadside"),
    "roofing": ("roof", "roofing", "shingle", "gutter"),
    "carpet": ("carpet", "flooring", "rug", "floor"),
}
SERVICES = {"Residential": ("residential",), "Commercial": ("commercial",), "24/7 Emergency": ("24/7", "emergency", "24 hour"), "Installation": ("install",), "Repair": ("repair",), "Maintenance": ("maintenance",)}
SIZES = (r"(\d+)\s*(?:employees?|team members?|people)", r"founded in (\d{4})", r"since (\d{4})", r"(\d+)\s*(?:years?|offices?|locations?)")
ABOUT = cases(
    "c_custkey",
    [
        "'Residential and commercial repair, 24/7. ' || c_custkey || ' employees since 1999'",
        "'We do branding for shops. Founded in 2004 with 12 offices'",
        "'Roof and gutter work, since 1987'",
        "'Commercial boiler install and plumbing; strategy consulting'",
        "'Wellness courses'",
        "'Nothing of note'",
        "NULL",
    ],
)
_about = f"a AS (SELECT c_custkey, lower(coalesce({ABOUT}, '')) AS s FROM customer)"
_first = lambda groups, rest: "CASE " + " ".join(f"WHEN {has_any('s', ws)} THEN {quoted(k)}" for k, ws in groups.items()) + f" ELSE {quoted(rest)} END"
_sizes = "CASE " + " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN array_to_string(regexp_extract_all(s, {quoted(p)}, 1)[1:3], ', ')" for p in SIZES) + " ELSE '' END"


@book.add(f"""
WITH {_about} SELECT c_custkey, {_first(INDUSTRIES, 'other')} AS industry, {_first(NICHE_WORDS, 'unknown')} AS niche, coalesce(list_aggregate(list_filter([{", ".join(f"CASE WHEN {has_any('s', ws)} THEN {quoted(k)} END" for k, ws in SERVICES.items())}], lambda x: x IS NOT NULL), 'string_agg', ', '), '') AS services,
  CASE WHEN contains(s, 'residential') AND contains(s, 'commercial') THEN 'Residential & Commercial' WHEN contains(s, 'residential') THEN 'Residential Only' WHEN contains(s, 'commercial') THEN 'Commercial Only' ELSE 'General' END AS specialization, {_sizes} AS size_indicators FROM a""")
def keyword_groups(t: Tables):
    """Industry and niche by the first group of words, services, specialization and size indicators."""
    a = t.customer.select("c_custkey", F.lower(F.coalesce(F.expr(ABOUT), F.lit(""))).alias("s"))
    s = F.col("s")
    first = lambda groups, rest: reduce(lambda c, x: F.when(any_of(s, x[1]), x[0]).otherwise(c), reversed(groups.items()), F.lit(rest))
    services = F.array_join(F.array_compact(F.array(*(F.when(any_of(s, ws), k) for k, ws in SERVICES.items()))), ", ")
    home, trade = s.contains("residential"), s.contains("commercial")
    sizes = reduce(lambda c, p: F.when(s.rlike(p), F.array_join(F.slice(F.regexp_extract_all(s, F.lit(p), F.lit(1)), 1, 3), ", ")).otherwise(c), reversed(SIZES), F.lit(""))
    special = F.when(home & trade, "Residential & Commercial").when(home, "Residential Only").when(trade, "Commercial Only").otherwise("General")
    return a.select("c_custkey", first(INDUSTRIES, "other").alias("industry"), first(NICHE_WORDS, "unknown").alias("niche"), services.alias("services"), special.alias("specialization"), sizes.alias("size_indicators"))


NAME = cases(
    "c_custkey",
    [
        "'Acme Widgets Pty Ltd'",
        "'Grand River Hotel and Convention Centre'",
        "'Smith & Sons Limited'",
        "'The Museum & History Center of Salem'",
        "'Sydney Harbour View Cafe Australia'",
        "'National Memorial Collection of the Northern Provinces and Islands'",
        "'Cottages by the Sea Inc.'",
        "'Customer ' || c_custkey || ' Company'",
    ],
)
_bare = "trim(n)"
for _s in names.SUFFIXES:
    _bare = f"regexp_replace({_bare}, {quoted('\\b' + _s)}, '', 'gi')"
_bare = f"regexp_replace({_bare}, '\\bAustralian?\\b', '', 'gi')"
_bare = f"regexp_replace(regexp_replace(regexp_replace({_bare}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '[ ,\\-–—]+$', '')"
_short = "n"
for _s in names.REMOVED:
    _short = f"replace({_short}, {quoted(_s)}, '')"
_short = f"trim(regexp_replace(regexp_replace(trim({_short}), '^-+|-+$', '', 'g'), '^,+|,+$', '', 'g'))"


@book.add(f"""
WITH r AS (SELECT c_custkey, {NAME} AS n FROM customer), b AS (SELECT c_custkey, n, {_bare} AS bare, {_short} AS cut FROM r), w AS (SELECT *, string_split(bare, ' ') AS w FROM b)
SELECT c_custkey, CASE WHEN len(w) > 4 THEN array_to_string(w[1:(CASE WHEN list_has_any(w, [{", ".join(map(quoted, names.LODGING))}]) THEN 4 ELSE 3 END)], ' ') ELSE bare END AS casual,
  CASE WHEN cut = '' THEN n[1:40] WHEN length(cut) > 40 THEN regexp_replace(cut[1:40], '\\s\\S*$', '') ELSE cut END AS short FROM w""")
def business_names(t: Tables):
    """Names without legal forms and places, and short ones, over names on which the rules fire."""
    n = F.expr(NAME)
    return t.customer.select("c_custkey", names.casual(n).alias("casual"), names.short(n).alias("short"))


@book.add(f"""
WITH src AS (SELECT page_id AS id, regexp_replace(html, '<[^>]*>', ' ', 'g') || ' ' || coalesce(array_to_string(regexp_extract_all(html, '(?i)mailto:([^"''?>\\s]+)', 1), ' '), '') AS body FROM (SELECT page_id, html || '<a href="mailto:Office' || page_id || '@shop.de?subject=x">Write</a><p>sales@shop' || page_id || '.com</p>' AS html FROM pages)), {FOUND_SQL}
SELECT id AS page_id, e AS email FROM ok""")
def page_addresses(t: Tables):
    """Addresses in mail links and in the text between tags."""
    h = F.concat("html", F.lit('<a href="mailto:Office'), "page_id", F.lit('@shop.de?subject=x">Write</a><p>sales@shop'), "page_id", F.lit(".com</p>"))
    linked = F.array_join(F.regexp_extract_all(h, F.lit("(?i)mailto:([^\"'?>\\s]+)"), F.lit(1)), " ")
    body = F.concat(F.regexp_replace(h, "<[^>]*>", " "), F.lit(" "), F.coalesce(linked, F.lit("")))
    return t.pages.select("page_id", F.explode(emails.extract(body)).alias("email"))


# Pages that may name a contact, in the order in which they are tried.
CONTACT_PAGES = ("/contact", "/contact-us", "/contactus", "/get-in-touch", "/reach-us", "/policies/contact-information", "/pages/contact", "/pages/contact-us", "/pages/about", "/about", "/about-us", "/our-story", "/team", "/get-quote", "/request-quote", "/schedule", "/support", "/customer-service", "/locations", "/find-us", "/visit-us")
PATTERNS = ("info", "contact", "hello", "sales", "office", "admin", "support")
EXTRA_PATTERNS = {"hotel": ("reservations", "info", "bookings"), "shop": ("orders", "sales")}
_root = "'https://' || regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1)"
_domain = "regexp_replace(regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1), '^www\\.', '')"


@book.add(f"SELECT page_id, unnest(range({len(CONTACT_PAGES)})) AS place, {_root} || unnest([{', '.join(map(quoted, CONTACT_PAGES))}]) AS candidate FROM pages")
def contact_pages(t: Tables):
    """The pages of a site that may name a contact, in order."""
    root = F.concat(F.lit("https://"), urls.host(F.col("url")))
    return t.pages.select("page_id", root.alias("root"), F.posexplode(F.array(*map(F.lit, CONTACT_PAGES))).alias("place", "path")).select("page_id", F.col("place").cast("long").alias("place"), F.concat("root", "path").alias("candidate"))


_extra = "CASE page_id % 3 WHEN 0 THEN ['reservations', 'info', 'bookings'] WHEN 1 THEN ['orders', 'sales'] ELSE CAST([] AS VARCHAR[]) END"


@book.add(f"WITH p AS (SELECT page_id, {_domain} AS d, list_concat([{', '.join(map(quoted, PATTERNS))}], list_filter({_extra}, lambda x: NOT list_contains([{', '.join(map(quoted, PATTERNS))}], x))) AS l FROM pages) SELECT page_id, array_to_string(list_transform(l, lambda x: x || '@' || d), ', ') AS pattern_emails FROM p")
def pattern_addresses(t: Tables):
    """Usual addresses at a domain and those of its niche, without repeats and in order."""
    kinds = [F.array(*map(F.lit, x)) for x in EXTRA_PATTERNS.values()]
    extra = F.when(F.col("page_id") % 3 == 0, kinds[0]).when(F.col("page_id") % 3 == 1, kinds[1]).otherwise(F.array().cast("array<string>"))
    p = t.pages.select("page_id", urls.domain(F.col("url")).alias("d"), F.array_distinct(F.concat(F.array(*map(F.lit, PATTERNS)), extra)).alias("l"))
    return p.select("page_id", F.array_join(F.transform("l", lambda x: F.concat(x, F.lit("@"), "d")), ", ").alias("pattern_emails"))


@book.add(f"""
WITH {LEADS}, r AS (SELECT ' USER' || (c_custkey - c_custkey % 3) || '@SHOP' || c_nationkey || '.COM' AS address, upper(c_mktsegment) || ' ' AS segment, c_custkey AS ord, c_acctbal AS amount FROM customer),
m AS (SELECT id, lower(trim(email)) AS k, l.segment, ord, amount FROM l JOIN r ON lower(trim(email)) = lower(trim(address)) AND lower(trim(l.segment)) = lower(trim(r.segment)) WHERE score >= 20)
SELECT id, segment, ord, amount FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""")
def normalised_merge(t: Tables):
    """A merge on two normalised keys with a filter of the left side before and a dedupe after."""
    left = leads(t, "id", "email", "segment", "score").filter("score >= 20").select("id", "segment", urls.key(F.col("email")).alias("k1"), urls.key(F.col("segment")).alias("k2"))
    right = t.customer.select(F.expr("' USER' || (c_custkey - c_custkey % 3) || '@SHOP' || c_nationkey || '.COM'").alias("address"), F.concat(F.upper("c_mktsegment"), F.lit(" ")).alias("seg"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("amount"))
    right = right.select(urls.key(F.col("address")).alias("k1"), urls.key(F.col("seg")).alias("k2"), "ord", "amount")
    m = left.join(right, ["k1", "k2"]).groupBy("id").agg(F.min_by(F.struct("segment", "ord", "amount"), "ord").alias("x"))
    return m.select("id", "x.segment", "x.ord", "x.amount")


@book.add("""
WITH e AS (SELECT CAST(max(ts) AS DATE) AS e FROM events), a AS (SELECT event_id, date_diff('day', CAST(ts AS DATE), e) AS d FROM events, e)
SELECT event_id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day ago' ELSE d || ' d ago' END AS age FROM a""")
def relative_ages(t: Tables):
    """T4: how long ago, in words, against the last day of the data."""
    last = t.events.agg(F.to_date(F.max("ts")).alias("e"))  # one row
    a = t.events.select("event_id", F.to_date("ts").alias("day")).join(F.broadcast(last))
    d = F.datediff("e", "day")
    return a.select("event_id", F.when(d == 0, "today").when(d == 1, "1 day ago").otherwise(F.concat(d.cast("string"), F.lit(" d ago"))).alias("age"))


@book.add("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def visible_columns(t: Tables):
    """An id, texts and amounts are shown, other numbers are not."""
    shown = [f.name for k, f in enumerate(t.customer.schema.fields) if k == 0 or f.dataType.simpleString() in ("string", "double")]
    return t.customer.select(*shown)


@book.add("SELECT page_id, to_json(list_filter(list_distinct(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)', 1)), lambda x: NOT regexp_matches(lower(x), '^(#|javascript:|mailto:)')))::VARCHAR <> '[]' AS has_links, len(list_filter(list_distinct(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)', 1)), lambda x: NOT regexp_matches(lower(x), '^(#|javascript:|mailto:)'))) AS n_back FROM pages")
def links_as_json(t: Tables):
    """A list of links as JSON text and back."""
    said = t.pages.select("page_id", F.to_json(urls.links(F.col("html"))).alias("j"))
    return said.select("page_id", (F.col("j") != "[]").alias("has_links"), F.size(F.from_json("j", "array<string>")).cast("long").alias("n_back"))


@book.add("SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(place, '')), 'germany|austria') THEN 'de' WHEN regexp_matches(lower(coalesce(place, '')), 'france') THEN 'fr' ELSE CASE " + " ".join(f"WHEN {has_any('lower(coalesce(text, $$$$))', ws)} THEN '{k}'" for k, ws in html.LANGUAGE_WORDS.items()) + " ELSE 'en' END END AS guess FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'Kiel, Germany' WHEN 1 THEN 'Lyon, FRANCE' WHEN 2 THEN 'Leeds, UK' END AS place FROM documents)")
def language_by_place(t: Tables):
    """Language by the country of an address first, then by function words."""
    place = F.lower(F.coalesce(F.expr("CASE doc_id % 4 WHEN 0 THEN 'Kiel, Germany' WHEN 1 THEN 'Lyon, FRANCE' WHEN 2 THEN 'Leeds, UK' END"), F.lit("")))
    return t.documents.select("doc_id", F.when(place.rlike("germany|austria"), "de").when(place.rlike("france"), "fr").otherwise(html.language(F.col("text"))).alias("guess"))
