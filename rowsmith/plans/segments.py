"""Classes, segments and plans of leads by fixed tables of values, reports of a run, and what pages and site maps hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions import cleaners, emails, urls
from rowsmith.operators import dedupe, merge, ranking
from rowsmith.operators.rules import count_if
from rowsmith.plans.contacts import cases
from rowsmith.plans.tables import Book, Tables
from rowsmith.plans.texts import has_any, quoted
from rowsmith.sources.shared import written

book = Book()


def any_of(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def d(x) -> Column:
    return F.lit(x).cast("double")


# --- classes ---------------------------------------------------------------------------------------------

# Categories of companies with their words and priority; the last is for all others.
CATEGORIES = (
    ("HVAC", 8, ("hvac", "heating", "air conditioning", "ac ", "furnace", "cooling", "heat pump")),
    ("Landscaping", 7, ("landscape", "landscaping", "lawn care", "lawn service", "tree service", "lawn mowing", "yard service", "sprinkler", "irrigation")),
    ("Auto_Repair", 6, ("auto repair", "truck repair", "mechanic", "automotive", "car care")),
    ("Other", 5, ()),
)
#: Least population of a tier, population of a city that the list lacks, least reviews of a colour.
TIERS, UNKNOWN_CITY = (("tier_1", 500_000), ("tier_2", 100_000), ("tier_3", 0)), 50_000
COLOURS = (("red", 300), ("orange", 100), ("green", 0))
#: Titles that have a template of their own.
HEADS = ("ceo", "founder", "owner", "president")

LEAD = {
    "id": "c_custkey",
    "category_name": cases("c_custkey", ["'HVAC contractor'", "'Tree Service'", "'Truck Repair Shop'", "'Bakery'", "'Notary'", "'Mechanic'"]),
    "business_type": cases("c_nationkey", ["'Heating'", "'AC unit sales'", "'Lawn Care'", "'Retail'", "''"]),
    "services": cases("(c_custkey + c_nationkey)", ["'Irrigation and more'", "'Car Care'", "'Bread'", "'Heat Pump repair'", "NULL", "'Tax'", "'Wills'"]),
    "city": cases("c_custkey", ["NULL", "'  '", "'City' || c_nationkey", "'City' || c_nationkey", "''"]),
    "reviews": "(c_custkey * 37) % 401",
    "employees": cases("c_custkey", ["NULL", "0", "c_custkey % 12", "11 + c_custkey % 45", "300", "7", "40"]),
    "title": cases("c_custkey", ["'CEO'", "'Sales Manager'", "NULL", "'founder'", "''", "'Owner'", "'President of sales'", "' ceo '"]),
    "seniority": cases("(c_custkey + c_nationkey)", ["'founder'", "'owner'", "'c_suite'", "'vp'", "'manager'", "'director'", "'founder'", "'owner'"]),
}
LEADS = "l AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LEAD.items()) + " FROM customer)"


def leads(t: Tables, *names: str):
    return t.customer.select(*(F.expr(LEAD[n]).alias(n) for n in names))


def steps(value: Column, cuts) -> Column:
    """The name of the first cut that a value reaches."""
    return reduce(lambda rest, cut: F.when(value >= cut[1], cut[0]).otherwise(rest), reversed(cuts[:-1]), F.lit(cuts[-1][0]))


def company_category(*texts: Column) -> Column:
    """(category, priority) by the words of some texts."""
    low = F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in texts)))
    made = lambda c: F.struct(F.lit(c[0]).alias("category"), F.lit(c[1]).alias("priority"))
    return reduce(lambda rest, c: F.when(any_of(low, c[2]), made(c)).otherwise(rest), reversed(CATEGORIES[:-1]), made(CATEGORIES[-1]))


def template(title: Column, city: Column, employees: Column) -> Column:
    """Which template a lead gets, by the first that it has of: a head's title, a city, a number of employees, a title."""
    some = lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    return F.when(F.lower(title).isin(*HEADS), "has_title_ceo_founder").when(some(city), "has_city").when(some(employees), "has_employees_count").when(some(title), "has_title").otherwise("default")


_steps_sql = lambda c, cuts: "CASE " + " ".join(f"WHEN {c} >= {least} THEN '{name}'" for name, least in cuts[:-1]) + f" ELSE '{cuts[-1][0]}' END"


@book.add(f"""
WITH {LEADS}, p AS (SELECT 'City' || n_nationkey AS name, n_nationkey * 40000 AS population FROM nation WHERE n_nationkey % 5 <> 0),
k AS (SELECT *, lower(concat_ws(' ', coalesce(category_name, ''), coalesce(business_type, ''), coalesce(services, ''))) AS low, coalesce(population, {UNKNOWN_CITY}) AS people FROM l LEFT JOIN p ON city = name)
SELECT id, CASE {" ".join(f"WHEN {has_any('low', ws)} THEN '{n}'" for n, _, ws in CATEGORIES[:-1])} ELSE 'Other' END AS category, CASE {" ".join(f"WHEN {has_any('low', ws)} THEN {k}" for _, k, ws in CATEGORIES[:-1])} ELSE 5 END AS priority,
  {_steps_sql("people", TIERS)} AS tier, {_steps_sql("reviews", COLOURS)} AS colour,
  CASE WHEN lower(title) IN ({", ".join(map(quoted, HEADS))}) THEN 'has_title_ceo_founder' WHEN trim(city) <> '' THEN 'has_city' WHEN employees IS NOT NULL THEN 'has_employees_count' WHEN trim(title) <> '' THEN 'has_title' ELSE 'default' END AS template FROM k""")
def lead_categories(t: Tables):
    """Category with priority, tier of the city by its population, colour by reviews, template by what is there."""
    cities = t.nation.filter("n_nationkey % 5 <> 0").select(F.concat(F.lit("City"), "n_nationkey").alias("city"), (F.col("n_nationkey") * 40000).alias("population"))
    k = leads(t, "id", "category_name", "business_type", "services", "city", "reviews", "employees", "title").join(cities, "city", "left")
    c = company_category(F.col("category_name"), F.col("business_type"), F.col("services"))
    people = F.coalesce("population", F.lit(UNKNOWN_CITY))
    return k.select("id", c["category"].alias("category"), c["priority"].alias("priority"), steps(people, TIERS).alias("tier"), steps(F.col("reviews"), COLOURS).alias("colour"), template(F.col("title"), F.col("city"), F.col("employees")).alias("template"))


#: Fixed value: leads of a segment of small companies beyond which it is halved.
HALVE_OVER = 250


@book.add(f"""
WITH {LEADS}, z AS (SELECT id, seniority, CASE WHEN employees IS NULL OR employees = 0 THEN 'Unknown' WHEN employees <= 10 THEN 'Micro' WHEN employees <= 50 THEN 'Small' ELSE 'Enterprise' END AS size FROM l),
g AS (SELECT id, CASE WHEN size = 'Micro' AND seniority IN ('founder', 'owner') THEN 'micro_founders' WHEN size = 'Small' AND seniority = 'founder' THEN 'small_founders' WHEN size = 'Small' AND seniority = 'owner' THEN 'small_owners'
  WHEN size = 'Small' AND seniority IN ('c_suite', 'vp', 'director') THEN 'small_csuite' WHEN size = 'Enterprise' THEN 'vip_enterprise' END AS kind FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS place, count(*) OVER (PARTITION BY kind) AS n FROM g WHERE kind IS NOT NULL)
SELECT id, kind || CASE WHEN kind = 'micro_founders' OR kind IN ('small_founders', 'small_owners') AND n > {HALVE_OVER} THEN CASE WHEN place <= n // 2 THEN '_01' ELSE '_02' END ELSE '' END AS segment FROM n""")
def lead_segments(t: Tables):
    """Segments by size and seniority; founders of micro companies in halves, those and owners of small ones only if there are many."""
    e, s = F.col("employees"), F.col("seniority")
    size = F.when(e.isNull() | (e == 0), "Unknown").when(e <= 10, "Micro").when(e <= 50, "Small").otherwise("Enterprise")
    kind = F.when((size == "Micro") & s.isin("founder", "owner"), "micro_founders").when((size == "Small") & (s == "founder"), "small_founders").when((size == "Small") & (s == "owner"), "small_owners")
    kind = kind.when((size == "Small") & s.isin("c_suite", "vp", "director"), "small_csuite").when(size == "Enterprise", "vip_enterprise")
    g = leads(t, "id", "employees", "seniority").select("id", kind.alias("kind")).filter("kind is not null")
    sizes = g.groupBy("kind").agg(F.count("*").alias("n"))  # a row for each segment
    h = ranking.halves(g, "kind", ["id"]).join(F.broadcast(sizes), "kind")
    halved = (F.col("kind") == "micro_founders") | F.col("kind").isin("small_founders", "small_owners") & (F.col("n") > HALVE_OVER)
    return h.select("id", F.concat("kind", F.when(halved, F.when(F.col("half") == "first", "_01").otherwise("_02")).otherwise("")).alias("segment"))


# --- plans of a run --------------------------------------------------------------------------------------------

# Price of a result, share of results with an e-mail, shares lost to repeats and to filters.
PRICE, WITH_EMAIL, REPEATS, FILTERED = 0.006, 0.67, 0.10, 0.20
#: The cities of each tier and how many results one gives, from the customers of each segment.
_tiers = "t AS (SELECT row_number() OVER (ORDER BY c_mktsegment) AS n, c_mktsegment AS tier, count(DISTINCT c_nationkey) AS cities, CAST(ceil(count(*) / count(DISTINCT c_nationkey)) AS BIGINT) AS each FROM customer GROUP BY c_mktsegment)"
_raw = f"(SELECT count(*) * 0.3 / {WITH_EMAIL} / (1 - {REPEATS}) / (1 - {FILTERED}) FROM customer)"
@book.add(f"""
WITH RECURSIVE {_tiers}, r(n, tier, taken, left_over) AS (SELECT CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT), CAST({_raw} AS DOUBLE)
  UNION ALL SELECT r.n + 1, t.tier, CASE WHEN left_over > 0 THEN least(t.cities, CAST(floor(left_over / t.each) AS BIGINT)) ELSE 0 END, CASE WHEN left_over > 0 THEN left_over - least(t.cities, CAST(floor(left_over / t.each) AS BIGINT)) * t.each ELSE left_over END FROM r JOIN t ON t.n = r.n + 1)
SELECT r.tier, t.cities, t.each, r.taken, r.taken * t.each AS results, round(r.taken * t.each * {PRICE}::DOUBLE, 4) AS cost, round(r.left_over, 4) AS left_over, round(CAST({_raw} AS DOUBLE), 4) AS needed FROM r JOIN t USING (n)""")
def coverage_plan(t: Tables):
    """M4 M5: results needed for a number of e-mails, reckoned back through losses; whole cities taken tier after tier until they are reached."""
    by = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    tiers = by.groupBy(F.col("c_mktsegment").alias("tier")).agg(F.count("c_nationkey").alias("cities"), F.ceil(F.sum("n") / F.count("c_nationkey")).cast("long").alias("each"), F.sum("n").alias("n_all"))
    tiers = written(tiers, "tiers")  # a row for each tier
    return t.spark.sql(
        f"""
        WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY tier) AS n, tier, cities, each, n_all FROM {{tiers}}), need AS (SELECT sum(n_all) * CAST(0.3 AS DOUBLE) / CAST({WITH_EMAIL} AS DOUBLE) / (1 - CAST({REPEATS} AS DOUBLE)) / (1 - CAST({FILTERED} AS DOUBLE)) AS needed FROM t),
        r(n, tier, taken, left_over) AS (SELECT CAST(0 AS INT), CAST('' AS STRING), CAST(0 AS BIGINT), needed FROM need
          UNION ALL SELECT t.n, t.tier, CASE WHEN left_over > 0 THEN least(t.cities, CAST(floor(left_over / t.each) AS BIGINT)) ELSE CAST(0 AS BIGINT) END, CASE WHEN left_over > 0 THEN left_over - least(t.cities, CAST(floor(left_over / t.each) AS BIGINT)) * t.each ELSE left_over END FROM r JOIN t ON t.n = r.n + 1)
        SELECT r.tier, t.cities, t.each, r.taken, r.taken * t.each AS results, round(r.taken * t.each * CAST({PRICE} AS DOUBLE), 4) AS cost, round(r.left_over, 4) AS left_over, round(needed, 4) AS needed FROM r JOIN t ON r.n = t.n CROSS JOIN need""",
        tiers=tiers,
    )


# Price of a thousand tokens read and written.
READ, WRITTEN = 0.00015, 0.0006


@book.add(f"""
WITH w AS (SELECT conv_id, role = 'assistant' AS said, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, coalesce(sum(n) FILTER (WHERE NOT said), 0)::BIGINT AS n_read, coalesce(sum(n) FILTER (WHERE said), 0)::BIGINT AS n_written, round(coalesce(sum(n) FILTER (WHERE NOT said), 0) * {READ}::DOUBLE / 1000 + coalesce(sum(n) FILTER (WHERE said), 0) * {WRITTEN}::DOUBLE / 1000, 9) AS cost FROM w GROUP BY 1""")
def answer_costs(t: Tables):
    """M4: what a conversation costs, by words read and written."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda x: x != ""))
    said = F.col("role") == "assistant"
    g = t.conversations.groupBy("conv_id").agg(F.sum(F.when(said, 0).otherwise(n)).alias("n_read"), F.sum(F.when(said, n).otherwise(0)).alias("n_written"))
    return g.select("conv_id", "n_read", "n_written", F.round(F.col("n_read") * d(READ) / 1000 + F.col("n_written") * d(WRITTEN) / 1000, 9).alias("cost"))


@book.add("""
WITH p AS (SELECT max(ts) - INTERVAL 10 DAY AS mark FROM events), g AS (SELECT event_type, count(*) AS total, count_if(ts <= mark) AS done, epoch(any_value(mark)) - epoch(min(ts)) AS elapsed FROM events CROSS JOIN p GROUP BY 1)
SELECT event_type, total, done, CAST(CASE WHEN done > 0 THEN round((total - done) / (done / floor(elapsed)), 0) END AS BIGINT) AS seconds_left FROM g""")
def time_left(t: Tables):
    """M7: seconds that the rest takes at the speed so far, at a poll ten days before the end."""
    at = t.events.agg((F.max("ts") - F.expr("INTERVAL 10 DAY")).alias("at"))  # one row
    exact = lambda c: c.cast("timestamp").cast("double")
    g = t.events.join(F.broadcast(at)).groupBy("event_type").agg(F.count("*").alias("total"), count_if(F.col("ts") <= F.col("at")).alias("done"), (exact(F.first("at")) - exact(F.min("ts"))).alias("elapsed"))
    return g.select("event_type", "total", "done", F.when(F.col("done") > 0, F.round((F.col("total") - F.col("done")) / (F.col("done") / F.floor("elapsed")), 0)).cast("long").alias("seconds_left"))


@book.add("SELECT event_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) OVER w / (100.0::DOUBLE * count(*) OVER w) AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_averages(t: Tables):
    """The mean of each script's runs up to each run, summed in whole hundredths."""
    e = t.events.select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("hundredths"))
    r = ranking.running(e, "event_type", ["ts", "event_id"], "hundredths")
    return r.select("event_id", "event_type", (F.col("total") / (F.col("rn") * d(100.0))).alias("running"))


@book.add("""
WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, count(*) AS n, count_if(before = 'error') AS n_after_error, count_if(before = 'error' AND event_type <> 'error') AS n_recovered FROM r GROUP BY 1""")
def retry_outcomes(t: Tables):
    """How often what follows a failure of the same user succeeds, by kind."""
    r = ranking.with_previous(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], ["event_type"])
    failed = F.col("previous_event_type") == "error"
    return r.groupBy("event_type").agg(F.count("*").alias("n"), count_if(failed).alias("n_after_error"), count_if(failed & (F.col("event_type") != "error")).alias("n_recovered"))


@book.add("""
WITH g AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2),
u AS (SELECT user_id, sum(n) AS n, sum(n) FILTER (WHERE event_type <> 'error') AS ok, sum(s) AS s, to_json(map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type))) AS by_status FROM g GROUP BY 1)
SELECT user_id, n::BIGINT AS n, coalesce(ok, 0)::BIGINT AS ok, round(coalesce(ok, 0) * 100.0::DOUBLE / n, 2) AS ok_pct, round((n - coalesce(ok, 0)) * 100.0::DOUBLE / n, 2) AS failed_pct, round(s / n, 3) AS mean_value, by_status::VARCHAR AS results_by_status FROM u""")
def run_breakdown(t: Tables):
    """Success and failure rates of each run with its results by status as JSON."""
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    ok = F.coalesce(F.sum(F.when(F.col("event_type") != "error", F.col("n"))), F.lit(0))
    u = g.groupBy("user_id").agg(F.sum("n").alias("n"), ok.alias("ok"), F.sum("s").alias("s"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("results_by_status"))
    pct = lambda c: F.round(c * d(100.0) / F.col("n"), 2)
    return u.select("user_id", "n", "ok", pct(F.col("ok")).alias("ok_pct"), pct(F.col("n") - F.col("ok")).alias("failed_pct"), F.round(F.col("s") / F.col("n"), 3).alias("mean_value"), "results_by_status")


# --- rows kept and left out ---------------------------------------------------------------------------------------


@book.add("""
WITH p AS (SELECT CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN '' ELSE 'pl' || (c_custkey - c_custkey % 5) END AS place, c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS keyword, c_nationkey AS country FROM customer)
SELECT place, min(id) AS id, arg_min(name, id) AS name, count(*) - 1 AS n_removed, string_agg(DISTINCT coalesce(keyword, ''), ', ' ORDER BY coalesce(keyword, '')) AS found_in_keywords, string_agg(DISTINCT country::VARCHAR, ', ' ORDER BY country::VARCHAR) AS found_in_countries FROM p WHERE place <> '' GROUP BY 1""")
def place_provenance(t: Tables):
    """The first row of each place id with the words and countries that any of its rows was found by; rows without an id go."""
    p = t.customer.select(
        F.expr("CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN '' ELSE 'pl' || (c_custkey - c_custkey % 5) END").alias("place"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.expr("CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END").alias("keyword"), F.col("c_nationkey").alias("country"),
    ).filter("place <> ''")
    tracked = dedupe.with_provenance(p, "place", {"keyword": "found_in_keywords", "country": "found_in_countries"})
    first = dedupe.keep_first(p.select("place", "id", "name"), ["place"], ["id"])
    return first.join(tracked, "place").select("place", "id", "name", (F.col("n_rows") - 1).alias("n_removed"), "found_in_keywords", "found_in_countries")


@book.add("""
WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS key FROM customer), s AS (SELECT o_custkey AS key FROM orders WHERE o_totalprice > 150000), n AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS key FROM orders)
SELECT id, 'without nulls' AS part FROM k WHERE key NOT IN (SELECT key FROM s) UNION ALL SELECT id, 'with nulls' FROM k WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT id, 'of none' FROM k WHERE key NOT IN (SELECT key FROM n WHERE false)""")
def not_in_with_nulls(t: Tables):
    """NOT IN as SQL has it: a null key is in no answer, and a null in the list leaves none, unless the list is empty."""
    k = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("key"))
    some = t.orders.filter("o_totalprice > 150000").select(F.col("o_custkey").alias("key"))
    nulls = t.orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("key"))
    part = lambda df, name: merge.not_in(k, df, "key").select("id", F.lit(name).alias("part"))
    return part(some, "without nulls").union(part(nulls, "with nulls")).union(part(nulls.filter("false"), "of none"))


# --- pages and sites -------------------------------------------------------------------------------------------------

#: Addresses as a page shows them; a letter at the end of a domain is never a bar.
SHOWN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
# What no address of a page may have.
NOT_SHOWN = (r"@example\.", r"@test\.", r"@domain\.", r"@email\.", r"@yoursite\.", r"@sentry\.io", r"@2x\.png", r"@3x\.png")
ADDED = cases("page_id", ["' Info@Shop' || page_id || '.de, INFO@shop' || page_id || '.DE'", "' a@b.co|m icon@2x.png x@example.org'", "' no address @ all x@y'", "' me.too+x@sub.dom-ain.museum; z@test.io'"])


@book.add(f"""
WITH p AS (SELECT page_id, html || {ADDED} AS body FROM pages),
e AS (SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(body, {quoted(SHOWN)}), lambda x: lower(x)), lambda x: NOT regexp_matches(x, {quoted("|".join(NOT_SHOWN))}) AND regexp_matches(x, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$')))) AS found FROM p)
SELECT page_id, len(found) AS n_emails, array_to_string(found, ', ') AS emails, CASE WHEN len(found) > 0 THEN 'success' ELSE 'no_emails' END AS status FROM e""")
def page_contact_check(t: Tables):
    """Addresses that a page shows, in lower case, without those that no one reads."""
    body = F.concat("html", F.expr(ADDED))
    found = F.transform(F.regexp_extract_all(body, F.lit(cleaners.classes(SHOWN, True)), F.lit(0)), F.lower)
    valid = F.filter(found, lambda x: ~x.rlike("|".join(NOT_SHOWN)) & x.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"))
    p = t.pages.select("page_id", F.array_sort(F.array_distinct(valid)).alias("found"))
    n = F.size("found")
    return p.select("page_id", n.alias("n_emails"), F.array_join("found", ", ").alias("emails"), F.when(n > 0, "success").otherwise("no_emails").alias("status"))


_host = "regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1)"


@book.add(f"""
WITH p AS (SELECT page_id, {_host} AS host FROM pages), d AS (SELECT DISTINCT host FROM p)
SELECT host, 'https://' || host || '/pages-' || (page_id // 1000) || '.xml' AS sitemap, 'https://' || host || '/p/' || page_id AS location FROM p
UNION ALL SELECT host, 'https://' || host || '/flat.xml', 'https://' || host || '/flat' FROM d""")
def sitemap_urls(t: Tables):
    """From robots files to site maps, from index files to the maps that they name, and to the pages; any name space or none, broken files empty."""
    p = t.pages.select("page_id", urls.host(F.col("url")).alias("host"))
    root = F.concat(F.lit("https://"), "host")
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    # A site's files: robots, an index, a map for each thousand pages, one without a name space, one with a prefix, one broken.
    loc = lambda x: F.concat(F.lit("<url><loc>"), x, F.lit("</loc><priority>0.5</priority></url>"))
    maps = p.groupBy("host", F.floor(F.col("page_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(loc(F.concat(root, F.lit("/p/"), "page_id"))), "").alias("urls"))  # a thousand at most
    name = F.concat(root, F.lit("/pages-"), "part", F.lit(".xml"))
    pages = maps.select(name.alias("url"), F.concat(F.lit(head + '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "urls", F.lit("</urlset>")).alias("body"))
    hosts = maps.groupBy("host").agg(F.array_join(F.collect_list(F.concat(F.lit("<s:sitemap><s:loc>"), name, F.lit("</s:loc></s:sitemap>"))), "").alias("named"))
    flat, broken = F.concat(root, F.lit("/flat.xml")), F.concat(root, F.lit("/broken.xml"))
    more = F.concat(*(x for f in (flat, broken) for x in (F.lit("<s:sitemap><s:loc>"), f, F.lit("</s:loc></s:sitemap>"))))
    index = hosts.select(F.concat(root, F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit(head + '<s:sitemapindex xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">'), "named", more, F.lit("</s:sitemapindex>")).alias("body"))
    rest = hosts.select(F.explode(F.array(F.struct(flat.alias("url"), F.concat(F.lit("<urlset>"), loc(F.concat(root, F.lit("/flat"))), F.lit("</urlset>")).alias("body")), F.struct(broken.alias("url"), F.lit("<urlset><url><loc>x</lo").alias("body")))).alias("f")).select("f.*")
    files = written(pages.union(index).union(rest), "files")
    robots = hosts.select("host", F.concat(F.lit("User-agent: *\nSITEMAP: "), root, F.lit("/sitemap.xml \nSitemap: x")).alias("text"))

    def read(named):
        """What the files of (host, sitemap) hold: maps that they name, and pages."""
        held = named.join(files, F.col("sitemap") == F.col("url")).select("host", "sitemap", urls.sitemap(F.col("body")).alias("m"))
        return written(held.select("host", "sitemap", "m.*"), "held")

    layer, found = robots.select("host", F.get(urls.robots_sitemaps(F.col("text")), F.lit(0)).alias("sitemap")), None
    for _ in range(2):  # an index, and the maps that it names
        held = read(layer)
        here = held.select("host", "sitemap", F.explode("pages").alias("location"))
        found = here if found is None else found.union(here)
        layer = held.select("host", F.explode("maps").alias("sitemap"))
    return found


@book.add(f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE url END AS website, html || {ADDED} AS body FROM pages),
e AS (SELECT page_id, website, CASE WHEN website = '' THEN [] ELSE list_sort(list_distinct(list_transform(regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), lambda x: lower(x)))) END AS found FROM p)
SELECT page_id, unnest(CASE WHEN len(found) = 0 THEN [''] ELSE found END) AS email, CASE WHEN len(found) > 0 THEN 'success' ELSE 'failed' END AS scrape_status, CASE WHEN website = '' THEN 'No website provided' WHEN len(found) = 0 THEN 'no_email_found_static' ELSE '' END AS error_message FROM e""")
def page_rows(t: Tables):
    """D-U4: a table function, called for each row through a lateral join: a row for each address of a page, or one that says why there is none."""
    p = t.pages.select("page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("url")).alias("website"), F.concat("html", F.expr(ADDED)).alias("body"))
    return p.lateralJoin(emails.PageRows(F.col("website").outer(), F.col("body").outer())).select("page_id", "email", "scrape_status", "error_message")


_dynamic = ("react", "angular", "data-react")
_percent = lambda n: f"printf('%.2f%%', {n} * 100.0::DOUBLE / greatest(total, 1))"


@book.add(f"""
WITH e AS (SELECT page_id, {has_any("lower(html)", _dynamic)} AS dynamic, len(list_distinct(regexp_extract_all(lower(html), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'))) AS n FROM pages),
g AS (SELECT count(*) AS total, count_if(n > 0) AS ok, coalesce(sum(n), 0)::BIGINT AS emails, count_if(n = 0 AND NOT dynamic) AS st, count_if(n = 0 AND dynamic) AS dy, count_if(dynamic) AS sites_dynamic FROM e)
SELECT to_json({{'summary': {{'total_sites': total, 'success_rate': {_percent("ok")}}}, 'results': {{'success': {{'count': ok, 'percentage': {_percent("ok")}, 'total_emails': emails}},
  'failed': {{'total': total - ok, 'static_no_email': {{'count': st, 'percentage': {_percent("st")}}}, 'dynamic_no_email': {{'count': dy, 'percentage': {_percent("dy")}}}}}}}, 'site_types': {{'static': total - sites_dynamic, 'dynamic': sites_dynamic}}}})::VARCHAR AS report FROM g""")
def scrape_report(t: Tables):
    """The nested report of a run over pages: a summary, successes, failures by kind and kinds of sites, with shares."""
    low = F.lower("html")
    e = t.pages.select(any_of(low, _dynamic).alias("dynamic"), F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0)))).alias("n"))
    none = F.col("n") == 0
    g = e.agg(F.count("*").alias("total"), count_if(~none).alias("ok"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("emails"), count_if(none & ~F.col("dynamic")).alias("st"), count_if(none & F.col("dynamic")).alias("dy"), count_if("dynamic").alias("sites"))
    share = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f%%", F.col(c) * d(100.0) / F.greatest("total", F.lit(1)))).alias("percentage")
    part = lambda c, name: F.struct(F.col(c).alias("count"), share(c)).alias(name)
    failed = F.struct((F.col("total") - F.col("ok")).alias("total"), part("st", "static_no_email"), part("dy", "dynamic_no_email"))
    success = F.struct(F.col("ok").alias("count"), share("ok"), F.col("emails").alias("total_emails"))
    report = F.struct(F.struct(F.col("total").alias("total_sites"), share("ok").alias("success_rate")).alias("summary"), F.struct(success.alias("success"), failed.alias("failed")).alias("results"), F.struct((F.col("total") - F.col("sites")).alias("static"), F.col("sites").alias("dynamic")).alias("site_types"))
    return g.select(F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


WEB = cases("c_custkey", ["'https://www.Shop' || c_custkey || '.com/a'", "'shop.www.de'", "'HTTP://blog.www.shop' || c_nationkey || '.com:8080/x?y#z'", "'www.shop.de/www.html'", "''", "NULL", "' https://shop.com '"])


@book.add(f"""
WITH w AS (SELECT c_custkey, {WEB} AS site FROM customer), h AS (SELECT c_custkey, site, lower(trim(site)) AS low FROM w), s AS (SELECT *, CASE WHEN starts_with(low, 'http://') OR starts_with(low, 'https://') THEN low ELSE 'https://' || low END AS full_url FROM h)
SELECT c_custkey, CASE WHEN low <> '' THEN replace(regexp_extract(full_url, '^https?://([^/:?#]*)', 1), 'www.', '') END AS domain FROM s""")
def bare_domains(t: Tables):
    """L1: the bare domain of an address: a scheme added where there is none, "www." dropped wherever it stands, no port, no path."""
    return t.customer.select("c_custkey", urls.bare_domain(F.expr(WEB)).alias("domain"))


@book.add("""
SELECT user_id, count_if(event_type <> 'error') AS successful, count_if(event_type <> 'error' AND value > 50) AS covered, round(count_if(event_type <> 'error' AND value > 50) * 100.0::DOUBLE / greatest(count_if(event_type <> 'error'), 1), 2) AS coverage_pct,
  CASE WHEN count_if(event_type = 'signup') > 0 THEN round(count_if(event_type = 'signup' AND value > 50) * 100.0::DOUBLE / count_if(event_type = 'signup'), 2) ELSE 0 END AS signup_pct FROM events GROUP BY 1""")
def coverage_of_successes(t: Tables):
    """The share of successes that have something, by either guard against none: a divisor of one, or zero."""
    ok, some, signup = F.col("event_type") != "error", F.col("value") > 50, F.col("event_type") == "signup"
    n, m, s = count_if(ok), count_if(ok & some), count_if(signup)
    share = F.round(m * d(100.0) / F.greatest(n, F.lit(1)), 2)
    return t.events.groupBy("user_id").agg(n.alias("successful"), m.alias("covered"), share.alias("coverage_pct"), F.when(s > 0, F.round(count_if(signup & some) * d(100.0) / s, 2)).otherwise(d(0.0)).alias("signup_pct"))
