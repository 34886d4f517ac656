"""Leads: lookups on normalised keys, upserts, deduplication over several keys, filters, scores, reports.

Leads are made of the customers, with missing, blank, repeated and badly spelt e-mails, phones and websites; the
expressions are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.functions import emails, html, urls
from rowsmith.operators import dedupe, reshape
from rowsmith.operators.rules import count_if
from rowsmith.plans.contacts import cases
from rowsmith.plans.tables import Book, Tables
from rowsmith.plans.texts import has_any, quoted
from rowsmith.sources.shared import written

book = Book()

_h = "((c_custkey * 7919) % 1000003)"
LEAD = {
    "id": "c_custkey",
    "email": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ' ' ELSE ' User' || (c_custkey - c_custkey % 3) || '@Shop' || c_nationkey || '.com ' END",
    "phone": f"CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '555-' || ({_h} - {_h} % 3) END",
    "website": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'https://www.Shop' || (c_custkey - c_custkey % 4) || '.com/' END",
    "name": "CASE WHEN c_custkey % 11 = 0 THEN 'https://www.shop' || (c_custkey - c_custkey % 4) || '.com/' ELSE c_name END",
    "result": cases("c_custkey", ["'deliverable'", "'unknown'", "'risky'", "NULL", "'undeliverable'"]),
    "score": "c_custkey % 100",
    "size": "c_custkey % 700",
    "segment": "c_mktsegment",
    "balance": "c_acctbal",
}
LEADS = "l AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LEAD.items()) + " FROM customer)"


def leads(t: Tables, *names: str):
    return t.customer.select(*(F.expr(LEAD[n]).alias(n) for n in names))


def d(x):
    return F.lit(x).cast("double")


# --- deduplication --------------------------------------------------------------------------------------

_greedy = """
o AS (SELECT id, list_filter([{keys}], lambda x: x IS NOT NULL) AS keys, row_number() OVER (ORDER BY id) AS n FROM l),
step(n, seen, id) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT)
  UNION ALL SELECT o.n, CASE WHEN list_has_any(s.seen, o.keys) THEN s.seen ELSE list_concat(s.seen, o.keys) END, CASE WHEN list_has_any(s.seen, o.keys) THEN NULL ELSE o.id END FROM step s JOIN o ON o.n = s.n + 1)
SELECT id FROM step WHERE id IS NOT NULL"""


@book.add(f"WITH RECURSIVE {LEADS}, {_greedy.format(keys="'p' || phone, 'w' || website")}")
def dedupe_two_keys(t: Tables):
    """One pass over rows that drops what shares a phone or a website with an earlier kept row."""
    return dedupe.in_order(leads(t, "id", "phone", "website"), ["phone", "website"], "id").select("id")


@book.add(f"WITH RECURSIVE {LEADS}, {_greedy.format(keys="'p' || phone, 'w' || website, 'e' || nullif(lower(trim(email)), '')")}")
def dedupe_three_keys(t: Tables):
    """As with two keys, and the e-mail as a third."""
    r = leads(t, "id", "phone", "website", "email").withColumn("email", urls.key(F.col("email")))
    return dedupe.in_order(r, ["phone", "website", "email"], "id").select("id")


@book.add(f"WITH {LEADS}, k AS (SELECT lower(trim(email)) AS key, min(id) AS id FROM l WHERE trim(email) <> '' GROUP BY 1) SELECT id, key FROM k")
def dedupe_email(t: Tables):
    """The first row of each e-mail in lower case; rows without one go."""
    return leads(t, "id", "email").select("id", urls.key(F.col("email")).alias("key")).filter("key is not null").groupBy("key").agg(F.min("id").alias("id"))


@book.add(f"WITH {LEADS} SELECT min(id) AS id, phone, arg_min(name, id) AS name FROM l WHERE phone IS NOT NULL GROUP BY phone")
def dedupe_nonnull(t: Tables):
    """The first row of each key; rows with a null key go."""
    return dedupe.keep_first(leads(t, "id", "phone", "name"), ["phone"], ["id"], drop_null_keys=True)


@book.add(f"WITH {LEADS} SELECT count(*) AS n_rows, count(*) - count(DISTINCT coalesce(phone, '')) AS n_removed, round((count(*) - count(DISTINCT coalesce(phone, ''))) * 100.0::DOUBLE / greatest(count(*), 1), 4) AS rate FROM l")
def dedupe_rate(t: Tables):
    """Rows that deduplication by phone removes, and their share."""
    # Two steps: the distinct count is a count of groups, not an expansion.
    g = leads(t, "phone").groupBy(F.coalesce("phone", F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    g = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("kept"))
    return g.select("n_rows", (F.col("n_rows") - F.col("kept")).alias("n_removed"), F.round((F.col("n_rows") - F.col("kept")) * d(100.0) / F.greatest("n_rows", F.lit(1)), 4).alias("rate"))


@book.add(f"WITH {LEADS} SELECT phone, arg_min(name, id) AS name, string_agg(segment, ', ' ORDER BY id) AS segments FROM l WHERE phone IS NOT NULL GROUP BY phone")
def provenance_in_order(t: Tables):
    """The first row of each key with where each of its rows came from, in order of arrival, repeats kept."""
    g = leads(t, "id", "phone", "name", "segment").filter("phone is not null").groupBy("phone")
    g = g.agg(F.min_by("name", "id").alias("name"), F.array_sort(F.collect_list(F.struct("id", "segment"))).alias("s"))
    return g.select("phone", "name", F.array_join(F.transform("s", lambda x: x["segment"]), ", ").alias("segments"))


_sources = """
u AS (SELECT lower(trim(email)) AS key, 1 AS rank, id, result FROM l WHERE result = 'deliverable' UNION ALL SELECT lower(trim(email)), 2, id, result FROM l WHERE phone IS NOT NULL
  UNION ALL SELECT lower(trim(email)), 3, id, NULL FROM l WHERE website IS NOT NULL UNION ALL SELECT lower(trim(email)), 4, id, result FROM l)"""


def _by_source(t: Tables):
    r = leads(t, "id", "email", "phone", "website", "result").withColumn("key", urls.key(F.col("email")))
    rank = F.explode(F.array_compact(F.array(F.when(F.col("result") == "deliverable", 1), F.when(F.col("phone").isNotNull(), 2), F.when(F.col("website").isNotNull(), 3), F.lit(4))))
    r = r.select("id", "key", "result", rank.alias("rank")).filter("key is not null")
    return r.withColumn("result", F.when(F.col("rank") != 3, F.col("result")))


@book.add(f"WITH {LEADS}, {_sources} SELECT key AS email, arg_min(rank, (rank, id)) AS source, coalesce(max(CASE WHEN n = 1 THEN result END), 'no_validation') AS status FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, id) AS n FROM u WHERE key <> '') GROUP BY 1")
def first_source_wins(t: Tables):
    """Of four lists, the first that has an address decides on its status; none is no_validation."""
    g = _by_source(t).groupBy("key").agg(F.min_by(F.struct("rank", "result"), F.struct("rank", "id")).alias("x"))
    return g.select(F.col("key").alias("email"), F.col("x.rank").alias("source"), F.coalesce("x.result", F.lit("no_validation")).alias("status"))


@book.add(f"WITH {LEADS}, {_sources}, f AS (SELECT key, coalesce(result, 'no_validation') AS status FROM u WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, id) = 1) SELECT status, count(*) AS n, sum(count(*) FILTER (WHERE status <> 'undeliverable')) OVER ()::BIGINT AS usable FROM f GROUP BY 1")
def source_status_breakdown(t: Tables):
    """Addresses by status over the union of lists, the default bucket included, and how many are usable."""
    by = first_source_wins(t).groupBy("status").agg(F.count("*").alias("n"))
    usable = by.agg(F.sum(F.when(F.col("status") != "undeliverable", F.col("n")).otherwise(0)).alias("usable"))  # one row
    return by.join(F.broadcast(usable))


@book.add("SELECT c_custkey, c_nationkey AS state FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey - c_custkey % 3 ORDER BY c_nationkey, c_custkey) = 1")
def first_file_wins(t: Tables):
    """Of rows in several files, the one in the first file."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("state"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("k"))
    return dedupe.keep_first(c, ["k"], ["state", "c_custkey"]).select("c_custkey", "state")


# --- lookups and upserts ---------------------------------------------------------------------------------

CHECKS = """
checks AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'USER' ELSE ' user' END || (c_custkey - c_custkey % 3) || '@shop' || c_nationkey || '.COM' AS address, c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'risky' ELSE 'undeliverable' END AS status FROM customer)"""


def _checks(t: Tables):
    return t.customer.select(
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'USER' ELSE ' user' END || (c_custkey - c_custkey % 3) || '@shop' || c_nationkey || '.COM'").alias("address"),
        F.col("c_custkey").alias("ord"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'risky' ELSE 'undeliverable' END").alias("status"),
    )


@book.add(f"WITH {LEADS}, {CHECKS} SELECT id, status, ord FROM l LEFT JOIN checks ON lower(trim(email)) = lower(trim(address)) AND trim(email) <> ''")
def validation_lookup(t: Tables):
    """Validation joined on the e-mail in lower case, blanks and nulls matching nothing; each match is a row."""
    c = _checks(t).select(urls.key(F.col("address")).alias("key"), "status", "ord")
    return leads(t, "id", "email").withColumn("key", urls.key(F.col("email"))).join(c, "key", "left").select("id", "status", "ord")


@book.add(f"WITH {LEADS}, {CHECKS}, f AS (SELECT lower(trim(address)) AS key, arg_min(status, ord) AS status FROM checks GROUP BY 1) SELECT id, coalesce(f.status, 'no_email') AS status FROM l LEFT JOIN f ON lower(trim(email)) = key")
def verification_attach(t: Tables):
    """The first validation of each address; rows without one are no_email."""
    f = _checks(t).groupBy(urls.key(F.col("address")).alias("key")).agg(F.min_by("status", "ord").alias("status"))
    r = leads(t, "id", "email").select("id", urls.key(F.col("email")).alias("key")).join(f, "key", "left")
    return r.select("id", F.coalesce("status", F.lit("no_email")).alias("status"))


_sites = "sites AS (SELECT 'HTTPS://www.shop' || (c_custkey - c_custkey % 8) || '.com' AS site, 'City ' || c_nationkey AS city, c_custkey AS ord FROM customer)"
_site_key = lambda c: f"regexp_replace(lower(trim({c})), '/+$', '')"


@book.add(f"WITH {LEADS}, {_sites}, f AS (SELECT {_site_key('site')} AS key, arg_max(city, ord) AS city FROM sites GROUP BY 1) SELECT id, city, coalesce(city, name) AS label FROM l LEFT JOIN f ON {_site_key('website')} = key")
def website_backfill(t: Tables):
    """Attributes by website without slashes at its end, the last of repeated ones, and a fall-back."""
    site_key = lambda c: F.regexp_replace(F.lower(emails.strip(c)), "/+$", "")
    sites = t.customer.select(F.expr("'HTTPS://www.shop' || (c_custkey - c_custkey % 8) || '.com'").alias("site"), F.concat(F.lit("City "), "c_nationkey").alias("city"), F.col("c_custkey").alias("ord"))
    f = sites.groupBy(site_key(F.col("site")).alias("key")).agg(F.max_by("city", "ord").alias("city"))
    r = leads(t, "id", "website", "name").withColumn("key", site_key(F.col("website"))).join(f, "key", "left")
    return r.select("id", "city", F.coalesce("city", "name").alias("label"))


_listed = "listed AS (SELECT c_custkey AS ord, 'user' || (c_custkey - c_custkey % 3) || '@shop' || c_nationkey || '.com, Info' || c_custkey || '@x.org ,none' AS cell, 'place' || c_custkey AS place_id, c_name AS company FROM customer)"


@book.add(f"""
WITH {LEADS}, {_listed}, e AS (SELECT ord, place_id, company, lower(trim(unnest(string_split(cell, ',')))) AS key FROM listed), f AS (SELECT key, arg_max(place_id, ord) AS place_id, arg_max(company, ord) AS company FROM e WHERE contains(key, '@') GROUP BY 1)
SELECT id, f.place_id, f.company, 'https://maps.example/?q=place_id:' || f.place_id AS link, CASE WHEN f.place_id IS NULL THEN 'not_matched' ELSE 'places' END AS data_source FROM l LEFT JOIN f ON lower(trim(email)) = key""")
def explode_then_lookup(t: Tables):
    """Cells of addresses exploded, the last row of each address, its fields attached and tagged."""
    rows = t.customer.select(F.col("c_custkey").alias("ord"), F.expr("'user' || (c_custkey - c_custkey % 3) || '@shop' || c_nationkey || '.com, Info' || c_custkey || '@x.org ,none'").alias("cell"), F.concat(F.lit("place"), "c_custkey").alias("place_id"), F.col("c_name").alias("company"))
    each = rows.select("ord", "place_id", "company", F.explode(F.transform(F.split("cell", ","), lambda x: F.lower(F.trim(x)))).alias("key")).filter(F.col("key").contains("@"))
    f = each.groupBy("key").agg(F.max_by(F.struct("place_id", "company"), "ord").alias("x"))
    r = leads(t, "id", "email").select("id", urls.key(F.col("email")).alias("key")).join(f, "key", "left")
    return r.select("id", "x.place_id", "x.company", F.concat(F.lit("https://maps.example/?q=place_id:"), "x.place_id").alias("link"), F.when(F.col("x").isNull(), "not_matched").otherwise("places").alias("data_source"))


OLD = "old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'u' || c_custkey || '@x.com' END AS email, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'p' || c_custkey END AS phone, c_name AS label FROM customer)"
NEW = "new AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'u' || (c_custkey + 2) || '@x.com' END AS email, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'p' || (c_custkey * 2) END AS phone, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name || ' of ' || c_mktsegment END AS label, 'k' || (c_custkey % 3) AS field, c_mktsegment AS value FROM customer)"


@book.add(f"""
WITH {OLD}, {NEW},
m AS (SELECT new.*, coalesce(a.id, b.id) AS hit FROM new LEFT JOIN old a ON a.email = new.email LEFT JOIN old b ON b.phone = new.phone),
k AS (SELECT *, CASE WHEN hit IS NULL THEN 'new' || ord ELSE 'old' || hit END AS key FROM m),
every AS (SELECT 'old' || id AS key, CAST(-1 AS BIGINT) AS ord, email, phone, label, NULL AS field, NULL AS value FROM old UNION ALL SELECT key, ord, email, phone, label, field, value FROM k),
texts AS (SELECT key, arg_max(email, (length(email), -ord)) AS email, arg_max(phone, (length(phone), -ord)) AS phone, arg_max(label, (length(label), -ord)) AS label, count_if(ord >= 0) AS n_merged FROM every GROUP BY 1),
f AS (SELECT key, field, arg_max(value, ord) AS value FROM every WHERE field IS NOT NULL GROUP BY 1, 2),
x AS (SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS extra FROM f GROUP BY 1)
SELECT key, email, phone, label, n_merged, coalesce(extra, '') AS extra, CASE WHEN n_merged > 0 AND starts_with(key, 'old') THEN 'base,import' WHEN n_merged > 0 THEN 'import' ELSE 'base' END AS sources FROM texts LEFT JOIN x USING (key)""")
def upsert_two_keys(t: Tables):
    """A row of a batch whose rows don't meet merges into the one with its e-mail, else with its phone, or is new; longer texts win, maps unite, sources add up."""
    base = t.customer.select("c_custkey", *(F.expr(e).alias(n) for n, e in {"email": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'u' || c_custkey || '@x.com' END", "phone": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'p' || c_custkey END"}.items()), F.col("c_name").alias("label")).withColumnRenamed("c_custkey", "id")
    new = t.customer.select(
        F.col("c_custkey").alias("ord"),
        *(F.expr(e).alias(n) for n, e in {"email": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'u' || (c_custkey + 2) || '@x.com' END", "phone": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'p' || (c_custkey * 2) END", "label": "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name || ' of ' || c_mktsegment END", "field": "'k' || (c_custkey % 3)", "value": "c_mktsegment"}.items()),
    )
    by_email = new.join(base.select("email", F.col("id").alias("a")), "email", "left")
    hit = by_email.join(base.select("phone", F.col("id").alias("b")), "phone", "left").withColumn("hit", F.coalesce("a", "b"))
    keyed = hit.select(F.when(F.col("hit").isNull(), F.concat(F.lit("new"), "ord")).otherwise(F.concat(F.lit("old"), "hit")).alias("key"), "ord", "email", "phone", "label", "field", "value")
    every = base.select(F.concat(F.lit("old"), "id").alias("key"), F.lit(-1).cast("long").alias("ord"), "email", "phone", "label").unionByName(keyed, allowMissingColumns=True)
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col("ord")))).alias(c)
    texts = every.groupBy("key").agg(longest("email"), longest("phone"), longest("label"), F.count_if(F.col("ord") >= 0).alias("n_merged"))
    fields = every.filter("field is not null").groupBy("key", "field").agg(F.max_by("value", "ord").alias("value"))
    extra = fields.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit("="), "value"))), ",").alias("extra"))
    some = F.col("n_merged") > 0
    return texts.join(extra, "key", "left").select("key", "email", "phone", "label", "n_merged", F.coalesce("extra", F.lit("")).alias("extra"), F.when(some & F.col("key").startswith("old"), "base,import").when(some, "import").otherwise("base").alias("sources"))


# --- filters ---------------------------------------------------------------------------------------------

_blank = lambda c: f"({c} IS NULL OR trim({c}) = '')"


@book.add(f"""
WITH {LEADS} SELECT id, website IS NOT NULL AND {_blank('email')} AS site_only, lower(coalesce(name, '')) = lower(coalesce(website, '')) OR NOT contains(coalesce(email, ''), '@') OR length(trim(coalesce(email, ''))) <= 5 AS garbage,
  ({_blank('email')} OR coalesce(result, '') IN ('undeliverable', 'unknown')) AND phone IS NOT NULL AS phone_only, coalesce(result = 'deliverable' AND score >= 60, false) AND size BETWEEN 10 AND 200 AS quality FROM l""")
def lead_predicates(t: Tables):
    """A website without e-mail, garbage rows, rows to phone only, and verified rows of a good size."""
    r = leads(t, "id", "email", "phone", "website", "name", "result", "score", "size")
    e = F.trim(F.coalesce("email", F.lit("")))
    garbage = (F.lower(F.coalesce("name", F.lit(""))) == F.lower(F.coalesce("website", F.lit("")))) | ~F.contains(e, F.lit("@")) | (F.length(e) <= 5)
    phone_only = ((e == "") | F.coalesce("result", F.lit("")).isin("undeliverable", "unknown")) & F.col("phone").isNotNull()
    quality = F.coalesce((F.col("result") == "deliverable") & (F.col("score") >= 60), F.lit(False)) & F.col("size").between(10, 200)
    return r.select("id", (F.col("website").isNotNull() & (e == "")).alias("site_only"), garbage.alias("garbage"), phone_only.alias("phone_only"), quality.alias("quality"))


@book.add(f"WITH {LEADS} SELECT id FROM l WHERE {_blank('email')} ORDER BY id LIMIT 40 OFFSET 10")
def pending_window(t: Tables):
    """Rows 10 to 50 of those whose target is still blank."""
    return leads(t, "id", "email").filter("email is null or trim(email) = ''").select("id").orderBy("id").offset(10).limit(40)


@book.add(f"WITH {LEADS} SELECT id, segment FROM l WHERE segment = 'BUILDING' ORDER BY id DESC LIMIT 25")
def batch_page(t: Tables):
    """A page of one batch, the newest first."""
    return leads(t, "id", "segment").filter("segment = 'BUILDING'").orderBy(F.desc("id")).limit(25)


PRESETS = {"today": 0, "7d": 7, "14d": 14, "30d": 30, "90d": 90, "1y": 365}


@book.add("WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) AS e FROM orders), p AS (SELECT unnest([" + ", ".join(map(quoted, PRESETS)) + "]) AS preset, unnest([" + ", ".join(map(str, PRESETS.values())) + "]) AS days) SELECT preset, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM p CROSS JOIN e LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN e - CAST(days AS INTEGER) AND e GROUP BY 1")
def date_range_presets(t: Tables):
    """counts of every preset of dates before the last one, in one pass over the year before."""
    o = t.orders.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("last"))  # one row
    o = o.join(F.broadcast(last)).withColumn("age", F.datediff("last", "day"))
    sums = o.agg(*(x for p, n in PRESETS.items() for x in (F.count_if(F.col("age") <= n).alias(f"n{p}"), F.sum(F.when(F.col("age") <= n, F.col("o_totalprice"))).alias(f"t{p}"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(p).alias("preset"), F.col(f"n{p}").alias("n"), F.round(F.coalesce(F.col(f"t{p}"), d(0.0)), 2).alias("total")) for p in PRESETS))).alias("x")).select("x.*")


# --- classes and scores -----------------------------------------------------------------------------------

# Categories in order of priority, their words, and what they must not have.
CATEGORIES = (
    ("museum", ("museum", "memorial", "monument", "historic site", "exhibition", "gallery"), (), (), ("shop", "store")),
    ("military_shop", ("shop", "store", "surplus", "collectibles", "depot", "supply"), (), ("buy", "shop", "store", "merchandise", "gift shop"), ()),
    ("historical_society", ("historical society", "history center", "preservation", "heritage", "historic house"), (), (), ("museum",)),
    ("reenactment_group", (), ("reenactment", "living history"), (), ("museum", "historical society", "library", "memorial", "monument", "archive")),
    ("community_organization", ("library", "park", "chamber of commerce", "cultural center", "foundation", "association"), (), (), ()),
)
ORGANISATION = {
    "id": "c_custkey",
    "name": cases("c_custkey", ["'War Museum ' || c_custkey", "'Museum Shop'", "'Surplus Depot'", "'County Historical Society'", "'Old Group'", "'Public Library'", "'City Park'", "'Army Collectibles'", "'Chamber of Commerce'", "'Heritage House'", "'Nothing Else'"]),
    "source": cases("c_custkey", ["'wwii museums'", "'living_history groups'", "'cold war'", "'reenactment'", "'soviet clubs'"]),
    "content": cases("c_custkey", ["'Buy our merchandise'", "'Stories of the civil war'", "'The revolutionary years'", "''"]),
}
ORGS = "g AS (SELECT " + ", ".join(f"{e} AS {n}" if n == "id" else f"lower({e}) AS {n}" for n, e in ORGANISATION.items()) + " FROM customer)"


def _any(c: str, words):
    return reduce(lambda a, w: a | F.col(c).contains(w), words, F.lit(False))


_rules_sql, _rules = [], []
for _name, _in_name, _in_source, _in_content, _not in CATEGORIES:
    for _where, _ws, _sure in (("name", _in_name, "high"), ("source", _in_source, "medium"), ("content", _in_content, "medium")):
        if _ws:
            _rules_sql.append((f"{has_any(_where, _ws)}" + (f" AND NOT {has_any('name', _not)}" if _not else ""), f"{_name}/{_sure}"))
            _rules.append((_where, _ws, _not, f"{_name}/{_sure}"))
_category_sql = "CASE " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in _rules_sql) + " ELSE 'community_organization/low' END"
_detail_sql = """CASE category
  WHEN 'museum' THEN CASE WHEN contains(source, 'wwii') OR contains(source, 'world war 2') THEN 'wwii exhibits' WHEN contains(source, 'cold war') OR contains(source, 'eastern front') THEN 'cold war pieces' WHEN contains(source, 'soviet') OR contains(source, 'russian') THEN 'soviet military history' WHEN contains(source, 'red army') THEN 'red army artifacts' ELSE 'military exhibits' END
  WHEN 'military_shop' THEN CASE WHEN contains(name, 'surplus') THEN 'military surplus' WHEN contains(name, 'collectible') THEN 'military collectibles' ELSE 'military memorabilia' END
  WHEN 'historical_society' THEN CASE WHEN contains(content, 'revolutionary') OR contains(name, 'revolution') THEN 'revolutionary war history' WHEN contains(content, 'civil war') OR contains(name, 'civil war') THEN 'civil war history' WHEN contains(source, 'wwii') OR contains(source, 'world war') THEN 'wwii local history' ELSE 'local history' END
  WHEN 'reenactment_group' THEN CASE WHEN source <> '' THEN replace(source, '_', ' ') ELSE 'historical reenactment' END
  WHEN 'community_organization' THEN CASE WHEN contains(name, 'library') THEN 'library programs' WHEN contains(name, 'park') THEN 'park programs' WHEN contains(name, 'chamber') THEN 'local business' ELSE 'community programs' END
  ELSE 'history programs' END"""


@book.add(f"WITH {ORGS}, c AS (SELECT *, {_category_sql} AS k FROM g), s AS (SELECT *, split_part(k, '/', 1) AS category, split_part(k, '/', 2) AS confidence FROM c) SELECT id, category, confidence, {_detail_sql} AS detail FROM s")
def categorize_organisations(t: Tables):
    """The first category whose words a name, source or content has, how sure that is, and a detail of it."""
    g = t.customer.select(*(F.expr(e).alias(n) if n == "id" else F.lower(F.expr(e)).alias(n) for n, e in ORGANISATION.items()))
    found = F.lit("community_organization/low")
    for where, ws, no, label in reversed(_rules):
        found = F.when(_any(where, ws) & ~_any("name", no), label).otherwise(found)
    s = g.withColumn("k", F.split(found, "/")).select("*", F.col("k")[0].alias("category"), F.col("k")[1].alias("confidence"))
    has = lambda c, *ws: _any(c, ws)
    detail = (
        F.when(F.col("category") == "museum", F.when(has("source", "wwii", "world war 2"), "wwii exhibits").when(has("source", "cold war", "eastern front"), "cold war pieces").when(has("source", "soviet", "russian"), "soviet military history").when(has("source", "red army"), "red army artifacts").otherwise("military exhibits"))
        .when(F.col("category") == "military_shop", F.when(has("name", "surplus"), "military surplus").when(has("name", "collectible"), "military collectibles").otherwise("military memorabilia"))
        .when(F.col("category") == "historical_society", F.when(has("content", "revolutionary") | has("name", "revolution"), "revolutionary war history").when(has("content", "civil war") | has("name", "civil war"), "civil war history").when(has("source", "wwii", "world war"), "wwii local history").otherwise("local history"))
        .when(F.col("category") == "reenactment_group", F.when(F.col("source") != "", F.replace("source", F.lit("_"), F.lit(" "))).otherwise("historical reenactment"))
        .otherwise(F.when(has("name", "library"), "library programs").when(has("name", "park"), "park programs").when(has("name", "chamber"), "local business").otherwise("community programs"))
    )
    return s.select("id", "category", "confidence", detail.alias("detail"))


# Niches by what a keyword contains.
NICHES = {"hvac": "hvac", "plumb": "plumbers", "electric": "electricians", "locksmith": "locksmiths", "towing": "towing", "tow service": "towing", "garage": "garage_door", "door": "garage_door"}
KEYWORD = cases("c_custkey", ["'HVAC repair'", "'Emergency Plumber'", "'electrician near me'", "'24h Locksmith'", "'tow service'", "'Door fitting'", "'Dog Groomer ' || c_nationkey"])
INDUSTRY = cases("c_custkey", ["'Marketing & Advertising'", "'Information Technology'", "'Software'", "'Banking'", "NULL"])


@book.add(f"""
WITH k AS (SELECT c_custkey AS id, lower({KEYWORD}) AS k, {INDUSTRY} AS industry, c_custkey % 700 AS size, c_custkey * 1000 AS people, c_custkey % 4 AS rank FROM customer)
SELECT id, CASE {" ".join(f"WHEN contains(k, '{w}') THEN '{n}'" for w, n in NICHES.items())} ELSE replace(k, ' ', '_') END AS niche,
  CASE WHEN contains(lower(industry), 'marketing') THEN 'agency:1' WHEN contains(lower(industry), 'software') OR contains(lower(industry), 'technology') THEN 'tech:2' ELSE 'other:3' END AS industry_class,
  CASE WHEN size <= 10 THEN 'micro' WHEN size <= 50 THEN 'small' WHEN size <= 200 THEN 'medium' ELSE 'large' END || '_' || CASE WHEN rank = 0 THEN 'owner' WHEN rank = 1 THEN 'manager' ELSE 'staff' END AS segment,
  CASE WHEN people >= 1000000 THEN 'tier1' WHEN people >= 250000 THEN 'tier2' ELSE 'tier3' END AS tier, CASE WHEN size >= 500 THEN 'red' WHEN size >= 100 THEN 'orange' WHEN size >= 20 THEN 'blue' ELSE 'gray' END AS colour,
  CASE WHEN industry IS NOT NULL AND size > 50 THEN 'full' WHEN industry IS NOT NULL THEN 'industry' ELSE 'plain' END AS template FROM k""")
def lead_classes(t: Tables):
    """Niche by keyword and size of a company; classes by made-up cuts beside them."""
    k = t.customer.select(F.col("c_custkey").alias("id"), F.lower(F.expr(KEYWORD)).alias("k"), F.expr(INDUSTRY).alias("industry"), F.expr("c_custkey % 700").alias("size"), F.expr("c_custkey * 1000").alias("people"), F.expr("c_custkey % 4").alias("rank"))
    niche = F.replace("k", F.lit(" "), F.lit("_"))
    for w, n in reversed(NICHES.items()):
        niche = F.when(F.col("k").contains(w), n).otherwise(niche)
    low, size, people, rank = F.lower("industry"), F.col("size"), F.col("people"), F.col("rank")
    there = F.col("industry").isNotNull()
    return k.select(
        "id",
        niche.alias("niche"),
        F.when(low.contains("marketing"), "agency:1").when(low.contains("software") | low.contains("technology"), "tech:2").otherwise("other:3").alias("industry_class"),
        F.concat(F.when(size <= 10, "micro").when(size <= 50, "small").when(size <= 200, "medium").otherwise("large"), F.lit("_"), F.when(rank == 0, "owner").when(rank == 1, "manager").otherwise("staff")).alias("segment"),
        F.when(people >= 1_000_000, "tier1").when(people >= 250_000, "tier2").otherwise("tier3").alias("tier"),
        F.when(size >= 500, "red").when(size >= 100, "orange").when(size >= 20, "blue").otherwise("gray").alias("colour"),
        F.when(there & (size > 50), "full").when(there, "industry").otherwise("plain").alias("template"),
    )


SCORED = {
    "id": "c_custkey",
    "revenue": "c_acctbal * 60",
    "people": "c_custkey % 60",
    "country": cases("c_custkey", ["'United States'", "'UK'", "'Germany'", "NULL", "'Canada'"]),
    "industry": f"lower(coalesce({INDUSTRY}, ''))",
    "words": cases("c_custkey", ["'hubspot b2b'", "'lead generation'", "'cooking'", "''"]),
    "founded": "2010 + c_custkey % 16",
}
SCORES = "s AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCORED.items()) + " FROM customer)"
TECH, GROWTH = ("hubspot", "salesforce", "marketo", "pardot", "zoominfo", "digital marketing"), ("b2b", "growth marketing", "performance marketing", "marketing agency", "lead generation")
_points_sql = f"""least(100, CASE WHEN revenue >= 500000 THEN 30 WHEN revenue >= 300000 THEN 25 WHEN revenue >= 180000 THEN 20 WHEN revenue >= 100000 THEN 15 ELSE 0 END
  + CASE WHEN people BETWEEN 20 AND 50 THEN 20 WHEN people BETWEEN 15 AND 25 THEN 18 WHEN people BETWEEN 10 AND 20 THEN 15 WHEN people BETWEEN 5 AND 15 THEN 10 ELSE 0 END
  + CASE WHEN lower(country) IN ('united states', 'usa', 'us') THEN 15 WHEN lower(country) IN ('united kingdom', 'uk', 'canada', 'australia') THEN 12 ELSE 0 END
  + CASE WHEN contains(industry, 'marketing') OR contains(industry, 'advertising') THEN 15 WHEN contains(industry, 'information technology') THEN 10 WHEN contains(industry, 'software') OR contains(industry, 'saas') THEN 12 ELSE 0 END
  + CASE WHEN {has_any("words", TECH)} THEN 10 WHEN {has_any("words", GROWTH)} THEN 8 ELSE 0 END + CASE WHEN founded BETWEEN 2018 AND 2022 THEN 10 WHEN founded BETWEEN 2015 AND 2024 THEN 5 ELSE 0 END)"""


def _scored(t: Tables):
    s = t.customer.select(*(F.expr(e).alias(n) for n, e in SCORED.items()))
    r, p, country, industry, founded = F.col("revenue"), F.col("people"), F.lower("country"), F.col("industry"), F.col("founded")
    points = (
        F.when(r >= 500_000, 30).when(r >= 300_000, 25).when(r >= 180_000, 20).when(r >= 100_000, 15).otherwise(0)
        + F.when(p.between(20, 50), 20).when(p.between(15, 25), 18).when(p.between(10, 20), 15).when(p.between(5, 15), 10).otherwise(0)
        + F.when(country.isin("united states", "usa", "us"), 15).when(country.isin("united kingdom", "uk", "canada", "australia"), 12).otherwise(0)
        + F.when(_any("industry", ("marketing", "advertising")), 15).when(industry.contains("information technology"), 10).when(_any("industry", ("software", "saas")), 12).otherwise(0)
        + F.when(_any("words", TECH), 10).when(_any("words", GROWTH), 8).otherwise(0)
        + F.when(founded.between(2018, 2022), 10).when(founded.between(2015, 2024), 5).otherwise(0)
    )
    return s.select("id", "country", "industry", F.least(F.lit(100), points).alias("score"))


@book.add(f"WITH {SCORES} SELECT id, {_points_sql} AS score FROM s")
def lead_points(t: Tables):
    """Points for revenue, people, country, industry, tools and age, a hundred at most."""
    return _scored(t).select("id", "score")


@book.add(f"""
WITH {SCORES}, p AS (SELECT coalesce(country, '-') AS country, {_points_sql} AS score FROM s)
SELECT country, count(*) AS n, round(avg(score), 4) AS mean, count_if(score >= 80) AS n_high, count_if(score BETWEEN 60 AND 79) AS n_good, row_number() OVER (ORDER BY count(*) DESC, country) AS place FROM p GROUP BY 1 QUALIFY place <= 10""")
def lead_score_summary(t: Tables):
    """Mean and bands of scores by country, the ten largest."""
    by = _scored(t).groupBy(F.coalesce("country", F.lit("-")).alias("country")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), count_if(F.col("score") >= 80).alias("n_high"), count_if(F.col("score").between(60, 79)).alias("n_good"))
    # Countries, few of them, after the aggregate.
    return by.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "country"))).filter("place <= 10")


@book.add("""
WITH u AS (SELECT user_id, count(DISTINCT event_type) AS stages, count(*) AS n, count_if(value > 50) AS high, count_if(value > 90) AS top FROM events GROUP BY 1)
SELECT user_id, round(least(10.0::DOUBLE, stages / 5.0::DOUBLE * 4 + least(3.0::DOUBLE, high / greatest(n, 1)::DOUBLE * 3) + least(3.0::DOUBLE, top / greatest(n, 1)::DOUBLE * 3)), 4) AS quality FROM u""")
def pipeline_quality(t: Tables):
    """A score up to ten of stages done and of the share of high and of top values."""
    types = t.events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("event_type").alias("stages"))
    u = t.events.groupBy("user_id").agg(F.count("*").alias("n"), count_if(F.col("value") > 50).alias("high"), count_if(F.col("value") > 90).alias("top")).join(types, "user_id")
    share = lambda c: F.least(d(3.0), F.col(c) / F.greatest("n", F.lit(1)).cast("double") * 3)
    return u.select("user_id", F.round(F.least(d(10.0), F.col("stages") / d(5.0) * 4 + share("high") + share("top")), 4).alias("quality"))


# Type, priority, impact and effort of what to do, and when.
ADVICE = (
    ("open_rate < 15", "Subject Line Optimization - Critical", "Critical", 9, 3),
    ("open_rate >= 15 AND open_rate < 25", "Subject Line Optimization", "High", 7, 3),
    ("click_rate < 1", "Content & CTA Optimization", "High", 8, 5),
    ("click_rate >= 1 AND click_rate < 3", "Content Enhancement", "Medium", 6, 4),
    ("reply_rate < 0.5", "Personalization & Targeting", "Critical", 10, 7),
    ("reply_rate >= 0.5 AND reply_rate < 2", "Message Optimization", "High", 8, 6),
    ("bounce_rate > 8", "List Hygiene - Urgent", "Critical", 10, 3),
    ("bounce_rate > 3 AND bounce_rate <= 8", "List Quality Improvement", "High", 7, 4),
    ("sent = 0", "Campaign Activation", "Critical", 10, 1),
    ("sent > 0 AND sent < leads * 0.5", "Campaign Reach Optimization", "Medium", 6, 3),
    ("opened > 0 AND clicked = 0", "Call-to-Action Optimization", "High", 8, 4),
)
_rate = lambda c: f"CASE WHEN sent > 0 THEN round({c} * CAST(100.0 AS DOUBLE) / sent, 2) ELSE 0 END"
_funnel = "count(*) AS leads, count(CASE WHEN event_type <> 'signup' AND event_id % 5 <> user_id % 6 THEN 1 END) AS sent, count(CASE WHEN event_type = 'view' AND user_id % 3 > 0 THEN 1 END) AS opened, count(CASE WHEN event_type = 'click' AND user_id % 4 > 1 THEN 1 END) AS clicked, count(CASE WHEN event_type = 'purchase' AND user_id % 5 > 2 THEN 1 END) AS replied, count(CASE WHEN event_type = 'error' AND user_id % 7 > 3 THEN 1 END) AS bounced"
_rates = f"leads, sent, opened, clicked, {_rate('opened')} AS open_rate, {_rate('clicked')} AS click_rate, {_rate('replied')} AS reply_rate, {_rate('bounced')} AS bounce_rate"


@book.add(f"""
WITH f AS (SELECT user_id, {_funnel} FROM events GROUP BY 1), r AS (SELECT user_id, {_rates} FROM f),
a AS (SELECT user_id, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN {{'type': {quoted(k)}, 'priority': '{p}', 'impact': {i}, 'effort': {e}}} END" for c, k, p, i, e in ADVICE)}], lambda x: x IS NOT NULL)) AS x FROM r)
SELECT user_id, x.type AS type, x.priority AS priority, x.impact AS impact, x.effort AS effort FROM a""")
def campaign_advice(t: Tables):
    """What to do about a campaign, by eleven rules over its rates."""
    r = t.events.groupBy("user_id").agg(*(F.expr(e).alias(n) for e, n in _split(_funnel)))
    r = r.selectExpr("user_id", *(f"{e} AS {n}" for e, n in _split(_rates)))
    advice = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(k).alias("type"), F.lit(p).alias("priority"), F.lit(i).alias("impact"), F.lit(e).alias("effort"))) for c, k, p, i, e in ADVICE)))
    return r.select("user_id", F.explode(advice).alias("x")).select("user_id", "x.*")


def _split(text: str) -> list[tuple[str, str]]:
    """(expression, name) of a list of ``expression AS name`` or names."""
    out, depth, at = [], 0, 0
    for k, c in enumerate([*text, ","]):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            e, _, n = text[at:k].strip().rpartition(" AS ")
            out.append((e or n, n))
            at = k + 1
    return out


@book.add("""
WITH s AS (SELECT user_id, count(*) AS total, count_if(event_type = 'error') AS timeouts, count_if(event_type = 'click') AS dynamic, count(*) / greatest(date_diff('second', min(ts), max(ts)), 1)::DOUBLE AS speed FROM events GROUP BY 1)
SELECT user_id, coalesce(list_aggregate(list_filter([CASE WHEN timeouts > total * 0.1 THEN 'raise_timeout' END, CASE WHEN dynamic > total * 0.15 THEN 'use_renderer' END, CASE WHEN speed < 5 THEN 'more_workers' END, CASE WHEN timeouts * 100.0::DOUBLE / total > 30 THEN 'fewer_workers' END], lambda x: x IS NOT NULL), 'string_agg', ','), '') AS advice FROM s""")
def run_advice(t: Tables):
    """C11: what to change in a run, from its timeouts, dynamic pages, speed and failures."""
    s = t.events.groupBy("user_id").agg(F.count("*").alias("total"), count_if(F.col("event_type") == "error").alias("timeouts"), count_if(F.col("event_type") == "click").alias("dynamic"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.greatest(F.expr("timestampdiff(SECOND, date_trunc('second', a), date_trunc('second', b))"), F.lit(1))
    n = F.col("total")
    advice = F.array(F.when(F.col("timeouts") > n * 0.1, "raise_timeout"), F.when(F.col("dynamic") > n * 0.15, "use_renderer"), F.when(n / seconds < 5, "more_workers"), F.when(F.col("timeouts") * d(100.0) / n > 30, "fewer_workers"))
    return s.select("user_id", F.array_join(F.array_compact(advice), ",").alias("advice"))


# --- projections -----------------------------------------------------------------------------------------


@book.add(f"""
WITH {LEADS} SELECT id, nullif(trim(coalesce(phone, name)), '') AS phone, CASE WHEN name IS NULL THEN NULL ELSE concat_ws(' ', name, nullif(segment, 'BUILDING')) END AS full_name, trim(coalesce(nullif(segment, 'FURNITURE'), '') || ' ' || coalesce(name, '')) AS made_name,
  CASE WHEN score >= 50 THEN 'Yes' ELSE 'No' END AS good, concat_ws('; ', email, phone) AS contacts, CAST((email IS NOT NULL)::INT + (phone IS NOT NULL)::INT AS INTEGER) AS n_contacts, coalesce(phone, email) AS first_contact FROM l""")
def presentation(t: Tables):
    """Fall-backs, generated names, Yes and No, lists with their size, a first element."""
    r = leads(t, "id", "email", "phone", "name", "segment", "score")
    both = F.array_compact(F.array("email", "phone"))
    return r.select(
        "id",
        F.nullif(F.trim(F.coalesce("phone", "name")), F.lit("")).alias("phone"),
        F.when(F.col("name").isNotNull(), F.concat_ws(" ", "name", F.nullif("segment", F.lit("BUILDING")))).alias("full_name"),
        F.trim(F.concat(F.coalesce(F.nullif("segment", F.lit("FURNITURE")), F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")))).alias("made_name"),
        F.when(F.col("score") >= 50, "Yes").otherwise("No").alias("good"),
        F.array_join(both, "; ").alias("contacts"),
        F.size(both).alias("n_contacts"),
        F.get(F.array_compact(F.array("phone", "email")), F.lit(0)).alias("first_contact"),
    )


@book.add(f"WITH {LEADS} SELECT email, id, segment AS segment_right, balance AS balance_right, coalesce(score, 0) AS rating FROM l")
def shaped_columns(t: Tables):
    """A name given only where it is free, suffixes for one side, temporary columns gone, the important first."""
    r = leads(t, "id", "email", "segment", "balance", "score").withColumn("work_tmp", F.lit(1))
    right = r.select("id", *(F.col(c).alias(f"{c}_right") for c in ("segment", "balance")))
    r = r.drop("segment", "balance").join(right, "id")
    r = r if "rating" in r.columns else r.withColumnRenamed("score", "rating").withColumn("rating", F.coalesce("rating", F.lit(0)))
    r = r.drop(*(c for c in r.columns if c.endswith("_tmp")))
    important = ["email", "id"]
    return r.select(*important, *(c for c in r.columns if c not in important))


@book.add(f"WITH {LEADS}, o AS (SELECT id, list_filter([CASE WHEN trim(name) <> '' THEN 'name=' || trim(name) END, CASE WHEN phone <> '' THEN 'phone=' || phone END, CASE WHEN trim(email) <> '' THEN 'email=' || trim(email) END], lambda x: x IS NOT NULL) AS l FROM l) SELECT id, coalesce(list_aggregate(list_sort(l), 'string_agg', ','), '') AS extra FROM o")
def overflow_fields(t: Tables):
    """Columns beyond the core as a map without blanks, and as an upload's variables."""
    r = leads(t, "id", "email", "phone", "name").select("id", *(F.trim(c).alias(c) for c in ("email", "phone", "name")))
    m = reshape.overflow(r, ["id"])
    return m.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("extra"))


@book.add("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) WHEN event_id % 3 = 1 THEN CAST(event_id AS INTEGER) END AS k, CASE WHEN event_id % 3 = 2 THEN 'no object ' || event_id END AS text FROM events")
def fenced_answers(t: Tables):
    """The object of a fenced block or of the whole text as columns; a text that holds none stays one column."""
    said = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'Here it is:\n```json\n{\"k\": ' || event_id || '}\n``` done' ELSE 'no object ' || event_id END")
    fields = html.fenced_json(F.col("said"))
    r = t.events.select("event_id", said.alias("said")).select("event_id", "said", fields.alias("f"))
    k = F.try_element_at("f", F.lit("k"))
    return r.select("event_id", k.cast("int").alias("k"), F.when(k.isNull(), F.col("said")).alias("text"))


# --- reports ---------------------------------------------------------------------------------------------


@book.add(f"WITH {LEADS}, v AS (SELECT unnest(['email', 'phone', 'website', 'result']) AS field, unnest([nullif(trim(email), ''), phone, website, result]) AS value FROM l) SELECT field, count(*) AS n_rows, count(value) AS n_filled, round(count(value) * 100.0::DOUBLE / count(*), 4) AS pct FROM v GROUP BY 1")
def fill_rates(t: Tables):
    """How many rows have each column."""
    names_ = ("email", "phone", "website", "result")
    r = leads(t, *names_).agg(F.count("*").alias("n_rows"), *(F.count(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in names_))
    r = r.select("n_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_filled")) for c in names_))).alias("x"))
    return r.select("x.field", "n_rows", "x.n_filled", F.round(F.col("x.n_filled") * d(100.0) / F.col("n_rows"), 4).alias("pct"))


@book.add("SELECT event_type, round(sum(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value * 2 END, 0)), 2) AS total, count(*) AS n FROM events GROUP BY 1")
def alternate_totals(t: Tables):
    """Totals of a figure that goes by two names, none counting as 0."""
    v = F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value")), F.when(F.col("event_id") % 3 == 0, F.col("value") * 2), d(0.0))
    return t.events.groupBy("event_type").agg(F.round(F.sum(v), 2).alias("total"), F.count("*").alias("n"))


@book.add("""
WITH s AS (SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(ts) AS last FROM events GROUP BY 1)
SELECT event_type, n, mean, last AS last_run, n = max(n) OVER () AS most_used FROM s""")
def script_usage(t: Tables):
    """Runs of each script with their mean, the last one, and which is used most."""
    s = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("ts").alias("last_run"))
    most = s.agg(F.max("n").alias("most"))  # one row
    return s.join(F.broadcast(most)).select("event_type", "n", "mean", "last_run", (F.col("n") == F.col("most")).alias("most_used"))


@book.add("""
SELECT event_type, to_json({'total': count(*), 'values': {'high': count_if(value >= 50), 'low': count_if(value < 50)}, 'users': count(DISTINCT user_id)})::VARCHAR AS report FROM events GROUP BY 1""")
def nested_report(t: Tables):
    """A nested report of each kind as JSON."""
    users = t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("users"))
    r = t.events.groupBy("event_type").agg(F.count("*").alias("total"), count_if(F.col("value") >= 50).alias("high"), count_if(F.col("value") < 50).alias("low"))
    r = r.join(users.withColumnRenamed("event_type", "kind"), F.col("event_type").eqNullSafe(F.col("kind")))
    return r.select("event_type", F.to_json(F.struct("total", F.struct("high", "low").alias("values"), "users"), {"ignoreNullFields": "false"}).alias("report"))


@book.add("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IS NOT NULL)) AS n_keys, 5 AS n_columns FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def merge_statistics(t: Tables):
    """Rows, distinct keys and columns of a merged table."""
    m = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "c_nationkey", "n_name", "c_acctbal")
    by = m.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("n_rows"), F.count("c_nationkey").alias("n_keys")).select("n_rows", "n_keys", F.lit(len(m.columns)).alias("n_columns"))


@book.add(f"WITH {LEADS} SELECT segment, count(*) AS n, count(DISTINCT phone) AS n_phones, round(avg(coalesce(CASE WHEN score > 20 THEN score END, 0)), 4) AS mean_rating, round(count(*) / greatest(count(DISTINCT phone), 1)::DOUBLE, 4) AS per_phone FROM l GROUP BY 1")
def group_performance(t: Tables):
    """Rows, distinct ids, mean over all rows with none as 0, and rows for each id, by group."""
    by = leads(t, "segment", "phone", "score").groupBy("segment", "phone").agg(F.count("*").alias("n"), F.sum(F.when(F.col("score") > 20, F.col("score")).otherwise(0)).alias("s"))
    g = by.groupBy("segment").agg(F.sum("n").alias("n"), F.count("phone").alias("n_phones"), F.sum("s").alias("s"))
    return g.select("segment", "n", "n_phones", F.round(F.col("s") / F.col("n"), 4).alias("mean_rating"), F.round(F.col("n") / F.greatest("n_phones", F.lit(1)), 4).alias("per_phone"))


@book.add(f"WITH {LEADS}, c AS (SELECT segment, count(*) AS n FROM l GROUP BY 1) SELECT segment, n, n // 40 AS full_batches, n % 40 AS remainder FROM c")
def batch_capacity(t: Tables):
    """Full batches of forty and what is left over."""
    c = leads(t, "segment").groupBy("segment").agg(F.count("*").alias("n"))
    return c.select("segment", "n", F.floor(F.col("n") / 40).alias("full_batches"), (F.col("n") % 40).alias("remainder"))


@book.add("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5 THEN 'full' ELSE 'brief' END AS detail FROM orders")
def latest_in_full(t: Tables):
    """The five latest rows of each in full, older ones in brief."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t.orders.select("o_custkey", "o_orderkey", F.when(rank <= 5, "full").otherwise("brief").alias("detail"))


@book.add("SELECT s_suppkey, q, round(s_nationkey + CASE WHEN q IN (1, 3) THEN 0.5 ELSE -0.5 END, 4) AS lat, round(s_suppkey % 90 + CASE WHEN q < 2 THEN 0.5 ELSE -0.5 END, 4) AS lng FROM supplier, (SELECT unnest(range(4)) AS q)")
def quadrants(t: Tables):
    """The four quarters of a search area."""
    s = t.supplier.select("s_suppkey", "s_nationkey", F.explode(F.expr("sequence(0L, 3L)")).alias("q"))
    lat = F.col("s_nationkey") + F.when(F.col("q").isin(1, 3), d(0.5)).otherwise(d(-0.5))
    lng = F.col("s_suppkey") % 90 + F.when(F.col("q") < 2, d(0.5)).otherwise(d(-0.5))
    return s.select("s_suppkey", "q", F.round(lat, 4).alias("lat"), F.round(lng, 4).alias("lng"))


@book.add(f"WITH {LEADS} SELECT id, CASE WHEN {_blank('email')} THEN 'guess' || id || '@x.com' ELSE lower(trim(email)) END AS email, {_blank('email')} AS changed FROM l")
def transform_part(t: Tables):
    """What a split, a change of one part and a union give, as one expression."""
    blank = F.col("email").isNull() | (F.trim("email") == "")
    return leads(t, "id", "email").select("id", F.when(blank, F.concat(F.lit("guess"), "id", F.lit("@x.com"))).otherwise(F.lower(F.trim("email"))).alias("email"), blank.alias("changed"))


@book.add(f"WITH {LEADS} SELECT id, upper(name) AS answer FROM l")
def mapped_back(t: Tables):
    """Results that come back in any order, joined to their rows by a stable id."""
    r = leads(t, "id", "name")
    answers = r.select("id", F.upper("name").alias("answer")).orderBy(F.desc("id"))
    return r.select("id").join(answers, "id")


@book.add("SELECT event_type, count(*) AS items, round(CASE event_type WHEN 'view' THEN 0.05 WHEN 'click' THEN 0.5 ELSE 3.0 END * count(*) * 25 / 50, 4)::DOUBLE AS seconds, round(count(*) / greatest(date_diff('day', min(ts), max(ts)), 1)::DOUBLE, 4) AS per_day FROM events GROUP BY 1")
def time_estimates(t: Tables):
    """M6: seconds that items of a kind take with fifty workers, and how many come each day."""
    each = F.when(F.col("event_type") == "view", d(0.05)).when(F.col("event_type") == "click", d(0.5)).otherwise(d(3.0))
    g = t.events.groupBy("event_type").agg(F.count("*").alias("items"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.greatest(F.datediff(F.to_date("b"), F.to_date("a")), F.lit(1))
    return g.select("event_type", "items", F.round(each * F.col("items") * 25 / 50, 4).alias("seconds"), F.round(F.col("items") / days, 4).alias("per_day"))


@book.add("""
WITH t AS (SELECT c_nationkey AS tier, count(*) * 10 AS cost FROM customer GROUP BY 1), r AS (SELECT tier, cost, sum(cost) OVER (ORDER BY tier) - cost AS before, (SELECT sum(cost) FROM t) // 2 AS budget FROM t)
SELECT tier, cost, CAST(greatest(0, least(cost, budget - before)) AS BIGINT) AS allocated FROM r""")
def budget_allocation(t: Tables):
    """A budget of half the cost given to tiers in order until it is used up, the last one in part."""
    tiers = t.customer.groupBy(F.col("c_nationkey").alias("tier")).agg((F.count("*") * 10).alias("cost"))
    budget = tiers.agg(F.expr("sum(cost) div 2").alias("budget"))  # one row
    before = F.sum("cost").over(W.orderBy("tier").rowsBetween(W.unboundedPreceding, -1))  # tiers, few of them
    r = tiers.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(budget))
    return r.select("tier", "cost", F.greatest(F.lit(0).cast("long"), F.least("cost", F.col("budget") - F.col("before"))).alias("allocated"))


@book.add("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def sql_over_files(t: Tables):
    """SQL over files by path and over a registered table."""
    return t.spark.sql(f"SELECT n_name, count(*) AS n FROM {{nation}} JOIN parquet.`{t.sf_dir}/customer.parquet` ON n_nationkey = c_nationkey GROUP BY 1", nation=t.nation)


@book.add(f"WITH {LEADS} SELECT id, replace(replace(replace(name, chr(7), ''), chr(10), ' '), chr(13), ' ')[1:50000] AS cell FROM (SELECT id, chr(7) || name || chr(10) || 'x' AS name, email FROM l) WHERE NOT {_blank('email')}")
def sheet_cells(t: Tables):
    """Cells without characters that a sheet forbids, on one line, at most 50,000 characters; rows need an e-mail."""
    r = leads(t, "id", "name", "email").filter("email is not null and trim(email) <> ''")
    cell = F.regexp_replace(F.regexp_replace(F.concat(F.char(F.lit(7)), "name", F.lit("\nx")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"[\r\n]", " ")
    return r.select("id", F.substring(cell, 1, 50_000).alias("cell"))


@book.add("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, unnest([c_custkey * 2 + 1, c_custkey * 2 + 2]) AS b FROM customer), n AS (SELECT a, b FROM e WHERE b <= (SELECT max(c_custkey) FROM customer)),
r(page, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT b, depth + 1 FROM r JOIN n ON a = page WHERE depth < 6) SELECT page, min(depth) AS depth FROM r GROUP BY 1""")
def bounded_crawl(t: Tables):
    """Pages within six links of the first one, each new layer without what is known."""
    last = t.customer.agg(F.max("c_custkey").alias("last"))  # one row
    pairs = t.customer.select(F.col("c_custkey").alias("a"), F.explode(F.array(F.col("c_custkey") * 2 + 1, F.col("c_custkey") * 2 + 2)).alias("b")).join(F.broadcast(last)).filter("b <= last").select("a", "b")
    found = layer = t.spark.range(1).select(F.col("id").alias("page"), F.lit(0).alias("depth"))
    for k in range(6):
        new = layer.join(pairs, F.col("page") == F.col("a")).select(F.col("b").alias("page")).distinct()
        layer = written(new.join(found, "page", "left_anti").withColumn("depth", F.lit(k + 1)), "layer")
        found = found.union(layer)
    return found


@book.add("SELECT c_nationkey AS city, count(*) AS weight, c_nationkey * 1.5::DOUBLE AS lat, c_nationkey * -2.0::DOUBLE AS lng FROM customer GROUP BY 1")
def weighted_points(t: Tables):
    """Cities with their weight and the coordinates of a list."""
    spots = t.nation.select(F.col("n_nationkey").alias("city"), (F.col("n_nationkey") * d(1.5)).alias("lat"), (F.col("n_nationkey") * d(-2.0)).alias("lng"))
    by = t.customer.groupBy(F.col("c_nationkey").alias("city")).agg(F.count("*").alias("weight"))
    return by.join(spots, "city")
