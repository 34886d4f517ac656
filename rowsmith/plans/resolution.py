"""Passes over rows in order, where what a row meets depends on the rows before it; SQL is a recursive pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.operators import dedupe, resolve
from rowsmith.plans.tables import Book, Tables

book = Book()

# Read alike by Spark and DuckDB.
PLACE = {
    "id": "c_custkey",
    "place": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'pl' || (c_custkey - c_custkey % 4) END",
    "phone": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '555-' || (c_custkey * 3 - (c_custkey * 3) % 7) END",
    "site": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.Shop' || (c_custkey - c_custkey % 9) || '.com/a?b' WHEN 2 THEN 'http://Shop' || (c_custkey - c_custkey % 9) || '.com#top' WHEN 3 THEN 'shop' || c_custkey || '.com' WHEN 4 THEN 'https://my.www.shop' || (c_custkey - c_custkey % 15) || '.de:8080/' ELSE 'https://Shop' || (c_custkey - c_custkey % 9) || '.com' END",
}
#: What an address has between its scheme and its path, without "www." anywhere; an address without a scheme has none.
HOST = "nullif(replace(regexp_extract(site, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), '')"
PLACES = "l AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PLACE.items()) + " FROM customer)"
_one_pass = """
o AS (SELECT id, list_filter([{keys}], lambda x: x IS NOT NULL) AS keys, row_number() OVER (ORDER BY id) AS n FROM l),
step(n, seen, id) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT)
  UNION ALL SELECT o.n, CASE WHEN list_has_any(s.seen, o.keys) THEN s.seen ELSE list_concat(s.seen, o.keys) END, CASE WHEN list_has_any(s.seen, o.keys) THEN NULL ELSE o.id END FROM step s JOIN o ON o.n = s.n + 1)
SELECT id FROM step WHERE id IS NOT NULL"""


def places(t: Tables):
    return t.customer.select(*(F.expr(e).alias(n) for n, e in PLACE.items()))


@book.add(f"WITH RECURSIVE {PLACES}, {_one_pass.format(keys="'i' || place, 'p' || phone")}")
def dedupe_place_phone(t: Tables):
    """One pass over rows that drops what shares a place id or a phone with an earlier kept row."""
    return dedupe.in_order(places(t).drop("site"), ["place", "phone"], "id").select("id")


@book.add(f"WITH RECURSIVE {PLACES}, {_one_pass.format(keys=f"'i' || place, 'p' || phone, 'h' || {HOST}")}")
def dedupe_place_phone_host(t: Tables):
    """As with place id and phone, and the host of the website as a third key."""
    return dedupe.in_order(places(t).withColumn("host", F.expr(HOST)).drop("site"), ["place", "phone", "host"], "id").select("id")


BASE = {
    "id": "c_custkey",
    "email": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'u' || (c_custkey - c_custkey % 2) || '@x.com' END",
    "phone": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'p' || (c_custkey - c_custkey % 3) END",
    "label": "c_name",
    "field": "'k0'",
    "value": "c_mktsegment",
}
NEW = {
    "ord": "c_custkey",
    "email": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'u' || (c_custkey - c_custkey % 4 + 2) || '@' || repeat('x', CAST(1 + c_custkey % 3 AS INTEGER)) || '.com' END",
    "phone": "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'p' || (c_custkey * 2 - (c_custkey * 2) % 3) END",
    "label": "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name || ' of ' || c_mktsegment END",
    "field": "'k' || (c_custkey % 3)",
    "value": "c_mktsegment || c_custkey",
}
_base = "base AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in BASE.items()) + " FROM customer)"
_new = "new AS (SELECT " + ", ".join(f"nullif(trim({e}), '') AS {n}" if n in ("email", "phone") else f"{e} AS {n}" for n, e in NEW.items()) + ", row_number() OVER (ORDER BY c_custkey) AS n FROM customer)"


@book.add(f"""
WITH RECURSIVE {_base}, {_new},
step(n, recs, ord, lead) AS (
  SELECT CAST(0 AS BIGINT), list({{'k': 'old' || id, 'e': email, 'p': phone}} ORDER BY id), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM base
  UNION ALL
  SELECT n, CASE WHEN hit IS NULL THEN list_append(recs, {{'k': 'new' || ord, 'e': email, 'p': phone}}) ELSE list_transform(recs, lambda x, i: CASE WHEN i <> hit THEN x ELSE
      {{'k': x.k, 'e': CASE WHEN x.e IS NULL OR length(email) > length(x.e) THEN email ELSE x.e END, 'p': CASE WHEN x.p IS NULL OR length(phone) > length(x.p) THEN phone ELSE x.p END}} END) END,
    ord, CASE WHEN hit IS NULL THEN 'new' || ord ELSE recs[hit].k END
  FROM (SELECT new.n, new.ord, email, phone, recs, coalesce(
      CASE WHEN email IS NOT NULL THEN nullif(list_position(list_transform(recs, lambda x: x.e), email), 0) END,
      CASE WHEN phone IS NOT NULL THEN nullif(list_position(list_transform(recs, lambda x: x.p), phone), 0) END) AS hit
    FROM step s JOIN new ON new.n = s.n + 1)),
every AS (SELECT 'old' || id AS key, CAST(-1 AS BIGINT) AS ord, email, phone, label, field, value FROM base UNION ALL SELECT lead, new.ord, email, phone, label, field, value FROM new JOIN (SELECT ord, lead FROM step WHERE ord IS NOT NULL) s ON s.ord = new.ord),
texts AS (SELECT key, arg_max(email, (length(email), -ord)) AS email, arg_max(phone, (length(phone), -ord)) AS phone, arg_max(label, (length(label), -ord)) AS label, count_if(ord >= 0) AS n_merged FROM every GROUP BY 1),
f AS (SELECT key, field, arg_max(value, ord) AS value FROM every GROUP BY 1, 2),
x AS (SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS extra FROM f GROUP BY 1),
tag AS (SELECT 'import_' || strftime(CAST(max(o_orderdate) AS DATE), '%Y%m%d') AS tag FROM orders)
SELECT key, email, phone, label, n_merged, extra, CASE WHEN starts_with(key, 'new') THEN tag WHEN n_merged > 0 THEN 'base,' || tag ELSE 'base' END AS sources, CASE WHEN starts_with(key, 'new') THEN 'import' ELSE 'base' END AS original_source
FROM texts JOIN x USING (key) CROSS JOIN tag""")
def upsert_in_order(t: Tables):
    """Each row of a batch merges into the record with its e-mail, else with its phone, whether from the base or made by an earlier row; longer texts win, maps unite, sources add up."""
    base = t.customer.select(*(F.expr(e).alias(n) for n, e in BASE.items()))
    new = t.customer.select(*((F.nullif(F.trim(F.expr(e)), F.lit("")) if n in ("email", "phone") else F.expr(e)).alias(n) for n, e in NEW.items()))
    lead = resolve.assign(base.select("id", F.col("email").alias("first"), F.col("phone").alias("second")), new.select(F.col("ord").alias("pos"), F.col("email").alias("first"), F.col("phone").alias("second")))
    tag = t.orders.agg(F.concat(F.lit("import_"), F.date_format(F.to_date(F.max("o_orderdate")), "yyyyMMdd")).alias("tag"))  # one row
    return resolve.merged(base, new.join(lead, F.col("ord") == F.col("pos")).drop("pos"), ["email", "phone", "label"]).join(F.broadcast(tag)).select(
        "key", "email", "phone", "label", "n_merged", "extra",
        F.when(F.col("key").startswith("new"), F.col("tag")).when(F.col("n_merged") > 0, F.concat(F.lit("base,"), "tag")).otherwise("base").alias("sources"),
        F.when(F.col("key").startswith("new"), "import").otherwise("base").alias("original_source"),
    )
