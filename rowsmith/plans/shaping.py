"""Nested answers as flat rows, cells and columns by field, types by content, windows of dates, exports read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rowsmith.operators import reshape
from rowsmith.plans.contacts import cases
from rowsmith.plans.tables import Book, Tables
from rowsmith.plans.texts import quoted
from rowsmith.sources import project
from rowsmith.sources.shared import shared_path

book = Book()

#: JSON of places, as SQL that Spark and DuckDB read alike: keys are missing, null, empty lists and deep.
PLACE_JSON = cases(
    "s_suppkey",
    [
        """'{"place_id":"p' || s_suppkey || '","name":"N' || s_suppkey || '","types":["hvac","store"],"geometry":{"location":{"lat":1.5,"lng":-2.25}},"opening_hours":{"open_now":true,"weekday_text":["Mon: 9-5","Tue: closed"]},"rating":4.5}'""",
        """'{"place_id":"p' || s_suppkey || '","types":[],"geometry":{},"opening_hours":{"open_now":false,"weekday_text":[]}}'""",
        """'{"place_id":"p' || s_suppkey || '","name":null,"types":["one"],"user_ratings_total":' || (s_suppkey * 3) || '}'""",
        "'no json'",
    ],
)
PLACE_TYPE = "place_id string, name string, types array<string>, geometry struct<location: struct<lat: double, lng: double>>, opening_hours struct<open_now: boolean, weekday_text: array<string>>, rating double, user_ratings_total long"


@book.add(f"""
WITH j AS (SELECT s_suppkey, {PLACE_JSON} AS t FROM supplier), p AS (SELECT s_suppkey, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM j)
SELECT s_suppkey, coalesce(j->>'place_id', '') AS place_id, coalesce(j->>'name', '') AS name, coalesce(array_to_string(CAST(j->'types' AS VARCHAR[]), ', '), '') AS types, CAST(j->'geometry'->'location'->>'lat' AS DOUBLE) AS latitude, CAST(j->'geometry'->'location'->>'lng' AS DOUBLE) AS longitude,
  CAST(j->'opening_hours'->>'open_now' AS BOOLEAN) AS is_open_now, nullif(array_to_string(CAST(j->'opening_hours'->'weekday_text' AS VARCHAR[]), ' | '), '') AS hours, CAST(j->>'rating' AS DOUBLE) AS rating, coalesce(CAST(j->>'user_ratings_total' AS BIGINT), 0) AS total_ratings FROM p""")
def place_details(t: Tables):
    """Places of JSON as flat rows: lists joined by commas, hours by bars, coordinates from two levels down, constants for what is missing."""
    p = t.supplier.select("s_suppkey", F.from_json(F.expr(PLACE_JSON), PLACE_TYPE).alias("p"))
    text = lambda c: F.coalesce(c, F.lit(""))
    flat = p.select(
        "s_suppkey", text(F.col("p.place_id")).alias("place_id"), text(F.col("p.name")).alias("name"), text(F.array_join("p.types", ", ")).alias("types"), F.col("p.geometry.location.lat").alias("latitude"), F.col("p.geometry.location.lng").alias("longitude"),
        F.col("p.opening_hours.open_now").alias("is_open_now"), F.nullif(F.array_join("p.opening_hours.weekday_text", " | "), F.lit("")).alias("hours"), F.col("p.rating").alias("rating"), F.col("p.user_ratings_total").alias("total_ratings"),
    )
    return flat.na.fill({"total_ratings": 0})


# Flags of an answer, false where it lacks them.
FLAGS = ("has_emergency_service", "has_online_booking", "is_family_owned", "is_growing", "targets_residential", "targets_commercial")
ANSWER = cases(
    "c_custkey",
    [
        """'{"business_summary":"S' || c_custkey || '","personalization_angle":"A","key_flags":{"has_online_booking":true,"is_growing":false,"targets_commercial":true}}'""",
        """'{"business_summary":"only","key_flags":{"is_family_owned":true}}'""",
        """'{"personalization_angle":"no flags"}'""",
        "NULL",
        "'[broken'",
    ],
)


@book.add(f"""
WITH a AS (SELECT c_custkey, {ANSWER} AS t FROM customer), p AS (SELECT c_custkey, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM a)
SELECT c_custkey, coalesce(j->>'business_summary', '') AS business_summary, coalesce(j->>'personalization_angle', '') AS personalization_angle, {", ".join(f"coalesce(CAST(j->'key_flags'->>'{f}' AS BOOLEAN), false) AS {f}" for f in FLAGS)} FROM p""")
def enrichment_flags(t: Tables):
    """P10: an answer's texts and typed flags, each with a default where it has none."""
    kind = "business_summary string, personalization_angle string, key_flags struct<" + ", ".join(f"{f}: boolean" for f in FLAGS) + ">"
    a = t.customer.select("c_custkey", F.from_json(F.expr(ANSWER), kind).alias("a"))
    texts = [F.coalesce(F.col(f"a.{c}"), F.lit("")).alias(c) for c in ("business_summary", "personalization_angle")]
    return a.select("c_custkey", *texts, *(F.coalesce(F.col(f"a.key_flags.{f}"), F.lit(False)).alias(f) for f in FLAGS))


@book.add("SELECT c_custkey, CASE WHEN c_custkey % 7 = 2 THEN 'changed ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 2 THEN NULL WHEN c_custkey % 5 = 1 THEN 'n' || c_custkey END AS note, c_mktsegment || '!' AS mark FROM customer")
def updated_cells(t: Tables):
    """P20: cells of a known column and of one that is made for them, by row; and a whole column at once."""
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    names = c.filter("c_custkey % 7 = 2").select("c_custkey", F.concat(F.lit("changed "), "c_custkey").alias("value"))
    notes = c.filter("c_custkey % 7 = 2 or c_custkey % 5 = 1").select("c_custkey", F.when(F.col("c_custkey") % 7 != 2, F.concat(F.lit("n"), "c_custkey")).alias("value"))
    c = reshape.update_cells(reshape.update_cells(c, "c_custkey", "c_name", names), "c_custkey", "note", notes)
    return c.withColumn("mark", F.concat("c_mktsegment", F.lit("!"))).drop("c_mktsegment")


# Days from the first day of a window to the reference day, and from its last day.
WINDOWS = {"today": (0, 0), "yesterday": (1, 1), "7days": (7, 0), "2weeks": (14, 0), "30days": (30, 0), "3months": (90, 0)}
#: A window by its own dates.
CUSTOM = ("1995-03-01", "1996-02-29")


@book.add(f"""
WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) AS e FROM orders), w AS (SELECT unnest([{", ".join(map(quoted, WINDOWS))}]) AS period, unnest([{", ".join(str(a) for a, _ in WINDOWS.values())}]) AS a, unnest([{", ".join(str(b) for _, b in WINDOWS.values())}]) AS b),
p AS (SELECT period, e - CAST(a AS INTEGER) AS low, e - CAST(b AS INTEGER) AS high FROM w CROSS JOIN e UNION ALL SELECT 'all', CAST(e - INTERVAL 1 YEAR AS DATE), e FROM e UNION ALL SELECT 'custom', DATE '{CUSTOM[0]}', DATE '{CUSTOM[1]}')
SELECT period, CAST(low AS VARCHAR) AS start_date, CAST(high AS VARCHAR) AS end_date, count(o_orderkey) AS n FROM p LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN low AND high GROUP BY 1, 2, 3""")
def date_windows(t: Tables):
    """orders of each window of dates, the year before and one by its own dates among them, in one pass."""
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("e"))  # one row
    spans = [(name, F.date_sub("e", a), F.date_sub("e", b)) for name, (a, b) in WINDOWS.items()] + [("all", F.add_months("e", -12), F.col("e")), ("custom", F.lit(CUSTOM[0]).cast("date"), F.lit(CUSTOM[1]).cast("date"))]
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(F.broadcast(last))
    inside = F.array_compact(F.array(*(F.when(F.col("day").between(low, high), name) for name, low, high in spans)))
    counts = o.select(F.explode(inside).alias("period")).groupBy("period").agg(F.count("*").alias("n"))
    named = last.select(F.explode(F.array(*(F.struct(F.lit(name).alias("period"), low.cast("string").alias("start_date"), high.cast("string").alias("end_date")) for name, low, high in spans))).alias("w")).select("w.*")
    return named.join(counts, "period", "left").select("period", "start_date", "end_date", F.coalesce("n", F.lit(0)).alias("n"))


CELLS = {"email": cases("c_custkey", ["'a' || c_custkey || '@x.com'", "' '", "NULL", "'b@y.de'"]), "company": cases("c_custkey", ["c_name", "''", "c_name"]), "amount": "c_custkey % 6"}
_cells = "l AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in CELLS.items()) + " FROM customer)"


@book.add(f"WITH {_cells} SELECT c_custkey FROM l WHERE email <> '' AND company <> '' AND amount <> 0")
def required_fields(t: Tables):
    """rows that have all of some fields: neither null nor empty, a number not zero; a blank counts as something."""
    return reshape.with_all(t.customer.select("c_custkey", *(F.expr(e).alias(n) for n, e in CELLS.items())), list(CELLS)).select("c_custkey")


# Types that a table shows, and expressions that half of a column's values or more match.
SHOWN = ("company", "website", "email", "phone", "name", "title", "location")
TYPES = {"email": r"^[^@\s]+@[^@\s]+\.[a-z]+$", "website": r"^(https?://|www\.)\S+$", "phone": r"^\+?[0-9][0-9 ()-]{6,}$", "number": r"^-?[0-9]+(\.[0-9]+)?$"}
COLUMNS = {"c1": "'u' || c_custkey || '@x.com'", "c2": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://x' || c_custkey || '.com' END", "c3": "'25-' || (1000000 + c_custkey)", "c4": "CAST(c_custkey AS VARCHAR(20))", "c5": "c_name", "c6": "CASE WHEN c_custkey % 3 = 0 THEN 'a@b.cc' ELSE 'text' END"}
_typed = "CASE " + " ".join(f"WHEN count_if(regexp_matches(v, {quoted(p)})) * 2 >= greatest(count_if(v <> ''), 1) THEN '{n}'" for n, p in TYPES.items()) + " ELSE 'text' END"


@book.add("WITH l AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + f" FROM customer), u AS (UNPIVOT (SELECT * FROM l) ON {', '.join(COLUMNS)} INTO NAME field VALUE v) SELECT field, {_typed} AS type, {_typed} IN ({', '.join(map(quoted, SHOWN))}) AS visible FROM u GROUP BY 1")
def shown_columns(t: Tables):
    """Each column's type by what half of its values or more look like, and whether a table shows it."""
    c = t.customer.select(*(F.expr(e).alias(n) for n, e in COLUMNS.items()))
    counts = c.agg(*(F.struct(F.count_if(F.col(n) != "").alias("n"), *(F.count_if(F.col(n).rlike(p)).alias(k) for k, p in TYPES.items())).alias(n) for n in COLUMNS))  # one row, one pass
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("s")) for n in COLUMNS))).alias("r"))
    kind = reduce(lambda rest, k: F.when(F.col(f"r.s.{k}") * 2 >= F.greatest(F.col("r.s.n"), F.lit(1)), k).otherwise(rest), reversed(TYPES), F.lit("text"))
    return rows.select("r.field", kind.alias("type"), kind.isin(*SHOWN).alias("visible"))


@book.add("""
SELECT s_name AS name, '25-' || s_suppkey AS phone, CAST(NULL AS VARCHAR) AS segment, s_acctbal AS balance, 'suppliers' AS source FROM supplier UNION ALL SELECT c_name, CAST(NULL AS VARCHAR), c_mktsegment, c_acctbal, 'customers' FROM customer""")
def aligned_concat(t: Tables):
    """Two tables brought to the columns of both, by name, and put one under the other."""
    a = t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("25-"), "s_suppkey").alias("phone"), F.col("s_acctbal").alias("balance"), F.lit("suppliers").alias("source"))
    b = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.lit("customers").alias("source"))
    both = {c: dict(a.dtypes + b.dtypes)[c] for c in sorted({*a.columns, *b.columns})}
    return reshape.aligned(a, both).unionByName(reshape.aligned(b, both))


@book.add("""
WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer)
SELECT 'id' AS field, 'bigint' AS type, count(*) AS n_rows, 3 AS n_columns, count(*) - count(id) AS n_null FROM l UNION ALL SELECT 'name', 'string', count(*), 3, count(*) - count(name) FROM l UNION ALL SELECT 'balance', 'double', count(*), 3, count(*) - count(balance) FROM l""")
def project_profile(t: Tables):
    """Rows, columns, and each column's type and nulls."""
    c = t.customer.select(F.col("c_custkey").cast("long").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).cast("double").alias("balance"))
    one = c.agg(F.count("*").alias("n"), *(F.count(x).alias(x) for x in c.columns))
    rows = one.select("n", F.explode(F.array(*(F.struct(F.lit(x).alias("field"), F.lit(k).alias("type"), F.col(x).alias("some")) for x, k in c.dtypes))).alias("r"))
    return rows.select("r.field", "r.type", F.col("n").alias("n_rows"), F.lit(len(c.columns)).alias("n_columns"), (F.col("n") - F.col("r.some")).alias("n_null"))


@book.add("""
WITH o AS (SELECT event_id, event_type, value, event_type <> 'error' AS ok FROM events)
SELECT 'combined' AS part, event_type, count(*) AS n, round(sum(value), 2) AS total FROM o GROUP BY 2 UNION ALL SELECT CASE WHEN ok THEN 'success' ELSE 'failed' END, event_type, count(*), round(sum(value), 2) FROM o GROUP BY 1, 2 UNION ALL SELECT 'segment', event_type, count(*), round(sum(value), 2) FROM o GROUP BY 2""")
def exported_outcomes(t: Tables):
    """Successes, failures and both as JSON, and a CSV folder for each segment, written and read back."""
    e = t.events.select("event_id", "event_type", "value")
    path = shared_path(t.spark, "export")
    project.export_outcomes(e, path, F.col("event_type") != "error", "json")
    project.export_segments(e.withColumn("segment", F.col("event_type")), f"{path}/segments", "segment")
    schema = "event_id long, event_type string, value double"
    parts = [t.spark.read.schema(schema).json(f"{path}/{p}").withColumn("part", F.lit(p)) for p in ("combined", "success", "failed")]
    parts.append(t.spark.read.option("header", True).schema(schema).csv(f"{path}/segments").select("event_id", F.col("segment").alias("event_type"), "value", F.lit("segment").alias("part")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("part", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
