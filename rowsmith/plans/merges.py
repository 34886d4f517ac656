"""Merges, lookups, deduplication, ranking and reshaping over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.operators import dedupe, merge, ranking, reshape, rules
from rowsmith.plans.tables import Book, Tables

book = Book()

PATCH = "(SELECT c_custkey * 2 AS c_custkey, nullif(round(c_acctbal * 2, 2), 0) AS c_acctbal, 'patched' AS note FROM customer)"
BASE = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"


def _patch(t: Tables):
    base = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    patch = t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), F.nullif(F.round(F.col("c_acctbal") * 2, 2), F.lit(0.0).cast("double")).alias("c_acctbal"), F.lit("patched").alias("note"))
    return base, patch


@book.add(f"SELECT b.c_custkey, c_name, coalesce(p.c_acctbal, b.c_acctbal) AS c_acctbal, note FROM {BASE} b LEFT JOIN {PATCH} p USING (c_custkey)")
def enrich_prefer_new(t: Tables):
    """Columns added by key, new values before old ones."""
    return merge.enrich(*_patch(t), "c_custkey", "new")


@book.add(f"SELECT b.c_custkey, c_name, coalesce(b.c_acctbal, p.c_acctbal) AS c_acctbal, note FROM {BASE} b LEFT JOIN {PATCH} p USING (c_custkey)")
def enrich_keep_old(t: Tables):
    """Old values before new ones."""
    return merge.enrich(*_patch(t), "c_custkey", "old")


@book.add("""
WITH a AS (SELECT c_nationkey AS k, max(c_acctbal) AS balance, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_acctbal) AS balance FROM supplier GROUP BY 1), c AS (SELECT n_nationkey AS k, n_name FROM nation)
SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(b.balance, a.balance) AS balance, customers, n_name FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""")
def nway_outer_merge(t: Tables):
    """Any number of tables by key, the last value counts."""
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("balance"), F.count("*").alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("balance"))
    return merge.merge_all([a, b, t.nation.select(F.col("n_nationkey").alias("k"), "n_name")], "k")


def _sides(t: Tables):
    # Shifted, so that rows of both sides have no match.
    return t.customer.select("c_custkey", "c_name"), t.orders.select("o_orderkey", (F.col("o_custkey") + 7).alias("o_custkey"), "o_totalprice")


def _merge_sql(how: str) -> str:
    return f"""SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice FROM customer c {how} JOIN (SELECT o_orderkey, o_custkey + 7 AS o_custkey, o_totalprice FROM orders) o ON c_custkey = o_custkey"""


@book.add(_merge_sql("LEFT"))
def merge_left(t: Tables):
    """Left merge of differently named keys."""
    return merge.merge(*_sides(t), {"c_custkey": "o_custkey"}, "left")


@book.add(_merge_sql("RIGHT"))
def merge_right(t: Tables):
    """Right merge."""
    return merge.merge(*_sides(t), {"c_custkey": "o_custkey"}, "right")


@book.add(_merge_sql("INNER"))
def merge_inner(t: Tables):
    """Inner merge."""
    return merge.merge(*_sides(t), {"c_custkey": "o_custkey"}, "inner")


@book.add(_merge_sql("FULL"))
def merge_outer(t: Tables):
    """Outer merge."""
    return merge.merge(*_sides(t), {"c_custkey": "o_custkey"}, "outer")


@book.add("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'known' END, n_name) AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_backfill(t: Tables):
    """Missing values from two lookups in a row."""
    o = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "known").alias("place"))
    o = merge.lookup(o.withColumn("c_custkey", F.col("o_custkey")), t.customer, "c_custkey", "c_nationkey", "nation")
    named = merge.lookup(o.withColumn("n_nationkey", F.col("nation")), t.nation, "n_nationkey", "n_name", "place")
    return named.select("o_orderkey", "place")


@book.add("""
WITH a AS (SELECT c_custkey, c_name AS label FROM customer), b AS (SELECT c_custkey + 3 AS c_custkey, c_mktsegment || '/' || c_mktsegment AS label FROM customer)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.label IS NULL OR length(b.label) > length(a.label) THEN coalesce(b.label, a.label) ELSE a.label END AS label FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def upsert_longer_wins(t: Tables):
    """Insert or update by one key, the longer text stays."""
    a = t.customer.select("c_custkey", F.col("c_name").alias("label"))
    b = t.customer.select((F.col("c_custkey") + 3).alias("c_custkey"), F.concat_ws("/", "c_mktsegment", "c_mktsegment").alias("label"))
    return merge.upsert(a, b, "c_custkey", ["label"])


@book.add("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS)""")
def not_contacted_recently(t: Tables):
    """Customers without an order in the last 30 days of the data."""
    end = t.orders.agg(F.max("o_orderdate").alias("end"))
    recent = t.orders.filter(F.col("o_orderdate") > end.scalar() - F.expr("INTERVAL 30 DAYS"))
    return t.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@book.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def semi_join(t: Tables):
    """Rows with a match."""
    return t.customer.join(t.orders.filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@book.add("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join(t: Tables):
    """Rows that are still to be processed."""
    return t.customer.join(t.orders.filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@book.add("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'home-' || c_custkey WHEN c_custkey % 5 = 0 THEN 'pages-' || c_custkey WHEN c_custkey % 7 = 0 THEN 'guess-' || c_custkey END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN 'home' WHEN c_custkey % 5 = 0 THEN 'pages' WHEN c_custkey % 7 = 0 THEN 'guess' END AS email_source FROM customer""")
def waterfall_merge(t: Tables):
    """The first source that has a value, and which one it was."""
    key = lambda k: F.col("c_custkey") * k
    sources = [(n, t.customer.select(key(k).alias("c_custkey"), F.concat(F.lit(f"{n}-"), key(k)).alias("email"))) for n, k in (("home", 3), ("pages", 5), ("guess", 7))]
    return merge.waterfall(t.customer.select("c_custkey"), sources, "c_custkey", "email")


@book.add("""
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events),
f AS (SELECT user_id, event_type FROM e WHERE a = 1), l AS (SELECT user_id, event_type FROM e WHERE z = 1)
SELECT f.event_type AS status_before, l.event_type AS status_after, count(*) AS n FROM f JOIN l USING (user_id) WHERE f.event_type <> l.event_type GROUP BY 1, 2""")
def run_changes(t: Tables):
    """How statuses changed between two runs."""
    e = t.events.select("user_id", "event_type", "ts", "event_id")
    return merge.changes(dedupe.keep_first(e, ["user_id"], ["ts", "event_id"]), dedupe.keep_last(e, ["user_id"], ["ts", "event_id"]), "user_id", "event_type")


@book.add("SELECT r_name, segment, r_name || ' ' || segment AS search FROM region, (SELECT DISTINCT c_mktsegment AS segment FROM customer)")
def cross_grid(t: Tables):
    """Every region with every segment; both are short lists of names."""
    segments = t.customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    return t.region.join(segments).select("r_name", "segment", F.concat_ws(" ", "r_name", "segment").alias("search"))


LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@book.add(f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_first(t: Tables):
    """The first row of a composite key."""
    return dedupe.keep_first(t.lineitem, ["l_orderkey", "l_linenumber"], LINE_ORDER, columns=["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"])


@book.add(f"""
SELECT l_orderkey, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_last(t: Tables):
    """The last row of a key."""
    return dedupe.keep_last(t.lineitem, ["l_orderkey"], LINE_ORDER).select("l_orderkey", "l_shipdate", "l_extendedprice")


@book.add("SELECT l_returnflag, l_linestatus, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2")
def dedupe_composite(t: Tables):
    """D3: one row for each pair."""
    return dedupe.keep_first(t.lineitem.select("l_returnflag", "l_linestatus", "l_shipdate"), ["l_returnflag", "l_linestatus"], ["l_shipdate"])


@book.add("SELECT text, count(*) AS n_rows, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs FROM documents GROUP BY text")
def dedupe_provenance(t: Tables):
    """One row for each text with where it came from."""
    return dedupe.with_provenance(t.documents, "text", {"source": "sources", "lang": "langs"}, hashed=True)


@book.add("""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, 'F') AS status, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders)
SELECT o_custkey, arg_min(status, (-o_totalprice, o_orderkey)) FILTER (WHERE status IS NOT NULL) AS status, arg_min(priority, (-o_totalprice, o_orderkey)) FILTER (WHERE priority IS NOT NULL) AS priority FROM o GROUP BY 1""")
def first_nonnull_by_priority(t: Tables):
    """Of each column the value of the best row that has one."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return dedupe.first_nonnull(o, "o_custkey", ["status", "priority"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@book.add("""
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1)
SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS q FROM a) WHERE q = 1""")
def dedupe_in_sequence(t: Tables):
    """One key after the other."""
    return dedupe.in_sequence(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"], ["o_orderkey"])


@book.add("""
SELECT * FROM (SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""")
def top_bottom_k(t: Tables):
    """The ten highest and the ten lowest."""
    return ranking.top_and_bottom(t.orders.select("o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], [F.asc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 10)


@book.add("""
SELECT c_nationkey, c_custkey, c_acctbal, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3""")
def topn_per_group(t: Tables):
    """The best three of each group."""
    return ranking.top_per_group(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@book.add("""
SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= floor(count(*) OVER (PARTITION BY c_nationkey) / 2) THEN 'first' ELSE 'second' END AS half FROM customer""")
def halves(t: Tables):
    """Groups cut in two by place."""
    return ranking.halves(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"]).select("c_custkey", "half")


@book.add("""SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 25) AS BIGINT) AS batch FROM customer""")
def batches(t: Tables):
    """Batches of twenty-five."""
    return ranking.batches(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"], 25).select("c_custkey", "batch")


@book.add("""
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def aligned_union(t: Tables):
    """Tables of different columns one below the other."""
    return reshape.stack([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


CELL = "concat(c_mktsegment, ', ', CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, '; ', CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE ' ' END)"


@book.add(f"SELECT c_custkey, trim(part) AS part FROM (SELECT c_custkey, unnest(regexp_split_to_array({CELL}, '[,;]\\s*')) AS part FROM customer) WHERE trim(part) <> ''")
def explode_list(t: Tables):
    """A row for each part of a cell."""
    return reshape.explode_list(t.customer.select("c_custkey", F.expr(CELL).alias("cell")), "cell", "part").select("c_custkey", "part")


@book.add("""
WITH s AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey END], lambda x: x IS NOT NULL) AS parts FROM customer)
SELECT c_custkey, CASE len(parts) WHEN 0 THEN 'no_valid_email' WHEN 1 THEN 'single_email' ELSE 'multi_email_split' END AS status, unnest(CASE WHEN len(parts) = 0 THEN [NULL] ELSE parts END) AS part FROM s""")
def explode_status(t: Tables):
    """Parts of a cell with what the cell held, empty ones too."""
    of = lambda k, x: F.when(F.col("c_custkey") % k == 0, F.concat(F.lit(x), F.col("c_custkey")))
    s = t.customer.select("c_custkey", F.array_compact(F.array(of(2, "a"), of(3, "b"))).alias("parts"))
    return s.select("c_custkey", reshape.cell_status(F.col("parts")).alias("status"), F.explode_outer("parts").alias("part"))


@book.add("""
SELECT n_nationkey, i, j, round(n_nationkey * 1.0::DOUBLE - 0.5::DOUBLE + i * 0.25::DOUBLE, 6) AS point_lat, round(n_regionkey * 10.0::DOUBLE - 0.5::DOUBLE + j * 0.25::DOUBLE, 6) AS point_lng
FROM nation, range(5) a(i), range(5) b(j)""")
def grid_points(t: Tables):
    """Search points around each place."""
    n = t.nation.select("n_nationkey", (F.col("n_nationkey") * F.lit(1.0).cast("double")).alias("lat"), (F.col("n_regionkey") * F.lit(10.0).cast("double")).alias("lng"))
    g = reshape.grid(n, "lat", "lng", 1.0, 5)
    return g.select("n_nationkey", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "point_lat", "point_lng")


@book.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 8000 AND c_mktsegment = 'BUILDING'")
def filter_dsl(t: Tables):
    """F1 F2 K2: a filter written as data, applied before the projection."""
    c = t.customer.withColumn("low", F.col("c_acctbal"))
    return rules.apply_filters(c, {"c_acctbal": ">=1000", "low": "<8000", "c_mktsegment": "BUILDING", "absent": ">3"}).select("c_custkey", "c_name", "c_acctbal")


@book.add("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'with_email' WHEN o_totalprice > 100000 THEN 'phone_only' ELSE 'failed' END AS bucket FROM orders""")
def three_way_split(t: Tables):
    """One column for three outputs."""
    return t.orders.select("o_orderkey", rules.first_match([(F.col("o_orderstatus") == "F", "with_email"), (F.col("o_totalprice") > 100000, "phone_only")], "failed").alias("bucket"))
