"""Projections, predicates, dates and small functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.functions import emails, html, names, urls
from rowsmith.operators import rules
from rowsmith.operators.workflow import Workflow
from rowsmith.plans.tables import Book, Tables
from rowsmith.sources.readers import renamed

book = Book()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@book.add("""
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS name, c_acctbal AS balance, c_acctbal > 0 AS has_balance, 'import' AS source FROM customer""")
def canonical_columns(t: Tables):
    """Many names to one, presence flags and provenance."""
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("company"), F.col("c_mktsegment").alias("business"), "c_acctbal")
    c = renamed(c, {"c_custkey": "id", "company": "name", "business": "name", "c_acctbal": "balance"})
    return c.select("id", "name", "balance", (F.col("balance") > 0).alias("has_balance"), F.lit("import").alias("source"))


@book.add("""
SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_size > 10 THEN 'SIZE ' || p_size END, CASE WHEN p_type <> 'SMALL' THEN 'TYPE ' || p_type END, 'NAME ' || p_name) AS summary FROM part""")
def conditional_summary(t: Tables):
    """Parts of a text that are there."""
    line = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    return t.part.select("p_partkey", F.concat_ws("\n", F.when(F.col("p_size") > 10, line("SIZE ", "p_size")), F.when(F.col("p_type") != "SMALL", line("TYPE ", "p_type")), line("NAME ", "p_name")).alias("summary"))


@book.add("SELECT event_id, TRY_CAST(replace(event_type, 'view', '7') AS INTEGER) AS number, coalesce(CASE event_type WHEN 'view' THEN 'low' WHEN 'purchase' THEN 'high' END, 'other') AS level FROM events")
def coerce_and_map(t: Tables):
    """Numbers where there are some, and a fixed map with a default."""
    level = F.create_map(*map(F.lit, ("view", "low", "purchase", "high")))
    return t.events.select("event_id", F.expr("try_cast(replace(event_type, 'view', '7') as int)").alias("number"), F.coalesce(F.try_element_at(level, F.col("event_type")), F.lit("other")).alias("level"))


@book.add("""
SELECT page_id FROM pages WHERE length(url) > 40 AND contains(url, '.') AND starts_with(url, 'http') AND NOT regexp_matches(lower(url), 'facebook\\.com|blog\\.')""")
def page_predicates(t: Tables):
    """Presence, validity, prefixes and excluded platforms."""
    u = F.col("url")
    return t.pages.filter(rules.present(u) & (F.length(u) > 40) & u.contains(".") & u.startswith("http") & ~F.lower(u).rlike(r"facebook\.com|blog\.")).select("page_id")


@book.add("SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND n_chars > 500 AND lang IN ('en', 'de') AND contains(text, '@')")
def ready_documents(t: Tables):
    """Rows that have all that a step needs."""
    return t.documents.filter(F.col("text").isNotNull() & (F.col("n_chars") > 500) & F.col("lang").isin("en", "de") & F.col("text").contains("@")).select("doc_id", "n_chars")


@book.add("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month, date_diff('day', CAST(o_orderdate AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS age_days
FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAYS""")
def date_presets(t: Tables):
    """The last ninety days of the data, with buckets and ages."""
    end = t.orders.agg(F.max("o_orderdate").alias("end"))
    o = t.orders.filter(F.col("o_orderdate") >= end.scalar() - F.expr("INTERVAL 90 DAYS")).join(F.broadcast(end))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.datediff(F.to_date("end"), F.to_date("o_orderdate")).cast("long").alias("age_days"))


@book.add("""
SELECT event_id, CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS lasted FROM (SELECT event_id, CAST(floor(value * 30) AS BIGINT) AS s FROM events)""")
def durations(t: Tables):
    """Seconds as a clock and as words."""
    s = F.floor(F.col("value") * 30).cast("long")
    m, r = F.floor(s / 60).cast("string"), (s % 60).cast("string")
    return t.events.select("event_id", F.concat(m, F.lit(":"), F.lpad(r, 2, "0")).alias("clock"), F.when(s >= 60, F.concat(m, F.lit("m "), r, F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s"))).alias("lasted"))


@book.add("""
SELECT event_type, round(count(*) * 0.001::DOUBLE, 4) AS cost, CASE WHEN count(*) > 0 THEN round(count_if(value > 50) * 100.0::DOUBLE / count(*), 2) ELSE 0 END AS yield_pct, CAST(ceil(count(*) / 25.0::DOUBLE) AS BIGINT) AS batches FROM events GROUP BY 1""")
def cost_model(t: Tables):
    """Fixture: cost, yield with a guard for nothing, and batches."""
    n = F.count("*")
    return t.events.groupBy("event_type").agg(F.round(n * F.lit(0.001).cast("double"), 4).alias("cost"), rules.percent(rules.count_if(F.col("value") > 50), n).alias("yield_pct"), F.ceil(n / 25).cast("long").alias("batches"))


_host = "regexp_replace(regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1), '^www\\.', '')"


@book.add(f"""
SELECT page_id, unnest(['contact', 'about', 'team', 'impressum']) AS page, 'https://' || {_host} || '/' || unnest(['contact', 'about', 'team', 'impressum']) AS candidate FROM pages""")
def page_expansion(t: Tables):
    """Fixture: pages of a site that may name a contact."""
    paths = F.explode(F.array(*map(F.lit, ("contact", "about", "team", "impressum"))))
    return t.pages.select("page_id", urls.domain(F.col("url")).alias("d"), paths.alias("page")).select("page_id", "page", F.concat(F.lit("https://"), "d", F.lit("/"), "page").alias("candidate"))


@book.add(f"""
WITH d AS (SELECT DISTINCT {_host} AS domain FROM pages) SELECT domain, p || '@' || domain AS email, regexp_extract(split_part(domain, '.', 1), '[a-z]+') AS word FROM d, (SELECT unnest(['info', 'contact', 'hello']) AS p)""")
def address_patterns(t: Tables):
    """Fixture: usual addresses at each domain."""
    d = t.pages.select(urls.domain(F.col("url")).alias("domain")).distinct()
    full = d.select("domain", F.explode(F.array(*map(F.lit, ("info", "contact", "hello")))).alias("p")).select("domain", F.concat("p", F.lit("@"), "domain").alias("email"))
    return full.select("domain", "email", F.regexp_extract(F.substring_index(emails.domain(F.col("email")), ".", 1), "[a-z]+", 0).alias("word"))


@book.add("""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href=["'']([^"'']+)', 1) AS links FROM pages)
SELECT page_id, len(list_distinct(list_filter(links, lambda x: NOT list_contains(['/the', '/and'], lower(x)) AND NOT regexp_matches(lower(x), '^(#|javascript:|mailto:)')))) AS n_new FROM l""")
def link_difference(t: Tables):
    """Fixture: links that are not known yet."""
    seen = F.array(*map(F.lit, ("/the", "/and")))
    return t.pages.select("page_id", F.size(F.filter(urls.links(F.col("html")), lambda x: ~F.array_contains(seen, F.lower(x)))).cast("long").alias("n_new"))


WORDS = {"software": ("the ", "and "), "services": ("der ", "und "), "trade": ("les ", "des ")}
_tags = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {quoted(w)})' for w in ws)} THEN '{k}' END" for k, ws in WORDS.items())


@book.add(f"""
WITH g AS (SELECT doc_id, list_filter([{_tags}], lambda x: x IS NOT NULL) AS tags FROM documents) SELECT doc_id, coalesce(tags[1], 'other') AS industry, coalesce(list_aggregate(tags, 'string_agg', ','), '') AS tags FROM g""")
def keyword_tags(t: Tables):
    """Fixture: the first group of words found, and all of them."""
    low = F.lower("text")
    tags = F.array_compact(F.array(*(F.when(html.any_of(low, ws), k) for k, ws in WORDS.items())))
    return t.documents.select("doc_id", tags.alias("g")).select("doc_id", F.coalesce(F.get("g", F.lit(0)), F.lit("other")).alias("industry"), F.array_join("g", ",").alias("tags"))


@book.add("""
SELECT c_custkey, to_json({'email': lower(c_mktsegment) || '@x.com', 'name': c_name}) AS payload FROM customer""")
def upload_payload(t: Tables):
    """Fixture: an upload record as JSON."""
    return t.customer.select("c_custkey", F.to_json(F.struct(F.concat(F.lower("c_mktsegment"), F.lit("@x.com")).alias("email"), F.col("c_name").alias("name"))).alias("payload"))


@book.add("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Supplier ' || s_suppkey END AS label, 'seen' AS mark FROM supplier")
def workflow_steps(t: Tables):
    """D-U1 D-U2: named steps that fill what is missing."""
    w = Workflow()
    w.fill("label", "s_suppkey", "label", lambda c: F.concat(F.lit("Supplier "), c.cast("string")))
    w.step("mark")(lambda df: df.withColumn("mark", F.lit("seen")))
    s = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("label"))
    return w.run(s, ["label", "mark"])


@book.add("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def point_layer(t: Tables):
    """Fixture: weights by place."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("weight"))


@book.add("""SELECT name, rank FROM (SELECT p_name || ' Hotel Resort Spa House Ltd' AS full_name, p_partkey FROM part) JOIN (SELECT p_partkey, array_to_string(string_split(p_name || ' Hotel Resort Spa House', ' ')[1:4], ' ') AS name, p_partkey % 7 AS rank FROM part) USING (p_partkey)""")
def casual_lodging(t: Tables):
    """Four words stay of a lodging's name."""
    return t.part.select(names.casual(F.concat("p_name", F.lit(" Hotel Resort Spa House Ltd"))).alias("name"), (F.col("p_partkey") % 7).alias("rank"))
