"""Addresses, links, places, phones and page texts: the functions of contacts over rows on which their rules fire.

Customers get a written address of one of many shapes, broken ones among them, a postal address and an error message;
pages give links and HTML. The shapes are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.functions import emails, html, names, urls
from rowsmith.operators.rules import count_if
from rowsmith.plans.tables import Book, Tables
from rowsmith.plans.texts import LINKS, REPAIRED, chain, has_any, quoted
from rowsmith.plans.texts import stripped as _strip

book = Book()


def cases(column: str, shapes: list[str]) -> str:
    return "CASE " + column + f" % {len(shapes)} " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shapes)) + " END"


EMAIL = cases(
    "c_custkey",
    [
        "'%20info@shop' || c_custkey || '.com'",
        "'312-555-0199sales@shop' || c_custkey || '.org'",
        "'contact@museum' || c_custkey || '.ukregistered'",
        "' Mary.Jane@shop' || c_custkey || '.comhoursavailable'",
        "'john_smith7@gmail.com'",
        "'Info@remove-this.shop' || c_custkey || '.nl.'",
        "'bob@site' || c_custkey || '.co'",
        "'noreply@shop.com'",
        "'x' || c_custkey || '@example.com'",
        "'dr@shop' || c_custkey || '.co.ukopening'",
        "'anna@yahoo.com; ben@shop' || c_custkey || '.de, (312) 555-0199'",
        "'office@hotel' || c_custkey || '.huhorizon'",
        "'20500events@shop.info'",
        "'no address here'",
        "'a@b'",
        "'us407.618.9029info@service' || c_custkey || '.com'",
        "NULL",
    ],
)
PLACE = cases("c_custkey", ["c_custkey || ' Main St, Houston, TX 77001, USA'", "'9 Ring Road, Miami, FL 33101, United States'", "'Strandweg ' || c_custkey || ', Kiel, Germany'", "'Somewhere without any commas that is quite long'", "'5 High St, Leeds, UK'", "NULL"])
ERROR = cases("c_custkey", ["'no_email_found_static'", "'no_email_found_dynamic: spa'", "'Read Timeout after 10 s'", "'HTTP 404'", "'Page Not Found'", "'SSL error'", "''", "NULL"])
SAYS = cases(
    "c_custkey",
    [
        "'CEO Jane Miller met Tom Baker, Director of sales. Call (312) 555-0199 or 312.555.0123. Noticed Acme helps plumbers at small firms — I know a few who miss calls. More'",
        "'Visit https://www.shop-acme.com.au/x or https://facebook.com/acme.shop and call 0412 345 678. I''m around dentists daily and they keep saying they lose time. End'",
        "'Founder  Max Muster; see https://directory-finder.com and http://customer' || c_custkey || '.org, https://www.google.com/maps/place/x y'",
        "'We leverage synergy and innovative solutions {a:1} deadbeefdeadbeefdeadbeef aa xx 12 1234 the the end <b>bold</b>'",
        "NULL",
    ],
)


def written(t: Tables, **expressions: str):
    return t.customer.select("c_custkey", "c_name", *(F.expr(e).alias(n) for n, e in expressions.items()))


_host = lambda c: f"split_part({c}, '@', -1)"


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer), f AS (SELECT c_custkey, e, lower({_strip(chain(_strip("coalesce(e, '')"), emails.SPLIT_REPAIRS, "gi"))}) AS fixed FROM r)
SELECT c_custkey, CASE WHEN contains(fixed, '@') AND contains({_host("fixed")}, '.') THEN {_strip("fixed", ".,;: ")} ELSE '' END AS repaired FROM f""")
def email_split_repair(t: Tables):
    """The fourteen repairs of the splitting step."""
    return written(t, e=EMAIL).select("c_custkey", emails.split_repair(F.col("e")).alias("repaired"))


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e, {cases("c_custkey", ["'undeliverable'", "'risky'", "'deliverable'", "'unknown'"])} AS result FROM customer),
f AS (SELECT *, {chain(_strip("e"), emails.REVALIDATION_REPAIRS, "g")} AS fixed FROM r)
SELECT c_custkey, e AS original, fixed AS cleaned FROM f WHERE result IN ('undeliverable', 'risky', 'unknown') AND fixed <> e""")
def email_revalidate(t: Tables):
    """Rows with a bad result that the repairs change, before and after."""
    r = written(t, e=EMAIL, result=cases("c_custkey", ["'undeliverable'", "'risky'", "'deliverable'", "'unknown'"]))
    f = r.withColumn("fixed", emails.revalidation_repair(F.col("e"))).filter(F.col("result").isin("undeliverable", "risky", "unknown") & (F.col("fixed") != F.col("e")))
    return f.select("c_custkey", F.col("e").alias("original"), F.col("fixed").alias("cleaned"))


@book.add(f"""
WITH r AS (SELECT c_custkey, lower({_strip("e")}) AS e FROM (SELECT c_custkey, {EMAIL} AS e FROM customer)), f AS (SELECT c_custkey, CASE WHEN ends_with(e, '.co') THEN e || 'm' ELSE e END AS e FROM r)
SELECT c_custkey, CASE WHEN NOT {has_any("e", emails.FAKE)} AND contains(e, '@') AND contains({_host("e")}, '.') AND length(e) BETWEEN 5 AND 100 THEN e END AS scraped FROM f""")
def email_scraped(t: Tables):
    """What the scraper keeps of an address."""
    return written(t, e=EMAIL).select("c_custkey", emails.scraped(F.col("e")).alias("scraped"))


_ending = "NULL"
for _e in reversed((*emails.COMPOUND_ENDINGS, *emails.SINGLE_ENDINGS)):
    _ending = f"CASE WHEN instr(host, '.{_e}') > 1 THEN name || '@' || substr(host, 1, instr(host, '.{_e}') + {len(_e)}) ELSE {_ending} END"


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer), found AS (SELECT c_custkey, lower(unnest(regexp_extract_all(e, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) AS e FROM r),
parts AS (SELECT c_custkey, split_part(e, '@', 1) AS name, split_part(e, '@', -1) AS host FROM found WHERE NOT regexp_matches(e, {quoted("|".join(emails.SPAM))})),
cut AS (SELECT DISTINCT c_custkey, {_ending} AS e FROM parts)
SELECT c_custkey, e AS email FROM cut WHERE e IS NOT NULL""")
def email_by_ending(t: Tables):
    """Addresses cut behind a known ending, those of two labels first."""
    return written(t, e=EMAIL).select("c_custkey", F.explode(emails.by_ending(F.col("e"))).alias("email"))


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer)
SELECT c_custkey, CASE WHEN e IS NULL OR NOT contains(e, '@') THEN 'invalid_format' ELSE coalesce(list_aggregate(list_filter([CASE WHEN regexp_matches(e, '\\d{{6,}}') THEN 'has_phone' END, CASE WHEN regexp_matches(e, '^[\\d\\-]+[a-z]') THEN 'starts_with_digits' END,
  CASE WHEN regexp_matches({_host("e")}, '\\.(?:{"|".join(emails.TLDS)})[a-z]+') THEN 'concatenated_domain' END, CASE WHEN split_part({_host("e")}, '.', -1) NOT IN ({", ".join(map(quoted, emails.TLDS))}) THEN 'invalid_tld' END], lambda x: x IS NOT NULL), 'string_agg', ','), '') END AS codes FROM r""")
def email_suspicions(t: Tables):
    """Codes of what is odd in an address."""
    return written(t, e=EMAIL).select("c_custkey", F.array_join(emails.suspicions(F.col("e")), ",").alias("codes"))


_role = has_any("name", emails.ROLE_WORDS)
_part = lambda sep: f"regexp_replace(split_part(name, '{sep}', 1), '\\d+', '', 'g')"


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer), n AS (SELECT *, lower(split_part(e, '@', 1)) AS name, regexp_extract(e, '(\\d{{3}})[.\\-]?(\\d{{3}})[.\\-]?(\\d{{4}})', ['a', 'b', 'c']) AS p FROM r),
g AS (SELECT *, CASE WHEN NOT {_role} THEN CASE WHEN contains(name, '.') AND regexp_matches({_part(".")}, '^[a-z]{{2,12}}$') THEN {_part(".")} WHEN contains(name, '_') AND regexp_matches({_part("_")}, '^[a-z]{{2,12}}$') THEN {_part("_")} WHEN regexp_matches(name, '^[a-z]{{3,10}}$') THEN name END END AS first FROM n)
SELECT c_custkey, upper(first[1]) || first[2:] AS first_name, CASE WHEN p.a <> '' THEN '(' || p.a || ') ' || p.b || '-' || p.c END AS phone, lower({_host("e")}) IN ({", ".join(map(quoted, emails.FREE_DOMAINS))}) AS personal FROM g""")
def email_people(t: Tables):
    """A first name, a phone in front, and whether the domain is a free one."""
    e = F.col("e")
    return written(t, e=EMAIL).select("c_custkey", emails.first_name(e).alias("first_name"), emails.embedded_phone(e).alias("phone"), emails.is_personal(e).alias("personal"))


_v = "CASE c_custkey % 5 WHEN 0 THEN 'Deliverable' WHEN 1 THEN 'unknown' WHEN 2 THEN 'RISKY' WHEN 3 THEN 'undeliverable' END"
_rank = "CASE coalesce(lower(result), 'undeliverable') WHEN 'deliverable' THEN 4 WHEN 'unknown' THEN 3 WHEN 'risky' THEN 2 WHEN 'undeliverable' THEN 1 ELSE 0 END"
_prefix = "0"
for _p, _points in reversed(emails.PREFIX_RANK.items()):
    _prefix = f"CASE WHEN starts_with(lower(split_part(e, '@', 1)), '{_p}') THEN {_points} ELSE {_prefix} END"


@book.add(f"WITH r AS (SELECT c_custkey, {EMAIL} AS e, {_v} AS result FROM customer) SELECT c_custkey, {_rank} * 1000 + {_prefix} AS total FROM r WHERE e IS NOT NULL")
def email_total_rank(t: Tables):
    """A thousand for each step of the validation result, plus the rank of the name."""
    return written(t, e=EMAIL, result=_v).filter("e is not null").select("c_custkey", emails.total_rank(F.col("e"), F.col("result")).alias("total"))


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer), p AS (SELECT c_custkey, unnest(regexp_split_to_array(coalesce(e, ''), '[,;]\\s*')) AS c FROM r),
f AS (SELECT c_custkey, {REPAIRED} AS fixed FROM p)
SELECT c_custkey, fixed AS email, count(*) AS times FROM f WHERE regexp_matches(fixed, {quoted(emails.STRICT_FORMAT)}) AND length(fixed) > 5 GROUP BY 1, 2""")
def email_cells(t: Tables):
    """All addresses of a cell, each through the 34 repairs and the strict format."""
    return written(t, e=EMAIL).select("c_custkey", F.explode(emails.split_cell(F.col("e"))).alias("email")).groupBy("c_custkey", "email").agg(F.count("*").alias("times"))


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer), c AS (SELECT c_custkey, list_filter(list_transform(regexp_split_to_array(coalesce(e, ''), '[,;]\\s*'), lambda x: lower(trim(x))), lambda x: contains(x, '@')) AS l FROM r)
SELECT c_custkey, list_aggregate(l, 'string_agg', ', ') AS joined, l[1] AS primary_email, len(l) AS n, CASE WHEN len(l) = 0 THEN 'no_valid_email' WHEN len(l) = 1 THEN 'single_email' ELSE 'multi_email_split' END AS status FROM c""")
def email_output_forms(t: Tables):
    """All addresses of a cell joined, the first one, and how many there are."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("e"), F.lit("")), r"[,;]\s*"), lambda x: F.lower(F.trim(x))), lambda x: x.contains("@"))
    c = written(t, e=EMAIL).select("c_custkey", parts.alias("l"))
    n = F.size("l")
    status = F.when(n == 0, "no_valid_email").when(n == 1, "single_email").otherwise("multi_email_split")
    return c.select("c_custkey", F.when(n > 0, F.array_join("l", ", ")).alias("joined"), F.get("l", F.lit(0)).alias("primary_email"), n.cast("long").alias("n"), status.alias("status"))


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e, {_v} AS result FROM customer), d AS (SELECT *, lower({_host("e")}) IN ({", ".join(map(quoted, emails.FREE_DOMAINS))}) AS free FROM r WHERE e IS NOT NULL)
SELECT coalesce(lower(result), 'none') AS result, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM d), 4) AS pct, count_if(free) AS n_free, count_if(NOT free) AS n_corporate FROM d GROUP BY 1""")
def validation_statistics(t: Tables):
    """Rows by result with their share, free and corporate domains."""
    d = written(t, e=EMAIL, result=_v).filter("e is not null").select(F.coalesce(F.lower("result"), F.lit("none")).alias("result"), emails.is_personal(F.col("e")).alias("free"))
    by = d.groupBy("result").agg(F.count("*").alias("n"), count_if("free").alias("n_free"), count_if(~F.col("free")).alias("n_corporate"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("result", "n", F.round(F.col("n") * F.lit(100.0).cast("double") / F.col("total"), 4).alias("pct"), "n_free", "n_corporate")


@book.add(f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e, {_v} AS result FROM customer)
SELECT c_custkey, e AS email FROM r WHERE e IS NOT NULL AND NOT (lower(coalesce(result, '')) = 'unknown' AND lower({_host("e")}) IN ({", ".join(map(quoted, emails.FREE_DOMAINS))}))""")
def not_unknown_personal(t: Tables):
    """without addresses at free domains of which nothing is known."""
    r = written(t, e=EMAIL, result=_v).filter("e is not null")
    return r.filter(~((F.lower(F.coalesce("result", F.lit(""))) == "unknown") & emails.is_personal(F.col("e")))).select("c_custkey", F.col("e").alias("email"))


_issue_rows = f"""
WITH r AS (SELECT c_custkey, {EMAIL} AS e FROM customer WHERE c_custkey % 17 < 16), g AS (SELECT c_custkey, CASE WHEN NOT regexp_matches(e, {quoted(emails.GRADED_FORMAT)}) THEN 'INVALID' WHEN len(i) > 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS grade, i FROM (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(e, {quoted(p)}) THEN '{n}' END" for n, p in emails.SIGNS.items())}], lambda x: x IS NOT NULL) AS i FROM r))"""


@book.add(f"{_issue_rows} SELECT grade, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM g), 4) AS pct FROM g GROUP BY 1")
def email_grade_shares(t: Tables):
    """Addresses by grade, with shares."""
    by = written(t, e=EMAIL).filter("e is not null").groupBy(emails.grade(F.col("e")).alias("grade")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("grade", "n", F.round(F.col("n") * F.lit(100.0).cast("double") / F.col("total"), 4).alias("pct"))


@book.add(f"{_issue_rows} SELECT issue, count(*) AS n FROM (SELECT unnest(i) AS issue FROM g) GROUP BY 1")
def email_issue_counts(t: Tables):
    """How often each sign of a broken address occurs, from a list joined with commas."""
    joined = written(t, e=EMAIL).select(F.array_join(emails.issues(F.col("e")), ", ").alias("cell"))
    return joined.filter("cell <> ''").select(F.explode(F.split("cell", ", ")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


# --- places, phones, texts -----------------------------------------------------------------------------

_parts = "string_split(place, ',')"


@book.add(f"""
WITH r AS (SELECT c_custkey, {PLACE} AS place FROM customer), p AS (SELECT *, {_parts} AS a FROM r)
SELECT c_custkey, CASE WHEN len(a) >= 3 THEN trim(a[-3]) END AS city, CASE WHEN len(a) >= 3 THEN trim(a[-3]) || ', ' || regexp_extract(trim(a[-2]), '^(\\S*)', 1) ELSE place[1:30] END AS short_place,
  CASE WHEN contains(place, ', TX') THEN 'texas' WHEN contains(place, ', FL') THEN 'florida' WHEN contains(place, ', NY') THEN 'new_york' WHEN contains(place, ', IL') THEN 'illinois' WHEN contains(place, ', MI') THEN 'michigan' WHEN contains(place, ', PA') THEN 'pennsylvania' ELSE 'unknown' END AS state FROM p""")
def address_parts(t: Tables):
    """City, city with state, and the state of a postal address."""
    p = F.col("place")
    return written(t, place=PLACE).select("c_custkey", urls.city(p).alias("city"), urls.short_place(p).alias("short_place"), urls.state(p).alias("state"))


@book.add(f"""
WITH r AS (SELECT {PLACE} AS place FROM customer), c AS (SELECT nullif(trim(regexp_extract(place, ',([^,]*)$', 1)), '') AS country FROM r)
SELECT country, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c WHERE country IS NOT NULL), 4) AS pct FROM c WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, country LIMIT 10""")
def country_shares(t: Tables):
    """The ten most frequent countries, from the end of addresses."""
    by = written(t, place=PLACE).select(urls.country(F.col("place")).alias("country")).filter("country is not null").groupBy("country").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("country", "n", F.round(F.col("n") * F.lit(100.0).cast("double") / F.col("total"), 4).alias("pct")).orderBy(F.desc("n"), "country").limit(10)


@book.add(f"""
WITH r AS (SELECT c_custkey, c_name, {SAYS} AS s FROM customer)
SELECT c_custkey, coalesce(list_aggregate(list_sort(list_distinct(list_concat(regexp_extract_all(s, '\\(?\\d{{3}}\\)?[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}'), regexp_extract_all(s, '\\d{{3}}[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}'), regexp_extract_all(s, '\\d{{10}}')))), 'string_agg', '|'), '') AS phones,
  nullif(regexp_extract(s, '{urls.AU_PHONE}'), '') AS au_phone, 'https://facebook.com/' || nullif(regexp_extract(s, 'facebook\\.com/([a-zA-Z0-9.]+)', 1), '') AS facebook, nullif(regexp_extract(s, '(?:https?://)?(?:www\\.)?google\\.com/maps/[^\\s]+'), '') AS map_link FROM r""")
def text_phones(t: Tables):
    """Phone numbers of two countries, and handles, in a text."""
    s = F.col("s")
    first = lambda p, g=0: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    return written(t, s=SAYS).select(
        "c_custkey",
        F.array_join(urls.phones(s), "|").alias("phones"),
        first(urls.AU_PHONE).alias("au_phone"),
        F.concat(F.lit("https://facebook.com/"), first(r"facebook\.com/([a-zA-Z0-9.]+)", 1)).alias("facebook"),
        first(r"(?:https?://)?(?:www\.)?google\.com/maps/[^\s]+").alias("map_link"),
    )


@book.add(f"""
WITH r AS (SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS name, {SAYS} AS s FROM customer), u AS (SELECT *, list_filter(list_transform(regexp_extract_all(coalesce(s, ''), 'https?://(?:www\\.)?([a-zA-Z0-9-]+(?:\\.[a-zA-Z0-9-]+)+)', 1), lambda x: lower(x)), lambda d: NOT {has_any("d", urls.SOCIAL)}) AS found FROM r),
n AS (SELECT *, list_filter(found, lambda d: NOT {has_any("d", ("directory", "listing", "review", "find"))} AND len(list_filter(string_split(name, ' '), lambda w: length(w) > 3 AND contains(d, w))) > 0) AS named FROM u)
SELECT c_custkey, 'https://' || coalesce(named[1], found[1]) AS website FROM n""")
def own_website(t: Tables):
    """The website that is a company's own, from a text."""
    return written(t, s=SAYS).select("c_custkey", urls.own_website(F.col("s"), F.replace("c_name", F.lit("#"), F.lit(" "))).alias("website"))


@book.add(f"""
WITH r AS (SELECT c_custkey, {SAYS} AS s FROM customer), c AS (SELECT c_custkey, list_concat(
  list_zip(regexp_extract_all(s, '({html.ROLE})\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)', 2)[1:3], regexp_extract_all(s, '({html.ROLE})\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)', 1)[1:3]),
  list_zip(regexp_extract_all(s, '([A-Z][a-z]+\\s+[A-Z][a-z]+),?\\s+({html.ROLE})', 1)[1:3], regexp_extract_all(s, '([A-Z][a-z]+\\s+[A-Z][a-z]+),?\\s+({html.ROLE})', 2)[1:3])) AS l FROM r)
SELECT c_custkey, x[1] AS name, x[2] AS role FROM (SELECT c_custkey, unnest(l) AS x FROM c)""")
def text_contacts(t: Tables):
    """Names that stand beside a role."""
    return written(t, s=SAYS).select("c_custkey", F.explode(html.contacts(F.col("s"))).alias("x")).select("c_custkey", "x.name", "x.role")


_field = lambda p: f"nullif(trim(regexp_extract(s, {quoted(p)}, 1)), '')"
_fields = {k: _field(p) for k, p in html.ANSWER_FIELDS.items()}
_fields["dreamICP"] = f"coalesce({_fields['dreamICP']}, {_field(html.DREAM_OTHERWISE)})"


@book.add(f"WITH r AS (SELECT c_custkey, {SAYS} AS s FROM customer) SELECT c_custkey, " + ", ".join(f"{x} AS {k}" for k, x in _fields.items()) + " FROM r WHERE s IS NOT NULL")
def answer_fields(t: Tables):
    """Fields of a written answer by what stands around them."""
    f = written(t, s=SAYS).filter("s is not null").select("c_custkey", html.answer_fields(F.col("s")).alias("f"))
    return f.select("c_custkey", *(F.try_element_at("f", F.lit(k)).alias(k) for k in html.ANSWER_FIELDS))


FORBIDDEN = ("leverage", "synergy", "innovative", "cutting-edge", "solutions")


@book.add(f"""
WITH r AS (SELECT c_custkey, {SAYS} AS s FROM customer), w AS (SELECT c_custkey, coalesce(list_aggregate(list_filter([{", ".join(map(quoted, FORBIDDEN))}], lambda w: contains(lower(s), w)), 'string_agg', ', '), '') AS words FROM r WHERE s IS NOT NULL)
SELECT c_custkey, words = '' AS ok, words FROM w""")
def forbidden_words(t: Tables):
    """Whether a text is free of forbidden words, and which it has."""
    words = F.array_join(F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda w: F.contains(F.lower("s"), w)), ", ")
    return written(t, s=SAYS).filter("s is not null").select("c_custkey", (words == "").alias("ok"), words.alias("words"))


_failure = "CASE WHEN contains(m, 'no_email_found_static') THEN 'no_email_found_static' WHEN contains(m, 'no_email_found_dynamic') THEN 'no_email_found_dynamic' WHEN contains(lower(m), 'timeout') THEN 'connection_timeout' WHEN contains(m, '404') OR contains(lower(m), 'not found') THEN 'page_not_found' WHEN m <> '' THEN m ELSE 'unknown_error' END"


@book.add(f"WITH r AS (SELECT c_custkey, coalesce({ERROR}, '') AS m FROM customer) SELECT {_failure} AS reason, count(*) AS n, count_if(c_custkey % 3 = 0) AS n_retried FROM r GROUP BY 1")
def failure_reasons(t: Tables):
    """Failures by kind, and how many were tried again."""
    r = written(t, m=ERROR)
    return r.groupBy(html.failure(F.col("m")).alias("reason")).agg(F.count("*").alias("n"), count_if(F.col("c_custkey") % 3 == 0).alias("n_retried"))


_bare = "regexp_replace(regexp_replace({0}, '<[^>]*>|https?://\\S+|\\S+@\\S+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s.,!?''-]', ' ', 'g')"
_words = lambda c: f"list_filter(string_split(regexp_replace(regexp_replace({_bare.format(c)}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' '), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\\d{{1,3}}$') AND replace(w, w[1:1], '') <> '')"
_dense = r"regexp_replace(coalesce(s, ''), '\{[^{}]*\}|\b[0-9a-f]{16,}\b|function\s*\([^)]*\)', ' ', 'g')"


@book.add(f"""
WITH r AS (SELECT c_custkey, {SAYS} AS s FROM customer), w AS (SELECT c_custkey, {_words("coalesce(s, '')")} AS p, list_filter({_words(_dense)}, lambda w: length(w) <= 20) AS d FROM r)
SELECT c_custkey, coalesce(list_aggregate(p, 'string_agg', ' '), '') AS plain, coalesce(list_aggregate(list_filter(d, lambda w, i: i = 1 OR w <> d[i - 1]), 'string_agg', ' '), '') AS dense FROM w""")
def clean_words(t: Tables):
    """H4: a text's words without markup and noise, and without code, hashes and repeats."""
    s = F.col("s")
    # Rows are small in files and long to work on, so that they are dealt out first.
    dealt = t.customer.select("c_custkey", "c_name").repartition(4 * t.spark.sparkContext.defaultParallelism)
    return dealt.select("c_custkey", F.expr(SAYS).alias("s")).select("c_custkey", html.plain_words(s).alias("plain"), html.dense_words(s).alias("dense"))


# --- links of pages -------------------------------------------------------------------------------------

PATHS = ("about-us", "about", "team/leadership", "blog/news", "products", "services/it/x/y", "contact", "privacy", "our-story", "company/history", "index", "what-we-do", "careers", "docs/api", "founders")
#: Links of each site to some of PATHS, by the page's number, beside those that its page has.
SITE_LINKS = f"""{LINKS}, site AS (SELECT page_id, 'https://' || regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1) || '/' || unnest([{", ".join(map(quoted, PATHS))}]) AS link, unnest(range({len(PATHS)})) AS k FROM pages),
l AS (SELECT page_id, link FROM links UNION SELECT page_id, link FROM site WHERE (page_id + k) % 3 <> 0)"""


def _site_links(t: Tables):
    own = t.pages.select("page_id", urls.host(F.col("url")).alias("host"), F.posexplode(F.array(*map(F.lit, PATHS))).alias("k", "path"))
    own = own.filter((F.col("page_id") + F.col("k")) % 3 != 0).select("page_id", F.concat(F.lit("https://"), "host", F.lit("/"), "path").alias("link"))
    return _links(t).select("page_id", "link").union(own).distinct()


_page_links = f"{LINKS}, l AS (SELECT links.page_id, link, url FROM links JOIN pages USING (page_id))"
_path = "lower(regexp_extract(link, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"
_value = " + ".join(f"CASE WHEN contains(p, '{w}') THEN 10 ELSE 0 END" for w in urls.GOOD_PATHS) + " - (" + " + ".join(f"CASE WHEN contains(p, '{w}') THEN 20 ELSE 0 END" for w in urls.BAD_PATHS) + ")"
_depth = "len(list_filter(string_split(p, '/'), lambda x: x <> ''))"


def _links(t: Tables):
    return t.pages.select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("link"))


@book.add(f"""
WITH {SITE_LINKS}, p AS (SELECT *, {_path} AS p FROM l), v AS (SELECT page_id, link, {_value} + CASE {_depth} WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE CASE WHEN {_depth} > 3 THEN -3 ELSE 0 END END + CASE WHEN {has_any("p", urls.MAIN_PATHS)} THEN 5 ELSE 0 END AS score FROM p)
SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link) AS rank FROM v WHERE score > 0 QUALIFY rank <= 4""")
def link_filter(t: Tables):
    """The four most telling links of a page by the words and depth of their paths."""
    v = _site_links(t).select("page_id", "link", urls.page_value(F.col("link")).alias("score")).filter("score > 0")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "link"))
    return v.withColumn("rank", rank).filter("rank <= 4")


def _group_sql(groups) -> str:
    return "CASE " + " ".join(f"WHEN {has_any('p', ws)} THEN {k}" for k, ws in enumerate(groups)) + " END"


@book.add(f"""
WITH {SITE_LINKS}, p AS (SELECT page_id, link, {_path} AS p FROM l), g AS (SELECT page_id, link, {_group_sql(urls.PAGE_GROUPS)} AS coarse, {_group_sql(urls.FINE_GROUPS)} AS fine FROM p)
SELECT page_id, link, 'coarse' AS kind, row_number() OVER (PARTITION BY page_id ORDER BY coarse, link) AS rank FROM g WHERE coarse IS NOT NULL QUALIFY rank <= 5
UNION ALL SELECT page_id, link, 'fine', row_number() OVER (PARTITION BY page_id ORDER BY fine, link) AS rank FROM g WHERE fine IS NOT NULL QUALIFY rank <= 5""")
def link_priority(t: Tables):
    """Links by the first group of words that their path has, the five first of each page."""
    def kind(name: str, groups):
        g = _site_links(t).select("page_id", "link", urls.page_group(F.col("link"), groups).alias("g")).filter("g is not null")
        rank = F.row_number().over(W.partitionBy("page_id").orderBy("g", "link"))
        return g.select("page_id", "link", F.lit(name).alias("kind"), rank.alias("rank")).filter("rank <= 5")

    return kind("coarse", urls.PAGE_GROUPS).union(kind("fine", urls.FINE_GROUPS))


_base = "regexp_replace(regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1), '^www\\.', '')"


@book.add(f"""
WITH {_page_links}, b AS (SELECT page_id, link, lower(link) AS low, {_base} AS base FROM l),
w AS (SELECT page_id, base, CASE WHEN regexp_matches(low, '^(#|mailto:|tel:|javascript:|data:|ftp:)') THEN NULL WHEN regexp_matches(low, '^https?://') THEN link WHEN starts_with(link, '//') THEN 'https:' || link WHEN starts_with(link, '/') THEN 'https://' || base || link
  WHEN regexp_matches(link, '[?#]|javascript') OR NOT regexp_matches(link, '[./]') THEN NULL ELSE 'https://' || base || '/' || link END AS whole FROM b),
c AS (SELECT page_id, base, whole, regexp_replace(regexp_replace(whole, '[?#].*$', ''), '/+$', '') AS bare FROM w)
SELECT DISTINCT page_id, CASE WHEN contains(bare, '//www.') THEN bare ELSE replace(bare, '://' || base, '://www.' || base) END AS page FROM c WHERE contains(lower(whole), base) AND NOT {has_any("lower(bare)", (*urls.ASSETS, *urls.SERVICE_PATHS))}""")
def internal_pages(t: Tables):
    """Pages of the same site that a page links to, as whole URLs."""
    return _links(t).select("page_id", urls.internal(F.col("link"), F.col("url")).alias("page")).filter("page is not null").distinct()


_crawl = f"regexp_extract(lower(trim(link)), '^(?:https?://)?([^/?#:]+)', 1) = regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1) AND regexp_matches(link, '(?i)^https?://') AND NOT regexp_matches(lower(link), '({'|'.join(e.replace('.', chr(92) + '.') for e in urls.SKIPPED_FILES)})$')"
_social = "|".join(s.replace(".", "\\.") for s in urls.SOCIAL)


@book.add(f"""
WITH {_page_links}, k AS (SELECT page_id, link, coalesce({_crawl}, false) AS same, regexp_matches(lower(link), '{_social}') AS social FROM l)
SELECT page_id, count_if(same) AS n_same_site, count_if(social) AS n_social, coalesce(string_agg(link, ' ' ORDER BY link) FILTER (WHERE NOT social), '') AS others FROM k GROUP BY 1""")
def link_kinds(t: Tables):
    """Links that may be crawled, those to networks, and the others joined."""
    link = F.col("link")
    k = _links(t).select("page_id", "link", urls.crawlable(link, F.col("url")).alias("same"), F.lower(link).rlike(_social).alias("social"))
    others = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("social"), link))), " ")
    return k.groupBy("page_id").agg(count_if("same").alias("n_same_site"), count_if("social").alias("n_social"), others.alias("others"))


@book.add(f"""
WITH b AS (SELECT page_id, url, {_base} AS d FROM pages)
SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS with_scheme, unnest(['https://' || d, 'https://www.' || d, 'http://' || d, 'http://www.' || d]) AS variant,
  url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || page_id || 's' AS stamped, nullif(lower(trim(url)), '') AS key FROM b""")
def url_variants(t: Tables):
    """Spellings of a site's address, one with a time stamp, and a plain key."""
    u = F.col("url")
    return t.pages.select("page_id", urls.with_scheme(u).alias("with_scheme"), F.explode(urls.variants(u)).alias("variant"), urls.stamped(u, F.col("page_id")).alias("stamped"), urls.key(u).alias("key"))


@book.add(f"""
WITH d AS (SELECT DISTINCT {_base} AS domain FROM pages), w AS (SELECT domain, regexp_extract_all(split_part(domain, '.', 1), '[a-z]+') AS l FROM d)
SELECT domain, coalesce(list_aggregate(list_transform(l, lambda x: upper(x[1]) || x[2:]), 'string_agg', ' '), '') AS name FROM w""")
def names_of_domains(t: Tables):
    """Words of a domain with capitals."""
    return t.pages.select(urls.domain(F.col("url")).alias("domain")).distinct().select("domain", names.from_domain(F.col("domain")).alias("name"))


# --- pages ----------------------------------------------------------------------------------------------


@book.add("""
WITH m AS (SELECT page_id, url, html, nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS title FROM pages)
SELECT page_id, title, nullif(regexp_extract(html, '(?is)<meta\\s+name=["'']description["'']\\s+content=["'']([^"'']*)', 1), '') AS description, nullif(regexp_extract(html, '(?is)<meta\\s+name=["'']keywords["'']\\s+content=["'']([^"'']*)', 1), '') AS keywords,
  regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1) AS host, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) AS path FROM m""")
def page_metadata(t: Tables):
    """H5: title, description, keywords, host and path of a page."""
    h, u = F.col("html"), F.col("url")
    return t.pages.select("page_id", html.title(h).alias("title"), html.meta(h, "description").alias("description"), html.meta(h, "keywords").alias("keywords"), urls.host(u).alias("host"), urls.path(u).alias("path"))


@book.add("""
WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)', 1) AS l FROM pages), x AS (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS place FROM h)
SELECT page_id, CAST(place AS INTEGER) AS place, CAST(substr(h, 3, 1) AS INTEGER) AS level, regexp_replace(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS heading FROM x""")
def page_headings(t: Tables):
    """H6: headings with their level, in order."""
    return t.pages.select("page_id", F.posexplode(html.headings(F.col("html"))).alias("place", "h")).select("page_id", "place", "h.level", F.col("h.text").alias("heading"))


_plain = "regexp_replace(m, '<!--.*?-->', ' ', 'gs')"
for _d in html.DROPPED:
    _plain = f"regexp_replace({_plain}, '<{_d}\\b.*?</{_d}>', ' ', 'gis')"
_plain = f"regexp_replace({_plain}, '<[^>]*>', ' ', 'g')"
for _e, _c in html.ENTITIES.items():
    _plain = f"replace({_plain}, {quoted(_e)}, {quoted(_c)})"
_inner = lambda tag: f"nullif(regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), '')"


@book.add(f"WITH b AS (SELECT page_id, coalesce({_inner('main')}, {_inner('article')}, {_inner('body')}, html) AS m FROM pages) SELECT page_id, regexp_replace(regexp_replace({_plain}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS content FROM b")
def page_main_content(t: Tables):
    """H6: text of main, article or body, the first that a page has."""
    return t.pages.select("page_id", html.main_content(F.col("html")).alias("content"))


_s20 = "list_filter(string_split(text, '.')[1:20], lambda s: regexp_matches(s, '(?i)(^|[ ,])(the|der|les|una)([ ,]|$)'))[1:3]"


@book.add(f"SELECT doc_id, coalesce(list_aggregate(list_transform({_s20}, lambda s: trim(s)[1:200]), 'string_agg', '|'), '') AS sentences FROM documents")
def key_sentences(t: Tables):
    """Of the first twenty sentences three that have a word, cut to 200 characters."""
    return t.documents.select("doc_id", F.array_join(html.sentences_with(F.col("text"), r"(?i)(^|[ ,])(the|der|les|una)([ ,]|$)"), "|").alias("sentences"))


_risk = " + ".join(f"CASE WHEN contains(low, '{f}') THEN 25 ELSE 0 END" for f in html.FRAMEWORKS) + f" + CASE WHEN {has_any('low', html.LOADING)} THEN 10 ELSE 0 END + CASE WHEN {has_any('low', ('loading...', 'spinner'))} THEN 15 ELSE 0 END + CASE WHEN {has_any('low', html.PROTECTION)} THEN 30 ELSE 0 END"


@book.add(f"""
WITH i AS (SELECT page_id, lower(html) AS low, length(html) AS n FROM pages), q AS (SELECT page_id, n > 500 AS accessible, CASE WHEN n > 5000 THEN 'high' WHEN n > 2500 THEN 'medium' ELSE 'low' END AS quality, {_risk} AS risk, {has_any("low", html.PROTECTION)} AS protected FROM i),
c AS (SELECT *, round(greatest(0.1::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + CASE quality WHEN 'high' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.1::DOUBLE ELSE -0.2::DOUBLE END + CASE WHEN risk >= 50 THEN -0.4::DOUBLE WHEN risk >= 25 THEN -0.2::DOUBLE ELSE 0.2::DOUBLE END)), 4) AS conf FROM q),
m AS (SELECT *, CASE WHEN NOT accessible OR protected THEN 'apify' WHEN conf >= 0.4 THEN 'http' ELSE 'apify' END AS method, CASE WHEN NOT accessible THEN 0.9::DOUBLE WHEN protected THEN 0.95::DOUBLE ELSE conf END AS confidence FROM c)
SELECT page_id, method, confidence, confidence >= 0.7 OR (risk < 50 AND NOT protected AND method = 'http') AS use_http FROM m""")
def reading_method(t: Tables):
    """How to read a site and how sure that is, and the routing that follows."""
    h = F.col("html")
    low, n = F.lower(h), F.length(h)
    q = t.pages.select("page_id", (n > 500).alias("accessible"), F.when(n > 5000, "high").when(n > 2500, "medium").otherwise("low").alias("quality"), html.js_risk(h).alias("risk"), html.any_of(low, html.PROTECTION).alias("protected"))
    m = q.select("page_id", "risk", "protected", html.recommended(F.col("accessible"), F.col("quality"), F.col("risk"), F.col("protected")).alias("m"))
    route = (F.col("m.confidence") >= 0.7) | ((F.col("risk") < 50) & ~F.col("protected") & (F.col("m.method") == "http"))
    return m.select("page_id", "m.method", "m.confidence", route.alias("use_http"))


@book.add("""
WITH d AS (SELECT DISTINCT regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1) AS host FROM pages)
SELECT host, unnest(['https://' || host || '/sitemap.xml', 'https://' || host || '/a']) AS location, 'https://' || host || '/sitemap.xml' AS from_robots FROM d""")
def sitemaps(t: Tables):
    """Locations in a sitemap, and the sitemap that a robots file names."""
    d = t.pages.select(urls.host(F.col("url")).alias("host")).distinct()
    root = F.concat(F.lit("https://"), "host")
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> '), root, F.lit("/sitemap.xml </loc></url><url><s:loc>"), root, F.lit("/a</s:loc></url></urlset>"))
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\n Sitemap: "), root, F.lit("/sitemap.xml \n"))
    return d.select("host", F.explode(urls.sitemap_locations(xml)).alias("location"), F.get(urls.robots_sitemaps(robots), F.lit(0)).alias("from_robots"))
