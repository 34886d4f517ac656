"""Text, scoring, similarity and stream queries over documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.functions import emails, html, names, urls
from rowsmith.operators import reshape, rules, similarity
from rowsmith.plans.tables import Book, Tables
from rowsmith.streaming import resume

book = Book()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


TLDS_SQL = ", ".join(map(quoted, emails.TLDS))
_cut = "e"
for _t in reversed(emails.LONGEST_FIRST):
    _cut = f"CASE WHEN regexp_matches(e, '\\.{_t}[a-z]+$') THEN regexp_replace(e, '\\.{_t}[a-z]+$', '.{_t}') ELSE {_cut} END"
FOUND_SQL = f"""
found AS (SELECT id, unnest(regexp_extract_all(body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,20}}')) AS raw FROM src),
bare AS (SELECT id, regexp_replace(lower(raw), '^[0-9\\-]+([a-z])', '\\1') AS e FROM found),
cut AS (SELECT id, CASE WHEN split_part(e, '.', -1) IN ({TLDS_SQL}) THEN e ELSE {_cut} END AS e FROM bare),
ok AS (SELECT DISTINCT id, e FROM cut WHERE length(e) BETWEEN 5 AND 254 AND NOT regexp_matches(e, {quoted("|".join(emails.EXCLUDED))}) AND regexp_matches(e, {quoted(emails.FORMAT)}) AND split_part(e, '.', -1) IN ({TLDS_SQL}))"""


@book.add(f"WITH src AS (SELECT doc_id AS id, text AS body FROM documents), {FOUND_SQL} SELECT id AS doc_id, e AS email FROM ok")
def email_extract(t: Tables):
    """Valid addresses in documents."""
    return t.documents.filter(F.col("text").contains("@")).select("doc_id", F.explode(emails.extract(F.col("text"))).alias("email"))


@book.add(f"WITH src AS (SELECT page_id AS id, html AS body FROM pages), {FOUND_SQL} SELECT id AS page_id, e AS email FROM ok")
def email_extract_html(t: Tables):
    """Valid addresses in pages, links to mail included."""
    return t.pages.filter(F.col("html").contains("@")).select("page_id", F.explode(emails.extract(F.col("html"))).alias("email"))


RAW = "CASE WHEN c_custkey % 4 = 0 THEN ' MAILTO:' || lower(c_mktsegment) || c_custkey || '@Mail.COM ' WHEN c_custkey % 4 = 1 THEN c_custkey || 'info@shop' || c_custkey || '.combig' WHEN c_custkey % 4 = 2 THEN 'info@remove-this.shop.nlban' ELSE lower(c_mktsegment) || ' at shop' END"


@book.add(f"""
WITH r AS (SELECT c_custkey, {RAW} AS raw FROM customer), b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(raw), '^\\s+|\\s+$', '', 'g'), '^mailto:', ''), '\\s+', '', 'g') AS bare FROM r)
SELECT c_custkey, CASE WHEN regexp_matches(bare, {quoted(emails.FORMAT)}) THEN bare END AS cleaned,
  regexp_replace(regexp_replace(replace(replace(replace(lower(trim(raw)), 'remove-this.', ''), '-remove-this', ''), 'removethis', ''), '\\.nl[a-z]+$', '.nl'), '\\.com[a-z]+$', '.com') AS upload FROM b""")
def email_clean_chain(t: Tables):
    """Cleaning of broken addresses."""
    r = t.customer.select("c_custkey", F.expr(RAW).alias("raw"))
    return r.select("c_custkey", emails.clean(F.col("raw")).alias("cleaned"), emails.repair_for_upload(F.col("raw")).alias("upload"))


def chain(column: str, rules, flags: str) -> str:
    for pattern, new in rules:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, {quoted(flags)})"
    return column


def stripped(c: str, chars: str = r"\s") -> str:
    return f"regexp_replace({c}, '^[{chars}]+|[{chars}]+$', '', 'g')"


#: The repairs for an engine without look-ahead: what follows is taken along and put back.
LOOKLESS = []
for _pattern, _new in emails.REPAIRS:
    if "(?=" in _pattern:  # what follows is taken along and put back
        _group = _pattern.count("(") - _pattern.count("(?") - _pattern.count("\\(") + 1
        _pattern, _new = _pattern.replace("(?=", "("), _new + f"${_group}"
    LOOKLESS.append((_pattern, _new))
REPAIRED = f"lower({stripped(chain(stripped('c'), LOOKLESS, 'gi'))})"
REPAIRED = f"regexp_replace({REPAIRED}, '^[.,;:() ]+|[.,;:() ]+$', '', 'g')"


@book.add(f"""
WITH r AS (SELECT c_custkey, {RAW} AS raw FROM customer), f AS (SELECT c_custkey, raw, raw AS c FROM r), g AS (SELECT c_custkey, raw, {REPAIRED} AS fixed FROM f),
v AS (SELECT *, CASE WHEN regexp_matches(fixed, {quoted(emails.STRICT_FORMAT)}) THEN fixed ELSE '' END AS repaired FROM g)
SELECT c_custkey, repaired, repaired <> raw AS changed, CASE WHEN length(repaired) > 5 THEN 2 ELSE 0 END AS n_in_cell FROM v""")
def email_repair(t: Tables):
    """The repair chain, and rows that it changes."""
    r = t.customer.select("c_custkey", F.expr(RAW).alias("raw"))
    fixed = emails.repair(F.col("raw"))
    return r.select("c_custkey", fixed.alias("repaired"), (fixed != F.col("raw")).alias("changed"), F.size(emails.split_cell(F.concat_ws("; ", "raw", "raw"))).alias("n_in_cell"))


_issues = ", ".join(f"CASE WHEN regexp_matches(e, {quoted(p)}) THEN '{n}' END" for n, p in emails.SIGNS.items())
_prefix = "0"
for _p, _v in reversed(emails.PREFIX_RANK.items()):
    _prefix = f"CASE WHEN starts_with(split_part(lower(e), '@', 1), '{_p}') THEN {_v} ELSE {_prefix} END"


@book.add(f"""
WITH r AS (SELECT c_custkey, {RAW} AS e FROM customer), i AS (SELECT *, list_filter([{_issues}], lambda x: x IS NOT NULL) AS issues FROM r)
SELECT c_custkey, coalesce(list_aggregate(issues, 'string_agg', ', '), '') AS issues, CASE WHEN NOT regexp_matches(e, {quoted(emails.GRADED_FORMAT)}) THEN 'INVALID' WHEN len(issues) > 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS grade, {_prefix} AS prefix_rank FROM i""")
def email_quality(t: Tables):
    """Signs of broken addresses, their grade, and the rank of the name."""
    r = t.customer.select("c_custkey", F.expr(RAW).alias("e"))
    e = F.col("e")
    return r.select("c_custkey", F.array_join(emails.issues(e), ", ").alias("issues"), emails.grade(e).alias("grade"), emails.prefix_rank(e).alias("prefix_rank"))


@book.add("""
WITH v AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'deliverable' WHEN 'O' THEN 'risky' ELSE 'unknown' END AS result, CAST(o_orderkey % 100 AS INTEGER) AS score FROM orders)
SELECT o_orderkey, CASE WHEN result = 'deliverable' THEN 'SEND' WHEN result = 'risky' AND score >= 60 THEN 'TEST' ELSE 'SKIP' END AS status, CASE result WHEN 'deliverable' THEN 4 WHEN 'unknown' THEN 3 WHEN 'risky' THEN 2 ELSE 1 END AS rank FROM v""")
def campaign_status(t: Tables):
    """What to do with an address by its validation."""
    s = F.col("o_orderstatus")
    v = t.orders.select("o_orderkey", F.when(s == "F", "deliverable").when(s == "O", "risky").otherwise("unknown").alias("result"), (F.col("o_orderkey") % 100).alias("score"))
    return v.select("o_orderkey", emails.campaign_status(F.col("result"), F.col("score")).alias("status"), emails.result_rank(F.col("result")).alias("rank"))


@book.add("""
WITH h AS (SELECT page_id, url, regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]+)', 1) AS host FROM pages)
SELECT page_id, host, regexp_replace(host, '^www\\.', '') AS domain, regexp_replace(regexp_replace(lower(trim(url)), '^(?:https?://)?(?:www\\.)?', ''), '/+$', '') AS match_key, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS page FROM h""")
def url_normalize(t: Tables):
    """Hosts, domains and keys of URLs."""
    u = F.col("url")
    return t.pages.select("page_id", urls.host(u).alias("host"), urls.domain(u).alias("domain"), urls.match_key(u).alias("match_key"), urls.page(u).alias("page"))


LINKS = """
raw AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)', 1)) AS link FROM pages),
links AS (SELECT DISTINCT page_id, link FROM raw WHERE NOT regexp_matches(lower(link), '^(#|javascript:|mailto:)'))"""


@book.add(f"WITH {LINKS} SELECT page_id, link FROM links")
def link_extract(t: Tables):
    """Links of pages."""
    return t.pages.select("page_id", F.explode(urls.links(F.col("html"))).alias("link"))


_score = " + ".join(f"CASE WHEN contains(low, '{w}') THEN {p} ELSE 0 END" for p, ws in urls.LINK_WORDS.items() for w in ws)


@book.add(f"""
WITH {LINKS}, s AS (SELECT page_id, link, lower(link) AS low, {_score.replace("low", "lower(link)")} AS words FROM links)
SELECT page_id, link, CASE WHEN contains(low, '/products/') OR contains(low, '/collections/') THEN 0 ELSE words + CASE WHEN words > 0 AND (contains(low, '/pages/') OR contains(low, '/policies/')) THEN 50 ELSE 0 END END AS score FROM s""")
def link_score(t: Tables):
    """Links by how likely they lead to a contact."""
    links = t.pages.select("page_id", F.explode(urls.links(F.col("html"))).alias("link"))
    return links.select("page_id", "link", urls.link_score(F.col("link")).alias("score"))


_text = "regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
_plain = "regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs')"
for _d in html.DROPPED:
    _plain = f"regexp_replace({_plain}, '<{_d}\\b.*?</{_d}>', ' ', 'gis')"
_plain = f"regexp_replace({_plain}, '<[^>]*>', ' ', 'g')"
for _e, _c in html.ENTITIES.items():
    _text, _plain = (f"replace({x}, {quoted(_e)}, {quoted(_c)})" for x in (_text, _plain))


@book.add(f"SELECT page_id, regexp_replace(regexp_replace({_plain}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM pages")
def html_to_text(t: Tables):
    """H1 H4: text of pages."""
    return t.pages.select("page_id", html.to_text(F.col("html")).alias("plain"))


@book.add("""
SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS title, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS n_headings FROM pages""")
def html_metadata(t: Tables):
    """H5: titles and headings."""
    return t.pages.select("page_id", html.title(F.col("html")).alias("title"), F.size(html.headings(F.col("html"))).cast("long").alias("n_headings"))


@book.add(f"""
SELECT page_id, CASE WHEN {has_any("lower(html)", html.DYNAMIC)} THEN 'dynamic' WHEN {has_any("lower(html)", html.STATIC)} THEN 'static' ELSE 'unknown' END AS site_type FROM pages""")
def site_type(t: Tables):
    """H7: static, dynamic or unknown."""
    return t.pages.select("page_id", html.site_type(F.col("html")).alias("site_type"))


@book.add(f"""
WITH i AS (SELECT page_id, CASE WHEN length(regexp_replace({_text}, '^\\s+|\\s+$', '', 'g')) < 200 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(html), '<div[^>]*id=["''](root|app)["'']') THEN 1 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(lower(html), '<script')) > 10 THEN 1 ELSE 0 END + CASE WHEN {has_any("lower(html)", ("react", "vue", "angular"))} THEN 1 ELSE 0 END AS n FROM pages)
SELECT page_id, CASE WHEN n >= 2 THEN 'dynamic' ELSE 'static' END AS kind, round(CASE WHEN n >= 2 THEN least(n * 0.3::DOUBLE, 1.0::DOUBLE) ELSE 1.0::DOUBLE - n * 0.2::DOUBLE END, 4) AS confidence FROM i""")
def site_confidence(t: Tables):
    """H8: type by signs, with confidence."""
    c = t.pages.select("page_id", html.site_confidence(html.site_indicators(F.col("html"))).alias("c"))
    return c.select("page_id", F.col("c.type").alias("kind"), F.round("c.confidence", 4).alias("confidence"))


@book.add(f"""
WITH s AS (SELECT page_id, lower(html) AS low, {_text} AS body FROM pages),
p AS (SELECT page_id, CASE WHEN length(body) > 2000 THEN 30 WHEN length(body) > 500 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(low, '<h[123][ >]') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(low, '<p[ >]') THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(low, '<(nav|a)[ >]') THEN 10 ELSE 0 END + {" + ".join(f"CASE WHEN contains(lower(body), '{w}') THEN 3 ELSE 0 END" for w in html.BUSINESS_WORDS)} AS score FROM s)
SELECT page_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS quality FROM p""")
def content_quality(t: Tables):
    """H9: points for content."""
    score = html.quality_score(F.col("html"))
    return t.pages.select("page_id", score.alias("score"), html.quality_level(score).alias("quality"))


@book.add(f"""
SELECT page_id, {" + ".join(f"CASE WHEN contains(lower(html), '{f}') THEN 25 ELSE 0 END" for f in html.FRAMEWORKS)} + CASE WHEN {has_any("lower(html)", html.LOADING)} THEN 10 ELSE 0 END
  + CASE WHEN {has_any("lower(html)", ("loading...", "spinner"))} THEN 15 ELSE 0 END + CASE WHEN {has_any("lower(html)", html.PROTECTION)} THEN 30 ELSE 0 END AS risk FROM pages""")
def js_risk(t: Tables):
    """How far a page depends on scripts."""
    return t.pages.select("page_id", html.js_risk(F.col("html")).alias("risk"))


@book.add("SELECT doc_id, lang, CASE " + " ".join(f"WHEN {has_any('lower(text)', ws)} THEN '{k}'" for k, ws in html.LANGUAGE_WORDS.items()) + " ELSE 'en' END AS guess FROM documents")
def language_guess(t: Tables):
    """Language by function words."""
    return t.documents.select("doc_id", "lang", html.language(F.col("text")).alias("guess"))


@book.add("""
SELECT doc_id, CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') || '...' ELSE array_to_string(w, ' ') END AS start
FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ') AS w FROM documents)""")
def text_truncate(t: Tables):
    """The first words of a text."""
    return t.documents.select("doc_id", html.first_words(F.col("text"), 12).alias("start"))


@book.add("""
SELECT p_partkey, CASE WHEN contains(n, 'ring') THEN false WHEN contains(n, 'widget') THEN true WHEN k = 'PROMO' THEN false WHEN k IN ('ECONOMY', 'LARGE') AND p_size < 20 THEN false WHEN k IN ('ECONOMY', 'LARGE') THEN true ELSE false END AS keep,
  CASE WHEN contains(n, 'ring') THEN 'excluded_name_keyword: ring' WHEN contains(n, 'widget') THEN 'included_name_keyword: widget' WHEN k = 'PROMO' THEN 'excluded_type: PROMO' WHEN k IN ('ECONOMY', 'LARGE') AND p_size < 20 THEN 'low_rating'
  WHEN k IN ('ECONOMY', 'LARGE') THEN 'included_type: ' || k ELSE 'no_matching_criteria' END AS reason FROM (SELECT p_partkey, lower(p_name) AS n, p_type AS k, p_size FROM part)""")
def rule_filter_reason(t: Tables):
    """rules in order of precedence, with the one that decided."""
    kept = rules.include(F.col("p_name"), F.array("p_type"), F.col("p_size"), ["ring"], ["widget"], ["PROMO"], ["ECONOMY", "LARGE"], 20)
    return t.part.select("p_partkey", kept.alias("r")).select("p_partkey", "r.keep", "r.reason")


@book.add("""
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'bolt') AND p_type <> 'PROMO' THEN 'fastener' WHEN contains(lower(p_name), 'gear') THEN 'machine' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'by_size' ELSE 'community_organization' END AS category FROM part""")
def categorize(t: Tables):
    """Fixture: the first rule that fits gives the category."""
    n, k = F.lower("p_name"), F.col("p_type")
    table = [(n.contains("bolt") & (k != "PROMO"), "fastener"), (n.contains("gear"), "machine"), (k.isin("SMALL", "MEDIUM"), "by_size")]
    return t.part.select("p_partkey", rules.first_match(table, "community_organization").alias("category"))


@book.add("""
SELECT CASE WHEN p_size IS NULL OR s = 0 THEN 'Unknown' WHEN s <= 10 THEN 'Micro' WHEN s <= 50 THEN 'Small' ELSE 'Enterprise' END AS band, count(*) AS n FROM (SELECT *, p_size * (p_partkey % 3) AS s FROM part) GROUP BY 1""")
def size_bands(t: Tables):
    """Bands of a number."""
    return t.part.groupBy(rules.size_band(F.col("p_size") * (F.col("p_partkey") % 3)).alias("band")).agg(F.count("*").alias("n"))


@book.add("""
SELECT c_custkey, least(100, CASE WHEN r >= 500000 THEN 30 WHEN r >= 300000 THEN 25 WHEN r >= 180000 THEN 20 WHEN r >= 100000 THEN 15 ELSE 0 END
  + CASE WHEN e BETWEEN 20 AND 50 THEN 20 WHEN e BETWEEN 15 AND 25 THEN 18 WHEN e BETWEEN 10 AND 20 THEN 15 WHEN e BETWEEN 5 AND 15 THEN 10 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 15 ELSE 0 END) AS score
FROM (SELECT *, c_acctbal * 60 AS r, c_custkey % 60 AS e FROM customer)""")
def lead_score(t: Tables):
    """Fixture: points of several kinds, a hundred at most."""
    points = rules.revenue_points(F.col("c_acctbal") * 60) + rules.employee_points(F.col("c_custkey") % 60) + F.when(F.col("c_mktsegment") == "MACHINERY", 15).otherwise(0)
    return t.customer.select("c_custkey", F.least(F.lit(100), points).alias("score"))


@book.add("""
SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:3], ' ') AS casual, CASE WHEN length(p_name) > 40 THEN p_name[1:40] ELSE p_name END AS short, 'Dear ' || p_name || ' of ' || p_brand AS greeting FROM part""")
def name_casual(t: Tables):
    """Names for use in a text, and a template."""
    n = F.col("p_name")
    return t.part.select("p_partkey", names.casual(n).alias("casual"), names.short(n).alias("short"), names.render("Dear {name} of {brand}", {"name": n, "brand": F.col("p_brand")}).alias("greeting"))


_COS = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


@book.add(f"SELECT vec_id, label, {_COS} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20")
def cosine_topk(t: Tables):
    """Fixture: the vectors most like one of them."""
    query = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    return similarity.most_similar(t.embeddings, query, 20).select("vec_id", "label", "similarity")


@book.add(f"""
WITH k AS (SELECT vec_id, label, {_COS} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20)
SELECT label, count(*) AS n, max(similarity) AS best, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM k GROUP BY 1""")
def cosine_group(t: Tables):
    """Fixture: the best vectors by label."""
    query = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    members = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), ",")
    return similarity.most_similar(t.embeddings, query, 20).groupBy("label").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), members.alias("members"))


_EACH = """
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 20)"""


def _each_of_50(t: Tables):
    found = similarity.most_similar_each(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), 20)
    return found.join(t.embeddings.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "similarity")


@book.add(f"{_EACH} SELECT query_id, vec_id, label, similarity FROM k")
def cosine_topk_each(t: Tables):
    """The vectors most like each one whose id is divisible by 50."""
    return _each_of_50(t)


@book.add(f"{_EACH} SELECT query_id, vec_id, label, similarity FROM k")
def cosine_topk_pruned(t: Tables):
    """The vectors most like each one whose id is divisible by 50, without the blocks that can't hold one."""
    found = similarity.most_similar_pruned(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), 20)
    return found.join(t.embeddings.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "similarity")


@book.add(f"{_EACH} SELECT query_id, label, count(*) AS n, max(similarity) AS best, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM k GROUP BY 1, 2")
def cosine_group_each(t: Tables):
    """The best vectors of each query by label."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), ",")
    return _each_of_50(t).groupBy("query_id", "label").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), members.alias("members"))


@book.add("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_props(t: Tables):
    """Fixture: fields of JSON text."""
    fields = html.fenced_json(F.col("props"))
    return t.events.select("event_id", F.try_element_at(fields, F.lit("k")).cast("int").alias("k"), F.try_element_at(fields, F.lit("absent")).alias("absent"))


@book.add("SELECT c_custkey, CASE WHEN length(trim(c_mktsegment)) > 0 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS n_present FROM customer")
def overflow_map(t: Tables):
    """Fixture: columns beyond the core as a map without blanks."""
    c = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return reshape.overflow(c, ["c_custkey"]).select("c_custkey", F.size("extra").alias("n_present"))


@book.add("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_events(t: Tables):
    """Events by day and type."""
    w = resume.windowed_counts(t.events)
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@book.add("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def stream_resume(t: Tables):
    """Rows that an earlier run has not processed."""
    done = t.events.select((F.col("event_id") * 3).alias("event_id"))
    return resume.not_processed(t.events.select("event_id", "event_type"), done, "event_id")
