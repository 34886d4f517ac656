"""HTML and text as column expressions: plain text, metadata, site type, content quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.emails import strip

DROPPED = ("script", "style", "nav", "footer", "header", "aside", "iframe")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# Fixed values of the site checks, as substrings of the page in lower case.
DYNAMIC = ("react", "vue", "angular", "next.js", "nuxt", "app.js", "bundle.js", "main.js", '<div id="root"', '<div id="app"', "ng-app", "v-app", "data-react")
STATIC = ("<html", "<body", "<p>", "<div>")
FRAMEWORKS = ("react", "angular", "vue", "ember", "backbone")
LOADING = ("document.addeventlistener", "window.onload", "ajax", "fetch(", "xmlhttprequest", "loadmore", "infinite-scroll")
PROTECTION = ("cloudflare", "captcha", "bot detection", "access denied")
BUSINESS_WORDS = ("about", "services", "contact", "team", "products", "solutions")
LANGUAGE_WORDS = {
    "de": ("der ", "die ", "das ", "und ", "für "),
    "fr": ("le ", "la ", "les ", "et ", "pour "),
    "nl": ("de ", "het ", "een ", "van ", "voor "),
    "ru": ("на ", "по ", "из ", "для "),
    "sr": ("na ", "po ", "od ", "za "),
}


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def all_text(html: Column) -> Column:
    """Every tag and comment a space, scripts and styles with what they hold; common entities decoded."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return _decoded(F.regexp_replace(bare, r"<[^>]*>", " "))


def to_text(html: Column, most: int | None = None) -> Column:
    """Text without scripts, styles, navigation, header, footer, asides and frames; white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = collapse(_decoded(F.regexp_replace(bare, r"<[^>]*>", " ")))
    return F.substring(text, 1, most) if most else text


def _decoded(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def title(html: Column) -> Column:
    return F.nullif(collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"(?is)<meta\s+name=[\"']{name}[\"']\s+content=[\"']([^\"']*)", 1), F.lit(""))


def headings(html: Column) -> Column:
    """(level, text) of each heading, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), collapse(F.regexp_replace(h, "<[^>]*>", " ")).alias("text")))


def site_type(html: Column) -> Column:
    """dynamic with any sign of a script framework, else static with any plain markup, else unknown."""
    low = F.lower(html)
    return F.when(any_of(low, DYNAMIC), "dynamic").when(any_of(low, STATIC), "static").otherwise("unknown")


def site_indicators(html: Column) -> Column:
    """Signs of a page that scripts build: little text, a root element, over ten scripts, a framework's name."""
    low = F.lower(html)
    return F.array_compact(
        F.array(
            F.when(F.length(strip(all_text(html))) < 200, "low_text_content"),
            F.when(low.rlike("<div[^>]*id=[\"'](root|app)[\"']"), "spa_root_element"),
            F.when(F.regexp_count(low, F.lit("<script")) > 10, "many_scripts"),
            F.when(any_of(low, ("react", "vue", "angular")), "js_framework_detected"),
        )
    )


def site_confidence(indicators: Column) -> Column:
    """(type, confidence): dynamic from two signs on."""
    n = F.size(indicators)
    return F.struct(F.when(n >= 2, "dynamic").otherwise("static").alias("type"), F.when(n >= 2, F.least(n * F.lit(0.3).cast("double"), F.lit(1.0).cast("double"))).otherwise(F.lit(1.0).cast("double") - n * F.lit(0.2).cast("double")).alias("confidence"))


def quality_score(html: Column) -> Column:
    """Points for long text, headings, paragraphs, links and business words."""
    low, text = F.lower(html), all_text(html)
    size = F.length(text)
    words = sum((F.when(F.lower(text).contains(w), 3).otherwise(0) for w in BUSINESS_WORDS), F.lit(0))
    score = F.when(size > 2000, 30).when(size > 500, 15).otherwise(0) + F.when(low.rlike("<h[123][ >]"), 20).otherwise(0)
    return score + F.when(low.rlike("<p[ >]"), 15).otherwise(0) + F.when(low.rlike("<(nav|a)[ >]"), 10).otherwise(0) + words


def quality_level(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def js_risk(html: Column) -> Column:
    """Points for each framework, and once each for loading by scripts, placeholders and bot protection."""
    low = F.lower(html)
    once = lambda words, points: F.when(any_of(low, words), points).otherwise(0)
    return sum((F.when(low.contains(f), 25).otherwise(0) for f in FRAMEWORKS), F.lit(0)) + once(LOADING, 10) + once(("loading...", "spinner"), 15) + once(PROTECTION, 30)


def language(text: Column) -> Column:
    """The first language one of whose function words the text contains, else English."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda c, x: F.when(any_of(low, x[1]), x[0]).otherwise(c), reversed(LANGUAGE_WORDS.items()), F.lit("en"))


def first_words(text: Column, n: int, mark: str = "...") -> Column:
    parts = F.split(collapse(text), " ")
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit(mark))).otherwise(F.array_join(parts, " "))


def sentences_with(text: Column, pattern: str, scan: int = 20, keep: int = 3, most: int = 200) -> Column:
    """Of the first ``scan`` sentences the first ``keep`` that match, each cut to ``most`` characters."""
    first = F.slice(F.split(F.coalesce(text, F.lit("")), r"\."), 1, scan)
    return F.transform(F.slice(F.filter(first, lambda s: s.rlike(pattern)), 1, keep), lambda s: F.substring(F.trim(s), 1, most))


def fenced_json(text: Column) -> Column:
    """Key to value of the object in a fenced JSON block, else of the whole text; null where neither is an object."""
    block = F.nullif(F.regexp_extract(text, r"(?s)```json\s*\n(.*?)\n```", 1), F.lit(""))
    return F.from_json(F.coalesce(block, text), "map<string,string>")


# Roles that stand beside a name.
ROLE = "CEO|CTO|CMO|VP|Director|Manager|Founder"
# Fields of a written answer and where they stand.
ANSWER_FIELDS = {
    "dreamICP": r"I'm around (.*?) daily",
    "painTheySolve": r"they keep saying they (.*?)(?:\.|$)",
    "clean_company_name": r"Noticed (.*?) helps",
    "job_titles": r"helps (.*?) at",
    "company_type": r"at (.*?) —",
    "pain_description": r"I know a few who (.*?)(?:\.|$)",
}
DREAM_OTHERWISE = r"I talk to a lot of (.*?) and they"


def main_content(html: Column) -> Column:
    """Plain text of the first of main, article and body that a page has, else of the whole."""
    inner = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    return to_text(F.coalesce(inner("main"), inner("article"), inner("body"), html))


def recommended(accessible: Column, quality: Column, risk: Column, protected: Column) -> Column:
    """(method, confidence) of reading a site, from whether it answers, its content, and how far scripts build it."""
    d = lambda x: F.lit(x).cast("double")
    raw = d(0.5) + F.when(quality == "high", d(0.3)).when(quality == "medium", d(0.1)).otherwise(d(-0.2)) + F.when(risk >= 50, d(-0.4)).when(risk >= 25, d(-0.2)).otherwise(d(0.2))
    clamped = F.greatest(d(0.1), F.least(d(0.95), raw))
    confidence = F.when(~accessible, d(0.9)).when(protected, d(0.95)).otherwise(F.round(clamped, 4))
    method = F.when(~accessible | protected, "apify").when(F.round(clamped, 4) >= 0.4, "http").otherwise("apify")
    return F.struct(method.alias("method"), confidence.alias("confidence"))


def contacts(text: Column) -> Column:
    """(name, role) of the first three of each order, role before name and name before role."""
    name = r"[A-Z][a-z]+\s+[A-Z][a-z]+"
    each = lambda p, a, b: F.arrays_zip(F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(a)), 1, 3).alias("name"), F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(b)), 1, 3).alias("role"))
    return F.concat(each(rf"({ROLE})\s+({name})", 2, 1), each(rf"({name}),?\s+({ROLE})", 1, 2))


def answer_fields(text: Column) -> Column:
    """Field to what stands in its place, for those that are there."""
    value = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    found = {k: value(p) for k, p in ANSWER_FIELDS.items()}
    found["dreamICP"] = F.coalesce(found["dreamICP"], value(DREAM_OTHERWISE))
    return F.map_filter(F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def failure(message: Column) -> Column:
    """Why a page gave nothing, from its error message."""
    m, low = F.coalesce(message, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.contains("no_email_found_static"), "no_email_found_static")
        .when(m.contains("no_email_found_dynamic"), "no_email_found_dynamic")
        .when(low.contains("timeout"), "connection_timeout")
        .when(m.contains("404") | low.contains("not found"), "page_not_found")
        .when(m != "", m)
        .otherwise("unknown_error")
    )


def plain_words(text: Column) -> Column:
    """Words of two characters or more that are neither up to three digits nor one character repeated, one space between."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>|https?://\S+|\S+@\S+", " "), r"[^\p{L}\p{N}\s.,!?'-]", " ")
    words = F.filter(F.split(collapse(bare), " "), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d{1,3}$") & (F.replace(w, F.substring(w, 1, 1), F.lit("")) != ""))
    return F.array_join(words, " ")


def dense_words(text: Column, longest: int = 20) -> Column:
    """``plain_words`` without code, hashes and words of over ``longest`` characters, and without a word right behind itself."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\{[^{}]*\}|\b[0-9a-f]{16,}\b|function\s*\([^)]*\)", " ")
    words = F.filter(F.split(plain_words(bare), " "), lambda w: F.length(w) <= longest)
    apart = lambda ws: F.filter(ws, lambda w, i: (i == 0) | (w != F.coalesce(F.get(ws, i - 1), F.lit(""))))
    # Words as the one element of a list, so that they are made once and not again for each word.
    return F.array_join(F.flatten(F.transform(F.array(words), apart)), " ")
