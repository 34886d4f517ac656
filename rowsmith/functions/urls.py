"""URLs, addresses and phone numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.emails import strip

# Words in a URL and what each adds to its score; words that overlap all add.
LINK_WORDS = {
    100: ("contact", "contactus", "contact-us", "kontakt", "contacto", "contatto", "get-in-touch", "reach-us", "contact-information", "contact-info"),
    80: ("about", "aboutus", "about-us", "our-story", "policies", "policy", "info", "information"),
    60: ("team", "staff", "leadership", "management", "support", "help", "customer-service", "customer-support"),
    40: ("quote", "quotes", "request-quote", "get-quote", "location", "locations", "find-us", "directions", "schedule", "appointment", "inquiry", "enquiry"),
    20: ("office", "offices", "branch", "call", "phone", "email", "mail", "message", "feedback", "corporate", "business", "partner", "press", "media"),
    10: ("services", "faq", "helpdesk", "book", "reservation"),
}
# Hosts of social networks.
SOCIAL = ("facebook.com", "instagram.com", "twitter.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com")


def with_scheme(url: Column) -> Column:
    """``https://`` before a URL without a scheme; blank is null."""
    bare = F.nullif(strip(url), F.lit(""))
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(strip(url)), r"^(?:https?://)?([^/?#:]+)", 1), F.lit(""))


def domain(url: Column) -> Column:
    """The host without a leading ``www.`` and port; null for blank."""
    return F.regexp_replace(host(url), r"^www\.", "")


def match_key(url: Column) -> Column:
    """For joins: lower case, without scheme, ``www.`` and slashes at the end; blank is null and matches nothing."""
    bare = F.regexp_replace(F.lower(strip(url)), r"^(?:https?://)?(?:www\.)?", "")
    return F.nullif(F.regexp_replace(bare, "/+$", ""), F.lit(""))


def key(value: Column) -> Column:
    """Any key: trimmed, lower case, blank is null."""
    return F.nullif(F.lower(strip(value)), F.lit(""))


def page(url: Column) -> Column:
    """Without fragment, query and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def variants(url: Column) -> Column:
    """The four spellings by scheme and ``www.``, distinct and in order."""
    d = domain(url)
    return F.array_distinct(F.array(*(F.concat(F.lit(p), d) for p in ("https://", "https://www.", "http://", "http://www."))))


def links(html: Column) -> Column:
    """Targets of all links but fragments, scripts and mail addresses, distinct and in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)href=[\"']([^\"']+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: ~F.lower(u).rlike("^(#|javascript:|mailto:)")))


def social_links(html: Column) -> Column:
    return F.filter(links(html), lambda u: F.lower(u).rlike("|".join(s.replace(".", r"\.") for s in SOCIAL)))


def link_score(url: Column) -> Column:
    """Sum of the words in a URL, and 50 more on a ``/pages/`` or ``/policies/`` path; 0 for product pages."""
    low = F.lower(url)
    total = sum((F.when(low.contains(w), points).otherwise(0) for points, words in LINK_WORDS.items() for w in words), F.lit(0))
    paths = low.contains("/pages/") | low.contains("/policies/")
    product = low.contains("/products/") | low.contains("/collections/")
    return F.when(product, 0).otherwise(total + F.when((total > 0) & paths, 50).otherwise(0))


def city(address: Column) -> Column:
    """The third part from the end of an address with three parts or more."""
    parts = F.split(address, ",")
    return F.when(F.size(parts) >= 3, F.trim(F.element_at(parts, -3)))


def phones(text: Column) -> Column:
    """US phone numbers, sorted and distinct."""
    find = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))
    return F.array_sort(F.array_union(F.array_union(find(r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"), find(r"\d{3}[-.\s]\d{3}[-.\s]\d{4}")), find(r"\d{10}")))


def sitemap_locations(xml: Column) -> Column:
    """Locations in a sitemap, of either form and any namespace prefix."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)), strip)


def robots_sitemaps(text: Column) -> Column:
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"(?i)^\s*sitemap:"))
    return F.transform(found, lambda line: strip(F.regexp_replace(line, r"(?i)^\s*sitemap:", "")))


# Words of a path that speak for a page and against it, and those of main pages.
GOOD_PATHS = ("about", "services", "solutions", "products", "team", "company", "case-studies", "portfolio", "work", "projects", "contact")
BAD_PATHS = ("privacy", "terms", "legal", "login", "account", "cart", "checkout", "api", "docs", "support", "help", "blog", "news", "careers", "jobs", "employment", "author", "category", "tag")
MAIN_PATHS = ("services", "solutions", "about", "contact")
# Groups of words of a path, the most telling first.
PAGE_GROUPS = (
    ("about-us", "about_us", "aboutus", "about"),
    ("about-me", "about_me", "aboutme"),
    ("approach", "methodology", "process"),
    ("our-story", "our_story", "story"),
    ("team", "leadership", "founders"),
    ("company", "company-info"),
    ("services", "what-we-do"),
    ("mission", "values", "culture"),
    ("careers", "jobs", "work-with-us"),
)
FINE_GROUPS = (
    ("about-us", "about_us", "aboutus"),
    ("about-me", "about_me", "aboutme"),
    ("about-company", "about-the-company", "company-info"),
    ("about",),
    ("our-story", "our_story", "story"),
    ("team",),
    ("leadership",),
    ("founders",),
    ("company",),
    ("mission",),
    ("values",),
    ("history",),
    ("who-we-are", "who_we_are"),
    ("home", "homepage"),
    ("services",),
    ("what-we-do", "what_we_do"),
)
# Files and paths that are no pages, and states by what a city ends in.
ASSETS = (".css", ".js", ".png", ".jpg", ".gif", ".ico", ".svg", ".pdf", ".xml")
SERVICE_PATHS = ("wp-json", "xmlrpc", "platform-api")
SKIPPED_FILES = (".pdf", ".doc", ".docx", ".zip", ".exe", ".jpg", ".png", ".gif")
STATES = {", TX": "texas", ", FL": "florida", ", NY": "new_york", ", IL": "illinois", ", MI": "michigan", ", PA": "pennsylvania"}
AU_PHONE = r"\b(?:\+?61|0)[2-478](?:[ -]?[0-9]){8}\b"


def _has(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def path(url: Column) -> Column:
    """The path in lower case, empty for none."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))


def page_value(url: Column) -> Column:
    """Points of a page by its path: good and bad words, main pages, and how deep it lies."""
    p = path(url)
    depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    score = sum((F.when(p.contains(w), 10).otherwise(0) for w in GOOD_PATHS), F.lit(0)) - sum((F.when(p.contains(w), 20).otherwise(0) for w in BAD_PATHS), F.lit(0))
    score = score + F.when(depth == 1, 5).when(depth == 2, 2).when(depth > 3, -3).otherwise(0)
    return score + F.when(_has(p, MAIN_PATHS), 5).otherwise(0)


def page_group(url: Column, groups=PAGE_GROUPS) -> Column:
    """Number of the first group of words that the path has; null without any."""
    p, out = path(url), F.lit(None).cast("int")
    for k, words in reversed(list(enumerate(groups))):
        out = F.when(_has(p, words), k).otherwise(out)
    return out


def internal(link: Column, base_url: Column) -> Column:
    """A link of a page of ``base_url`` as a whole URL of that site with ``www.``, without query and fragment; null for others."""
    base, low = domain(base_url), F.lower(link)
    home = F.concat(F.lit("https://"), base)
    whole = (
        F.when(low.rlike("^(#|mailto:|tel:|javascript:|data:|ftp:)"), None)
        .when(low.rlike("^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(home, link))
        .when(link.rlike(r"[?#]|javascript") | ~link.rlike(r"[./]"), None)
        .otherwise(F.concat(home, F.lit("/"), link))
    )
    bare = F.regexp_replace(F.regexp_replace(whole, r"[?#].*$", ""), "/+$", "")
    ours = F.contains(F.lower(whole), base) & ~_has(F.lower(bare), (*ASSETS, *SERVICE_PATHS))
    www = F.when(bare.contains("//www."), bare).otherwise(F.replace(bare, F.concat(F.lit("://"), base), F.concat(F.lit("://www."), base)))
    return F.when(ours, www)


def crawlable(link: Column, base_url: Column) -> Column:
    """Whether a URL is of the same host, no file of a kind that is skipped, and of a scheme for pages."""
    low = F.lower(link)
    return F.coalesce((host(link) == host(base_url)) & link.rlike("(?i)^https?://") & ~low.rlike("(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_FILES) + ")$"), F.lit(False))


def short_place(address: Column) -> Column:
    """City and state of an address of three parts or more, else its first 30 characters."""
    parts = F.split(address, ",")
    state = F.regexp_extract(F.trim(F.element_at(parts, -2)), r"^(\S*)", 1)
    return F.when(F.size(parts) >= 3, F.concat(F.trim(F.element_at(parts, -3)), F.lit(", "), state)).otherwise(F.substring(address, 1, 30))


def state(place: Column) -> Column:
    out = F.lit("unknown")
    for mark, name in reversed(STATES.items()):
        out = F.when(place.contains(mark), name).otherwise(out)
    return out


def country(address: Column) -> Column:
    """The last part of an address of two parts or more."""
    return F.nullif(F.trim(F.regexp_extract(address, r",([^,]*)$", 1)), F.lit(""))


def stamped(url: Column, seconds: Column) -> Column:
    """With a parameter that says where to begin."""
    return F.concat(url, F.when(url.contains("?"), "&t=").otherwise("?t="), seconds.cast("string"), F.lit("s"))


def own_website(text: Column, name: Column, excluded=SOCIAL) -> Column:
    """The first host in a text with a longer word of the name, else the first; no network and no directory."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://(?:www\.)?([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+)"), F.lit(1)), F.lower)
    found = F.filter(found, lambda d: ~_has(d, excluded))
    words = F.filter(F.split(F.replace(F.lower(name), F.lit("&"), F.lit("")), r"\s+"), lambda w: F.length(w) > 3)
    named = F.filter(found, lambda d: ~_has(d, ("directory", "listing", "review", "find")) & F.exists(words, lambda w: d.contains(w)))
    return F.concat(F.lit("https://"), F.coalesce(F.get(named, F.lit(0)), F.get(found, F.lit(0))))


def sitemap(xml: Column) -> Column:
    """(maps, pages): the maps that an index file names, or the pages of a map; of any name space or none, empty for what is no XML."""
    held = F.from_xml(xml, "sitemap array<struct<loc: string>>, url array<struct<loc: string>>", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    maps = some(held["sitemap"]["loc"])
    return F.struct(maps.alias("maps"), F.when(F.size(maps) == 0, some(held["url"]["loc"])).otherwise(F.array().cast("array<string>")).alias("pages"))


def bare_domain(url: Column) -> Column:
    """The host in lower case, without port and without "www." anywhere; a scheme is added where there is none. Blank has none."""
    low = F.lower(F.trim(url))
    full = F.when(low.rlike("^https?://"), low).otherwise(F.concat(F.lit("https://"), low))
    return F.when(low != "", F.replace(F.regexp_extract(full, "^https?://([^/:?#]*)", 1), F.lit("www."), F.lit("")))
