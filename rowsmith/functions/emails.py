"""E-mail addresses as column expressions: cleaning, extraction, validation, grading and ranking.

All functions take and return columns, stay in the JVM, and give null (or an empty list) for null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top-level domains that count as real. The last line adds generic ones that cutting would damage.
TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int",
    "de", "uk", "fr", "it", "es", "nl", "pl", "ch", "at", "be", "cz", "dk", "fi", "gr",
    "hu", "ie", "no", "pt", "ro", "ru", "se", "sk", "si", "hr", "bg", "ee", "lt", "lv",
    "lu", "mt", "cy", "is", "li", "mc", "rs", "ua", "us", "ca", "au", "nz", "jp", "cn",
    "in", "br", "mx", "ar", "cl",
    "io", "co", "ai", "xyz", "online", "site", "tech", "store", "app", "eu", "asia", "africa",
    "info", "biz",
]
LONGEST_FIRST = sorted(TLDS, key=lambda t: (-len(t), t))

# Addresses with one of these are no one's.
EXCLUDED = (r"@example\.", r"@test\.", r"@domain\.", r"@email\.", r"@yoursite\.", r"@sentry\.io", r"@2x\.png", r"@3x\.png", r"remove-this", r"noreply@", r"no-reply@")

FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
STRICT_FORMAT = r"^[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
FIND = r"(?<![a-zA-Z0-9])([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,20})(?=[^a-zA-Z0-9]|$)"

# Repairs in the order in which they apply, case ignored.
REPAIRS = (
    ("^%20+", ""),
    ("%20", ""),
    (r"^[\d\.\-\(\)\s]+(?=[a-z]+@)", ""),
    (r"^\d{5}[a-z]*email[a-z]*", ""),
    (r"^\d{5}[a-z]*phone[a-z]*", ""),
    (r"^\d{5}[a-z]+", ""),
    (r"^\d+[a-z]+(?=@)", ""),
    (r"^\d+(?=[a-z]*@)", ""),
    (r"^[a-z]+[\d\.\-]+([a-z]+@)", "$1"),
    (r"(\.com)(?:[a-z]+.*?)$", "$1"),
    (r"(\.net)(?:[a-z]+.*?)$", "$1"),
    (r"(\.org)(?:[a-z]+.*?)$", "$1"),
    (r"(\.edu)(?:[a-z]+.*?)$", "$1"),
    (r"(\.gov)(?:[a-z]+.*?)$", "$1"),
    (r"(\.biz)(?:[a-z]+.*?)$", "$1"),
    (r"(\.info)(?:[a-z]+.*?)$", "$1"),
    (r"(\.site)(?:[a-z]+.*?)$", "$1"),
    (r"(\.email)(?:[a-z]+.*?)$", "$1"),
    (r"(\.io)(?:[a-z]+.*?)$", "$1"),
    (r"(\.com)[a-z]$", "$1"),
    (r"(\.net)[a-z]$", "$1"),
    (r"(\.org)[a-z]$", "$1"),
    (r"@(.+?)\.(huhorizon)$", "@$1.hu"),
    (r"@(.+?)\.(chder)$", "@$1.ch"),
    (r"@(.+?)\.(ukregistered)$", "@$1.uk"),
    (r"@(.+?)\.(nliban)$", "@$1.nl"),
    (r"@(.+?)\.(chhorizon)$", "@$1.ch"),
    (r"@(.+?)\.(dehorizon)$", "@$1.de"),
    (r"@remove-this\.", "@"),
    (r"@remove\.", "@"),
    (r"\(\d{3}\)\s*\d{3}-\d{4}", ""),
    (r"\d{3}-\d{3}-\d{4}", ""),
    (r"\d{3}-\d{4}", ""),
    ("^email(?=[a-z]+@)", ""),
)

# How good the start of an address is, the first that fits; and how good a validation result is.
PREFIX_RANK = {"info": 100, "contact": 90, "hello": 85, "sales": 80, "bookings": 75, "reservations": 70, "events": 60, "functions": 55, "reception": 50, "admin": 45, "enquiries": 40, "enquiry": 38, "accounts": 35, "office": 30}
RESULT_RANK = {"deliverable": 4, "unknown": 3, "risky": 2, "undeliverable": 1}

# A well-formed address, and named signs that one is broken.
GRADED_FORMAT = r"^[a-zA-Z0-9][a-zA-Z0-9._-]*@[a-zA-Z0-9][a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SIGNS = {
    "has_phone": r"\d{6,}",
    "has_space": r"\s",
    "double_domain": r"@.*@",
    "missing_tld": r"@[^.]+$",
    "weird_chars": r"[^\w@.\-+]",
    "ends_weird": r"\.[a-z]{4,}$",
    "multiple_dots_before_at": r"\.\.+.*@",
    "starts_with_digit_sequence": r"^[\d\-]+[a-z]",
}
FREE_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def tld(email: Column) -> Column:
    return F.lower(F.substring_index(email, ".", -1))


def is_well_formed(email: Column) -> Column:
    return email.rlike(FORMAT)


def is_valid(email: Column) -> Column:
    """5 to 254 characters, well formed, a known top-level domain, and none of the excluded patterns."""
    excluded = F.lower(email).rlike("|".join(EXCLUDED))
    return F.length(email).between(5, 254) & ~excluded & is_well_formed(email) & tld(email).isin(TLDS)


def clean(email: Column) -> Column:
    """Trimmed and in lower case, without ``mailto:`` and blanks; null unless the rest is well formed."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(email)), r"^mailto:", ""), r"\s+", "")
    return F.when(is_well_formed(bare), bare)


def repair(email: Column) -> Column:
    """All repairs in order, then the strict format; an address that still fails is empty, null too."""
    fixed = reduce(lambda c, r: F.regexp_replace(c, f"(?i){r[0]}", r[1]), REPAIRS, strip(F.coalesce(email, F.lit(""))))
    fixed = F.regexp_replace(F.lower(strip(fixed)), r"^[.,;:() ]+|[.,;:() ]+$", "")
    return F.when(fixed.rlike(STRICT_FORMAT), fixed).otherwise("")


def repair_for_upload(email: Column) -> Column:
    """In lower case without spam-trap marks, and ``.nl`` and ``.com`` without what is glued to them."""
    bare = F.lower(strip(email))
    for mark in ("remove-this.", "-remove-this", "removethis"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\.nl[a-z]+$", ".nl"), r"\.com[a-z]+$", ".com"), F.lit(""))


def cut_glued(email: Column) -> Column:
    """Text glued to a known top-level domain removed, the longest that fits; a known last label is left whole."""
    known = tld(email).isin(TLDS)
    cut = F.lit(None).cast("string")
    for t in reversed(LONGEST_FIRST):
        glued = rf"\.{t}[a-z]+$"
        cut = F.when(email.rlike(glued), F.regexp_replace(email, glued, f".{t}")).otherwise(cut)
    return F.when(known, email).otherwise(F.coalesce(cut, email))


def extract(text: Column) -> Column:
    """Valid addresses in a text, in lower case, sorted and distinct; digits before the name and glued text removed."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIND), F.lit(1)), lambda e: F.regexp_replace(F.lower(e), r"^[\d\-]+([a-z])", "$1"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, cut_glued), is_valid)))


def split_cell(cell: Column) -> Column:
    """Addresses of a cell that separates them with commas or semicolons, each repaired, those over 5 characters."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"[,;]\s*"), repair)
    return F.filter(parts, lambda e: F.length(e) > 5)


def issues(email: Column) -> Column:
    """Names of the signs that an address is broken."""
    return F.array_compact(F.array(*(F.when(email.rlike(p), F.lit(n)) for n, p in SIGNS.items())))


def grade(email: Column) -> Column:
    """INVALID unless well formed, SUSPICIOUS with any sign, else VALID."""
    return F.when(~email.rlike(GRADED_FORMAT), "INVALID").when(F.size(issues(email)) > 0, "SUSPICIOUS").otherwise("VALID")


def prefix_rank(email: Column) -> Column:
    """By the first listed beginning that the address has, else 0."""
    name = F.lower(local_part(email))
    return reduce(lambda c, x: F.when(name.startswith(x[0]), x[1]).otherwise(c), reversed(PREFIX_RANK.items()), F.lit(0))


def result_rank(result: Column) -> Column:
    known = F.coalesce(F.lower(result), F.lit("undeliverable"))
    return reduce(lambda c, x: F.when(known == x[0], x[1]).otherwise(c), RESULT_RANK.items(), F.lit(0))


def total_rank(email: Column, result: Column) -> Column:
    return result_rank(result) * 1000 + prefix_rank(email)


def campaign_status(result: Column, score: Column) -> Column:
    """SEND a deliverable address, TEST a risky one with a score of 60 or more, SKIP the rest."""
    known = F.lower(result)
    return F.when(known == "deliverable", "SEND").when((known == "risky") & (score >= 60), "TEST").otherwise("SKIP")


def is_personal(email: Column) -> Column:
    return F.lower(domain(email)).isin(*FREE_DOMAINS)


def first_name_guess(email: Column) -> Column:
    """The first part of 2 to 12 letters of the name before the at sign; null for a generic word."""
    part = F.regexp_extract(F.lower(local_part(email)), r"^([a-z]{2,12})(?:[._].*)?$", 1)
    return F.when((part != "") & ~part.isin(*PREFIX_RANK, "mail", "team", "support", "help", "email"), F.initcap(part))


def embedded_phone(email: Column) -> Column:
    """A phone number before the name, as (xxx) xxx-xxxx."""
    p = r"(\d{3})[.\-]?(\d{3})[.\-]?(\d{4})"
    part = [F.regexp_extract(email, p, k) for k in (1, 2, 3)]
    return F.when(part[0] != "", F.format_string("(%s) %s-%s", *part))


# Repairs of the splitting step, in order, case ignored.
SPLIT_REPAIRS = (
    (r"^%20+", ""),
    (r"%20", ""),
    (r"@([a-zA-Z0-9\-\.]+\.[a-z]{2,})([a-z]{4,}.*?)$", "@$1"),
    (r"@(.+?)\.(huhorizon)$", "@$1.hu"),
    (r"@(.+?)\.(chder)$", "@$1.ch"),
    (r"@(.+?)\.(ukregistered)$", "@$1.uk"),
    (r"@(.+?)\.(nliban)$", "@$1.nl"),
    (r"@(.+?)\.(chhorizon)$", "@$1.ch"),
    (r"@(.+?)\.(dehorizon)$", "@$1.de"),
    (r"@remove-this\.", "@"),
    (r"@remove\.", "@"),
    (r"\(\d{3}\)\s*\d{3}-\d{4}", ""),
    (r"\d{3}-\d{3}-\d{4}", ""),
    (r"\d{3}-\d{4}", ""),
)
# Repairs before a second validation, in order, case matters.
REVALIDATION_REPAIRS = (
    (r"@(.+?)\.(huhorizon)$", "@$1.hu"),
    (r"@(.+?)\.(chder)$", "@$1.ch"),
    (r"@(.+?)\.(ukregistered)$", "@$1.uk"),
    (r"@(.+?)\.(nliban)$", "@$1.nl"),
    (r"@(.+?)\.(chhorizon)$", "@$1.ch"),
    (r"@(.+?)\.(dehorizon)$", "@$1.de"),
    (r"@remove-this\.", "@"),
    (r"@remove\.", "@"),
)
# Parts of addresses that the scraper drops.
FAKE = ("example.com", "domain.com", "yoursite.com", "test.com", "filler@godaddy", "noreply@", "no-reply@", "donotreply@", "webmaster@", "postmaster@", "mailer-daemon@", "privacy@", "abuse@", "hostmaster@")
# Endings of two labels, then of one, and signs of spam, in the order in which they are tried.
COMPOUND_ENDINGS = ("co.uk", "com.au", "co.za", "co.nz", "com.br", "co.in", "com.mx", "co.jp", "com.cn", "co.kr", "com.ar", "co.il")
SINGLE_ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "io", "ai", "co", "uk", "ca", "au", "de", "fr", "jp", "cn", "ru", "br", "in", "biz", "info", "me", "tv", "us", "tech", "online", "store", "dev")
SPAM = (r"^test\d*@", r"^example\d*@", r"@sentry", r"@example\.com", r"bootcamp@", r"advisors\d+")
# Words in the name of an address that is no person's.
ROLE_WORDS = ("info", "contact", "admin", "office", "hello", "mail", "support", "manager", "director", "curator", "reception", "sales", "service", "help", "inquiries", "inquiry", "team", "general", "membership", "volunteer", "media", "press", "webmaster", "postmaster")


def split_repair(email: Column) -> Column:
    """The repairs of the splitting step, in lower case; empty unless an at sign and a dot behind it are left."""
    fixed = reduce(lambda c, r: F.regexp_replace(c, f"(?i){r[0]}", r[1]), SPLIT_REPAIRS, strip(F.coalesce(email, F.lit(""))))
    fixed = F.lower(strip(fixed))
    ok = fixed.contains("@") & domain(fixed).contains(".")
    return F.when(ok, F.regexp_replace(fixed, r"^[.,;: ]+|[.,;: ]+$", "")).otherwise("")


def revalidation_repair(email: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REVALIDATION_REPAIRS, strip(email))


def scraped(email: Column) -> Column:
    """``.co`` at the end completed to ``.com``; null for a fake, without a dot behind the at sign, or not 5 to 100 long."""
    low = F.lower(strip(email))
    low = F.when(low.endswith(".co"), F.concat(low, F.lit("m"))).otherwise(low)
    fake = reduce(lambda a, w: a | low.contains(w), FAKE, F.lit(False))
    return F.when(~fake & low.contains("@") & domain(low).contains(".") & F.length(low).between(5, 100), low)


def by_ending(text: Column) -> Column:
    """Addresses of a text, each cut behind the first ending of two labels that it has, else of one; sorted and distinct."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower)

    def cut(e: Column) -> Column:
        name, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
        out = F.lit(None).cast("string")
        for ending in reversed((*COMPOUND_ENDINGS, *SINGLE_ENDINGS)):
            at = F.instr(host, f".{ending}")
            out = F.when(at > 1, F.concat(name, F.lit("@"), F.substr(host, F.lit(1), at + len(ending)))).otherwise(out)
        return out

    kept = F.filter(found, lambda e: ~e.rlike("|".join(SPAM)))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(kept, cut))))


def suspicions(email: Column) -> Column:
    """Codes of what is odd in an address: digits of a phone, digits in front, text glued to an ending, an unknown ending."""
    host = domain(email)
    glued = host.rlike(r"\.(?:" + "|".join(LONGEST_FIRST) + ")[a-z]+")
    codes = F.array(
        F.when(email.rlike(r"\d{6,}"), "has_phone"),
        F.when(email.rlike(r"^[\d\-]+[a-z]"), "starts_with_digits"),
        F.when(glued, "concatenated_domain"),
        F.when(~F.substring_index(host, ".", -1).isin(TLDS), "invalid_tld"),
    )
    return F.when(email.isNull() | ~email.contains("@"), F.array(F.lit("invalid_format"))).otherwise(F.array_compact(codes))


def first_name(email: Column) -> Column:
    """A name guessed from the part before the at sign: null for a role; before a dot or underscore 2 to 12 letters, digits left out, else one word of 3 to 10 letters."""
    name = F.lower(local_part(email))
    part = lambda sep: F.regexp_replace(F.substring_index(name, sep, 1), r"\d+", "")
    role = reduce(lambda a, w: a | name.contains(w), ROLE_WORDS, F.lit(False))
    guess = F.when(name.contains(".") & part(".").rlike("^[a-z]{2,12}$"), part(".")).when(name.contains("_") & part("_").rlike("^[a-z]{2,12}$"), part("_")).when(name.rlike("^[a-z]{3,10}$"), name)
    return F.when(~role, F.initcap(guess))


@F.udtf(returnType="email string, scrape_status string, error_message string")
class PageRows:
    """A table function over (website, page): a row for each address that the page has, or one row that says why there is none."""

    def eval(self, website: str, page: str):
        import re

        if not (website or "").strip():
            yield "", "failed", "No website provided"
            return
        found = sorted({x.lower() for x in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", page or "")})
        for email in found:
            yield email, "success", ""
        if not found:
            yield "", "failed", "no_email_found_static"
