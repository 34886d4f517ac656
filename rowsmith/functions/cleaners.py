"""Two chains that cut a page down to what is readable, as stages of data: each stage is a list of expressions and what stands in for them.

The expressions are kept as text that Spark and DuckDB both read, once ``classes`` has written out what counts as a word
character, a blank and a digit beyond ASCII.
"""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches nothing, and is not tried at any place but the first.
NOTHING = r"\A(?!)"
WORD, BLANK, DIGIT = r"\p{L}\p{N}_", r"\s\x0B\x1C-\x1F\x{85}\p{Z}", r"\p{Nd}"

# Fixed values of the chain that keeps most: what each stage takes out, in order. (?i): any case; (?s): over line ends.
SMART_MARKUP = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?is)<head[^>]*>.*?</head>",
    r"(?i)<meta[^>]*/?>",
    r"(?i)<link[^>]*/?>",
    r"(?is)<noscript[^>]*>.*?</noscript>",
    *(rf"(?i)</?{tag}[^>]*>" for tag in "div p br h1 h2 h3 h4 h5 h6 li ul ol section article nav header footer aside".split()),
    r"<[^>]+>",
)
SMART_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&mdash;": "-", "&ndash;": "-", "&rsquo;": "'", "&lsquo;": "'", "&rdquo;": '"', "&ldquo;": '"'}
SMART_SCRIPT = (
    r"(?i)function\s*\([^)]*\)\s*\{[^}]*\}",
    r"(?i)var\s+\w+\s*=\s*[^;]+;",
    r"(?i)window\.\w+\s*=\s*[^;]+;",
    r"(?i)document\.\w+\s*=\s*[^;]+;",
    r"(?i)\w+\s*:\s*function\s*\([^)]*\)\s*\{[^}]*\}",
    r"(?i)addEventListener\([^)]+\)",
    r"(?i)removeEventListener\([^)]+\)",
    r"(?i)setTimeout\([^)]+\)",
    r"(?i)setInterval\([^)]+\)",
    r"(?i)return\s+[^;]+;",
)
SMART_STYLE = (r"[a-zA-Z-]+\s*:\s*[^;]+;", r"\.\w+\s*\{[^}]*\}", r"#\w+\s*\{[^}]*\}", r"@\w+[^{]*\{[^}]*\}", r"rgba?\([^)]+\)", r"\d+px\b", r"\d+em\b", r"\d+%\b", r"rgb\([^)]+\)", r"#[0-9a-fA-F]{3,6}\b")
SMART_PHRASES = (
    "cookie policy", "privacy policy", "terms of service", "terms and conditions", "accept all cookies", "decline cookies", "manage cookies",
    "subscribe to newsletter", "sign up for", "follow us on", "all rights reserved", r"copyright \d{4}", "powered by",
    "skip to content", "skip to main content", "back to top", r"loading\.\.\.", "please wait", r"error \d+", "page not found", "404", "403", "500",
)
SMART_LAST = r"[^\w\s\.\,\!\?\;\:\-\(\)]"

# Fixed values of the chain that keeps least.
BRUTAL_MARKUP = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<head[^>]*>.*?</head>", r"(?s)<!--.*?-->")
BRUTAL_SCRIPT = (
    r"function\s*\([^)]*\)\s*\{[^}]*\}", r"var\s+\w+\s*=\s*[^;]+;", r"const\s+\w+\s*=\s*[^;]+;", r"let\s+\w+\s*=\s*[^;]+;",
    r"if\s*\([^)]+\)\s*\{[^}]*\}", r"for\s*\([^)]+\)\s*\{[^}]*\}", r"while\s*\([^)]+\)\s*\{[^}]*\}", r"class\s+\w+\s*\{[^}]*\}",
    r"window\.\w+[^;]*;", r"document\.\w+[^;]*;", r"this\.\w+[^;]*;", r"return\s+[^;]+;", r"\w+\.\w+\([^)]*\)", r"new\s+\w+\([^)]*\)",
    r"typeof\s+\w+", "undefined", "null", "true", "false",
)
BRUTAL_STYLE = (
    r"--wp--preset--[^:]*:[^;]*;", r"[a-zA-Z-]+\s*:\s*[^;]*;", r"\d+px", r"\d+em", r"\d+rem", r"\d+%", r"rgba?\([^)]+\)",
    r"#[0-9a-fA-F]{3,6}", r"linear-gradient[^;]*", r"\.[\w-]+\s*\{[^}]*\}", r"#[\w-]+\s*\{[^}]*\}", r"@[\w-]+[^{]*\{[^}]*\}",
)
BRUTAL_TECHNICAL = (
    ":root", ":where", ":not", ":first-child", ":last-child", "alignleft", "alignright", "aligncenter", "alignfull", "alignwide",
    "wp-site-blocks", r"is-layout-\w+", r"margin-inline-\w+", "addEventListener", "removeEventListener", "querySelector",
    "getElementById", r"getElementsBy\w+", "createElement", "appendChild", "removeChild", "innerHTML", "textContent",
    "setAttribute", "getAttribute", "hasAttribute", "preventDefault", "stopPropagation", "currentScript",
    "sessionStorage", "localStorage", r"navigator\.userAgent", r"Math\.\w+", r"Date\(\)", "setTimeout", "setInterval",
    r"Promise\.all", r"async\s+await", r"new\s+Promise", r"document\.ready", r"window\.load", "DOMContentLoaded",
)
BRUTAL_PHRASES = (
    r"cookie\s+policy", r"privacy\s+policy", r"terms\s+of\s+service", r"all\s+rights\s+reserved", r"copyright\s+\d{4}",
    r"skip\s+to\s+content", r"back\s+to\s+top", r"scroll\s+to\s+top", r"loading\.\.\.", r"please\s+wait", r"page\s+not\s+found",
    r"subscribe\s+to\s+newsletter", r"sign\s+up", r"log\s+in", r"create\s+account", r"forgot\s+password", r"remember\s+me",
    r"accept\s+cookies", r"decline\s+cookies", r"manage\s+cookies",
)
BRUTAL_CODES = (r"\b\d{4,}\b", r"[a-fA-F0-9]{8,}", r"\w{20,}")
#: A character four times or more in a row.
BRUTAL_REPEATS = r"([^\n])\1{3,}"
#: Only these in small letters count: words are compared in lower case.
BRUTAL_WORDS = (
    "var", "const", "let", "function", "return", "typeof", "instanceof", "undefined", "null", "arguments", "this", "prototype", "constructor", "style",
)
BRUTAL_LAST = r"[^\w\s\.\,\!\?\;\:\-\(\)\'\"]"


def classes(pattern: str, lookaround: bool = False) -> str:
    r"""The pattern with \w, \s and \d written out, in brackets and outside; \b by what stands around it, for an engine that has look-around."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        k += len(c)
        if c in (r"\w", r"\s", r"\d"):
            text = {r"\w": WORD, r"\s": BLANK, r"\d": DIGIT}[c]
            out.append(text if inside else f"[{text}]")
        elif c == r"\b" and lookaround:
            out.append(rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
        else:
            inside = (c == "[" and not inside) or (inside and c != "]")
            out.append(c)
    return "".join(out)


def literals(pattern: str) -> list[str]:
    """Runs of characters without blanks, in small letters, each of which stands in whatever the pattern matches; none for one with alternatives or groups."""
    pattern = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    if re.search(r"(?<!\\)[|(]", pattern):
        return []
    parts = re.findall(r"(\[\^?\]?[^\]]*\]|\\.|.)([*?]\??|\{\d+(?:,\d*)?\}|\+\??)?", pattern)
    plain = lambda c, times: "\n" if c[0] == "[" or c in (".", "^", "$") or re.fullmatch(r"\\\w", c) or times[:1] in ("*", "?", "{") else c[-1] + ("\n" if times else "")
    return "".join(plain(*p) for p in parts).lower().split()


def once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def folded(text: Column) -> Column:
    """Small letters, with the four characters beyond ASCII that equal a Latin letter in any case."""
    return F.lower(F.when(text.rlike("[\u017f\u0131\u0130\u212a]"), F.translate(text, "\u017f\u0131\u0130\u212a", "siik")).otherwise(text))


def _cut(text: Column, patterns, new: str, flags: str = "", low: Column | None = None) -> Column:
    """Each pattern in turn; given ``low``, the folded text before the first of them, most only where it has all that they spell out.

    That is enough if ``new`` is a blank, as what is sought holds none.
    """

    def there(low: Column, p: str) -> Column:
        if "</?" in p:  # a tag, opened or closed
            return there(low, p.replace("</?", "<")) | there(low, p.replace("</?", "</"))
        return reduce(lambda a, b: a & b, (F.contains(low, F.lit(x)) for x in literals(p)))

    def cut(t: Column, p: str) -> Column:
        whole = F.lit(classes(flags + p, True).replace("(?i", "(?iu"))
        return F.regexp_replace(t, F.when(there(low, p), whole).otherwise(F.lit(NOTHING)) if low is not None and literals(p) else whole, F.lit(new))

    return reduce(cut, patterns, text)


def unescaped(text: Column) -> Column:
    """Numbered entities and those that HTML 4 names, each with its semicolon, as characters; others stay."""
    names = F.create_map(*(F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))))
    parts = F.split(text, "&")

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z0-9]+);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 10), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 10)).cast("int")
        fine = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, name))
        return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")


def _words(text: Column, keep) -> Column:
    words = F.split(F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", ""), f"[{BLANK}]+")
    plain = lambda w: (F.length(w) >= 2) & ~(w.rlike(rf"^{DIGIT}+$") & (F.length(w) < 4)) & (F.replace(w, F.substring(w, 1, 1), F.lit("")) != "")
    return F.array_join(F.filter(words, lambda w: plain(w) & w.rlike(f"[{WORD}]") & keep(w)), " ")


def _tidied(text: Column, last: str) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(text, classes(last), " "), f"[{BLANK}]+", " ")
    return F.trim(spaced)


def smart(html: Column) -> Column:
    """Readable text of a page: markup, left-over script and style, stock phrases and words without content go; null is empty."""
    with_low = lambda text, then: once(text, lambda t: once(folded(t), lambda low: then(t, low)))
    text = with_low(F.coalesce(html, F.lit("")), lambda t, low: _cut(t, SMART_MARKUP, " ", low=low))
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), SMART_ENTITIES.items(), text)
    text = with_low(text, lambda t, low: _cut(_cut(_cut(t, SMART_SCRIPT, " ", low=low), SMART_STYLE, " ", low=low), SMART_PHRASES, " ", "(?i)", low))
    return _tidied(_words(text, lambda _: F.lit(True)), SMART_LAST)


def brutal(html: Column) -> Column:
    """As ``smart``, but with code, hashes, long words and numbers, repeated characters and words of code gone too."""
    text = _cut(_cut(F.coalesce(html, F.lit("")), BRUTAL_MARKUP, ""), (r"<[^>]+>",), " ")
    text = _cut(_cut(unescaped(text), BRUTAL_SCRIPT, ""), BRUTAL_STYLE, "")
    text = _cut(_cut(text, BRUTAL_TECHNICAL, "", "(?i)"), BRUTAL_PHRASES, "", "(?i)")
    text = F.regexp_replace(_cut(text, BRUTAL_CODES, ""), BRUTAL_REPEATS, "")
    bare = lambda w: F.regexp_replace(F.lower(w), f"[^{WORD}]", "")
    return _tidied(_words(text, lambda w: ~bare(w).isin(*BRUTAL_WORDS)), BRUTAL_LAST)
