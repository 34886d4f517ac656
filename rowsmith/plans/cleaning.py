"""Pages cut down to readable text by two chains of stages; the SQL is made of the same stages."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from rowsmith.functions import cleaners as c
from rowsmith.plans.tables import Book, Tables

book = Book()


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Pages, as they are and with what pages of scripts and styles leave in a text.
EXTRA = (
    "",
    "<p>Call us &amp; ask: var x = 5; function (a) { b } window.foo = 1; return y; setTimeout(go, 5) 12px 50% #fff Copyright 2024 all rights reserved</p>",
    "<NOSCRIPT>no</NOSCRIPT><meta charset=x>.cls { a } @media x { y } rgba(1,2) a aa 12 1234 !!! -- Caf&eacute; &#233; &#xE9; &bogus; &ldquo;q&rdquo; it&rsquo;s 404",
    "<!-- gone --> const a = 1; let b = 2; if (x) { y } for (i) { j } this.go(); new Foo(1) typeof x Math.max deadbeef01 abcdefghijklmnopqrstuvwxyz haaaaa is-layout-flow sign  up 2024 20240101 undefined This style, THIS",
)
SRC = "src AS (SELECT page_id, html || CASE page_id % 4 " + " ".join(f"WHEN {k} THEN {_text(x)}" for k, x in enumerate(EXTRA)) + " END AS t FROM pages)"


class _Chain:
    """A column in steps, one common table expression for each stage, so that the SQL stays flat."""

    def __init__(self):
        self.ctes, self.name = [], "src"

    def step(self, expression: str) -> None:
        name = f"s{len(self.ctes)}"
        self.ctes.append(f"{name} AS (SELECT page_id, {expression} AS t FROM {self.name})")
        self.name = name

    def cut(self, patterns, new: str, flags: str = "") -> None:
        for p in patterns:
            self.step(f"regexp_replace(t, {_text(c.classes(flags + p))}, {_text(new)}, 'g')")

    def words(self, more: str = "true") -> None:
        self.step(f"regexp_replace(t, {_text(f'^[{c.BLANK}]+|[{c.BLANK}]+$')}, '', 'g')")
        keep = f"length(w) >= 2 AND NOT (regexp_matches(w, {_text(f'^{c.DIGIT}+$')}) AND length(w) < 4) AND replace(w, w[1:1], '') <> '' AND regexp_matches(w, {_text(f'[{c.WORD}]')}) AND {more}"
        self.step(f"array_to_string(list_filter(regexp_split_to_array(t, {_text(f'[{c.BLANK}]+')}), lambda w: {keep}), ' ')")

    def tidied(self, last: str) -> None:
        self.cut((last, rf"[{c.BLANK}]+"), " ")
        self.step("trim(t)")


def _smart() -> str:
    s = _Chain()
    s.cut(c.SMART_MARKUP, " ")
    for name, char in c.SMART_ENTITIES.items():
        s.step(f"replace(t, {_text(name)}, {_text(char)})")
    s.cut(c.SMART_SCRIPT, " ")
    s.cut(c.SMART_STYLE, " ")
    s.cut(c.SMART_PHRASES, " ", "(?i)")
    s.words()
    s.tidied(c.SMART_LAST)
    return f"WITH {SRC}, {', '.join(s.ctes)} SELECT page_id, t AS text FROM {s.name}"


def _brutal() -> str:
    s = _Chain()
    s.cut(c.BRUTAL_MARKUP, "")
    s.cut((r"<[^>]+>",), " ")
    names = "MAP {" + ", ".join(f"{_text(n)}: {_text(chr(k))}" for n, k in sorted(name2codepoint.items())) + "}"
    name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z0-9]+);', 1)"
    number = f"CASE WHEN regexp_matches({name}, '^#[xX]') THEN CAST('0x' || {name}[3:] AS INTEGER) WHEN {name}[1] = '#' THEN CAST({name}[2:] AS INTEGER) END"
    char = f"CASE WHEN {name}[1] = '#' THEN CASE WHEN {number} > 0 AND {number} < 1114112 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr({number}) END ELSE {names}[{name}] END"
    decoded = f"CASE WHEN i = 1 THEN p WHEN {char} IS NOT NULL THEN {char} || p[length({name}) + 2:] ELSE '&' || p END"
    s.step(f"array_to_string(list_transform(string_split(t, '&'), lambda p, i: {decoded}), '')")
    s.cut(c.BRUTAL_SCRIPT, "")
    s.cut(c.BRUTAL_STYLE, "")
    s.cut(c.BRUTAL_TECHNICAL, "", "(?i)")
    s.cut(c.BRUTAL_PHRASES, "", "(?i)")
    s.cut(c.BRUTAL_CODES, "")
    # Without back references: each printable character of the Latin blocks by itself.
    s.cut(("|".join(rf"\x{{{k:X}}}{{4,}}" for k in (9, 13, *range(32, 127), *range(161, 384))),), "")
    s.words(f"regexp_replace(lower(w), {_text(f'[^{c.WORD}]')}, '', 'g') NOT IN ({', '.join(map(_text, c.BRUTAL_WORDS))})")
    s.tidied(c.BRUTAL_LAST)
    return f"WITH {SRC}, {', '.join(s.ctes)} SELECT page_id, t AS text FROM {s.name}"


def _pages(t: Tables):
    extra = F.element_at(F.array(*map(F.lit, EXTRA)), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", F.concat("html", extra).alias("html"))


@book.add(_smart())
def smart_text(t: Tables):
    """H2: readable text of pages in twelve stages."""
    return _pages(t).select("page_id", c.smart(F.col("html")).alias("text"))


@book.add(_brutal())
def brutal_text(t: Tables):
    """H3: readable text of pages with code, hashes and repeats gone, in thirteen stages."""
    return _pages(t).select("page_id", c.brutal(F.col("html")).alias("text"))
