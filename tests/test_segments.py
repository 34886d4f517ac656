"""Values of the classes and the stages of the text cleaners, each by a literal case."""

import pytest
from pyspark.sql import functions as F

from rowsmith.functions import cleaners, urls
from rowsmith.plans import segments


def values(spark, fn, *cases):
    width = len(cases[0]) if isinstance(cases[0], tuple) else 1
    rows = [c if isinstance(c, tuple) else (c,) for c in cases]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} {'string' if not isinstance(rows[0][i], int) else 'long'}" for i in range(width)))
    return [r.v for r in df.select("k", fn(*(F.col(f"c{i}") for i in range(width))).alias("v")).orderBy("k").collect()]


def test_company_categories(spark):
    got = values(spark, segments.company_category, ("HVAC contractor", "", ""), ("", "", "AC repair"), ("ac", "x", ""), ("Tree Service", "Heat Pump sales", ""), ("Lawn Mowing", "", ""), ("Sprinkler", "", "mechanic"), ("Mechanical works", "", ""), ("Car Care", "", ""), ("Bakery", None, None))
    assert [tuple(x) for x in got] == [("HVAC", 8), ("HVAC", 8), ("HVAC", 8), ("HVAC", 8), ("Landscaping", 7), ("Landscaping", 7), ("Auto_Repair", 6), ("Auto_Repair", 6), ("Other", 5)]


def test_tiers_and_colours(spark):
    assert values(spark, lambda c: segments.steps(c, segments.TIERS), 500_000, 499_999, 100_000, 99_999, 0) == ["tier_1", "tier_2", "tier_2", "tier_3", "tier_3"]
    assert values(spark, lambda c: segments.steps(c, segments.COLOURS), 300, 299, 100, 99, 0) == ["red", "orange", "orange", "green", "green"]
    assert segments.UNKNOWN_CITY == 50_000


def test_templates(spark):
    got = values(spark, segments.template, ("CEO", "Austin", "5"), ("President of sales", "Austin", "5"), ("Manager", " ", "5"), ("Manager", None, " "), (" ", "", None), (None, None, None))
    assert got == ["has_title_ceo_founder", "has_city", "has_employees_count", "has_title", "default", "default"]


def test_bare_domains(spark):
    cases = {"https://www.shop.com/a?b": "shop.com", "shop.com": "shop.com", "HTTP://My.WWW.Shop.de:8080/": "my.shop.de", "www.shop.de/www.html": "shop.de", "": None, " ": None}
    assert values(spark, urls.bare_domain, *cases) == list(cases.values())


SMART = {
    "markup": ("a1<script>var x</script>b2<STYLE>p{}</STYLE>c3<head>h</head>d4<meta x/>e5<link y>f6<noscript>n\nn</noscript>g7<div class=q>h8<span>i9", "a1 b2 c3 d4 e5 f6 g7 h8 i9"),
    "entities": ("Tom &amp; Jerry&#39;s caf&eacute;&nbsp;bar", "Tom Jerry s caf eacute; bar"),
    "script": ("ab function (x) { y } cd var q = 1; ef window.foo = 2; gh setTimeout(go) ij return z; kl", "ab cd ef gh ij kl"),
    "style": ("ab color: red; cd .box { x } ef #box { y } gh @media z { w } ij rgba(1,2) kl 12px mn 50% op #fff qr", "ab cd ef gh ij kl mn 50 op qr"),
    "phrases": ("ab Cookie Policy cd copyright 2024 ef Loading... gh error 17 ij 404 kl", "ab cd ef gh ij kl"),
    "words": ("a cd 12 123 1234 xx yyyx --- zz9 !!", "cd 1234 yyyx zz9"),
    "last": ("café «q» a/b x@y (ok) no-go; e.g. 日本", "café q a b x y (ok) no-go; e.g. 日本"),
    "blank": (None, ""),
}


@pytest.mark.parametrize("stage", SMART)
def test_smart_stages(spark, stage):
    html, want = SMART[stage]
    assert values(spark, cleaners.smart, (html,)) == [want]


BRUTAL = {
    "markup": ("ab<script>x</script>cd<!-- c -->ef<b>gh</b>ij", "abcdef gh ij"),
    "entities": ("caf&eacute; &#233; &#xE9;t&#xe9; &lt;b&gt; &bogus; &amp;amp;", "café été b bogus; amp;"),
    "script": ("ab const q = 1; cd let r = 2; ef if (x) { y } gh this.go(); ij new Foo(1) kl typeof zz mn foo.bar(1) op undefined", "ab cd ef gh ij kl mn op"),
    "style": ("ab --wp--preset--x: y; cd color: red; ef 12px 3em 4rem gh 50% ij #abc kl linear-gradient(x); mn .a-b { c } op", "ab cd efgh ij kl mn op"),  # four blanks in a row are a repeat, and go
    "technical": ("ab alignleft cd is-layout-flow ef Math.max gh localStorage ij DOMContentLoaded kl", "ab cd ef gh ij kl"),
    "phrases": ("ab privacy  policy cd sign\nup ef remember me gh", "ab cd ef gh"),
    "codes": ("ab 2024 cd 20240101 ef deadbeef01 gh abcdefghijklmnopqrstuvw ij a1234b kl", "ab cd ef gh ij a1234b kl"),
    "repeats": ("ab hahaaaaa cd ----- ef wooow gh", "ab hah cd ef wooow gh"),
    "words": ("ab var cd Style, ef THIS gh q ij 123 kl prototype mn NaN", "ab cd ef gh ij kl mn NaN"),
    "last": ("ab/cd \"ef\" it's (gh) ij@kl", "ab cd \"ef\" it's (gh) ij kl"),
    "blank": (None, ""),
}


@pytest.mark.parametrize("stage", BRUTAL)
def test_brutal_stages(spark, stage):
    html, want = BRUTAL[stage]
    assert values(spark, cleaners.brutal, (html,)) == [want]


def test_site_maps(spark):
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    got = values(
        spark, lambda c: urls.sitemap(c),
        f'<?xml version="1.0"?><urlset xmlns="{ns}"><url><loc>a</loc></url><url><loc/></url><url><loc>b</loc></url></urlset>',
        f'<x:sitemapindex xmlns:x="{ns}"><x:sitemap><x:loc>m</x:loc></x:sitemap></x:sitemapindex>',
        "<urlset><url><loc>c</loc></url></urlset>", "<urlset><url><loc>c</lo", "no xml", None,
    )
    assert [(list(x.maps), list(x.pages)) for x in got] == [([], ["a", "b"]), (["m"], []), ([], ["c"]), ([], []), ([], []), ([], [])]
