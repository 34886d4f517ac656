import pytest
from pyspark.sql import functions as F

from rowsmith.functions import cleaners, emails, html, names, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("info@sovjet-ereveld.nliban", ["info@sovjet-ereveld.nl"]),
        ("budapestinfo@flippermuzeum.huhorizon", ["budapestinfo@flippermuzeum.hu"]),
        ("verein-bl64@mhsz.chder", ["verein-bl64@mhsz.ch"]),
        ("paulandlindab@hotmail.co.ukregistered", ["paulandlindab@hotmail.co.uk"]),
        ("102info@army-surplus.cz", ["info@army-surplus.cz"]),
        ("664info@antique-vintage-berlin.de", ["info@antique-vintage-berlin.de"]),
        ("info@militex.chbewertungen", ["info@militex.ch"]),
        ("hstaebler@remove-this.crestawald.ch", []),
        ("fake@test.invalidtld", []),
        ("Contact: info@museum.de", ["info@museum.de"]),
        ("a@foo.com, b@foo.info; a@foo.com", ["a@foo.com", "b@foo.info"]),
        ("", []),
        (None, []),
    ],
)
def test_extract(spark, raw, want):
    assert one(spark, emails.extract(F.col("v").cast("string")), v=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" 312.719.6721info@shop.com ", "info@shop.com"), ("%20info@shop.combig", "info@shop.com"), ("x@y.nliban", "x@y.nl"), ("34110emailinfo@a.de", "info@a.de"), ("no address", ""), (None, "")],
)
def test_repair(spark, raw, want):
    assert one(spark, emails.repair(F.col("v").cast("string")), v=raw) == want


def test_repair_does_not_change_its_result(spark):
    df = spark.createDataFrame([(e,) for e in ("INFO@Shop.comx", "12info@a.org", "a.b@c.de", "x@remove-this.y.nl")], "e string")
    once = df.select(emails.repair(F.col("e")).alias("e"))
    assert once.collect() == once.select(emails.repair(F.col("e")).alias("e")).collect()


def test_cells_status_and_names(spark):
    assert one(spark, emails.split_cell(F.col("v")), v="a@x.com; b@y.org, bad") == ["a@x.com", "b@y.org"]
    assert one(spark, emails.campaign_status(F.col("r"), F.col("s")), r="risky", s=60) == "TEST"
    assert one(spark, emails.campaign_status(F.col("r"), F.col("s")), r="risky", s=59) == "SKIP"
    assert one(spark, emails.campaign_status(F.col("r"), F.col("s")), r="Deliverable", s=1) == "SEND"
    assert one(spark, emails.first_name_guess(F.col("v")), v="anna.smith@x.com") == "Anna"
    assert one(spark, emails.first_name_guess(F.col("v")), v="info@x.com") is None
    assert one(spark, emails.embedded_phone(F.col("v")), v="us407.618.9029info@ngenservices.com") == "(407) 618-9029"
    assert one(spark, emails.total_rank(F.col("v"), F.lit("deliverable")), v="sales@x.com") == 4080
    assert one(spark, emails.is_personal(F.col("v")), v="x@Gmail.com")


@pytest.mark.parametrize("url", ["https://www.apple.com/abc", "http://apple.com", "www.apple.com", "apple.com/xyz?test=1", "APPLE.com:80"])
def test_domain(spark, url):
    assert one(spark, urls.domain(F.col("v")), v=url) == "apple.com"


def test_urls(spark):
    assert one(spark, urls.with_scheme(F.col("v")), v=" a.com ") == "https://a.com"
    assert one(spark, urls.with_scheme(F.col("v")), v="  ") is None
    assert one(spark, urls.match_key(F.col("v")), v="HTTPS://www.A.com/b//") == "a.com/b"
    assert one(spark, urls.link_score(F.col("v")), v="https://a.com/pages/contact-us") == 250
    assert one(spark, urls.link_score(F.col("v")), v="https://a.com/products/contact") == 0
    assert one(spark, urls.city(F.col("v")), v="123 Main St, Houston, TX 77001, USA") == "Houston"
    assert one(spark, urls.city(F.col("v")), v="Houston") is None
    assert one(spark, urls.phones(F.col("v")), v="call 407-618-9029 or 4076189029") == ["407-618-9029", "4076189029"]
    assert one(spark, urls.links(F.col("v")), v="<a href='/a'><a href=\"#x\"><a href='mailto:b'><a href='/a'>") == ["/a"]
    assert one(spark, urls.sitemap_locations(F.col("v")), v="<urlset><url><loc> http://a/ </loc></url><u:loc>b</u:loc></urlset>") == ["http://a/", "b"]
    assert one(spark, urls.robots_sitemaps(F.col("v")), v="User-agent: *\nSitemap: http://a/s.xml") == ["http://a/s.xml"]
    assert len(one(spark, urls.variants(F.col("v")), v="a.com")) == 4


def test_html(spark):
    page = "<html><head><title> A &amp; B</title><script>x<y</script></head><nav>menu</nav><h1>One <b>two</b></h1><p>text&nbsp;here</p></html>"
    assert one(spark, html.to_text(F.col("v")), v=page) == "A & B One two text here"
    assert one(spark, html.title(F.col("v")), v=page) == "A &amp; B"
    assert [tuple(r) for r in one(spark, html.headings(F.col("v")), v=page)] == [(1, "One two")]
    assert one(spark, html.site_type(F.col("v")), v=page) == "static"
    assert one(spark, html.site_type(F.col("v")), v='<div id="root">') == "dynamic"
    assert one(spark, html.site_type(F.col("v")), v="plain") == "unknown"
    assert one(spark, html.js_risk(F.col("v")), v="React vue fetch( spinner captcha") == 25 + 25 + 10 + 15 + 30
    assert one(spark, html.language(F.col("v")), v="und der Hund") == "de"
    assert one(spark, html.sentences_with(F.col("v"), "cat"), v="A cat. A dog. The cat sat.") == ["A cat", "The cat sat"]
    assert one(spark, html.fenced_json(F.col("v")), v='x\n```json\n{"a": 1}\n```') == {"a": "1"}
    assert one(spark, html.to_text(F.col("v").cast("string")), v=None) == ""


def test_names(spark):
    assert one(spark, names.casual(F.col("v")), v="Devonport Historic Cottages Pty Ltd") == "Devonport Historic Cottages"
    assert one(spark, names.casual(F.col("v")), v="Luxury 5 Star Hotel - Gold Coast") == "Luxury 5 Star Hotel"
    assert one(spark, names.short(F.col("v")), v="The Big Museum") == "Big"
    assert one(spark, names.from_domain(F.col("v")), v="big-shop.com.au") == "Big Shop"
    assert one(spark, names.render("{a}-{b}", {"a": F.col("v"), "b": F.lit(None)}), v="x") == "x-"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("%20info@shop.com", "info@shop.com"), ("a@shop.comhoursavailable", "a@shop.comhoursavail"), ("b@m.ukr", "b@m.ukr"), (" C@Remove-This.x.nl. ", "c@x.nl"), ("555-0199d@x.org", "d@x.org"), ("nothing", ""), (None, "")],
)
def test_split_repair(spark, raw, want):
    assert one(spark, emails.split_repair(F.col("v").cast("string")), v=raw) == want


def test_addresses_by_other_rules(spark):
    v = F.col("v")
    assert one(spark, emails.scraped(v), v="Bob@site.co") == "bob@site.com"
    assert one(spark, emails.scraped(v), v="noreply@shop.com") is None
    assert one(spark, emails.scraped(v), v="x@example.com") is None
    assert one(spark, emails.by_ending(v), v="dr@shop.co.ukopening and test1@x.com") == ["dr@shop.co.uk"]
    assert one(spark, emails.suspicions(v), v="12info@shop.combig") == ["starts_with_digits", "concatenated_domain", "invalid_tld"]
    assert one(spark, emails.suspicions(v), v="nothing") == ["invalid_format"]
    assert one(spark, emails.revalidation_repair(v), v=" x@remove-this.y.huhorizon") == "x@y.hu"
    for raw, want in (("john.smith@x.com", "John"), ("jane2_doe@x.com", "Jane"), ("anna@x.com", "Anna"), ("info@x.com", None), ("ab@x.com", None)):
        assert one(spark, emails.first_name(v), v=raw) == want


def test_places_and_pages(spark):
    v = F.col("v")
    assert one(spark, urls.short_place(v), v="1 Main St, Houston, TX 77001, USA") == "Houston, TX"
    assert one(spark, urls.short_place(v), v="Somewhere in a town without commas") == "Somewhere in a town without co"
    assert one(spark, urls.state(v), v="Houston, TX 77001") == "texas" and one(spark, urls.country(v), v="x, Kiel, Germany") == "Germany"
    assert one(spark, urls.page_value(v), v="https://x.com/about") == 20 and one(spark, urls.page_value(v), v="https://x.com/blog/news/a/b") == -43
    assert one(spark, urls.page_group(v), v="https://x.com/our-story") == 3
    site = F.lit("https://www.x.com/start")
    assert one(spark, urls.internal(v, site), v="/a/b?x=1#y") == "https://www.x.com/a/b"
    assert one(spark, urls.internal(v, site), v="https://other.org/a") is None and one(spark, urls.internal(v, site), v="/style.css") is None
    assert one(spark, urls.own_website(v, F.lit("Acme & Sons")), v="see http://finder.com or https://www.acme-shop.com") == "https://acme-shop.com"
    assert one(spark, urls.stamped(v, F.lit(9)), v="https://x.com?a=1") == "https://x.com?a=1&t=9s"


def test_texts_by_rules(spark):
    v = F.col("v")
    assert one(spark, html.contacts(v), v="CEO Jane Miller met Tom Baker, Director of sales") == [("Jane Miller", "CEO"), ("Tom Baker", "Director")]
    assert one(spark, html.answer_fields(v), v="I'm around dentists daily and they keep saying they lose time. End") == {"dreamICP": "dentists", "painTheySolve": "lose time"}
    assert one(spark, html.failure(v), v="Read Timeout") == "connection_timeout" and one(spark, html.failure(v), v="") == "unknown_error"
    assert one(spark, html.plain_words(v), v="<b>bold</b> a aa 12 1234 http://x.y me@x.com word") == "bold 1234 word"
    assert one(spark, html.dense_words(v), v="the the end {x:1} deadbeefdeadbeef " + "w" * 10 + "x" * 15) == "the end"
    assert tuple(one(spark, html.recommended(F.lit(True), v, F.lit(10), F.lit(False)), v="high")) == ("http", 0.95)
    assert tuple(one(spark, html.recommended(F.lit(True), v, F.lit(60), F.lit(False)), v="low")) == ("apify", 0.1)


def test_dense_words_makes_words_once(spark):
    plan = spark.createDataFrame([("a b",)], "v string").select(html.dense_words(F.col("v")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 2  # of the plain words, and of these again


def test_patterns_are_sought_where_their_literals_are(spark, monkeypatch):
    assert cleaners.literals(r"(?i)var\s+\w+\s*=\s*[^;]+;") == ["var", "=", ";"]
    assert cleaners.literals(r"rgba?\([^)]+\)") == ["rgb", "(", ")"] and cleaners.literals(r"[a-f]{8,}") == [] and cleaners.literals("a|b") == []
    assert cleaners.literals(r"error \d+") == ["error"] and cleaners.literals(r"(?s)<!--.*?-->") == ["<!--", "-->"]
    v = F.col("v")
    texts = [
        "keep CooKie404Policy ALL RIGHTS RESERVED here", "keep \u017fign up for, ma\u0131n; \u017fKip to content <D\u0130V a>words</d\u0131v> \u212aeep \u017fKIP to content",
        "&lt;b&gt; &lt;script&gt; x &lt;/script&gt; var abc = 5; keep rgb(1,2) top", "<p <div> a>b</p><scr<br>ipt>c</script> coo<i></i>kie policy", None, "",
    ]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    found = [r.x for r in df.select(cleaners.smart(v).alias("x")).collect()]
    monkeypatch.setattr(cleaners, "literals", lambda _: [])
    assert found == [r.x for r in df.select(cleaners.smart(v).alias("x")).collect()] and "cookie" not in found[1]
    monkeypatch.undo()
    # Texts without any literal of a stage leave its expression out: the plan has a condition for each.
    plan = spark.createDataFrame([("a",)], "v string").select(cleaners.smart(v).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("CASE WHEN") >= 50
