import json
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import fuzzy, offers, text
from shelfspark.functions.dom import parse
from shelfspark.operators import catalog

PRICES = {
    "3.499": 3499.0, "6799.00": 6799.0, "1.234,56 TL": 1234.56, "1,234.56": 1.23, "1,234,567": None, "₺ 899,9": 899.9, "1.234.567": 1234567.0, "0": None, "": None, None: None, "bedava": None, ".5": 0.5, "12.": 12.0, "tl 2.499": 2499.0, "-5": 5.0, "1.2.3,4": 123.4,
}


def test_prices(spark):
    rows = spark.createDataFrame([(k,) for k in PRICES], "t string").select("t", text.parse_price_text(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == PRICES
    assert {k: offers.price_of(k) for k in PRICES} == PRICES


def test_prices_and_their_python_twin_agree(spark):
    r = random.Random(5)
    given = ["".join(r.choice("0123456789.,., TL₺x") for _ in range(r.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(g,) for g in given], "t string").select("t", text.parse_price_text(F.col("t")).alias("p")).collect()
    for row in rows:
        # a third decimal 5 goes up in columns, and to the even side of its binary value in Python
        assert row.p == pytest.approx(offers.price_of(row.t), abs=0.0101), row.t


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_sizes_and_scale(spark):
    assert values(spark, [("42,5",), (" 42 eu ",), ("",), (None,)], "s string", text.normalize_size(F.col("s"))) == [("42.5",), ("42 EU",), ("-",), ("-",)]
    assert values(spark, [(679900.0,), (15000.0,), (15000.01,), (1.0,), (None,)], "v double", text.scale_fix(F.col("v"))) == [(6799.0,), (15000.0,), (1500.0,), (1.0,), (None,)]


def test_family_key(spark):
    names = [("Asics Gel-Kayano 31 Siyah Erkek Koşu Ayakkabısı",), ("ASICS Gel-Kayano 31 Beyaz Kadın",), ("Gel-Kayano 31 GTS",), ("siyah",), ("",), (None,)]
    assert [r[0] for r in values(spark, names, "n string", text.family_key(F.col("n")))] == ["asics gel kayano 31", "asics gel kayano 31", "gel kayano 31 gts", None, None, None]


def test_names_tokens_and_labels(spark):
    c = F.col("n")
    assert values(spark, [("Nike  Air Max ",), ("Nike",), ("  ",)], "n string", text.brand_of(c), text.model_of(c)) == [("Nike", "Air Max"), ("Nike", "Model"), ("Bilinmeyen", "Model")]
    assert values(spark, [("abcdefghijkl",), ("short",), (None,)], "n string", text.mask_token(c)) == [("abcd...ijkl",), ("***",), ("",)]
    assert values(spark, [(1234567.5,)], "n double", text.money_text(c)) == [("1.234.567,50 TL",)]


def test_urls(spark):
    u = F.col("u")
    rows = [("https://www.Shop.example/a-b-c-d-eeeeeeeeeeeeeeeeeeee/?x=1",), ("http://a.example",), ("/just/a/path",), (None,)]
    assert values(spark, rows, "u string", text.url_host(u), text.is_product_link(u)) == [("shop.example", True), ("a.example", False), ("", False), (None, None)]


def test_chunks_and_challenges(spark):
    t = F.col("t")
    assert values(spark, [("x" * 600,), ("",), (None,)], "t string", F.size(text.chunks(t))) == [(3,), (0,), (0,)]
    assert values(spark, [("<b>Just a Moment</b>",), ("x" * 8000 + "recaptcha",), (None,)], "t string", text.bot_challenge(t)) == [(True,), (False,), (False,)]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("nike air max", "air max", 100, 100), ("nike air max 90", "asics gel", 0, 50), ("nike air zoom pegasus", "nike pegasus 41", 70, 95), ("", "x", 0, 0)])
def test_fuzzy_scores(a, b, low, high):
    assert low <= fuzzy.score(a, b) <= high
    assert fuzzy.score(a, b) == fuzzy.score(b, a)


def test_longest_common_subsequence():
    r = random.Random(2)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert fuzzy._common(a, b) == slow(a, b)


def test_dom():
    page = parse("<div class='a b'><p id=x>one<p>two <b>three</b></div><ul><li>1<li>2</ul><img src=i.png><div")
    assert page.first("div.a p").text() == "one"
    assert [n.text() for n in page.select("p, li")] == ["one", "two three", "1", "2"]
    assert page.first("[class*='b'] #x") is not None and page.first("ul img") is None
    assert parse("<div>" * 30_000 + "deep").text() == "deep"
    assert parse(None).text() == ""


def test_index_finds_what_a_walk_finds():
    r = random.Random(5)
    tags, classes = ("div", "p", "li", "a", "span", "img"), ("x", "price", "product-card", "y-price")
    for _ in range(60):
        html = "".join(r.choice((f'<{t} class="{r.choice(classes)} {r.choice(classes)}" id=i{r.randint(0, 3)}>', f"<{t} href=/u>", f"</{t}>", f"<{t}>", "text ")) for t in (r.choice(tags) for _ in range(40)))
        page = parse(html)
        for selector in ("div", ".price", "[class*='price']", "div.x", "p .price, li", "a[href]", "#i1", "[class*='card'] img, .x, span.y-price"):
            found = list(page.select(selector))
            index, page.index = page.index, None
            assert found == list(page.select(selector))
            page.index = index


def test_embedded_prices():
    state = lambda data: parse(f'<script id="__NEXT_DATA__">{json.dumps(data)}</script>')
    deep = {"price": 700}
    for _ in range(6):
        deep = {"in": deep}
    assert offers.embedded_prices(state([{"Sale_Price": "1.299,90", "price": {"price": 60}}, {"x": {"bestPrice": 80}}, {"price": 3}])) == [1299.9, 80.0]
    assert offers.embedded_prices(state(deep)) == [700.0] and offers.embedded_prices(state({"in": deep})) == []
    assert offers.embedded_prices(state([{"price": 60 + i} for i in range(30)])) == [60.0 + i for i in range(10)]
    assert offers.embedded_prices(state([{}] * 25 + [{"price": 60}])) == []
    page = parse('<script>dataLayer=[{"price":99,"name":"x"}]</script><script>INITIAL_STATE={"sellingPrice":"150,00","selling_price":"160","bestPrice" : 2}</script>')
    assert offers.embedded_prices(page) == [150.0, 160.0]


def test_extractors():
    from shelfspark.plans.pages import SAMPLES

    got = {name: offers.offer(html, url, slug) for name, slug, url, html in SAMPLES}
    short = {n: (o["title"], o["current_price"], o["old_price"], o["price_source"], o["stock_count"], o["in_stock"]) for n, o in got.items()}
    assert short == {
        "generic-json": ("Runner 5", 1299.9, None, "json_ld", 0, True),
        "generic-meta": ("Walker", 899.5, None, "meta", 0, True),
        "generic-state": ("S", 450.0, 600.0, "embedded_json", 0, True),
        "generic-css": (None, 2499.0, None, "selector:.price", 0, True),
        "intersport": (None, 2799.0, 3499.0, "cart_offer", 1, True),
        "intersport-scale": ("B", 6799.0, None, "json_ld", 0, True),
        "sportive": (None, 1499.99, None, "meta[name=og:price:amount]", 1, True),
        "decathlon": (None, 990.0, 1290.0, "product:price:amount", 1, True),
        "adidas": ("E", 2800.0, 3500.0, "json_ld:ProductGroup.hasVariant.offers.price", 1, True),
        "nike": ("F", 3199.9, None, "css", 1, True),
        "puma": ("G", 2099.0, None, "css", 2, True),
        "newbalance": ("H", 4799.0, None, "css", 1, True),
        "empty": (None, None, None, None, 0, False),
    }
    assert got["generic-json"]["brand"] == "Acme"
    assert [s["name"] for s in got["decathlon"]["sizes"]] == ["42", "43"]


def test_search_and_variants():
    html = """<script type="application/ld+json">{"itemListElement":[{"item":{"@type":"Product","name":"Nike Pegasus 41","url":"/nike-pegasus-41-erkek-kosu-p-123","offers":{"price":"4.299,00"}}}]}</script>
    <div class="product-card"><a href="/nike-pegasus-41-erkek-kosu-p-123?x=1">Nike Pegasus 41</a></div>
    <div class="product-card"><a href="/nike-pegasus-40-p-9" title="Nike Pegasus 40 Kadın"></a><span class="price">3.999 TL</span></div>
    <a href="#top">x</a><a href="https://other.example/nike-pegasus-p-1">Nike Pegasus elsewhere</a>"""
    found = offers.search_results(html, "nike pegasus", "https://shop.example/s?q=x", ("shop.example",), r"-p-\d+")
    assert [(r["url"], r["price"]) for r in found] == [("https://shop.example/nike-pegasus-41-erkek-kosu-p-123", 4299.0), ("https://shop.example/nike-pegasus-40-p-9", 3999.0)]
    page = parse('<div class="color-options"><a href="/p/red?c=1">r</a><a href="/p/blue">b</a><a href="https://x.example/p/y">y</a></div>')
    assert offers.variant_urls(page, "https://www.shop.example/p/blue") == ["https://www.shop.example/p/red"]


def test_catalog(spark):
    rows = spark.createDataFrame([("www.nike.com.tr",), ("shop.example",), ("tr.puma.com",)], "host string")
    assert [r.store for r in catalog.route(rows).collect()] == ["Nike TR", "shop.example", "Puma TR"]
    assert catalog.shops(spark).count() == 22


def test_search_pages(spark):
    from shelfspark.plans import QUERIES

    got = [(r["name"], r["place"], r["title"], r["url"], r["price"]) for r in QUERIES["X14_search_pages"](spark, "").collect()]
    assert sorted(got) == [
        ("cards", 0, "Nike Pegasus 41", "https://shop.example/nike-pegasus-41-erkek-kosu-ayakkabi", 4999.9),
        ("decathlon", 0, "Kiprun KS900", "https://www.decathlon.com.tr/p/kiprun-1", 2990.0),
        ("decathlon", 1, "Kiprun KS900", "https://www.decathlon.com.tr/p/kiprun-1", None),
        ("sportive", 0, "Adizero Evo SL", "https://www.sportive.com.tr/evo-sl", 10199.9),
    ]


def test_enrich(spark):
    results = spark.createDataFrame([(f"u{i}", 90 - i, 1.0, None) for i in range(10)], "url string, score int, price double, image string")
    found = spark.createDataFrame([("u0", 5.0, 9.0, "i.png", [("42", True), ("43", False)]), ("u9", 7.0, None, None, [])], "url string, current_price double, old_price double, image string, sizes array<struct<name:string,in_stock:boolean>>")
    got = {r.url: r for r in offers.enrich(results, found).collect()}
    assert (got["u0"].price, got["u0"].old_price, got["u0"].sizes_in_stock, got["u0"].sizes_total, got["u0"].enriched) == (5.0, 9.0, ["42"], 2, True)
    assert (got["u1"].price, got["u1"].enriched) == (1.0, False) and (got["u9"].price, got["u9"].enriched) == (1.0, None)


def test_profiles_families_and_models(spark):
    c = F.col
    rows = [("80", None, "42"), (None, "", None)]
    told = values(spark, rows, "weight string, usage string, shoe_size string", text.profile_text({k: c(k) for k in ("weight", "usage", "shoe_size")}))
    assert told == [("\n\nKullanici profili:\nKilo: 80\nAyakkabi numarasi: 42",), ("",)]
    assert values(spark, [("a", "a"), ("a", "b"), (None, "b"), (None, None)], "a string, b string", text.same_family(c("a"), c("b"))) == [(True,), (False,), (True,), (True,)]
    assert values(spark, [("x\n[MODELLER]: Nike A | ab | Asics B\ny",), ("none",)], "s string", text.suggested_models(c("s"))) == [(["Nike A", "Asics B"],), ([],)]
    assert values(spark, [(None,)], "v double", text.money_text(c("v")), text.date_text(c("v").cast("string").cast("timestamp"))) == [("—", "—")]


def test_instants(spark):
    cases = {
        "2024-01-31": 1706659200.0, "2024-01-31T10:20": 1706696400.0, "2024-01-31 10:20:30": 1706696430.0, "2024-01-31T10:20:30.25Z": 1706696430.25, "2024-01-31T10:20:30+03:00": 1706685630.0,
        "2024-01-31T10:20:30-0130": 1706701830.0, "2024-02-30": None, "2024-01-31T25:00": None, "2024": None, "": None, " 2024-01-31": None, "soon": None, None: None,
    }
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", F.unix_micros(text.instant(F.col("s"))).alias("m")).collect()
            assert {r.s: None if r.m is None else r.m / 1e6 for r in rows} == cases
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
