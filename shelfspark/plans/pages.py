"""Plans over pages and searches, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import offers, text
from ..operators import search
from ..sources.kept import new_folder
from ..sources.tables import Tables
from ..streaming import radar
from .registry import query

# Small pages of our own, one for each way in which shops show an offer.
SAMPLES = [
    ("generic-json", "", "https://shop.example/x-1", '<title>T</title><script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"Runner 5","brand":{"name":"Acme"},"offers":{"offers":[{"price":"1.299,90","availability":"InStock"}]}}]}</script>'),
    ("generic-meta", "", "https://shop.example/x-2", '<meta property="og:title" content="Walker"><meta property="product:price:amount" content="899.50">'),
    ("generic-state", "", "https://shop.example/x-3", '<title>S</title><script id="__NEXT_DATA__">{"a":[{"sellingPrice":450,"price":"600,00"}]}</script>'),
    ("generic-css", "", "https://shop.example/x-4", '<h1>C</h1><div class="price">2.499 TL</div>'),
    ("intersport", "intersport", "https://www.intersport.com.tr/urun/a", '<div class="product-item__offers"><div class="product-item__offer-price"><pz-price>2.799,00 TL</pz-price></div></div><div class="product-price"><pz-price>3.499,00</pz-price><pz-price>3.999,00</pz-price></div><pz-variant key="integration_beden"><pz-variant-option label="42" selectable></pz-variant-option><pz-variant-option label="43"></pz-variant-option></pz-variant>'),
    ("intersport-scale", "intersport", "https://www.intersport.com.tr/urun/b", '<script type="application/ld+json">{"@type":"Product","name":"B","offers":{"price":679900}}</script>'),
    ("sportive", "sportive", "https://www.sportive.com.tr/c", '<meta name="og:price:amount" content="1499.99"><button id="41">41</button><button id="42,5"><p>Tükendi</p></button>'),
    ("decathlon", "decathlon", "https://www.decathlon.com.tr/d", '<meta property="product:price:amount" content="990"><meta property="product:original_price:amount" content="1290"><p>42 Stokta Mevcut</p><p>43 Stokta Mevcut Değil</p>'),
    ("adidas", "adidas", "https://www.adidas.com.tr/e", '<script type="application/ld+json">{"@type":"ProductGroup","name":"E","hasVariant":[{"size":"41","offers":{"price":3000,"availability":"OutOfStock"}},{"size":"42","offers":{"price":2800,"availability":"InStock","priceSpecification":{"priceType":"https://schema.org/StrikethroughPrice","price":3500}}}]}</script>'),
    ("nike", "nike", "https://www.nike.com/tr/t/f", '<title>F</title><div data-testid="currentPrice-1">3.199,90 TL</div><label>42</label><label disabled>43</label><label>Renk</label>'),
    ("puma", "puma", "https://tr.puma.com/pd/g.html", '<title>G</title><div class="sales"><span class="value">2.099,00 TL</span></div><button data-attr-value="41"></button><button data-attr-value="42.5" disabled></button>'),
    ("newbalance", "newbalance", "https://www.newbalance.com.tr/urun/h", '<title>H</title><div class="product-price">4.799 TL</div><div class="size-list"><label>44</label><label class="disabled">45</label></div>'),
    ("empty", "", "", ""),
]


@query("X4_offer_extract")
def offer_extract(t: Tables) -> DataFrame:
    pages = t.spark.createDataFrame(SAMPLES, "name string, slug string, url string, html string")
    return offers.extract_offers(pages, "name", slug="slug")


@query("X4_page_offers")
def page_offers(t: Tables) -> DataFrame:
    return offers.extract_offers(t.raw("pages"), "page_id").select("page_id", "title", "current_price", "price_source", "in_stock")


PRICED = "page_id % 20000 + 100"


def _priced_pages(t: Tables) -> DataFrame:
    """All landed pages with a price put into each, in one of four ways by page_id, and a struck one or a colour variant in some."""
    value = (F.col("page_id") % 20000 + 100).cast("string")
    head = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<meta property="product:price:amount" content="'), value, F.lit('.50">')))
    head = head.when(F.col("page_id") % 4 == 1, F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"P","offers":{"price":'), value, F.lit(',"availability":"OutOfStock"}}</script>')))
    head = head.when(F.col("page_id") % 4 == 2, F.concat(F.lit('<script>window.INITIAL_STATE={"sellingPrice":"'), value, F.lit(',00","bestPrice":'), value, F.lit("9}</script>")))
    body = F.concat(F.when(F.col("page_id") % 4 == 3, F.concat(F.lit('<div class="price">'), value, F.lit(",90 TL</div>"))).otherwise(""), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<p class="color-options"><a href="/renk/'), value, F.lit('?c=1">x</a><a href="https://other.example/y">y</a></p>'))).otherwise(""))
    return t.raw("pages").select("page_id", "url", F.concat(F.lit("<html><head>"), F.coalesce(head, F.lit("")), F.lit("</head><body>"), body, F.col("html"), F.lit("</body></html>")).alias("html"))


@query("X4_priced_pages", f"""SELECT page_id, CAST({PRICED} AS DOUBLE) + [0.5, 0, 0, 0.9][page_id % 4 + 1] AS current_price, ['meta', 'json_ld', 'embedded_json', 'selector:.price'][page_id % 4 + 1] AS price_source,
  CASE WHEN page_id % 4 = 2 AND ({PRICED}) * 10 + 9 < 200000 THEN CAST(({PRICED}) * 10 + 9 AS DOUBLE) END AS old_price, page_id % 4 <> 1 AS in_stock FROM pages""", views=False)
def priced_pages(t: Tables) -> DataFrame:
    return offers.extract_offers(_priced_pages(t), "page_id").select("page_id", "current_price", "price_source", "old_price", "in_stock")


@query("X13_variant_urls", f"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/renk/' || CAST({PRICED} AS VARCHAR) AS variant FROM pages WHERE page_id % 3 = 0""", views=False)
def page_variants(t: Tables) -> DataFrame:
    """Links to other colours on the same host, for each page that has any."""
    return offers.extract_offers(_priced_pages(t), "page_id").select("page_id", F.explode("variant_urls").alias("variant"))


@query("X12_page_titles")
def page_titles(t: Tables) -> DataFrame:
    return offers.page_heads(t.raw("pages"))


@query("X13_page_links", """SELECT page_id, CAST(i - 1 AS INT) AS n, CASE WHEN l[i] LIKE 'http%' THEN l[i] ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || l[i] END AS link
FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"#][^"]*)"', 1) AS l FROM pages))""", views=False)
def page_links(t: Tables) -> DataFrame:
    return offers.page_links(t.raw("pages"))


# Small result pages of our own.
SEARCHES = [
    ("cards", "", "https://shop.example/s?q=x", "nike pegasus", '<div class="product-card"><a href="/nike-pegasus-41-erkek-kosu-ayakkabi">Nike Pegasus 41</a><span class="price">4.999,90 TL</span></div><a href="/about">About</a>'),
    ("decathlon", "decathlon", "https://www.decathlon.com.tr/search", "kiprun", '<article><a href="/p/kiprun-1"><h2>Kiprun KS900</h2></a><span class="price">2.990 TL</span></article><article><a href="/p/kiprun-1"><h2>Kiprun KS900</h2></a></article>'),
    ("sportive", "sportive", "https://www.sportive.com.tr/s", "evo sl", r'<script>self.push("{\"products\":[{\"name\":\"Adizero Evo SL\",\"absolute_url\":\"/evo-sl\",\"price\":\"10.199,90\",\"in_stock\":true},{\"name\":\"Evo SL old\",\"absolute_url\":\"/old\",\"in_stock\":false}]}")</script>'),
]


@query("X14_search_pages")
def search_pages(t: Tables) -> DataFrame:
    pages = t.spark.createDataFrame(SEARCHES, "name string, slug string, url string, query string, html string")
    return offers.search_pages(pages, "name", {"": (("shop.example",), None)})


ASKED = "small red widget"

#: Names with their score against ASKED: the longest common subsequence is counted by one bit row, a character a step.
SCORED = """
f AS (SELECT name, list_sort(list_distinct(string_split(lower(trim(name)), ' '))) AS w FROM (SELECT DISTINCT name FROM products)),
g AS (SELECT name, list_filter(['red', 'small', 'widget'], lambda x: list_contains(w, x)) AS b, list_filter(['red', 'small', 'widget'], lambda x: NOT list_contains(w, x)) AS l, list_filter(w, lambda x: NOT list_contains(['red', 'small', 'widget'], x)) AS r FROM f),
h AS (SELECT name, array_to_string(b, ' ') AS base, array_to_string(b || l, ' ') AS one, array_to_string(b || r, ' ') AS two, len(b) > 0 AND (len(l) = 0 OR len(r) = 0) AS whole FROM g),
c AS (SELECT name, one, two, 0 AS i, (1::BIGINT << len(one)) - 1 AS v FROM h
  UNION ALL SELECT name, one, two, i + 1, ((v + (v & m)) | (v & ~m)) & ((1::BIGINT << len(one)) - 1)
  FROM (SELECT *, CAST(list_sum(list_transform(range(len(one)), lambda k: CASE WHEN substr(one, k + 1, 1) = substr(two, i + 1, 1) THEN 1::BIGINT << k ELSE 0 END)) AS BIGINT) AS m FROM c WHERE i < len(two))),
k AS (SELECT h.name, CAST(CASE WHEN whole THEN 100 ELSE round_even(greatest(200::DOUBLE * (len(h.one) - bit_count(v)) / (len(h.one) + len(h.two)),
  CASE WHEN base <> '' THEN 200::DOUBLE * len(base) / (len(base) + len(h.one)) END, CASE WHEN base <> '' THEN 200::DOUBLE * len(base) / (len(base) + len(h.two)) END), 0) END AS INT) AS score
  FROM h JOIN c ON c.name = h.name AND c.i = len(c.two)),
s AS (SELECT store_id, product_id, p.name, l.price, score FROM listings l JOIN products p USING (product_id) JOIN k ON k.name = p.name WHERE score >= 50)"""


def _scored(t: Tables) -> DataFrame:
    """Listings whose names score 50 or more against one query; a name is scored once, however many products bear it."""
    found = search.matches(t.products(), ASKED, 50)
    named = t.products().select("product_id", "name").join(found, "name")
    return t.listings().join(named, "product_id").select("store_id", "product_id", "name", "price", "score")


@query("FN7_search_scored", SCORED + """
==
SELECT * FROM s""")
def search_scored(t: Tables) -> DataFrame:
    return _scored(t)


@query("F18_index_search", SCORED + """
==
SELECT product_id, score FROM products p JOIN k USING (name) WHERE score >= 45""")
def index_search(t: Tables) -> DataFrame:
    """Products whose names score 45 or more, found in a kept index of all names."""
    found = search.NameIndex(t.spark, new_folder(t.spark, "names")).write(t.products()).search(ASKED, 45)
    return t.products().select("product_id", "name").join(found, "name").select("product_id", "score")


@query("W6_search_topk_per_store", SCORED + """,
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY store_id, name ORDER BY score DESC, price, product_id) = 1)
==
SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY score DESC, price, product_id) AS INT) AS place FROM o QUALIFY place <= 6""")
def search_topk(t: Tables) -> DataFrame:
    best = Window.partitionBy("store_id").orderBy(F.desc("score"), "price", "product_id")
    first = Window.partitionBy("store_id", "name").orderBy(F.desc("score"), "price", "product_id")
    once = _scored(t).withColumn("n", F.row_number().over(first)).where("n = 1")
    return once.withColumn("place", F.row_number().over(best)).where("place <= 6").drop("n")


@query("W6_topk_by_length", """
s AS (SELECT l.store_id, l.product_id, p.name, l.price, length(p.name) AS score FROM listings l JOIN products p USING (product_id)),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY store_id, name ORDER BY price, product_id) = 1)
==
SELECT store_id, product_id, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, price, product_id) AS place FROM o QUALIFY place <= 6""")
def topk_by_length(t: Tables) -> DataFrame:
    s = t.listings().join(t.products().select("product_id", "name"), "product_id").withColumn("score", F.length("name"))
    once = s.withColumn("n", F.row_number().over(Window.partitionBy("store_id", "name").orderBy("price", "product_id"))).where("n = 1")
    best = Window.partitionBy("store_id").orderBy(F.desc("score"), "price", "product_id")
    return once.withColumn("place", F.row_number().over(best).cast("long")).where("place <= 6").select("store_id", "product_id", "place")


@query("U1_search_union", """
a AS (SELECT store_id, product_id, 0 AS src FROM listings WHERE price < 3000 UNION ALL SELECT store_id, product_id, 1 FROM listings WHERE price > 2000),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY src) = 1)
==
SELECT store_id, count(*) AS results, count(*) FILTER (src = 1) AS rendered FROM d GROUP BY store_id""")
def search_union(t: Tables) -> DataFrame:
    l = t.listings().select("store_id", "product_id", "price")
    both = l.where("price < 3000").withColumn("src", F.lit(0)).unionByName(l.where("price > 2000").withColumn("src", F.lit(1)))
    once = both.groupBy("store_id", "product_id").agg(F.min("src").alias("src"))
    return once.groupBy("store_id").agg(F.count("*").alias("results"), F.count_if(F.col("src") == 1).alias("rendered"))


@query("T7_enrich_top8", """
r AS (SELECT product_id * 100000 + store_id AS url, price, CAST(product_id % 50 + 50 AS INT) AS score, in_stock, size FROM listings),
b AS (SELECT url FROM r ORDER BY score DESC, CAST(url AS VARCHAR) LIMIT 8)
==
SELECT CAST(url AS VARCHAR) AS url, CASE WHEN url IN (SELECT url FROM b) AND url % 2 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN url IN (SELECT url FROM b) THEN url % 2 = 0 END AS enriched, CASE WHEN url IN (SELECT url FROM b) AND url % 2 = 0 THEN 2 END AS sizes_total FROM r""")
def enrich_top8(t: Tables) -> DataFrame:
    """The eight best results take price and sizes from their own page, where that was read: every second one."""
    url = F.col("product_id") * 100_000 + F.col("store_id")
    listed = t.listings().select(url.alias("n"), "price", (F.col("product_id") % 50 + 50).cast("int").alias("score"), "size")
    results = listed.select(F.col("n").cast("string").alias("url"), "score", "price", F.lit(None).cast("string").alias("image"))
    entry = lambda name, ok: F.struct(name.alias("name"), F.lit(ok).alias("in_stock"))
    read = listed.where("n % 2 = 0").select(F.col("n").cast("string").alias("url"), (F.col("price") + 1).alias("current_price"), F.lit(None).cast("double").alias("old_price"), F.lit(None).cast("string").alias("image"), F.array(entry(F.col("size").cast("string"), True), entry(F.lit("x"), False)).alias("sizes"))
    return offers.enrich(results, read).select("url", "price", "enriched", "sizes_total")


@query("X14_pages_searched")
def pages_searched(t: Tables) -> DataFrame:
    """All landed pages read as search pages, for one search."""
    pages = t.raw("pages").select("page_id", "html", "url", F.lit("the and").alias("query"), F.lit("any").alias("slug"))
    return offers.search_pages(pages, "page_id", {"any": (("example",), ".*")})


@query("ST2_stream_radar", """
d AS (SELECT *, lag(price) OVER w AS previous_price, lag(checked_at) OVER w AS before FROM ticks WINDOW w AS (PARTITION BY listing_id ORDER BY checked_at, tick_id))
==
SELECT tick_id, listing_id, price, previous_price FROM d WHERE epoch_us(checked_at) - epoch_us(before) <= 3 * 86400000000 AND previous_price BETWEEN 50 AND 200000 AND previous_price <= price * 5 AND price < previous_price * 0.97""")
def stream_radar(t: Tables) -> DataFrame:
    """Price drops against a last price of at most three days."""
    found = radar.run_available(radar.drop_alerts(radar.as_ticks(radar.source(t.spark, t.sf_dir, "events")), keep_days=3), *radar.new_folders(t.spark))
    return found.select("tick_id", "listing_id", "price", "previous_price")


@query("ST3_stream_cooldown", """
h AS (SELECT *, coalesce(nullif(CAST(rule_id % 4 * 12 AS DOUBLE), 0), 24) AS hours FROM alerts),
RECURSIVE_f AS (SELECT rule_id, listing_id, min({'t': created_at, 'a': alert_id}) AS f FROM h GROUP BY 1, 2
  UNION ALL SELECT h.rule_id, h.listing_id, min({'t': h.created_at, 'a': h.alert_id}) FROM RECURSIVE_f f JOIN h ON h.rule_id = f.rule_id AND h.listing_id = f.listing_id AND epoch_us(h.created_at) - epoch_us(f.f.t) >= h.hours * 3600000000 GROUP BY 1, 2)
==
SELECT rule_id, listing_id, f.a AS alert_id FROM RECURSIVE_f""")
def stream_cooldown(t: Tables) -> DataFrame:
    return radar.run_available(radar.cooled_alerts(radar.as_alerts(radar.source(t.spark, t.sf_dir, "events"))), *radar.new_folders(t.spark))
