"""Plans over names, price texts, URLs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from ..sources.tables import Tables
from .registry import query

SKIP = str([*text.COLOUR_WORDS, *text.GENDER_WORDS, *text.GENERIC_WORDS])
FAMILY = f"nullif(array_to_string(list_filter(regexp_extract_all(lower(translate(name, '{text.TURKISH}', '{text.FOLDED}')), '[a-z0-9.]+'), lambda w: NOT list_contains({SKIP}, w))[1:6], ' '), '')"


@query("FN6_family_key", f"SELECT product_id, name, {FAMILY} AS family_key FROM products")
def family_key(t: Tables) -> DataFrame:
    return t.products().select("product_id", "name", text.family_key(F.col("name")).alias("family_key"))


@query("J6_family_siblings", f"""
f AS (SELECT product_id, label_price, {FAMILY} AS family FROM products WHERE active)
==
SELECT a.product_id, a.family, count(b.product_id) AS siblings, first(b.product_id ORDER BY b.label_price, b.product_id) FILTER (b.product_id IS NOT NULL) AS cheapest_sibling
FROM f a LEFT JOIN f b ON a.family = b.family AND a.product_id <> b.product_id GROUP BY 1, 2""")
def family_siblings(t: Tables) -> DataFrame:
    """The number of siblings and the cheapest other one. A family comes down to its size and two cheapest members first: no pairs are made."""
    p = t.products().where("active").select("product_id", "label_price", text.family_key(F.col("name")).alias("family"))
    first = p.groupBy("family").agg(F.count("*").alias("n"), F.min(F.struct("label_price", "product_id")).alias("a"))
    second = p.join(first, "family").where(F.col("product_id") != F.col("a.product_id")).groupBy("family").agg(F.min(F.struct("label_price", "product_id")).alias("b"))
    other = F.when(F.col("product_id") != F.col("a.product_id"), F.col("a.product_id")).otherwise(F.col("b.product_id"))
    return p.join(first, "family", "left").join(second, "family", "left").select("product_id", "family", F.coalesce(F.col("n") - 1, F.lit(0)).alias("siblings"), other.alias("cheapest_sibling"))


@query("FN10_split_product_name", r"""SELECT product_id, regexp_extract(name, '^\s*(\S+)', 1) AS brand, coalesce(nullif(regexp_extract(name, '^\s*\S+\s+(.*\S)', 1), ''), 'Model') AS model,
  trim(concat_ws(' ', regexp_extract(name, '^\s*(\S+)', 1), regexp_extract(name, '^\s*\S+\s+(.*\S)', 1))) AS display FROM products""")
def split_product_name(t: Tables) -> DataFrame:
    n = F.col("name")
    rest = F.regexp_extract(n, r"^\s*\S+\s+(.*\S)", 1)
    return t.products().select("product_id", text.brand_of(n).alias("brand"), text.model_of(n).alias("model"), F.trim(F.concat_ws(" ", text.brand_of(n), rest)).alias("display"))


@query("FN8_similarity", "SELECT product_id, CAST(CASE WHEN lower(name) = 'red widget' THEN 1.0 WHEN contains('red widget ring', lower(name)) OR contains(lower(name), 'red widget ring') THEN 0.7 ELSE 0.0 END AS DOUBLE) AS similarity FROM products")
def similarity(t: Tables) -> DataFrame:
    n = F.col("name")
    return t.products().select("product_id", F.greatest(F.when(text.similarity(n, F.lit("red widget")) == 1, 1.0).otherwise(0.0), text.similarity(n, F.lit("red widget ring"))).alias("similarity"))


PRICE_TEXTS = ["concat('₺', {n}, ',9')", "concat({n}, '.499')", "concat({n}, '.00 TL')", "concat('1.', {n}, ',50 tl')", "concat('1,234,', {n})", "concat('bedava ', '')", "concat('x', {n})"]


@query("FN1_parse_price_text", """
raw AS (SELECT product_id, CASE product_id % 7 """ + " ".join(f"WHEN {i} THEN {s.format(n='CAST(shoe_size + 100 AS VARCHAR)')}" for i, s in enumerate(PRICE_TEXTS)) + """ END AS txt FROM products),
k AS (SELECT *, regexp_replace(replace(replace(upper(txt), 'TL', ''), '₺', ''), '[^0-9.,]', '', 'g') AS t FROM raw),
v AS (SELECT *, CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(replace(t, '.', ''), ',', '.') WHEN contains(t, ',') THEN replace(t, ',', '.')
  WHEN length(t) - length(replace(t, '.', '')) > 1 OR regexp_matches(t, '^[0-9]*\\.[0-9]{3}$') THEN replace(t, '.', '') ELSE t END AS p FROM k)
==
SELECT product_id, txt, CASE WHEN round(TRY_CAST(p AS DOUBLE), 2) > 0 THEN round(TRY_CAST(p AS DOUBLE), 2) END AS price, TRY_CAST(nullif(regexp_replace(replace(replace(txt, '.', ''), ',', '.'), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS plain FROM v""")
def parse_price_text(t: Tables) -> DataFrame:
    n = (F.col("shoe_size") + 100).cast("string")
    kinds = [F.concat(F.lit("₺"), n, F.lit(",9")), F.concat(n, F.lit(".499")), F.concat(n, F.lit(".00 TL")), F.concat(F.lit("1."), n, F.lit(",50 tl")), F.concat(F.lit("1,234,"), n), F.lit("bedava "), F.concat(F.lit("x"), n)]
    given = t.products().select("product_id", F.get(F.array(*kinds), (F.col("product_id") % 7).cast("int")).alias("txt"))
    return given.select("product_id", "txt", text.parse_price_text(F.col("txt")).alias("price"), text.parse_price_plain(F.col("txt")).alias("plain"))


@query("FN4_scale_fix", """SELECT product_id, round(CASE WHEN v > 15000000 THEN v / 10 / 10 / 10 / 10 WHEN v > 1500000 THEN v / 10 / 10 / 10 WHEN v > 150000 THEN v / 10 / 10 WHEN v > 15000 THEN v / 10 ELSE v END, 2) AS price
FROM (SELECT product_id, label_price * power(10, product_id % 4) AS v FROM products)""")
def scale_fix(t: Tables) -> DataFrame:
    return t.products().select("product_id", text.scale_fix(F.col("label_price") * F.pow(F.lit(10.0), F.col("product_id") % 4)).alias("price"))


@query("FN5_normalize_size", """SELECT product_id, CASE WHEN coalesce(s, '') = '' THEN '-' ELSE upper(trim(replace(s, ',', '.'))) END AS size
FROM (SELECT product_id, CASE WHEN product_id % 5 = 0 THEN NULL WHEN product_id % 5 = 1 THEN '' WHEN product_id % 5 = 2 THEN ' ' || shoe_size || ',5 eu ' ELSE CAST(shoe_size AS VARCHAR) END AS s FROM products)""")
def normalize_size(t: Tables) -> DataFrame:
    n = F.col("product_id") % 5
    s = F.when(n == 0, F.lit(None)).when(n == 1, "").when(n == 2, F.concat(F.lit(" "), F.col("shoe_size"), F.lit(",5 eu "))).otherwise(F.col("shoe_size").cast("string"))
    return t.products().select("product_id", text.normalize_size(s).alias("size"))


@query("FN12_labels", """SELECT product_id, CASE WHEN length(name) <= 8 THEN '***' ELSE substr(name, 1, 4) || '...' || right(name, 4) END AS masked,
  trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS query, 'https://shop.example/s?q=' || replace(name, ' ', '+') AS url,
  CASE WHEN shoe_size % 3 = 0 THEN shoe_size || '/50 beden' WHEN active THEN 'Stokta' ELSE 'Belirsiz' END AS stock,
  CASE WHEN product_id % 2 = 0 THEN 'Sepet indirimi' ELSE 'Normal fiyat' END AS price_type,
  replace(replace(replace(format('{:,.2f}', label_price), ',', '#'), '.', ','), '#', '.') || ' TL' AS price FROM products""")
def labels(t: Tables) -> DataFrame:
    n = F.col("name")
    stock = text.stock_text(F.col("shoe_size"), F.when(F.col("shoe_size") % 3 == 0, 50).otherwise(0), F.col("active"))
    cart = F.when(F.col("product_id") % 2 == 0, F.lit(1.0))
    return t.products().select("product_id", text.mask_token(n).alias("masked"), text.normalize_query(n).alias("query"), text.search_url("https://shop.example/s?q={q}", n).alias("url"), stock.alias("stock"), text.price_type(cart).alias("price_type"), text.money_text(F.col("label_price")).alias("price"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("FN16_url_parts", f"""SELECT page_id, {HOST} AS host, {PATH} AS path, regexp_replace(split_part(url, '?', 1), '/+$', '') AS bare,
  length({PATH}) - length(replace({PATH}, '-', '')) >= 3 AND length({PATH}) > 25 AS product_link, regexp_matches(url, '/[a-z]{{2}}/[0-9]+') AS pattern_link FROM pages""", views=False)
def url_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.raw("pages").select("page_id", text.url_host(u).alias("host"), text.url_path(u).alias("path"), text.strip_query(u).alias("bare"), text.is_product_link(u).alias("product_link"), text.is_product_link(u, "/[a-z]{2}/[0-9]+").alias("pattern_link"))


_HOSTS = ", ".join(f"('{d}')" for shop in catalog.SHOPS for d in shop[2])
_ROUTED = " ".join("WHEN " + " OR ".join(f"contains(host, '{d}')" for d in shop[2]) + f" THEN '{shop[0]}'" for shop in catalog.SHOPS)


@query("J9_url_route", f"""WITH d AS (SELECT list(h ORDER BY h) AS hosts FROM (VALUES {_HOSTS}) v(h)),
h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {HOST} ELSE 'www.' || hosts[page_id % len(hosts) + 1] END AS host FROM pages, d)
SELECT page_id, host, CASE {_ROUTED} ELSE host END AS store FROM h""", views=False)
def url_route(t: Tables) -> DataFrame:
    """Pages against the whole catalog: two of three hosts are a shop's."""
    hosts = sorted(d for shop in catalog.SHOPS for d in shop[2])
    known = F.concat(F.lit("www."), F.get(F.array(*[F.lit(h) for h in hosts]), (F.col("page_id") % len(hosts)).cast("int")))
    return catalog.route(t.raw("pages").select("page_id", F.when(F.col("page_id") % 3 == 0, text.url_host(F.col("url"))).otherwise(known).alias("host")))


@query("J8_url_dedupe", """WITH bare AS (SELECT page_id, url, trim(split_part(split_part(url, '?', 1), '#', 1)) AS u FROM pages), tracked AS (SELECT DISTINCT u FROM bare WHERE contains(url, '?')) SELECT page_id FROM bare WHERE NOT contains(url, '?') AND u NOT IN (SELECT u FROM tracked)""", views=False)
def url_dedupe(t: Tables) -> DataFrame:
    """Pages without a query whose address isn't tracked yet by one with a query."""
    pages = t.raw("pages").select("page_id", F.col("url").contains("?").alias("tracked"), F.trim(F.substring_index(F.substring_index("url", "?", 1), "#", 1)).alias("u"))
    return pages.where("not tracked").join(pages.where("tracked").select("u").distinct(), "u", "left_anti").select("page_id")


@query("F24_bot_challenge", "SELECT page_id, " + " OR ".join(f"contains(lower(substr(html, 1, 8000)), '{w}')" for w in text.CHALLENGE_TOKENS) + " OR contains(lower(substr(html, 1, 8000)), 'ad 0') AS challenge FROM pages", views=False)
def bot_challenge(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", (text.bot_challenge(F.col("html")) | F.lower(F.substring("html", 1, 8000)).contains("ad 0")).alias("challenge"))


@query("F25_error_status", """SELECT event_id, CASE WHEN regexp_matches(m, '403|429') THEN 'blocked' WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, '404') THEN 'missing' ELSE 'error' END AS status
FROM (SELECT event_id, lower(['HTTP 403', 'Timeout after 20 s', 'HTTP 404', 'HTTP 500', 'HTTP 429'][event_id % 5 + 1]) AS m FROM events)""", views=False)
def error_status(t: Tables) -> DataFrame:
    said = F.get(F.array(*[F.lit(m) for m in ("HTTP 403", "Timeout after 20 s", "HTTP 404", "HTTP 500", "HTTP 429")]), (F.col("event_id") % 5).cast("int"))
    return t.raw("events").select("event_id", text.fetch_status(said).alias("status"))


@query("F26_usable_image", """SELECT page_id, NOT (contains(u, 'favicon') OR contains(u, 'logo.svg') OR contains(u, '/logo') OR contains(u, 'sprite') OR contains(u, 'placeholder') OR contains(u, 'blank.gif') OR contains(u, 'loader')) AND NOT (u LIKE '%.svg' AND NOT contains(u, 'product')) AS usable
FROM (SELECT page_id, lower(url) || ['/a.jpg', '/logo.png', '/x.svg', '/product.svg', '/favicon.ico'][page_id % 5 + 1] AS u FROM pages)""", views=False)
def usable_image(t: Tables) -> DataFrame:
    tail = F.get(F.array(*[F.lit(m) for m in ("/a.jpg", "/logo.png", "/x.svg", "/product.svg", "/favicon.ico")]), (F.col("page_id") % 5).cast("int"))
    return t.raw("pages").select("page_id", text.usable_image(F.concat("url", tail)).alias("usable"))


def _catalog_sql() -> str:
    text_of = lambda v: "NULL" if v is None else "'" + v + "'"
    rows = ", ".join(f"({i}, {text_of(n)}, {text_of(s)}, {list(d)}, {text_of(p)}, {js}, {br})" for i, (n, s, d, p, js, br) in enumerate(catalog.SHOPS))
    return f"SELECT * FROM (VALUES {rows}) AS v(ordinal, name, slug, domains, product_pattern, js_search, use_browser)"


@query("SRC12_shop_catalog", _catalog_sql(), views=False)
def shop_catalog(t: Tables) -> DataFrame:
    return catalog.shops(t.spark)
