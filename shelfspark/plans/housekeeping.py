"""Plans of upkeep: instants, settings, backfills, batch order, older rules, and shops and readers of one's own."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import offers, text
from ..operators import catalog, rules, state
from ..sources.tables import Tables, cents
from .alerts import LISTED, whole_listings, whole_rules
from .registry import query
from .texts import FAMILY, HOST


@query("FN19_iso_instants", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 3 * 3600000000
  WHEN 2 THEN epoch_us(date_trunc('minute', ts)) WHEN 3 THEN epoch_us(date_trunc('day', ts)) END AS micros FROM events""", views=False)
def iso_instants(t: Tables) -> DataFrame:
    """Instants written in four ways, and two texts that are none."""
    at = lambda form: F.date_format("ts", form)
    way = F.col("event_id") % 6
    said = F.when(way == 0, at("yyyy-MM-dd'T'HH:mm:ss")).when(way == 1, F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit("+03:00"))).when(way == 2, F.concat(at("yyyy-MM-dd'T'HH:mm"), F.lit("Z")))
    said = said.when(way == 3, at("yyyy-MM-dd")).when(way == 4, "2024-02-30T10:00:00").otherwise("yesterday")
    return t.raw("events").select("event_id", F.unix_micros(text.instant(said)).alias("micros"))


@query("SRC10_settings", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 60 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS minutes, event_id % 4 = 1 AS on_now, CASE WHEN event_id % 4 IN (0, 2) THEN 'light' ELSE event_type END AS theme FROM events""", views=False)
def settings(t: Tables) -> DataFrame:
    """Saved settings over their defaults: every fourth text is broken, others leave something out."""
    every = F.regexp_extract("props", "[0-9]+", 0)
    theme = F.when(F.col("event_id") % 4 == 2, ',"theme":null').otherwise(F.concat(F.lit(',"theme":"'), "event_type", F.lit('"')))
    saved = F.concat(F.lit('{"scheduler":{'), F.when(F.col("event_id") % 4 == 1, '"enabled":true,').otherwise(""), F.lit('"interval_minutes":'), every, F.lit("}"), theme, F.lit("}"))
    given = t.raw("events").select("event_id", F.when(F.col("event_id") % 4 != 0, saved).otherwise('{"scheduler":').alias("raw"))
    read = state.read_settings(given, "raw", "event_id", {"scheduler": {"enabled": False, "interval_minutes": 60}, "theme": "light"})
    return read.select("event_id", F.col("scheduler.interval_minutes").alias("minutes"), F.col("scheduler.enabled").alias("on_now"), "theme")


@query("SNK14_family_backfill", f"SELECT product_id, CASE WHEN product_id % 3 = 1 THEN 'set' ELSE {FAMILY} END AS family_key FROM products")
def family_backfill(t: Tables) -> DataFrame:
    """Family keys for products that have none yet."""
    given = t.products().withColumn("family_key", F.when(F.col("product_id") % 3 == 1, "set").when(F.col("product_id") % 3 == 2, ""))
    return state.backfill(given, "family_key", text.family_key(F.col("name"))).select("product_id", "family_key")


@query("F3_rules_of_listed", "SELECT rule_id, product_id FROM rules WHERE product_id IN (SELECT product_id FROM listings WHERE in_stock AND store_id % 5 = 0)")
def rules_of_listed(t: Tables) -> DataFrame:
    return rules.rules_of(t.rules(), t.listings().where("in_stock and store_id % 5 = 0")).select("rule_id", "product_id")


@query("F15_legacy_matches", LISTED + """,
c AS (SELECT r.rule_id, r.product_id, l.store_id, l.listing_id, l.price, l.listed, r.want, st.any_ok FROM rl r JOIN lid l ON l.product_id = r.product_id AND l.price <= r.target_price JOIN st ON st.product_id = l.product_id AND st.store_id = l.store_id),
m AS (SELECT c.*, sz.label, coalesce(sz.ok, false) AS ok FROM c LEFT JOIN sz ON sz.product_id = c.product_id AND sz.store_id = c.store_id AND replace(sz.label, ',', '.') = c.want)
==
SELECT rule_id, product_id, listing_id, price, CASE WHEN want IS NOT NULL THEN label WHEN listed THEN 'Herhangi Bir Beden' ELSE 'Beden Bilgisi Yok' END AS size FROM m WHERE CASE WHEN want IS NOT NULL THEN listed AND ok WHEN listed THEN any_ok ELSE true END""")
def legacy_matches(t: Tables) -> DataFrame:
    return rules.legacy_matches(whole_rules(t), whole_listings(t))


@query("F28_sized_listings", LISTED + """
==
SELECT lid.listing_id, count(*) AS n_sizes, count(*) FILTER (sz.ok) AS n_in_stock FROM lid JOIN sz ON sz.product_id = lid.product_id AND sz.store_id = lid.store_id WHERE lid.listed GROUP BY 1""")
def sized_listings(t: Tables) -> DataFrame:
    """Listings that show any sizes, with how many of them are in stock."""
    shown = whole_listings(t).where("active").where(F.size("last_sizes") > 0)
    return shown.select(F.col("id").alias("listing_id"), F.size("last_sizes").cast("long").alias("n_sizes"), F.size(F.filter("last_sizes", lambda s: s["in_stock"])).cast("long").alias("n_in_stock"))


@query("T13_batch_order", """SELECT product_id, store_id, min(checked_at) AS first_seen FROM history GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 500""")
def batch_order(t: Tables) -> DataFrame:
    """The 500 listings that a batch checks: the oldest ones."""
    seen = t.history().groupBy("product_id", "store_id").agg(F.min("checked_at").alias("first_seen"))
    return seen.orderBy("first_seen", "product_id", "store_id").limit(500)


@query("T5_first_products", "SELECT product_id, name FROM products WHERE active ORDER BY product_id LIMIT 200")
def first_products(t: Tables) -> DataFrame:
    """A capped list without an order of its own: by id, so that reruns agree."""
    return t.products().where("active").orderBy("product_id").select("product_id", "name").limit(200)


def _length(html: str | None, url: str) -> dict[str, Any]:
    return offers.own_offer(current_price=float(len(html or "")), price_source="length", in_stock=True)


@query("UD1_own_reader", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(length(html) AS DOUBLE) END AS current_price, CASE WHEN page_id % 2 = 0 THEN 'length' END AS price_source FROM pages""", views=False)
def own_reader(t: Tables) -> DataFrame:
    """A reader of one's own for every second page; the others have no price."""
    given = t.raw("pages").withColumn("slug", F.when(F.col("page_id") % 2 == 0, "own").otherwise("none"))
    found = offers.extract_offers(given, "page_id", slug="slug", readers={"own": _length, "none": lambda html, url: offers.own_offer()})
    return found.select("page_id", "current_price", "price_source")


@query("UD2_own_shops", f"""SELECT page_id, CASE WHEN {HOST} LIKE '%example.org%' THEN 'Org' WHEN {HOST} LIKE '%example.net%' OR {HOST} LIKE '%m.th%' THEN 'Net' ELSE {HOST} END AS store FROM pages""", views=False)
def own_shops(t: Tables) -> DataFrame:
    """Shops that are nothing but a name and domains."""
    known = catalog.with_own(("Org", ["example.org"]), ("Net", ["example.net", "m.th"]))
    return catalog.route(t.raw("pages").select("page_id", text.url_host(F.col("url")).alias("host")), known).select("page_id", "store")


@query("SNK15_manual_prices", """
e AS (SELECT product_id, store_id, product_id * 100000 + store_id AS id, floor((price - 900) * 100 + 0.5) / 100 AS entered, checked_at AS said_at FROM history WHERE discount >= 0.09),
v AS (SELECT *, count(*) OVER (PARTITION BY id) AS entries FROM e WHERE entered > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY said_at DESC, entered DESC) = 1)
==
SELECT l.product_id * 100000 + l.store_id AS id, coalesce(v.entered, l.price) AS last_price, CASE WHEN v.id IS NULL THEN 'shelf' ELSE 'manual' END AS last_price_source, CASE WHEN v.id IS NULL THEN 0.5::DOUBLE ELSE 0.99::DOUBLE END AS last_confidence,
  coalesce(v.said_at, l.checked_at) AS last_checked_at, l.size, coalesce(v.entries, 0) AS entries FROM listings l LEFT JOIN v ON v.id = l.product_id * 100000 + l.store_id""")
def manual_prices(t: Tables) -> DataFrame:
    """Listings after prices were entered by hand, some of them refused and some listings' more than once, with the number of history rows of each."""
    number = (F.col("product_id") * 100_000 + F.col("store_id")).alias("id")
    listed = t.listings().select(number, "product_id", F.col("price").alias("last_price"), F.lit("shelf").alias("last_price_source"), F.lit(0.5).alias("last_confidence"), F.col("checked_at").alias("last_checked_at"), "size")
    entered = t.history().where("discount >= 0.09").select(number, cents(F.col("price") - 900).alias("price"), F.col("checked_at").alias("at"))
    put, rows = state.manual_prices(listed, entered)
    entries = rows.groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("entries"))
    return put.join(entries, "id", "left").select("id", "last_price", "last_price_source", "last_confidence", "last_checked_at", "size", F.coalesce("entries", F.lit(0)).alias("entries"))


@query("SNK4_image_fill", """
o AS (SELECT product_id, max({'at': checked_at, 'image': 'img-' || store_id}).image AS image FROM history GROUP BY 1)
==
SELECT p.product_id, CASE WHEN p.product_id % 3 = 2 THEN 'own' ELSE coalesce(o.image, CASE WHEN p.product_id % 3 = 1 THEN '' END) END AS image FROM products p LEFT JOIN o USING (product_id)""")
def image_fill(t: Tables) -> DataFrame:
    """Products whose image is null or empty take the newest observed one; an image that is there stays."""
    products = t.products().select("product_id", F.when(F.col("product_id") % 3 == 1, "").when(F.col("product_id") % 3 == 2, "own").alias("image"), F.lit(None).cast(t.history().schema["checked_at"].dataType).alias("at"))
    seen = t.history().select("product_id", F.col("checked_at").alias("at"), F.concat(F.lit("img-"), F.col("store_id")).alias("image"))
    return state.upsert_latest(products, seen, "product_id", "at", keep_if_set=("image",)).select("product_id", "image")


@query("FN29_profile_texts", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 OR c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'Kullanici profili:' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 2 = 0 THEN 'Ayakkabi numarasi: ' || c_nationkey ELSE '' END || CASE WHEN c_custkey % 2 = 0 AND c_acctbal >= 0 THEN chr(10) ELSE '' END || CASE WHEN c_acctbal >= 0 THEN 'Kullanim amaci: ' || c_mktsegment ELSE '' END AS said FROM customer""", views=False)
def profile_texts(t: Tables) -> DataFrame:
    """Customers as profiles: every second one has a size, those not in debt a use; a field that is null or empty has no line."""
    fields = {"weight": F.lit(None).cast("string"), "shoe_size": F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")), "usage": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("")}
    return t.raw("customer").select("c_custkey", text.profile_text(fields).alias("said"))


@query("FN31_folded_texts", f"""SELECT doc_id, translate(lower(trim(coalesce(translate(text, 'cgiosuCGOSUI', 'çğıöşüÇĞÖŞÜI'), ''))), '{text.TURKISH}', '{text.FOLDED}') AS folded FROM documents""", views=False)
def folded_texts(t: Tables) -> DataFrame:
    """Whole texts, written with Turkish letters, folded back. Without a capital dotted I, which engines lower differently."""
    turkish = F.translate("text", "cgiosuCGOSUI", "çğıöşüÇĞÖŞÜI")
    return t.raw("documents").select("doc_id", text.fold_turkish(turkish).alias("folded"))


@query("FN26_size_lists", """
r AS (SELECT product_id, store_id, size, size_in_stock, (product_id + store_id) % 5 AS way FROM listings)
==
SELECT product_id, store_id, CAST(CASE way WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS sizes, CASE WHEN way < 2 THEN CAST(size AS VARCHAR) END AS first_size, CASE WHEN way < 2 THEN size_in_stock END AS first_in_stock FROM r""")
def size_lists(t: Tables) -> DataFrame:
    """Saved JSON size lists of all listings, read back: some are broken, empty or no lists, and count as lists of nothing."""
    entry = F.format_string('{"name":"%s","in_stock":%s}', F.col("size").cast("string"), F.col("size_in_stock").cast("string"))
    way = (F.col("product_id") + F.col("store_id")) % 5
    raw = F.when(way == 0, F.concat(F.lit(" ["), entry, F.lit(',{"name":"x"}]'))).when(way == 1, F.concat(F.lit("["), entry, F.lit("]"))).when(way == 2, F.concat(F.lit("["), entry)).when(way == 3, entry)
    read = text.size_list(raw)
    return t.listings().select("product_id", "store_id", F.size(read).alias("sizes"), F.get(read, F.lit(0))["name"].alias("first_size"), F.get(read, F.lit(0))["in_stock"].alias("first_in_stock"))
