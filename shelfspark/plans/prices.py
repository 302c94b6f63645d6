"""Plans over price history: insight, drops, products, scores, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import insight, rules, score
from ..sources.tables import Tables
from .registry import query

INSIGHT = """
e AS (SELECT max(checked_at) AS as_of FROM history),
insight AS (SELECT product_id,
  min(CASE WHEN checked_at >= as_of - INTERVAL 7 DAY THEN price END) AS min_7d, min(CASE WHEN checked_at >= as_of - INTERVAL 30 DAY THEN price END) AS min_30d,
  min(CASE WHEN checked_at >= as_of - INTERVAL 90 DAY THEN price END) AS min_90d, floor(avg(CASE WHEN checked_at >= as_of - INTERVAL 30 DAY THEN CAST(round(price * 100) AS BIGINT) END) + 0.5) / 100 AS avg_30d,
  count(*) AS data_points, first(price ORDER BY checked_at DESC, price) AS last_price
  FROM history, e WHERE price > 0 AND price <= 150000 AND checked_at IS NOT NULL GROUP BY product_id)"""


INSIGHT_ASOF = INSIGHT + """
==
SELECT *, coalesce(last_price <> 0 AND min_30d <> 0 AND last_price <= min_30d * 1.02, false) AS is_near_lowest FROM insight"""


@query("A7_price_insight_asof", INSIGHT_ASOF)
def price_insight_asof(t: Tables) -> DataFrame:
    return insight.price_insight(t.history(), ["product_id"])


@query("W1_price_insight_running", """SELECT tick_id, min(price) OVER w AS low, count(*) OVER w AS n FROM ticks
WINDOW w AS (PARTITION BY listing_id ORDER BY checked_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""")
def price_insight_running(t: Tables) -> DataFrame:
    return insight.running_low(t.ticks(), "listing_id").select("tick_id", "low", "n")


@query("W3_price_drop_radar", """
d AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY checked_at, tick_id) AS previous_price FROM ticks)
==
SELECT tick_id, listing_id, price, previous_price, round_even((previous_price - price) / previous_price * 100, 0) AS drop_pct FROM d
WHERE previous_price BETWEEN 50 AND 200000 AND previous_price <= price * 5 AND price < previous_price * 0.97""")
def price_drop_radar(t: Tables) -> DataFrame:
    return insight.price_drops(t.ticks(), "listing_id", ["checked_at", "tick_id"]).select("tick_id", "listing_id", "price", "previous_price", "drop_pct")


@query("W3_price_drop_radar_products", """
d AS (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY checked_at, l_orderkey, l_linenumber, store_id, price) AS previous_price FROM history)
==
SELECT product_id, count(*) AS drops, max(round_even((previous_price - price) / previous_price * 100, 0)) AS worst FROM d
WHERE previous_price BETWEEN 50 AND 200000 AND previous_price <= price * 5 AND price < previous_price * 0.97 GROUP BY product_id""")
def price_drop_radar_products(t: Tables) -> DataFrame:
    found = insight.price_drops(t.history().select("*", "seq.l_orderkey", "seq.l_linenumber"), "product_id", ["checked_at", "l_orderkey", "l_linenumber", "store_id", "price"])
    return found.groupBy("product_id").agg(F.count("*").alias("drops"), F.max("drop_pct").alias("worst"))


@query("X_tumbling_price_window", """SELECT listing_id, date_trunc('day', checked_at) AS starts, count(*) AS n, min(price) AS low, max(price) AS high, round(avg(price), 4) AS mean FROM ticks GROUP BY 1, 2""")
def tumbling_price_window(t: Tables) -> DataFrame:
    return insight.tumbling_prices(t.ticks())


@query("A1_dashboard_counts", """SELECT (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM products WHERE active) AS active_products, (SELECT count(*) FROM listings) AS listings,
  (SELECT count(*) FROM rules WHERE enabled) AS enabled_rules, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM alerts WHERE is_read = false) AS unread_alerts""")
def dashboard_counts(t: Tables) -> DataFrame:
    one = lambda df, *aggs: df.agg(*aggs)
    products = one(t.products(), F.count("*").alias("products"), F.count_if("active").alias("active_products"))
    listed = one(t.raw("lineitem").select("l_partkey", "l_suppkey").distinct(), F.count("*").alias("listings"))
    ruled = one(t.rules(), F.count_if("enabled").alias("enabled_rules"))
    alerted = one(t.alerts(), F.count("*").alias("alerts"), F.count_if(~F.col("is_read")).alias("unread_alerts"))
    scalars = [(df.select(c).scalar(), c) for df in (products, listed, ruled, alerted) for c in df.columns]
    return t.spark.range(1).select(*[s.alias(c) for s, c in scalars])


PRODUCT_LIST = """
best AS (SELECT product_id, min(price) AS best_price, bool_or(in_stock) AS in_stock, count(*) AS listings FROM listings GROUP BY product_id)
==
SELECT p.product_id, p.name, b.best_price, coalesce(b.in_stock, false) AS in_stock, coalesce(b.listings, 0) AS listings, r.target_price
FROM products p LEFT JOIN best b USING (product_id) LEFT JOIN (SELECT * FROM dated_rules WHERE enabled QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY created_at, rule_id) = 1) r USING (product_id)"""


@query("J1_product_list", PRODUCT_LIST)
def product_list(t: Tables) -> DataFrame:
    """Products with their cheapest listing and the target of their oldest rule that is on."""
    best = t.listings().groupBy("product_id").agg(F.min("price").alias("best_price"), F.bool_or("in_stock").alias("in_stock"), F.count("*").alias("listings"))
    first_rule = t.dated_rules().where("enabled").groupBy("product_id").agg(F.min_by("target_price", F.struct("created_at", "rule_id")).alias("target_price"))
    joined = t.products().join(best, "product_id", "left").join(first_rule, "product_id", "left")
    return joined.select("product_id", "name", "best_price", F.coalesce("in_stock", F.lit(False)).alias("in_stock"), F.coalesce("listings", F.lit(0)).alias("listings"), "target_price")


@query("A5_product_sizes", """
s AS (SELECT DISTINCT product_id, CASE WHEN size % 7 = 0 THEN 'EU' || size ELSE CAST(size AS VARCHAR) END AS label FROM history WHERE size_in_stock)
==
SELECT product_id, string_agg(label, ',' ORDER BY TRY_CAST(label AS DOUBLE) IS NULL, TRY_CAST(label AS DOUBLE), label) AS sizes FROM s GROUP BY product_id""")
def product_sizes(t: Tables) -> DataFrame:
    label = F.when(F.col("size") % 7 == 0, F.concat(F.lit("EU"), F.col("size"))).otherwise(F.col("size").cast("string"))
    number = lambda s: s.try_cast("double")
    order = lambda s: F.struct(number(s).isNull().alias("t"), number(s).alias("n"), s.alias("s"))
    labels = t.history().where("size_in_stock").groupBy("product_id").agg(F.collect_set(label).alias("_l"))
    return labels.select("product_id", F.array_join(F.transform(F.array_sort(F.transform("_l", order)), lambda x: x["s"]), ",").alias("sizes"))


@query("A8_best_listing", """SELECT product_id, store_id, price, in_stock FROM listings QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) = 1""")
def best_listing(t: Tables) -> DataFrame:
    best = F.min_by(F.struct("store_id", "price", "in_stock"), F.struct("price", "store_id")).alias("b")
    return t.listings().groupBy("product_id").agg(best).select("product_id", "b.*")


@query("A9_strictest_rule", """SELECT brand, rule_id, target_price FROM rules JOIN products USING (product_id) WHERE enabled QUALIFY row_number() OVER (PARTITION BY brand ORDER BY coalesce(nullif(target_price, 0), 1e12), rule_id) = 1""")
def strictest_rule(t: Tables) -> DataFrame:
    first = F.min_by(F.struct("rule_id", "target_price"), F.struct(F.coalesce(F.nullif("target_price", F.lit(0.0)), F.lit(1e12)), "rule_id")).alias("r")
    return t.rules().where("enabled").join(t.products(), "product_id").groupBy("brand").agg(first).select("brand", "r.*")


def scored(t: Tables, profile: DataFrame | None = None) -> DataFrame:
    """Every active product's best listing with its rule, insight, sizes and one buyer's profile, scored: that of the table profile(shoe_size, use), which has a row at most, or a fixed one."""
    own = F.lit(" 42 ") if profile is None else profile.select("shoe_size").scalar()
    use = F.lit(True) if profile is None else profile.select("use").scalar()
    sizes = t.history().groupBy("product_id", F.col("size").cast("string").alias("size")).agg(F.bool_or("size_in_stock").alias("in_stock")).groupBy("product_id").agg(F.collect_list(F.struct("size", "in_stock")).alias("sizes"))
    trailing = insight.price_insight(t.history(), ["product_id"])
    best = best_listing(t).withColumnRenamed("price", "best_price").withColumnRenamed("in_stock", "last_in_stock")
    ruled = t.rules().where("enabled").select("product_id", F.lit(True).alias("has_rule"), "target_price", F.col("rule_size").cast("string").alias("rule_size"))
    p = t.products().where("active").join(best, "product_id", "left").join(ruled, "product_id", "left").join(trailing, "product_id", "left").join(sizes, "product_id", "left")
    source = F.get(F.array(*[F.lit(s) for s in (*score.SOURCE_POINTS, "other", "")]), (F.col("product_id") % 8).cast("int"))
    near = F.coalesce((F.col("best_price") != 0) & (F.col("min_30d") != 0) & (F.col("best_price") <= F.col("min_30d") * 1.02), F.lit(False))
    return score.buy_score(p.select(
        "product_id", "kind", F.col("best_price").alias("last_price"), F.col("label_price").alias("last_old_price"), F.when(F.col("product_id") % 8 == 0, F.col("best_price")).alias("last_cart_price"),
        source.alias("last_price_source"), F.when(F.col("product_id") % 50 == 0, "403").alias("last_error"), "last_in_stock", F.when(F.col("product_id") % 5 != 0, F.col("sizes")).alias("sizes"), "has_rule", "target_price", "rule_size",
        own.alias("profile_size"), use.alias("profile_use"), near.alias("is_near_lowest"), F.coalesce("data_points", F.lit(0)).alias("data_points"), "min_30d",
    ))


SCORED = INSIGHT + """,
sz AS (SELECT product_id, size, bool_or(size_in_stock) AS in_stock FROM history GROUP BY 1, 2),
best AS (SELECT product_id, price, in_stock FROM listings QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) = 1),
stock AS (SELECT product_id, count(*) FILTER (in_stock) AS n, bool_or(in_stock AND size = 42) AS own FROM sz GROUP BY 1),
a AS (SELECT p.product_id, b.price AS cur, p.label_price AS old, CASE WHEN p.product_id % 8 = 0 THEN b.price END AS cart,
  ['cart_offer', 'manual', 'shelf', 'json_ld', 'embedded_json', 'meta', 'other', ''][p.product_id % 8 + 1] AS src, p.product_id % 50 = 0 AS bad, b.in_stock AS stocked,
  p.product_id % 5 <> 0 AND k.n IS NOT NULL AS listed, p.product_id % 5 <> 0 AND coalesce(k.own, false) AS own, CASE WHEN p.product_id % 5 <> 0 THEN coalesce(k.n, 0) ELSE 0 END AS n, r.rule_id IS NOT NULL AS has_rule, r.target_price AS target, r.rule_size AS want,
  coalesce(b.price <> 0 AND i.min_30d <> 0 AND b.price <= i.min_30d * 1.02, false) AND coalesce(i.data_points, 0) >= 3 AS near, i.min_30d, coalesce(z.in_stock, false) AND p.product_id % 5 <> 0 AS want_stock
  FROM products p LEFT JOIN best b USING (product_id) LEFT JOIN (SELECT * FROM rules WHERE enabled) r USING (product_id) LEFT JOIN insight i USING (product_id) LEFT JOIN stock k USING (product_id)
  LEFT JOIN sz z ON z.product_id = p.product_id AND z.size = r.rule_size WHERE p.active),
s AS (SELECT *, least(40, CASE WHEN coalesce(target, 0) <> 0 THEN CASE WHEN cur <= target THEN 20 WHEN cur <= target * 1.1 THEN 10 ELSE 0 END ELSE 8 END + CASE WHEN near THEN 10 ELSE 0 END
    + CASE WHEN coalesce(old, 0) <> 0 AND old > cur THEN CASE WHEN (old - cur) / old * 100 >= 20 THEN 6 WHEN (old - cur) / old * 100 >= 10 THEN 4 ELSE 2 END ELSE 0 END + CASE WHEN coalesce(cart, 0) <> 0 THEN 4 ELSE 0 END) AS ps,
  CASE WHEN want IS NOT NULL THEN CASE WHEN want_stock THEN 20 ELSE 0 END WHEN listed THEN CASE WHEN n > 0 THEN 14 ELSE 0 END WHEN stocked THEN 8 ELSE 3 END AS ss,
  least(25, 8 + CASE WHEN own THEN 12 ELSE 0 END + CASE WHEN has_rule THEN 5 ELSE 0 END) AS fs,
  CASE WHEN bad THEN 2 ELSE CASE src WHEN 'cart_offer' THEN 15 WHEN 'manual' THEN 14 WHEN 'shelf' THEN 12 WHEN 'json_ld' THEN 9 WHEN 'embedded_json' THEN 8 WHEN 'meta' THEN 6 WHEN '' THEN 2 ELSE 4 END END AS ts FROM a),
scored AS (SELECT product_id, CASE WHEN cur IS NULL THEN 0 ELSE ps END AS price_score, CASE WHEN cur IS NULL THEN 0 ELSE ss END AS stock_score, CASE WHEN cur IS NULL THEN 0 ELSE fs END AS profile_score,
  CASE WHEN cur IS NULL THEN 0 ELSE ts END AS trust_score, CASE WHEN cur IS NULL THEN 0 ELSE ps + ss + fs + ts END AS score,
  CASE WHEN cur IS NULL OR (ts <= 2 AND NOT listed) THEN 'BELİRSİZ' WHEN ps + ss + fs + ts >= 85 THEN 'AL' WHEN ps + ss + fs + ts >= 70 THEN 'ALINABİLİR' WHEN ps + ss + fs + ts >= 50 THEN 'BEKLE'
    WHEN ps + ss + fs + ts >= 30 THEN 'SADECE ÇOK UCUZSA' ELSE 'UYGUN DEĞİL' END AS decision FROM s)"""


@query("FN22_buy_score", SCORED + "\n==\nSELECT product_id, price_score, stock_score, profile_score, trust_score, score, decision FROM scored")
def buy_score(t: Tables) -> DataFrame:
    return scored(t).select("product_id", "price_score", "stock_score", "profile_score", "trust_score", "score", "decision")


_BUYER = "(SELECT {} FROM customer WHERE c_custkey = 1)"


@query("J11_profile_scores", SCORED.replace("size = 42", f"size = {_BUYER.format('c_nationkey')}").replace("least(25, 8 +", f"least(25, CASE WHEN {_BUYER.format('c_acctbal > 5000')} THEN 8 ELSE 5 END +") + "\n==\nSELECT product_id, profile_score, score, decision FROM scored")
def profile_scores(t: Tables) -> DataFrame:
    """Scores for the buyer whose profile is a row of a table: a size, and whether a use is given."""
    profile = t.raw("customer").where("c_custkey = 1").select(F.col("c_nationkey").cast("string").alias("shoe_size"), (F.col("c_acctbal") > 5000).alias("use"))
    return scored(t, profile).select("product_id", "profile_score", "score", "decision")


def _said(*lines: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {said} END" for cond, said in lines) + "], lambda x: x IS NOT NULL)"


_AIMED, _WHOLE = "coalesce(target, 0) <> 0", "CAST(CAST(round_even({}, 0) AS BIGINT) AS VARCHAR)"
REASONS = _said(
    (f"{_AIMED} AND cur <= target", f"'Hedef fiyatın (' || {_WHOLE.format('target')} || ' TL) altında'"),
    (f"{_AIMED} AND cur > target AND cur <= target * 1.1", "'Hedef fiyata çok yakın (%10 bandında)'"),
    ("near", "'Son 30 günün en düşük fiyatına yakın'"),
    ("coalesce(old, 0) <> 0 AND old > cur AND (old - cur) / old * 100 >= 20", f"'Etiket fiyatına göre %' || {_WHOLE.format('(old - cur) / old * 100')} || ' indirim'"),
    ("coalesce(cart, 0) <> 0", "'Sepet indirimi yakalandı'"),
    ("want IS NOT NULL AND want_stock", "'İstenen beden (' || want || ') bildirim anında stokta görünüyordu'"),
    ("want IS NULL AND listed AND n > 0", "n || ' beden stokta görünüyor'"),
    ("own", "'Profilinizdeki numara ( 42 ) stokta'"),
    ("src = 'cart_offer'", "'Fiyat sepet teklifinden okundu (yüksek güven)'"),
)
RISKS = _said(
    (f"{_AIMED} AND cur > target * 1.1", f"'Hedef fiyatın (' || {_WHOLE.format('target')} || ' TL) üzerinde'"),
    (f"NOT ({_AIMED})", "'Hedef fiyat kuralı tanımlı değil'"),
    ("NOT near AND coalesce(min_30d, 0) <> 0 AND cur > min_30d * 1.1", f"'Son 30 günde daha ucuzu görüldü (' || {_WHOLE.format('min_30d')} || ' TL)'"),
    ("coalesce(cart, 0) <> 0", "'Sepet indirimi ödeme ekranında doğrulanmalı'"),
    ("want IS NOT NULL AND NOT want_stock", "'İstenen beden (' || want || ') stokta görünmüyor'"),
    ("want IS NULL AND listed AND n = 0", "'Hiçbir beden stokta görünmüyor'"),
    ("want IS NULL AND NOT listed", "'Beden bazlı stok bilgisi yok, stok durumu belirsiz'"),
    ("n > 0", "'Stok hızlı tükenebilir'"),
    ("NOT own AND n > 0", "'Profilinizdeki numara stok listesinde görünmüyor'"),
    ("bad", "'Son kontrolde hata alındı, veri bayat olabilir'"),
)


@query("FN23_buy_decision", SCORED + f""",
w AS (SELECT product_id, CASE WHEN cur IS NULL THEN ['Güncel fiyat okunamadı'] ELSE {REASONS}[1:6] END AS why, CASE WHEN cur IS NULL THEN ['Fiyat verisi olmadan karar üretilemez'] ELSE {RISKS}[1:5] END AS risk FROM a)
==
SELECT product_id, decision, score, decision || ' (' || score || '/100)' || CASE WHEN len(why) > 0 AND why[1] <> '' THEN '. ' || array_to_string(why[1:2], '; ') ELSE '' END AS comment,
  array_to_string(why, ' | ') AS reasons, array_to_string(risk, ' | ') AS risks FROM scored JOIN w USING (product_id)""")
def buy_decision(t: Tables) -> DataFrame:
    return scored(t).select("product_id", "decision", "score", "comment", F.array_join("reasons", " | ").alias("reasons"), F.array_join("risks", " | ").alias("risks"))


@query("T6_deals_top6", SCORED + "\n==\nSELECT product_id, score, decision FROM scored WHERE NOT (decision = 'BELİRSİZ' AND score = 0) ORDER BY score DESC, product_id LIMIT 6")
def deals_top6(t: Tables) -> DataFrame:
    return score.deals(scored(t)).select("product_id", "score", "decision")


MATCH = """SELECT r.rule_id, r.product_id, l.store_id, l.price, r.target_price{extra} FROM rules r JOIN listings l ON r.product_id = l.product_id AND l.price <= r.target_price * {tolerance}
WHERE r.enabled AND r.target_price IS NOT NULL AND CASE WHEN r.rule_size IS NOT NULL THEN l.size = r.rule_size AND l.size_in_stock ELSE l.in_stock END"""


MATCHES = MATCH.format(tolerance="1.1", extra=", l.price > r.target_price AS in_tolerance, CASE WHEN r.rule_size IS NOT NULL THEN CAST(r.rule_size AS VARCHAR) ELSE 'Herhangi bir beden' END AS matched_size")


@query("J4_rule_matches", MATCHES)
def rule_matches(t: Tables) -> DataFrame:
    return rules.rule_matches(t.rules(), t.listings()).drop("listing_product_id")


@query("J12_rule_matches_strict", MATCH.format(tolerance="1.0", extra=""))
def rule_matches_strict(t: Tables) -> DataFrame:
    return rules.rule_matches(t.rules(), t.listings(), tolerance=1.0).select("rule_id", "product_id", "store_id", "price", "target_price")


@query("J5_spectrum_matches", """
fam AS (SELECT product_id, array_to_string(list_filter(regexp_extract_all(lower(name), '[a-z0-9.]+'), lambda w: NOT list_contains(""" + str([*text.COLOUR_WORDS, *text.GENDER_WORDS, *text.GENERIC_WORDS]) + """, w))[1:6], ' ') AS family FROM products WHERE active),
f AS (SELECT * FROM fam WHERE family <> '')
==
SELECT r.rule_id, r.product_id, l.product_id AS listing_product_id, l.store_id, l.price, r.target_price FROM rules r JOIN f a ON r.product_id = a.product_id JOIN f b ON a.family = b.family JOIN listings l ON l.product_id = b.product_id
WHERE r.spectrum AND r.enabled AND l.price <= r.target_price * 1.1 AND CASE WHEN r.rule_size IS NOT NULL THEN l.size = r.rule_size AND l.size_in_stock ELSE l.in_stock END
QUALIFY row_number() OVER (PARTITION BY r.rule_id ORDER BY l.price, l.product_id, l.store_id) = 1""")
def spectrum_matches(t: Tables) -> DataFrame:
    return rules.spectrum_matches(t.rules(), t.products().withColumn("family_key", text.family_key(F.col("name"))), t.listings())


@query("J7_cooldown_alerts", """SELECT candidate_id, c.rule_id, c.listing_id FROM candidates c ASOF LEFT JOIN (SELECT rule_id, listing_id, created_at FROM alerts) h
  ON c.rule_id = h.rule_id AND c.listing_id = h.listing_id AND c.as_of >= h.created_at
WHERE NOT coalesce(epoch_us(as_of) - epoch_us(h.created_at) < coalesce(nullif(cooldown_hours, 0), 24) * 3600000000, false)""")
def cooldown_alerts(t: Tables) -> DataFrame:
    return rules.outside_cooldown(t.candidates(), t.alerts(), ["rule_id", "listing_id"]).select("candidate_id", "rule_id", "listing_id")


@query("J13_unread_suppression", """SELECT candidate_id, rule_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM alerts b WHERE b.is_read = false AND b.rule_id = c.rule_id AND b.listing_id = c.listing_id)""")
def unread_suppression(t: Tables) -> DataFrame:
    return rules.without_unread(t.candidates(), t.alerts(), ["rule_id", "listing_id"]).select("candidate_id", "rule_id")


@query("W4_latest_alerts", """SELECT rule_id, listing_id, alert_id, created_at FROM alerts QUALIFY row_number() OVER (PARTITION BY rule_id, listing_id ORDER BY created_at DESC, alert_id DESC) = 1""")
def latest_alerts(t: Tables) -> DataFrame:
    return rules.latest_alerts(t.alerts(), ["rule_id", "listing_id"]).select("rule_id", "listing_id", "alert_id", "created_at")


@query("J14_cheapest_in_stock", """SELECT product_id, store_id, price FROM listings WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) = 1""")
def cheapest_in_stock(t: Tables) -> DataFrame:
    return t.listings().where("in_stock").groupBy("product_id").agg(F.min(F.struct("price", "store_id")).alias("b")).select("product_id", "b.store_id", "b.price")


@query("J3_rules_with_product", """SELECT r.rule_id, coalesce(p.name, '?') AS product_name FROM rules r LEFT JOIN (SELECT * FROM products WHERE active) p USING (product_id)""")
def rules_with_product(t: Tables) -> DataFrame:
    return t.rules().join(t.products().where("active").select("product_id", "name"), "product_id", "left").select("rule_id", F.coalesce("name", F.lit("?")).alias("product_name"))
