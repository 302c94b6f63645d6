"""Plans from rules to alerts: evaluation over whole listings, delivery, fetch attempts, cascades, and the same over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules, state
from ..sources.tables import Tables
from ..streaming import radar
from .registry import query
from .texts import SKIP

LISTED = """
fam AS (SELECT product_id, name, nullif(array_to_string(list_filter(regexp_extract_all(lower(name), '[a-z0-9.]+'), lambda w: NOT list_contains(""" + SKIP + """, w))[1:6], ' '), '') AS family FROM products WHERE active),
lid AS (SELECT product_id, store_id, product_id * 100000 + store_id AS listing_id, price, CASE WHEN store_id % 4 = 0 THEN price END AS cart, in_stock, (product_id + store_id) % 9 <> 0 AS listed FROM listings WHERE store_id % 6 <> 0),
sz AS (SELECT product_id, store_id, size, CASE WHEN size % 5 = 0 THEN size || ',5' ELSE CAST(size AS VARCHAR) END AS label, max(checked_at) = max(CASE WHEN size_in_stock THEN checked_at END) AS ok FROM history GROUP BY 1, 2, 3),
st AS (SELECT product_id, store_id, bool_or(ok) AS any_ok FROM sz GROUP BY 1, 2),
rl AS (SELECT *, CASE WHEN rule_size % 5 = 0 THEN rule_size || '.5' ELSE CAST(rule_size AS VARCHAR) END AS want FROM rules WHERE enabled AND target_price IS NOT NULL)"""


def whole_listings(t: Tables) -> DataFrame:
    """Listings with all that a rule looks at; every ninth without known sizes, every sixth store inactive.

    A size's latest observation and the listing's come from one pass over the history, as the latest of the latest.
    """
    newest = F.max("checked_at") == F.max(F.when(F.col("size_in_stock"), F.col("checked_at")))
    label = F.when(F.col("size") % 5 == 0, F.concat("size", F.lit(",5"))).otherwise(F.col("size").cast("string"))
    known = t.history().where("product_id is not null and store_id is not null")
    sized = known.groupBy("product_id", "store_id", "size").agg(F.coalesce(newest, F.lit(False)).alias("ok"), t.latest()).withColumn("e", F.struct(label.alias("name"), label.alias("size"), F.col("ok").alias("in_stock")))
    whole = sized.groupBy("product_id", "store_id").agg(F.array_sort(F.collect_list("e")).alias("_s"), F.max("l").alias("l"))
    return whole.select(
        (F.col("product_id") * 100_000 + F.col("store_id")).alias("id"), "product_id", F.col("l.price").alias("last_price"), F.when(F.col("store_id") % 4 == 0, F.col("l.price")).alias("last_cart_price"),
        F.when((F.col("product_id") + F.col("store_id")) % 9 != 0, F.col("_s")).alias("last_sizes"), F.col("l.in_stock").alias("last_in_stock"), (F.col("store_id") % 6 != 0).alias("active"),
    )


def whole_rules(t: Tables) -> DataFrame:
    label = F.when(F.col("rule_size") % 5 == 0, F.concat("rule_size", F.lit(".5"))).otherwise(F.col("rule_size").cast("string"))
    return t.rules().select(F.col("rule_id").alias("id"), "product_id", "target_price", label.alias("size"), F.col("spectrum").alias("spectrum_mode"), "cooldown_hours", "enabled")


EVALUATED = LISTED + """,
c AS (SELECT r.rule_id, r.product_id, l.listing_id, f.name, l.price, r.target_price, l.cart, r.spectrum, l.store_id, l.product_id AS of_product, l.listed, l.in_stock, r.want, st.any_ok
  FROM rl r JOIN fam a ON a.product_id = r.product_id JOIN fam f ON f.product_id = r.product_id OR (r.spectrum AND f.family = a.family) JOIN lid l ON l.product_id = f.product_id AND l.price <= r.target_price * 1.1 JOIN st ON st.product_id = l.product_id AND st.store_id = l.store_id),
m AS (SELECT c.*, sz.label, sz.ok FROM c LEFT JOIN sz ON sz.product_id = c.of_product AND sz.store_id = c.store_id AND replace(sz.label, ',', '.') = c.want),
k AS (SELECT * FROM m WHERE CASE WHEN want IS NOT NULL THEN listed AND coalesce(ok, false) WHEN listed THEN any_ok ELSE in_stock END)
==
SELECT rule_id, product_id, listing_id, CASE WHEN price > target_price THEN '🎯 HEDEFE YAKLAŞTI: ' ELSE '✅ HEDEF YAKALANDI: ' END || name AS title, price, CASE WHEN want IS NOT NULL THEN label WHEN listed THEN 'Herhangi bir beden' ELSE 'Beden bilgisi yok' END AS size,
  CASE WHEN coalesce(cart, 0) <> 0 THEN 'Sepet indirimi' ELSE 'Normal fiyat' END AS price_type FROM k QUALIFY NOT spectrum OR row_number() OVER (PARTITION BY rule_id ORDER BY price, listing_id) = 1"""


@query("F13_rule_alerts", EVALUATED)
def rule_alerts(t: Tables) -> DataFrame:
    products = t.products().select(F.col("product_id").alias("id"), "name", "active", text.family_key(F.col("name")).alias("family_key"))
    found = rules.evaluate_rules(whole_rules(t), products, whole_listings(t))
    return found.select("rule_id", "product_id", "listing_id", "title", "price", "size", "price_type")


@query("SNK5_alert_delivery", """
n AS (SELECT candidate_id AS alert_id, rule_id, listing_id, as_of AS created_at FROM candidates),
a AS (SELECT alert_id, rule_id, listing_id, created_at, CAST(NULL AS BOOLEAN) AS sent FROM alerts UNION ALL SELECT *, false FROM n WHERE alert_id NOT IN (SELECT alert_id FROM alerts))
==
SELECT alert_id, rule_id, CASE WHEN sent IS NULL THEN alert_id % 2 = 0 WHEN alert_id % 3 = 0 THEN true ELSE false END AS telegram_sent, CASE WHEN sent IS NOT NULL AND alert_id % 3 = 1 THEN 'HTTP 429' END AS telegram_error FROM a""")
def alert_delivery(t: Tables) -> DataFrame:
    """New alerts are appended once, then marked by what the messenger said of them; those it says nothing of stay unsent."""
    old = t.alerts().select("alert_id", "rule_id", F.col("is_read").alias("telegram_sent"), F.lit(None).cast("string").alias("telegram_error"))
    new = t.candidates().select(F.col("candidate_id").alias("alert_id"), "rule_id")
    said = new.where("alert_id % 3 <> 2").select("alert_id", (F.col("alert_id") % 3 == 0).alias("ok"), F.when(F.col("alert_id") % 3 == 1, "HTTP 429").alias("error"))
    return state.mark_sent(state.append_alerts(old, new), said)


@query("SNK7_delivery_summary", "SELECT rule_id, count(*) FILTER (k = 0) AS sent, count(*) FILTER (k = 1) AS skipped, count(*) FILTER (k = 2) AS errors FROM (SELECT rule_id, alert_id % 3 AS k FROM alerts) GROUP BY rule_id")
def delivery_summary(t: Tables) -> DataFrame:
    outcome = F.get(F.array(*[F.lit(x) for x in ("sent", "skipped", "error")]), (F.col("alert_id") % 3).cast("int"))
    return state.delivery_summary(t.alerts().withColumn("outcome", outcome), "rule_id")


@query("SRC3_fetch_cascade", """
a AS (SELECT user_id AS page, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS engine, event_id, CASE WHEN value >= 50 THEN value END AS body FROM events)
==
SELECT page, first(engine ORDER BY body IS NULL, engine, event_id) FILTER (body IS NOT NULL) AS engine, first(body ORDER BY body IS NULL, engine, event_id) FILTER (body IS NOT NULL) AS body, count(*) AS attempts FROM a GROUP BY page""")
def fetch_cascade(t: Tables) -> DataFrame:
    """Landed fetch attempts: of each page the body of the first engine in order that gave one."""
    engine = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    attempts = t.raw("events").select(F.col("user_id").alias("page"), engine.alias("engine"), "event_id", F.when(F.col("value") >= 50, F.col("value")).alias("body"))
    return state.first_success(attempts, "page", ["engine", "event_id"], "body", ["engine"])


@query("A6_first_image", """
i AS (SELECT product_id, store_id, CASE WHEN store_id % 3 <> 0 THEN 'https://img.example/' || product_id || '/' || store_id END AS image FROM listings)
==
SELECT p.product_id, coalesce(CASE WHEN p.product_id % 5 = 0 THEN 'own' END, (SELECT first(image ORDER BY store_id) FROM i WHERE i.product_id = p.product_id AND image IS NOT NULL)) AS image FROM products p""")
def first_image(t: Tables) -> DataFrame:
    """A product's own picture, else that of its first listing that has one."""
    picture = F.when(F.col("store_id") % 3 != 0, F.concat(F.lit("https://img.example/"), F.col("product_id"), F.lit("/"), F.col("store_id")))
    of = t.listings().withColumn("image", picture).groupBy("product_id").agg(F.min_by("image", F.when(F.col("image").isNotNull(), F.col("store_id"))).alias("_image"))
    own = t.products().select("product_id", F.when(F.col("product_id") % 5 == 0, "own").alias("image"))
    return own.join(of, "product_id", "left").select("product_id", F.coalesce("image", "_image").alias("image"))


@query("SNK9_cascade_all", """
d AS (SELECT product_id FROM products WHERE NOT active)
==
SELECT 'history' AS child, count(*) AS left_rows FROM history WHERE product_id NOT IN (SELECT product_id FROM d) UNION ALL SELECT 'listings', count(*) FROM listings WHERE product_id NOT IN (SELECT product_id FROM d)
UNION ALL SELECT 'rules', count(*) FROM rules WHERE product_id NOT IN (SELECT product_id FROM d)""")
def cascade_all(t: Tables) -> DataFrame:
    """All children of deleted products go: history, listings and rules."""
    children = {"history": t.history().select("product_id"), "listings": t.raw("lineitem").select(F.col("l_partkey").alias("product_id"), "l_suppkey").distinct(), "rules": t.rules().select("product_id")}
    left = state.cascade_all(t.products().where("not active"), children, "product_id")
    counts = [df.agg(F.count("*").alias("left_rows")).select(F.lit(name).alias("child"), "left_rows") for name, df in left.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("ST4_stream_rule_matches", """SELECT r.rule_id, h.product_id, h.store_id, h.price, h.l_orderkey, h.l_linenumber, h.price > r.target_price AS in_tolerance FROM rules r JOIN history h ON r.product_id = h.product_id AND h.price <= r.target_price * 1.1
WHERE r.enabled AND r.target_price IS NOT NULL AND CASE WHEN r.rule_size IS NOT NULL THEN h.size = r.rule_size AND h.size_in_stock ELSE h.in_stock END""")
def stream_rule_matches(t: Tables) -> DataFrame:
    """Observations as a stream against rules as a table: the batch check, as observations come."""
    seen = t.history(radar.source(t.spark, t.sf_dir, "lineitem"))
    found = rules.rule_matches(t.rules(), seen, keep=("seq.l_orderkey", "seq.l_linenumber"))
    return radar.run_available(found.select("rule_id", "product_id", "store_id", "price", "l_orderkey", "l_linenumber", "in_tolerance"), *radar.new_folders(t.spark))
