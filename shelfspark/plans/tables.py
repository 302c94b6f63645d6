"""Plans over whole tables: changes, reports, lists, set operations, JSON and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import hot, insight, state
from ..sources.tables import Tables
from .registry import query


@query("A11_check_run_report", """
r AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS run, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'no_price' END AS status, o_custkey AS product_id FROM orders)
==
SELECT run, count(*) AS total, count(*) FILTER (status = 'ok') AS success, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'no_price') AS no_price, count(DISTINCT product_id) AS products FROM r GROUP BY run""")
def check_run_report(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("no_price")
    return state.run_report(t.raw("orders").select(F.to_date("o_orderdate").cast("string").alias("run"), status.alias("status"), F.col("o_custkey").alias("product_id")), "run")


@query("SNK2_latest_state", """
o AS (SELECT product_id, price, checked_at, store_id FROM history QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY checked_at DESC, price DESC, store_id DESC) = 1)
==
SELECT p.product_id, o.price AS last_price, coalesce(p.title, 'store ' || o.store_id) AS title, o.checked_at AS last_checked_at FROM (SELECT product_id, CASE WHEN product_id % 4 <> 0 THEN name END AS title FROM products) p LEFT JOIN o USING (product_id)""")
def latest_state(t: Tables) -> DataFrame:
    current = t.products().select("product_id", F.lit(None).cast("double").alias("last_price"), F.when(F.col("product_id") % 4 != 0, F.col("name")).alias("title"), F.lit(None).cast("timestamp_ntz").alias("last_checked_at"))
    current = current.withColumn("last_checked_at", F.lit(None).cast(dict(t.history().dtypes)["checked_at"]))
    observed = t.history().select("product_id", F.col("checked_at").alias("last_checked_at"), F.col("price").alias("last_price"), F.concat(F.lit("store "), F.col("store_id")).alias("title"), "store_id")
    newest = observed.groupBy("product_id").agg(F.max(F.struct("last_checked_at", "last_price", "store_id", "title")).alias("n")).select("product_id", "n.last_checked_at", "n.last_price", "n.title")
    return state.upsert_latest(current, newest, "product_id", "last_checked_at", keep_if_set=("title",))


@query("SNK3_error_state", """SELECT product_id, store_id, m AS last_error, CASE WHEN m = 'HTTP 404' THEN false ELSE in_stock END AS in_stock, CASE WHEN m = 'HTTP 404' THEN 0 ELSE 3 END AS stock_count
FROM (SELECT *, ['HTTP 404', 'HTTP 403', 'HTTP 500'][product_id % 3 + 1] AS m FROM listings)""")
def error_state(t: Tables) -> DataFrame:
    said = F.get(F.array(*[F.lit(m) for m in ("HTTP 404", "HTTP 403", "HTTP 500")]), (F.col("product_id") % 3).cast("int"))
    return state.error_state(t.listings().select("product_id", "store_id", "in_stock", F.lit(3).alias("stock_count")), said)


@query("SNK9_cascade_delete", "SELECT count(*) AS left_rows, count(DISTINCT product_id) AS products FROM history WHERE product_id NOT IN (SELECT product_id FROM products WHERE NOT active)")
def cascade_delete(t: Tables) -> DataFrame:
    return state.cascade(t.products().where("not active"), t.history(), "product_id").agg(F.count("*").alias("left_rows"), F.count_distinct("product_id").alias("products"))


@query("SNK11_partial_update", "SELECT product_id, CASE WHEN product_id % 2 = 0 THEN 'renamed' ELSE name END AS name, brand FROM products")
def partial_update(t: Tables) -> DataFrame:
    changes = t.products().select("product_id", F.when(F.col("product_id") % 2 == 0, "renamed").alias("name"), F.lit(None).cast("string").alias("brand"))
    return state.patch(t.products().select("product_id", "name", "brand"), changes, "product_id")


@query("SNK12_profile_upsert", """SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS shoe_size, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'daily' END AS usage, '' AS notes FROM customer WHERE c_custkey = 1""", views=False)
def profile_upsert(t: Tables) -> DataFrame:
    """One saved profile over the defaults."""
    saved = t.raw("customer").where("c_custkey = 1").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("shoe_size"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("usage"))
    return state.with_defaults(saved, {"id": 0, "shoe_size": "42", "usage": "daily", "notes": ""})


@query("SNK13_toggles", "SELECT product_id, NOT coalesce(CASE WHEN product_id % 3 = 0 THEN NULL ELSE active END, true) AS active FROM products")
def toggles(t: Tables) -> DataFrame:
    return t.products().select("product_id", state.toggle(F.when(F.col("product_id") % 3 != 0, F.col("active"))).alias("active"))


@query("SNK10_mark_all_read", "SELECT rule_id, count(*) AS n, count(*) AS n_read, min(alert_id) AS first_alert FROM alerts GROUP BY rule_id")
def mark_all_read(t: Tables) -> DataFrame:
    return t.alerts().withColumn("is_read", F.lit(True)).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("is_read").alias("n_read"), F.min("alert_id").alias("first_alert"))


@query("SNK10_delete_all", """SELECT alert_id FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'signup' AND e.user_id = a.rule_id AND e.ts >= a.created_at)""")
def delete_all(t: Tables) -> DataFrame:
    """Alerts that are left when each signup empties its user's list."""
    emptied = t.raw("events").where("event_type = 'signup'").select(F.col("user_id").alias("rule_id"), F.col("ts").alias("created_at"))
    return state.delete_all(t.alerts(), emptied, owner="rule_id").select("alert_id")


@query("SNK6_outbox", """SELECT alert_id, CASE WHEN rule_id % 3 = 0 THEN false WHEN listing_id = 0 THEN false ELSE true END AS sent,
  CASE WHEN rule_id % 3 = 0 THEN 'telegram_kapali' WHEN listing_id = 0 THEN 'token_veya_chat_id_eksik' END AS reason FROM alerts""")
def outbox(t: Tables) -> DataFrame:
    """What a messenger does with each alert: by each user's own settings."""
    settings = t.alerts().withColumns({"_on": F.col("rule_id") % 3 != 0, "_token": F.when(F.col("listing_id") != 0, "t"), "_chat": F.lit("c")})
    return state.outbox(settings, F.col("_on"), F.col("_token"), F.col("_chat")).select("alert_id", "sent", "reason")


@query("SNK13_missing_stores", "SELECT s_name AS name FROM supplier WHERE s_acctbal < 1000", views=False)
def missing_stores(t: Tables) -> DataFrame:
    """Seed rows whose name isn't there yet."""
    s = t.raw("supplier")
    return s.select(F.col("s_name").alias("name")).join(s.where("s_acctbal >= 1000").select(F.col("s_name").alias("name")), "name", "left_anti")


@query("T1_recent_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey, o_totalprice LIMIT 300", views=False)
def recent_orders(t: Tables) -> DataFrame:
    return t.raw("orders").orderBy(F.desc("o_orderdate"), "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice").limit(300)


@query("T2_recent_alerts", "SELECT alert_id, rule_id FROM alerts QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY created_at DESC, alert_id DESC) <= 20")
def recent_alerts(t: Tables) -> DataFrame:
    newest = Window.partitionBy("rule_id").orderBy(F.desc("created_at"), F.desc("alert_id"))
    return t.alerts().withColumn("n", F.row_number().over(newest)).where("n <= 20").select("alert_id", "rule_id")


@query("T3_oldest_history", "SELECT tick_id, listing_id FROM ticks QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY checked_at, tick_id) <= 50")
def oldest_history(t: Tables) -> DataFrame:
    oldest = Window.partitionBy("listing_id").orderBy("checked_at", "tick_id")
    return t.ticks().withColumn("n", F.row_number().over(oldest)).where("n <= 50").select("tick_id", "listing_id")


@query("T9_best_price_nulls_last", "SELECT product_id, row_number() OVER (PARTITION BY brand ORDER BY b NULLS LAST, product_id) AS place FROM (SELECT product_id, brand, CASE WHEN product_id % 9 <> 0 THEN label_price END AS b FROM products)")
def best_price_nulls_last(t: Tables) -> DataFrame:
    """Each product's place among those of its brand, products without a price last."""
    p = t.products().select("product_id", "brand", F.when(F.col("product_id") % 9 != 0, F.col("label_price")).alias("b"))
    return hot.placed(p, "brand", "b", "product_id", 10, "place").select("product_id", "place")


@query("W5_latest_run", "SELECT o_orderpriority AS \"trigger\", first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS run FROM orders GROUP BY 1", views=False)
def latest_run(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(F.col("o_orderpriority").alias("trigger")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query("W9_chart_series", "SELECT tick_id, listing_id, price FROM ticks QUALIFY count(*) OVER (PARTITION BY listing_id) >= 2")
def chart_series(t: Tables) -> DataFrame:
    return insight.series_of_two(t.ticks(), "listing_id").select("tick_id", "listing_id", "price")


@query("W8_last8_messages", """SELECT conv_id, string_agg(role || ':' || left(text, 400), ' | ' ORDER BY turn) AS context FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) GROUP BY conv_id""", views=False)
def last8_messages(t: Tables) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.raw("conversations").withColumn("n", F.row_number().over(newest)).where("n <= 8")
    line = F.struct("turn", F.concat("role", F.lit(":"), F.substring("text", 1, 400)).alias("s"))
    return last.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select("conv_id", F.array_join(F.transform("l", lambda x: x["s"]), " | ").alias("context"))


@query("SNK16_text_chunks", """SELECT conv_id, turn, i AS piece, substr(text, i * 260 + 1, 260) AS chunk FROM (SELECT conv_id, turn, text, unnest(range(CAST(ceil(length(text) / 260.0) AS BIGINT))) AS i FROM conversations)""", views=False)
def text_chunks(t: Tables) -> DataFrame:
    return t.raw("conversations").select("conv_id", "turn", F.posexplode(text.chunks(F.col("text"))).alias("piece", "chunk")).withColumn("piece", F.col("piece").cast("long"))


@query("FN26_json_sizes", """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS BIGINT) AS k, event_id % 3 = 0 AS broken FROM events""", views=False)
def json_sizes(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.col("props"))
    read = F.from_json(raw, "k bigint")
    return t.raw("events").select("event_id", read["k"].alias("k"), (read.isNull() | read["k"].isNull()).alias("broken"))


@query("FN27_llm_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""", views=False)
def llm_json(t: Tables) -> DataFrame:
    said = F.concat(F.lit("Sure, here it is:\n"), F.col("props"), F.lit("\nAnything else?"))
    return t.raw("events").select("event_id", F.try_variant_get(F.try_parse_json(F.regexp_extract(said, r"(?s)\{.*\}", 0)), "$.k", "bigint").alias("k"))


@query("FN28_split_models", r"""SELECT event_id, 'a ' || event_type || '|model ' || user_id AS models FROM events""", views=False)
def split_models(t: Tables) -> DataFrame:
    said = F.concat(F.lit("Try these.\n[MODELLER]: a "), F.col("event_type"), F.lit(" | x |  model "), F.col("user_id"), F.lit(" \nBye"))
    return t.raw("events").select("event_id", F.array_join(text.suggested_models(said), "|").alias("models"))


@query("U8_alert_union", """SELECT alert_id, 'rule' AS kind, is_read FROM alerts UNION ALL SELECT tick_id, 'radar', NULL FROM ticks WHERE price > 90""")
def alert_union(t: Tables) -> DataFrame:
    ruled = t.alerts().select("alert_id", F.lit("rule").alias("kind"), "is_read")
    radar = t.ticks().where("price > 90").select(F.col("tick_id").alias("alert_id"), F.lit("radar").alias("kind"))
    return ruled.unionByName(radar, allowMissingColumns=True)


@query("P2_drop_nested", """SELECT product_id, count(*) AS results, sum(CAST(round(price * 100) AS BIGINT)) / 100 AS total FROM listings GROUP BY product_id""")
def drop_nested(t: Tables) -> DataFrame:
    nested = t.listings().groupBy("product_id").agg(F.collect_list(F.struct("store_id", "price", F.struct("size").alias("sizes"))).alias("r"))
    slim = nested.select("product_id", F.transform("r", lambda x: x.dropFields("sizes")).alias("r"))
    return slim.select("product_id", F.size("r").cast("long").alias("results"), (F.aggregate(F.transform("r", lambda x: F.round(x["price"] * 100).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b) / 100).alias("total"))
