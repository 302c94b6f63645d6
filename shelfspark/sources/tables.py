"""Domain views over the star-schema tables: products, price history, listings, rules, alerts, runs and messages.

All are lazy projections, so filters and column pruning reach the Parquet scans. `as_of` is always data, never the
clock: the latest instant of the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Rounded half up to two decimals in binary arithmetic, which every engine does alike."""
    return F.floor(amount * 100 + 0.5) / 100


class Tables:
    """Reads a folder of Parquet tables as the views that the plans use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def products(self) -> DataFrame:
        """Parts as products; small ones are inactive."""
        return self.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("shoe_size"), F.col("p_retailprice").alias("label_price"), (F.col("p_size") > 5).alias("active"))

    def history(self, lineitem: DataFrame | None = None) -> DataFrame:
        """Line items, of the table or of a given one such as a stream, as price observations; seq breaks ties of one instant."""
        return (self.raw("lineitem") if lineitem is None else lineitem).select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"), cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("checked_at"),
            (F.col("l_returnflag") != "R").alias("in_stock"), F.col("l_quantity").cast("int").alias("size"), (F.col("l_linestatus") == "O").alias("size_in_stock"), F.col("l_discount").alias("discount"),
            F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("seq"),
        )

    @staticmethod
    def latest() -> Column:
        """The latest of a group's observations."""
        return F.max(F.struct("checked_at", "seq", "price", "in_stock", "size", "size_in_stock", "discount")).alias("l")

    def listings(self) -> DataFrame:
        """The latest observation of each product in each store."""
        return self.history().groupBy("product_id", "store_id").agg(self.latest()).select("product_id", "store_id", F.col("l.checked_at").alias("checked_at"), F.col("l.price").alias("price"), F.col("l.in_stock").alias("in_stock"), F.col("l.size").alias("size"), F.col("l.size_in_stock").alias("size_in_stock"), F.col("l.discount").alias("discount"))

    def rules(self) -> DataFrame:
        """One rule for each product: a target of nine tenths of the label price; spectrum for one kind; no size for every third."""
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("rule_id"), F.col("p_partkey").alias("product_id"), cents(F.col("p_retailprice") * 0.9).alias("target_price"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("rule_size"), (F.col("p_type") == "ECONOMY").alias("spectrum"), (F.col("p_partkey") % 4 * 12).cast("double").alias("cooldown_hours"), (F.col("p_size") > 3).alias("enabled"))

    def dated_rules(self) -> DataFrame:
        """The rules with the day they are from, and a second one, older or newer, for every other product."""
        day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).alias("created_at")
        p, first = F.col("product_id"), self.rules()
        second = first.where("product_id % 2 = 0").select((F.col("rule_id") + 10_000_000).alias("rule_id"), *[c for c in first.columns if c not in ("rule_id", "target_price")], cents(F.col("target_price") * 0.8).alias("target_price"), day(p * 3 % 11))
        return first.select("*", day(p % 7)).unionByName(second)

    def alerts(self) -> DataFrame:
        """Purchases as alerts of a rule (user) on a listing (a user's item)."""
        e = self.raw("events").where("event_type = 'purchase'")
        return e.select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("rule_id"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("listing_id"), "value", F.col("ts").alias("created_at"), (F.col("event_id") % 2 == 0).alias("is_read"))

    def candidates(self) -> DataFrame:
        """Clicks as candidates for an alert, keyed as alerts are."""
        e = self.raw("events").where("event_type = 'click'")
        return e.select(F.col("event_id").alias("candidate_id"), F.col("user_id").alias("rule_id"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("listing_id"), F.col("ts").alias("as_of"), (F.col("user_id") % 4 * 12).cast("double").alias("cooldown_hours"))

    def ticks(self) -> DataFrame:
        """Events as a price stream of one listing for each user."""
        return self.raw("events").select(F.col("event_id").alias("tick_id"), F.col("user_id").alias("listing_id"), F.col("value").alias("price"), F.col("ts").alias("checked_at"))


#: The same views in SQL, as common table expressions.
SQL_VIEWS = """
products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS shoe_size, p_retailprice AS label_price, p_size > 5 AS active FROM part),
history AS (SELECT l_partkey AS product_id, l_suppkey AS store_id, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_shipdate AS checked_at, l_returnflag <> 'R' AS in_stock,
  CAST(l_quantity AS INT) AS size, l_linestatus = 'O' AS size_in_stock, l_discount AS discount, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_tax FROM lineitem),
listings AS (SELECT product_id, store_id, checked_at, price, in_stock, size, size_in_stock, discount FROM history
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY checked_at DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, discount DESC, l_tax DESC, price DESC, in_stock DESC, size DESC, size_in_stock DESC) = 1),
rules AS (SELECT p_partkey AS rule_id, p_partkey AS product_id, floor(p_retailprice * 0.9::DOUBLE * 100 + 0.5) / 100 AS target_price, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS rule_size, p_type = 'ECONOMY' AS spectrum,
  CAST(p_partkey % 4 * 12 AS DOUBLE) AS cooldown_hours, p_size > 3 AS enabled FROM part),
dated_rules AS (SELECT *, DATE '2024-01-01' + CAST(product_id % 7 AS INT) AS created_at FROM rules UNION ALL SELECT rule_id + 10000000, product_id, floor(target_price * 0.8::DOUBLE * 100 + 0.5) / 100, rule_size, spectrum, cooldown_hours, enabled, DATE '2024-01-01' + CAST(product_id * 3 % 11 AS INT)
  FROM rules WHERE product_id % 2 = 0),
alerts AS (SELECT event_id AS alert_id, user_id AS rule_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS listing_id, value, ts AS created_at, event_id % 2 = 0 AS is_read FROM events WHERE event_type = 'purchase'),
candidates AS (SELECT event_id AS candidate_id, user_id AS rule_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS listing_id, ts AS as_of, CAST(user_id % 4 * 12 AS DOUBLE) AS cooldown_hours FROM events WHERE event_type = 'click'),
ticks AS (SELECT event_id AS tick_id, user_id AS listing_id, value AS price, ts AS checked_at FROM events)
"""
