"""Plans over kept tables: insight from partials, views bucketed by product, and the batch check in two runs of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.kept import PriceHistory, ProductTables, new_folder
from ..sources.tables import Tables
from ..streaming.checks import BatchCheck
from .alerts import LISTED, whole_rules
from .prices import INSIGHT_ASOF, MATCHES, PRODUCT_LIST, product_list, rule_matches
from .registry import query

#: Observations before it are the first batch, the others the second.
CUT = "1995-06-17"


@query("A7_price_insight_rollup", INSIGHT_ASOF)
def price_insight_rollup(t: Tables) -> DataFrame:
    """The trailing insight from daily partials, after two batches of history have been appended."""
    kept, first = PriceHistory(t.spark, new_folder(t.spark, "prices")), F.col("checked_at") < F.lit(CUT).cast("timestamp")
    rows = t.history().select("product_id", "store_id", "price", "checked_at")
    kept.append(rows.where(first), 0)
    kept.append(rows.where(~first), 1)
    return kept.insight()


@query("SNK1_kept_product_list", PRODUCT_LIST)
def kept_product_list(t: Tables) -> DataFrame:
    return product_list(ProductTables(t.spark, t.sf_dir))


@query("SNK1_kept_rule_matches", MATCHES)
def kept_rule_matches(t: Tables) -> DataFrame:
    return rule_matches(ProductTables(t.spark, t.sf_dir))


def observations(history: DataFrame) -> DataFrame:
    """History as observations of listings: some fail, some have no price, every ninth listing shows no sizes."""
    label = lambda n: F.when(n % 5 == 0, F.concat(n, F.lit(",5"))).otherwise(n.cast("string"))
    entry = lambda n, ok: F.struct(label(n).alias("name"), label(n).alias("size"), ok.alias("in_stock"))
    failed = F.when(F.col("seq.l_tax") >= 0.08, F.when(F.col("size") % 2 == 0, "HTTP 404").otherwise("HTTP 500"))
    price = F.when(F.col("discount") < 0.1, F.col("price"))
    return history.select(
        (F.col("product_id") * 100_000 + F.col("store_id")).alias("listing_id"), "product_id", price.alias("price"), F.lit(None).cast("double").alias("old_price"), F.when(F.col("store_id") % 4 == 0, price).alias("cart_price"), F.lit("shelf").alias("price_source"),
        F.when((F.col("product_id") + F.col("store_id")) % 9 != 0, F.array(entry(F.col("size"), F.col("size_in_stock")), entry(F.col("size") + 1, F.lit(False)))).alias("sizes"), "in_stock", failed.alias("error"), "checked_at", F.col("seq").alias("tie"),
    )


def checked(t: Tables) -> BatchCheck:
    """The check over the history's two halves, each landed and run by itself from the stream's checkpoint."""
    path = new_folder(t.spark, "check")
    products = t.products().select(F.col("product_id").alias("id"), "name", "active", text.family_key(F.col("name")).alias("family_key"))
    profile = t.raw("customer").where("c_custkey = 1").select(F.col("c_nationkey").cast("string").alias("shoe_size"), (F.col("c_acctbal") > 0).alias("use"))
    lineitem, first = t.raw("lineitem"), F.col("l_shipdate") < F.lit(CUT).cast("timestamp")
    for part in (lineitem.where(first), lineitem.where(~first)):
        part.write.mode("append").option("compression", "zstd").parquet(f"{path}/landed")
        stream = t.spark.readStream.schema(lineitem.schema).parquet(f"{path}/landed")
        check = BatchCheck(t.spark, path, whole_rules(t), products, profile)
        check.start(observations(t.history(stream))).awaitTermination()
    return check


CHECKED = LISTED + f""",
o AS (SELECT product_id, store_id, product_id * 100000 + store_id AS listing_id, CASE WHEN discount < 0.1 THEN price END AS price, CASE WHEN l_tax >= 0.08 THEN CASE WHEN size % 2 = 0 THEN 'HTTP 404' ELSE 'HTTP 500' END END AS error, size, size_in_stock, in_stock, checked_at,
  CASE WHEN checked_at < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS batch, (checked_at, l_orderkey, l_linenumber, l_extendedprice, l_quantity, discount, l_tax, price, size, in_stock) AS place FROM history),
b AS (SELECT batch, max(checked_at) AS at FROM o GROUP BY batch),
ob AS (SELECT b.batch AS upto, o.* FROM b JOIN o ON o.batch <= b.batch),
good AS (SELECT * FROM ob WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY upto, listing_id ORDER BY place DESC) = 1),
said AS (SELECT upto, listing_id, error FROM ob QUALIFY row_number() OVER (PARTITION BY upto, listing_id ORDER BY place DESC) = 1),
now AS (SELECT g.upto, g.product_id, g.store_id, g.listing_id, g.price, g.size, g.size_in_stock, CASE WHEN s.error = 'HTTP 404' THEN false ELSE g.in_stock END AS in_stock, (g.product_id + g.store_id) % 9 <> 0 AS listed FROM good g JOIN said s USING (upto, listing_id)),
touched AS (SELECT DISTINCT batch, product_id FROM o),
tf AS (SELECT DISTINCT batch, family FROM touched JOIN fam USING (product_id) WHERE family IS NOT NULL),
asked AS (SELECT b.batch, r.*, a.family FROM b, rl r JOIN fam a USING (product_id) WHERE EXISTS (SELECT 1 FROM touched t WHERE t.batch = b.batch AND t.product_id = r.product_id) OR (r.spectrum AND EXISTS (SELECT 1 FROM tf WHERE tf.batch = b.batch AND tf.family = a.family))),
c AS (SELECT r.batch, r.rule_id, r.product_id, l.listing_id, f.name, l.price, r.target_price, r.spectrum, l.store_id, l.listed, l.in_stock, r.want, CASE WHEN l.size % 5 = 0 THEN l.size || ',5' ELSE CAST(l.size AS VARCHAR) END AS label, l.size_in_stock
  FROM asked r JOIN fam f ON f.product_id = r.product_id OR (r.spectrum AND f.family = r.family) JOIN now l ON l.upto = r.batch AND l.product_id = f.product_id AND l.price <= r.target_price * 1.1)
==
"""


@query("ST6_batch_check", CHECKED + """SELECT batch, rule_id, product_id, listing_id, CASE WHEN price > target_price THEN '🎯 HEDEFE YAKLAŞTI: ' ELSE '✅ HEDEF YAKALANDI: ' END || name AS title, price, CASE WHEN want IS NOT NULL THEN label WHEN listed THEN 'Herhangi bir beden' ELSE 'Beden bilgisi yok' END AS size,
  CASE WHEN store_id % 4 = 0 THEN 'Sepet indirimi' ELSE 'Normal fiyat' END AS price_type FROM c WHERE CASE WHEN want IS NOT NULL THEN listed AND replace(label, ',', '.') = want AND size_in_stock WHEN listed THEN size_in_stock ELSE in_stock END
  QUALIFY NOT spectrum OR row_number() OVER (PARTITION BY batch, rule_id ORDER BY price, listing_id) = 1""")
def batch_check(t: Tables) -> DataFrame:
    """Alerts of both runs; the two are years apart, so that no cooldown holds one back."""
    return checked(t).alerts().select(F.col("batch").cast("int").alias("batch"), "rule_id", "product_id", "listing_id", "title", "price", "size", "price_type")


@query("SNK8_batch_runs", """
o AS (SELECT CASE WHEN checked_at < TIMESTAMP '""" + CUT + """' THEN 0 ELSE 1 END AS batch, l_tax >= 0.08 AS failed, discount < 0.1 AS priced, checked_at FROM history)
==
SELECT batch, count(*) AS total, count(*) FILTER (NOT failed AND priced) AS success, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND NOT priced) AS no_price, max(checked_at) AS finished_at FROM o GROUP BY batch""")
def batch_runs(t: Tables) -> DataFrame:
    """The reports of both runs, whose counters were taken while their observations were written."""
    return checked(t).runs().select(F.col("batch").cast("int").alias("batch"), "total", "success", "failed", "no_price", "finished_at")
