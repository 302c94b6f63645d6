"""The plan of variant discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery
from ..sources.tables import Tables
from .registry import query


@query("ST7_variant_discovery", """
pg AS (SELECT product_id AS id, CASE WHEN product_id % 11 <> 0 THEN 'm' || (product_id // 8) END AS family FROM products),
ln AS (SELECT id, unnest([id + 1, id - 3, id * 2 + 1]) AS t FROM pg),
s AS (SELECT * FROM pg WHERE id % 16 = 1),
RECURSIVE_r(id, family) AS (SELECT id, family FROM s UNION SELECT p.id, coalesce(r.family, p.family) FROM RECURSIVE_r r JOIN ln ON ln.id = r.id JOIN pg p ON p.id = ln.t WHERE (r.family IS NULL OR p.family IS NULL OR r.family = p.family) AND p.id NOT IN (SELECT id FROM s))
==
SELECT CAST(id AS VARCHAR) AS url, min(family) AS family FROM RECURSIVE_r WHERE id NOT IN (SELECT id FROM s) GROUP BY id""")
def variant_discovery(t: Tables) -> DataFrame:
    """Products as pages, in families of eight of which every eleventh is unknown; links go on, back, and far away."""
    known = F.when(F.col("product_id") % 11 != 0, F.concat(F.lit("m"), F.floor(F.col("product_id") / 8)))
    pages = t.products().select(F.col("product_id").alias("url"), known.alias("family"))
    i = F.col("url")
    links = pages.select("url", F.explode(F.array(i + 1, i - 3, i * 2 + 1)).alias("to"))
    return discovery.discovered(pages.where("url % 16 = 1"), links, pages).select("url", "family")
