"""Variant discovery: what is reached from tracked pages over links to colour variants, within the family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.kept import new_folder


def discovered(sources: DataFrame, links: DataFrame, pages: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(url, family, depth) of the pages that sources(url, family) lead to over links(url, to), and that are not sources themselves.

    A page of pages(url, family) is followed if its family is the one looked for, or if either is unknown; it then counts
    as one of the family looked for, or of its own. A page that is reached for several families is looked at for each,
    and has the first of them, by code points, at its least depth. Links in a circle end where they began; links to pages that are
    not there lead nowhere. Each round follows the last one's pages only, and is written to the cluster's shared folder; only whether there are more
    comes to the driver.
    """
    spark, path = sources.sparkSession, new_folder(sources.sparkSession, "discovery")
    known = sources.select("url").distinct()
    schema = "url string, family string, depth int"

    def keep(rows: DataFrame, at: int) -> DataFrame:
        rows.write.parquet(f"{path}/round={at}")
        return spark.read.schema(schema).parquet(f"{path}/round={at}")

    new = keep(sources.select(F.col("url").cast("string").alias("url"), "family", F.lit(0).alias("depth")).distinct(), 0)
    # sources and pages seen so far grow with the tables: without a hint they would be collected for a broadcast in every round
    for at in range(1, most_rounds + 1):
        asked = new.alias("s").join(links.alias("l"), F.col("s.url") == F.col("l.url")).select(F.col("l.to").cast("string").alias("url"), F.col("s.family").alias("_for")).distinct()
        fits = asked.join(pages.select(F.col("url").cast("string").alias("url"), F.col("family").alias("_own")), "url").where(text.same_family(F.col("_for"), F.col("_own")))
        reached = fits.select("url", F.coalesce("_for", "_own").alias("family")).distinct().join(known.select(F.col("url").cast("string").alias("url")).hint("merge"), "url", "left_anti")
        seen = spark.read.schema(schema).option("basePath", path).parquet(path).hint("merge").alias("o")
        fresh = reached.alias("n").join(seen, (F.col("n.url") == F.col("o.url")) & F.col("n.family").eqNullSafe(F.col("o.family")), "left_anti")
        new = keep(fresh.select("url", "family", F.lit(at).alias("depth")), at)
        if new.isEmpty():
            found = spark.read.schema(schema).option("basePath", path).parquet(path).where("depth > 0")
            return found.groupBy("url").agg(F.min("family").alias("family"), F.min("depth").alias("depth"))
    raise RuntimeError(f"discovery: still new pages after {most_rounds} rounds")
