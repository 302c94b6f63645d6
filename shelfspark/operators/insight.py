"""Trailing price insight of each product, and price drops of each listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hot

MOST_PRICE = 150_000
WINDOWS = (7, 30, 90)


def micros(column: str) -> Column:
    """Microseconds of an instant, with or without a time zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def clean_history(history: DataFrame) -> DataFrame:
    """Rows with a plausible price and an instant."""
    return history.where((F.col("price") > 0) & (F.col("price") <= MOST_PRICE) & F.col("checked_at").isNotNull())


def near_lowest() -> Column:
    """Whether last_price is within 2 % of min_30d."""
    return F.coalesce((F.col("last_price") != 0) & (F.col("min_30d") != 0) & (F.col("last_price") <= F.col("min_30d") * 1.02), F.lit(False))


def price_insight(history: DataFrame, keys: list[str], as_of: DataFrame | None = None) -> DataFrame:
    """(keys, min_7d, min_30d, min_90d, avg_30d, data_points, last_price, is_near_lowest), one aggregation; windows end at the latest instant of history, or of as_of(as_of)."""
    points = clean_history(history)
    end = (as_of if as_of is not None else history.agg(F.max("checked_at").alias("as_of"))).select("as_of").scalar()
    dated = points.select(*keys, "price", "checked_at", end.alias("as_of"))
    within = lambda days: F.when(F.col("checked_at") >= F.col("as_of") - F.make_dt_interval(F.lit(days)), F.col("price"))
    out = dated.groupBy(*keys).agg(
        *[F.min(within(d)).alias(f"min_{d}d") for d in WINDOWS],
        (F.floor(F.avg(F.round(within(30) * 100).cast("long")) + 0.5) / 100).alias("avg_30d"),  # whole cents, so that no order of summing matters
        F.count("*").alias("data_points"),
        F.min_by("price", F.struct(-micros("checked_at"), F.col("price"))).alias("last_price"),
    )
    return out.withColumn("is_near_lowest", near_lowest())


def running_low(ticks: DataFrame, key: str, days: int = 7, least: int = hot.LEAST) -> DataFrame:
    """Each tick with the least price, and the number of ticks, of the `days` days that end with it; hot keys (`hot.split`) day by day."""
    span = Window.partitionBy(key).orderBy(micros("checked_at")).rangeBetween(-days * 86_400_000_000, 0)
    cold, much = hot.split(ticks, key, least)
    plain = cold.withColumns({"low": F.min("price").over(span), "n": F.count("*").over(span)})
    return plain if much is None else plain.unionByName(hot.trailing_low(much, key, "checked_at", "price", days))


def price_drops(observations: DataFrame, key: str, order: list[str], least: float = 50.0, most: float = 200_000.0, hot_from: int = hot.LEAST) -> DataFrame:
    """Observations that are at least 3 % below the one before, which must be plausible; hot keys of more than `hot_from` rows day by day."""
    cold, much = hot.split(observations, key, hot_from)
    before = F.lag("price").over(Window.partitionBy(key).orderBy(*order))
    seen = cold.withColumn("previous_price", before)
    if much is not None:
        seen = seen.unionByName(hot.with_previous(much, key, order, "price", "previous_price"))
    valid = F.col("previous_price").between(least, most) & (F.col("previous_price") <= F.col("price") * 5)
    dropped = seen.where(valid & (F.col("price") < F.col("previous_price") * 0.97))
    return dropped.withColumn("drop_pct", F.bround((F.col("previous_price") - F.col("price")) / F.col("previous_price") * 100, 0))


def series_of_two(ticks: DataFrame, key: str, least: int = hot.LEAST) -> DataFrame:
    """Ticks of listings that have two or more; those of hot listings aren't shuffled."""
    cold, much = hot.split(ticks, key, max(least, 1))
    plain = cold.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n >= 2").drop("_n")
    return plain if much is None else plain.unionByName(much)


def tumbling_prices(ticks: DataFrame, length: str = "1 day") -> DataFrame:
    """Count, low, high and mean of each listing's prices in each window."""
    return ticks.groupBy("listing_id", F.window("checked_at", length)).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("price"), 4).alias("mean")).select("listing_id", F.col("window.start").alias("starts"), "n", "low", "high", "mean")
