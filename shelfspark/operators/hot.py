"""Keys that hold many rows, told apart so that windows over them can be cut into slices of time.

A key is hot if it has more than `least` rows and more than one in 1,024 of all rows, so there are fewer than 1,024 hot
keys and they may reach the driver. Both ways of a window give the same rows; the hot one shuffles more and never
has more than a slice of a key in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ONE_IN = 1024
#: So many rows of one key are no burden to a task.
LEAST = 1_000_000


def hot_keys(rows: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """(_hot): the hot keys, the null key among them if it is hot; fewer than ONE_IN."""
    counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    return counts.where((F.col("_n") > least) & (F.col("_n") * ONE_IN > rows.agg(F.count("*")).scalar())).select("_hot")


def split(rows: DataFrame, key: str, least: int = LEAST) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cold keys and rows of hot keys, or all rows and None if there is no hot key. Looks for hot keys at once; both sides then are filters that scans can take."""
    found = [r["_hot"] for r in hot_keys(rows, key, least).collect()]
    if not found:
        return rows, None
    is_hot = F.coalesce(F.col(key).isin([v for v in found if v is not None]), F.lit(None in found))
    return rows.where(~is_hot), rows.where(is_hot)


def with_previous(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before within the key, by `order`, which begins with an instant or a date; a task has at most a day of a key.

    The last value of each day is carried to the key's next day that has rows, as a row that comes first there.
    """
    daily = rows.withColumns({"_day": F.to_date(order[0]), "_own": F.lit(1)})
    last = daily.groupBy(key, "_day").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(key, "_day", F.lag("_last").over(Window.partitionBy(key).orderBy("_day")).alias(value), F.lit(0).alias("_own"))
    both = daily.unionByName(carried, allowMissingColumns=True)
    seen = both.withColumn(name, F.lag(value).over(Window.partitionBy(key, "_day").orderBy("_own", *order)))
    return seen.where("_own = 1").drop("_own", "_day")


def trailing_low(rows: DataFrame, key: str, instant: str, value: str, days: int) -> DataFrame:
    """Adds low and n, the least value and the number of the key's rows in the `days` days that end with a row; a task has at most a day of a key.

    The days are a piece of the first one, whole days and a piece of the last one: suffix minima of the first, partials of
    whole days and prefix minima of the last, found in one window sort of each day. Rows without an instant see one another.
    """
    day, at = 86_400_000_000, F.unix_micros(F.col(instant).cast("timestamp"))
    span, start = days * day, lambda t: t - F.pmod(t, F.lit(day))
    points = rows.groupBy(F.col(key).alias("_k"), at.alias("_at")).agg(F.min(value).alias("_low"), F.count("*").alias("_n"))
    nothing = F.lit(None).cast(points.schema["_low"].dataType)
    own = F.struct(start(F.col("_at")).alias("day"), F.col("_at").alias("t"), F.col("_low").alias("low"), F.col("_n").alias("n"), F.lit(0).alias("kind"))
    asks = F.struct(start(F.col("_at") - span).alias("day"), (F.col("_at") - span).alias("t"), nothing.alias("low"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("kind"))
    pieces = points.select("_k", F.explode(F.when(F.col("_at").isNull(), F.array(own)).otherwise(F.array(own, asks))).alias("p")).select("_k", "p.*")
    whole = points.where("_at is not null").groupBy("_k", start(F.col("_at")).alias("of")).agg(F.min("_low").alias("low"), F.sum("_n").alias("n"))
    later = whole.select("_k", F.explode(F.sequence(F.lit(1), F.lit(days - 1))).alias("i"), "of", "low", "n").where("i > 0") if days > 1 else whole.limit(0).withColumn("i", F.lit(1))
    begun = (F.col("of") + F.col("i") * day).alias("day")
    both = pieces.unionByName(later.select("_k", begun, (F.col("of") + F.col("i") * day - 1).alias("t"), "low", "n", F.lit(2).alias("kind")))
    within = Window.partitionBy("_k", "day")
    until = within.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    since = within.orderBy(F.desc_nulls_last("t")).rangeBetween(Window.unboundedPreceding, 0)
    asked = F.col("kind") == 1
    told = both.select(
        "_k", "kind", F.when(asked, F.col("t") + span).otherwise(F.col("t")).alias("_at"),
        F.min("low").over(until).alias("l0"), F.sum("n").over(until).alias("n0"), F.min("low").over(since).alias("l1"), F.sum("n").over(since).alias("n1"),
    ).where("kind < 2")
    asked = F.col("kind") == 1
    merged = told.groupBy("_k", "_at").agg(F.min(F.when(asked, F.col("l1")).otherwise(F.col("l0"))).alias("low"), F.sum(F.when(asked, F.col("n1")).otherwise(F.col("n0"))).alias("n"))
    bare = rows.drop("low", "n").withColumn("_t", at)
    return bare.join(merged, bare[key].eqNullSafe(merged["_k"]) & bare["_t"].eqNullSafe(merged["_at"])).drop("_k", "_at", "_t")


def placed(rows: DataFrame, key: str, value: str, tie: str, step: float, name: str) -> DataFrame:
    """Adds each row's place within its key by (value, null last; tie), from 1; a task has at most the rows of one key whose values lie within one `step`.

    The counts of the steps before are summed up from one row a key and step.
    """
    cut = rows.withColumns({"_step": F.floor(F.col(value) / step), "_own": F.lit(1).cast("long")})
    before = Window.partitionBy(key).orderBy(F.asc_nulls_last("_step")).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(key, "_step").agg(F.count("*").alias("_c")).select(key, "_step", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_add"))
    both = cut.withColumn("_kept", F.lit(1)).unionByName(counts.select(key, "_step", F.col("_add").alias("_own"), F.lit(0).alias("_kept")), allowMissingColumns=True)
    upto = Window.partitionBy(key, "_step").orderBy("_kept", F.asc_nulls_last(value), tie).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("_own").over(upto)).where("_kept = 1").drop("_step", "_own", "_kept")
