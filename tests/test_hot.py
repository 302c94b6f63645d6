"""Windows over hot keys give the rows of plain windows, from many tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import hot, insight

START = dt.datetime(2024, 1, 1)
SCHEMA = "tick_id long, listing_id long, price double, checked_at timestamp, low string, _own int"


@pytest.fixture(scope="module")
def ticks(spark):
    """Nine tenths of 4,000 ticks are of listing 1; ties, repeats, nulls in every column, gaps of weeks and clashing names."""
    draw = random.Random(3)
    out = []
    for i in range(4000):
        key = 1 if i % 10 else draw.choice([2, 3, None])
        hours = draw.choice([draw.randint(0, 24 * 9), draw.randint(24 * 30, 24 * 45), 24 * draw.randint(0, 20)])
        at = None if i % 97 == 0 else START + dt.timedelta(hours=hours)
        out.append((i, key, None if i % 53 == 0 else float(draw.randint(60, 900)), at, "x", 7))
    return spark.createDataFrame(out + out[:40], SCHEMA).repartition(8).cache()


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("days", [1, 2, 7])
def test_trailing_low(ticks, days):
    span = Window.partitionBy("listing_id").orderBy(insight.micros("checked_at")).rangeBetween(-days * 86_400_000_000, 0)
    want = rows(ticks.drop("low").withColumns({"low": F.min("price").over(span), "n": F.count("*").over(span)}))
    assert rows(insight.running_low(ticks, "listing_id", days)) == want
    assert rows(insight.running_low(ticks, "listing_id", days, least=0)) == want
    assert rows(insight.running_low(ticks, "listing_id", days, least=1000)) == want


def test_price_drops(ticks):
    order = ["checked_at", "tick_id"]
    once = ticks.drop("_own").dropDuplicates(["tick_id"])
    want = rows(insight.price_drops(once, "listing_id", order))
    assert len(want) > 500
    for least in (0, 1000):
        assert rows(insight.price_drops(once, "listing_id", order, hot_from=least)) == want


def test_series_and_places(ticks):
    want = rows(ticks.withColumn("k", F.count("*").over(Window.partitionBy("listing_id"))).where("k >= 2").drop("k"))
    assert rows(insight.series_of_two(ticks, "listing_id")) == rows(insight.series_of_two(ticks, "listing_id", least=0)) == want
    once = ticks.drop("_own").dropDuplicates(["tick_id"])
    place = Window.partitionBy("listing_id").orderBy(F.asc_nulls_last("price"), "tick_id")
    assert rows(hot.placed(once, "listing_id", "price", "tick_id", 50, "place")) == rows(once.withColumn("place", F.row_number().over(place)))


def test_hot_keys_are_few(spark, ticks):
    assert [r[0] for r in hot.hot_keys(ticks, "listing_id", 1000).collect()] == [1]
    assert hot.hot_keys(spark.range(5000).withColumn("k", F.col("id")), "k", 0).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert insight.running_low(none, "listing_id", least=0).count() == insight.price_drops(none.drop("_own"), "listing_id", ["checked_at", "tick_id"], hot_from=0).count() == 0


def test_a_hot_listing_is_many_tasks(spark, ticks):
    """With 64 shuffle partitions, no task that finds previous prices or trailing lows has over a third of the rows."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        one = ticks.drop("_own").where("listing_id = 1").cache()
        made = ((hot.with_previous(one, "listing_id", ["checked_at", "tick_id"], "price", "p"), "p"), (hot.trailing_low(one, "listing_id", "checked_at", "price", 7), "low"), (hot.placed(one, "listing_id", "price", "tick_id", 50, "p"), "p"))
        for found, column in made:  # the column is asked for, so that its window stays in the plan
            sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(column)).collect()]
            assert max(sizes) * 3 < sum(sizes) and len(sizes) > 10
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
