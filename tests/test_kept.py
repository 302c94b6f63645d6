"""Kept tables, the batch check as a stream, and streams whose state expires."""

import datetime as dt
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from shelfspark import plans
from shelfspark.operators import insight
from shelfspark.plans import kept as kept_plans
from shelfspark.sources.kept import PriceHistory, ProductTables
from shelfspark.sources.tables import Tables
from shelfspark.streaming import checks, radar

SF = "/root/testdata/sf0.001"
DAY = dt.timedelta(days=1)


def rows(df):
    return sorted(map(str, df.collect()))


def same_insight(kept, history):
    got, want = kept.insight(), insight.price_insight(history, ["product_id"])
    assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))


def test_insight_from_partials(spark, tmp_path):
    end = dt.datetime(2024, 3, 31, 13, 30)
    seen = [(i % 7, float(50 + (i * 37) % 101), end - dt.timedelta(hours=5 * i)) for i in range(700)]
    seen += [(8, 10.0, end - n * DAY - s) for n in (7, 30, 90) for s in (dt.timedelta(), dt.timedelta(seconds=1))] + [(9, 5.0, end - 400 * DAY), (9, -1.0, end), (9, 200_000.0, end), (9, None, end)]
    history = spark.createDataFrame(seen, "product_id long, price double, checked_at timestamp")
    kept = PriceHistory(spark, str(tmp_path / "prices"))
    kept.append(history.where("checked_at < '2024-02-01'"), 0)
    kept.append(history.where("checked_at >= '2024-02-01'"), 1)
    same_insight(kept, history)
    before = rows(kept.history())
    kept.append(history.where("checked_at >= '2024-02-01'"), 1)  # run again
    assert rows(kept.history()) == before
    same_insight(kept, history)
    upto = kept.insight(0)
    assert rows(upto.select(sorted(upto.columns))) == rows(insight.price_insight(history.where("checked_at < '2024-02-01'"), ["product_id"]).select(sorted(upto.columns)))


def test_insight_reads_the_months_of_its_windows_only(spark, tmp_path):
    history = Tables(spark, SF).history().select("product_id", "price", "checked_at")
    kept = PriceHistory(spark, str(tmp_path / "prices"))
    kept.append(history, 0)
    same_insight(kept, history)
    read = kept.insight()
    assert not [f for f in read.inputFiles() if "/history/" in f]  # windows begin with a day
    plan = read._jdf.queryExecution().executedPlan().toString()
    first = int(re.search(r"PartitionFilters: \[[^]]*month#\d+ >= (\d+)", plan).group(1))
    months = kept.history().select("month").distinct()
    assert months.where(F.col("month") >= first).count() <= 5 < months.count()


def test_views_by_product_need_no_exchange(spark):
    t = ProductTables(spark, SF)
    joined = t.products().join(t.listings(), "product_id").join(t.rules(), "product_id").groupBy("product_id").agg(F.min("price"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        matches = kept_plans.rule_matches(t)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in matches
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert t.listings().count() == Tables(spark, SF).listings().count()


SIZES = "array<struct<name:string,size:string,in_stock:boolean>>"
OBSERVED = f"listing_id long, product_id long, price double, old_price double, cart_price double, price_source string, sizes {SIZES}, in_stock boolean, error string, checked_at timestamp, tie long"
START = dt.datetime(2024, 1, 1)


def seen(listing, product, price, hours, error=None, sizes=(("42", True),), tie=0):
    return (listing, product, price, 200.0, None, "shelf", [(s, s, ok) for s, ok in sizes] if sizes is not None else None, True, error, START + dt.timedelta(hours=hours), tie)


BATCHES = [
    [seen(1, 1, 90.0, 0), seen(2, 1, 300.0, 0), seen(3, 2, 95.0, 1), seen(4, 3, 50.0, 1, sizes=None)],
    [seen(1, 1, 80.0, 5), seen(2, 1, 99.0, 6), seen(3, 2, 70.0, 6, error="HTTP 500")],
    [seen(4, 3, None, 30, sizes=None), seen(1, 1, 85.0, 29), seen(1, 1, 60.0, 29, sizes=(("42", False), ("43", True)), tie=1)],
    [seen(4, 3, 40.0, 60, error="HTTP 404", sizes=None), seen(3, 2, 60.0, 61)],
]


def check_of(spark, path, after=None):
    rules = spark.createDataFrame([(10, 1, 100.0, "42", False, 24.0, True), (11, 1, 100.0, None, False, 2.0, True), (20, 2, 100.0, None, True, 24.0, True), (30, 3, 100.0, "-", False, None, True), (31, 3, 100.0, None, False, 1.0, False)], "id long, product_id long, target_price double, size string, spectrum_mode boolean, cooldown_hours double, enabled boolean")
    products = spark.createDataFrame([(1, "One", "f", True), (2, "Two", "f", True), (3, "Three", None, True)], "id long, name string, family_key string, active boolean")
    profile = spark.createDataFrame([("42", True)], "shoe_size string, use boolean")
    return checks.BatchCheck(spark, path, rules, products, profile, after)


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    check = check_of(spark, str(tmp_path_factory.mktemp("whole") / "check"))
    for i, batch in enumerate(BATCHES):
        check.run_batch(spark.createDataFrame(batch, OBSERVED), i)
    return check


def test_alerts_of_the_batch_check(checked):
    got = sorted((r.batch, r.rule_id, r.listing_id, r.price, r["size"]) for r in checked.alerts().collect())
    assert got == [
        (0, 10, 1, 90.0, "42"), (0, 11, 1, 90.0, "Herhangi bir beden"), (0, 20, 1, 90.0, "Herhangi bir beden"), (0, 30, 4, 50.0, "Beden bilgisi yok"),
        (1, 10, 2, 99.0, "42"), (1, 11, 1, 80.0, "Herhangi bir beden"), (1, 11, 2, 99.0, "Herhangi bir beden"),
        (2, 10, 2, 99.0, "42"), (2, 11, 1, 60.0, "Herhangi bir beden"), (2, 11, 2, 99.0, "Herhangi bir beden"), (2, 20, 1, 60.0, "Herhangi bir beden"),
        (3, 20, 1, 60.0, "Herhangi bir beden"),
    ]


def test_runs_and_state_of_the_batch_check(checked):
    assert sorted((r.batch, r.total, r.success, r.failed, r.no_price) for r in checked.runs().collect()) == [(0, 4, 4, 0, 0), (1, 3, 2, 1, 0), (2, 3, 2, 0, 1), (3, 2, 1, 1, 0)]
    counts = {r.batch: r.alerts_created for r in checked.runs().collect()}
    assert counts == {b: checked.alerts().where(F.col("batch") == b).count() for b in range(4)}
    now = {r.listing_id: r for r in checked.listings().collect()}
    assert (now[1].last_price, [s.in_stock for s in now[1].last_sizes]) == (60.0, [False, True])
    assert (now[3].last_price, now[3].last_error) == (60.0, None) and now[4].last_error == "HTTP 404" and now[4].last_in_stock is False and now[4].last_price is None
    assert {r.listing_id: r.last_error for r in checked.listings(1).collect()}[3] == "HTTP 500" and {r.listing_id: r.last_price for r in checked.listings(1).collect()}[3] == 95.0
    assert checked.prices.history().count() == 9
    scored = checked.alerts().where("batch = 0 and rule_id = 10").first()
    # price 20, 6 for the rate; stock 20; profile 8 + 12 + 5; shelf 12
    assert (scored.ai_decision, scored.ai_score) == ("ALINABİLİR", 83)


@pytest.mark.parametrize("step", ["history", "alerts"])
def test_killed_runs_leave_the_same_rows(spark, tmp_path, checked, step):
    class Killed(Exception):
        pass

    def die(at, batch):
        if (at, batch) == (step, 1):
            raise Killed

    path = str(tmp_path / "check")
    check = check_of(spark, path, die)
    check.run_batch(spark.createDataFrame(BATCHES[0], OBSERVED), 0)
    with pytest.raises(Killed):
        check.run_batch(spark.createDataFrame(BATCHES[1], OBSERVED), 1)
    assert check.done() == 0 and check.alerts().where("batch > 0").isEmpty()
    again = check_of(spark, path)
    for i, batch in enumerate(BATCHES[:2]):
        again.run_batch(spark.createDataFrame(batch, OBSERVED), i)  # the first counts already
    for got, want in ((again.alerts(), checked.alerts(1)), (again.runs(), checked.runs().where("batch < 2")), (again.listings(), checked.listings(1)), (again.prices.history(), checked.prices.history(1))):
        assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(got.columns)))


def test_whole_states_between_deltas(spark, tmp_path, checked, monkeypatch):
    monkeypatch.setattr(checks, "WHOLE_EVERY", 2)
    check = check_of(spark, str(tmp_path / "check"))
    for i, batch in enumerate(BATCHES):
        check.run_batch(spark.createDataFrame(batch, OBSERVED), i)
    assert check._read("latest", 2).where("batch = 2").count() == 4
    assert rows(check.listings()) == rows(checked.listings()) and rows(check.alerts().drop("batch")) == rows(checked.alerts().drop("batch"))


def test_last_prices_expire(spark, tmp_path):
    ticks = [(i, u, p, START + dt.timedelta(hours=h)) for i, (u, p, h) in enumerate([(1, 100.0, 0), (2, 100.0, 1), (1, 90.0, 20), (1, 80.0, 60), (3, 60.0, 61), (2, 50.0, 400), (3, 55.0, 401), (3, 52.0, 402)])]
    parts = [ticks[:2], ticks[2:3], ticks[3:5], ticks[5:7], ticks[7:]]
    schema = "tick_id long, listing_id long, price double, checked_at timestamp"
    found = []
    for part in parts:  # five micro-batches, each from the last one's checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = radar.drop_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep_days=2)
        found = radar.run_available(stream, str(tmp_path / "state"), str(tmp_path / "out")).collect()
    whole = spark.createDataFrame(ticks, schema)
    before = whole.alias("a").join(whole.alias("b"), "listing_id").where("b.tick_id < a.tick_id").groupBy("a.tick_id").agg(F.max("b.tick_id").alias("last"))
    near = {r["tick_id"] for r in before.collect() if ticks[r["tick_id"]][3] - ticks[r["last"]][3] <= 2 * DAY}
    want = {(r.tick_id, r.previous_price) for r in insight.price_drops(whole, "listing_id", ["checked_at", "tick_id"]).collect() if r.tick_id in near}
    assert {(r.tick_id, r.previous_price) for r in found} == want == {(2, 100.0), (3, 90.0), (7, 55.0)}
    values = spark.read.format("statestore").option("stateVarName", "value").load(str(tmp_path / "state")).select("key.*").collect()
    assert {r[0] for r in values} <= {1, 2, 3} and len(values) < 3  # the first listing's price is gone


def test_registered_checks_equal_their_sql():
    assert {"ST6_batch_check", "SNK8_batch_runs", "A7_price_insight_rollup", "SNK1_kept_product_list", "SNK1_kept_rule_matches"} <= set(plans.SQL)


def test_observations_land_in_parallel(spark, monkeypatch):
    landed = []

    class Stop(Exception):
        pass

    class Watch:
        def __init__(self, spark, path, *more):
            self.path = path

        def start(self, observations):
            landed.append(spark.read.parquet(f"{self.path}/landed").inputFiles())
            if len(landed) == 2:
                raise Stop
            return self

        def awaitTermination(self):
            pass

    monkeypatch.setattr(kept_plans, "BatchCheck", Watch)
    t = Tables(spark, SF)
    raw = t.raw
    monkeypatch.setattr(t, "raw", lambda name: raw(name).repartition(4) if name == "lineitem" else raw(name))
    with pytest.raises(Stop):
        kept_plans.checked(t)
    assert len(landed[0]) == 4 and len(landed[1]) == 8


def test_nothing_shuffled_outlives_a_batch(spark, tmp_path):
    def shuffled():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before, check = shuffled(), check_of(spark, str(tmp_path / "check"))
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for i, batch in enumerate(BATCHES[:2]):
        check.run_batch(spark.createDataFrame(batch, OBSERVED), i)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_history_ids_are_not_stored(spark, checked):
    assert "id" not in spark.read.parquet(f"{checked.path}/prices/history").columns
    got = {(r.listing_id, r.checked_at, r.price): r.id for r in checked.history().collect()}
    assert len(got) == 9 and all(i == hashlib.sha256(f"{n}|{at}|{p}".encode()).hexdigest() for (n, at, p), i in got.items())
    assert {r.id for r in checked.history(0).collect()} < set(got.values())


def test_slices_leave_the_rows_of_one_whole(spark, tmp_path, checked, monkeypatch):
    """Each step that shuffles a batch goes slice by slice; a run killed between two of them leaves the same rows too."""
    monkeypatch.setattr(checks, "SLICE_ROWS", 1)
    puts, put = [], checks.put

    class Killed(Exception):
        pass

    def dying(rows, path, batch, *more, **how):
        if path.endswith("/latest"):
            puts.append(batch)
            if len(puts) == 6:
                raise Killed
        put(rows, path, batch, *more, **how)

    monkeypatch.setattr(checks, "put", dying)
    check = check_of(spark, str(tmp_path / "check"))
    check.run_batch(spark.createDataFrame(BATCHES[0], OBSERVED), 0)
    assert puts == [0] * 4
    with pytest.raises(Killed):
        check.run_batch(spark.createDataFrame(BATCHES[1], OBSERVED), 1)
    for i, batch in enumerate(BATCHES[:2]):
        check.run_batch(spark.createDataFrame(batch, OBSERVED), i)
    assert check._read("latest", 1).groupBy("batch", "listing_id").count().where("count > 1").isEmpty()
    for got, want in ((check.alerts(), checked.alerts(1)), (check.runs(), checked.runs().where("batch < 2")), (check.listings(), checked.listings(1)), (check.prices.insight(), checked.prices.insight(1))):
        assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(got.columns)))
    months = [START + dt.timedelta(days=31 * n) for n in range(5)]
    history = spark.createDataFrame([(n % 2, 10.0 + n, at) for n, at in enumerate(months)], "product_id long, price double, checked_at timestamp")
    kept = PriceHistory(spark, str(tmp_path / "prices"))
    kept.append(history, 0, slices=3)
    same_insight(kept, history)
    assert kept._read("days", None).count() == 5
