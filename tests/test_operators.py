import datetime as dt
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shelfspark import plans
from shelfspark.functions import offers
from shelfspark.operators import insight, rules, score, state
from shelfspark.sources.tables import Tables
from shelfspark.streaming import radar

SF = "/root/testdata/sf0.001"


def clean(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat()[:19] if hasattr(v, "isoformat") else v

    return sorted(([one(v) for v in r] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(plans.SQL))
def test_plan_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert clean(tuple(r) for r in got.select(*names).collect()) == clean(want.fetchall())


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.SQL])
def test_other_plans_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    plan = plans.QUERIES["W3_price_drop_radar"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1] and "event_type" not in plan.split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plans.QUERIES["W4_latest_alerts"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_insight_bounds(spark):
    end = dt.datetime(2024, 1, 31)
    rows = [(1, 100.0, end), (1, 90.0, end - dt.timedelta(days=7)), (1, 80.0, end - dt.timedelta(days=7, seconds=1)), (1, 1.0, end - dt.timedelta(days=91)), (1, -5.0, end), (1, 150_001.0, end), (1, None, end), (1, 5.0, None), (2, 200.0, end - dt.timedelta(days=100))]
    got = {r.product_id: r for r in insight.price_insight(spark.createDataFrame(rows, "product_id int, price double, checked_at timestamp"), ["product_id"]).collect()}
    assert (got[1].min_7d, got[1].min_30d, got[1].min_90d, got[1].avg_30d, got[1].data_points, got[1].is_near_lowest) == (90.0, 80.0, 80.0, 90.0, 4, False)
    assert (got[2].min_90d, got[2].data_points, got[2].is_near_lowest) == (None, 1, False)


def scored(spark, **over):
    base = dict(last_price=100.0, last_old_price=None, last_cart_price=None, last_price_source="shelf", last_error=None, last_in_stock=True, sizes=None, has_rule=False, target_price=None, rule_size=None, profile_size=None, profile_use=False, is_near_lowest=False, data_points=0, min_30d=None)
    return score.buy_score(spark.createDataFrame([tuple({**base, **over}.values())], score.INPUT)).first()


def test_score_cases(spark):
    r = scored(spark)
    assert (r.price_score, r.stock_score, r.profile_score, r.trust_score, r.score, r.decision) == (8, 8, 5, 12, 33, "SADECE ÇOK UCUZSA")
    r = scored(spark, last_price=None)
    assert (r.score, r.decision, r.comment) == (0, "BELİRSİZ", "BELİRSİZ (0/100). Güncel fiyat okunamadı")
    r = scored(spark, target_price=100.0, has_rule=True, rule_size="42,5", sizes=[("42.5 ", True), ("43", False)], profile_size="42.5", profile_use=True, is_near_lowest=True, data_points=3, last_old_price=125.0, last_cart_price=100.0, last_price_source="cart_offer")
    assert (r.price_score, r.stock_score, r.profile_score, r.trust_score, r.score, r.decision) == (40, 20, 25, 15, 100, "AL")
    assert len(r.reasons) == 6 and r.reasons[0] == "Hedef fiyatın (100 TL) altında" and r.comment.startswith("AL (100/100). ")
    r = scored(spark, last_error="403", last_in_stock=False)
    assert (r.trust_score, r.decision) == (2, "BELİRSİZ")
    r = scored(spark, target_price=0.0, sizes=[("42", False)], last_price_source="other")
    assert (r.price_score, r.stock_score, r.trust_score) == (8, 0, 4) and "Hiçbir beden stokta görünmüyor" in r.risks


def test_first_size_decides(spark):
    rows = spark.createDataFrame([("42", [("42", False), ("42", True)]), ("42", [("41", True)]), ("42,5", [("42.5", True)]), ("42", [])], "r string, s array<struct<name:string,in_stock:boolean>>")
    assert [x[0] for x in rows.select(rules.first_size_in_stock(F.col("r"), F.col("s"))).collect()] == [False, False, True, False]


def test_tolerance_and_cooldown(spark):
    r = spark.createDataFrame([(1, 1, 100.0, None, True)], "rule_id int, product_id int, target_price double, rule_size int, enabled boolean")
    l = spark.createDataFrame([(1, s, p, True, 42, True) for s, p in enumerate((100.0, 110.0, 110.01, 111.0))], "product_id int, store_id int, price double, in_stock boolean, size int, size_in_stock boolean")
    assert {(x.store_id, x.in_tolerance) for x in rules.rule_matches(r, l).collect()} == {(0, False), (1, True)}
    at = dt.datetime(2024, 1, 2)
    c = spark.createDataFrame([(k, h, at) for k, h in enumerate((0.0, None, 12.0, 24.0))], "k int, cooldown_hours double, as_of timestamp")
    a = spark.createDataFrame([(k, at - dt.timedelta(hours=13)) for k in range(4)], "k int, created_at timestamp")
    assert {x.k for x in rules.outside_cooldown(c, a, ["k"]).collect()} == {2}


def test_state_changes(spark):
    base = spark.createDataFrame([(1, "a", None), (2, None, 5.0)], "id int, title string, price double")
    assert {tuple(r) for r in state.patch(base, spark.createDataFrame([(2, "b", None)], "id int, title string, price double"), "id").collect()} == {(1, "a", None), (2, "b", 5.0)}
    now = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame([(1, "kept", 1.0, None), (2, "", 2.0, None)], "id int, title string, price double, at timestamp")
    seen = spark.createDataFrame([(i, now, f"new{i}", 9.0) for i in (1, 2, 3)], "id int, at timestamp, title string, price double")
    got = {r.id: (r.title, r.price) for r in state.upsert_latest(current, seen, "id", "at", ("title",)).collect()}
    assert got == {1: ("kept", 9.0), 2: ("new2", 9.0), 3: ("new3", 9.0)}
    empty = spark.createDataFrame([], "id string, shoe_size string")
    assert tuple(state.with_defaults(empty, {"id": "main", "shoe_size": "42"}).first()) == ("main", "42")
    off = state.outbox(spark.range(1), F.lit(False), F.lit("t"), F.lit("c")).first()
    assert (off.sent, off.reason) == (False, "telegram_kapali")


def test_streams_equal_batches(spark, tmp_path):
    t = Tables(spark, SF)
    want = {(r.tick_id, r.drop_pct) for r in insight.price_drops(t.ticks(), "listing_id", ["checked_at", "tick_id"]).collect()}
    parts = str(tmp_path / "events.parquet")
    events = t.raw("events")
    for low, high in ((0, 300), (300, 301), (301, 700), (700, 10_000)):  # in time order, file by file
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(parts)
        time.sleep(1.1)  # files are taken by their time, to the second
    stream = radar.source(spark, str(tmp_path), "events", files=1)
    got = radar.run_available(radar.drop_alerts(radar.as_ticks(stream)), str(tmp_path / "state"), str(tmp_path / "out"))
    assert {(r.tick_id, r.drop_pct) for r in got.collect()} == want


def test_cooldown_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=h), 4, "purchase", 1.0, '{"k": 5}') for i, h in enumerate((0, 23, 24, 25, 47, 48, 100))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = radar.run_available(radar.cooled_alerts(radar.as_alerts(radar.source(spark, str(tmp_path), "events"))), str(tmp_path / "state"), str(tmp_path / "out"))
    assert sorted(r.alert_id for r in got.collect()) == [0, 2, 5, 6]


SIZES = "array<struct<name:string,size:string,in_stock:boolean>>"


@pytest.mark.parametrize(
    ("rule", "listing", "want"),
    [
        ((5000.0, None, False), (5400.0, [("42", "42", True)], True), ("🎯 HEDEFE YAKLAŞTI: P", "Herhangi bir beden")),
        ((5000.0, None, False), (5500.01, [("42", "42", True)], True), None),
        ((5000.0, "44", False), (4000.0, [("44", "44", False)], True), None),
        ((5000.0, "42.5", False), (4000.0, [("42,5", "x", True)], True), ("✅ HEDEF YAKALANDI: P", "42,5")),
        ((5000.0, None, False), (4000.0, [("42", "42", False)], True), None),
        ((5000.0, "-", False), (4000.0, [], True), ("✅ HEDEF YAKALANDI: P", "Beden bilgisi yok")),
        ((5000.0, None, False), (4000.0, None, False), None),
        ((None, None, False), (4000.0, None, True), None),
        ((5000.0, "43", False), (4000.0, [("43", "43", False), ("43", "43", True)], True), None),
    ],
)
def test_rule_cases(spark, rule, listing, want):
    rules_of = spark.createDataFrame([("r", "p", *rule, 24.0, True)], "id string, product_id string, target_price double, size string, spectrum_mode boolean, cooldown_hours double, enabled boolean")
    products = spark.createDataFrame([("p", "P", None, True)], "id string, name string, family_key string, active boolean")
    listings = spark.createDataFrame([("l", "p", listing[0], 1.0, listing[1], listing[2], True)], f"id string, product_id string, last_price double, last_cart_price double, last_sizes {SIZES}, last_in_stock boolean, active boolean")
    got = [(r.title, r["size"]) for r in rules.evaluate_rules(rules_of, products, listings).collect()]
    assert got == ([want] if want else [])


def test_spectrum_rules(spark):
    rules_of = spark.createDataFrame([("wide", "p1", 5000.0, None, True, 24.0, True), ("alone", "p4", 5000.0, None, True, 24.0, True)], "id string, product_id string, target_price double, size string, spectrum_mode boolean, cooldown_hours double, enabled boolean")
    products = spark.createDataFrame([("p1", "One", "f", True), ("p2", "Two", "f", True), ("p3", "Off", "f", False), ("p4", "Four", None, True)], "id string, name string, family_key string, active boolean")
    rows = [("a", "p1", 4500.0), ("b", "p2", 4300.0), ("c", "p2", 4300.0), ("d", "p3", 100.0), ("e", "p4", 4900.0), ("f", "p4", 4800.0)]
    listings = spark.createDataFrame([(i, p, v, None, None, True, True) for i, p, v in rows], f"id string, product_id string, last_price double, last_cart_price double, last_sizes {SIZES}, last_in_stock boolean, active boolean")
    got = {r.rule_id: (r.product_id, r.listing_id, r.product_name, r.price) for r in rules.evaluate_rules(rules_of, products, listings).collect()}
    assert got == {"wide": ("p1", "b", "Two", 4300.0), "alone": ("p4", "f", "Four", 4800.0)}


def test_manual_prices_and_history(spark):
    at = dt.datetime(2024, 1, 1)
    listings = spark.createDataFrame([("a", "p", 10.0, "shelf", 0.9, None), ("b", "p", 20.0, "shelf", 0.9, None)], "id string, product_id string, last_price double, last_price_source string, last_confidence double, last_checked_at timestamp")
    put, history = state.manual_prices(listings, spark.createDataFrame([("a", 5.0, at), ("b", 0.0, at)], "id string, price double, at timestamp"))
    assert {r.id: (r.last_price, r.last_price_source) for r in put.collect()} == {"a": (5.0, "manual"), "b": (20.0, "shelf")}
    assert [(r.listing_id, r.price, r.price_source) for r in history.collect()] == [("a", 5.0, "manual")]
    checked = spark.createDataFrame([("a", "p", 5.0, at), ("b", "p", None, at)], "listing_id string, product_id string, current_price double, checked_at timestamp").select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("old_price", "double"), ("cart_price", "double"), ("price_source", "string"), ("confidence", "double"), ("stock_count", "int"))])
    assert [r.listing_id for r in state.history_rows(checked).collect()] == ["a"]


def test_only_alerts_before_a_candidate_suppress_it(spark):
    at = dt.datetime(2024, 1, 10, 12)
    hour = dt.timedelta(hours=1)
    alerts = {"after": [19 * 24], "before": [-11.9], "both": [-13, 5], "same": [0], "days": [-40], "null": [-1], "none": []}
    c = spark.createDataFrame([(k if k != "null" else None, 36.0 if k == "days" else 12.0, at, "x") for k in alerts], "k string, cooldown_hours double, as_of timestamp, _day string")
    a = spark.createDataFrame([(k if k != "null" else None, at + h * hour) for k, hours in alerts.items() for h in hours] + [("none", None)], "k string, created_at timestamp")
    assert {x.k for x in rules.outside_cooldown(c, a, ["k"]).collect()} == {"after", "both", "days", None, "none"}
    late = c.withColumn("cooldown_hours", F.lit(48.0))
    assert {x.k for x in rules.outside_cooldown(late, a, ["k"]).collect()} == {"after", None, "none"}


def test_cooldown_equals_a_plain_search(spark):
    t = Tables(spark, SF)
    rows, alerts = t.candidates().collect(), [(a.rule_id, a.listing_id, a.created_at) for a in t.alerts().collect()]
    want = set()
    for r in rows:
        before = [x for u, l, x in alerts if (u, l) == (r.rule_id, r.listing_id) and x <= r.as_of]
        if not before or (r.as_of - max(before)).total_seconds() >= (r.cooldown_hours or 24) * 3600:
            want.add(r.candidate_id)
    assert {r.candidate_id for r in rules.outside_cooldown(t.candidates(), t.alerts(), ["rule_id", "listing_id"]).collect()} == want


def test_settings_over_defaults(spark):
    saved = ['{"a":{"x":2,"other":1},"b":"t"}', '{"a":{"x":"no","y":null},"b":null}', '{"a":5}', "[1]", "{", "", None]
    got = state.read_settings(spark.createDataFrame(list(enumerate(saved)), "i int, raw string"), "raw", "i", {"a": {"x": 1, "y": True}, "b": "d"})
    assert {r.i: (r.a.x, r.a.y, r.b) for r in got.collect()} == {0: (2, True, "t"), **{i: (1, True, "d") for i in range(1, 7)}}


def test_backfill_leaves_what_is_set(spark):
    given = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "k", "n"), (4, None, None)], "i int, k string, name string")
    assert {r.i: r.k for r in state.backfill(given, "k", F.col("name")).collect()} == {1: "n", 2: "n", 3: "k", 4: None}


def test_legacy_rules(spark):
    sizes = "array<struct<name:string,size:string,in_stock:boolean>>"
    offers = [(1, 1, 100.0, None, False, True), (2, 1, 100.5, None, True, True), (3, 1, 90.0, [("42,5", None, False), ("42.5", None, True)], True, True), (4, 1, 90.0, [("42,5", None, True)], True, True), (5, 1, None, None, True, True), (6, 1, 1.0, None, True, False), (7, 1, 80.0, [], None, True), (8, 1, 80.0, [("41", None, None)], True, True)]
    listings = spark.createDataFrame(offers, f"id int, product_id int, last_price double, last_sizes {sizes}, last_in_stock boolean, active boolean")
    asked = spark.createDataFrame([(1, 1, 100.0, None, True), (2, 1, 100.0, "-", True), (3, 1, 100.0, " 42.5", True), (4, 1, None, None, True), (5, 1, 100.0, None, False)], "id int, product_id int, target_price double, size string, enabled boolean")
    got = {(r.rule_id, r.listing_id): r.size for r in rules.legacy_matches(asked, listings).collect()}
    any_size = {1: "Beden Bilgisi Yok", 3: "Herhangi Bir Beden", 4: "Herhangi Bir Beden", 7: "Beden Bilgisi Yok"}
    assert got == {**{(r, i): s for r in (1, 2) for i, s in any_size.items()}, (3, 4): "42,5"}


def test_own_offers_know_their_fields():
    assert offers.own_offer(title="t")["title"] == "t" and offers.own_offer()["sizes"] == []
    with pytest.raises(ValueError, match="colour"):
        offers.own_offer(colour="red")


def test_delete_all_alerts(spark):
    alerts = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 20), (4, None, 5), (5, "a", None), (6, "c", 1), (6, "c", 1)], "alert_id long, user string, created_at long")
    resets = spark.createDataFrame([("a", 10), ("a", 5), ("b", 20), (None, 99), ("c", None)], "user string, created_at long")
    left = lambda *a, **k: sorted(r.alert_id for r in state.delete_all(*a, **k).collect())
    assert left(alerts, resets, owner="user") == [2, 4, 6, 6]
    assert left(alerts, resets.where("created_at < 20")) == [2, 3]
    assert left(alerts, resets.limit(0)) == left(alerts, resets.limit(0), owner="user") == [1, 2, 3, 4, 5, 6, 6]
