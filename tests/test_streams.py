"""Streams keep their keys in a bounded number of buckets."""

import datetime as dt

from shelfspark.streaming import radar

START = dt.datetime(2024, 1, 1)


def _in_parts(spark, tmp_path, rows, schema, parts, stream_of):
    """What a stream gives over files that come one after the other, each from the last one's checkpoint."""
    step, found = -(-len(rows) // parts), None
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = radar.run_available(stream_of(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "state"), str(tmp_path / "out"))
    return found.collect()


def _buckets(spark, tmp_path):
    return spark.read.format("statestore").option("stateVarName", "value").load(str(tmp_path / "state")).count()


def test_cooldowns_of_many_keys_in_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(radar, "BUCKETS", 3)
    rows = [(i, None if i % 40 == 7 else i * 7 % 40, i % 3 or None, START + dt.timedelta(hours=i // 20), (i * 7 % 40 % 4 * 12.0) or None) for i in range(2000)]
    got = _in_parts(spark, tmp_path, rows, "alert_id long, rule_id long, listing_id int, created_at timestamp, cooldown_hours double", 3, radar.cooled_alerts)
    want, last = set(), {}
    for alert, rule, listing, at, wait in rows:
        key = rule, listing
        if key not in last or at - last[key] >= dt.timedelta(hours=wait or 24):
            last[key] = at
            want.add((rule, listing, alert))
    assert len(got) == len(want) and {(r.rule_id, r.listing_id, r.alert_id) for r in got} == want
    assert 120 >= len(last) > 100 and _buckets(spark, tmp_path) <= 3


def test_drops_of_many_keys_in_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(radar, "BUCKETS", 3)
    rows = [(i, i % 50 or None, None if i % 37 == 5 else 100.0 + i * i % 89, START + dt.timedelta(hours=i // 10)) for i in range(1500)]
    got = _in_parts(spark, tmp_path, rows, "tick_id long, listing_id long, price double, checked_at timestamp", 3, radar.drop_alerts)
    want, last = set(), {}
    for tick, listing, price, _ in rows:
        before = last.get(listing)
        if price is not None and before is not None and price < before * 0.97:
            want.add((listing, tick, price, before))
        last[listing] = price
    assert len(got) == len(want) and {(r.listing_id, r.tick_id, r.price, r.previous_price) for r in got} == want
    assert len(last) == 50 and _buckets(spark, tmp_path) <= 3
