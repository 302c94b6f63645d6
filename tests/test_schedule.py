"""A scheduled stream follows its settings and comes back after a failure."""

import datetime as dt
import time

from shelfspark.streaming.schedule import Schedule, interval


def until(true, seconds=60):
    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.1)


def save(spark, path, *settings):
    spark.createDataFrame([(on, minutes, dt.datetime(2024, 1, day)) for on, minutes, day in settings], "enabled boolean, interval_minutes int, saved_at timestamp").coalesce(1).write.mode("append").parquet(path)


def test_interval():
    assert [interval(m) for m in (None, 0, -5, 1, 45)] == [30, 30, 1, 1, 45]


def test_settings_are_followed(spark, tmp_path):
    seen, landed, asked = [], str(tmp_path / "in"), str(tmp_path / "settings")
    spark.range(10).write.parquet(landed)
    save(spark, asked, (True, 30, 1))

    def start(every):
        seen.append(every)
        stream = spark.readStream.schema("id long").parquet(landed)
        return stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime=every).start(str(tmp_path / "out"))

    rows = lambda: spark.read.schema("id long").parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() else 0
    schedule = Schedule(spark, start)
    following = schedule.follow(spark.readStream.schema("enabled boolean, interval_minutes int, saved_at timestamp").parquet(asked), str(tmp_path / "s"))
    try:
        until(lambda: rows() == 10 and schedule.status()["last_run_at"])
        assert seen == ["30 minutes"] and schedule.status()["running"]
        spark.range(10, 15).write.mode("append").parquet(landed)
        save(spark, asked, (False, 9, 2), (True, 0, 4), (True, 5, 3))  # the latest has no interval: 30 minutes, as before
        following.processAllAvailable()
        save(spark, asked, (True, -2, 5))
        until(lambda: seen == ["30 minutes", "1 minutes"] and rows() == 15)  # nothing is read twice
        save(spark, asked, (False, 7, 4))  # older than what counts
        following.processAllAvailable()
        time.sleep(1)
        assert schedule.status()["running"] and schedule.status()["interval_minutes"] == 1
        save(spark, asked, (False, 1, 6))
        until(lambda: not schedule.status()["running"])
        save(spark, asked, (True, 1, 7))
        until(lambda: schedule.status()["running"])
        assert len(seen) == 3
    finally:
        following.stop()
        schedule.close()
    assert not schedule.status()["running"]


def test_a_failed_query_is_started_again(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    tries, got = [], []

    def check(rows, batch):
        tries.append(batch)
        if len(tries) == 1:
            raise ValueError("lost")
        got.extend(r.id for r in rows.collect())

    def start(every):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(check).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime=every).start()

    schedule = Schedule(spark, start, wait=lambda minutes: minutes / 60)
    try:
        schedule.apply(True, 1)
        until(lambda: len(got) == 4)
        assert tries == [0, 0] and schedule.status()["starts"] == 2
    finally:
        schedule.close()
