"""Price radar and alert cooldown over streams of observations.

Both keep a few numbers for each key in the RocksDB state store, order a micro-batch by (instant, id) within the key, of
which they hold a few numbers a row, and give over a whole stream what the batch operators give over the whole table, as
long as files come in the order of time. Keys are dealt to buckets, whose values are read, judged and written at once, so
that the cost of a call into Python is a bucket's and not a key's; a micro-batch writes the live keys of the buckets that
it touches. A timer at the instant at which a key's value stops to matter takes it away, once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.kept import new_folder

DROP = "listing_id long, tick_id long, price double, previous_price double, drop_pct double"
FIRED = "rule_id long, listing_id int, alert_id long"
#: Where streams keep the state of their keys.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_US = 86_400_000_000
#: Into how many buckets keys are dealt; a prime, so that numbers with a common step are spread, too.
BUCKETS = 1021


class _Expiring(StatefulProcessor):
    """A bucket's keys, each with its values and the instant (ms) after which they stop to matter, as arrays in one state value; the timer is that of the first to end.

    Rows of a bucket come as arrays, in order within each key, with the key's values so far before them.
    """

    #: Columns of a row that make its key (with `nulls`, a bit for each key that is null), numbers of a row, and what is kept of a key.
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = ", ".join(f"{c} array<long>" for c in (*self.keys, "nulls", "until_ms"))
        self.state = handle.getValueState("value", f"timer_ms long, {longs}, {', '.join(f'{k} array<{t}>' for k, t in (c.split() for c in self.kept))}")

    def known(self) -> tuple[int | None, list[np.ndarray]]:
        """The timer, and arrays of keys, ends and values."""
        types = [np.int64] * (len(self.keys) + 2) + [np.float64 if c.endswith("double") else np.int64 for c in self.kept]
        old = self.state.get() if self.state.exists() else None
        return (None, [np.empty(0, t) for t in types]) if old is None else (old[0], [np.array(c, t) for c, t in zip(old[1:], types, strict=True)])

    def put(self, timer: int | None, arrays: list[np.ndarray], live: np.ndarray) -> None:
        """Keeps the keys that are live, and moves the timer to the first of their ends."""
        arrays = [c[live] for c in arrays]
        ends = arrays[len(self.keys) + 1]
        first = int(ends.min()) if len(ends) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.state.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.state.update((first, *[c.tolist() for c in arrays]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [[part[c].to_numpy() for c in (*self.keys, "nulls", "at_us", *self.columns)] for part in rows]
        fresh = [np.concatenate(c) for c in zip(*parts, strict=True)]
        (timer, old), n, width = self.known(), len(fresh[0]), len(self.keys) + 1
        known = len(old[0])
        seen, values = np.arange(known + n) < known, old[width + 1 :]
        whole = [np.concatenate(c) for c in zip(old[:width], fresh[:width], strict=True)]
        at = np.concatenate([np.zeros(known, np.int64), fresh[width]])
        number = np.concatenate([np.zeros(known, fresh[width + 1].dtype), fresh[width + 1]])
        order = np.lexsort((number, at, ~seen, *whole))
        whole, seen = [c[order] for c in whole], seen[order]
        starts = np.ones(known + n, bool)
        starts[1:] = np.any([c[1:] != c[:-1] for c in whole], axis=0)
        others = [np.concatenate([np.full(known, np.nan), c.astype(np.float64)])[order] for c in fresh[width + 2 :]]
        before = [np.concatenate([v, np.zeros(n, v.dtype)])[order] for v in values]
        fired, after, until_us = self.judge(starts, seen, at[order], others, before)
        ends = np.append(np.flatnonzero(starts)[1:], known + n) - 1
        untouched, now = seen[ends], timerValues.getCurrentWatermarkInMs()
        until = np.concatenate([old[width], np.zeros(n, np.int64)])[order][ends]
        until = np.where(untouched, until, np.maximum(until_us[ends] // 1000, now) + 1)
        # what ended at or before this batch's watermark would go at its end in any case
        self.put(timer, [*[c[ends] for c in whole], until, *[c[ends] for c in after]], until >= now)
        if len(fired[0]):
            chosen = fired[0]
            named = {k: pd.array(whole[i][chosen], "Int64") for i, k in enumerate(self.keys)}
            for i, k in enumerate(self.keys):
                named[k][(whole[-1][chosen] >> i & 1).astype(bool)] = pd.NA
            yield pd.DataFrame(named | self.told(number[order][chosen], *fired[1:]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, arrays = self.known()
        until = arrays[len(self.keys) + 1]
        self.put(None, arrays, (until > expiredTimerInfo.getExpiryTimeInMs()) & (until >= timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def judge(self, starts: np.ndarray, seen: np.ndarray, at: np.ndarray, columns: list[np.ndarray], before: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(places of the rows that fire and what is said of them), (values after each row), (instant until which these matter); `starts` marks a key's first row, `seen` one that stands for its values so far."""
        raise NotImplementedError

    def told(self, numbers: np.ndarray, *said: np.ndarray) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Drops(_Expiring):
    keys, columns, kept = ("listing_id",), ("tick_id", "price"), ("price double", "at_us long")

    def __init__(self, least: float, most: float, keep_days: int) -> None:
        self.least, self.most, self.keep_us = least, most, keep_days * _DAY_US

    def judge(self, starts: np.ndarray, seen: np.ndarray, at: np.ndarray, columns: list[np.ndarray], before: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        prices, at = np.where(seen, before[0], columns[0]), np.where(seen, before[1], at)
        last, since = np.full(len(prices), np.nan), np.zeros(len(prices), np.int64)
        last[1:], since[1:] = np.where(starts[1:], np.nan, prices[:-1]), np.where(starts[1:], 0, at[1:] - at[:-1])
        fell = np.flatnonzero((last >= self.least) & (last <= self.most) & (last <= prices * 5) & (prices < last * 0.97) & (since <= self.keep_us))
        drop = np.rint((last - prices)[fell] / last[fell] * 100)
        return [fell, prices[fell], last[fell], drop], [prices, at], at + self.keep_us

    def told(self, numbers: np.ndarray, *said: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(("tick_id", "price", "previous_price", "drop_pct"), (numbers, *said), strict=True))


class _Cooled(_Expiring):
    keys, columns, kept = ("rule_id", "listing_id"), ("alert_id", "wait_hours"), ("last_us long", "longest double")

    def judge(self, starts: np.ndarray, seen: np.ndarray, at: np.ndarray, columns: list[np.ndarray], before: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        lasts, longests, fired = before[0].tolist(), before[1].tolist(), []
        last, longest = None, 0.0
        for i, (first, old, now, wait) in enumerate(zip(starts.tolist(), seen.tolist(), at.tolist(), columns[0].tolist(), strict=True)):
            if first:
                last, longest = None, 0.0
            if old:
                last, longest = lasts[i], longests[i]
                continue
            longest = max(longest, wait)
            if last is None or now - last >= wait * 3_600_000_000:
                last = now
                fired.append(i)
            lasts[i], longests[i] = last, longest
        after = [np.array(lasts, np.int64), np.array(longests, np.float64)]
        return [np.array(fired, np.int64)], after, after[0] + (after[1] * 3_600_000_000).astype(np.int64)

    def told(self, numbers: np.ndarray, *said: np.ndarray) -> dict[str, np.ndarray]:
        return {"alert_id": numbers}


def _bucketed(rows: DataFrame, of: _Expiring, instant: str, late: str) -> GroupedData:
    """Rows by their keys' bucket, with what the processor reads of them; a single number is its own hash."""
    key = F.xxhash64(*of.keys) if len(of.keys) > 1 else F.coalesce(F.col(of.keys[0]).cast("long"), F.lit(0))
    nulls = reduce(Column.__add__, [F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(of.keys)])
    at = F.coalesce(F.unix_micros(F.col(instant)), F.lit(np.iinfo(np.int64).min // 2))
    put_in = rows.withWatermark(instant, late).select(F.pmod(key, F.lit(BUCKETS)).alias("bucket"), *[F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in of.keys], nulls.alias("nulls"), at.alias("at_us"), *of.columns, instant)
    return put_in.groupBy("bucket")


def drop_alerts(ticks: DataFrame, least: float = 50.0, most: float = 200_000.0, keep_days: int = 365, late: str = "1 hour") -> DataFrame:
    """Ticks at least 3 % below the listing's last one, which must be plausible and at most `keep_days` old; a listing's last price goes when it is older than that.

    Ticks that come later than `late` after the latest one count for nothing.
    """
    drops, timed = _Drops(least, most, keep_days), ticks.withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    return _bucketed(timed, drops, "checked_at", late).transformWithStateInPandas(drops, DROP, "Append", "EventTime")


def cooled_alerts(alerts: DataFrame, hours: float = 24.0, late: str = "1 hour") -> DataFrame:
    """Alerts of (rule, listing) that come at least their cooldown after the last one that was let through, which is state.

    The cooldown is the alert's own cooldown_hours where there is such a column and it is neither 0 nor null, else
    `hours`; the state of a key ends with the longest cooldown that it has seen, once the watermark, `late` behind the
    latest alert, is past it.
    """
    own = F.coalesce(F.nullif(F.col("cooldown_hours"), F.lit(0.0)), F.lit(hours)) if "cooldown_hours" in alerts.columns else F.lit(hours)
    cooled, timed = _Cooled(), alerts.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("wait_hours", own)
    return _bucketed(timed, cooled, "created_at", late).transformWithStateInPandas(cooled, FIRED, "Append", "EventTime")


def new_folders(spark: SparkSession) -> tuple[str, str]:
    """A new checkpoint folder and a new output folder, in the folder that the cluster shares."""
    run = new_folder(spark, "stream")
    return f"{run}/state", f"{run}/out"


def run_available(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Runs a stream over all that is there, to Parquet files under `out`, and returns them."""
    start(stream, checkpoint, out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def start(stream: DataFrame, checkpoint: str, out: str, every: str | None = None) -> StreamingQuery:
    """Starts a stream to Parquet files under `out`: over all that is there, or again and again at an interval such as "30 minutes"."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def source(spark: SparkSession, sf_dir: str, name: str, files: int = 1000) -> DataFrame:
    """A table as a stream of its files, oldest first and `files` at a time: those of its folder, or the one file, watched in the folder that holds it."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet" if single else "*.parquet").option("maxFilesPerTrigger", files)
    return reader.parquet(sf_dir if single else path)


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("tick_id"), F.col("user_id").alias("listing_id"), F.col("value").alias("price"), F.col("ts").alias("checked_at"))


def as_alerts(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("rule_id"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("listing_id"), F.col("ts").alias("created_at"), (F.col("user_id") % 4 * 12).cast("double").alias("cooldown_hours"))
