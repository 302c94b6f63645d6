"""Helpers that the corpus operators share: shared folders, size-checked broadcasts, scalable running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a hinted broadcast may have at most; beyond it the callers shuffle or work in blocks.
BROADCAST_ROWS = 500_000
#: A key with more than one in HOT of all rows is joined by a broadcast; there are fewer than HOT such keys at any size.
HOT = 1024
#: Rows that one task orders at most in :func:`running_total`, on average.
BUCKET_ROWS = 4096
#: Bits for each key in the bitmaps of :func:`flagged`, and their bits at most (64 MB); with more than 2^25 keys more rows pass that need not.
KEY_BITS, MOST_BITS = 16, 1 << 29

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset on a local master; elsewhere that is an error."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shelfspark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it has at most `most` rows (BROADCAST_ROWS by default; counted, up to most + 1), else as it is; and which of them."""
    most = BROADCAST_ROWS if most is None else most
    fits = df.limit(most + 1).count() <= most
    return (F.broadcast(df) if fits else df), fits


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new folder of the shared ones and read from there: without lineage, and by columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flagged(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows with `_maybe`: false only where the 64-bit `key` is not among those of keys(k), else true, and true for about one row in KEY_BITS that needs not be.

    A bitmap of the keys' hashes is broadcast, whose size is bounded at any number of keys, so that rows without a partner
    need no shuffle to learn that.
    """
    bits = min(MOST_BITS, 1 << max(15, (keys.count() * KEY_BITS).bit_length()))
    slot = lambda k: F.pmod(k, F.lit(bits)) + 1
    at = keys.where("k is not null").select(slot(F.col("k")).alias("_s"))
    maps = at.groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_map"))
    given = rows.withColumn("_s", slot(key)).withColumns({"_bucket": F.bitmap_bucket_number("_s"), "_bit": F.bitmap_bit_position("_s")})
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return given.join(F.broadcast(maps), "_bucket", "left").select(*rows.columns, is_set.alias("_maybe"))


def without(rows: DataFrame, gone: DataFrame, same: Column, key: Column, gone_key: Column) -> DataFrame:
    """rows without a partner in gone by `same`, which partners have an equal `key` and `gone_key`. gone is read more than once.

    gone is broadcast if it is small; else only rows whose key is flagged are shuffled to meet it.
    """
    side, fits = small(gone)
    if fits:
        return rows.join(side, same, "left_anti")
    given = flagged(rows, key, gone.select(gone_key.alias("k")))
    met = given.where("_maybe").drop("_maybe").join(side, same, "left_anti")
    return given.where("not _maybe").drop("_maybe").unionByName(met)


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with side(keys, n, ...), whose keys are unique and whose `n` tells how many of rows have them; n goes.

    Keys that hold more than one in HOT of all rows meet theirs in a broadcast of fewer than HOT rows, so that no
    key fills a task; the others are joined by a shuffle. `total`, the sum of n, is counted where it is not given; up to
    BROADCAST_ROWS, which side cannot have more rows than, all of side is broadcast.
    """
    if total is None:
        total = side.agg(F.sum(n)).first()[0] or 0
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.drop(n)), keys).select(*rows.columns, *[c for c in side.columns if c not in (n, *keys)])
    heavy, others = F.col(n) * HOT > total, [c for c in side.columns if c not in (n, *keys)]
    names = [*rows.columns, *others]
    hot, rest = side.where(heavy).select(*keys, *others, F.lit(True).alias("_hot")), side.where(~heavy).drop(n)
    met = rows.join(F.broadcast(hot), keys, "left")
    fresh = met.where("_hot is null").select(*rows.columns)
    return met.where("_hot").select(*names).unionByName(fresh.join(rest, keys).select(*names))


def word_list(text) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def running_total(df: DataFrame, part: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` up to and with each row, in the order (bucket, *order) within `part`.

    Two levels: totals of the buckets are summed first, then each bucket is ordered by itself, so that a
    part that holds most rows is spread over as many tasks as it has buckets. df is read twice.
    """
    keys = [*part, bucket]
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.sum(value).alias("_t")).select(*keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, keys).withColumn(out, F.col("_o") + F.sum(value).over(within)).drop("_o")
