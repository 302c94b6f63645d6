"""Tables that are kept between runs: price history by month and batch with mergeable partials, and views bucketed by product.

Every write replaces the partitions of its own batch and no others, so a batch that is run again leaves the same rows.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import insight
from .tables import Tables

#: Buckets of the views by product; as many tasks read them without an exchange.
BUCKETS = 8


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; a temporary one is for local masters only."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shelfspark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled goes from the executors' disks when the query ends, not when the driver happens to collect its garbage.

    A query that needs such files again, as none here does, makes them again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def put(rows: DataFrame, path: str, batch: int, by: tuple[str, ...] = (), deal: bool = True, add: bool = False) -> None:
    """Writes a batch's rows under `path`, in place of those that the same batch wrote before, or beside them with `add`; `deal`: of the columns `by` a batch has several values."""
    dealt = rows.hint("rebalance", *by) if by and deal else rows  # one file or a few for each partition, a large one split
    dealt.withColumn("batch", F.lit(batch).cast("long")).write.mode("append" if add else "overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by, "batch").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


class PriceHistory:
    """Price history under a folder: rows by (month, batch), a partial for each product and day, and one for each product.

    Trailing windows are merged from the partials of the days in them; only a day that a window's bound cuts in two is
    read by rows. Partials of a new batch are made from its own rows alone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, upto: int | None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def history(self, upto: int | None = None) -> DataFrame:
        return self._read("history", upto)

    def append(self, rows: DataFrame, batch: int, slices: int = 1) -> None:
        """Adds a batch's rows(product_id, price, checked_at, ...), whose own partials follow; those of days in so many slices of the months, one after the other."""
        put(rows.withColumn("month", _month(F.col("checked_at"))), f"{self.path}/history", batch, ("month",))
        own = insight.clean_history(self.history().where(F.col("batch") == batch))
        at = insight.micros("checked_at")
        days = own.groupBy("product_id", "month", F.to_date("checked_at").alias("day")).agg(
            F.min("price").alias("low"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"), F.count("*").alias("n"), F.min(F.struct((-at).alias("back"), "price")).alias("last"),
        )
        months = sorted(r["month"] for r in own.select("month").distinct().collect()) if slices > 1 else []
        for of in [months[i::slices] for i in range(min(slices, len(months)))] or [None]:
            put(days if of is None else days.where(F.col("month").isin(of)), f"{self.path}/days", batch, ("month",))
        merged = self._read("days", None).where(F.col("batch") == batch).groupBy("product_id").agg(F.sum("n").alias("n"), F.min("last").alias("last"))
        put(merged, f"{self.path}/totals", batch)

    def insight(self, upto: int | None = None) -> DataFrame:
        """What :func:`insight.price_insight` gives over the whole history by product_id, from partials."""
        totals = self._read("totals", upto)
        newest = totals.agg(-F.min("last.back")).first()[0]
        if newest is None:
            return insight.price_insight(self.history(upto), ["product_id"])
        bounds = {d: newest - d * 86_400_000_000 for d in insight.WINDOWS}
        instant = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
        start = F.unix_micros(F.col("day").cast("timestamp"))
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "GMT"):  # days begin elsewhere: the bound's day is looked at by rows wherever it begins
            cut_days = {d: True for d in bounds}
        else:
            cut_days = {d: us % 86_400_000_000 != 0 for d, us in bounds.items()}
        first = instant(min(bounds.values())) - dt.timedelta(days=1)
        months = F.col("month") >= first.year * 12 + first.month
        inside = [F.when(start >= us, True).otherwise(False).alias(f"_{d}") for d, us in bounds.items()]
        parts = self._read("days", upto).where(months).select("product_id", "low", "cents", "n", *inside)
        if any(cut_days.values()):
            near = self.history(upto).where(months)
            at = insight.micros("checked_at")
            day_start = F.unix_micros(F.to_date("checked_at").cast("timestamp"))
            cut = [((at >= us) & (day_start < us)).alias(f"_{d}") for d, us in bounds.items()]
            edge = insight.clean_history(near).select("product_id", F.col("price").alias("low"), F.round(F.col("price") * 100).cast("long").alias("cents"), F.lit(1).cast("long").alias("n"), *cut)
            parts = parts.unionByName(edge.where(" or ".join(f"_{d}" for d in bounds)))
        windows = parts.groupBy("product_id").agg(
            *[F.min(F.when(F.col(f"_{d}"), F.col("low"))).alias(f"min_{d}d") for d in bounds], F.sum(F.when(F.col("_30"), F.col("cents"))).alias("_cents"), F.sum(F.when(F.col("_30"), F.col("n"))).alias("_n"),
        )
        known = totals.groupBy("product_id").agg(F.sum("n").alias("data_points"), F.min("last").alias("_l")).join(windows, "product_id", "left")
        out = known.select("product_id", *[f"min_{d}d" for d in bounds], (F.floor(F.col("_cents") / F.col("_n") + 0.5) / 100).alias("avg_30d"), "data_points", F.col("_l.price").alias("last_price"))
        return out.withColumn("is_near_lowest", insight.near_lowest())


class ProductTables(Tables):
    """The views of a folder with products, rules and listings kept as tables in buckets by product: joins and groups by it need no exchange.

    The tables are written when first asked for, and hold as long as this object is used.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, sf_dir)
        self.buckets, self._kept = buckets, {}

    def _bucketed(self, name: str, rows: DataFrame) -> DataFrame:
        if name not in self._kept:
            known = f"kept_{name}_{uuid.uuid4().hex}"
            path = new_folder(self.spark, name)
            rows.repartition(self.buckets, "product_id").write.bucketBy(self.buckets, "product_id").sortBy("product_id").option("path", path).saveAsTable(known)
            self._kept[name] = known
        return self.spark.table(self._kept[name])

    def products(self) -> DataFrame:
        return self._bucketed("products", super().products())

    def rules(self) -> DataFrame:
        return self._bucketed("rules", super().rules())

    def listings(self) -> DataFrame:
        return self._bucketed("listings", super().listings())
