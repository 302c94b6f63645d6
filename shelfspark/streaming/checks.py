"""The batch check as a stream: observations of listings become history, latest state, alerts and a run report, batch by batch.

A micro-batch is one run. Its outputs are written one after the other, and the run's report last: a batch counts once its
report is there, and readers see only batches that count. Every output is a partition of its batch, read back by later
steps and written over if the batch is run again, and what a batch reads of the past are batches before it: so a run
that is killed anywhere and started again leaves the rows of one that was not.

Of each listing the newest observation without an error gives its state; an error is remembered beside it, and a page
that is gone takes the listing out of stock. A product's rules are looked at if any of its listings, or of its family's
for spectrum rules, was observed in the batch. Alerts within a rule's cooldown of an earlier one are not made. The time
of a batch is the latest instant in it, never the clock.

What a batch leaves on disk is these outputs alone: shuffled rows go with the step that shuffled them, and ids of the
history are made as it is read. Steps that shuffle whole observations or the whole state do so slice by slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules as engine
from ..operators import score, state
from ..sources.kept import PriceHistory, exists, put, shuffles_removed

#: Columns of an observation, beside `tie`, any column that orders observations of one listing and instant.
OBSERVED = ("listing_id", "product_id", "price", "old_price", "cart_price", "price_source", "sizes", "in_stock", "error", "checked_at", "tie")
STATE = ("last_price", "last_old_price", "last_cart_price", "last_price_source", "last_sizes", "last_in_stock")
#: Of the state what an alert's score looks at beside what rules do: it goes with the candidates, so that the state is put together once a batch.
KEPT = ("last_old_price", "last_price_source", "last_error")
#: After so many batches the whole state is written anew, so that readers merge fewer ones.
WHOLE_EVERY = 20
#: Observations in a slice, and slices at most: each reads its step's input, but only its own listings, or months, are shuffled.
SLICE_ROWS, MOST_SLICES = 2_000_000, 4


class BatchCheck:
    """Keeps the tables of a check under `path`. rules, products(id, name, family_key, active) and profile(shoe_size, use) are read anew in each batch."""

    def __init__(self, spark: SparkSession, path: str, rules: DataFrame, products: DataFrame, profile: DataFrame | None = None, after: Callable[[str, int], None] | None = None) -> None:
        self.spark, self.path, self.rules, self.products, self.profile = spark, path, rules, products, profile
        self.prices = PriceHistory(spark, f"{path}/prices")
        self.after = after or (lambda step, batch: None)

    def _read(self, name: str, upto: int) -> DataFrame | None:
        """A table's rows of batches up to `upto`."""
        at = f"{self.path}/{name}"
        return self.spark.read.parquet(at).where(F.col("batch") <= upto) if exists(self.spark, at) else None

    def runs(self) -> DataFrame:
        """The report of each batch that counts."""
        return self.spark.read.parquet(f"{self.path}/runs")

    def done(self) -> int:
        """The last batch that counts, or -1."""
        return self.runs().agg(F.max("batch")).first()[0] if exists(self.spark, f"{self.path}/runs") else -1

    def alerts(self, upto: int | None = None) -> DataFrame:
        found = self._read("alerts", self.done() if upto is None else upto)
        return found if found is not None else self.spark.createDataFrame([], "rule_id long, listing_id long, created_at timestamp, batch long")

    def history(self, upto: int | None = None) -> DataFrame:
        """Price history with the rows' ids."""
        return self.prices.history(self.done() if upto is None else upto).withColumn("id", state.history_id())

    def listings(self, upto: int | None = None) -> DataFrame | None:
        """The state of each listing: the newest of the batches since the last whole one."""
        upto = self.done() if upto is None else upto
        rows = self._read("latest", upto)
        if rows is None:
            return None
        last_whole = rows.where("whole = 1").agg(F.max("batch")).first()[0] or 0
        others = [c for c in rows.columns if c not in ("listing_id", "batch", "whole")]
        newest = F.max(F.struct("batch", *others)).alias("s")  # one row a listing and batch
        return rows.where(F.col("batch") >= last_whole).groupBy("listing_id").agg(newest).select("listing_id", *[f"s.{c}" for c in others])

    @staticmethod
    def _slice(rows: DataFrame, i: int, slices: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("listing_id"), F.lit(slices)) == i) if slices > 1 else rows

    def _latest(self, observed: DataFrame, known: DataFrame | None, batch: int) -> DataFrame:
        good = F.col("error").isNull()
        fields = [F.col(c.removeprefix("last_")).alias(c) for c in STATE]
        # what orders observations stands first in both, and nowhere else
        last, best = F.max(F.struct("checked_at", "tie", "product_id", "error")), F.max(F.when(good, F.struct("checked_at", "tie", *fields)))
        seen = observed.groupBy("listing_id").agg(last.alias("_last"), best.alias("_best"), F.max("checked_at").alias("last_checked_at")).select(
            "listing_id", "_last.product_id", F.when(F.col("_best").isNotNull(), F.struct(*[F.col(f"_best.{c}").alias(c) for c in STATE])).alias("_new"), F.col("_best").isNotNull().alias("_good"),
            F.col("_last.error").alias("last_error"), "last_checked_at",
        )
        if known is None:
            put_in = seen.withColumn("_s", F.col("_new"))
        else:
            before = known.select("listing_id", F.struct(*STATE).alias("_old"), F.col("product_id").alias("_product"), F.col("last_error").alias("_error"), F.col("last_checked_at").alias("_at"))
            joined = seen.join(before, "listing_id", "full" if batch % WHOLE_EVERY == 0 else "left")
            put_in = joined.withColumns({
                "_s": F.when(F.coalesce("_good", F.lit(False)), F.col("_new")).otherwise(F.col("_old")), "last_error": F.when(F.col("last_checked_at").isNull(), F.col("_error")).otherwise(F.col("last_error")),
                "product_id": F.coalesce("product_id", "_product"), "last_checked_at": F.coalesce("last_checked_at", "_at"),
            })
        gone = F.col("last_error").contains("404") & ~F.rlike("last_error", F.lit("403|429"))
        out = put_in.select("listing_id", "product_id", "_s.*", "last_error", "last_checked_at")
        return out.withColumn("last_in_stock", F.when(F.coalesce(gone, F.lit(False)), F.lit(False)).otherwise(F.col("last_in_stock")))

    def _scored(self, found: DataFrame, batch: int) -> DataFrame:
        """Alerts, with the state `kept` of their listings, in whose place the decision, score and comment of a buyer with the profile come."""
        trailing = self.prices.insight(batch).select("product_id", "data_points", "min_30d")
        own = self.profile.select("shoe_size").scalar() if self.profile is not None else F.lit(None).cast("string")
        use = self.profile.select("use").scalar() if self.profile is not None else F.lit(False)
        sizes = F.transform("last_sizes", lambda s: F.struct(F.coalesce(F.nullif(s["name"], F.lit("")), s["size"]).alias("size"), s["in_stock"].alias("in_stock")))
        asked = self.rules.select(F.col("id").alias("rule_id"), F.col("size").alias("rule_size"))
        rows = found.select("*", F.col("price").alias("last_price"), "kept.*").join(asked, "rule_id").join(trailing, "product_id", "left")
        near = F.coalesce((F.col("price") != 0) & (F.col("min_30d") != 0) & (F.col("price") <= F.col("min_30d") * 1.02), F.lit(False))
        put_in = rows.withColumns({"sizes": sizes, "has_rule": F.lit(True), "profile_size": own, "profile_use": use, "is_near_lowest": near, "data_points": F.coalesce("data_points", F.lit(0))})
        return score.buy_score(put_in).select(*[c for c in found.columns if c != "kept"], F.col("decision").alias("ai_decision"), F.col("score").alias("ai_score"), F.col("comment").alias("ai_comment"))

    def run_batch(self, observed: DataFrame, batch: int) -> None:
        """Everything that one batch writes."""
        if batch <= self.done():
            return
        with shuffles_removed(self.spark):
            self._run(observed, batch)

    def _run(self, observed: DataFrame, batch: int) -> None:
        counted = Observation(f"check-{batch}")
        failed = F.col("error").isNotNull()
        watched = observed.select(*OBSERVED).observe(
            counted, F.count("*").alias("total"), F.count_if(~failed & F.col("price").isNotNull()).alias("success"), F.count_if(failed).alias("failed"),
            F.count_if(~failed & F.col("price").isNull()).alias("no_price"), F.max("checked_at").alias("at"),
        )
        put(watched, f"{self.path}/observed", batch)
        counts = counted.get
        if not counts["total"]:
            return
        slices = min(MOST_SLICES, 1 + counts["total"] // SLICE_ROWS)
        self.after("observed", batch)
        kept = self.spark.read.parquet(f"{self.path}/observed").where(F.col("batch") == batch).drop("batch")
        self.prices.append(state.history_rows(kept.where("error is null").withColumnRenamed("price", "current_price").withColumns({"confidence": F.lit(None).cast("double"), "stock_count": F.lit(None).cast("int")})).drop("id"), batch, slices)
        self.after("history", batch)
        known = self.listings(batch - 1)
        for i in range(slices):
            state_then = self._latest(self._slice(kept, i, slices), known if known is None else self._slice(known, i, slices), batch)
            put(state_then.withColumn("whole", F.lit(int(batch % WHOLE_EVERY == 0))), f"{self.path}/latest", batch, ("whole",), deal=False, add=i > 0)
        self.after("latest", batch)
        listings = self.listings(batch)
        touched = kept.select("product_id").distinct()
        names = self.products.where("active").select(F.col("id").alias("product_id"), "family_key")
        families = names.join(touched, "product_id", "left_semi").where("family_key is not null").select("family_key").distinct()
        wide = self.rules.where("spectrum_mode").join(names.join(families, "family_key", "left_semi").select("product_id"), "product_id", "left_semi")
        asked = self.rules.where("not coalesce(spectrum_mode, false)").join(touched, "product_id", "left_semi").unionByName(wide).unionByName(self.rules.where("spectrum_mode").join(touched, "product_id", "left_semi")).dropDuplicates(["id"])
        asked = engine.written([asked], "asked")  # what was touched is not looked for again in each step
        state_now = listings.select("listing_id", F.col("listing_id").alias("id"), "product_id", "last_price", "last_cart_price", "last_sizes", "last_in_stock", F.lit(True).alias("active"), *KEPT)
        at = F.lit(counts["at"])
        found = engine.evaluate_rules(asked, self.products, [self._slice(state_now, i, slices).drop("listing_id") for i in range(slices)], keep=KEPT).withColumn("created_at", at)
        fresh = engine.outside_cooldown(found, self.alerts(batch - 1), ["rule_id", "listing_id"], "created_at")
        scored = self._scored(fresh.drop("cooldown_hours"), batch)
        made = Observation(f"alerts-{batch}")
        ids = F.sha2(F.concat_ws("|", "rule_id", "listing_id", F.col("created_at").cast("string")), 256)
        put(scored.withColumns({"alert_id": ids, "is_read": F.lit(False), "telegram_sent": F.lit(False)}).observe(made, F.count("*").alias("n")), f"{self.path}/alerts", batch)
        self.after("alerts", batch)
        report = self.spark.range(1).select(*[F.lit(counts[c]).alias(c) for c in ("total", "success", "failed", "no_price")], F.lit(made.get["n"]).alias("alerts_created"), at.alias("finished_at"))
        put(report.coalesce(1), f"{self.path}/runs", batch)

    def start(self, observations: DataFrame, every: str | None = None) -> StreamingQuery:
        """Runs over all that is there, or again and again at an interval."""
        writer = observations.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", f"{self.path}/progress")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
