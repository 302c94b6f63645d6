"""Changes to tables, as rebuilt tables: upserts, partial updates, cascades, toggles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(current: DataFrame, observed: DataFrame, key: str, at: str, keep_if_set: tuple[str, ...] = ()) -> DataFrame:
    """current with each key's latest observation over it; columns of keep_if_set are only filled where they are empty."""
    others = [c for c in observed.columns if c not in (key, at)]
    newest = observed.groupBy(key).agg(F.max(F.struct(at, *others)).alias("_n"))
    joined = current.join(newest, key, "full")
    newer = F.col("_n").isNotNull()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    out = [F.when(newer & (blank(c) if c in keep_if_set else F.lit(True)), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in [at, *others] else F.col(c) for c in current.columns]
    return joined.select(*out)


def error_state(listings: DataFrame, message: Column) -> DataFrame:
    """The last error of each listing; a missing page also takes it out of stock, but leaves price and sizes."""
    missing = message.contains("404") & ~F.rlike(message, F.lit("403|429"))
    return listings.withColumns({"last_error": message, "in_stock": F.when(missing, F.lit(False)).otherwise(F.col("in_stock")), "stock_count": F.when(missing, 0).otherwise(F.col("stock_count"))})


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def cascade_all(parents: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Every child table without the rows of deleted parents."""
    return {name: cascade(parents, child, key) for name, child in children.items()}


def append_alerts(alerts: DataFrame, new: DataFrame, key: str = "alert_id") -> DataFrame:
    """alerts(key, telegram_sent, telegram_error, ...) with new ones below them, unsent; an id that is there already is not added again, so that a rerun changes nothing."""
    fresh = new.join(alerts.select(key), key, "left_anti").withColumns({"telegram_sent": F.lit(False), "telegram_error": F.lit(None).cast("string")})
    return alerts.unionByName(fresh)


def delete_all(alerts: DataFrame, resets: DataFrame, at: str = "created_at", owner: str | None = None) -> DataFrame:
    """alerts that are newer than the last delete-all, of everything or, with `owner`, of each owner's own; one of the same instant goes.

    resets(at) or resets(owner, at) are the delete-alls so far. Without any, all alerts stay; a null owner's resets delete nothing.
    Alerts without an instant go with any reset, as nothing tells that they came later.
    """
    if owner is None:
        last = resets.agg(F.max(at).alias("_last")).select("_last").scalar()
        return alerts.where(last.isNull() | F.coalesce(F.col(at) > last, F.lit(False)))
    last = resets.groupBy(F.col(owner).alias("_owner")).agg(F.max(at).alias("_last")).where("_last is not null")
    gone = (F.col(owner) == F.col("_owner")) & ~F.coalesce(F.col(at) > F.col("_last"), F.lit(False))
    return alerts.join(last, gone, "left_anti")


def mark_sent(alerts: DataFrame, said: DataFrame, key: str = "alert_id") -> DataFrame:
    """alerts with what the messenger said(key, ok, error) of them; ids that it says nothing of stay as they are."""
    heard = said.groupBy(key).agg(F.bool_or("ok").alias("_ok"), F.max("error").alias("_error"))
    joined = alerts.join(heard, key, "left")
    return joined.withColumns({"telegram_sent": F.coalesce("_ok", "telegram_sent"), "telegram_error": F.when(F.col("_ok").isNull(), F.col("telegram_error")).otherwise(F.col("_error"))}).drop("_ok", "_error")


def delivery_summary(alerts: DataFrame, by: str) -> DataFrame:
    """Alerts(outcome) of each `by` that were sent, skipped and failed."""
    return alerts.groupBy(by).agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("sent", "sent"), ("skipped", "skipped"), ("error", "errors"))])


def first_success(attempts: DataFrame, key: str, order: list[str], value: str, also: list[str]) -> DataFrame:
    """(key, *also, value, attempts): the first non-null value of each key, in order, with what else stands beside it; null where no attempt gave one."""
    won = F.min_by(F.struct(*also, value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_w")
    return attempts.groupBy(key).agg(won, F.count("*").alias("attempts")).select(key, *[F.col(f"_w.{c}") for c in (*also, value)], "attempts")


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of changes; a null never overwrites."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.withColumnsRenamed({c: f"_{c}" for c in fields})
    return base.join(renamed, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields])


def with_defaults(settings: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """One row of settings with defaults for what is null or absent."""
    one = settings.sparkSession.range(1).select()
    given = one.join(settings.limit(1), F.lit(True), "left")
    return given.select(*[(F.coalesce(F.col(k), F.lit(v)) if k in settings.columns else F.lit(v)).alias(k) for k, v in defaults.items()])


def backfill(table: DataFrame, column: str, value: Column) -> DataFrame:
    """table with `value` where the column is null or empty; what is set stays."""
    return table.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), value))


def read_settings(saved: DataFrame, raw: str, keep: str, defaults: dict[str, object]) -> DataFrame:
    """(keep, settings...) of each saved JSON text `raw`, merged over the defaults, whose values may be dictionaries of values, one struct each.

    A leaf that is null, absent or of another kind, and a text that isn't JSON, give the default; unknown keys are not read.
    """
    read = F.try_parse_json(raw)

    def leaf(path: str, default: object) -> Column:
        kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(default)]
        return F.coalesce(F.try_variant_get(read, f"$.{path}", kind), F.lit(default).cast(kind))

    def whole(name: str, default: object) -> Column:
        return (F.struct(*[leaf(f"{name}.{k}", v).alias(k) for k, v in default.items()]) if isinstance(default, dict) else leaf(name, default)).alias(name)

    return saved.select(keep, *[whole(k, v) for k, v in defaults.items()])


def toggle(flag: Column) -> Column:
    """The opposite of a flag; a missing one counts as set."""
    return ~F.coalesce(flag, F.lit(True))


def run_report(results: DataFrame, run: str) -> DataFrame:
    """Counters of each run's results(status, price)."""
    return results.groupBy(run).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "no_price").alias("no_price"), F.count_distinct("product_id").alias("products"))


def outbox(alerts: DataFrame, enabled: Column, token: Column, chat: Column) -> DataFrame:
    """Alerts with what a messenger would do: sent, or the reason why not. Settings are columns: of one user, or of each alert's own."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = F.when(~F.coalesce(enabled, F.lit(False)), "telegram_kapali").when(blank(token) | blank(chat), "token_veya_chat_id_eksik")
    return alerts.withColumns({"sent": reason.isNull(), "reason": reason})


def manual_prices(listings: DataFrame, entered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings with the prices entered(id, price, at) by hand, and the history rows for them; prices of 0 or less are refused. Sizes and stock stay.

    Of several prices for one listing the latest counts, the highest of one instant; all are history. Prices for unknown listings count for nothing.
    """
    valid = entered.where("price > 0").select("id", F.col("price").alias("_price"), F.col("at").alias("_at"))
    last = valid.groupBy("id").agg(F.max(F.struct("_at", "_price")).alias("_e"))
    joined = listings.join(last, "id", "left").select(*listings.columns, F.col("_e").isNotNull().alias("_new"), "_e._at", "_e._price")
    put = {"last_price": F.coalesce("_price", "last_price"), "last_price_source": F.when(F.col("_new"), "manual").otherwise(F.col("last_price_source")), "last_confidence": F.when(F.col("_new"), 0.99).otherwise(F.col("last_confidence")), "last_checked_at": F.coalesce("_at", "last_checked_at")}
    history = listings.select("id", "product_id").join(valid, "id").select(F.col("id").alias("listing_id"), "product_id", F.col("_price").alias("price"), F.lit("manual").alias("price_source"), F.lit(0.99).alias("confidence"), F.col("_at").alias("checked_at"))
    return joined.withColumns(put).drop("_price", "_at", "_new"), history


def history_id(price: str = "price") -> Column:
    """The id of a price history row: a hash of its listing, instant and price, so that it need not be stored."""
    return F.sha2(F.concat_ws("|", "listing_id", "checked_at", price), 256)


def history_rows(checked: DataFrame) -> DataFrame:
    """Price history rows of checked offers: only those with a price; ids are a hash, so that a rerun gives the same ones."""
    return checked.where("current_price is not null").withColumn("id", history_id("current_price")).select("id", "listing_id", "product_id", F.col("current_price").alias("price"), "old_price", "cart_price", "price_source", "confidence", "stock_count", "checked_at")
