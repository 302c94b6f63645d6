"""Rules against listings: price, size, stock, family and cooldown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import new_folder
from .insight import micros

TOLERANCE = 1.10
DEFAULT_COOLDOWN = 24.0


def rule_matches(rules: DataFrame, listings: DataFrame, tolerance: float = TOLERANCE, on: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rule, listing) pairs on one product (or `on`) whose price is within the target's tolerance and whose size, or any size, is in stock.

    The price test is part of the join, so pairs that fail it are never made. Listings may be a stream; `keep` names
    further columns of theirs.
    """
    r, p = rules.where("enabled and target_price is not null").alias("r"), listings.alias("l")
    joined = r.join(p, (on if on is not None else F.col("r.product_id") == F.col("l.product_id")) & (F.col("l.price") <= F.col("r.target_price") * F.lit(tolerance)))
    sized = F.col("r.rule_size").isNotNull()
    fits = F.when(sized, (F.col("l.size") == F.col("r.rule_size")) & F.col("l.size_in_stock")).otherwise(F.col("l.in_stock"))
    return joined.where(F.coalesce(fits, F.lit(False))).select("r.rule_id", "r.product_id", F.col("l.product_id").alias("listing_product_id"), "l.store_id", "l.price", "r.target_price", (F.col("l.price") > F.col("r.target_price")).alias("in_tolerance"), F.when(sized, F.col("r.rule_size").cast("string")).otherwise("Herhangi bir beden").alias("matched_size"), *[F.col(f"l.{c}") for c in keep])


def first_size_in_stock(rule_size: Column, sizes: Column) -> Column:
    """Whether the first entry of sizes(name, in_stock) that equals the rule's size is in stock; false without one."""
    norm = lambda s: F.upper(F.trim(F.replace(s, F.lit(","), F.lit("."))))
    return F.coalesce(F.get(F.filter(sizes, lambda s: norm(s["name"]) == norm(rule_size)), 0)["in_stock"], F.lit(False))


def spectrum_matches(rules: DataFrame, products: DataFrame, listings: DataFrame, family: str = "family_key") -> DataFrame:
    """For spectrum rules: the cheapest match over all active products of the rule's family, one row for each rule.

    Families may hold a large share of all products: a family's listings are brought down to its cheapest matches
    before rules meet them, so the join has one row for each rule, never rules times listings.
    """
    known = products.where(F.col("active") & F.col(family).isNotNull()).select("product_id", family)
    spectrum = rules.where("spectrum and enabled and target_price is not null").join(known, "product_id")
    offers = listings.join(known, "product_id").where("price is not null")
    best = F.min(F.struct("price", "product_id", "store_id"))
    any_size = offers.where("in_stock").groupBy(family).agg(best.alias("any"))
    by_size = offers.where("size_in_stock").groupBy(family, F.col("size").alias("rule_size")).agg(best.alias("sized"))
    met = spectrum.join(any_size, family, "left").join(by_size, [family, "rule_size"], "left")
    chosen = met.withColumn("b", F.when(F.col("rule_size").isNull(), F.col("any")).otherwise(F.col("sized"))).where(F.col("b.price") <= F.col("target_price") * TOLERANCE)
    return chosen.select("rule_id", "product_id", F.col("b.product_id").alias("listing_product_id"), F.col("b.store_id").alias("store_id"), F.col("b.price").alias("price"), "target_price")


def last_alert_before(rows: DataFrame, alerts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows with `_last`, the latest alert of the same keys at or before the row's instant `at`; null without one, or where a key or the instant is null.

    In two levels, so that a key with most rows is as many tasks as it has days: within a day rows and alerts stand in
    one order; of the days before only the latest alert is looked at.
    """
    day = lambda c: F.to_date(F.col(c)).alias("_day")
    mine = rows.select(*keys, day(at), micros(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    theirs = alerts.where(F.col("created_at").isNotNull()).select(*keys, day("created_at"), micros("created_at").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    both = mine.unionByName(theirs)
    alerted = F.when(F.col("_kind") == 0, F.col("_at"))
    days = both.groupBy(*keys, "_day").agg(F.max(alerted).alias("_most"))
    earlier = days.select(*keys, "_day", F.max("_most").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    within = Window.partitionBy(*keys, "_day").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_within", F.max(alerted).over(within)).where("_kind = 1").select(*keys, "_day", "_within", "_row")
    # a row whose key is null meets no day, and so no alert
    return seen.join(earlier, [*keys, "_day"], "left").select("_row.*", F.when(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), F.coalesce("_within", "_earlier")).alias("_last"))


def outside_cooldown(candidates: DataFrame, alerts: DataFrame, keys: list[str], at: str = "as_of") -> DataFrame:
    """Candidates(keys, cooldown_hours, as_of) without an alert of the same keys within the cooldown before them; a cooldown of 0 or null means the default. Alerts after a candidate count for nothing."""
    hours = F.coalesce(F.nullif(F.col("cooldown_hours"), F.lit(0.0)), F.lit(DEFAULT_COOLDOWN))
    recent = micros(at) - F.col("_last") < hours * 3_600_000_000
    return last_alert_before(candidates, alerts, keys, at).where(~F.coalesce(recent, F.lit(False))).drop("_last")


def rules_of(rules: DataFrame, products: DataFrame) -> DataFrame:
    """The rules of the products listed."""
    return rules.join(products.select("product_id"), "product_id", "left_semi")


def legacy_matches(rules: DataFrame, listings: DataFrame) -> DataFrame:
    """(rule_id, product_id, listing_id, price, size) by the older rule: no tolerance, and a listing without known sizes is taken on its price alone, unless the rule names a size.

    rules and listings are those of :func:`evaluate_rules`; the first entry with the rule's size decides.
    """
    wanted = F.when(~F.coalesce("size", F.lit("")).isin("", "-"), _norm(F.col("size")))
    asked = rules.where("enabled and target_price is not null").select(F.col("id").alias("rule_id"), "product_id", "target_price", wanted.alias("_want"))
    offers = listings.where("active").select(F.col("id").alias("listing_id"), F.col("product_id").alias("_of"), F.col("last_price").alias("price"), "last_sizes")
    met = asked.join(offers, (F.col("product_id") == F.col("_of")) & (F.col("price") <= F.col("target_price")))
    first = F.get(F.filter("last_sizes", lambda s: _norm(s["name"]) == F.col("_want")), 0)
    stocked = F.exists("last_sizes", lambda s: F.coalesce(s["in_stock"], F.lit(False)))
    unknown = F.coalesce(F.size("last_sizes"), F.lit(0)) <= 0
    size = F.when(F.col("_want").isNotNull(), F.when(first["in_stock"], first["name"])).when(unknown, "Beden Bilgisi Yok").when(stocked, "Herhangi Bir Beden")
    return met.withColumn("size", size).where("size is not null").select("rule_id", "product_id", "listing_id", "price", "size")


def without_unread(candidates: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates for which no unread alert stands: by the state of alerts now, whenever the candidates are from."""
    return candidates.join(alerts.where("is_read = false").select(*keys).distinct(), keys, "left_anti")


def latest_alerts(alerts: DataFrame, keys: list[str]) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("alert_id"))
    return alerts.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _norm(size: Column) -> Column:
    return F.upper(F.trim(F.replace(size, F.lit(","), F.lit("."))))


def written(slices: list[DataFrame], name: str) -> DataFrame:
    """Rows, slice by slice, as Parquet in a new folder of the cluster's shared one, so that what reads them again doesn't make them again."""
    spark = slices[0].sparkSession
    path = new_folder(spark, name)
    for rows in slices:
        rows.write.mode("append").parquet(path)
    return spark.read.schema(slices[0].schema).parquet(path)


def _label(entry: Column) -> Column:
    return F.coalesce(F.nullif(entry["name"], F.lit("")), entry["size"])


def evaluate_rules(rules: DataFrame, products: DataFrame, listings: DataFrame | list[DataFrame], tolerance: float = TOLERANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of all rules over whole listings(id, product_id, last_price, last_cart_price, last_sizes, last_in_stock, active).

    A sized rule takes the first size entry with its label; one without a size (null, empty or "-") takes any size in
    stock, or the listing's own flag where no sizes are known. Spectrum rules look at all active products of the
    family, or at their own product where it has no family, and keep the cheapest candidate. Families are brought down
    to their cheapest offers, for each size and for any, before rules meet them. Listings are gone through once: the
    offers that some rule of their product or family may take by price are written to the cluster's shared folder.

    Listings may be a list of slices, which are gone through one after the other. With `keep`, further columns of listings, candidates have a struct `kept` of last_cart_price, last_sizes, last_in_stock and those.
    """
    active = products.where("active").select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "family_key")
    scoped = rules.where("enabled and target_price is not null").join(active, "product_id")
    # a family without an active listing has none of the rule's own product either, so it needs no look of its own
    wide = F.coalesce("spectrum_mode", F.lit(False)) & F.col("family_key").isNotNull()
    scoped = scoped.withColumns({"_wide": wide, "_want": F.when(~F.coalesce("size", F.lit("")).isin("", "-"), _norm(F.col("size")))})

    most = F.max(F.col("target_price") * F.lit(tolerance))
    by_product = scoped.where("not _wide").groupBy(F.col("product_id").alias("listing_product_id")).agg(most.alias("_own"))
    by_family = scoped.where("_wide").groupBy(F.col("family_key").alias("listing_family")).agg(most.alias("_of_family"))
    names = active.select(F.col("product_id").alias("listing_product_id"), F.col("product_name").alias("listing_name"), F.col("family_key").alias("listing_family"))
    bounded = names.join(by_product, "listing_product_id", "left").join(by_family, "listing_family", "left").withColumn("_most", F.greatest("_own", "_of_family")).where("_most is not null").drop("_own", "_of_family")
    if isinstance(listings, list) and len(listings) > 1:
        bounded = written([bounded], "bounds")  # not made again for each slice
    reach = lambda part: part.where("active and last_price is not null").select(F.col("id").alias("listing_id"), F.col("product_id").alias("listing_product_id"), "last_price", "last_cart_price", "last_sizes", "last_in_stock", *keep).join(bounded, "listing_product_id").where("last_price <= _most").drop("_most")
    offers = written([reach(part) for part in (listings if isinstance(listings, list) else [listings])], "offers")

    listed = F.coalesce(F.size("last_sizes"), F.lit(0)) > 0
    any_fits = F.coalesce(F.when(listed, F.exists("last_sizes", lambda s: F.coalesce(s["in_stock"], F.lit(False)))).otherwise(F.col("last_in_stock")), F.lit(False))
    any_said = F.when(listed, "Herhangi bir beden").otherwise("Beden bilgisi yok")
    with_it = [F.struct("last_cart_price", "last_sizes", "last_in_stock", *keep).alias("kept")] if keep else []
    offer = lambda said: F.struct("last_price", "listing_id", "last_cart_price", "listing_name", said.alias("matched_size"), *with_it)

    cheap = F.col("last_price") <= F.col("target_price") * F.lit(tolerance)
    first = F.get(F.filter("last_sizes", lambda s: _norm(_label(s)) == F.col("_want")), 0)
    own = scoped.where("not _wide").join(offers, (F.col("product_id") == F.col("listing_product_id")) & cheap)
    sized = F.col("_want").isNotNull()
    own = own.where(F.coalesce(F.when(sized, first["in_stock"]).otherwise(any_fits), F.lit(False))).withColumn("_o", offer(F.when(sized, first["name"]).otherwise(any_said)))
    rule = ["id", "product_id", "target_price", "cooldown_hours"]
    plain = own.where(~F.coalesce("spectrum_mode", F.lit(False))).select(*rule, "_o")
    alone = own.where("spectrum_mode").groupBy(*rule).agg(F.min("_o").alias("_o"))

    entries = offers.where("listing_family is not null").withColumn("_labels", F.transform("last_sizes", lambda s: _norm(_label(s))))
    firsts = F.filter("last_sizes", lambda s, i: (F.array_position("_labels", _norm(_label(s))) == i + 1) & F.coalesce(s["in_stock"], F.lit(False)))
    each = entries.select("listing_family", "last_price", "listing_id", "last_cart_price", "listing_name", "last_sizes", "last_in_stock", *keep, F.explode(firsts).alias("s"))
    by_size = each.groupBy("listing_family", _norm(_label(F.col("s"))).alias("_size")).agg(F.min(offer(F.col("s.name"))).alias("_sized"))
    by_any = entries.where(any_fits).groupBy("listing_family").agg(F.min(offer(any_said)).alias("_any"))
    asked = scoped.where("_wide")
    met = asked.join(by_any, F.col("family_key") == F.col("listing_family"), "left").drop("listing_family").join(by_size, (F.col("family_key") == F.col("listing_family")) & (F.col("_want") == F.col("_size")), "left")
    family = met.withColumn("_o", F.when(sized, F.col("_sized")).otherwise(F.col("_any"))).where(F.col("_o.last_price") <= F.col("target_price") * F.lit(tolerance)).select(*rule, "_o")

    kept = plain.unionByName(alone).unionByName(family).select(*rule, "_o.*")
    title = F.concat(F.when(F.col("last_price") > F.col("target_price"), "🎯 HEDEFE YAKLAŞTI: ").otherwise("✅ HEDEF YAKALANDI: "), "listing_name")
    cart = F.when(F.coalesce("last_cart_price", F.lit(0.0)) != 0, "Sepet indirimi").otherwise("Normal fiyat")
    return kept.select(F.col("id").alias("rule_id"), "product_id", "listing_id", title.alias("title"), F.col("listing_name").alias("product_name"), F.col("last_price").alias("price"), "target_price", F.col("matched_size").alias("size"), cart.alias("price_type"), "cooldown_hours", *(["kept"] if keep else []))
