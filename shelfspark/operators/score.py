"""Buy score, decision, reasons and risks of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points for where a price was read.
SOURCE_POINTS = {"cart_offer": 15, "manual": 14, "shelf": 12, "json_ld": 9, "embedded_json": 8, "meta": 6}
# Decisions and the least score of each.
DECISIONS = ((85, "AL"), (70, "ALINABİLİR"), (50, "BEKLE"), (30, "SADECE ÇOK UCUZSA"))
NEVER, UNKNOWN = "UYGUN DEĞİL", "BELİRSİZ"

#: Columns that a scored row needs.
INPUT = (
    "last_price double, last_old_price double, last_cart_price double, last_price_source string, last_error string, last_in_stock boolean, sizes array<struct<size:string,in_stock:boolean>>, "
    "has_rule boolean, target_price double, rule_size string, profile_size string, profile_use boolean, is_near_lowest boolean, data_points long, min_30d double"
)


def _norm(size: Column) -> Column:
    return F.upper(F.trim(F.replace(F.coalesce(size, F.lit("")), F.lit(","), F.lit("."))))


def _truthy(number: Column) -> Column:
    return F.coalesce(number != 0, F.lit(False))


def buy_score(rows: DataFrame) -> DataFrame:
    """rows with price_score, stock_score, profile_score, trust_score, score, decision, reasons, risks and comment."""
    c, no = F.col, F.lit(False)
    price, target, old = c("last_price"), c("target_price"), c("last_old_price")
    stocked = F.transform(F.filter(F.coalesce("sizes", F.array().cast("array<struct<size:string,in_stock:boolean>>")), lambda s: F.coalesce(s["in_stock"], no)), lambda s: _norm(s["size"]))
    known = rows.withColumns({
        "_want": F.nullif(F.nullif(_norm(c("rule_size")), F.lit("")), F.lit("-")), "_own": _norm(c("profile_size")), "_stocked": stocked, "_listed": F.coalesce(F.size("sizes"), F.lit(0)) > 0,
        "_rate": F.when(_truthy(old) & (old > price), (old - price) / old * 100), "_rule": F.coalesce("has_rule", no), "_cart": _truthy(c("last_cart_price")), "_near": F.coalesce(c("is_near_lowest") & (c("data_points") >= 3), no),
    })
    any_stock = F.size("_stocked") > 0
    want_stock, own_stock = F.array_contains("_stocked", c("_want")), F.array_contains("_stocked", c("_own"))
    rate = c("_rate")
    price_score = F.least(F.lit(40), F.when(_truthy(target), F.when(price <= target, 20).when(price <= target * 1.1, 10).otherwise(0)).otherwise(8) + F.when(c("_near"), 10).otherwise(0) + F.when(rate >= 20, 6).when(rate >= 10, 4).when(rate > 0, 2).otherwise(0) + F.when(c("_cart"), 4).otherwise(0))
    stock_score = F.when(c("_want").isNotNull(), F.when(want_stock, 20).otherwise(0)).when(c("_listed"), F.when(any_stock, 14).otherwise(0)).otherwise(F.when(F.coalesce("last_in_stock", no), 8).otherwise(3))
    profile_score = F.least(F.lit(25), F.when(F.coalesce("profile_use", no), 8).otherwise(5) + F.when((c("_own") != "") & own_stock, 12).otherwise(0) + F.when(c("_rule"), 5).otherwise(0))
    source = F.coalesce("last_price_source", F.lit(""))
    points = F.when(source == "", 2)
    for name, value in SOURCE_POINTS.items():
        points = points.when(source == name, value)
    trust_score = F.when(F.coalesce("last_error", F.lit("")) != "", 2).otherwise(points.otherwise(4))
    whole = lambda x: F.format_string("%.0f", F.bround(x, 0))
    say = lambda cond, *text: F.when(cond, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    has_want = c("_want").isNotNull()
    # What reasons and risks say.
    reasons = [
        say(_truthy(target) & (price <= target), "Hedef fiyatın (", whole(target), " TL) altında"),
        say(_truthy(target) & (price > target) & (price <= target * 1.1), "Hedef fiyata çok yakın (%10 bandında)"),
        say(c("_near"), "Son 30 günün en düşük fiyatına yakın"),
        say(rate >= 20, "Etiket fiyatına göre %", whole(rate), " indirim"),
        say(c("_cart"), "Sepet indirimi yakalandı"),
        say(has_want & want_stock, "İstenen beden (", c("_want"), ") bildirim anında stokta görünüyordu"),
        say(~has_want & c("_listed") & any_stock, F.size("_stocked").cast("string"), " beden stokta görünüyor"),
        say((c("_own") != "") & own_stock, "Profilinizdeki numara (", c("profile_size"), ") stokta"),
        say(source == "cart_offer", "Fiyat sepet teklifinden okundu (yüksek güven)"),
    ]
    risks = [
        say(_truthy(target) & (price > target * 1.1), "Hedef fiyatın (", whole(target), " TL) üzerinde"),
        say(~_truthy(target), "Hedef fiyat kuralı tanımlı değil"),
        say(~c("_near") & _truthy(c("min_30d")) & (price > c("min_30d") * 1.1), "Son 30 günde daha ucuzu görüldü (", whole(c("min_30d")), " TL)"),
        say(c("_cart"), "Sepet indirimi ödeme ekranında doğrulanmalı"),
        say(has_want & ~want_stock, "İstenen beden (", c("_want"), ") stokta görünmüyor"),
        say(~has_want & c("_listed") & ~any_stock, "Hiçbir beden stokta görünmüyor"),
        say(~has_want & ~c("_listed"), "Beden bazlı stok bilgisi yok, stok durumu belirsiz"),
        say(any_stock, "Stok hızlı tükenebilir"),
        say((c("_own") != "") & ~own_stock & any_stock, "Profilinizdeki numara stok listesinde görünmüyor"),
        say(F.coalesce("last_error", F.lit("")) != "", "Son kontrolde hata alındı, veri bayat olabilir"),
    ]
    parts = known.withColumns({"price_score": price_score, "stock_score": stock_score, "profile_score": profile_score, "trust_score": trust_score, "_reasons": F.slice(F.array_compact(F.array(*reasons)), 1, 6), "_risks": F.slice(F.array_compact(F.array(*risks)), 1, 5)})
    total, blank = c("price_score") + c("stock_score") + c("profile_score") + c("trust_score"), price.isNull()
    decided = F.when(blank | ((c("trust_score") <= 2) & ~c("_listed")), UNKNOWN)
    for least, name in DECISIONS:
        decided = decided.when(total >= least, name)
    out = parts.withColumns({
        "score": F.when(blank, 0).otherwise(total), "decision": decided.otherwise(NEVER),
        "reasons": F.when(blank, F.array(F.lit("Güncel fiyat okunamadı"))).otherwise(c("_reasons")), "risks": F.when(blank, F.array(F.lit("Fiyat verisi olmadan karar üretilemez"))).otherwise(c("_risks")),
        **{n: F.when(blank, 0).otherwise(c(n)) for n in ("price_score", "stock_score", "profile_score", "trust_score")},
    })
    head = F.format_string("%s (%d/100)", c("decision"), c("score"))
    first = F.array_join(F.slice("reasons", 1, 2), "; ")
    return out.withColumn("comment", F.when(first == "", head).otherwise(F.concat(head, F.lit(". "), first))).drop("_want", "_own", "_stocked", "_listed", "_rate", "_rule", "_cart", "_near", "_reasons", "_risks")


def deals(scored: DataFrame, most: int = 6) -> DataFrame:
    """The best-scored rows, those without any verdict left out."""
    return scored.where(~((F.col("decision") == UNKNOWN) & (F.col("score") == 0))).orderBy(F.desc("score"), "product_id").limit(most)
