"""Scalar text and number functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a family key leaves out.
COLOUR_WORDS = (
    "siyah", "beyaz", "mavi", "kirmizi", "turuncu", "mor", "pembe", "yesil", "gri", "lacivert", "bej", "kahverengi", "sari", "krem", "antrasit", "bordo", "haki", "gumus", "altin", "fume", "black", "white", "blue", "red", "orange", "purple", "pink", "green", "grey", "gray", "navy", "multi", "renkli", "petrol", "mint", "lila", "somon", "turkuaz", "ekru",
)
GENDER_WORDS = (
    "erkek", "kadin", "unisex", "cocuk", "kiz", "bebek", "men", "women", "mens", "womens", "kids", "genc",
)
GENERIC_WORDS = (
    "kosu", "ayakkabisi", "ayakkabi", "spor", "sneaker", "yuruyus", "outdoor", "gunluk", "antrenman", "bot", "terlik", "sandalet", "shoes", "running", "tenis", "fitness", "yol", "kosusu", "yarim", "bilekli", "su", "gecirmez",
)
# Turkish letters and what they fold to.
TURKISH, FOLDED = "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU"
# What a bot challenge page says within its first 8000 characters.
CHALLENGE_TOKENS = ("sec-if-cpt-container", "scf-akamai", "powered and protected by", "cf-chl", "just a moment", "distil_r_captcha", "recaptcha")
# Image addresses that are no product pictures.
BAD_IMAGE_TOKENS = ("favicon", "logo.svg", "/logo", "sprite", "placeholder", "blank.gif", "loader")


def parse_price_text(text: Column) -> Column:
    """A price from shop text: with both marks dots are thousands and the comma is decimal; one dot before three digits is thousands; null if none or not above 0."""
    kept = F.regexp_replace(F.replace(F.replace(F.upper(text), F.lit("TL"), F.lit("")), F.lit("₺"), F.lit("")), r"[^0-9.,]", "")
    dots = F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit("")))
    no_dots = F.replace(kept, F.lit("."), F.lit(""))
    plain = (
        F.when(kept.contains(",") & (dots > 0), F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(kept.contains(","), F.replace(kept, F.lit(","), F.lit(".")))
        .when((dots > 1) | F.rlike(kept, F.lit(r"^[0-9]*\.[0-9]{3}$")), no_dots)
        .otherwise(kept)
    )
    value = F.round(F.when(F.rlike(plain, F.lit(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")), plain).try_cast("double"), 2)
    return F.when(value > 0, value)


def parse_price_plain(text: Column) -> Column:
    """The older rule: all dots go, the comma is decimal."""
    kept = F.regexp_replace(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), r"[^0-9.]", "")
    return F.when(kept != "", kept).try_cast("double")


def instant(iso: Column) -> Column:
    """An ISO date or instant in words of 2024-01-31T10:20:30.5+03:00, of which all after the day may be left out; without a zone it is UTC; null for anything else."""
    known = F.rlike(iso, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"))
    colon = F.regexp_replace(iso, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    timed = F.when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00"))).otherwise(F.regexp_replace(colon, r"^(.{11}[0-9]{2}:[0-9]{2})(Z|[+-].*)?$", "$1:00$2"))
    zoned = F.when(F.rlike(timed, F.lit(r"(Z|[+-][0-9]{2}:[0-9]{2})$")), timed).otherwise(F.concat(timed, F.lit("Z")))
    return F.when(known, zoned).try_cast("timestamp")


def scale_fix(value: Column, limit: float = 15000.0) -> Column:
    """Divided by ten as often as it takes to be at most `limit`; infinity stays."""
    steps = F.greatest(F.lit(0.0), F.ceil(F.log10(value / limit)).cast("double"))
    near = value / F.pow(F.lit(10.0), steps)  # one step off where the logarithm was rounded
    exact = F.when(near > limit, near / 10).when((steps > 0) & (near * 10 <= limit), near * 10).otherwise(near)
    return F.round(F.when((value > limit) & (value < float("inf")), exact).otherwise(value), 2)


def normalize_size(size: Column, empty: str = "-") -> Column:
    """Comma to dot, trimmed, upper case; `empty` for null and empty."""
    return F.when(F.coalesce(size, F.lit("")) == "", F.lit(empty)).otherwise(F.upper(F.trim(F.replace(size, F.lit(","), F.lit(".")))))


def family_key(name: Column) -> Column:
    """The first six words of a name that tell a model from its colours, genders and generic words; null if none."""
    words = F.regexp_extract_all(F.lower(F.translate(name, TURKISH, FOLDED)), F.lit(r"[a-z0-9.]+"), F.lit(0))
    skip = F.array(*[F.lit(w) for w in [*COLOUR_WORDS, *GENDER_WORDS, *GENERIC_WORDS]])
    return F.nullif(F.array_join(F.slice(F.filter(words, lambda w: ~F.array_contains(skip, w)), 1, 6), " "), F.lit(""))


def fold_turkish(text: Column) -> Column:
    """Trimmed, in lower case and without Turkish letters; empty for null."""
    return F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), TURKISH, FOLDED)


def size_list(raw: Column) -> Column:
    """The sizes of a JSON list of (name, size, in_stock); an empty list for null, empty or broken text and for anything that isn't a list."""
    entry = "array<struct<name:string,size:string,in_stock:boolean>>"
    listed = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, entry))
    return F.coalesce(listed, F.array().cast(entry))


def normalize_query(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal, 0.7 where one holds the other, else 0."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.7).otherwise(0.0)


def brand_of(name: Column) -> Column:
    """The first word of a name."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^\s*(\S+)", 1), F.lit("")), F.lit("Bilinmeyen"))


def model_of(name: Column) -> Column:
    """What follows a name's first word."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^\s*\S+\s+(.*\S)", 1), F.lit("")), F.lit("Model"))


def mask_token(token: Column) -> Column:
    """Hides all but the ends of a secret; all of a short one."""
    return F.when(F.coalesce(token, F.lit("")) == "", "").when(F.length(token) <= 8, "***").otherwise(F.concat(F.substring(token, 1, 4), F.lit("..."), F.substring(token, -4, 4)))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def strip_query(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def is_product_link(url: Column, pattern: str | None = None) -> Column:
    """The shop's pattern, or a path of over 25 characters with three dashes or more."""
    path = url_path(url)
    return F.rlike(url, F.lit(pattern)) if pattern else (F.length(path) - F.length(F.replace(path, F.lit("-"), F.lit(""))) >= 3) & (F.length(path) > 25)


def search_url(template: str, query: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{q}"), F.url_encode(query))


def skip_link(href: Column) -> Column:
    return F.rlike(href, F.lit("^(#|javascript|mailto)"))


def bot_challenge(html: Column) -> Column:
    head = F.lower(F.substring(html, 1, 8000))
    found = F.lit(False)
    for token in CHALLENGE_TOKENS:
        found = found | head.contains(token)
    return F.coalesce(found, F.lit(False))


def usable_image(url: Column) -> Column:
    low = F.lower(url)
    bad = F.lit(False)
    for token in BAD_IMAGE_TOKENS:
        bad = bad | low.contains(token)
    return F.coalesce(~bad & ~(low.endswith(".svg") & ~low.contains("product")), F.lit(False))


def fetch_status(message: Column) -> Column:
    """blocked (403, 429), timeout, missing (404) or error."""
    low = F.lower(message)
    return F.when(F.rlike(low, F.lit("403|429")), "blocked").when(low.contains("timeout"), "timeout").when(low.contains("404"), "missing").otherwise("error")


def drop_percent(last: Column, now: Column) -> Column:
    return F.round((last - now) / last * 100, 0)


def price_type(cart_price: Column) -> Column:
    return F.when(F.coalesce(cart_price, F.lit(0.0)) != 0, "Sepet indirimi").otherwise("Normal fiyat")


def money_text(value: Column) -> Column:
    """Two decimals, dots for thousands, a comma, TL; a dash for null."""
    return F.coalesce(F.concat(F.translate(F.format_number(value, 2), ",.", ".,"), F.lit(" TL")), F.lit("—"))


def date_text(instant: Column) -> Column:
    """Day, month, year, hour and minute; a dash for null."""
    return F.coalesce(F.date_format(instant, "dd.MM.yyyy HH:mm"), F.lit("—"))


def same_family(a: Column, b: Column) -> Column:
    """False only for two known families that differ."""
    return ~F.coalesce(a != b, F.lit(False))


# Fields of a buyer's profile, and how they are called.
PROFILE_LABELS = {"weight": "Kilo", "target_weight": "Hedef kilo", "shoe_size": "Ayakkabi numarasi", "foot_notes": "Ayak yapisi notlari", "usage": "Kullanim amaci", "priorities": "Oncelikler", "notes": "Ek notlar"}


def profile_text(fields: dict[str, Column]) -> Column:
    """A line for each field that is set, under a heading; empty if none is."""
    lines = F.array_compact(F.array(*[F.when(F.coalesce(fields[k], F.lit("")) != "", F.concat(F.lit(f"{label}: "), fields[k])) for k, label in PROFILE_LABELS.items() if k in fields]))
    return F.when(F.size(lines) > 0, F.concat(F.lit("\n\nKullanici profili:\n"), F.array_join(lines, "\n"))).otherwise("")


def suggested_models(answer: Column) -> Column:
    """The models that an answer's last line suggests: between bars, trimmed, of 3 to 59 characters."""
    parts = F.transform(F.split(F.regexp_extract(answer, r"(?i)\[MODELLER\]:?\s*([^\n]+)", 1), r"\|"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) > 2) & (F.length(s) < 60))


def stock_text(in_stock: Column, total: Column, any_stock: Column) -> Column:
    return F.when(total > 0, F.concat(in_stock.cast("string"), F.lit("/"), total.cast("string"), F.lit(" beden"))).when(any_stock, "Stokta").otherwise("Belirsiz")


def chunks(text: Column, size: int = 260) -> Column:
    """The text in pieces of `size` characters; none for an empty one."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
