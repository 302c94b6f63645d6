"""The shop catalog, and which shop a URL belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, slug, host parts, product link pattern (None: the general rule), searched by a browser, fetched by a browser; first match wins.
SHOPS = (
    ("Decathlon", "decathlon", ("decathlon.com.tr",), None, False, False),
    ("Adidas Türkiye", "adidas", ("adidas.com.tr",), r"/[A-Z]{2}\d{4}\.html", True, True),
    ("Nike TR", "nike", ("nike.com",), "/t/", False, False),
    ("Puma TR", "puma", ("tr.puma.com", "puma.com"), r"/pd/|\.html/?$", True, False),
    ("New Balance TR", "newbalance", ("newbalance.com.tr",), "/urun/", False, False),
    ("Sportive", "sportive", ("sportive.com.tr",), None, False, False),
    ("Intersport", "intersport", ("intersport.com.tr",), "/urun/", False, False),
    ("Barçın", "barcin", ("barcin.com",), None, True, False),
    ("Korayspor", "korayspor", ("korayspor.com",), None, False, False),
    ("FLO", "flo", ("flo.com.tr",), None, True, False),
    ("SuperStep", "superstep", ("superstep.com.tr",), None, True, False),
    ("Sneaks Up", "sneaksup", ("sneaksup.com",), None, False, False),
    ("Yalı Spor", "yalispor", ("yalispor.com.tr",), None, False, False),
    ("Boyner", "boyner", ("boyner.com.tr",), None, False, False),
    ("SPX", "spx", ("spx.com.tr",), None, True, False),
    ("Kutupayısı", "kutupayisi", ("kutupayisi.com",), None, True, False),
    ("Trendyol", "trendyol", ("trendyol.com",), r"-p-\d+", False, False),
    ("Hepsiburada", "hepsiburada", ("hepsiburada.com",), "-p[m]?-[A-Z0-9]+", False, False),
    ("n11", "n11", ("n11.com",), "/urun/", False, False),
    ("Amazon TR", "amazon", ("amazon.com.tr",), "/dp/", False, False),
    ("ASICS TR", "asics", ("asics.com.tr", "asics.com"), "/[0-9]{3,}", True, True),
    ("Skechers TR", "skechers", ("skechers.com.tr",), "/p-", True, True),
)


def shops(spark: SparkSession) -> DataFrame:
    rows = [(i, n, s, list(d), p, js, br) for i, (n, s, d, p, js, br) in enumerate(SHOPS)]
    return spark.createDataFrame(rows, "ordinal int, name string, slug string, domains array<string>, product_pattern string, js_search boolean, use_browser boolean")


def with_own(*own: tuple[str, list[str]]) -> list[tuple[int, str, list[str]]]:
    """Shops for :func:`route`: own ones (name, domains), in their order, before those of the catalog."""
    every = [*own, *[(s[0], list(s[2])) for s in SHOPS]]
    return [(i, name, list(domains)) for i, (name, domains) in enumerate(every)]


def route(urls: DataFrame, known: list[tuple[int, str, list[str]]] | None = None, host: str = "host") -> DataFrame:
    """urls with `store`: the first shop one of whose domains is part of the host, else the host itself.

    The catalog is a few fixed rows, so the match is a chain of conditions in the projection: no join at all.
    """
    found = None
    for _, name, domains in sorted(known if known is not None else [(i, s[0], list(s[2])) for i, s in enumerate(SHOPS)]):
        here = F.lit(False)
        for d in domains:
            here = here | F.col(host).contains(d)
        found = F.when(here, name) if found is None else found.when(here, name)
    return urls.withColumn("store", found.otherwise(F.col(host)) if found is not None else F.col(host))
