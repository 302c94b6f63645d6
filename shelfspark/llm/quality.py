"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into a fixed number of buckets. Two smoothed multinomials over the buckets
are counted, one from the trusted documents (its prior is the raw one) and one from all. A document's score is the mean over its
n-grams of log(p_target / p_raw); documents below a fixed threshold are rejected, each by itself.
Everything is a DataFrame expression: no Python runs on executors.

Defined results: a null or empty text has no words and fails the base rules; rows are judged one by one, so
repeated rows repeat their result; an empty corpus or an empty target gives uniform multinomials (score 0 for
each n-gram, nothing rejected by score); other columns of the input are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, small, word_list

#: Buckets of the multinomials; the model is this many doubles, at any corpus size.
BUCKETS = 8192
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.03
#: N-grams of prior, dealt as the raw corpus is, that are added to the target's counts: a few trusted documents alone move nothing.
PRIOR = 64 * BUCKETS
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"


def _n_repeat_words(windows: Column) -> Column:
    """Words covered by three-word windows whose hash occurs twice or more, from the windows' hashes in order."""

    def covered(ordered: Column) -> Column:
        twice = F.transform(ordered, lambda s, k: F.when((F.get(ordered, k - 1)["h"] == s["h"]) | (F.get(ordered, k + 1)["h"] == s["h"]), s["i"]))
        return F.transform(F.array(F.array_sort(F.array_compact(twice))), lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda x, y: x + y))[0]

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.transform(F.array(ordered), covered)[0]).otherwise(F.lit(0)).cast("long")


def _with_hashes(docs: DataFrame, text: str) -> DataFrame:
    """Adds _words and _h, the words' 64-bit hashes."""
    out = docs.withColumn("_words", word_list(F.col(text)))
    return out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def _pairs_of(h: Column) -> Column:
    return F.when(F.size(h) > 1, F.transform(F.slice(h, 1, F.size(h) - 1), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ngram_counts(docs: DataFrame, trusted: Column, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_raw, n_target) over all rows of docs, whose rows with `trusted` are the target."""
    hashed = _with_hashes(docs.select(F.col(text), F.coalesce(trusted, F.lit(False)).alias("_trusted")), text)
    each = hashed.select("_trusted", F.explode(F.concat("_h", _pairs_of(F.col("_h")))).alias("h"))
    return each.groupBy(_bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("n_raw"), F.count_if("_trusted").alias("n_target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, one column `w`: the buckets' log(p_target / p_raw) in order of bucket; raw add-one smoothed, target by PRIOR."""
    full = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["n_raw", "n_target"])
    one = full.agg(F.sum("n_raw").alias("r"), F.sum("n_target").alias("t"), F.array_sort(F.collect_list(F.struct("bucket", "n_raw", "n_target"))).alias("a"))
    raw = lambda x: (x["n_raw"] + 1.0) / (F.col("r") + buckets)
    return one.select(F.transform("a", lambda x: F.log((x["n_target"] + PRIOR * raw(x)) / (F.col("t") + PRIOR) / raw(x))).alias("w"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The one-row model: trusted are the documents that `labels` marks with quality 1.

    Few trusted ids are broadcast; with many, all documents are counted without meeting them, and those that a
    bitmap of the ids flags are shuffled to be counted as trusted.
    """
    ids, fits = small(labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct())
    given, same = docs.select(F.col(id_col).alias("_doc"), F.col(text)), F.col("_doc") == F.col("_id")
    if fits:
        return log_ratios(ngram_counts(given.join(ids, same, "left"), F.col("_id").isNotNull(), text, buckets), buckets)
    likely = flagged(given, F.xxhash64(F.col("_doc").cast("string")), ids.select(F.xxhash64(F.col("_id").cast("string")).alias("k"))).where("_maybe")
    target = ngram_counts(likely.join(ids, same), F.lit(True), text, buckets).select("bucket", "n_target")
    raw = ngram_counts(given, F.lit(False), text, buckets).select("bucket", "n_raw")
    return log_ratios(raw.join(target, "bucket", "left"), buckets)


def judge(docs: DataFrame, model: DataFrame, text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept; rows keep their other columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    h = F.col("_h")
    windows = F.when(F.size(h) > 2, F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    measured = _with_hashes(docs, text).withColumns({"_win": windows, "_two": _pairs_of(h), "_lines": lines, "_w": model.select("w").scalar()})
    n = F.col("n_words")
    add = lambda grams: F.aggregate(grams, F.lit(0.0), lambda s, x: s + F.coalesce(F.get(F.col("_w"), _bucket(x, buckets)), F.lit(0.0)))
    measured = measured.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS.replace("[", "[^") + "+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _n_repeat_words(F.col("_win")),
        "llr": F.coalesce(F.try_divide(add(h) + add(F.col("_two")), F.size(h) + F.size("_two")), F.lit(0.0)),
    })
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * n)
    judged = measured.withColumns({"base_failed": failed, "kept": ~failed & (F.col("llr") >= threshold)}).drop("_words", "_h", "_win", "_two", "_lines", "_w")
    # A generator as the last step: a caller's filter on a verdict would else be pushed below, and into, the steps
    # that make it, and so make every hash again for each word.
    return judged.select(F.inline_outer(F.array(F.struct(*judged.columns))))
