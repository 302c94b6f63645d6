"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics (lengths, shares of kinds of characters, repetition), transformed to
be roughly normal. For each label the mean and the covariance are taken over all labelled rows, as sums that
partitions add up; covariances are shrunk towards their pooled diagonal. A score is the posterior of label 1 from
the difference of the two Mahalanobis log-densities, with Cholesky factors that are taken once.

Defined results: a null or empty text has the statistics of no characters and is scored like any other; labels
other than 0 and 1 teach nothing; a label that occurs more than once for an id counts each time; with labels of one
value only (or none) every score is the smoothed share of label 1; repeated rows repeat their result; no rows give
no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

STATISTICS = (
    "chars", "words", "word_length", "word_length_spread", "letters", "upper", "digits", "symbols", "bangs", "bars",
    "other_punctuation", "spaces", "distinct_words", "commonest_word", "lines", "distinct_lines", "line_length", "marked_words",
)
#: Share of the pooled diagonal in each class's covariance, and what is added to every variance.
SHRINK, FLOOR = 0.1, 1e-4
CUT = 0.3

_KIND = np.full(128, 6, np.uint8)  # other punctuation
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[ord(c) for c in "#*$%&<>"]] = 3
_KIND[ord("!")] = 4
_KIND[ord("|")] = 5
_KIND[[32, *range(9, 14)]] = 7
_MARKS = b"#*$%&<>!|"


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[b[b < 128]] if len(b := np.frombuffer(raw, np.uint8)) else np.zeros(0, np.uint8), minlength=8).astype(float)
    beyond = len(text) - kinds.sum()
    letters, chars = kinds[0] + kinds[1] + beyond, len(text)
    words = raw.split()
    lengths = np.fromiter(map(len, words), float, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = Counter(words)
    share = lambda part, whole: np.arcsin(np.sqrt((part + 0.5) / (whole + 1.0))) if part <= whole else np.pi / 2
    marked = sum(n for w, n in count.items() if w[-1] in _MARKS)
    return np.array([
        np.log1p(chars), np.log1p(len(words)), np.log1p(lengths.mean() if len(words) else 0.0), np.log1p(lengths.std() if len(words) else 0.0),
        share(letters, chars), share(kinds[1], letters), share(kinds[2], chars), share(kinds[3], chars), share(kinds[4], chars), share(kinds[5], chars),
        share(kinds[6], chars), share(kinds[7], chars), share(len(count), len(words)), share(max(count.values(), default=0), len(words)),
        np.log1p(len(lines)), share(len(set(lines)), len(lines)), np.log1p(len(words) / max(1, len(lines))), share(marked, len(words)),
    ])


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t.as_py()) for t in part.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_col]}, x array<double>")


@dataclass
class Model:
    prior: float  # log odds of label 1
    means: list[np.ndarray]
    factors: list[np.ndarray]  # lower Cholesky factors of the covariances

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for rows of statistics."""
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = self.prior + (logs[1] - logs[0] if logs else np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(measured: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> Model:
    """From measured(doc_id, x) and labels(doc_id, label): the sums that both classes need are added up on executors."""
    d = len(STATISTICS)
    known = labels.where("label in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    joined = measured.join(known, F.col("doc_id") == F.col("_id")).select("label", "x")

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for part in parts:
            x, y = np.array(part.column(1).to_pylist(), float).reshape(-1, d), np.array(part.column(0))
            for label, t in total.items():
                own = x[y == label]
                t += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0], total[1]], pa.list_(pa.float64()))], ["label", "s"])

    added = joined.mapInArrow(sums, "label int, s array<double>").select("label", F.posexplode("s").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in added:
        total[r["label"], r["i"]] = r["v"]
    n = total[:, 0]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Model(prior, [], [])
    means = [total[k, 1 : d + 1] / n[k] for k in (0, 1)]
    covariances = [total[k, d + 1 :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.diag(n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()) + FLOOR * np.eye(d)
    return Model(prior, means, [np.linalg.cholesky((1 - shrink) * c + shrink * pooled + FLOOR * np.eye(d)) for c in covariances])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def score(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of measured rows."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = model.score(np.array(part.column(2).to_pylist(), float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64()), pa.array((found >= CUT).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(measured.dtypes)["doc_id"]
    return measured.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(each, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from labels(doc_id, quality) of rows that are not held out, and scores every row of docs."""
    measured = cut(measure(docs, id_col, text))
    return score(measured, fit(measured, labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))))
