"""Language identification by error-correcting output codes.

Every language has a binary codeword. One linear classifier for each bit of the code, over hashed character
n-grams, predicts that bit; a text goes to the language whose codeword has the least loss summed over the bits
(loss-weighted decoding with the logistic loss), and is flagged as ambiguous if the second-best codeword is close.

Fitting takes at most SAMPLE labelled texts for each language, those of least hash of the text; that bound is the
only one: predictions read every text whole.

Defined results: a null text, or one without a letter, is `und` with score 0; a null label teaches nothing; with
no label at all every text is `und`; one language only is always that language; repeated rows repeat their result;
no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

#: Labelled texts for each language that fitting reads at most.
SAMPLE = 250
#: Buckets for the n-grams of each order.
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Rounds and step of the gradient descent, and its ridge.
ROUNDS, STEP, RIDGE = 150, 2.0, 1e-4
#: A decision is ambiguous below this difference of mean loss between the two nearest codewords.
AMBIGUOUS = 0.5
UNKNOWN = "und"
_BLOCK = 1 << 16


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the hashed n-grams' shares, of norm 1 over each order; texts of any length go in blocks."""
    points, out = _points(text), np.zeros(len(ORDERS) * BUCKETS, np.float32)
    for k, n in enumerate(ORDERS):
        counts = np.zeros(BUCKETS, np.int64)
        for i in range(0, max(0, len(points) - n + 1), _BLOCK):
            block = points[i : i + _BLOCK + n - 1]
            h = np.zeros(len(block) - n + 1, np.uint32)
            for j in range(n):
                h = (h ^ block[j : j + len(h)]) * np.uint32(2654435761)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        if total := counts.sum():
            out[k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(counts / total)
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 / -1, far from each other and without constant or repeated columns: all 2^(n-1) - 1 splits up to 7 languages, else columns drawn by a fixed rule."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        columns = [[1] + [1 if i >> b & 1 else -1 for b in range(n - 1)] for i in range((1 << (n - 1)) - 1)]
    else:
        r, columns = np.random.default_rng(n), []
        while len(columns) < 10 * int(np.ceil(np.log2(n))):
            column = r.permutation([1] * (n // 2) + [-1] * (n - n // 2)).tolist()
            if column not in columns and [-x for x in column] not in columns:
                columns.append(column)
    return np.array(columns, np.int8).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x features
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = self.weights @ features(text) + self.bias
        loss = np.logaddexp(0, -self.code * margin).mean(axis=1)
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-(loss - loss[order[0]]) * self.code.shape[1])
        return self.languages[order[0]], float(1 / likely.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from texts and their languages."""
    return fit_features(np.array([features(t) for t in texts], np.float32), langs)


def fit_features(x: np.ndarray, langs: list[str]) -> Model:
    """A classifier for each bit from rows of features, by full-batch gradient descent on the logistic loss; languages weigh the same."""
    known = sorted(set(langs))
    code = codewords(len(known))
    if len(known) < 2:
        return Model(known, code, np.zeros((1, len(ORDERS) * BUCKETS), np.float32), np.zeros(1))
    row = np.array([known.index(v) for v in langs])
    weight = (1.0 / np.bincount(row, minlength=len(known)))[row].astype(np.float32) / len(known)
    y = code[row].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(ROUNDS):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * weight[:, None]
        dw, db = 0.9 * dw + x.T @ pull + RIDGE * w, 0.9 * db + pull.sum(axis=0)
        w -= STEP * dw
        b -= STEP * db
    return Model(known, code, np.ascontiguousarray(w.T), b.astype(np.float64))


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` usable texts of each language, equal texts once: those of least hash.

    A language's distinct texts with a letter are counted first, by their hashes; only those in the lowest share of
    hashes that holds twice the sample on average go further, so neither sorting nor shuffling of texts grows with the
    corpus, and copies of a text take no other's place.
    """
    given = docs.where(usable & F.col(lang).isNotNull() & F.rlike(F.col(text), F.lit(r"\p{L}"))).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    counts, _ = small(given.groupBy(F.col("l").alias("_l")).agg(F.count_distinct(F.xxhash64("t")).alias("_n")))
    hashed = given.withColumn("h", F.xxhash64("t"))
    near = hashed.join(counts, F.col("l") == F.col("_l")).where((F.col("h") / 2.0**64 + 0.5) * F.col("_n") <= 2 * sample).select("l", "h", "t").dropDuplicates(["l", "h"])
    least = near.withColumn("_r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("_r") <= sample)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [features(t.as_py()) for t in part.column(2)]
            at = [np.flatnonzero(x).astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(found, at, strict=True)], pa.list_(pa.float32()))], ["l", "h", "at", "x"])

    # the driver gets vectors, which are bounded, of at most `sample` texts a language, never texts
    rows = least.select("l", "h", "t").mapInArrow(each, "l string, h bigint, at array<int>, x array<float>").collect()
    rows.sort(key=lambda r: (r["l"], r["h"]))
    x = np.zeros((len(rows), len(ORDERS) * BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["x"]
    return fit_features(x, [r["l"] for r in rows])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of each row; the model goes out with the function, by broadcast if it is large."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [model.predict(t.as_py()) for t in part.column(2)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("_text")).mapInArrow(each, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
