import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import common, quality, queries

from .data import SF, documents, empty

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(w, seed=42):
    return xxhash.xxh64(w.encode(), seed=seed).intdigest()


def long_hash(value, seed):
    return xxhash.xxh64((value & M).to_bytes(8, "little"), seed=seed).intdigest()


def chain(*values):
    h = 42
    for v in values:
        h = long_hash(v, h)
    return h


def brute(rows, trusted):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    grams = []
    for w in words:
        h = [word_hash(x) for x in w]
        grams.append([signed(x) % quality.BUCKETS for x in [*h, *(chain(a, b) for a, b in zip(h, h[1:]))]])
    raw, target = Counter(), Counter()
    for (d, _), g in zip(rows, grams):
        raw.update(g)
        if d in trusted:
            target.update(g)
    r, t = raw.total(), target.total()
    p = lambda b: (raw[b] + 1) / (r + quality.BUCKETS)
    weight = {b: math.log((target[b] + quality.PRIOR * p(b)) / (t + quality.PRIOR) / p(b)) for b in raw}
    out = []
    for (d, text), w, g in zip(rows, words, grams):
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        llr = sum(weight[b] for b in g) / len(g) if g else 0.0
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= quality.THRESHOLD, llr))
    return out


def test_query_equals_brute_force(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = quality.judge(docs.drop("kept"), quality.fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr").collect()
        want = brute([(r.doc_id, r.text) for r in docs.collect()], trusted)
        assert sorted((tuple(r)[:8] for r in got), key=str) == sorted((w[:8] for w in want), key=str)
        assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(r.llr for r in got), sorted(w[8] for w in want)))


def test_empty_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.judge(empty(spark), quality.fit(empty(spark), labels)).collect() == []
    docs = documents(spark).drop("kept")
    none = quality.judge(docs, quality.fit(docs, labels.limit(0))).select("base_failed", "kept").collect()
    assert all(r.kept == (not r.base_failed) for r in none)


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = queries.op1_quality_rules(spark, sf).join(labels, "doc_id").where("not base_failed")
    rate = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.2


def test_many_labels_give_the_same_model(spark, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (-5, 1, 0)], "doc_id long, quality int, toxic int").select(F.col("doc_id"), "quality", "toxic"))
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet"), empty(spark)):
        few = quality.fit(docs, labels).first().w
        with monkeypatch.context() as m:
            m.setattr(common, "BROADCAST_ROWS", 1)
            many = quality.fit(docs, labels).first().w
        assert few == many


def test_bitmaps_flag_every_key(spark):
    rows = spark.range(200_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    keys = rows.where("id % 7 = 0").select(F.col("h").alias("k"))
    seen = common.flagged(rows, F.col("h"), keys).groupBy((F.col("id") % 7 == 0).alias("own")).agg(F.count("*").alias("n"), F.count_if("_maybe").alias("maybe")).collect()
    n = {r.own: (r.n, r.maybe) for r in seen}
    assert n[True][0] == n[True][1] == 28572 and n[False][0] == 171428 and 0 < n[False][1] < 171428 / 8
    assert common.flagged(rows, F.col("h"), keys.limit(0)).where("_maybe").isEmpty()
