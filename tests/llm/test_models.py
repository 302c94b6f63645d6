import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import langid, qda, queries

from .data import SF, documents, empty


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 8, 20, 100):
        code = langid.codewords(n).astype(int)
        assert code.shape[0] == n and not any(abs(c.sum()) == n for c in code.T)
        if n > 2:
            apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
            assert apart >= code.shape[1] / 4


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_language_codes(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97


def test_language_edge_cases(spark):
    docs = documents(spark)
    found = langid.predict(docs, langid.learn(docs, ~langid.held_out(), sample=20)).collect()
    assert len(found) == docs.count()
    got = {r.doc_id: r for r in found}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 6))
    assert all(r.lang_pred in ("en", "de", "und") for r in found)
    none = langid.learn(empty(spark), ~langid.held_out())
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty(spark), none).collect() == []
    one = langid.fit(["a b", "c"], ["en", "en"])
    assert one.predict("zzz") == ("en", 1.0, False) and one.predict("123") == ("und", 0.0, False)
    two = langid.fit(["der die das und"] * 3 + ["the of and to"] * 3, ["de"] * 3 + ["en"] * 3)
    assert two.predict("the of the")[0] == "en" and two.predict("das und das")[0] == "de"
    assert two.predict("der die das und the of and to")[2] and not two.predict("the of the")[2]


def test_language_that_is_nearly_all_copies(spark, monkeypatch):
    texts = [f"bonjour le monde numéro {i}" for i in range(30)]
    rows = [(t, "fr") for t in texts] + [("la même page", "fr")] * 3000 + [(f"12 {i}", "fr") for i in range(3000)] + [(f"the world and {i} of it", "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("h", F.xxhash64("text"))
    least = {v: [r.text for r in docs.where(F.col("lang") == v).where("text not like '12 %'").distinct().orderBy("h").limit(20).collect()] for v in ("en", "fr")}
    taken, fit = {}, langid.fit_features
    monkeypatch.setattr(langid, "fit_features", lambda x, langs: taken.update({v: [tuple(t) for t, w in zip(x, langs, strict=True) if w == v] for v in set(langs)}) or fit(x, langs))
    model = langid.learn(docs, F.lit(True), sample=20)
    assert taken == {v: [tuple(langid.features(t)) for t in texts] for v, texts in least.items()} and model.predict("le monde")[0] == "fr"


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_quality_discriminant(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99


def test_discriminant_is_that_of_the_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows, known = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    measured = qda.measure(docs)
    model = qda.fit(measured, labels.withColumnRenamed("quality", "label"))
    x = {r.doc_id: qda.statistics(r.text) for r in rows}
    groups = [np.array([x[d] for d, q in known.items() if q == k]) for k in (0, 1)]
    pooled = sum(len(g) * g.var(axis=0) for g in groups) / sum(map(len, groups)) + qda.FLOOR
    logs = []
    for g in groups:
        cov = 0.9 * np.cov(g.T, bias=True) + 0.1 * np.diag(pooled) + qda.FLOOR * np.eye(g.shape[1])
        d = np.array([x[r.doc_id] for r in rows]) - g.mean(axis=0)
        logs.append(-0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = np.log((len(groups[1]) + 1) / (len(groups[0]) + 1)) + logs[1] - logs[0]
    got = {r.doc_id: r.score for r in qda.score(measured, model).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], 1 / (1 + np.exp(-np.clip(odds, -500, 500))), atol=1e-6)


def test_quality_edge_cases(spark):
    docs, labels = documents(spark), spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    rows = qda.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in qda.classify(docs, labels.where("quality = 1 and doc_id is not null")).collect()} and qda.classify(empty(spark), labels).collect() == []
    assert {r.score for r in qda.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_codewords_decode_as_by_hand():
    r = np.random.default_rng(4)
    for n in (2, 3, 5, 7, 9, 12):
        code = langid.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1, 1}
        assert len({tuple(c) for c in code}) == n and not any(abs(c.sum()) == n for c in code.T)
        assert not any((a == b).all() or (a == -b).all() for i, a in enumerate(code.T) for b in code.T[:i])
        size = len(langid.ORDERS) * langid.BUCKETS
        model = langid.Model([f"l{i}" for i in range(n)], code, r.normal(size=(code.shape[1], size)).astype(np.float32), r.normal(size=code.shape[1]))
        for text in ("a few words", "ein Satz mit Ümlaut", "x", "abc " * 500):
            margin = [float(w.astype(np.float64) @ langid.features(text).astype(np.float64) + b) for w, b in zip(model.weights, model.bias, strict=True)]
            loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margin, strict=True)) / len(margin) for word in code.tolist()]
            best, second = sorted(range(n), key=lambda i: loss[i])[:2]
            lang, score, ambiguous = model.predict(text)
            assert lang == f"l{best}" and 0 <= score <= 1
            assert abs(score - 1 / sum(math.exp(-(v - loss[best]) * len(margin)) for v in loss)) < 1e-3
            assert ambiguous == (loss[second] - loss[best] < langid.AMBIGUOUS)
        # a bit that is wrong in a code of distance 3 or more does not change the answer
        distance = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        for bit in range(code.shape[1] if distance >= 3 else 0):
            word = code[0].astype(float)
            word[bit] *= -1
            assert np.argmin(np.logaddexp(0, -code * word * 4).mean(axis=1)) == 0


def test_fitted_texts_are_those_of_least_hash(spark, monkeypatch):
    rows = [(i, "ein und derselbe Satz" if i % 3 else f"satz nummer {i}", "de") for i in range(3000)] + [(i, f"sentence number {i % 40}", "en") for i in range(3000, 3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "fit_features", lambda x, langs: seen.update(x=x, langs=langs))
    langid.learn(docs, F.lit(True), sample=25)
    hashes = {(r.lang, r.text): r.h for r in docs.select("lang", "text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = [langid.features(t) for lang in ("de", "en") for _, t in sorted((h, t) for (v, t), h in hashes.items() if v == lang)[:25]]
    assert seen["langs"] == ["de"] * 25 + ["en"] * 25 and np.allclose(seen["x"], np.stack(want))
