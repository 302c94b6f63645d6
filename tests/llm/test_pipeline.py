import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import common, decontam, fairmix, simhash, stages

from .data import SF, documents, empty


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        rows = docs.collect()
        assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
        assert all(r == given[r.doc_id] for r in rows)
        if name != "mixing":
            assert max(Counter(r.doc_id for r in rows).values()) == 1
        else:
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in rows)
    again = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in last)
    written = corpus_pipeline.write(spark, SF, str(tmp_path / "shards")).select("row.*", "shard").collect()
    assert Counter((r.doc_id, r.shard) for r in written) == Counter((r.doc_id, r.shard) for r in last)
    assert all(r.text == given[r.doc_id].text for r in written)


def test_one_of_each_group_of_copies_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    kept = {r.doc_id for r in stages.near_duplicates(spark, docs, SF).collect()}
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert kept <= set(first.values())
    # a document that shares no five-word shingle with a smaller id stays
    seen, clean = set(), set()
    for r in sorted(rows, key=lambda r: r.doc_id):
        own = set(simhash.shingles_of(simhash.words_of(r.text), 5))
        if len(simhash.words_of(r.text)) >= 50 and not own & seen:
            clean.add(r.doc_id)
        seen |= own
    assert clean and clean <= kept


def similar_classes(texts):
    """The number of each text's class, by brute force over sets of five-word shingles."""
    sets = [frozenset(simhash.shingles_of(simhash.words_of(t), 5)) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def awkward(spark):
    """documents() with ids of several different texts, equal rows, rows that differ in another column only, and null ids."""
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randint(0, 900)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(9001, a), (9005, a), (9005, b), (9007, c), (9007, text()), (9007, c), (None, a), (None, text()), (None, b), (None, text()), (None, None), (9009, "")]
    rows += [(9010, text())] * 5
    more = spark.createDataFrame([(i, t, "en", "s1", 0, f"x{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs = documents(spark).unionByName(more)
    return docs.withColumns({"_row": F.lit(1), "t": F.lit("t"), "g": F.create_map(F.lit("k"), F.lit(2)), "_h": F.lit(3)})


@pytest.mark.parametrize("most", [500_000, 1])
def test_one_row_of_each_class_stays(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    docs = awkward(spark)
    rows = docs.drop("g").collect()
    of = similar_classes([r.text for r in rows])
    first = {}
    for r, c in zip(rows, of, strict=True):
        key = (r.doc_id is None, r.doc_id or 0)
        first[c] = min(first.get(c, key), key)
    out = stages.near_duplicates(spark, docs, SF)
    kept = out.drop("g").collect()
    assert out.columns == docs.columns
    assert all(r in rows for r in kept)
    classes = [next(c for x, c in zip(rows, of, strict=True) if x == r) for r in kept]
    assert sorted(classes) == sorted(set(of))
    assert all((r.doc_id is None, r.doc_id or 0) == first[c] for r, c in zip(kept, classes, strict=True))


@pytest.mark.parametrize("most", [500_000, 1])
def test_contaminated_rows_go_and_no_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    docs = awkward(spark)
    passage = [f"p{i}" for i in range(20)]
    bad = docs.limit(1).select(*[F.lit(" ".join(["some", "words", *passage, "more"])).alias(c) if c == "text" else F.lit(None).cast(t).alias(c) if c == "doc_id" else c for c, t in docs.dtypes])
    bad = bad.unionByName(bad.withColumn("doc_id", F.lit(9005).cast("long")))
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, "w1"), (3, None)], "item_id long, text string")
    kept = decontam.clean(docs.unionByName(bad), bench, 4)
    same = lambda df: Counter(map(str, df.drop("g").collect()))
    assert kept.columns == docs.columns and same(kept) == same(docs)


@pytest.mark.parametrize("most", [500_000, 1])
def test_mixing_takes_what_the_mix_takes(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    docs = awkward(spark)
    many = spark.createDataFrame([(None, f"one two three four five{i // 3}", "s9") for i in range(24)] + [(7, "six of one and half", "s9")] * 7, "doc_id long, text string, source string")
    for given in (docs, many):
        out = stages.mixing(spark, given, SF)
        assert out.columns == given.columns
        rows = Counter((r.doc_id, r.text, r.source) for r in given.collect())
        got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
        assert all(got[k] <= 2 * rows[k] for k in got) and set(got) <= set(rows)
        words = lambda t: len(simhash.words_of(t))
        total = sum(words(t) * n for (_, t, _), n in rows.items())
        taken = fairmix.mix(given).agg(F.sum("taken")).first()[0]
        assert sum(words(t) * n for (_, t, _), n in got.items()) == taken <= 1.5 * total


def test_sharding_places_every_row(spark):
    docs = awkward(spark)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_other_kinds_of_ids_and_sources(spark):
    docs = documents(spark).withColumns({"doc_id": F.concat(F.lit("d"), F.col("doc_id")), "source": F.length("source")})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count()


def test_empty_tables_pass(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty(spark), SF)
        assert out.count() == 0 and out.columns == empty(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), SF).count() == 0


def test_quality_stage_applies_its_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = stages.quality_rules(spark, docs, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = kept.join(labels, "doc_id").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count("*").alias("n")).first()
    assert left.n > 250 and left.bad <= 6
