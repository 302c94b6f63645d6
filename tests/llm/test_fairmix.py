import pytest
from pyspark.sql import functions as F

from shelfspark.llm import common, fairmix

from .data import SF, documents, empty


def targets(sizes, weights=(3, 1, 2)):
    """Shares by rounds: who is above its cap is set to it, the excess goes to the others by weight."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = fairmix.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes = {}
        for r in rows:
            sizes[r._source] = sizes.get(r._source, 0) + r.size
        want = targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r._source] and r.target == pytest.approx(want[r._source])
            assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert sum(r.taken for r in rows) <= 1.5 * sum(sizes.values())
        largest = max(r.size for r in rows)
        for s in sizes:
            taken = sum(r.taken for r in rows if r._source == s)
            assert abs(taken - want[s]) <= 2 * largest
        again = fairmix.mix(docs.repartition(5)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert fairmix.mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in fairmix.mix(blank).collect()] == [(0.0, 0)] * 2


def test_running_total_over_a_hot_part(spark):
    rows = spark.range(5000).select((F.col("id") % 50 == 0).cast("int").alias("p"), (F.col("id") * 7919 % 5000).alias("o"), F.lit(1).cast("long").alias("v")).withColumn("b", F.floor(F.col("o") / 100))
    got = common.running_total(rows, ["p"], "b", ["o"], "v", "t").orderBy("p", "o").collect()
    for p in (0, 1):
        own = [r.t for r in got if r.p == p]
        assert own == list(range(1, len(own) + 1))
