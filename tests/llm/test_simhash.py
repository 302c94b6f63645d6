import numpy as np
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import common, components, simhash

from .data import SF, documents, empty


def brute(rows, most=2):
    def fingerprint(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [fingerprint(t) for _, t in rows]
    p = np.array(prints, dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= most):
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(docs):
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")), "component_id")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_equals_brute_force(spark):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(empty(spark)) == []


def test_chains_of_close_fingerprints_link(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 6, dtype=np.int64)
    rows, expect, n = [], {}, 0
    for b in base:
        x, first = int(b), n
        for _ in range(300):  # a chain: each differs from the last in two bits
            rows.append((n, x))
            expect[n] = first
            n += 1
            x ^= (1 << int(r.integers(0, 63))) | (1 << int(r.integers(0, 63)))
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, f0 long"), 1, 2, 2)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert all(found[d] <= expect[d] for d in found)
    assert len(set(found.values())) <= len(base)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 300), (7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 400: 300, 500: 300, 901: 900}


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    edges = spark.range(1, 5000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(spark.range(6000, 9000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 3 <> 0"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 5000))
    assert all(got[i] == i - (i - 1) % 3 for i in range(6002, 9000) if i % 3 != 1)
