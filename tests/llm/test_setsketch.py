import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import setsketch, stages
from shelfspark.llm.simhash import shingles_of, words_of

from .data import SF, documents, empty


def sets_of(texts):
    return [set(shingles_of(words_of(t), 5)) for t in texts]


def brute(rows, percent):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, by all pairs."""
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(docs, percent=85):
    return sorted((tuple(r) for r in setsketch.near_copies(docs, percent).collect()), key=str)


def of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("percent", [80, 85])
def test_classes_equal_brute_force(spark, percent):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        assert run(docs, percent) == brute([(r.doc_id, r.text) for r in docs.collect()], percent)
    assert run(empty(spark), percent) == []


def test_registers_estimate_and_merge():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 3000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        both = np.concatenate([a, r.integers(0, 1 << 63, n, dtype=np.uint64)])
        assert (setsketch.registers(both) == setsketch.merged(setsketch.registers(a), setsketch.registers(both[n:]))).all()
    for j in (0.5, 0.7, 0.85):
        for own, other in ((400, 400), (900, 1000)):
            both = round(j * (own + other) / (1 + j))
            best = []
            for _ in range(30):
                h = r.integers(0, 1 << 63, own + other - both, dtype=np.uint64)
                a, b = setsketch.registers(h[:own]), setsketch.registers(h[own - both :])
                larger, smaller = np.array([(b < a).sum()]), np.array([(b > a).sum()])
                steps = np.arange(0.01, 0.9, 0.01)
                best.append(max([x for x in steps if setsketch.rises(larger, smaller, float(own), np.array([float(other)]), x)[0]], default=0))
            assert abs(np.mean(best) - j) < 0.04


def test_block_edits_are_found(spark):
    r = np.random.default_rng(5)
    pairs = []
    for n, vocabulary in ((200, 3000), (200, 50_000), (800, 3000), (800, 50_000)):
        words = lambda k: [f"w{i}" for i in r.integers(0, vocabulary, k)]  # noqa: B023, E731
        for share in (0.04, 0.08, 0.11, 0.15, 0.19):
            for edit in ("append", "prepend", "remove", "replace") * 4:
                base, k = words(n), int(n * share)
                at = int(r.integers(0, n - k))
                edited = {"append": base + words(k), "prepend": words(k) + base, "remove": base[:at] + base[at + k :], "replace": base[:at] + words(k // 2) + base[at + k // 2 :]}
                pairs.append((base, edited[edit]))
    rows = [(2 * i + j, " ".join(w)) for i, pair in enumerate(pairs) for j, w in enumerate(pair)]
    got = {x.doc_id: x.component_id for x in setsketch.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    sets = [sets_of([" ".join(w) for w in pair]) for pair in pairs]
    found = [(len(a & b) / len(a | b), got[2 * i + 1] == 2 * i) for i, (a, b) in enumerate(sets)]
    assert sum(j >= 0.8 for j, _ in found) > 200
    assert all(f == (j >= 0.8) for j, f in found)
    assert all(got[2 * i] == 2 * i for i in range(len(pairs)))


def test_long_texts_at_the_threshold(spark):
    """Thousands of shingles a text, similarities just below and above 0.8: no sample of them decides."""
    texts = []
    for i, n in enumerate((3000, 3000, 5000)):
        base = [f"t{i}w{k}" for k in range(n)]
        shingles = n - 4
        for wanted in (0.785, 0.797, 0.803, 0.815):
            new = round((1 - wanted) / (1 + wanted) * shingles)  # so many shingles of each are not the other's
            texts.append(base[: n - new] + [f"t{i}x{wanted}_{k}" for k in range(new)])
        texts.append(base)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    near = [len(a & b) / len(a | b) for k in (0, 5, 10) for s in [sets_of([t for _, t in rows[k : k + 5]])] for b in s[4:] for a in s[:4]]
    assert min(abs(j - 0.8) for j in near) < 0.004 and sum(j >= 0.8 for j in near) == 6
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 80) == brute(rows, 80)


def test_groups_of_many_sets_are_cut_into_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    texts = []
    for f in range(3):  # families that drift: neighbours are similar, the ends are not, and all share bands now and then
        words = [f"f{f}w{i}" for i in range(200)]
        for n in range(70):
            words[int(r.integers(0, 200))] = f"n{f}_{n}"
            texts.append(" ".join(words))
    want = brute(list(enumerate(texts)), 85)
    assert len({c for _, _, c in want}) == 3
    assert run(of(spark, texts)) == want
    monkeypatch.setattr(setsketch, "BLOCK_SETS", 8)
    monkeypatch.setattr(setsketch, "BLOCK_SHINGLES", 2000)
    assert run(of(spark, texts)) == want


def test_links_between_blocks_that_only_the_second_pass_finds(spark):
    words = lambda k: " ".join(f"k{k}w{i}" for i in range(40))
    held = spark.createDataFrame([(i, words(i % 6)) for i in range(9)], "g long, text string")
    rows = spark.createDataFrame([(1, g, 36, 9 * 36) for g in range(9)], "key long, g long, w long, total long")
    roots = spark.createDataFrame([(g, 0 if g < 2 else g) for g in range(9)], "g long, root long")
    more = setsketch._across(rows.select("key", "g", "w"), held, roots, setsketch.Sets, 85, 72)
    assert {frozenset((e.a, e.b)) for e in more.collect()} == {frozenset((0, 6)), frozenset((0, 7)), frozenset((2, 8))}
    assert setsketch._across(rows.select("key", "g", "w"), held, roots.withColumn("root", F.lit(0).cast("long")), setsketch.Sets, 85, 72) is None
    found = {r.g: r.root for r in setsketch.group_links(rows, held, setsketch.Sets, 85, 72).collect()}
    assert found == {0: 0, 6: 0, 1: 1, 7: 1, 2: 2, 8: 2}


def test_boilerplate_is_no_link_and_costs_no_text(spark):
    """Texts that share two thirds of their words: none is similar to another, and none is compared in full."""
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(common + [f"d{d}w{i}" for i in range(150)]) for d in range(400)]
    docs = of(spark, texts)
    nodes = setsketch.sketched(docs).groupBy("g").agg(F.any_value("n").alias("n"), F.any_value("regs").alias("regs"))
    assert setsketch._candidates(nodes, 85).count() == 0
    assert sorted(run(docs)) == [(d, 446, d) for d in range(400)]


def test_one_text_or_id_with_half_of_all_rows(spark):
    rows = [(7, "one two three four five six")] * 300 + [(i, f"a{i} b c d e f g") for i in range(300)] + [(None, "one two three four five six")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows, 85)
    kept = stages.near_duplicates(spark, docs, SF).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(7, rows[0][1]), *rows[300:600]], key=str)


def test_sets_find_what_all_pairs_find():
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 3, 30)) for _ in range(20)]
    for _ in range(60):
        words = texts[int(r.integers(0, len(texts)))].split()
        words[int(r.integers(0, len(words)))] = "new"
        texts.append(" ".join(words))
    sets = sets_of(texts)
    known = setsketch.Sets(pa.table({"text": texts}), 60)
    for x in range(len(texts)):
        for rest in (np.array([i for i in range(len(texts)) if i != x]), np.array([i for i in range(3) if i != x])):
            want = [100 * len(sets[x] & sets[y]) >= 60 * len(sets[x] | sets[y]) for y in rest]
            assert known.near(x, rest).tolist() == want


def test_texts_are_not_shuffled_for_repeated_rows(spark, monkeypatch):
    """With many repeated rows only those that a bitmap flags are shuffled; without a side to broadcast, too."""
    from shelfspark.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(200)] + [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(0, 200, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = setsketch.one_of_each_class(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bitmap_construct_agg") >= 2 and "BroadcastHashJoin" not in plan
    assert sorted(tuple(r) for r in out.collect()) == sorted(set(rows))


def test_pipeline_candidates_come_from_deletion_variants(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = [[f"w{x}" for x in r.integers(0, 5000, 1500)] for _ in range(6)]
    docs = of(spark, [" ".join(x) for b in base for x in (b, [*b, "end"], ["start", *b])] + ["", "one"])
    nodes = setsketch.sketched(docs).select("g", "n", "f0", "doc_id").collect()
    prints = {x.doc_id: (x.g, np.uint64(x.f0 % (1 << 64))) for x in nodes if x.n}
    # links of the engine: every pair within the bits is in one component, and no other pair is linked
    edges = {(x.a, x.b) for x in setsketch._near_prints(spark.createDataFrame(nodes)).collect()}
    root = {g: g for g, _ in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    close = [(a, b) for a, p in prints.values() for b, q in prints.values() if a < b and np.bitwise_count(p ^ q) <= setsketch.VARIANT_BITS]
    assert len(close) >= 6 and all(find(a) == find(b) for a, b in close)
    assert {tuple(sorted(e)) for e in edges} <= set(close)
    # without the bands the stage still finds what the variants do
    none = spark.createDataFrame([], "g bigint, root bigint")
    monkeypatch.setattr(setsketch, "_candidates", lambda nodes, percent: none)
    whole = len({find(g) for g, _ in prints.values()})
    assert stages.near_duplicates(spark, docs, SF).count() == whole + 1 < len(prints)
