import random
import zlib
from collections import Counter, defaultdict

import pytest

from shelfspark.llm import common, sharding

from .data import SF, documents, empty


def brute_pack(sizes, capacity):
    """Best-fit-decreasing, item by item."""
    room, out = [], Counter()
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            _, i = min(fits)
        else:
            room.append(max(capacity, s))
            i = len(room) - 1
        room[i] -= s
        out[s, i] += 1
    return out, len(room)


@pytest.mark.parametrize("seed", range(5))
def test_pack_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 20), r.randint(1, 300)]) for _ in range(400)]
    want, n = brute_pack(sizes, 500)
    got = Counter()
    for size, start, end, shard in sharding.pack(list(Counter(sizes).items()), 500):
        got[size, shard] += end - start
    assert +got == want
    assert len({k for _, k in got}) == n


def test_pack_evenly_with_a_giant():
    runs = sharding.pack_evenly([(10_000, 1), (10, 500), (7, 100)], 8)
    fill = Counter()
    for size, start, end, shard in runs:
        fill[shard] += size * (end - start)
    assert fill[0] == 10_000
    rest = [fill[i] for i in range(1, 8)]
    assert max(rest) - min(rest) <= 20 and sum(rest) == 5700


def check(rows, docs):
    text = defaultdict(list)
    for d, t in docs:
        text[d].append(t)
    assert len(rows) == len(docs)
    groups = defaultdict(set)
    for r in rows:
        t = next(t for t in text[r.doc_id] if len((t or "").encode()) + 1 == r.size)
        assert zlib.crc32((t or "").encode()) == r.text_crc32
        groups[t].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_even_shards(spark):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sharding.even_shards(docs).collect()
        check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    fill = Counter()
    for r in rows:
        fill[r.shard] += r.size
    assert len(fill) == 8 and max(fill.values()) < 1.02 * min(fill.values())
    assert sharding.even_shards(empty(spark)).collect() == []


def test_shards_of_a_fixed_capacity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shards_of(docs, 50_000).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    fill = Counter()
    for r in rows:
        fill[r.shard] += r.size
    assert max(fill.values()) <= 50_000
    assert len(fill) <= 2 + sum(fill.values()) / 50_000


@pytest.mark.parametrize("shuffled", (False, True))
def test_written_shards_have_whole_rows(spark, tmp_path, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    for name, docs in (("odd", documents(spark)), ("clash", documents(spark).withColumnsRenamed({"lang": "shard", "source": "row", "kept": "_g"})), ("none", empty(spark))):
        for _ in range(2):  # a second run replaces the first
            found = sharding.write_shards(docs, str(tmp_path / name), file_bytes=4_000)
        got = found.collect()
        assert Counter(map(str, (tuple(r.row) for r in got))) == Counter(map(str, map(tuple, docs.collect())))
        assert [f.name for f in found.schema["row"].dataType] == docs.columns
        want = defaultdict(set)
        for r in sharding.even_shards(docs).collect():
            want[r.doc_id, r.text_crc32].add(r.shard)
        seen = defaultdict(set)
        for r in got:
            seen[r.row.doc_id, zlib.crc32((r.row.text or "").encode())].add(r.shard)
        assert seen == want
    assert all(len(list((tmp_path / "odd" / f"shard={k}").glob("*.parquet"))) >= 1 for k in range(8))
    assert max(len(list((tmp_path / "odd" / f"shard={k}").glob("*.parquet"))) for k in range(8)) > 1
