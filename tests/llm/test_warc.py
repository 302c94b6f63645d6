import base64
import gzip
import hashlib
import os
import random

import pytest

from shelfspark.llm import common, warc

HTML = [None, "", "a", "a", "line\r\n\r\nWARC/1.1\r\n\r\n", "ü" * 50, "x" * 100_000]


def pages(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["http://a.example/x", "https://www.B.example:80/y?q=1#f", None, "http://c.example/\r\nX: y", "bad url"]), HTML[i % len(HTML)], "x") for i in range(60)]
    rows += [(7, "http://a.example/x", HTML[0], "x"), rows[3], (None, "http://n.example", "nobody", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), rows


def brute(rows, least=0):
    last = {}
    for p, _, h, _ in rows:
        if p is not None and len((h or "").encode()) >= least:
            last[h or ""] = max(p, last.get(h or "", p))
    out = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        to = last.get(h or "")
        refers = to if p is not None and to is not None and to > p else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archives_round_trip(spark, tmp_path):
    given, rows = pages(spark)
    for least in (0, 60):
        got = warc.capture_histories(given, str(tmp_path / f"w{least}"), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, least)


def test_histories_are_in_global_order(spark, tmp_path):
    given, rows = pages(spark)
    path = warc.write_archives(given.repartition(5), str(tmp_path / "w"), records_per_file=4)
    merged = warc.merge_runs(warc.index_runs(spark, path), 3).collect()
    assert len(merged) == len(rows)
    assert len({r.archive for r in merged}) > 5
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in merged]
    assert keys == sorted(keys)
    for r in merged:
        with gzip.open(f"{path}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            record = f.read(r.length)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_no_pages(spark, tmp_path):
    given, _ = pages(spark)
    assert warc.capture_histories(given.limit(0), str(tmp_path / "none")).collect() == []


def test_loser_tree():
    r = random.Random(6)
    for k in range(9):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for run in runs for x in run)


def test_url_key():
    assert warc.url_key("https://u:p@www.A.example:8080/b/c?d=1#e") == "example,a,www)/b/c?d=1"
    assert warc.url_key("http://a.example?x") == "example,a)?x" and warc.url_key("") == ""


def test_large_payloads_have_files_of_their_own(spark, tmp_path):
    given, rows = pages(spark)
    path = warc.write_archives(given.coalesce(1), str(tmp_path / "w"), large=1000)
    entries = warc.index_runs(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in entries), key=str) == brute(rows)
    count = {a: sum(r.archive == a for r in entries) for a in {r.archive for r in entries}}
    assert all(count[r.archive] == 1 for r in entries if r.payload_bytes > 1000) and max(count.values()) > 10


def test_revisits_are_shuffled_where_they_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    given, rows = pages(spark)
    got = warc.capture_histories(given, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_changed_bytes_are_noticed(spark, tmp_path):
    given = spark.createDataFrame([(i, "http://a.example/", "abc" * 50 if i % 2 else f"text {i}") for i in range(8)], "page_id long, url string, html string")
    path = warc.write_archives(given.coalesce(1), str(tmp_path / "w"))
    name = next(f for f in os.listdir(path) if f.startswith("part-"))
    raw = gzip.decompress(open(f"{path}/{name}", "rb").read())
    whole = list(warc.parse_archive(name, gzip.compress(raw)))
    assert [e[2] for e in whole] == list(range(8)) and whole == list(warc.parse_archive(name, gzip.compress(raw[:500]) + gzip.compress(raw[500:])))
    with pytest.raises(ValueError, match="not the one that was written"):
        list(warc.parse_archive(name, gzip.compress(raw.replace(b"abcabc", b"abcabd", 1))))
    with pytest.raises(ValueError, match="without an end"):
        list(warc.parse_archive(name, gzip.compress(raw[:-3])))
    entries = warc.index_runs(spark, path)
    warc.check_revisits(entries)
    with pytest.raises(ValueError, match="not in the archives"):
        warc.check_revisits(entries.where("page_id <> 7"))


def test_a_payload_that_most_pages_share(spark, monkeypatch):
    """Nine in ten pages are empty: their digest meets the others in a broadcast, at any size."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    rows = [(i, f"http://h{i % 7}.example/{i}", None if i % 2 else "") for i in range(900)] + [(i, f"http://x.example/{i}", f"<p>{i // 3}</p>") for i in range(900, 1000)]
    planned = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.refers_to for r in planned if r.page_id < 900} == {**{i: 899 for i in range(899)}, 899: None}
    assert {r.page_id: r.refers_to for r in planned if r.page_id >= 900} == {i: None if i // 3 != (i + 1) // 3 or i == 999 else min(i // 3 * 3 + 2, 999) for i in range(900, 1000)}
