import re

from shelfspark.llm import licenses

from .data import SF, documents, empty


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = licenses.labelled(licenses.scan(docs)).collect()
        want = sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
        for r in got:
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert not r.base_labels or r.score == 1
    assert licenses.labelled(licenses.scan(empty(spark))).collect() == []


def test_notices_with_edits(spark):
    notice = next(t for t, label in licenses.NOTICES.items() if label == "mit").split()
    edited = notice[:8] + ["really", "and"] + notice[8:20] + notice[21:]
    rows = [(0, " ".join(notice)), (1, "x " * 500 + " ".join(edited) + " y" * 40), (2, " ".join(notice[:6])), (3, " ".join(reversed(notice))), (4, "\n * ".join(notice).upper())]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.labelled(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0] == ("mit", 1.0) and got[4] == ("mit", 1.0)
    assert got[1][0] == "mit" and 0.6 < got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0)
    spans = [r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.template is not None and r.doc_id == 1]
    assert [(r.first, r.last) for r in spans] == [(500, 500 + len(edited) - 3)]


def bodies():
    """Two licenses of 1,500 words each, which share their middle third, and a short one."""
    word = lambda seed, i: f"w{(i * 7919 + seed * 104729) % 4001}"
    a, b = ([word(seed, i) for i in range(1500)] for seed in (1, 2))
    b[500:1000] = a[500:1000]
    return {"whole-a": a, "whole-b": b, "short": ["only", "two"]}


def spans_by_hand(docs, known):
    """(doc_id, label, first, last, votes) of the merged diagonals that pass, from all pairs of equal k-grams."""
    out = []
    for doc, words in docs.items():
        for label, body in known.items():
            grams = [tuple(body[i : i + 3]) for i in range(len(body) - 2)]
            at = {}
            for i in range(len(words) - 2):
                for j, g in enumerate(grams):
                    if g == tuple(words[i : i + 3]):
                        at.setdefault(i - j, []).append(i)
            runs = []
            for d in sorted(at):
                runs = [*runs[:-1], [*runs[-1], d]] if runs and d - runs[-1][-1] <= licenses.BAND else [*runs, [d]]
            for run in runs:
                hits = [i for d in run for i in at[d]]
                if len(hits) >= licenses.COVER * len(grams) and max(hits) - min(hits) + 1 <= licenses.STRETCH * len(grams) + licenses.BAND:
                    out.append((doc, label, min(hits), max(hits), round(min(1.0, len(hits) / len(grams)), 9)))
    return sorted(out)


def test_whole_licenses_of_a_table_in_one_and_in_many_parts(spark, monkeypatch):
    known = bodies()
    a, b = known["whole-a"], known["whole-b"]
    docs = {0: ["x"] * 40 + a + ["y"] * 9, 1: a[:700] + ["new", "words"] + a[703:], 2: a[500:1000], 3: b[:1000] + a[:1000], 4: ["nothing"], 5: a + a}
    table = spark.createDataFrame([*((" ".join(w), k, None) for k, w in known.items()), (" ".join(a), "whole-a", False), (None, "none", False), ("no label at all here", None, False)], "text string, label string, exact boolean")
    rows = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    want = spans_by_hand(docs, known)
    assert {(d, label) for d, label, *_ in want} >= {(0, "whole-a"), (1, "whole-a"), (3, "whole-b"), (3, "whole-a"), (5, "whole-a")} and not any(d in (2, 4) for d, *_ in want)
    for most in (500_000, 900):
        monkeypatch.setattr(licenses.common, "BROADCAST_ROWS", most)
        assert len(licenses._in_blocks(licenses.templates(table))) == (1 if most > 900 else 7)
        found = licenses.scan(rows, known=table)
        assert sorted((r.doc_id, r.label, r.first, r.last, round(r.cover, 9)) for r in found.where("template is not null").collect()) == want
        assert sorted((r.doc_id, r.n_words) for r in licenses.labelled(found).collect()) == [(i, len(w)) for i, w in docs.items()]
    assert licenses.scan(rows, known=table.limit(0)).where("template is not null").count() == 0
