import re
from collections import Counter
from itertools import permutations

import pytest

from shelfspark.llm import filteraudit

from .data import SF, documents, empty


def flags(doc_id, text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and first[text] is not None and doc_id > first[text])
    return {f for f, x in zip("ABCDE", fails, strict=True) if x}


def brute(docs, labels):
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.select("doc_id", "text", "source").collect()]
    first = {}
    for d, t, _ in rows:
        old = first.get(t)
        first[t] = d if old is None else old if d is None else min(d, old)
    good, toxic = ({r.doc_id for r in labels.collect() if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    known = [(p, flags(d, t, first), d in good, d in toxic) for d, t, p in rows]
    out = []
    for part in {p for p, *_ in known}:
        mine, removed, steps = [x for x in known if x[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                again = sum(f in x[1] for x in mine) - len(gone)
                removed[f] += len(gone)
                steps.append([part, "".join(order), k + 1, len(left), len(gone), again, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        out += [(*s, removed[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def labelled(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def test_audit_equals_counting_every_step(spark):
    docs = documents(spark)
    got = filteraudit.audit(docs, labelled(spark))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labelled(spark))


def test_audit_of_copies_nulls_and_one_source(spark):
    rows = [(None, "a", None), (None, "a", ""), (5, "a", None), (5, "a", "s"), (4, "a", "s"), (6, None, "s"), (7, "", "s"), (8, "A# b", "s"), (9, " ".join(f"w{i}" for i in range(250)), "s"), (10, "x " * 300, None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in filteraudit.audit(docs, labelled(spark)).collect()) == brute(docs, labelled(spark))


def test_audit_of_nothing(spark):
    assert filteraudit.audit(empty(spark), labelled(spark)).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = filteraudit.audit(docs, labelled(spark).limit(0))
    assert {(r.good_lost, r.toxic_lost) for r in got.collect()} == {(0, 0)}
    assert got.count() == 600 * docs.select("source").distinct().count()


@pytest.mark.parametrize("half", [True, False])
def test_survivors_are_those_of_the_cube(spark, half):
    counts = filteraudit.flagged_counts(documents(spark), labelled(spark))
    counts = counts.where("A") if half else counts
    rows = counts.collect()
    want = {(r.part, m): sum(x.n for x in rows if x.part == r.part and not any(x[f] for i, f in enumerate("ABCDE") if m >> i & 1)) for r in rows for m in range(32)}
    assert {(r.part, r.mask): r.n for r in filteraudit.survivors(counts).collect()} == want
