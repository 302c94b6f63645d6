import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from shelfspark.llm import spelling

from .data import SF, documents, empty


def near(a, b):
    """Distance one, by trying every edit's place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else "".join(c for i, c in enumerate(run) if i != h % len(run))] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(words):
    forms, out = {}, []
    for w, n in words.items():
        close = sorted((-k, x) for x, k in words.items() if near(w, x))
        form = close[0][1] if close and -close[0][0] >= 5 * n else None
        forms[w] = form
        out.append((w, n, len(close), form, words.get(form)))
    root = lambda w: w if forms[w] is None else root(forms[w])
    return sorted(((*r, root(r[0])) for r in out), key=str)


def misspelt(seed=3, n=60, base=("kaufhaus", "straße", "überfall", "naïveté", "banana", "abcdef", "zzzzzz", "aaaaaa")):
    r = random.Random(seed)
    words = list(base)
    for _ in range(n):
        w, i, c = r.choice(words), r.randrange(9), r.choice("abcßüz")
        words.append(r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    return {w: r.choice([5, 6, 30, 200, 4000]) for w in words if len(w) >= 6}


def test_query_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = list(misspelt())
    rows = [(i, " ".join(r.choice(vocabulary).upper() if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 300)))) for i in range(60)]
    rows += [(64, "Ǝkaufhaus kaufhaus\u2019s \u20ackaufhaus\U0001f389kaufhaus\x85kaufhaus\xa0kaufhausŸ " * 4), (None, "Kaufhaus kaufhaus-KAUFHAUS " * 50), (60, None), (61, ""), (62, "kaufhau " * 7), (62, "kaufhau " * 7), (63, "×÷kaufhaus÷ " * 9)]
    more = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, word int")
    for docs in (more, documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted((tuple(x) for x in got.collect()), key=str) == brute(counted([(x.doc_id, x.text) for x in docs.collect()]))
    assert spelling.variants(empty(spark)).collect() == []


def test_trie_join_finds_all_pairs():
    for seed in range(20):
        words = [w for w in misspelt(seed, 120)] + ["a", "b", "ab", "", "ba"]
        words = sorted(set(words))
        got = sorted(spelling.Trie((w, w) for w in words).pairs())
        assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_large_groups_are_dealt_by_pieces(spark):
    words = misspelt(5, 400, ("präfixabcdef", "präfixabc", "präfix", "xyzabcsuffix"))
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((a, b, words[b]) for a in words for b in words if near(a, b))
    assert len(want) > 300
    for group in (5000, 10, 1):
        assert sorted(tuple(r) for r in spelling.near_words(given, group).collect()) == want


def test_chains_of_forms_lead_to_the_last(spark):
    steps = [("w" + "a" * i, "w" + "a" * (i + 1)) for i in range(40)]
    got = {r.word: r.root for r in spelling._followed(spark.createDataFrame([*steps, ("p", "q"), ("r", "q")], "word string, form string")).collect()}
    assert got == {**{w: "w" + "a" * 40 for w, _ in steps}, "p": "q", "r": "q"}
    assert spelling._followed(spark.createDataFrame(steps, "word string, form string").where(F.lit(False))).collect() == []
