"""Small documents with every awkward case, and rows read back from DataFrames."""

import random

SF = "/root/testdata/sf0.001"

LINE = "Licensed under the Apache License, Version 2.0."


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Ümlaut", "naïve", "x", "cc", "by", "nc", "under", "mit", "license", *[f"w{i}" for i in range(200)]]
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    out: list[str | None] = [None, "", " \t\n\x0b\x0c\r ", "one", "two words", "a b c", "!!! ###", "\n\nline\nline\nline\n", "a b c a b c a b c", "UNDER THE MIT License, under the mit license", LINE + " cc-by-nc 4.0", "Kelvin İstanbul", " nbsp sep", "🎉 emoji 🎉"]
    out += [words(r.randint(1, 150)) for _ in range(n)]
    out += [out[-1], out[-2], out[20].replace("the", "of", 1) if out[20] else "", words(20_000), "same " * 3000]
    return out


def documents(spark, seed: int = 1, n: int = 60):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 4}", len(t or ""), "x") for i, t in enumerate(texts(seed, n))]
    rows += [rows[20], rows[20], (None, "no id at all", "en", "s1", 3, "x")]
    # columns of other names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").withColumnsRenamed({"size": "kept"})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
