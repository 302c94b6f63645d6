"""Fuzzy search by an index: against scoring every name."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import fuzzy
from shelfspark.operators import search

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "red", "RED  red", "small red widget", "widget\tsmall red", "Straße", "x" * 5000, "red " + "y" * 300, "wid", "deirgets lamwl", "tegdiw der llams", "İzmir red"]


def every(spark, names, query, least):
    scores = {n: fuzzy.score(n, query) for n in names if n}
    return sorted((n, s) for n, s in scores.items() if s >= least)


def found(df):
    return sorted((r["name"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("query", "least"), [("small red widget", 50), ("small red widget", 45), ("Red", 1), ("a b", 100), ("", 1), ("  \t", 50), ("x" * 4000, 70)])
def test_equals_scoring_every_name(spark, tmp_path, query, least):
    draw = random.Random(5)
    names = ODD + ["".join(draw.choice("smalredwigt x") for _ in range(draw.randint(1, 30))) for _ in range(800)] + ["red", "red"]
    df = spark.createDataFrame([(n, 1) for n in names], "name string, score int")
    want = every(spark, names, query, least)
    assert found(search.matches(df, query, least)) == want
    assert found(search.NameIndex(spark, str(tmp_path)).write(df).search(query, least)) == want


def test_documents_are_found_and_most_are_not_scored(spark, tmp_path):
    """First eight words of all documents, and of each the first as a name too."""
    words = F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")
    names = spark.read.parquet(f"{SF}/documents.parquet").select(F.array_join(F.slice(words, 1, 8), " ").alias("name"))
    known = [r["name"] for r in names.collect()]
    index = search.NameIndex(spark, str(tmp_path)).write(names)
    query = " ".join(known[3].split()[:4])
    assert found(index.search(query, 75)) == every(spark, known, query, 75)
    assert index.candidates(query, 75).count() < 0.5 * len(set(known))


def test_index_is_read_by_word_and_size(spark, tmp_path):
    df = spark.createDataFrame([(f"n{i} red{'x' * (i % 40)}",) for i in range(500)], "name string")
    plan = search.NameIndex(spark, str(tmp_path)).write(df).candidates("red shoe", 60)._jdf.queryExecution().toString()
    assert "In(word, [red,shoe])" in plan and "GreaterThanOrEqual(size,3)" in plan


def test_empty_table_and_no_index(spark, tmp_path):
    none = spark.createDataFrame([], "name string")
    assert search.NameIndex(spark, str(tmp_path / "i")).write(none).search("red", 50).count() == 0
    with pytest.raises(FileNotFoundError):
        search.NameIndex(spark, str(tmp_path / "none")).search("red", 50)
    with pytest.raises(ValueError, match="1 or more"):
        search.matches(none, "red", 0)
