"""Fuzzy search of names by their token-set ratio with a query, by an index and a bound that leaves few names to be scored.

The index has each name once, with its distinct words: one table ordered by the words' joined length, one by word. A
search reads the names that share a word with the query from the second, and from the first those of a length that can
still reach the least score without sharing one. Of both it keeps the names whose bound reaches the least score, and only
those are scored in Python. No name that scores enough is lost, as the bound is never below the score:

* words that both sides have stand first on both sides of the ratio, so they and the blank after them are common to
  both, and the ratios of the shared words against either side are known from lengths alone;
* the longest common subsequence of the rest is at most the number of characters that both rests have, counted with
  repeats.

Null and blank names and queries score 0 and are never found. Repeated names are indexed once. Words are lower-cased and
parted by any white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..sources.kept import exists

#: White space as str.split sees it.
_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def words_of(name: Column) -> Column:
    """The distinct words of a text, lower-cased and sorted."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(name), _SPACE), "")))


def index_rows(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, words, size): each name once, with the length of its joined words."""
    words = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("words", words_of(F.col("name")))
    return words.withColumn("size", F.length(F.array_join("words", " "))).where("size > 0")


def asked_words(query: str) -> list[str]:
    return sorted(set(query.lower().split()))


def _count(text: Column, character: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, character, F.lit("")))


def upper_bound(words: Column, query: str) -> Column:
    """What the unrounded token-set ratio of words and query never exceeds. The parts are bound once, as fields of a lambda's argument, so that filters that are pushed down don't repeat them."""
    asked = F.array(*[F.lit(w) for w in asked_words(query)])
    letters = F.array(*[F.lit(c) for c in sorted(set(" ".join(asked_words(query))))])
    parts = F.struct(*[F.array_join(a, " ").alias(n) for n, a in (("both", F.array_intersect(asked, words)), ("left", F.array_except(asked, words)), ("right", F.array_except(words, asked)))])

    def ratio(p: Column) -> Column:
        both, left, right = (F.length(p[n]) for n in ("both", "left", "right"))
        common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(_count(p["left"], c), _count(p["right"], c)))
        gap = (both > 0).cast("int")
        one, two = both + gap + left, both + gap + right
        shared = F.when(both > 0, F.greatest(200 * both / (both + one), 200 * both / (both + two))).otherwise(0.0)
        return F.when((both > 0) & ((left == 0) | (right == 0)), 100.0).otherwise(F.greatest(200 * (both + gap + common) / (one + two), shared))

    return F.transform(F.array(parts), ratio)[0]


def _reaching(rows: DataFrame, query: str, least: int) -> DataFrame:
    return rows.withColumn("bound", upper_bound(F.col("words"), query)).where(F.col("bound") >= least - 0.5 - 1e-9)  # scores are rounded


def scored(candidates: DataFrame, query: str, least: int) -> DataFrame:
    """(name, score) of the candidates that score at least `least`."""
    score = fuzzy.match_score(F.array_join("words", " "), F.lit(query))
    return candidates.select("name", score.alias("score")).where(F.col("score") >= least)


def matches(names: DataFrame, query: str, least: int, column: str = "name") -> DataFrame:
    """(name, score) of all names with a score of at least `least` (1 or more), in one pass and without a kept index."""
    if least < 1:
        raise ValueError("the least score is 1 or more")
    rows = index_rows(names, column)
    return scored(_reaching(rows, query, least) if asked_words(query) else rows.limit(0), query, least)


class NameIndex:
    """The index as two Parquet tables under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, names: DataFrame, column: str = "name") -> NameIndex:
        """Indexes names. A word that many names have spans as many files as it needs."""
        rows = index_rows(names, column)
        salt = F.xxhash64("name").alias("salt")
        rows.repartitionByRange("size", salt).sortWithinPartitions("size").write.mode("overwrite").parquet(f"{self.path}/sizes")
        by_word = rows.withColumn("word", F.explode("words"))
        by_word.repartitionByRange("word", salt).sortWithinPartitions("word").write.mode("overwrite").parquet(f"{self.path}/words")
        return self

    def candidates(self, query: str, least: int) -> DataFrame:
        """(name, words, size, bound) of names that may score at least `least`; each once."""
        if least < 1:
            raise ValueError("the least score is 1 or more")
        if not exists(self.spark, f"{self.path}/words"):
            raise FileNotFoundError(f"no index under {self.path}")
        by_size = self.spark.read.parquet(f"{self.path}/sizes")
        asked = asked_words(query)
        if not asked:
            return by_size.withColumn("bound", F.lit(0.0)).limit(0)
        literal, length, low = F.array(*[F.lit(w) for w in asked]), len(" ".join(asked)), least - 0.5
        first = F.array_min(F.array_intersect("words", literal))
        sharing = self.spark.read.parquet(f"{self.path}/words").where(F.col("word").isin(asked) & (F.col("word") == first)).drop("word")
        apart = by_size.where((F.col("size") >= int(low * length / (200 - low))) & (F.col("size") <= int((200 - low) * length / low) + 1) & ~F.arrays_overlap("words", literal))
        return _reaching(sharing.unionByName(apart), query, least)

    def search(self, query: str, least: int) -> DataFrame:
        """(name, score) of all names with a score of at least `least`."""
        return scored(self.candidates(query, least), query, least)
