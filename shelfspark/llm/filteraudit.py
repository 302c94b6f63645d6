"""Filter interaction audit: what each step of every order of five filters removes, keeps, repeats and loses.

Each document becomes five failure flags, and equal (part, flags) become one row with its counts. A SQL CUBE over the
part and the flags follows: the row of a grouping set whose selected flags are all false counts what survives that
subset of filters. A step of an order goes from one subset to a larger one by one filter, so its figures are those of
a joined pair of subsets: 80 pairs a part serve all 600 steps of the 120 orders.

Documents are read once and leave it as rows of some fifty bytes; the exact-copy flag comes from the least id of each
text's SHA-256, which hot texts meet in a broadcast. Rows are counted by (id, part, flags) before they meet the
labels, and what the cube reads has at most 32 rows a part.

Defined results: null texts are empty ones, null parts the empty string; a row with a null id is no copy of anything,
as ids are compared, makes no other row one, and has no label; rows with one id are each counted, and are good (toxic)
if any label row of that id is; equal ids are not smaller ones; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, table

FILTERS = "ABCDE"
_SPACES = "\t\n\x0b\x0c\r"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_ALL = (1 << len(FILTERS)) - 1
#: In how many of the 120 orders a filter comes right after a given set of k others: k! (4 - k)!.
_ORDERS = (24, 6, 4, 6, 24)


def failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, _h, A, B, C, D): what each document fails by itself, and its text's hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("_body"), F.array_remove(F.split(F.translate(body, _SPACES, " " * len(_SPACES)), " "), "").alias("_w"))
    n = F.size("_w")
    return split.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("_body").cast("binary"), 256)).alias("_h"), (n < 200).alias("A"), (F.size(F.array_distinct("_w")) * 100 < n * 50).alias("B"),
        (F.length(F.regexp_replace("_body", "[^A-Z]+", "")).cast("long") * 100 > F.length("_body").cast("long") * 2).alias("C"), F.rlike("_body", F.lit("[#$%&*|]")).alias("D"),
    )


def flagged_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, ..., E, n, good, toxic): documents of each part by the filters that they fail; at most 32 rows a part."""
    slim = table(failures(docs, id_col, text, part), "failures")
    firsts = slim.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    seen = hot_join(slim, firsts, ["_h"], "_n").withColumn("E", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    by_id = seen.groupBy("doc_id", "part", *FILTERS).agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    met = by_id.join(known, "doc_id", "left")
    return met.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"_{c}"), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def survivors(counts: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of every part and every subset of the filters, as bits: what passes all of the subset, zeros included."""
    cube = counts.cube("part", *FILTERS).agg(F.grouping_id().alias("_g"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # grouping_id has a bit for each column that a row's set leaves out, the part's first
    chosen = [F.getbit(F.col("_g"), F.lit(len(FILTERS) - 1 - i)) == 0 for i in range(len(FILTERS))]
    none_fails = reduce(Column.__and__, [~c | ~F.coalesce(F.col(f), F.lit(False)) for c, f in zip(chosen, FILTERS, strict=True)])
    mask = reduce(Column.__add__, [F.when(c, _BIT[f]).otherwise(0) for c, f in zip(chosen, FILTERS, strict=True)])
    passed = cube.where((F.getbit(F.col("_g"), F.lit(len(FILTERS))) == 0) & none_fails).select("part", mask.alias("mask"), "n", "good", "toxic")
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("mask"))
    return grid.join(passed, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each step of each order of the filters in each part."""
    passed = table(survivors(flagged_counts(docs, labels, id_col, text, part)), "survivors")
    bits = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("bit")) for f, b in _BIT.items()]))
    before = passed.select("*", bits.alias("_f")).select("*", "_f.*").where(F.col("mask").bitwiseAND(F.col("bit")) == 0)
    after = passed.select("part", F.col("mask").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("n", "good", "toxic")])
    pairs = before.withColumn("_to", F.col("mask") + F.col("bit")).join(after, ["part", "_to"]).select(
        "part", "mask", "f", "bit", F.col("_n").alias("kept"), (F.col("n") - F.col("_n")).alias("removed"), (F.col("good") - F.col("_good")).alias("good_lost"), (F.col("toxic") - F.col("_toxic")).alias("toxic_lost"),
    )
    weight = F.get(F.array(*[F.lit(w) for w in _ORDERS]), F.bit_count("mask"))
    alone = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("removed")))
    each = pairs.groupBy("part", "f").agg(alone(F.lit(0)).alias("fails"), alone(F.lit(_ALL) - F.col("bit")).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    steps = [("".join(o), k + 1, f, sum(_BIT[x] for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
    taken = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, f string, mask int")
    rows = pairs.join(F.broadcast(taken), ["f", "mask"]).join(each, ["part", "f"])
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Independent of the cube: every step counts the rows that its own filter and none of the earlier ones fail.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN coalesce(doc_id > first, false) THEN 16 ELSE 0 END) AS b
  FROM t JOIN m USING (text) LEFT JOIN g USING (doc_id)),
c AS (SELECT part, b, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, b),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (b & (coalesce(before, 0) | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (b & coalesce(before, 0) = 0 AND b & bit <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (b & coalesce(before, 0) <> 0 AND b & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (b = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (b & coalesce(before, 0) = 0 AND b & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (b & coalesce(before, 0) = 0 AND b & bit <> 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
