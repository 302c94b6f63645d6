"""Mixing sources to target weights by weighted fair queueing.

Sources get targets by filling to a common water level (a source stops at `max_repeats` times its size, its
excess goes to the others by weight). Each source's documents are shuffled by a hash of their id and text; a document's
virtual finish time is its source's running size divided by the source's target, and each further repeat of the
source goes on where the last one ended. All copies are put in one order by finish time and cut where their
running size passes the budget. Everything is a DataFrame expression: no Python runs on executors.

A hot source is no hot task: running sums are taken in two levels (see common.running_total). The cut needs the
order of one narrow slice of finish times only; whole slices before it are taken by their totals.

Defined results: a null text has size 0; null sources are one source, after all others; rows with equal id, text
and source are interchangeable, are ordered in one task, and each is taken on its own; no rows, or only empty ones,
give target 0 and taken 0; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, WORD, cut, running_total, small, word_list

WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix holds.
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(_source, source_size, n_rows, target) for each source of sizes(_source, size), by order of _source."""
    stats = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("_source"))
    ranked = stats.withColumns({
        "_w": F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights)))),
        "_cap": F.lit(max_repeats) * F.col("source_size"),
        "_budget": F.lit(budget_share) * F.sum("source_size").over(every),
    })
    ranked = ranked.withColumn("_level", F.col("_cap") / F.col("_w"))
    upto = Window.orderBy("_level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # at the level where this source is full, those up to it hold their caps and the rest hold level x weight
    filled = F.sum("_cap").over(upto) + F.col("_level") * (F.sum("_w").over(every) - F.sum("_w").over(upto))
    full = ranked.withColumn("_full", filled <= F.col("_budget"))
    level = (F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(every)) / F.nullif(F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every), F.lit(0.0))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(level * F.col("_w"), F.lit(0.0)))
    return full.withColumn("target", target).select("_source", "source_size", "n_rows", "target")


def _finish(repeat: int | Column) -> Column:
    return F.try_divide(F.col("source_size") * repeat + F.col("_cum"), F.col("target"))


def source_name(source: Column) -> Column:
    """A source's name in the order of sources: by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The hash of an id and a text by which documents are shuffled."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit(""))))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, _source, size, source_size, target, copies, taken, _h) of each row: how often, and how many words, the mix takes; _h is its shuffle_key."""
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), source_name(F.col(source)).alias("_source"), F.size(word_list(F.col(text))).cast("long").alias("size"), shuffle_key(F.col(id_col), F.col(text), seed).alias("_h")))
    targets, _ = small(cut(source_targets(sizes, weights, budget_share, max_repeats)))
    unit = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")  # below 2^32, in the order of _h
    part = F.floor(unit * F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.col("n_rows") / BUCKET_ROWS)).cast("long") / F.lit(1 << 32)).cast("long")
    queued = running_total(sizes.join(targets, "_source").withColumn("_b", part), ["_source"], "_b", ["_h", "doc_id", "size"], "size", "_cum")
    queued = cut(queued.drop("_b", "n_rows"))

    total = sizes.agg(F.sum("size").alias("t"), F.count("*").alias("n")).first()
    budget, slices = budget_share * (total["t"] or 0), int(min(1 << 16, max(1, total["n"] // BUCKET_ROWS)))
    at = lambda v: F.floor(F.lit(float(slices)) * v / (v + 1.0)).cast("long")  # noqa: E731  slices of equal width in v / (v + 1)
    copy = lambda e: F.struct(_finish(e).alias("v"), F.col("_h").alias("h"), F.col("doc_id").alias("id"), F.col("size").alias("s"), F.lit(e).alias("e"))
    copies = queued.where("size > 0").select(F.explode(F.array(*[copy(e) for e in range(max_repeats)])).alias("c"), "size").withColumn("_g", at(F.col("c.v")))
    totals = copies.groupBy("_g").agg(F.sum("size").alias("t"))
    before = F.sum("t").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    crossing = totals.select("_g", "t", before.alias("upto")).where(F.col("upto") > budget).orderBy("_g").first()
    if crossing is None:
        taken_of = lambda e: F.col("size") > 0
    else:
        g, offset = crossing["_g"], crossing["upto"] - crossing["t"]
        within = Window.partitionBy("_g").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = copies.where(F.col("_g") == g).withColumn("upto", F.sum("size").over(within) + offset).where(F.col("upto") <= budget).agg(F.max("c").alias("c")).first()["c"]
        edge = F.struct(*[F.lit(x) for x in last]).cast(copies.schema["c"].dataType) if last is not None else None
        in_slice = (lambda e: copy(e) <= edge) if edge is not None else (lambda e: F.lit(False))
        taken_of = lambda e: (F.col("size") > 0) & ((at(_finish(e)) < g) | ((at(_finish(e)) == g) & in_slice(e)))
    count = sum((F.coalesce(taken_of(e), F.lit(False)).cast("long") for e in range(max_repeats)), F.lit(0).cast("long"))
    return queued.withColumn("copies", count).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "_source", "size", "source_size", "target", "copies", "taken", "_h")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay.

    Finish times rise with a source's hashes, so what the mix takes of a source is told by the last hash that it takes
    once, twice and so on: documents meet these few hashes in a broadcast, and their texts are never shuffled. Only where
    the cut goes through rows that are equal in id, text and source do copies differ among such rows: the first ones by
    their other columns then get one copy more.
    """
    mixed = mix(docs, id_col, text, source, max_repeats=max_repeats).where("size > 0").select("_source", "_h", "copies")
    last = F.array(*[F.coalesce(F.max(F.when(F.col("copies") > e, F.col("_h"))), F.lit("")) for e in range(max_repeats)])
    ends, _ = small(cut(mixed.groupBy("_source").agg(last.alias("_ends"))))
    at_ends = mixed.join(ends, "_source").where(F.array_contains("_ends", F.col("_h")))
    edges = cut(at_ends.groupBy("_source", "_h").agg(F.count("*").alias("_n"), F.sum("copies").alias("_c")).where("_c % _n <> 0"))
    has_words = F.coalesce(F.rlike(F.col(text), F.lit(WORD)), F.lit(False))
    given = docs.where(has_words).select(F.struct(*docs.columns).alias("_row"), shuffle_key(F.col(id_col), F.col(text)).alias("_h"), source_name(F.col(source)).alias("_source"))
    times = lambda n: F.explode(F.array_repeat("_row", n.cast("int"))).alias("_row")
    taken = F.size(F.filter("_ends", lambda end: F.col("_h") <= end))
    met = given.join(ends, "_source")
    if edges.isEmpty():
        return met.select(times(taken)).select("_row.*")
    side, _ = small(edges)  # at most max_repeats for each source
    met = met.join(side, ["_source", "_h"], "left")
    place = F.row_number().over(Window.partitionBy("_source", "_h").orderBy(F.to_json("_row")))
    uneven = met.where("_n is not null").withColumn("_p", place).select(times(F.floor(F.col("_c") / F.col("_n")) + (F.col("_p") <= F.col("_c") % F.col("_n")).cast("long")))
    return met.where("_n is null").select(times(taken)).unionByName(uneven).select("_row.*")


def op4_sql() -> str:
    """DuckDB SQL for the op4 query."""
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY src COLLATE "C") - 1) % 3 + 1)::INT] AS w,
             {MAX_REPEATS} * source_size AS cap, {BUDGET_SHARE}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (SELECT *, cap / w AS level FROM r),
f AS (SELECT *, CAST(sum(cap) OVER u AS DOUBLE) + level * (sum(w) OVER () - sum(w) OVER u) <= budget AS isfull
      FROM l WINDOW u AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT src, source_size, budget,
             CASE WHEN isfull THEN CAST(cap AS DOUBLE)
                  ELSE (budget - CAST(sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER () AS DOUBLE)) / nullif(sum(CASE WHEN isfull THEN 0.0::DOUBLE ELSE w END) OVER (), 0) * w END AS target FROM f),
q AS (SELECT d.*, source_size, target, budget,
             sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM d JOIN t USING (src)),
c AS (SELECT doc_id, size, h, e, budget, (CAST(source_size AS DOUBLE) * e + CAST(cum AS DOUBLE)) / nullif(target, 0) AS v
      FROM q, (SELECT unnest(range({MAX_REPEATS})) AS e) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY v, h, doc_id, size, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, coalesce(q.target, 0) AS target, coalesce(k.taken, 0) AS taken
FROM q LEFT JOIN k USING (doc_id)"""
