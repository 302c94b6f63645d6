"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts are one group. Groups in decreasing size each enter the shard whose remaining capacity
is the tightest that holds them; remaining capacities stand in a balanced tree. Groups of about one size are
interchangeable, so the packing runs over size classes: the driver gets a table (class, number of groups), whose
rows are bounded by CLASS_BITS at any corpus size, and gives back runs of each class that go to one shard. A
class's size is its largest one, so a capacity is never exceeded. Executors then rank the groups of a class in two
levels and look the run up.

`shards_of` packs into as few shards of a fixed capacity as best-fit-decreasing needs; `even_shards` finds the
least capacity for which a given number of shards suffices, groups above the even share first getting shards of
their own.

Defined results: a null text has no bytes and forms one group (apart from empty texts); a row's size is its bytes
plus one, so no row is free; repeated rows fall in one group; no rows give no rows; a group above the fixed
capacity gets a shard of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, cut, hot_join, running_total

#: Significant bits of a class's size: classes are exact below 2^12 bytes and within 1 / 2^11 above; at most
#: 2^11 classes for each doubling of the size.
CLASS_BITS = 12
SHARDS = 8
#: Bytes of text in a file of a written shard, about.
FILE_BYTES = 256 << 20


class _Tree:
    """A treap of (remaining capacity, shard), with the tightest fit found in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def _priority(self) -> int:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return self.seed >> 33

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, [key, self._priority(), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least (remaining, shard) with remaining >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(right, (key[0], key[1] + 1))
        self.root = self._join(left, rest)
        return key


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, end rank, shard) of best-fit-decreasing over (size, count) classes.

    Opens shards as needed; None if that would be more than `most`. A size above the capacity has its own shards.
    """
    tree, runs, opened = _Tree(), [], 0
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and opened >= most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, shard = found
            fit = min(count - rank, room // size)
            runs.append((size, rank, rank + fit, shard))
            rank += fit
            tree.add((room - fit * size, shard))
    return runs


def pack_evenly(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """pack() with the least capacity that `shards` shards suffice for; sizes above the even share stand alone."""
    left, alone, runs = dict(classes), 0, []
    total = sum(s * c for s, c in classes)
    while left and shards - alone > 1 and (top := max(left)) * (shards - alone) >= total:
        rank = sum(end - start for size, start, end, _ in runs if size == top)
        runs.append((top, rank, rank + 1, alone))
        total, alone = total - top, alone + 1
        left[top] -= 1
        if not left[top]:
            del left[top]
    done = {size: end for size, _, end, _ in runs}
    rest = list(left.items())
    low = max(1, -(-total // (shards - alone)))
    high = low + max(left, default=0)  # suffices: a group fits nowhere only if all shards are filled above the even share
    best = pack(rest, high, shards - alone)
    while low < high:
        middle = (low + high) // 2
        if (found := pack(rest, middle, shards - alone)) is None:
            low = middle + 1
        else:
            high, best = middle, found
    return runs + [(size, start + done.get(size, 0), end + done.get(size, 0), shard + alone) for size, start, end, shard in best]


def _class_of(size: Column) -> Column:
    """The largest size that shares the CLASS_BITS leading bits of `size`."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - CLASS_BITS)
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return (F.floor(size / unit).cast("long") + F.when(drop > 0, 1).otherwise(0)) * unit - F.when(drop > 0, 1).otherwise(0)


def _group_of(text: Column) -> Column:
    """Equal for equal texts alone; null is a group of its own."""
    return F.when(text.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)))


def _size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def _place(rows: DataFrame, planned) -> tuple[DataFrame, int]:
    """(_g, _n, shard) of the groups of rows(_g, size), with the number of each group's rows, and the number of all; planned: the runs for a list of (class size, count)."""
    n = rows.count()
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")).withColumn("_class", _class_of(F.col("_bytes")))
    groups = cut(groups.withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(max(1, n // BUCKET_ROWS))).cast("long")).withColumn("_1", F.lit(1).cast("long")))
    runs = planned([(r["_class"], r["n"]) for r in groups.groupBy("_class").agg(F.count("*").alias("n")).collect()])
    runs.sort()
    start = np.array([(r[0], r[1]) for r in runs], dtype=[("s", "i8"), ("r", "i8")])
    shard = np.array([r[3] for r in runs], dtype="int32")

    def look_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = np.empty(len(part), dtype=start.dtype)
            at["s"], at["r"] = part["_class"], part["_rank"] - 1
            yield pd.DataFrame({"_g": part["_g"], "_n": part["_n"], "shard": shard[np.searchsorted(start, at, side="right") - 1]})

    ranked = running_total(groups, ["_class"], "_b", ["_g"], "_1", "_rank").select("_g", "_n", "_class", "_rank")
    return cut(ranked.mapInPandas(look_up, "_g binary, _n long, shard int")), n


def _assign(docs: DataFrame, id_col: str, text: str, planned) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); planned: the runs for a list of (class size, count)."""
    whole = F.col(text)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), _size_of(whole).alias("size"), F.crc32(F.encode(F.coalesce(whole, F.lit("")), "UTF-8")).alias("text_crc32"), _group_of(whole).alias("_g")))
    placed, n = _place(rows, planned)
    put = cut(hot_join(rows, placed, ["_g"], "_n", n).withColumn("_b", F.pmod(F.xxhash64("doc_id", "_g"), F.lit(max(1, n // BUCKET_ROWS))).cast("long")).withColumn("_1", F.lit(1).cast("long")))
    slots = running_total(put, ["shard"], "_b", ["doc_id", "_g"], "_1", "_slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") - 1).alias("slot"))


def shards_of(docs: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs into shards of `capacity` bytes, as few as best-fit-decreasing needs."""
    return _assign(docs, id_col, text, lambda classes: pack(classes, capacity))


def even_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs into `shards` shards of the least capacity that suffices."""
    return _assign(docs, id_col, text, lambda classes: pack_evenly(classes, shards))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the whole rows of docs to the shards of `even_shards`, a folder `shard=k` each, and returns the table as it is read back: `row`, a struct of a row's columns, and shard.

    A shard is files of about `file_bytes` of text each, dealt by id and text, so that neither a shard nor a group of copies
    is one task; rows equal in both stay together. Texts move once, to their files; beforehand too only where groups
    are too many for a broadcast. What stood at `path` is replaced, so a run may be repeated; no rows give an empty table.
    """
    whole = F.col(f"row.{text}")
    tagged = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"_g": _group_of(whole), "size": _size_of(whole)})
    placed, n = _place(cut(tagged.select("_g", "size")), lambda classes: pack_evenly(classes, shards))
    put = hot_join(tagged, placed, ["_g"], "_n", n)
    files = max(1, -(-(tagged.agg(F.sum("size")).first()[0] or 0) // (file_bytes * shards)))
    dealt = put.withColumn("_file", F.pmod(F.xxhash64(F.col(f"row.{id_col}").cast("string"), "_g"), F.lit(files)))
    dealt = dealt.repartition(shards * files, "shard", "_file").select("row", "shard")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)
