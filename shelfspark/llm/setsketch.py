"""Near copies by SetSketch registers: classes of documents whose sets of five-word shingles have a given Jaccard similarity.

A document's set becomes REGISTERS registers of one byte: for each hash function the least hash over the set, as an
exponential variable, is cut down to the exponent of BASE that it lies at. Registers of a union are the maxima of its
parts' (:func:`merged`), and two sets agree in a register about as often as their similarity says. Three steps follow:

1. Bands of BAND_ROWS registers are keys; a key that two sets share makes them candidates. Sets of similarity J share
   one with probability 1 - (1 - J ** BAND_ROWS) ** BANDS at least: all but 3 in 10^8 at 0.85, all but 7 in 10^6 at 0.8.
2. Within a key the similarity is estimated jointly, from how many registers are larger, smaller and equal and from
   both sizes: pairs go on whose likelihood still rises at SLACK below the threshold, which is five standard errors.
   What goes on is a spanning forest of them, and components of all keys' forests are clusters, each a row a set.
3. Within a cluster the texts' full sets are compared, exactly: by an index of each set's least frequent shingles of
   which similar sets must share one, then by the sizes of intersection and union. Links are a spanning forest again.

The pipeline's stage (:func:`one_of_each_class`) goes by deletion-variant signatures first: every pair of sets whose
SimHashes of 64 bits differ in at most VARIANT_BITS shares the value of a segment or one of its one-wildcard variants, is
verified bit by bit (see simhash) and joins its cluster. Sets of similarity 0.8 differ in about ten bits, though, so steps 1
and 2 bring the pairs that lie beyond these bits into the clusters, and step 3 compares what both have found.

Nothing is emitted a pair: forests are linear in a group's sets. Groups of any size are cut into blocks of bounded
memory; blocks share the group's first set, and what still links different classes across blocks is found by a second
pass, in which sets outside the group's main class meet all of its blocks. Equal sets are one node from the start.
Texts move only for sets with an estimated partner, one text a set.

Defined results: words are lower-cased A-Z, between ASCII white space; a text of fewer than five words is one shingle;
sets without a shingle (null or empty texts) link with nothing, or with each other where `empty_too` says so; texts of
any length count whole; repeated rows are in one class; rows with null ids get their class's smallest id (null if it has
none); no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flagged, hot_join, small, table, without
from .components import components
from .simhash import SEED, forest, links, majority, shingles_of, words_of

SIMILAR_WORDS = 5
BANDS, BAND_ROWS = 30, 5
REGISTERS = BANDS * BAND_ROWS
#: Registers are exponents of BASE, cut to 0 .. 255, of an exponential variable of RATE a shingle: sets of 1 to 10^7 shingles are within.
BASE, RATE = 1.125, 20.0
#: Bits of the sets' SimHashes in which deletion variants over two segments find every pair.
VARIANT_BITS = 3
#: Sets of one block at most where registers are compared; shingles of one block where full sets are.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1_000_000
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's five-word shingles, in order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles_of(words_of(text), SIMILAR_WORDS)], dtype=np.uint64))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes; all 0 for the empty one."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint8)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, i : i + (1 << 12)] * _ODD[:, None]).min(axis=1), out=least)
    waits = -np.log1p(-(np.minimum(least.astype(np.float64), 2.0**64 - 4096) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(waits) / np.log(BASE)), 0, 255).astype(np.uint8)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(one, other)


def _larger(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability that a register of one set is the larger one, x being the share of the union's weight that only this set has (as in u - v J), and its slope."""
    c, log = (BASE - 1) / BASE, np.log(BASE)
    return -np.log1p(-x * c) / log, c / ((1 - x * c) * log)


def rises(larger: np.ndarray, smaller: np.ndarray, own: np.ndarray, other: np.ndarray, at: float) -> np.ndarray:
    """Whether the joint likelihood of the similarity still rises at `at`, so that its maximum is there or above; `own` and `other` are the sets' sizes, whose ratio must be above `at`."""
    u = own / (own + other)
    v = 1 - u
    (p, dp), (q, dq) = _larger(u - v * at), _larger(v - u * at)
    equal = REGISTERS - larger - smaller
    return equal * (v * dp + u * dq) / (1 - p - q) - larger * v * dp / p - smaller * u * dq / q >= 0


def slack(percent: int) -> float:
    """Five standard errors of a similarity of `percent`."""
    j = percent / 100
    return 5 * (j * (1 - j) / REGISTERS) ** 0.5


class Sketches:
    """Sets by their registers: which may be similar by `percent`."""

    def __init__(self, group: pa.Table, percent: int) -> None:
        self.regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        self.sizes, self.percent = group.column("n").to_numpy().astype(np.float64), percent

    def near(self, x: int, rest: np.ndarray) -> np.ndarray:
        own, sizes = self.sizes[x], self.sizes[rest]
        fits = np.minimum(own, sizes) * 100 >= np.maximum(own, sizes) * self.percent
        at = rest[fits]
        if len(at):
            mine, theirs = self.regs[x], self.regs[at]
            likely = rises((theirs < mine).sum(axis=1), (theirs > mine).sum(axis=1), own, self.sizes[at], self.percent / 100 - slack(self.percent))
            fits[fits] = likely
        return fits


class Sets:
    """Full sets: which are similar by `percent`, exactly, by an index of the shingles that similar sets must share one of."""

    def __init__(self, group: pa.Table, percent: int) -> None:
        sets = [shingle_hashes(t.as_py()) for t in group.column("text")]
        self.percent, self.sizes = percent, np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        of = np.repeat(np.arange(len(sets)), self.sizes)
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        ids = rank[ids]
        self.ids = ids[np.lexsort((ids, of))]  # of each set its least frequent shingles first
        self.marked = np.zeros(len(counts), bool)
        # sets that share `percent` of their union share that much of each: the first shingles of both, that many less, have one in common
        self.heads = self.sizes - -(-self.sizes * percent // 100) + 1
        place = np.arange(len(ids)) - np.repeat(self.starts[:-1], self.sizes)
        first = place < np.repeat(self.heads, self.sizes)
        order = np.argsort(self.ids[first], kind="stable")
        self.posted, self.posts = self.ids[first][order], of[first][order]
        self.open = np.zeros(len(sets), bool)

    def near(self, x: int, rest: np.ndarray) -> np.ndarray:
        own = self.ids[self.starts[x] : self.starts[x + 1]]
        head = own[: self.heads[x]]
        begin, end = np.searchsorted(self.posted, head), np.searchsorted(self.posted, head, side="right")
        found = np.zeros(len(rest), bool)
        if (end - begin).sum() < len(rest):
            self.open[:] = False
            for a, b in zip(begin, end, strict=True):
                self.open[self.posts[a:b]] = True
            asked = np.flatnonzero(self.open[rest])
        else:
            asked = np.arange(len(rest))
        sizes = self.sizes[rest[asked]]
        asked = asked[np.minimum(sizes, len(own)) * 100 >= np.maximum(sizes, len(own)) * self.percent]
        self.marked[own] = True
        for i in asked:
            y = rest[i]
            both = int(self.marked[self.ids[self.starts[y] : self.starts[y + 1]]].sum())
            found[i] = both * 100 >= self.percent * (len(own) + int(self.sizes[y]) - both)
        self.marked[own] = False
        return found


Kind = Callable[[pa.Table, int], Sketches | Sets]


def by_key(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        keys = part.column(0).to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]):
            if held and held[-1].column(0)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _compared(rows: DataFrame, held: DataFrame, handle: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what `handle` gives for the nodes of each key of rows(key, g, ...), with what is held(g, ...) of them."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in by_key(parts):
            if group.num_rows > 1:
                out += handle(group)
            if len(out) > 65_536:
                yield _edges(out)
                out = []
        yield _edges(out)

    met = rows.join(held, "g")
    return met.select("key", *[c for c in met.columns if c != "key"]).repartition("key").sortWithinPartitions("key").mapInArrow(each, "a bigint, b bigint").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(g, root) of each g with an edge, roots included."""
    found = components(edges).select(F.col("node").alias("g"), "root")
    return cut(found.unionByName(found.select(F.col("root").alias("g"), "root").distinct()))


def _across(wide: DataFrame, held: DataFrame, roots: DataFrame, kind: Kind, percent: int, most: int) -> DataFrame | None:
    """Links within keys of wide(key, g, w), which have more than one block, between nodes that have not the same root yet; None if all have.

    A key's nodes that are not of its heaviest root are compared with all of the key's nodes, block by block.
    """
    of = cut(wide.join(roots, "g", "left").withColumn("root", F.coalesce("root", "g")))
    shares = of.groupBy("key", "root").agg(F.sum("w").alias("c"), F.count("*").alias("m")).groupBy("key")
    counts = shares.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("most"), F.sum("m").alias("_of"), F.count("*").alias("classes"))
    left = cut(counts.where("classes > 1").drop("classes"))
    if left.isEmpty():
        return None
    rows = cut(hot_join(of, left, ["key"], "_of"))
    blocks, parts = F.ceil(F.col("n") / most).cast("long"), F.ceil((F.col("n") - F.col("most")) / most).cast("long")
    turn = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    everyone = rows.select("key", "g", "root", F.lit(0).cast("long").alias("new"), F.pmod(F.xxhash64("g"), blocks).alias("i"), turn(parts).alias("j"))
    others = rows.where("root <> main").select("key", "g", "root", F.lit(1).cast("long").alias("new"), turn(blocks).alias("i"), F.pmod(F.xxhash64("g"), parts).alias("j"))
    met = everyone.unionByName(others).select(F.xxhash64("key", "i", "j").alias("key"), "g", "root", "new")

    def crossing(group: pa.Table) -> list[tuple[int, int]]:
        known, roots, new = kind(group, percent), group.column("root").to_numpy(), group.column("new").to_numpy()
        old, out = np.flatnonzero(new == 0), []
        for x in np.flatnonzero(new == 1):
            rest = old[roots[old] != roots[x]]
            if len(rest):
                out += [(int(roots[x]), int(root)) for root in np.unique(roots[rest[known.near(x, rest)]])]
        return out

    return _compared(met, held, crossing)


def group_links(rows: DataFrame, held: DataFrame, kind: Kind, percent: int, most: int) -> DataFrame:
    """(g, root) of the nodes that have a link: components of all links that `kind` sees within the keys of rows(key, g, w, total), where held(g, ...) is what it looks at.

    `w` is a node's weight and `total` its key's; blocks have a weight of about `most`.
    """
    blocks = F.ceil(F.col("total") / most).cast("long")
    dealt = rows.select("key", "g", F.pmod(F.xxhash64("g"), blocks).alias("block"))
    wide = rows.where(F.col("total") > most)
    pivots = wide.groupBy("key").agg(F.min("g").alias("g"), F.max(blocks).alias("_b")).select("key", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("block"))
    first = dealt.unionByName(pivots).distinct().select(F.xxhash64("key", "block").alias("key"), "g")

    def trees(group: pa.Table) -> list[tuple[int, int]]:
        return forest(group.column("g").to_numpy(), kind(group, percent).near)

    edges = cut(_compared(first, held, trees))
    roots = _roots(edges)
    if not wide.isEmpty() and (more := _across(wide.select("key", "g", "w"), held, roots, kind, percent, most)) is not None:
        roots = _roots(edges.unionByName(more))
    return roots


def sketched(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t, g, n, regs, f0) of each row: hashes of its text and of its set, the set's size, its registers and its SimHash."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [shingle_hashes(t.as_py()) for t in part.column(2)]
            whole = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), whole, pa.array([len(h) for h in found], pa.int64()), pa.array([registers(h).tobytes() for h in found], pa.binary()), pa.array([int(majority(h).view(np.int64)[0]) for h in found], pa.int64())], ["doc_id", "t", "g", "n", "regs", "f0"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("_text"))
    return given.mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_col]}, t bigint, g bigint, n bigint, regs binary, f0 bigint")


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(g, root): clusters of nodes(g, n, regs) that share a band and whose estimate is near the threshold or above."""
    band = lambda i: F.xxhash64(i, F.substring("regs", i * BAND_ROWS + 1, F.lit(BAND_ROWS)))
    keyed = nodes.where("n > 0").select("g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    stats = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("g").alias("_least"), F.max("g").alias("_most"), F.bit_xor("g").alias("_all")).where("n > 1"))
    # keys whose nodes are the same are one key
    alike = stats.select("key", "n", F.xxhash64("n", "_least", "_most", "_all").alias("set"), F.col("n").alias("_of"))
    shared = cut(hot_join(keyed, alike, ["key"], "_of").select(F.col("set").alias("key"), "g", F.lit(1).cast("long").alias("w"), F.col("n").alias("total")).distinct())
    # registers of nodes that meet none are told by a bitmap and stay where they are
    held = flagged(nodes.select("g", "n", "regs"), F.col("g"), shared.select(F.col("g").alias("k")).distinct()).where("_maybe").drop("_maybe")
    return group_links(shared, held, Sketches, percent, BLOCK_SETS)


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all nodes(g, n, f0) with SimHashes that differ in at most VARIANT_BITS bits, by deletion variants."""
    given = nodes.where("n > 0").select("g", "f0")
    prints = cut(given.groupBy("f0").agg(F.min("g").alias("id"), F.count("*").alias("_n")))
    same = hot_join(given, prints.where("_n > 1"), ["f0"], "_n").where("g <> id").select(F.col("id").alias("a"), F.col("g").alias("b"))
    return same.unionByName(links(prints.select("id", "f0"), 1, 2, VARIANT_BITS))


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(g, text) for wanted(g, doc, t), from the row with that id and hash of its text, or one of them. wanted is read more than once."""
    given = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_t"), F.col(text).alias("text"))
    same = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_t") == F.col("t"))
    side, fits = small(wanted)
    if not fits:
        given = flagged(given, F.xxhash64("_doc", "_t"), wanted.select(F.xxhash64("doc", "t").alias("k"))).where("_maybe").groupBy("_doc", "_t").agg(F.any_value("text").alias("text"))
    return given.join(side, same).groupBy("g").agg(F.any_value("text").alias("text"))


def classes(docs: DataFrame, percent: int, id_col: str = "doc_id", text: str = "text", empty_too: bool = False, variants: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, g, n) of each row, and (g, root, n, rows, first) of each set: its class, size, rows and first row (none, doc_id, t), rows without an id last.

    Sets are in one class if a chain of sets joins them, each of which shares `percent` of its union with the next. Empty
    sets are nodes like any other; whether their rows are one class is for the caller to say, by `empty_too`. With `variants`
    the candidates come from deletion variants of the sets' SimHashes too.
    """
    prints = table(sketched(docs, id_col, text), "prints")
    own = prints if empty_too else prints.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    nodes = table(own.groupBy("g").agg(F.any_value("n").alias("n"), F.any_value("regs").alias("regs"), F.any_value("f0").alias("f0"), F.count("*").alias("rows"), first), "nodes")
    near = cut(_near_prints(nodes)) if variants else None
    clusters = _candidates(nodes, percent)
    if near is not None and not near.isEmpty():
        clusters = _roots(near.unionByName(clusters.where("g <> root").select(F.col("root").alias("a"), F.col("g").alias("b"))))
    members = cut(clusters.join(nodes.select("g", "n", "first"), "g"))
    totals = members.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("_of"))
    rows = cut(hot_join(members.select(F.col("root"), "g", F.col("n").alias("w")), totals, ["root"], "_of").withColumnRenamed("root", "key"))
    texts = _texts(docs, members.select("g", F.col("first.doc_id").alias("doc"), "first.t"), id_col, text)
    roots = group_links(rows, texts, Sets, percent, BLOCK_SHINGLES)
    return prints.select("doc_id", "t", "g", "n"), cut(nodes.drop("regs", "f0").join(roots, "g", "left").withColumn("root", F.coalesce("root", "g")))


def _class_first(nodes: DataFrame) -> DataFrame:
    """(g, rows, first) of nodes(g, root, rows, first): the first row of each one's whole class."""
    least = cut(nodes.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("_of")))
    return hot_join(nodes.select("root", "g", "rows"), least, ["root"], "_of").select("g", "rows", F.col("least").alias("first"))


def near_copies(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: classes of near copies, exact copies included, by their smallest id; rows without a shingle are each by themselves."""
    rows, nodes = classes(docs, percent, id_col, text)
    met = hot_join(rows.where("n > 0"), cut(_class_first(nodes)), ["g"], "rows").select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
    return met.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each_class(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class its row with the smallest id, then the least hash of the text; all columns stay.

    Rows go by what they are, not by their ids: different texts under one id, and rows with null ids, are judged each by
    itself; texts without a word are one class. Of rows with equal id and text the first by its other columns stays.
    """
    rows, nodes = classes(docs, percent, id_col, text, empty_too=True, variants=True)
    distinct = cut(rows.groupBy("doc_id", "t").agg(F.count("*").alias("n")))
    firsts = cut(_class_first(nodes).select("first.doc_id", "first.t").distinct())
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("t"))
    is_first = F.col("f.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("f.t") == F.col("d.t"))
    later = cut(distinct.alias("d").join(firsts.alias("f"), is_first, "left_anti").select("doc_id", "t"))
    given = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_t"))
    first = without(given, later, same, F.xxhash64("_doc", "_t"), F.xxhash64("doc_id", "t"))
    repeated = cut(distinct.alias("d").where("n > 1").join(firsts.alias("f"), is_first, "left_semi").select("doc_id", "t"))
    if repeated.isEmpty():
        return first.select("_row.*")
    # only rows that may be repeated are shuffled
    maybe = flagged(first, F.xxhash64("_doc", "_t"), repeated.select(F.xxhash64("doc_id", "t").alias("k")))
    few, _ = small(repeated)
    asked = maybe.where("_maybe").drop("_maybe")
    again = asked.join(few, same, "left_semi").groupBy("_doc", "_t").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return maybe.where("not _maybe").select("_row").unionByName(asked.join(few, same, "left_anti").select("_row")).unionByName(again.select("_row")).select("_row.*")


#: All pairs of distinct sets that share a shingle, and their transitive closure.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) END AS s FROM d),
h AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS g, s FROM s),
u AS (SELECT g, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS doc_id FROM h WHERE n > 0 GROUP BY g),
x AS (SELECT doc_id, n, md5_number(unnest(s)) AS k FROM u),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_shingles, CASE WHEN h.n = 0 THEN h.doc_id ELSE root END AS component_id, h.n = 0 OR h.doc_id = root AS kept FROM h LEFT JOIN u USING (g) LEFT JOIN c ON c.a = u.doc_id"""
