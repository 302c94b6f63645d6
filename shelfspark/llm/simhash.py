"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's bits are cut into few segments: two fingerprints that differ in at most 2s - 1 bits over s
segments have a segment that differs in at most one bit. Each segment is indexed once as it is and once for each
of its bits with that bit wildcarded; equal keys meet, and fingerprints that share a key are verified bit by bit.
Only keys that can link something go on: an exact key with two fingerprints or more, a wildcard key whose bit
takes both values (fingerprints that agree in the bit share the exact key too). Within a key a spanning forest of
the verified links is emitted, which is linear in the key's fingerprints, never all pairs.

Equal fingerprints are one node from the start, so exact copies cost one row. Components of the nodes come from
rounds of large-star and small-star joins.

The pipeline's stage takes candidates from the same signatures, of five-word shingles, and links by Jaccard similarity: see setsketch.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of any length count
whole; repeated rows share a fingerprint and a component; rows with null ids get their group's smallest id (null if
it has none); no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_join
from .components import components

SEED = 42
#: Bits in which linked fingerprints of the op7 query differ at most; 64 bits in two segments find all of them.
MAX_BITS = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS_AT_ONCE = 4096


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles, repeats included; a shorter text is one shingle; no words give none."""
    if not words:
        return []
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit majority of 64-bit hashes; blocks keep memory flat for very long texts."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes for the fingerprint's further 64-bit words, by a multiply-xorshift of the first ones."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_fingerprint(text: str | None, k: int = 3) -> np.ndarray:
    """The 64-bit SimHash of a text's k-word shingles."""
    found = shingles_of(words_of(text), k)
    return majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], dtype=np.uint64)) if found else np.zeros(1, np.uint64)


def fingerprints(docs: DataFrame, of: Callable[[str | None], np.ndarray], n_words: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): each row's fingerprint as signed 64-bit words."""
    names = [f"f{i}" for i in range(n_words)]

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = np.array([of(t.as_py()) for t in part.column(1)], dtype=np.uint64).reshape(-1, n_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(n_words))], ["doc_id", *names])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def _segment(start: int, width: int) -> F.Column:
    """Bits start .. start + width - 1 of the fingerprint as a number; width is at most 53."""
    word, bit = divmod(start, 64)
    low = F.shiftrightunsigned(F.col(f"f{word}"), bit)
    if bit + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - bit))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def variants(nodes: DataFrame, bits: int, segments: int) -> DataFrame:
    """nodes(id, f0, ...) with a row for each key: the exact value of each segment (bit null) and its one-wildcard variants (bit: the value under the wildcard).

    A key is the segment's value, above ten bits that tell which segment or which wildcard position it is.
    """
    ends = [bits * i // segments for i in range(segments + 1)]
    one, tag = F.lit(1).cast("long"), lambda v, t: F.shiftleft(v, 10).bitwiseOR(t.cast("long")).alias("key")

    def wildcards(i: int) -> F.Column:
        value = F.col(f"_v{i}")

        def at(j: F.Column) -> F.Column:
            under = F.call_function("shiftleft", one, j)
            return F.struct(tag(value.bitwiseAND(F.bitwise_not(under)), j + ends[i]), F.when(value.bitwiseAND(under) == 0, 0).otherwise(1).alias("bit"))

        return F.transform(F.sequence(F.lit(0), F.lit(ends[i + 1] - ends[i] - 1)), at)

    exact = F.array(*[F.struct(tag(F.col(f"_v{i}"), F.lit(bits + i)), F.lit(None).cast("int").alias("bit")) for i in range(segments)])
    cutup = nodes.select("*", *[_segment(ends[i], ends[i + 1] - ends[i]).alias(f"_v{i}") for i in range(segments)])
    return cutup.select(*nodes.columns, F.concat(exact, *[wildcards(i) for i in range(segments)]).alias("_keys")).select(*nodes.columns, F.inline_outer("_keys"))


def forest(ids: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among one key's nodes; linked(x, rest) tells which of rest have a link to x.

    Each step takes a node off the frontier and links to it all nodes that no tree has yet: nodes that are in
    a tree are never compared again, so one large family costs about one comparison a node.
    """
    rest, out = np.arange(len(ids)), []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = linked(x, rest)
            for y in rest[near]:
                out.append((int(ids[x]), int(ids[y])))
                frontier.append(y)
            rest = rest[~near]
    return out


def _each_key(handle: Callable[[np.ndarray], list[tuple[int, ...]]], columns: list[str], out: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows that are sorted by key: the rows that `handle` gives for the rows of each key."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the last key's rows, which the next batch may go on with
        found: list[tuple[int, ...]] = []

        def done(blocks: list[np.ndarray]) -> None:
            rows = np.concatenate(blocks)
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                found.extend(handle(rows[start:end]))

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame(found, columns=out, dtype="int64").drop_duplicates()
            found.clear()
            return rows

        for part in parts:
            if part.empty:
                continue
            rows = np.ascontiguousarray(part[columns].to_numpy(dtype=np.int64))
            split = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if split:
                done([*held, rows[:split]])
                held = []
            elif held and held[-1][0, 0] != rows[0, 0]:
                done(held)
                held = []
            held.append(rows[split:])
            if len(found) > _ROWS_AT_ONCE:
                yield flush()
        if held:
            done(held)
        yield flush()

    return each


def links(nodes: DataFrame, n_words: int, segments: int, most: int) -> DataFrame:
    """(a, b): links whose components are those of all links between nodes(id, f0, ...) that share a key and differ in at most `most` bits."""
    columns = ["key", "id", *[f"f{i}" for i in range(n_words)]]
    same = Window.partitionBy("key")
    keyed = variants(nodes, 64 * n_words, segments).withColumns({"_n": F.count("*").over(same), "_least": F.min("bit").over(same), "_most": F.max("bit").over(same)})
    alive = keyed.where((F.col("_n") > 1) & (F.col("bit").isNull() | (F.col("_least") < F.col("_most")))).select(*columns).sortWithinPartitions("key")

    def trees(rows: np.ndarray) -> list[tuple[int, ...]]:
        prints = rows[:, 2:].view(np.uint64)
        return forest(rows[:, 1], lambda x, rest: np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1) <= most)

    return alive.mapInPandas(_each_key(trees, columns, ["a", "b"]), "a bigint, b bigint").distinct()


def classes(prints: DataFrame, n_words: int, segments: int, most: int) -> DataFrame:
    """prints(doc_id, f0, ..., perhaps more) with component_id, the smallest doc_id reachable by links; rows that are equal but for doc_id are one node."""
    names = [c for c in prints.columns if c != "doc_id"]
    nodes = cut(prints.groupBy(*names).agg(F.min("doc_id").alias("id"), F.count("*").alias("_n")))
    roots = components(links(nodes.where("id is not null").drop("_n"), n_words, segments, most))
    rooted = cut(nodes.join(roots, F.col("id") == F.col("node"), "left").select(*names, "_n", F.coalesce("root", "id").alias("component_id")))
    return hot_join(prints, rooted, names, "_n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, component_id): classes of 64-bit fingerprints of three-word shingles that differ in at most MAX_BITS bits."""
    return classes(cut(fingerprints(docs, shingle_fingerprint, 1, id_col, text)), 1, 2, MAX_BITS)
