"""Spelling variants: words at distance one of each other, found by trie self-joins with active-node sets.

The vocabulary is counted on executors and dealt out by prefix. Each group of words with a common prefix becomes a trie,
which is walked from its root with the set of active nodes: the nodes whose strings are at most one insertion, deletion
or replacement away from the walked one. A child's set comes from its parent's, so words that share a prefix share that
work, and where the walk ends a word, the words that end in its active nodes are its partners.

Of two words at distance one whose shorter one has s code points, the first half of s is common to both, or what s has
beyond it is common to their ends. So tries are dealt by (s, first half) for words, and by (s, end) for words turned
round; a word stands in both as the shorter and as the longer one. Which of them reports a pair is decided by how many
first code points the two share, so each is reported once. A group that holds more than GROUP words is dealt again, by
all but a piece of at most PIECE code points in which the difference lies: its words then share what is before the piece
and what is after it, and a group has as few words as a piece has spellings.

Defined results: null texts have no words; a null id counts as an empty one; repeated rows count each, long texts whole;
no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, small, table

#: A word's letters are single bytes of Latin-1; all others become spaces, and A-Z a-z.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: One run in TYPO_IN loses a code point.
TYPO_IN = 199
LEAST_LETTERS, LEAST_N, FORM_TIMES = 6, 5, 5
#: Words of a group beyond which it is dealt again by pieces of PIECE code points.
GROUP, PIECE = 5000, 3
#: Words that a task counts before it hands them on.
_HELD = 400_000


def runs_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of a text that can give a word, in Latin-1."""
    return [run for run in (text or "").encode("latin-1", "replace").translate(_LETTERS).split() if len(run) >= LEAST_LETTERS]


def typos(doc_id: str | None, runs: Iterable[bytes]) -> list[tuple[bytes, bytes]]:
    """(run, what is left of it) for the runs that lose a code point: where the hash of the document's id and the run says so."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
    for run in runs:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if not h % TYPO_IN:
            out.append((run, run[: h % len(run)] + run[h % len(run) + 1 :]))
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of whole texts that have LEAST_LETTERS code points and stand LEAST_N times or more."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = {w.decode("latin-1"): n for w, n in held.items() if n and len(w) >= LEAST_LETTERS}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for part in parts:
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                runs = runs_of(body.as_py())
                held.update(runs)
                for run, left in typos(doc_id, set(runs)):
                    n = runs.count(run)
                    held[run] -= n
                    held[left] += n
                if len(held) > _HELD:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_N}")


class Trie:
    """A trie over (string, payload), and the self-join of its strings at distance one."""

    def __init__(self, words: Iterable[tuple[str, Any]]) -> None:
        self.root: dict[str, Any] = {}
        for word, held in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = held  # the empty key marks the end of a string

    def pairs(self) -> Iterator[tuple[Any, Any]]:
        """(payload, payload) of strings at distance one, in both directions."""
        # active nodes by identity: (node, distance); the only one at distance 0 is the walked node itself
        stack = [(self.root, {id(self.root): (self.root, 0), **{id(x): (x, 1) for c, x in self.root.items() if c}})]
        while stack:
            node, active = stack.pop()
            if "" in node:
                for other, distance in active.values():
                    if distance and "" in other:
                        yield node[""], other[""]
            for c, child in node.items():
                if c:
                    stack.append((child, _step(active, c)))


def _step(active: dict[int, tuple[dict[str, Any], int]], c: str) -> dict[int, tuple[dict[str, Any], int]]:
    """The active nodes of a child by c, from those of its parent."""
    out: dict[int, tuple[dict[str, Any], int]] = {}

    def put(node: dict[str, Any], distance: int) -> None:
        if (old := out.get(id(node))) is None or distance < old[1]:
            out[id(node)] = (node, distance)

    for node, distance in active.values():
        if not distance:
            put(node, 1)  # c is one too many
        if (same := node.get(c)) is not None:
            put(same, distance)
            if not distance:
                for k, x in same.items():
                    if k:
                        put(x, 1)  # one is missing after c
        if not distance:
            for k, x in node.items():
                if k and k != c:
                    put(x, 1)  # another one in c's place
    return out


def shared(a: str, b: str) -> int:
    """How many first code points two strings have in common."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _dealt(words: DataFrame) -> DataFrame:
    """(key, s, at, end, turned, word, n): each word in the groups of its halves. `word` is turned round where `turned` says so, and its first `at` code points are the group's; at `end` begins what the group does not look at."""
    size, turned = F.length("word"), F.explode(F.array(F.lit(False), F.lit(True))).alias("turned")
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).select("*", turned)
    half = F.floor(F.col("s") / 2).cast("int")
    oriented = each.select("s", "turned", F.when(F.col("turned"), F.col("s") - half).otherwise(half).alias("at"), F.when(F.col("turned"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n")
    key = F.concat_ws("|", F.col("turned").cast("string"), F.col("s").cast("string"), F.substring("word", F.lit(1), F.col("at")))
    return oriented.select(key.alias("key"), "s", "at", (F.col("s") + 1).alias("end"), "turned", "word", "n")


def _by_pieces(large: DataFrame) -> DataFrame:
    """The rows of large groups, dealt again by what lies around each piece of PIECE code points in which two of a group may differ."""
    pieces = large.select("*", F.explode(F.sequence(F.col("at"), F.col("s"), F.lit(PIECE))).alias("_i"))
    tail = F.greatest(F.lit(0), F.col("s") - F.col("_i") - PIECE)  # what lies after the piece in words of s code points; one more in a longer one
    key = F.concat_ws("|", "key", F.col("_i").cast("string"), F.substring("word", F.lit(1), F.col("_i")), F.when(tail > 0, F.substring("word", -tail, tail)).otherwise(""))
    return pieces.select(key.alias("key"), "s", F.col("_i").alias("at"), (F.col("_i") + PIECE).alias("end"), "turned", "word", "n")


def _pairs_of(rows: list[tuple[int, int, int, bool, str, int]]) -> Iterator[tuple[str, str, int]]:
    """(word, near, near_n) that a group of rows (s, at, end, turned, word, n) has to report."""
    s, at, end, turned = rows[0][:4]
    if len(rows) == 1 or min(len(w) for *_, w, _ in rows) > s:
        return
    for (a, _), (b, n) in Trie((w[at:], (w, n)) for *_, w, n in rows).pairs():
        if min(len(a), len(b)) == s and shared(a, b) < end:
            if not turned:
                yield a, b, n
            elif shared(a := a[::-1], b := b[::-1]) < s // 2:
                yield a, b, n


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, near_n): words(word, n) at distance one, in both directions, each once. words is read more than once."""
    keyed = _dealt(words)
    large = cut(keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > group).select("key"))
    if not large.isEmpty():
        side, _ = small(large)
        keyed = keyed.join(side, "key", "left_anti").unionByName(_by_pieces(keyed.join(side, "key", "left_semi")))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            found = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(found, ["word", "near", "near_n"])

        for part in parts:
            for k, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if k != key:
                    if rows:
                        out += _pairs_of(rows)
                    if len(out) > 8192:
                        yield flush()
                    key, rows = k, []
                rows.append(row)
        if rows:
            out += _pairs_of(rows)
        yield flush()

    return keyed.repartition("key").sortWithinPartitions("key", "word").mapInArrow(each, "word string, near string, near_n bigint")


def _followed(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) for each word of forms(word, form): the form that has no form itself. Every round doubles the steps taken."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        counts = now.groupBy("root").agg(F.count("*").alias("_n"))
        onward = cut(now.select(F.col("word").alias("_w"), F.col("root").alias("_r")).join(counts, F.col("_w") == F.col("root")).select("root", "_r", "_n"))
        if onward.isEmpty():
            return now
        moved = hot_join(now, onward, ["root"], "_n").select("word", F.col("_r").alias("root"))
        side, _ = small(onward.select("root"))
        now = cut(now.join(side, "root", "left_anti").select("word", "root").unionByName(moved))
    raise RuntimeError(f"spelling: roots not found after {most_rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", times: Column | int = FORM_TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word: its form is the near word that stands most often (then the first by code points), if that is `times` as often as itself."""
    words = table(word_counts(docs, id_col, text), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    known = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("b.m") >= F.col("n") * times, F.struct(F.col("b.w").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"))
    roots = _followed(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: Bytes of UTF-8 and CRC-32 by a table made by its rule; near words by equal strings once a code point is left out.
OP13_SQL = r"""
WITH RECURSIVE bit(i, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
y AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM y, crc),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN x b ON a.word = b.cut UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.cut = b.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM p GROUP BY word),
k AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
w(word, form, k) AS (SELECT word, word, 0 FROM k UNION ALL SELECT w.word, k.form, w.k + 1 FROM w JOIN k ON k.word = w.form WHERE k.form IS NOT NULL)
SELECT word, k.n, n_near, k.form, form_n, root FROM k JOIN (SELECT word, last(form ORDER BY k) AS root FROM w GROUP BY word) USING (word)"""
