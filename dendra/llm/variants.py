"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

A word is a point: its rank in forward order and its rank in reverse order among the words
of its length. For every edit position, the words that agree before it are an interval of
the first and those that agree after it one of the second; a wavelet tree over the points
reports what lies in both. An edit leaves one half of the word whole, so points and queries
meet in shards by length and half; a shard that is too large is cut by points, and its
queries go to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import CREATED, dealt, finish, lean, release, remove, save, scratch
from dendra.llm.textgrams import runs, sorted_groups

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is this many times as frequent as its variant.
TIMES = 5
#: Of so many runs one loses a code point.
MODULUS = 199
#: Words of a shard; points that one index holds at most.
PER_SHARD, MOST_POINTS = 8_192, 32_768
#: Shard groups beyond MOST_POINTS that may be broadcast; beyond it they are joined by a shuffle.
MOST_HOT = 100_000
#: Range queries that are answered at once.
CHUNK = 1 << 19

_CODE = np.int64(1 << 21)  # above every code point


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z in lower case, of at least ``least_length`` code points and ``least_count`` occurrences.

    With a modulus, a run whose crc32 of ``<id>:<run>`` it divides loses its code point at crc32 % length (a null id is written as nothing)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("w"))
    word = F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = runs.select("i", word.alias("w"))
    if modulus:
        rows = rows.select("w", F.crc32(F.concat("i", F.lit(":"), "w")).alias("h")).select("w", F.when(F.col("h") % modulus == 0, F.col("h") % F.char_length("w")).cast("int").alias("at"))
        rows = rows.select(F.expr("CASE WHEN at IS NULL THEN w ELSE concat(left(w, at), substr(w, at + 2)) END").alias("w"))
    return rows.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


# ---- the index of one shard ---------------------------------------------------------------


def codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.int64)


class WaveletTree:
    """A permutation of 0..n-1 by bits, the highest first; reports the values of an interval of positions in an interval of values."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # numbers of 0 bits before each position
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [low, high) at a position in [left, right)."""
        q, v = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in zip(reversed(range(self.levels)), self.zeros, strict=True):
            half = 1 << level
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            a = np.flatnonzero((r0 > l0) & (low[q] < v + half))  # its values are v .. v + half - 1
            b = np.flatnonzero((r1 > l1) & (high[q] > v + half))
            b = b[low[q[b]] < v[b] + 2 * half]
            a = a[high[q[a]] > v[a]]
            left, right = np.concatenate([l0[a], l1[b]]), np.concatenate([r0[a], r1[b]])
            q, v = np.concatenate([q[a], q[b]]), np.concatenate([v[a], v[b] + half])
        return q, v


def intervals(points: np.ndarray, queries: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """[step, query] -> the interval of the sorted points that agree with the query in the first ``step`` columns."""
    n = len(points)
    low, high = np.zeros((steps + 1, len(queries)), np.int64), np.full((steps + 1, len(queries)), n)
    first = np.zeros(n, np.int64)
    for j in range(steps):
        key = first * _CODE + points[:, j]
        wanted = low[j] * _CODE + queries[:, j]
        low[j + 1] = np.searchsorted(key, wanted, "left")
        high[j + 1] = np.maximum(low[j + 1], np.minimum(np.searchsorted(key, wanted, "right"), high[j]))
        low[j + 1] = np.where(high[j] > low[j], low[j + 1], 0)
        high[j + 1] = np.where(high[j] > low[j], high[j + 1], 0)
        first = np.searchsorted(key, key, "left")
    return low, high


class Shard:
    """Points of one length, and queries that differ from them by one edit in one half."""

    def __init__(self, points: np.ndarray):
        self.length = points.shape[1]
        self.forward = np.lexsort(points.T[::-1])
        self.backward = np.lexsort(points.T)
        place = np.empty(len(points), np.int64)
        place[self.backward] = np.arange(len(points))
        self.tree = WaveletTree(place[self.forward])
        self.begins, self.ends = points[self.forward], points[self.backward][:, ::-1]

    def near(self, queries: np.ndarray, positions: range, skip: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) for queries that agree with a point before a position, and after it from ``skip`` characters on: 1 for
        queries with one character replaced (themselves included), or with one inserted, each run of equal ones once."""
        c, longest = self.length, queries.shape[1]
        before = intervals(self.begins, queries, min(c, positions.stop))
        behind = intervals(self.ends, queries[:, ::-1], min(c, longest - positions.start - 1))
        todo: list[tuple[np.ndarray, ...]] = []
        size = 0
        for i in positions:
            rest = longest - i - 1
            l, r, x, y = before[0][i], before[1][i], behind[0][rest], behind[1][rest]
            ok = (r - l >= skip) & (y - x >= skip)
            if longest > c and i:
                ok &= queries[:, i] != queries[:, i - 1]
            at = np.flatnonzero(ok)
            todo.append((at, l[at], r[at], x[at], y[at]))
            size += len(at)
            if size >= CHUNK or i == positions.stop - 1:
                at, l, r, x, y = (np.concatenate(part) for part in zip(*todo, strict=True))
                for k in range(0, len(at), CHUNK):
                    q, v = self.tree.report(l[k : k + CHUNK], r[k : k + CHUNK], x[k : k + CHUNK], y[k : k + CHUNK])
                    yield at[k : k + CHUNK][q], self.backward[v]
                todo, size = [], 0


def _best(words: list[str], n: np.ndarray, target: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near words, the most frequent of them, the least by code points of equals) of the words that have any."""
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[other], -n[other], target))
    target, other = target[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    return target[first], np.diff(np.concatenate([first, [len(target)]])), other[first]


def _near_in(words: list[str], length: int, side: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, other) of a shard's words that are one edit apart in the half that the side names; for kind see _copies()."""
    points, same, longer = (np.flatnonzero(x) for x in (kind == 0, kind <= 1, kind == 2))
    if len(points) == 0:
        return points, points
    shard, half = Shard(codes([words[i] for i in points], length)), length // 2
    targets, others = [points[:0]], [points[:0]]
    # an interval that holds nothing but the query itself needs no look
    for q, p in shard.near(codes([words[i] for i in same], length), range(half, length) if side == 0 else range(half), 1 if len(same) > len(points) else 2):
        targets.append(same[q])
        others.append(points[p])
    if len(longer):
        for q, p in shard.near(codes([words[i] for i in longer], length + 1), range(half, length + 1) if side == 0 else range(half), 1):
            targets += [longer[q], points[p]]
            others += [points[p], longer[q]]
    target, other = np.concatenate(targets), np.concatenate(others)
    keep = target != other
    return target[keep], other[keep]


@lean
def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards sorted by key -> (word, near, best_n, best): for every word what the shard has near it."""
    for t in sorted_groups(batches):
        edges = runs(t["key"].to_numpy())
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            g = t.slice(a, b - a)
            words, n = g["word"].to_pylist(), g["n"].to_numpy().astype(np.int64)
            target, other = _near_in(words, g["length"][0].as_py(), g["side"][0].as_py(), g["kind"].to_numpy())
            if len(target):
                w, near, best = _best(words, n, target, other)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in w], pa.string()), pa.array(near), pa.array(n[best]), pa.array([words[i] for i in best], pa.string())], ["word", "near", "best_n", "best"])


# ---- shards -------------------------------------------------------------------------------


def _copies(words: DataFrame) -> DataFrame:
    """Every word as a point of its length, for edits behind its first half (side 0) and inside it (side 1), and as a query on the next shorter length. kind: 0 point and query, 2 query that is one longer."""
    m = F.char_length("word")

    def copy(length, side: int, kind: int):
        half = F.floor(length / 2).cast("int")
        part = F.left("word", half) if side == 0 else F.right("word", length - half)
        return F.struct(length.alias("length"), F.lit(side).alias("side"), F.lit(kind).alias("kind"), part.alias("half"))

    return words.select("word", "n", F.explode(F.array(copy(m, 0, 0), copy(m, 1, 0), copy(m - 1, 0, 2), copy(m - 1, 1, 2))).alias("x")).select("word", "n", "x.*")


def near_words(words: DataFrame, per_shard: int = PER_SHARD, most_points: int = MOST_POINTS) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n; distinct) that have another one edit away: how many there are, and the most frequent of them."""
    shards = max(1, -(-words.count() // per_shard))
    rows = _copies(words)
    group = ["length", "side", "half"]
    # a half that very many words share is cut by points; all its queries go to every part
    points = rows.where("kind = 0").groupBy(*group).agg(F.count("*").alias("m")).where(F.col("m") > most_points)
    hot = save(points.select(*group, F.ceil(F.col("m") / most_points).cast("int").alias("parts")), scratch(words.sparkSession, "variants-hot"))
    rows = rows.join(F.broadcast(hot) if hot.count() <= MOST_HOT else hot, group, "left")
    own = F.pmod(F.xxhash64("word", F.lit(13)), F.coalesce("parts", F.lit(1))).cast("int")
    part = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("word", "n", "length", "side", "half", "kind", "parts", own.alias("own"), part.alias("part"))
    kind = F.when((F.col("kind") == 0) & (F.col("own") != F.col("part")), 1).otherwise(F.col("kind"))
    # a hot half has shards of its own; the others share them
    place = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("half"), F.lit(shards))).otherwise(F.xxhash64("half", F.lit(1)))
    rows = rows.select("word", "n", "length", "side", kind.cast("int").alias("kind"), F.xxhash64("length", "side", place, "part").alias("key"))
    found = dealt(rows, 8 * shards).mapInArrow(_report, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to their last, by doubling the steps until nothing moves. Forms must have no cycle."""
    spark = forms.sparkSession
    path = scratch(spark, "variants-roots")
    now = save(forms.select("word", F.col("form").alias("root")), path)
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        following = scratch(spark, "variants-roots")
        rows = save(moved, following)
        remove(spark, path)
        path, now = following, rows.select("word", "root")
        if rows.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, times: int = TIMES, **sizes: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each once: near words differ by one inserted, deleted or replaced code
    point; the form is the most frequent near word (the least by code points of equals) if it is ``times`` as frequent, else null; the
    root is the last form of forms, the word itself without one."""
    spark = words.sparkSession
    near = save(words.join(near_words(words, **sizes), "word", "left"), scratch(spark, "variants-near"))
    chosen = F.col("best_n") >= times * F.col("n")
    rows = near.select("word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n"))
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """group_variants() over the vocabulary() of whole texts.

    Null and empty texts have no words, repeated rows count again, a null id is written as nothing; empty tables give no
    rows and other columns are not read. Words may be of any length."""
    spark = docs.sparkSession
    since = len(CREATED)
    words = save(vocabulary(docs, id_col, text_col, modulus, least_length, least_count), scratch(spark, "variants-words"))
    out = finish(group_variants(words, times), "op13", since)
    release(spark)
    return out
