"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts by language and bucket come from all training rows. The matrix of logarithms is in
fixed point, so a document's sums don't depend on how it is cut or batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import crc_remainder, held, lean, small_batches

#: Lengths of the n-grams.
ORDERS = (1, 2, 3, 4)
#: Buckets of a language, and cells of the whole matrix: 32 MB at most, so more languages get fewer buckets each.
MOST_BUCKETS, LEAST_BUCKETS, MOST_CELLS = 1 << 16, 1 << 8, 1 << 22
#: Added to every count.
PRIOR = 0.5
#: Fixed point of the logarithms.
UNIT = 1 << 20
FOLDS, HELD = 4, 2
NO_LANG = "und"
#: Characters that are handled at once, and languages whose counts a task holds at once.
PIECE, HELD_LANGS = 1 << 18, 64

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _coded(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the text in lower case; each run of others than letters, and either end, is one 0."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(letters[a], a, np.uint32(0))
    a = np.concatenate([np.zeros(1, np.uint32), a, np.zeros(1, np.uint32)])
    return a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]


def _buckets(a: np.ndarray, k: int, n: int) -> np.ndarray:
    """Bucket (of n, a power of two) of every k neighbouring code points."""
    size = len(a) - k + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, k, np.uint64)
    for j in range(k):
        h = (h ^ a[j : j + size]) * _MULT
        h ^= h >> np.uint64(29)
    return (h & np.uint64(n - 1)).astype(np.int64)


def grams(text: str, n: int, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, some PIECE characters of one length at a time."""
    a = _coded(text, letters)
    for at in range(0, len(a), PIECE):
        for k in ORDERS:
            yield _buckets(a[at : at + PIECE + k - 1], k, n)


def _counted(n: int):
    """(text, lang) -> (lang, bucket, c, docs): counts of a task; bucket -1 counts the documents."""

    def rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(c[at])], ["lang", "bucket", "c"])

    def add(c: np.ndarray, found: list[np.ndarray]) -> None:
        if found:
            c[1:] += np.bincount(np.concatenate(found), minlength=n)
            found.clear()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = held("langid", "letters", _letters)
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text or "")
            for lang, mine in texts.items():
                if lang not in counts and len(counts) >= HELD_LANGS:
                    yield from rows(counts)
                    counts = {}
                c = counts.setdefault(lang, np.zeros(n + 1, np.int64))
                c[0] += len(mine)
                found, size = [], 0
                for text in mine:
                    for g in grams(text, n, letters):
                        found.append(g)
                        size += len(g)
                        if size > 4 * PIECE:
                            add(c, found)
                            size = 0
                add(c, found)
        yield from rows(counts)

    return run


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [bucket, language], fixed point
    prior: np.ndarray  # [language], fixed point

    def sums(self, text: str, letters: np.ndarray) -> np.ndarray:
        """Logarithms of prior times likelihood in fixed point."""
        out = self.prior.copy()
        step = max(1, (1 << 22) // len(self.langs))
        for g in grams(text, len(self.table), letters):
            for i in range(0, len(g), step):
                out += self.table[g[i : i + step]].sum(0)
        return out

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        """The likeliest language (the first by code point of equals) and its posterior; without a letter ``und`` and 0."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return NO_LANG, 0.0
        x = self.sums(text, letters)
        best = int(x.argmax())
        return self.langs[best], float(1 / np.exp((x - x[best]) / UNIT).sum())


def fit(rows: DataFrame) -> Model:
    """rows: (text, lang), lang not null. The driver gets a row for each language and bucket, MOST_CELLS at most.

    ValueError for more languages than MOST_CELLS / LEAST_BUCKETS: such a column is no language."""
    small_batches(rows.sparkSession)
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST_CELLS // LEAST_BUCKETS + 1).collect())
    if len(langs) > MOST_CELLS // LEAST_BUCKETS:
        raise ValueError(f"more than {MOST_CELLS // LEAST_BUCKETS} languages")
    if not langs:
        return Model([], np.zeros((1, 0), np.int64), np.zeros(0, np.int64))
    n = min(MOST_BUCKETS, 1 << (MOST_CELLS // len(langs)).bit_length() - 1)
    found = rows.select("text", "lang").mapInArrow(_counted(n), "lang string, bucket int, c bigint").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    at = {x: i for i, x in enumerate(langs)}
    where, bucket, c = np.array([at[x] for x in found["lang"].to_pylist()], np.int64), found["bucket"].to_numpy(), found["c"].to_numpy()
    docs = np.zeros(len(langs))
    docs[where[bucket < 0]] = c[bucket < 0]
    counts = np.zeros((n, len(langs)))
    inside = bucket >= 0
    counts[bucket[inside], where[inside]] = c[inside]
    table = np.log(counts + PRIOR) - np.log(counts.sum(0) + PRIOR * n)
    return Model(langs, np.rint(table * UNIT).astype(np.int64), np.rint(np.log(docs / docs.sum()) * UNIT).astype(np.int64))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the matrix is broadcast (MOST_CELLS numbers at most)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = held("langid", "letters", _letters), shared.value
        for b in batches:
            found = [m.predict(t, letters) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(F.col(text_col).cast("string").alias("__text"), id_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, out_fold: int = HELD) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; trained on rows with a language whose crc32(doc_id) mod folds is not ``out_fold``.

    Texts that are null or have no letter are ``und`` with score 0, as are all where nothing can be learned. Null ids don't
    train, and are null in held_out; repeated rows count again; equal texts get equal results; other columns are not read."""
    rest = crc_remainder(id_col, folds)
    train = docs.where(F.col(lang_col).isNotNull() & (rest != out_fold)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return predict(docs, fit(train), id_col, text_col).select(id_col, (rest == out_fold).alias("held_out"), "lang_pred", "score")
