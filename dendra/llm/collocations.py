"""Phrase collocations: n-grams counted by language, scored against their parts, ranked.

Phrases of one to five neighbouring words are exploded into rows and aggregated by
language. A phrase can be frequent only if all phrases inside it are, so a first pass counts
those of one to three words by hash alone, and the second explodes only phrases whose parts
pass. They travel as a bit map of bounded size: a full one lets more phrases through and
changes no result, since counts are made by the phrases themselves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import CREATED, finish, lean, save, scratch, small_batches
from dendra.llm.textgrams import blocks, chained, mix, runs, word_hashes

MOST_WORDS = 5
LEAST_COUNT = 100
PER_LANG = 2000
#: A phrase goes if a longer one that holds it has this share (percent) of its count.
ABSORBED = 100
NO_LANG = "und"
#: Words of the phrases that the first pass counts.
FIRST = 3
#: Bits of the map of frequent short phrases: PER_PHRASE for each, at most 16 MB in all.
PER_PHRASE = 64
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_MAP_PART = 32_768  # bits that bitmap_construct_agg puts into one blob
#: Hashes that a task holds before it hands their counts on.
HELD_HASHES = 3_000_000
#: Rows and bytes of phrases of one batch that goes back to the JVM (a longer phrase is a batch of its own).
BATCH, BATCH_BYTES = 100_000, 4 << 20
#: First ranks are taken within so many parts of a language, so its last ranking reads PARTS * PER_LANG rows at most.
PARTS = 16
#: Languages whose totals may be broadcast; beyond it they are joined by a shuffle.
MOST_LANGS = 100_000

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _CUT.copy()
_GAP[[32, 9]] = True
_SPACES = re.compile(rb"\t[ \t]*| [ \t]+")


def _words(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: (bytes in lower case with one space for each gap, word starts, ends, hashes, number of the word's piece)."""
    raw = [_SPACES.sub(b" ", t.encode().lower()) for t in texts if t]
    for _, _, joined, _ in blocks(raw):
        s, e, h = word_hashes(joined, _GAP)
        if len(h):
            yield joined, s, e, h, np.cumsum(_CUT[np.frombuffer(joined, np.uint8)])[s]


def _grams(h: np.ndarray, piece: np.ndarray, k: int, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, by language and k, and whether they lie in one piece."""
    g = chained(h, k)
    return mix(g ^ np.uint64(zlib.crc32(f"{k}:{lang}".encode()))), piece[: len(g)] == piece[k - 1 :]


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[str | None]]:
    out: dict[str, list[str | None]] = {}
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        out.setdefault(lang, []).append(text)
    return out


def _summed(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate(hashes)
    h.sort()
    r = runs(h)
    return h[r[:-1]], np.diff(r)


@lean
def _explode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (h, c): hashes of phrases of up to FIRST words with their counts so far."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        h, c = _summed(held)
        for i in range(0, len(h), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + BATCH].view(np.int64)), pa.array(c[i : i + BATCH])], ["h", "c"])

    for b in batches:
        for lang, texts in _by_lang(b).items():
            for _, _, _, h, piece in _words(texts):
                for k in range(1, FIRST + 1):
                    g, inside = _grams(h, piece, k, lang)
                    held.append(g[inside])
                    size += len(held[-1])
                if size >= HELD_HASHES:
                    yield from out()
                    held, size = [], 0
    if size:
        yield from out()


def _frequent(df: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """The bit map of hashes that stand ``least`` times or more, and the bits of a hash that it goes by."""
    # tasks have summed what they can: the rest meets after the exchange
    counted = df.mapInArrow(_explode_short, "h bigint, c bigint").repartition("h").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    found = save(counted.select("h"), scratch(df.sparkSession, "collocations-short"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_PHRASE * max(1, found.count()) - 1).bit_length()))
    bit = F.shiftrightunsigned("h", 65 - bits.bit_length())
    parts = found.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _MAP_PART).cast("int").alias("part"))
    rows = parts.agg(F.bitmap_construct_agg(F.col("bit") % _MAP_PART).alias("map")).collect()  # at most MOST_BITS / 32,768 rows of 4 KB
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.part * _MAP_PART // 8 : (r.part + 1) * _MAP_PART // 8] = np.frombuffer(r.map, np.uint8)
    return out, 65 - bits.bit_length()


def _slices(raw: bytes, s: np.ndarray, e: np.ndarray) -> Iterator[pa.Array]:
    """raw[s:e] for all s and e as text, some BATCH_BYTES at a time."""
    a = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(e - s)
    first = 0
    while first < len(s):
        base = int(ends[first - 1]) if first else 0
        last = min(first + BATCH, max(first + 1, int(np.searchsorted(ends, base + BATCH_BYTES, "right"))))
        offsets = np.concatenate([[0], ends[first:last] - base])
        at = np.repeat(s[first:last] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
        yield pa.StringArray.from_buffers(last - first, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(a[at]))
        first = last


def _explode_phrases(table: np.ndarray, shift: int, most: int):
    """(text, lang) -> (lang, words, phrase, c): a row for each phrase whose short parts are in the map, and the number of all words as phrase of none."""

    def passes(h: np.ndarray) -> np.ndarray:
        bit = (h >> np.uint64(shift)).astype(np.int64)
        return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def rows(lang: str, words: int, phrases: pa.Array, c: int) -> pa.RecordBatch:
        n = len(phrases)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(words, pa.int32()), n), phrases, pa.repeat(pa.scalar(c, pa.int64()), n)], ["lang", "words", "phrase", "c"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, texts in _by_lang(b).items():
                for raw, s, e, h, piece in _words(texts):
                    yield rows(lang, 0, pa.array([""]), len(h))
                    for k in range(1, most + 1):
                        if k <= FIRST:
                            g, inside = _grams(h, piece, k, lang)
                            short = passes(g) & inside
                            ok = short if k == 1 else short & ok[:-1] & ok[1:]
                        else:  # all shorter phrases inside are
                            ok = ok[:-1] & ok[1:]
                        at = np.flatnonzero(ok)
                        if not len(at):
                            break
                        for phrases in _slices(raw, s[at], e[at + k - 1]):
                            yield rows(lang, k, phrases, 1)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, words, phrase, f): every phrase of 1 to ``most`` words with f >= least, and a row of 0 words with the number of all words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    table, shift = _frequent(rows, least)
    exploded = rows.mapInArrow(_explode_phrases(table, shift, most), "lang string, words int, phrase string, c bigint")
    return exploded.groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of the phrases of two words and more: the lowest score of all cuts, ties to the first cut. Decimal arithmetic of 38 digits, floored."""
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    if totals.count() <= MOST_LANGS:
        totals = F.broadcast(totals)
    w = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(1, k).alias("left"), part(k + 1, F.col("words") - k).alias("right")))).alias("x")
    cuts = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), cut).select("lang", "words", "phrase", "a", "x.*")
    known = counts.where("words > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = "cast(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div cast(cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)) as decimal(38, 0))"
    cuts = cuts.withColumn("score", F.expr(exact))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return cuts.groupBy("lang", "words", "phrase", "a", "n").agg(lowest).select("lang", "words", "phrase", "a", "m.l", "m.r", "n", "m.score")


def unabsorbed(phrases: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Phrases that no longer phrase accounts for. Counts fall from a phrase to any that holds it, so one-word extensions suffice: whatever a longer one absorbs, the extension between them does too."""
    w = F.split("phrase", " ")
    ends = F.explode(F.array(F.slice(w, 1, F.col("words") - 1), F.slice(w, F.lit(2), F.col("words") - 1))).alias("w")
    longer = phrases.where("words > 2").select("lang", ends, "a").select("lang", F.array_join("w", " ").alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg((100 * F.max("a")).alias("__longer"))
    here = phrases.alias("p")
    return here.join(longer.alias("q"), (F.col("p.lang") == F.col("q.lang")) & (F.col("p.phrase") == F.col("q.phrase")) & (F.col("__longer") >= absorbed * F.col("p.a")), "left_anti")


def ranked(phrases: DataFrame, most: int = PER_LANG) -> DataFrame:
    """Each language's first ``most`` phrases by score and count descending, then by the phrase's bytes; ``rank`` from 1.

    A first ranking within parts of a language leaves the last one a bounded number of rows."""
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = phrases.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int"))
    first = part.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__rank") <= most).drop("__part", "__rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST_COUNT, absorbed: int = ABSORBED, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases.

    Null texts have no words; null languages are ``und`` and join that language's rows. Empty texts and tables give no
    rows; repeated rows count again; other columns of ``docs`` are not read. Words may be of any length."""
    spark = docs.sparkSession
    since = len(CREATED)
    counts = save(phrase_counts(docs, text_col, lang_col, most, least), scratch(spark, "collocations-counts"))
    phrases = save(scored(counts), scratch(spark, "collocations-scores"))
    out = ranked(unabsorbed(phrases, absorbed), per_lang)
    return finish(out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "op11", since)
