"""Toxicity by maximum-scoring segments.

Tokens get log-odds between toxic and clean labelled documents under an informative
Dirichlet prior (the background shares of tokens); a token counts once for each distinct
context, so copies of a document add nothing. Beside whole words, word beginnings of
four to eight letters are tokens, for inflected and compound words. The lexicon holds the
tokens whose z-score passes a fixed limit, and the log-odds of words that lean to clean
text; a word scores its best toxic token, else its own negative log-odds, and a word of
neither kind costs a little. A linear scan finds all maximal scoring segments of the
whole text. By extreme-value theory the best one of n background words exceeds S with
probability 1 - exp(-K n exp(-lambda S)): lambda is the rate at which the background's
odds balance (sum of p exp(lambda s) = 1), and K is fitted by maximum likelihood to the
best segments of clean documents (censored where a document has none). So scores become
chances, and the best one of a document is calibrated to a probability on rows kept out
of the lexicon.

Defined cases: null and empty texts have no segment and get the score of such texts;
null ids are kept (held_out null); repeated labels of an id count once, the greatest;
without labels of both classes every score is their share, or 0.5. Other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm import calibration
from dendra.llm.common import crc_remainder, lean, remove, save, scratch, small_batches
from dendra.llm.quality import SEED

FOLDS, HELD = 4, 2
#: Labelled rows of each class that a fit may use; the only bound on training data.
MAX_TOXIC, MAX_CLEAN = 3_000, 5_000
PRIOR = 0.2  # weight of the prior, as a share of all counts
Z_LIMIT = 3.5  # one-sided: about one token in 4,300 by chance
Z_CLEAN = 1.0  # words that lean to clean text keep their negative log-odds
STEMS = range(4, 9)
MEMO = 500_000
GAP = 0.05  # what a word outside the lexicon costs
MAX_ODDS = 8.0
SIGNIFICANT = 0.05  # expected count of a segment by chance, below which it is reported
THRESHOLD = 0.3

_TOKEN = re.compile("[a-z0-9'\x80-\U0010ffff]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def stems(word: str) -> list[str]:
    """What a word counts as: itself, and its beginnings (marked by a hyphen, which no word has)."""
    return [word, *[f"{word[:n]}-" for n in STEMS if n <= len(word)]]


class Odds(dict):
    """word -> its score by the lexicon; a bounded memo."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __reduce__(self):
        return Odds, (self.lexicon,)

    def __missing__(self, word: str) -> float:
        found = [self.lexicon[s] for s in stems(word) if s in self.lexicon]
        best = max(found, default=0.0)
        value = best if best > 0 else min(self.lexicon.get(word, -GAP), -GAP)
        if len(self) >= MEMO:
            self.clear()
        self[word] = value
        return value


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time: segments are kept with the totals before
    and after them; a new one joins back to the last that begins lower, if it also ends lower. Each keeps the place of the last
    before it that begins lower, so a search jumps over what earlier searches have passed."""
    totals = list(accumulate(scores, initial=0.0))
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, the last that begins lower or -1
    for i, s in enumerate(scores):
        if s <= 0:
            continue
        first, low, high = i, totals[i], totals[i + 1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0:
                done += [(a, b, r - l) for a, b, l, r, _ in stack]
                stack = [(first, i, low, high, -1)]
                break
            if stack[j][3] >= high:
                stack.append((first, i, low, high, j))
                break
            first, _, low, _, back = stack[j]
            del stack[j:]
            j = back
    return done + [(a, b, r - l) for a, b, l, r, _ in stack]


def balance(shares: list[tuple[float, float]]) -> float:
    """The positive lambda with sum of share * exp(lambda * score) + rest * exp(-lambda * GAP) = 1."""
    rest, low, high = max(0.0, 1 - sum(p for p, _ in shares)), 1e-6, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        over = sum(p * math.exp(min(mid * s, 600)) for p, s in shares) + rest * math.exp(-mid * GAP) > 1
        low, high = (low, mid) if over else (mid, high)
    return low


def fit_k(best: np.ndarray, n: np.ndarray, rate: float, least: float) -> float:
    """K by maximum likelihood from the best scores of documents of n words; 0, no segment, is known only to be below ``least``. One observation is added to both counts."""
    return float((best > 0).sum() + 1) / float((n * np.exp(-rate * np.where(best > 0, best, least))).sum() + 1)


@dataclass
class Model:
    odds: Odds
    rate: float  # lambda
    k: float
    knots: tuple[np.ndarray, np.ndarray]

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Segments as (first token, last token, expected count by chance), and the number of tokens."""
        found = tokens(text)
        scores = [self.odds[w] for w in found]
        if max(scores, default=0.0) <= 0:
            return [], len(found)
        return [(a, b, self.k * len(found) * math.exp(-self.rate * s)) for a, b, s in maximal_segments(scores)], len(found)

    def best(self, text: str | None) -> tuple[float, int]:
        """The best segment's score (0: none), and the number of words."""
        scores = [self.odds[w] for w in tokens(text)]
        if max(scores, default=0.0) <= 0:
            return 0.0, len(scores)
        return max(s for *_, s in maximal_segments(scores)), len(scores)

    def evidence(self, text: str | None) -> float:
        return evidence(min((e for *_, e in self.passages(text)[0]), default=math.inf))


def evidence(expected: float) -> float:
    """-ln of the chance that the background alone holds so good a segment; 0 without any."""
    p = -math.expm1(-expected)
    return -math.log(p) if 0 < p < 1 else (0.0 if p >= 1 else 700.0)


def sample(labels: DataFrame, label: str, usable, id_col: str = "doc_id") -> DataFrame:
    """At most MAX_TOXIC and MAX_CLEAN labelled ids, by the hash of the id: (id, y, fold)."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64(F.col(id_col), F.lit(SEED)), F.col(id_col)]
    rows = rows.where("y > 0").orderBy(*order).limit(MAX_TOXIC).union(rows.where("y <= 0").orderBy(*order).limit(MAX_CLEAN))
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED + 1)), F.lit(4)).cast("int"))


def contexts(rows: DataFrame) -> DataFrame:
    """(text, y) -> (token, context, y): of each document, each token's first context."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, c, ys = [], [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = ["", *tokens(text), ""]
                seen: set[str] = set()
                for i in range(1, len(found) - 1):
                    if found[i] in seen:
                        continue
                    context = None
                    for s in stems(found[i]):
                        if s not in seen:
                            seen.add(s)
                            context = context or zlib.crc32(" ".join(found[i - 1 : i + 2]).encode())
                            t.append(s)
                            c.append(context)
                            ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(c, pa.int64()), pa.array(ys, pa.int32())], ["token", "context", "y"])

    return rows.mapInArrow(run, "token string, context bigint, y int")


def counts(rows: DataFrame) -> DataFrame:
    """(text, y) -> (token, a, b): distinct contexts in toxic and in clean documents."""
    return contexts(rows).groupBy("token").agg(F.count_distinct(F.when(F.col("y") > 0, F.col("context"))).alias("a"), F.count_distinct(F.when(F.col("y") <= 0, F.col("context"))).alias("b"))


def fit(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """chosen: (id, y, fold), bounded by sample(), so the broadcast and the collected counts are bounded too."""
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch(spark, "toxicity")
    rows = save(docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "y", "fold"), path)
    sizes = {r.y > 0: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = float(next(iter(sizes))) if sizes else 0.5
        remove(spark, path)
        return Model(Odds({}), 1.0, 1.0, (np.array([0.0]), np.array([share])))
    counted = scratch(spark, "toxicity-counts")
    by = save(counts(rows.where("fold <> 0").select("text", "y")), counted)
    total = by.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    na, nb = float(total.a or 0), float(total.b or 0)
    prior = F.lit(PRIOR) * (F.col("a") + F.col("b"))
    a, b = F.col("a") + prior, F.col("b") + prior
    weight = PRIOR * (na + nb)
    odds = F.log(a / (F.lit(na + weight) - a)) - F.log(b / (F.lit(nb + weight) - b))
    lexicon = by.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b)).where((F.col("z") >= Z_LIMIT) | ((F.col("z") <= -Z_CLEAN) & ~F.endswith("token", F.lit("-")))).select("token", "odds", "b").collect()
    remove(spark, counted)
    table = {r.token: max(-MAX_ODDS, min(r.odds, MAX_ODDS)) for r in lexicon}
    model = Model(Odds(table), 1.0, 1.0, (np.array([0.0]), np.array([0.5])))
    least = min((s for s in table.values() if s > 0), default=1.0)
    clean = _best(rows.where("fold <> 0 and y <= 0"), model)
    best, n = np.array([x[0] for x in clean]), np.array([float(x[2]) for x in clean])
    # the background: how often the tokens turn up in clean text
    model.rate = balance([((r.b + 0.5) / (nb + 0.5 * len(lexicon) + 1), table[r.token]) for r in lexicon])
    model.k = fit_k(best, n, model.rate, least)
    pairs = _best(rows.where("fold = 0"), model) or _best(rows, model)
    chance = [evidence(model.k * n * math.exp(-model.rate * s) if s > 0 else math.inf) for s, _, n in pairs]
    # both classes were sampled; the knots speak of the sample's shares
    model.knots = calibration.isotonic(np.array(chance), np.array([y for _, y, _ in pairs]))
    remove(spark, path)
    return model


def _best(rows: DataFrame, model: Model) -> list[tuple[float, int, int]]:
    """(best score, label, words) of the rows of a bounded sample."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.best(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.float64()), b.column(1), pa.array([n for _, n in found], pa.int64())], ["s", "y", "n"])

    return [(r.s, r.y, r.n) for r in rows.select("text", "y").mapInArrow(run, "s double, y int, n bigint").collect()]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): passages are the significant segments, as first and last token and expected count by chance."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("by_chance", pa.float64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chances, found = [], []
            for t in b.column(0).to_pylist():
                segments, _ = model.passages(t)
                chances.append(evidence(min((x for _, _, x in segments), default=math.inf)))
                found.append([dict(first=x, last=y, by_chance=z) for x, y, z in segments if z <= SIGNIFICANT])
            s = np.clip(calibration.apply(np.array(chances), model.knots), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64()), pa.array(found, pa.list_(passage))], [id_col, "score", "passages"])

    return docs.select(F.col(text_col).alias("__text"), id_col).mapInArrow(run, f"`{id_col}` {kind}, score double, passages array<struct<first:bigint,last:bigint,by_chance:double>>")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every document; rows whose crc32(doc_id) mod folds is ``held`` never train."""
    model = fit(docs, sample(labels, label, crc_remainder("doc_id", folds) != held))
    return score(docs, model).select("doc_id", (crc_remainder("doc_id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "passages")
