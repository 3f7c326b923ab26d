"""Quality classifier: random Fourier features, partition-summed ridge, isotonic calibration.

A document becomes some twenty statistics of its whole text (no label, language, source
or id among them). Their z-scores pass through cosines of random projections, which
approximate a Gaussian kernel; the normal equations of a ridge regression are summed
over partitions, solved on the driver (a matrix of fixed size), and the fitted values
are calibrated by isotonic regression on rows kept out of the regression.

Defined cases: null and empty texts are documents of length 0 and get a score; null ids
are kept (they are never labelled, and held_out is null); repeated labels of an id count
once, the greatest; with no labels every score is 0.5, with one class only it is that
class's share. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.llm import calibration
from dendra.llm.common import crc_remainder, lean, remove, save, scratch, small_batches

FOLDS = 5
#: Labelled rows that a fit may use; the only bound on training data.
MAX_TRAIN = 20_000
FEATURES = 256
RIDGE = 1e-3
SEED = 20240
THRESHOLD = 0.3

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:!?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Scale-free numbers of a whole text; words are runs of non-space bytes."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n, k = len(raw), len(words)
    if k == 0:
        return [0.0] * N_STATS
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = by[by > 0] / n
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = int(by[65:91].sum() + by[97:123].sum()) or 1
    pairs = max(k - 1, 1)
    return [
        math.log1p(n),
        math.log1p(k),
        math.log1p(len(lines)),
        math.log1p(k / len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        float((lengths > 20).mean()),
        int(by[65:91].sum()) / letters,
        int(by[48:58].sum()) / n,
        int(by[_SYMBOLS].sum()) / n,
        int(by[_STOPS].sum()) / n,
        int(by[33]) / n,
        int(by[124]) / n,
        int(by[128:].sum()) / n,
        int(by[:32].sum() - by[9] - by[10] - by[13]) / n,
        float(-(p * np.log(p)).sum()),
        len(counts) / k,
        math.log(len(counts)) / math.log(k + 1),
        max(counts.values()) / k,
        sum(map(eq, words, words[1:])) / pairs,
        len(set(zip(words, words[1:], strict=False))) / pairs if k > 1 else 1.0,
        1 - len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / k,
    ]


N_STATS = 24


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(calibration.apply(self.raw(x), self.knots), 0, 1)


def sample(labels: DataFrame, label: str, usable, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids, by the hash of the id: (id, y)."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable).groupBy(id_col).agg(F.max(label).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(SEED)), id_col).limit(bound)


def _partial(df: DataFrame, schema: str, f) -> list:
    """f: (statistics matrix, labels) -> row, once per partition; the rows come to the driver (bounded partitions of a bounded sample)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for b in batches:
            x += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        if x:
            row = f(np.array(x, float), np.array(y, float))
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    return df.mapInArrow(run, schema).collect()


def fit(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """chosen: (id, y), bounded by sample()."""
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch(spark, "quality")

    @lean
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1), b.column(2)], ["x", "y", "fold"])

    # the sample is bounded (MAX_TRAIN ids and labels), so this broadcast is
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col).select(text_col, "y", F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED + 1)), F.lit(4)).cast("int").alias("fold"))
    rows = save(rows.mapInArrow(stats, "x array<double>, y double, fold int"), path).coalesce(8)
    fitted, kept = rows.where("fold <> 0").select("x", "y"), rows.where("fold = 0").select("x", "y")
    moments = _partial(fitted, "n double, s array<double>, q array<double>, y double", lambda x, y: {"n": float(len(y)), "s": x.sum(0).tolist(), "q": (x * x).sum(0).tolist(), "y": float(y.sum())})
    rng = np.random.default_rng(SEED)
    directions, phases = rng.standard_normal((N_STATS, FEATURES)) / math.sqrt(N_STATS), rng.uniform(0, 2 * math.pi, FEATURES)
    n, ones = sum(r.n for r in moments), sum(r.y for r in moments)
    if not 0 < ones < n:
        remove(spark, path)
        share = ones / n if n else 0.5
        return Model(np.zeros(N_STATS), np.ones(N_STATS), directions, phases, np.zeros(FEATURES + 1), (np.array([0.0]), np.array([share])))
    mean = sum(np.array(r.s) for r in moments) / n
    var = sum(np.array(r.q) for r in moments) / n - mean**2
    model = Model(mean, np.sqrt(np.maximum(var, 1e-12)) + 1e-9, directions, phases, np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])))
    weight = n / (2 * (n - ones)), n / (2 * ones)  # both classes weigh the same

    def normal(x: np.ndarray, y: np.ndarray) -> dict:
        z, w = model.features(x), np.where(y > 0, weight[1], weight[0])
        return {"a": ((z * w[:, None]).T @ z).ravel().tolist(), "b": ((z * w[:, None]).T @ y).tolist()}

    parts = _partial(fitted, "a array<double>, b array<double>", normal)
    a = sum(np.array(r.a) for r in parts).reshape(FEATURES + 1, -1)
    model.weights = np.linalg.solve(a + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, sum(np.array(r.b) for r in parts))
    scored = kept.union(fitted) if kept.isEmpty() else kept
    pairs = _partial(scored, "s array<double>, y array<double>", lambda x, y: {"s": model.raw(x).tolist(), "y": y.tolist()})
    s, y = np.concatenate([r.s for r in pairs]), np.concatenate([r.y for r in pairs])
    model.knots = calibration.isotonic(s, y)
    remove(spark, path)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, [kept columns], score) for every row; scores are in 0..1, higher: label 1 likelier."""
    small_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    sent = [text_col, *[c for c in keep if c != text_col]]  # a text goes to Python once
    at = [sent.index(c) for c in keep]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(0).to_pylist()], float).reshape(b.num_rows, N_STATS)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in at], pa.array(model.score(x), pa.float64())], [*keep, "score"])

    return docs.select(*sent).mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = 0, bound: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows whose crc32(doc_id) mod folds is ``held`` never train."""
    model = fit(docs, sample(labels, label, crc_remainder("doc_id", folds) != held, bound))
    return score(docs, model).select("doc_id", (crc_remainder("doc_id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
