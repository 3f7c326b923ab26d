"""Corpus BLEU and chrF from clipped n-gram counts.

N-grams are counted and clipped per segment and summed; the closed forms run on one
row of sums. Definitions follow the published metrics: BLEU with exponential smoothing
and brevity penalty, chrF with characters without spaces, orders 1..6, beta 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode ranges whose characters stand alone in Chinese tokenization.
CHINESE = "\\u2E80-\\u2FDF\\u2FF0-\\u303F\\u3100-\\u312F\\u31A0-\\u31EF\\u3200-\\u4DB5\\u4E00-\\u9FBB\\uF900-\\uFAD9\\uFE10-\\uFE1F\\uFE30-\\uFE4F\\uFF00-\\uFFEF"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def chinese_words(text: Column) -> Column:
    """Chinese characters and punctuation apart, the rest by the usual punctuation rules."""
    t = F.regexp_replace(F.trim(text), f"([{CHINESE}])", " $1 ")
    t = F.regexp_replace(t, r"([{-~\[-` -&(-+:-@/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return words(t)


def characters(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"\s+", ""), ""), "")


def ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    upto = F.size(tokens) - n
    return F.when(upto >= 0, F.transform(F.sequence(F.lit(0), upto), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), separator))).otherwise(F.array().cast("array<string>"))


#: Tokens of segments that are counted at a time.
TOKENS_AT_ONCE = 1_000_000


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column as numbers, and how many each row has. A string's tokens are its code points; null has none."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        text = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in column.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *text]).astype(np.int64), np.array([len(t) for t in text], np.int64)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths


def clipped_counts(tokens: np.ndarray, lengths: np.ndarray, orders: int) -> np.ndarray:
    """(matches, hyp total, ref total) by order, from the tokens of all hypotheses, then of all references, with their lengths.

    An n-gram's number is that of its first n - 1 tokens with the last one, so numbers are exact and belong to one segment."""
    segments = len(lengths) // 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    places, base = np.arange(len(tokens)), int(tokens.max(initial=0)) + 1
    gram = row % max(1, segments)
    out = np.zeros((orders, 3), np.int64)
    for n in range(orders):
        on = places + n < ends[places]
        places, gram = places[on], gram[on]
        if not len(places):
            break
        _, gram = np.unique(gram * base + tokens[places + n], return_inverse=True)
        hyp = row[places] < segments
        h, r = np.bincount(gram[hyp], minlength=gram.max() + 1), np.bincount(gram[~hyp], minlength=gram.max() + 1)
        out[n] = np.minimum(h, r).sum(), h.sum(), r.sum()
    return out


def _counts(orders: int):
    """(hyp, ref) -> (n, matches, hyp_total, ref_total): sums over the segments of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((orders, 3), np.int64)
        for b in batches:
            both, lengths = _tokens(pa.concat_arrays([b.column(0), b.column(1)]))  # one numbering for both
            nh, nr = lengths[: b.num_rows], lengths[b.num_rows :]
            hyp, ref = both[: nh.sum()], both[nh.sum() :]
            eh, er = np.cumsum(nh), np.cumsum(nr)
            cuts = [0, *(np.flatnonzero(np.diff((eh + er) // TOKENS_AT_ONCE)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    part = np.concatenate([hyp[eh[i] - nh[i] : eh[j - 1]], ref[er[i] - nr[i] : er[j - 1]]])
                    total += clipped_counts(part, np.concatenate([nh[i:j], nr[i:j]]), orders)
        some = np.flatnonzero(total[:, 1:].sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some + 1, pa.int32()), *[pa.array(total[some, k]) for k in range(3)]], ["n", "matches", "hyp_total", "ref_total"])

    return run


def ngram_counts(pairs: DataFrame, id_col: str, hyp: str, ref: str, orders: int) -> DataFrame:
    """Per order: matches (clipped per segment), totals of both sides. hyp and ref are arrays of tokens, or strings, whose characters
    count; a row is a segment. N-grams are counted where their segment lies, so only sums are exchanged, a row per task and order."""
    sums = pairs.select(hyp, ref).mapInArrow(_counts(orders), "n int, matches bigint, hyp_total bigint, ref_total bigint")
    return sums.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matches", "hyp_total", "ref_total")])


def corpus_bleu(counts: list, hyp_length: int, ref_length: int, orders: int = 4) -> float:
    """Percent, from rows of ngram_counts on the driver (one per order)."""
    by = {r["n"]: r for r in counts}
    if not any(r["matches"] for r in counts):
        return 0.0  # smoothing speaks only of orders beside a match
    logs, smooth = 0.0, 1.0
    for n in range(1, orders + 1):
        r = by.get(n)
        total, right = (r["hyp_total"], r["matches"]) if r else (0, 0)
        if not total:
            return 0.0
        if not right:
            smooth *= 2
            logs += math.log(100.0 / (smooth * total))
        else:
            logs += math.log(100.0 * right / total)
    penalty = 1.0 if hyp_length > ref_length else math.exp(1 - ref_length / hyp_length) if hyp_length else 0.0
    return penalty * math.exp(logs / orders)


def corpus_chrf(counts: list, beta: float = 2.0) -> float:
    """Percent: mean precision and recall over the orders that both sides have, then F-beta."""
    p = r = 0.0
    used = 0
    for c in counts:
        if c["hyp_total"] and c["ref_total"]:
            p += c["matches"] / c["hyp_total"]
            r += c["matches"] / c["ref_total"]
            used += 1
    if not used or p + r == 0:
        return 0.0
    p, r = p / used, r / used
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0
