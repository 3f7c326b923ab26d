"""Distribution analysis of one or two treebanks: counts, rates, divergences, correlations.

Arcs are DataFrames with sid, tid, head, deprel, upos, head_upos. Both sides are tagged
and aggregated together, so each report is one shuffle of keys and counts; no join of
arcs and no rescan per label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.functions import expr

DIMENSIONS = ("deprel", "base_deprel", "direction", "distance_bucket", "upos", "head_upos", "attachment_signature")


def describe(arcs: DataFrame) -> DataFrame:
    """Adds base, dist, direction and bucket."""
    t, h = F.col("tid"), F.col("head")
    return arcs.select("*", expr.base_relation(F.col("deprel")).alias("base"), expr.distance(t, h).alias("dist"), expr.direction(t, h).alias("direction"), expr.distance_bucket(t, h).alias("bucket"))


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return describe(a).withColumn("side", F.lit("a")).unionByName(describe(b).withColumn("side", F.lit("b")))


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def with_totals(counts: DataFrame) -> DataFrame:
    """Adds words and sentences of each side to grouped counts (count_s, firsts_s): sums over the report's own rows, so arcs are read once.

    A sentence is counted by its word 1. The totals are one row, joined to the rows of the report; the exchange below is shared."""
    totals = counts.agg(*[x for s in "ab" for x in (F.sum(f"count_{s}").alias(f"words_{s}"), F.sum(f"firsts_{s}").alias(f"sents_{s}"))])
    return counts.crossJoin(F.broadcast(totals))


def relation_distribution(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per strict label and side: count, per 1000 words, per sentence, head-left % of non-root arcs, 6+ %, mean non-root distance; and differences. Undefined ratios are null."""
    arcs = both_sides(a, b)
    aggs = []
    for s in "ab":
        mine = F.col("side") == s
        arc = mine & (F.col("head") != 0)
        aggs += [
            _n(mine).alias(f"count_{s}"),
            _n(mine & (F.col("tid") == 1)).alias(f"firsts_{s}"),
            _n(arc).alias(f"arcs_{s}"),
            _n(mine & (F.col("direction") == "head_left")).alias(f"left_{s}"),
            _n(mine & (F.col("dist") >= 6)).alias(f"long_{s}"),
            F.sum(F.when(arc, F.col("dist"))).alias(f"dist_{s}"),
        ]
    rows = with_totals(arcs.groupBy("deprel").agg(*aggs))
    out = ["deprel"]
    for s in "ab":
        out += [
            F.col(f"count_{s}"),
            F.round(expr.rate(F.col(f"count_{s}"), F.col(f"words_{s}")), 6).alias(f"per_1000_{s}"),
            F.round(expr.rate(F.col(f"count_{s}"), F.col(f"sents_{s}"), 1.0), 6).alias(f"per_sentence_{s}"),
            F.round(expr.percent(F.col(f"left_{s}"), F.col(f"arcs_{s}")), 6).alias(f"head_left_pct_{s}"),
            F.round(expr.percent(F.col(f"long_{s}"), F.col(f"count_{s}")), 6).alias(f"long_pct_{s}"),
            F.round(F.try_divide(F.col(f"dist_{s}"), F.col(f"arcs_{s}")), 6).alias(f"mean_distance_{s}"),
        ]
    rate = lambda s: expr.rate(F.col(f"count_{s}"), F.col(f"sents_{s}"), 1.0)
    return rows.select(*out, F.round(rate("a") - rate("b"), 6).alias("per_sentence_difference"))


def signature_shifts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts and rates of (upos, head tag, label, direction, bucket) on both sides, with the absolute difference of the rates per 1000."""
    arcs = both_sides(a, b)
    key = ["upos", "head_upos", "deprel", "direction", "bucket"]
    first = F.col("tid") == 1
    rows = with_totals(arcs.groupBy(*key).agg(*[x for s in "ab" for x in (_n(F.col("side") == s).alias(f"count_{s}"), _n((F.col("side") == s) & first).alias(f"firsts_{s}"))]))
    ra, rb = expr.rate(F.col("count_a"), F.col("words_a")), expr.rate(F.col("count_b"), F.col("words_b"))
    return rows.select(*key, "count_a", "count_b", F.round(ra, 6).alias("per_1000_a"), F.round(rb, 6).alias("per_1000_b"), F.round(F.abs(ra - rb), 6).alias("shift"))


def divergence(counts: DataFrame, by: list[str], a: str = "n_a", b: str = "n_b") -> DataFrame:
    """Jensen-Shannon divergence in bits and total variation of two count columns within each group; an empty side counts as no mass."""
    t = counts.groupBy(*by).agg(F.sum(a).alias("__ta"), F.sum(b).alias("__tb"))
    rows = counts.join(t, by) if by else counts.crossJoin(F.broadcast(t))
    p, q = F.coalesce(F.try_divide(F.col(a).cast("double"), F.col("__ta")), F.lit(0.0)), F.coalesce(F.try_divide(F.col(b).cast("double"), F.col("__tb")), F.lit(0.0))
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return rows.groupBy(*by).agg(F.round(F.sum(term(p) + term(q)), 6).alias("js_bits"), F.round(F.sum(F.abs(p - q)) / 2, 6).alias("total_variation"))


def divergence_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """js_bits and total_variation for seven dimensions: arcs unpivoted once, one aggregation by (dimension, key)."""
    arcs = both_sides(a, b)
    sig = F.concat_ws("|", "upos", "head_upos", "deprel", "direction", "bucket")
    values = [F.col("deprel"), F.col("base"), F.col("direction"), F.col("bucket"), F.col("upos"), F.col("head_upos"), sig]
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("key")) for d, v in zip(DIMENSIONS, values, strict=True)])).alias("x")
    counts = arcs.select("side", pairs).groupBy("x.dimension", "x.key").agg(_n(F.col("side") == "a").alias("n_a"), _n(F.col("side") == "b").alias("n_b"))
    return divergence(counts, ["dimension"])


def sentence_shifts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sentence present on both sides: word counts, mean non-root distance, long % of non-root arcs (0 without arcs), JS of base labels."""
    arcs = both_sides(a, b)
    counts = arcs.groupBy("sid", "base").agg(*[x for s in "ab" for x in (_n(F.col("side") == s).alias(f"n_{s}"), _n((F.col("side") == s) & (F.col("head") != 0)).alias(f"arcs_{s}"), F.sum(F.when(F.col("side") == s, F.col("dist")).otherwise(0)).alias(f"dist_{s}"), _n((F.col("side") == s) & (F.col("dist") >= 6)).alias(f"long_{s}"))])
    js = divergence(counts, ["sid"]).select("sid", "js_bits")
    per = counts.groupBy("sid").agg(*[F.sum(c).alias(c) for s in "ab" for c in (f"n_{s}", f"arcs_{s}", f"dist_{s}", f"long_{s}")]).where("n_a > 0 and n_b > 0")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return per.join(js, "sid").select(
        "sid", F.col("n_a").alias("words_a"), F.col("n_b").alias("words_b"),
        *[F.round(zero(F.try_divide(F.col(f"dist_{s}"), F.col(f"arcs_{s}"))), 6).alias(f"mean_distance_{s}") for s in "ab"],
        *[F.round(zero(expr.percent(F.col(f"long_{s}"), F.col(f"arcs_{s}"))), 6).alias(f"long_pct_{s}") for s in "ab"],
        "js_bits",
    )


def corpus_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per side: sentences, words, mean words, mean non-root distance, long % of all words, head-left % of non-root arcs."""
    per = both_sides(a, b).groupBy("side", "sid").agg(F.count("*").alias("n"), _n(F.col("head") != 0).alias("arcs"), F.sum("dist").alias("dist"), _n(F.col("dist") >= 6).alias("long"), _n(F.col("direction") == "head_left").alias("left"))
    return per.groupBy("side").agg(
        F.count("*").alias("sentences"), F.sum("n").alias("words"), F.round(F.avg("n"), 6).alias("mean_words"), F.round(F.try_divide(F.sum("dist"), F.sum("arcs")), 6).alias("mean_distance"),
        F.round(F.try_divide(100.0 * F.sum("long"), F.sum("n")), 6).alias("long_pct"), F.round(F.try_divide(100.0 * F.sum("left"), F.sum("arcs")), 6).alias("head_left_pct"),
    )


def length_stats(lengths: DataFrame, column: str = "n") -> DataFrame:
    """One row: min, max, mean, median and linearly interpolated percentiles; nulls for no rows."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    row = lengths.agg(F.count(column).alias("n"), F.min(column).cast("bigint").alias("min"), F.max(column).cast("bigint").alias("max"), F.round(F.avg(column), 6).alias("mean"), q.alias("q"))
    return row.select("n", "min", "max", "mean", F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[0], 6).alias("p25"), F.round(F.col("q")[2], 6).alias("p75"), F.round(F.col("q")[3], 6).alias("p95"))


#: Parts into which a pass of percentiles() cuts each range that it is still looking at.
BINS = 1024


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation, nulls left out; null for no rows.

    Distributed selection: each pass counts the values in the parts of the ranges that hold the wanted ranks, and goes on with one
    part of each, until it holds a single value. Rows are never sorted or exchanged; the driver sees BINS rows a rank at most."""
    rows = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    found: dict[int, float] = {}
    open_: dict[int, tuple[float, float, int]] = {k: (low, high, 0) for x in places for k in (math.floor(x), math.ceil(x))}  # range, values below it
    while open_:
        for k in [k for k, (a, b, _) in open_.items() if a == b]:
            found[k] = open_.pop(k)[0]
        asked = sorted({(a, b) for a, b, _ in open_.values()})
        if not asked:
            break
        v = F.col("v")
        part = lambda a, b: F.least(F.floor((v / 2 - F.lit(a) / 2) / (F.lit(b) / 2 - F.lit(a) / 2) * BINS).cast("int"), F.lit(BINS - 1))
        places_of = F.explode(F.array_compact(F.array(*[F.when(v.between(a, b), F.struct(F.lit(i).alias("r"), part(a, b).alias("p"))) for i, (a, b) in enumerate(asked)]))).alias("x")
        counted = rows.select("v", places_of).groupBy("x.r", "x.p").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("r", "p").collect()
        for k, (a, b, below) in list(open_.items()):
            for c in counted:
                if asked[c.r] == (a, b):
                    if below + c.n > k:
                        open_[k] = (c.a, c.b, below)
                        break
                    below += c.n
    lower = [found[math.floor(x)] for x in places]
    return [a + (found[math.ceil(x)] - a) * (x - math.floor(x)) for a, x in zip(lower, places, strict=True)]


def pearson(x: str, y: str) -> Column:
    """Null with fewer than two points or without variance."""
    return F.when((F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def parallel_correlation(shifts: DataFrame) -> DataFrame:
    """Correlations over sentence pairs of word counts, distances and long shares."""
    return shifts.agg(F.count("*").alias("pairs"), *[F.round(pearson(f"{c}_a", f"{c}_b"), 6).alias(f"r_{c}") for c in ("words", "mean_distance", "long_pct")])
