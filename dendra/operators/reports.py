"""Orders and selections of reports: what a reader sees first, always with a total order.

``ranked`` sorts by the report's own keys and then by enough others that no two rows tie,
and numbers the leading rows; the sort is a top-k per partition, never a full sort.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendra.functions import expr
from dendra.operators import scoring


def ranked(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows with rank from 1. The window spans those rows alone."""
    return rows.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def relation_order() -> list[Column]:
    """Greatest difference per sentence first, then the label."""
    return [F.abs("per_sentence_difference").desc_nulls_last(), F.col("deprel")]


def signature_order() -> list[Column]:
    """Greatest rate difference first, then the parts of the signature."""
    return [F.col("shift").desc_nulls_last(), *[F.col(c) for c in ("upos", "head_upos", "deprel", "direction", "bucket")]]


def pair_order(pair: str) -> list[Column]:
    """Greatest divergence first, then the greatest difference of word counts, then the pair's id as text."""
    return [F.col("js_bits").desc_nulls_last(), F.abs(F.col("words_a") - F.col("words_b")).desc(), F.col(pair).cast("string")]


def numeric_order(parallel_id: str) -> list[Column]:
    """By the number after the last slash; ids without one come last, by text."""
    return [expr.pair_number(F.col(parallel_id)).asc_nulls_last(), F.col(parallel_id)]


def confusion_order() -> list[Column]:
    return [F.col("n").desc(), F.col("gold_deprel"), F.col("pred_deprel")]


def near_pair_order() -> list[Column]:
    return [F.col("similarity").desc(), F.col("a"), F.col("b")]


def worst_relation_order(label: str = "deprel") -> list[Column]:
    """Lowest LAS first, then the most words, then the label."""
    return [F.col("las"), F.col("words").desc(), F.col(label)]


def support_order(label: str = "deprel") -> list[Column]:
    return [F.col("words").desc(), F.col(label)]


def bucket_order(bucket: str = "bucket") -> list[Column]:
    return [expr.bucket_rank(F.col(bucket)), F.col(bucket)]


def overall_by_tag(rows: DataFrame, tag: str = "upos", pred_tag: str = "pred_upos") -> DataFrame:
    """Words, tag accuracy, and UAS and LAS over all words and over those whose tag was predicted right or wrong; null where there are none. One aggregation."""
    right = F.col(tag).eqNullSafe(F.col(pred_tag))
    given = lambda score, where: F.round(100 * F.avg(F.when(where, F.col(score).cast("double"))), 6)
    scores = [given(s, where).alias(f"{s}{suffix}") for s in ("uas", "las") for where, suffix in ((F.lit(True), ""), (right, "_tag_right"), (~right, "_tag_wrong"))]
    return rows.agg(F.count("*").alias("words"), F.round(100 * F.avg(right.cast("double")), 6).alias("tag_accuracy"), *scores)


def compare_by(rows: DataFrame, keys: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """(dimension, value, words, and of each measure before, after, delta in percent) for several keys in one aggregation: measures maps a name to the boolean columns of the two systems."""
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")
    flat = rows.select(place, *{c for pair in measures.values() for c in pair})
    aggs = []
    for name, (before, after) in measures.items():
        a, b = (100 * F.avg(F.col(c).cast("double")) for c in (before, after))
        aggs += [F.round(a, 6).alias(f"{name}_before"), F.round(b, 6).alias(f"{name}_after"), F.round(b - a, 6).alias(f"{name}_delta")]
    return flat.groupBy("x.dimension", "x.value").agg(F.count("*").alias("words"), *aggs)


def exact_token_metrics(rows: DataFrame, form: str = "form", pred_form: str = "pred_form", sid: str = "sid") -> DataFrame:
    """tree_metrics over the sentences whose predicted tokens all equal the gold ones: how many they are, and null scores if there are none."""
    w = Window.partitionBy(sid)
    exact = F.bool_and(F.coalesce(F.col(form).eqNullSafe(F.col(pred_form)), F.lit(False))).over(w)
    return scoring.tree_metrics(rows.withColumn("__exact", exact).where("__exact").drop("__exact"), sid)


def aliases(rows: DataFrame, signature: list[str], name: str) -> DataFrame:
    """Configurations that are equal but for their name: the signature, how many, and the sorted names."""
    return rows.groupBy(*signature).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("aliases"))


# ---- experiment bookkeeping, on the driver ------------------------------------------------------------


def experiment_signature(settings: dict) -> str:
    """sha256 of the settings as JSON with sorted keys, in ASCII."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def pending_runs(wanted: dict[str, dict], finished: dict[str, str]) -> list[str]:
    """Names of runs still to do; ValueError if a finished run of that name had other settings."""
    out = []
    for name, settings in wanted.items():
        had = finished.get(name)
        if had is None:
            out.append(name)
        elif had != experiment_signature(settings):
            raise ValueError(f"run {name} was finished with other settings")
    return out
