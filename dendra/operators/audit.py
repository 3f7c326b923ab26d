"""Parallel joins and their audits, tree problems, coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.operators import trees


def parallel_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """1:1 join on a key that is unique and complete on both sides; anything else fails the query (columns of b get the suffix _b)."""
    w = Window.partitionBy(key)  # the join's own partitioning: counting adds no shuffle
    left = a.withColumn("__na", F.count("*").over(w))
    right = b.select(F.col(key), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key]).withColumn("__nb", F.count("*").over(w))
    ok = (F.col("__na") == 1) & (F.col("__nb") == 1)
    fault = F.raise_error(F.concat(F.lit(f"{key} is not 1:1: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return left.join(right, key, "full").where(F.when(ok, True).otherwise(fault).cast("boolean")).drop("__na", "__nb")


def parallel_exclusions(a: DataFrame, b: DataFrame, key: str, keep_a: list[str], keep_b: list[str]) -> DataFrame:
    """Each row of a with its match in b, or the reason why there is none, in this order: no key, key not unique in a, number of matches in b."""
    left = a.join(a.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__na")), key, "left")
    one = b.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__nb"), *[F.min(c).alias(f"{c}_b") for c in keep_b])
    rows = left.join(one, key, "left")
    n = F.coalesce("__nb", F.lit(0))
    reason = F.when(F.col(key).isNull(), "no parallel id").when(F.col("__na") != 1, "parallel id not unique").when(n != 1, F.concat(F.lit("match count "), n.cast("string")))
    return rows.select(key, *keep_a, reason.alias("reason"), *[F.when(reason.isNull(), F.col(f"{c}_b")).alias(f"{c}_b") for c in keep_b])


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(problem, key, n): keys of one side only, and keys that a side holds twice or more."""
    both = a.select(key, F.lit("a").alias("side")).union(b.select(key, F.lit("b").alias("side"))).where(F.col(key).isNotNull())
    g = both.groupBy(key).agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    problems = F.array_compact(F.array(F.when(F.col("nb") == 0, F.struct(F.lit("only_in_a").alias("problem"), F.col("na").alias("n"))), F.when(F.col("na") == 0, F.struct(F.lit("only_in_b").alias("problem"), F.col("nb").alias("n"))), F.when(F.col("na") > 1, F.struct(F.lit("twice_in_a").alias("problem"), F.col("na").alias("n"))), F.when(F.col("nb") > 1, F.struct(F.lit("twice_in_b").alias("problem"), F.col("nb").alias("n")))))
    return g.select(key, F.explode(problems).alias("x")).select("x.problem", key, "x.n")


def root_histogram(sents: DataFrame, heads: str = "heads") -> DataFrame:
    return sents.groupBy(F.size(F.filter(heads, lambda h: h == 0)).cast("bigint").alias("roots")).agg(F.count("*").alias("sentences"))


def tree_problems(sents: DataFrame, id_col: str = "sid", heads: str = "heads") -> DataFrame:
    """(id, type, detail): non_integer_head (null), head_out_of_range, unexpected_root_count, dependency_cycle (least rotation). Only cycles use a UDF."""
    h = F.col(heads)
    n = F.size(h)
    at = F.transform(h, lambda x, i: F.struct((i + 1).alias("i"), x.alias("h")))
    none = F.filter(at, lambda s: s["h"].isNull())
    out = F.filter(at, lambda s: (s["h"] < 0) | (s["h"] > n))
    roots = F.filter(at, lambda s: s["h"] == 0)
    say = lambda kind, arr, detail: F.transform(arr, lambda s: F.struct(F.lit(kind).alias("type"), detail(s).alias("detail")))
    found = F.concat(
        say("non_integer_head", none, lambda s: s["i"].cast("string")),
        say("head_out_of_range", out, lambda s: F.concat_ws(">", s["i"].cast("string"), s["h"].cast("string"))),
        F.when(F.size(roots) != 1, F.array(F.struct(F.lit("unexpected_root_count").alias("type"), F.size(roots).cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<type:string,detail:string>>")),
        F.transform(trees.cycles_col(h, F.lit(None).cast("array<int>")), lambda c: F.struct(F.lit("dependency_cycle").alias("type"), F.array_join(F.transform(c, lambda x: x.cast("string")), ">").alias("detail"))),
    )
    return sents.select(id_col, F.explode(found).alias("x")).select(id_col, "x.type", "x.detail")


def id_problems(sents: DataFrame, sent_id: str) -> DataFrame:
    """Missing and repeated sentence ids: (problem, sent_id, n)."""
    g = sents.groupBy(sent_id).agg(F.count("*").alias("n"))
    return g.where(F.col(sent_id).isNull() | (F.col("n") > 1)).select(F.when(F.col(sent_id).isNull(), "missing").otherwise("repeated").alias("problem"), F.col(sent_id).alias("sent_id"), "n")


def unseen_labels(rows: DataFrame, label: str, part: str, known: str = "train") -> DataFrame:
    """(part, label) that turn up in a part but not in the known one; one aggregation per label, no join."""
    g = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.collect_set(part).alias("parts"))
    return g.where(~F.array_contains("parts", known)).select(F.explode("parts").alias(part), label)


def not_contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    return inner.select(key).distinct().join(outer.select(key), key, "left_anti")
