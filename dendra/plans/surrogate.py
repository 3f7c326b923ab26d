"""A deterministic treebank over ``lineitem``: orders are sentences, line items words.

Words are ordered by line number; a second order, by price, ranks them. The first ranked
is the root; any other depends on an earlier ranked one, so every tree is acyclic with
one root, and surface order mixes directions and crossings.

The DataFrame form exchanges once by order and looks heads up in the order's own words; the
SQL form is for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The columns of a word, in the order of its struct.
WORD = ("tid", "head", "deprel", "upos", "head_upos", "form", "pred_head", "pred_deprel")


def words(spark: SparkSession, sf_dir: str, side: str = "a", ranged: bool = False) -> DataFrame:
    """(sid, tid, head, deprel, upos, head_upos, form, pred_head, pred_deprel), a row per word, as sorted by rank within sentences.
    Side b leaves out rows with flag N.

    One exchange by order; two windows number the words by line and by price, and a third hands each its sentence's words by rank,
    so that heads are looked up without a join. Columns that a query doesn't read are never built. ``ranged``: the exchange is by
    ranges of orders, so that what is written in their order needs no other; only the orders' keys are read for the bounds."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("sid"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    if side == "b":
        rows = rows.where("l_returnflag <> 'N'")
    if ranged:
        rows = rows.repartitionByRange("sid")
    mine = Window.partitionBy("sid")
    rows = rows.withColumn("tid", F.row_number().over(mine.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")))
    ranked = mine.orderBy("l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey", "tid")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", F.row_number().over(ranked).alias("rank"), F.collect_list(F.struct("tid", "l_partkey")).over(whole).alias("order"))
    tag = lambda key: F.concat(F.lit("U"), (key % 7).cast("string"))
    rank, above = F.col("rank"), F.greatest(F.col("rank") - 1, F.lit(1))
    first = F.element_at("order", (1 + F.col("l_partkey") % above).cast("int"))
    deprel = F.when(rank == 1, "root").otherwise(F.concat("l_returnflag", F.lit(":"), "l_linestatus"))
    moved = F.when(F.col("l_suppkey") % 4 != 0, first["tid"]).otherwise(F.element_at("order", above)["tid"])
    return rows.select(
        "sid", "tid", F.when(rank == 1, 0).otherwise(first["tid"]).alias("head"), deprel.alias("deprel"), tag(F.col("l_partkey")).alias("upos"),
        F.when(rank == 1, "ROOT").otherwise(tag(first["l_partkey"])).alias("head_upos"), F.concat(F.lit("w"), (F.col("l_partkey") % 100).cast("string")).alias("form"),
        F.when(rank == 1, 0).otherwise(moved).alias("pred_head"), F.when(F.col("l_suppkey") % 5 != 0, deprel).otherwise(F.concat(F.lit("dep:"), "l_linestatus")).alias("pred_deprel"),
    )


def sentences(spark: SparkSession, sf_dir: str, side: str = "a", columns: tuple[str, ...] = WORD, ranged: bool = False) -> DataFrame:
    """(sid, words): words in surface order as structs of the columns. Gathered where the words lie, without another exchange."""
    mine = Window.partitionBy("sid").orderBy("tid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = words(spark, sf_dir, side, ranged).select("sid", "tid", F.collect_list(F.struct(*columns)).over(mine).alias("words"))
    return gathered.where("tid = 1").select("sid", "words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a bound variable isn't copied into lambdas by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def arcs(sents: DataFrame) -> DataFrame:
    """One row per word, with the head's tag already looked up in the row: no join."""
    return sents.select("sid", F.inline("words"))


def arcs_sql(name: str = "arcs", side: str = "a") -> str:
    """The same arcs as common table expressions ``name`` (and helpers), without WITH."""
    only = "WHERE l_returnflag <> 'N'" if side == "b" else ""
    s = f"{name}_s"
    return f"""{s} AS (
  SELECT l_orderkey AS sid, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS tid,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus) AS k
  FROM lineitem {only}),
{name}_t AS (
  SELECT s.sid, s.tid, CASE WHEN s.k = 1 THEN 0 ELSE h.tid END AS head,
    CASE WHEN s.k = 1 THEN 'root' ELSE s.l_returnflag || ':' || s.l_linestatus END AS deprel,
    'U' || CAST(s.l_partkey % 7 AS VARCHAR) AS upos, 'w' || CAST(s.l_partkey % 100 AS VARCHAR) AS form,
    CASE WHEN s.k = 1 THEN 0 WHEN s.l_suppkey % 4 <> 0 THEN h.tid ELSE p.tid END AS pred_head,
    CASE WHEN s.l_suppkey % 5 = 0 THEN 'dep:' || s.l_linestatus WHEN s.k = 1 THEN 'root' ELSE s.l_returnflag || ':' || s.l_linestatus END AS pred_deprel
  FROM {s} s LEFT JOIN {s} h ON h.sid = s.sid AND h.k = 1 + (s.l_partkey % greatest(s.k - 1, 1))
  LEFT JOIN {s} p ON p.sid = s.sid AND p.k = s.k - 1),
{name} AS (
  SELECT t.*, CASE WHEN t.head = 0 THEN 'ROOT' ELSE h.upos END AS head_upos,
    split_part(t.deprel, ':', 1) AS base,
    CASE WHEN t.head = 0 THEN 0 ELSE abs(t.tid - t.head) END AS dist,
    CASE WHEN t.head = 0 THEN 'ROOT' WHEN t.head < t.tid THEN 'head_left' ELSE 'head_right' END AS direction,
    CASE WHEN t.head = 0 THEN 'ROOT' WHEN abs(t.tid - t.head) <= 2 THEN '1-2' WHEN abs(t.tid - t.head) <= 5 THEN '3-5' ELSE '6+' END AS bucket
  FROM {name}_t t LEFT JOIN {name}_t h ON h.sid = t.sid AND h.tid = t.head)"""
