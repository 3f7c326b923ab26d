"""Queries over the reference's operators on the driver's tables, each with its oracle in SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendra import session
from dendra.functions import expr
from dendra.operators import audit, distributions, grouping, reports, scoring, selection, similarity, textmetrics, trees
from dendra.plans import surrogate
from dendra.plans.surrogate import arcs_sql
from dendra.sources import conllu, publish

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(surrogate.words(spark, d, s) for s in "ab")


def arcs_a(spark: SparkSession, d: str) -> DataFrame:
    return distributions.describe(surrogate.words(spark, d))


def heads(spark: SparkSession, d: str) -> DataFrame:
    s = surrogate.sentences(spark, d, columns=("head", "deprel"))
    return s.select("sid", F.col("words.head").alias("heads"), F.col("words.deprel").alias("labels"))


A, B = arcs_sql("a"), arcs_sql("b", "b")
BOTH = f"WITH {A}, {B}, u AS (SELECT *, 'a' AS side FROM a UNION ALL SELECT *, 'b' AS side FROM b), tot AS (SELECT (SELECT count(*) FROM a) AS wa, (SELECT count(*) FROM b) AS wb, (SELECT count(DISTINCT sid) FROM a) AS sa, (SELECT count(DISTINCT sid) FROM b) AS sb)"
JUDGED = f"WITH {A}, j AS (SELECT *, head = pred_head AS uas, head = pred_head AND base = split_part(pred_deprel, ':', 1) AS las, head = pred_head AND deprel = pred_deprel AS strict, deprel = pred_deprel AS label_ok, (sid + tid) % 6 <> 0 AS other FROM a)"


def pct(x: str) -> str:
    return f"round(100 * avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END), 6)"


# ---- distributions --------------------------------------------------------------------


def _rel(s: str) -> str:
    on = f"side = '{s}'"
    n = f"count(*) FILTER ({on})"
    arcs = f"count(*) FILTER ({on} AND head <> 0)"
    return f"""{n} AS count_{s}, round(1000.0 * {n} / max(w{s}), 6) AS per_1000_{s}, round(1.0 * {n} / max(s{s}), 6) AS per_sentence_{s},
      round(100.0 * count(*) FILTER ({on} AND direction = 'head_left') / nullif({arcs}, 0), 6) AS head_left_pct_{s},
      round(100.0 * count(*) FILTER ({on} AND dist >= 6) / nullif({n}, 0), 6) AS long_pct_{s},
      round(1.0 * sum(dist) FILTER ({on} AND head <> 0) / nullif({arcs}, 0), 6) AS mean_distance_{s}"""


@query(f"{BOTH} SELECT deprel, {_rel('a')}, {_rel('b')}, round(1.0 * count(*) FILTER (side = 'a') / max(sa) - 1.0 * count(*) FILTER (side = 'b') / max(sb), 6) AS per_sentence_difference FROM u, tot GROUP BY deprel")
def relation_distribution(spark, d):
    return distributions.relation_distribution(*sides(spark, d))


@query(f"""{BOTH} SELECT upos, head_upos, deprel, direction, bucket, count(*) FILTER (side = 'a') AS count_a, count(*) FILTER (side = 'b') AS count_b,
  round(1000.0 * count(*) FILTER (side = 'a') / max(wa), 6) AS per_1000_a, round(1000.0 * count(*) FILTER (side = 'b') / max(wb), 6) AS per_1000_b,
  round(abs(1000.0 * count(*) FILTER (side = 'a') / max(wa) - 1000.0 * count(*) FILTER (side = 'b') / max(wb)), 6) AS shift
  FROM u, tot GROUP BY upos, head_upos, deprel, direction, bucket""")
def signature_shifts(spark, d):
    return distributions.signature_shifts(*sides(spark, d))


_TERMS = "sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END)"


@query(f"""{BOTH}, x AS ({' UNION ALL '.join(f"SELECT side, '{n}' AS dimension, {c} AS key FROM u" for n, c in zip(distributions.DIMENSIONS, ("deprel", "base", "direction", "bucket", "upos", "head_upos", "concat_ws('|', upos, head_upos, deprel, direction, bucket)"), strict=True))}),
  c AS (SELECT dimension, key, CAST(count(*) FILTER (side = 'a') AS DOUBLE) AS na, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS nb FROM x GROUP BY dimension, key),
  f AS (SELECT dimension, na / sum(na) OVER (PARTITION BY dimension) AS p, nb / sum(nb) OVER (PARTITION BY dimension) AS q FROM c)
  SELECT dimension, round({_TERMS}, 6) AS js_bits, round(sum(abs(p - q)) / 2, 6) AS total_variation FROM f GROUP BY dimension""")
def divergence_table(spark, d):
    return distributions.divergence_table(*sides(spark, d))


_SHIFTS = f"""{BOTH}, c AS (SELECT sid, base, CAST(count(*) FILTER (side = 'a') AS DOUBLE) AS na, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS nb FROM u GROUP BY sid, base),
  f AS (SELECT sid, coalesce(na / nullif(sum(na) OVER (PARTITION BY sid), 0), 0) AS p, coalesce(nb / nullif(sum(nb) OVER (PARTITION BY sid), 0), 0) AS q FROM c),
  js AS (SELECT sid, round({_TERMS}, 6) AS js_bits FROM f GROUP BY sid),
  s AS (SELECT sid, count(*) FILTER (side = 'a') AS words_a, count(*) FILTER (side = 'b') AS words_b,
    {', '.join(f"round(coalesce(1.0 * sum(dist) FILTER (side = '{x}') / nullif(count(*) FILTER (side = '{x}' AND head <> 0), 0), 0), 6) AS mean_distance_{x}, round(coalesce(100.0 * count(*) FILTER (side = '{x}' AND dist >= 6) / nullif(count(*) FILTER (side = '{x}' AND head <> 0), 0), 0), 6) AS long_pct_{x}" for x in 'ab')} FROM u GROUP BY sid),
  shifts AS (SELECT s.sid, words_a, words_b, mean_distance_a, mean_distance_b, long_pct_a, long_pct_b, js_bits FROM s JOIN js ON s.sid = js.sid WHERE words_a > 0 AND words_b > 0)"""


@query(f"{_SHIFTS} SELECT * FROM shifts")
def sentence_shifts(spark, d):
    return distributions.sentence_shifts(*sides(spark, d))


@query(f"{_SHIFTS} SELECT count(*) AS pairs, {', '.join(f'CASE WHEN var_pop({c}_a) > 0 AND var_pop({c}_b) > 0 THEN round(corr({c}_a, {c}_b), 6) END AS r_{c}' for c in ('words', 'mean_distance', 'long_pct'))} FROM shifts")
def parallel_correlation(spark, d):
    return distributions.parallel_correlation(distributions.sentence_shifts(*sides(spark, d)))


@query(f"""{BOTH}, s AS (SELECT side, sid, count(*) AS n, count(*) FILTER (head <> 0) AS arcs, sum(dist) AS dist, count(*) FILTER (dist >= 6) AS long, count(*) FILTER (direction = 'head_left') AS lft FROM u GROUP BY side, sid)
  SELECT side, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS words, round(avg(n), 6) AS mean_words, round(1.0 * sum(dist) / sum(arcs), 6) AS mean_distance, round(100.0 * sum(long) / sum(n), 6) AS long_pct, round(100.0 * sum(lft) / sum(arcs), 6) AS head_left_pct FROM s GROUP BY side""")
def corpus_summary(spark, d):
    return distributions.corpus_summary(*sides(spark, d))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT count(n) AS n, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean,
  round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95 FROM s""")
def length_stats(spark, d):
    return distributions.length_stats(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")))


PRICE_SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@query("SELECT " + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS p{int(100 * p):03d}" for p in PRICE_SHARES) + " FROM lineitem")
def price_percentiles(spark, d):
    """Percentiles of a column of nearly as many values as rows."""
    found = distributions.percentiles(table(spark, d, "lineitem"), "l_extendedprice", list(PRICE_SHARES))
    names = [f"p{int(100 * p):03d}" for p in PRICE_SHARES]
    return spark.createDataFrame([[None if x is None else round(x, 6) for x in found]], ", ".join(f"{x} double" for x in names))


@query("WITH s AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT n AS value, count(*) AS n FROM s GROUP BY s.n")
def length_histogram(spark, d):
    return distributions.value_counts(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("words")), "words")


@query(f"WITH {A} SELECT upos, bucket, CASE WHEN dist = 0 THEN 'ROOT' WHEN dist = 1 THEN '1' WHEN dist = 2 THEN '2' WHEN dist <= 5 THEN '3-5' WHEN dist <= 10 THEN '6-10' ELSE '11+' END AS fine, count(*) AS n FROM a GROUP BY ALL")
def distance_buckets(spark, d):
    rows = arcs_a(spark, d)
    return rows.groupBy("upos", "bucket", expr.distance_bucket_fine(F.col("tid"), F.col("head")).alias("fine")).agg(F.count("*").alias("n"))


# ---- groups and splits ------------------------------------------------------------------

#: The published ids name a group after all its members; the split names it after its first, so that no group is gathered.
GROUPS = "g AS (SELECT text, 'grp-' || substr(sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)), 1, 16) AS group_id, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY text)"
NAMED = "g AS (SELECT text, 'grp-' || substr(sha256(CAST(min(doc_id) AS VARCHAR)), 1, 16) AS group_id, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY text)"
SPLIT = f"""{NAMED}, o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY sha256('42:' || group_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle, sum(size) OVER () AS total FROM g),
  sp AS (SELECT text, group_id, size, first, CASE WHEN CAST(middle AS DOUBLE) <= CAST(0.8 AS DOUBLE) * CAST(total AS DOUBLE) THEN 'train' WHEN CAST(middle AS DOUBLE) <= CAST(0.9 AS DOUBLE) * CAST(total AS DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM o),
  ds AS (SELECT d.doc_id, d.text, d.lang, d.source, sp.group_id, sp.split FROM documents d JOIN sp ON d.text IS NOT DISTINCT FROM sp.text)"""


def doc_groups(spark: SparkSession, d: str, exact_id: bool = False) -> DataFrame:
    return grouping.duplicate_groups(table(spark, d, "documents"), F.sha2("text", 256), "doc_id", "doc_id", exact_id)


def doc_split(spark: SparkSession, d: str) -> DataFrame:
    """documents with group_key, group_id and split; null texts are one group."""
    groups = grouping.split_by_hash(doc_groups(spark, d)).select(F.col("group_key").alias("key"), "group_id", "split")
    rows = table(spark, d, "documents").withColumn("group_key", F.sha2("text", 256))
    return rows.join(groups, F.col("group_key").eqNullSafe(F.col("key"))).drop("key")


@query(f"WITH {GROUPS} SELECT group_id, size, first FROM g")
def duplicate_groups(spark, d):
    return doc_groups(spark, d, exact_id=True).select("group_id", "size", "first")


@query(f"WITH {SPLIT} SELECT group_id, size, split FROM sp")
def group_split_hash(spark, d):
    return grouping.split_by_hash(doc_groups(spark, d)).select("group_id", "size", "split")


@query()
def group_split_random(spark, d):
    return grouping.split_by_shuffle(doc_groups(spark, d)).select("group_id", "size", "split")


@query()
def simple_split_random(spark, d):
    return grouping.split_simple(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"""WITH {SPLIT}, x AS (SELECT split, length(text) AS n, 'all' AS dimension, '' AS value FROM ds UNION ALL SELECT split, length(text), 'lang', coalesce(lang, '') FROM ds UNION ALL SELECT split, length(text), 'source', coalesce(source, '') FROM ds)
  SELECT split, dimension, value, count(*) AS n, CAST(sum(n) AS BIGINT) AS total_length, round(avg(n), 6) AS mean_length FROM x GROUP BY split, dimension, value""")
def split_stats(spark, d):
    return grouping.split_statistics(doc_split(spark, d).withColumn("len", F.char_length("text")), "len", ["lang", "source"])


@query(f"WITH {SPLIT} SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM ds GROUP BY source")
def crosstab_split_source(spark, d):
    return doc_split(spark, d).groupBy("source").pivot("split", ["train", "dev", "test"]).agg(F.count("doc_id")).fillna(0)


@query("SELECT CAST(NULL AS VARCHAR) AS \"check\", CAST(NULL AS VARCHAR) AS value WHERE 1 = 0")
def split_leak_check(spark, d):
    return grouping.split_violations(doc_split(spark, d), "doc_id", "group_key")


#: A split of rows instead of groups: copies fall apart, and some rows stand in it twice.
CARELESS = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END"


@query(f"""WITH {NAMED}, d AS (SELECT doc_id, documents.text, group_id, {CARELESS} AS split FROM documents JOIN g ON documents.text IS NOT DISTINCT FROM g.text),
  x AS (SELECT * FROM d UNION ALL SELECT doc_id, text, group_id, 'dev' FROM d WHERE doc_id % 97 = 0)
  SELECT 'member_twice' AS "check", CAST(doc_id AS VARCHAR) AS value FROM x GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT 'key_in_two_splits', sha256(text) FROM x GROUP BY text HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'group_in_two_splits', group_id FROM x GROUP BY group_id HAVING count(DISTINCT split) > 1""")
def split_faults(spark, d):
    """The checks of split_leak_check over a split that breaks all of them."""
    rows = doc_split(spark, d).withColumn("split", F.expr(CARELESS))
    rows = rows.unionByName(rows.where("doc_id % 97 = 0").withColumn("split", F.lit("dev")))
    return grouping.split_violations(rows, "doc_id", "group_key")


#: What a faulty copy of the split does to its blocks: some go, some come twice, some change, some move.
SPOILT = {"gone": "doc_id % 89 = 3", "twice": "doc_id % 83 = 5", "changed": "doc_id % 79 = 7 AND text IS NOT NULL", "moved": "split = 'dev' AND doc_id % 11 = 2"}


def spoilt(rows: DataFrame) -> DataFrame:
    rows = rows.where(f"NOT ({SPOILT['gone']})")
    rows = rows.union(rows.where(SPOILT["twice"]))
    return rows.withColumn("text", F.expr(f"CASE WHEN {SPOILT['changed']} THEN concat(text, ' ') ELSE text END")).withColumn("split", F.expr(f"CASE WHEN {SPOILT['moved']} THEN 'test' ELSE split END"))


_SPOILT = f"""{SPLIT}, lossy AS (SELECT * FROM ds WHERE NOT ({SPOILT['gone']})), twice AS (SELECT * FROM lossy UNION ALL SELECT * FROM lossy WHERE {SPOILT['twice']}),
  spoilt AS (SELECT CASE WHEN {SPOILT['moved']} THEN 'test' ELSE split END AS split, sha256(CASE WHEN {SPOILT['changed']} THEN text || ' ' ELSE text END) AS block_sha256 FROM twice),
  both_ AS (SELECT split, sha256(text) AS block_sha256, 1 AS a FROM ds UNION ALL SELECT split, block_sha256, 0 FROM spoilt),
  c AS (SELECT split, block_sha256, CAST(sum(a) AS BIGINT) AS n_source, CAST(sum(1 - a) AS BIGINT) AS n_output FROM both_ GROUP BY split, block_sha256)"""


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("split", F.sha2("text", 256).alias("block_sha256"))


@query(f"WITH {_SPOILT} SELECT split, CAST(sum(n_source) AS BIGINT) AS n_source, CAST(sum(n_output) AS BIGINT) AS n_output, bool_and(n_source = n_output) AS identical FROM c GROUP BY split")
def block_identity(spark, d):
    """A faulty copy of the split against its source, by digests."""
    rows = doc_split(spark, d).select("doc_id", "text", "split")
    return grouping.block_identity(hashed(rows), hashed(spoilt(rows)), "split", "block_sha256")


@query(f"WITH {_SPOILT} SELECT split, block_sha256, n_source, n_output FROM c WHERE n_source <> n_output")
def differing_blocks(spark, d):
    rows = doc_split(spark, d).select("doc_id", "text", "split")
    return grouping.differing_blocks(hashed(rows), hashed(spoilt(rows)), "split", "block_sha256")


@query("SELECT * FROM (SELECT 'first' AS run, 'written' AS outcome UNION ALL SELECT 'again', 'unchanged' UNION ALL SELECT 'other', 'refused'), (SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents)")
def published_documents(spark, d):
    """What publishing the same rows twice and other rows once reports, and what is to be read afterwards."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    path = session.folder(spark, "published")
    runs = [("first", publish.publish_rows(rows, path)), ("again", publish.publish_rows(rows.repartition("doc_id"), path))]
    try:
        runs.append(("other", publish.publish_rows(rows.where("doc_id % 50 <> 1"), path)))
    except FileExistsError:
        runs.append(("other", "refused"))
    kept = publish.read_published(spark, path).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes"))
    return kept.crossJoin(F.broadcast(spark.createDataFrame(runs, "run string, outcome string")))  # three rows and one


@query(f"WITH {SPLIT} SELECT split, count(*) AS n_source, count(*) AS n_output, true AS identical FROM ds GROUP BY split")
def written_blocks(spark, d):
    """The split written as tables and read again: every block is as it was."""
    rows = doc_split(spark, d).select("doc_id", "text", "split")
    path = session.folder(spark, "split")
    rows.write.partitionBy("split").parquet(path)
    return grouping.block_identity(hashed(rows), hashed(spark.read.parquet(path)), "split", "block_sha256")


@query(f"WITH {SPLIT}, l AS (SELECT source || '/' || lang || '/' || CAST(length(text) // 500 AS VARCHAR) AS label, split FROM ds) SELECT DISTINCT split, label FROM l WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l t WHERE t.label = l.label AND t.split = 'train')")
def unseen_labels(spark, d):
    rows = doc_split(spark, d).withColumn("label", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.floor(F.char_length("text") / 500).cast("string")))
    return audit.unseen_labels(rows, "label", "split")


_NORM = "lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))"


@query(f"""WITH n AS (SELECT doc_id, sha256(text) AS exact, sha256({_NORM}) AS joined, source FROM documents), g AS (SELECT joined, count(*) AS size, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members, count(DISTINCT exact) AS e, count(DISTINCT joined) AS j, count(DISTINCT source) AS s FROM n GROUP BY joined HAVING count(*) > 1)
  SELECT joined AS group_key, size, members, e < size AS exact_collision, j < size AS joined_collision, e > 1 AS tokenization_differs, s > 1 AS annotation_inconsistent FROM g""")
def duplicate_report(spark, d):
    return grouping.duplicate_report(_keyed(spark, d), "group_key", "doc_id", "exact", "group_key", "source")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("exact"), F.sha2(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", "")), 256).alias("group_key"), "source")


@query(f"WITH n AS (SELECT doc_id, sha256({_NORM}) AS group_key, source FROM documents) SELECT group_key, row_number() OVER (PARTITION BY group_key ORDER BY doc_id) AS member_rank, doc_id, source FROM n QUALIFY count(*) OVER (PARTITION BY group_key) > 1")
def duplicate_members(spark, d):
    """The members that duplicate_report lists, as rows."""
    return grouping.group_members(_keyed(spark, d), "group_key", "doc_id", "source")


@query(f"""WITH n AS (SELECT doc_id, sha256(text) AS exact, sha256({_NORM}) AS joined, source FROM documents), x AS (SELECT 'tokens' AS key_type, exact AS key, source FROM n UNION ALL SELECT 'joined', joined, source FROM n)
  SELECT key_type, key, count(*) AS n, count(DISTINCT source) > 1 AS annotation_disagreement FROM x GROUP BY key_type, key HAVING count(*) > 1""")
def duplicate_audit(spark, d):
    return grouping.duplicate_audit(_keyed(spark, d), "exact", "group_key", "source")


@query(f"WITH n AS (SELECT sha256({_NORM}) AS k FROM documents), g AS (SELECT k, count(*) AS size FROM n GROUP BY k) SELECT count(*) FILTER (size > 1) AS groups, CAST(coalesce(sum(size) FILTER (size > 1), 0) AS BIGINT) AS documents, count(*) FILTER (size = 1) AS single FROM g")
def group_counts(spark, d):
    g = _keyed(spark, d).groupBy("group_key").agg(F.count("*").alias("size"))
    return g.agg(F.count_if(F.col("size") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).cast("bigint").alias("documents"), F.count_if(F.col("size") == 1).alias("single"))


# ---- parallel audits ----------------------------------------------------------------------


@query("""WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
  na AS (SELECT conv_id, count(*) AS n FROM a GROUP BY conv_id), nb AS (SELECT conv_id, count(*) AS n, min(turn) AS t FROM b GROUP BY conv_id),
  r AS (SELECT a.conv_id, a.turn, CASE WHEN a.conv_id IS NULL THEN 'no parallel id' WHEN na.n <> 1 THEN 'parallel id not unique' WHEN coalesce(nb.n, 0) <> 1 THEN 'match count ' || CAST(coalesce(nb.n, 0) AS VARCHAR) END AS reason, nb.t FROM a LEFT JOIN na ON a.conv_id = na.conv_id LEFT JOIN nb ON a.conv_id = nb.conv_id)
  SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN t END AS turn_b FROM r""")
def parallel_exclusions(spark, d):
    c = table(spark, d, "conversations")
    return audit.parallel_exclusions(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", ["turn"], ["turn"])


_ONE = "SELECT sid, count(*) AS n FROM {} GROUP BY sid"


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'N'), u AS (SELECT k, 'a' AS side FROM a UNION ALL SELECT k, 'b' FROM b), g AS (SELECT k, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM u GROUP BY k)
  SELECT 'only_in_a' AS problem, k, na AS n FROM g WHERE nb = 0 UNION ALL SELECT 'only_in_b', k, nb FROM g WHERE na = 0 UNION ALL SELECT 'twice_in_a', k, na FROM g WHERE na > 1 UNION ALL SELECT 'twice_in_b', k, nb FROM g WHERE nb > 1""")
def unmatched_audit(spark, d):
    return audit.unmatched(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT o.o_orderkey, count(*) AS words, max(o.o_orderpriority) AS priority FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def parallel_join(spark, d):
    """Orders with items against their items: neither side has a row that the other lacks, and the join fails if one had."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("words"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    return audit.parallel_join(lines, orders, "o_orderkey").select("o_orderkey", "words", F.col("o_orderpriority_b").alias("priority"))


# ---- trees ----------------------------------------------------------------------------------

#: Faults put into the surrogate trees: missing and far heads, second roots, two-word cycles.
FAULTS = "CASE WHEN sid % 13 = 0 AND tid = 1 THEN NULL WHEN sid % 7 = 0 AND tid = 1 THEN 99 WHEN sid % 5 = 0 AND tid = 2 THEN 0 WHEN sid % 3 = 0 AND tid = 1 AND n > 1 THEN 2 WHEN sid % 3 = 0 AND tid = 2 THEN 1 ELSE head END"


def faulty(spark: SparkSession, d: str) -> DataFrame:
    sid, n = F.col("sid"), F.size("heads")

    def wrong(h: Column, i: Column) -> Column:
        first, second = i == 0, i == 1
        return F.when((sid % 13 == 0) & first, F.lit(None)).when((sid % 7 == 0) & first, 99).when((sid % 5 == 0) & second, 0).when((sid % 3 == 0) & first & (n > 1), 2).when((sid % 3 == 0) & second, 1).otherwise(h)

    return heads(spark, d).select("sid", F.transform("heads", wrong).alias("heads"))


FAULTY = f"{A}, fa AS (SELECT sid, tid, head, count(*) OVER (PARTITION BY sid) AS n FROM a), f AS (SELECT sid, tid, n, {FAULTS} AS head FROM fa)"


@query(f"WITH {FAULTY}, r AS (SELECT sid, count(*) FILTER (head = 0) AS roots FROM f GROUP BY sid) SELECT roots, count(*) AS sentences FROM r GROUP BY roots")
def root_histogram(spark, d):
    return audit.root_histogram(faulty(spark, d))


@query(f"""WITH RECURSIVE {FAULTY}, w AS (SELECT sid, tid AS start, tid AS least, head AS cur, CAST(tid AS VARCHAR) AS path, 1 AS steps, n FROM f WHERE head IS NOT NULL AND head <> 0
  UNION ALL SELECT w.sid, w.start, least(w.least, f.tid), f.head, w.path || '>' || CAST(f.tid AS VARCHAR), w.steps + 1, w.n FROM w JOIN f ON f.sid = w.sid AND f.tid = w.cur WHERE w.cur <> w.start AND w.steps <= w.n AND f.head IS NOT NULL AND f.head <> 0)
  SELECT sid, 'non_integer_head' AS type, CAST(tid AS VARCHAR) AS detail FROM f WHERE head IS NULL
  UNION ALL SELECT sid, 'head_out_of_range', CAST(tid AS VARCHAR) || '>' || CAST(head AS VARCHAR) FROM f WHERE head > n OR head < 0
  UNION ALL SELECT sid, 'unexpected_root_count', CAST(count(*) FILTER (head = 0) AS VARCHAR) FROM f GROUP BY sid HAVING count(*) FILTER (head = 0) <> 1
  UNION ALL SELECT sid, 'dependency_cycle', path FROM w WHERE cur = start AND least = start""")
def tree_problems(spark, d):
    return audit.tree_problems(faulty(spark, d))


@query(f"""WITH {A}, s AS (SELECT sid, least(tid, head) AS lo, greatest(tid, head) AS hi FROM a), x AS (SELECT DISTINCT p.sid FROM s p JOIN s q ON p.sid = q.sid AND p.lo < q.lo AND q.lo < p.hi AND p.hi < q.hi)
  SELECT t.sid, x.sid IS NULL AS projective FROM (SELECT DISTINCT sid FROM a) t LEFT JOIN x ON t.sid = x.sid""")
def projectivity(spark, d):
    return heads(spark, d).select("sid", trees.projective(F.col("heads")).alias("projective"))


@query(f"""WITH {A}, s AS (SELECT sid, tid, least(tid, head) AS lo, greatest(tid, head) AS hi FROM a), x AS (SELECT p.sid, p.tid, count(*) AS n FROM s p JOIN s q ON p.sid = q.sid AND ((p.lo < q.lo AND q.lo < p.hi AND p.hi < q.hi) OR (q.lo < p.lo AND p.lo < q.hi AND q.hi < p.hi)) GROUP BY p.sid, p.tid)
  SELECT s.sid, s.tid, coalesce(x.n, 0) AS crossed FROM s LEFT JOIN x ON s.sid = x.sid AND s.tid = x.tid""")
def crossing_arcs(spark, d):
    """How many arcs each word's arc crosses."""
    rows = heads(spark, d).select("sid", F.posexplode(trees.crossings_col(F.col("heads"))).alias("i", "crossed"))
    return rows.select("sid", (F.col("i") + 1).alias("tid"), F.col("crossed").cast("bigint").alias("crossed"))


WALK = f"WITH RECURSIVE {A}, w AS (SELECT sid, tid, lpad(CAST(tid AS VARCHAR), 4, '0') AS path, 1 AS depth FROM a WHERE head = 0 UNION ALL SELECT a.sid, a.tid, w.path || lpad(CAST(a.tid AS VARCHAR), 4, '0'), w.depth + 1 FROM w JOIN a ON a.sid = w.sid AND a.head = w.tid)"


@query(f"{WALK} SELECT sid, string_agg(CAST(tid AS VARCHAR), '-' ORDER BY path) AS preorder, string_agg(CAST(tid AS VARCHAR), '-' ORDER BY path || '~' DESC) AS reversed_postorder_by_children FROM w GROUP BY sid".replace(", string_agg(CAST(tid AS VARCHAR), '-' ORDER BY path || '~' DESC) AS reversed_postorder_by_children", ", string_agg(CAST(tid AS VARCHAR), '-' ORDER BY path || '~') AS postorder"))
def tree_traversal(spark, d):
    none = F.lit(None).cast("array<int>")
    text = lambda c: F.array_join(c.cast("array<string>"), "-")
    return heads(spark, d).select("sid", text(trees.preorder_col("heads", none)).alias("preorder"), text(trees.postorder_col("heads", none)).alias("postorder"))


@query(f"{WALK} SELECT sid, CAST(max(depth) AS BIGINT) AS depth, CAST(sum(depth) AS BIGINT) AS total_depth FROM w GROUP BY sid")
def tree_depth(spark, d):
    deep = trees.depths_col("heads", F.lit(None).cast("array<int>"))
    rows = heads(spark, d).select("sid", deep.alias("x"))
    return rows.select("sid", F.array_max("x").cast("bigint").alias("depth"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total_depth"))


@query(f"WITH {A} SELECT sid, count(*) AS words, count(*) AS shifts_less_swaps, count(*) AS reductions FROM a GROUP BY sid")
def transition_counts(spark, d):
    rows = heads(spark, d).select("sid", F.size("heads").cast("bigint").alias("words"), trees.actions_col("heads", "labels").alias("x"))
    count = lambda name: F.size("x") - F.size(F.array_remove("x", name))
    reductions = F.size(F.filter("x", lambda a: a.contains("_REDUCE:")))
    return rows.select("sid", "words", (count(trees.SHIFT) - count(trees.SWAP)).cast("bigint").alias("shifts_less_swaps"), reductions.cast("bigint").alias("reductions"))


@query("SELECT CAST(NULL AS BIGINT) AS sid WHERE 1 = 0")
def transition_roundtrip(spark, d):
    return heads(spark, d).select("sid", trees.roundtrip_col("heads", "labels").alias("same")).where("NOT same").select("sid")


@query(f"WITH {A} SELECT sid, string_agg(CAST(head AS VARCHAR), '-' ORDER BY tid) AS heads, string_agg(deprel, ' ' ORDER BY tid) AS labels FROM a GROUP BY sid")
def derived_trees(spark, d):
    """The trees that the derived transitions build when they are replayed."""
    rows = heads(spark, d).select("sid", trees.derived_col("heads", "labels").alias("x"))
    return rows.select("sid", "x.heads", "x.labels")


@query()
def swap_stats(spark, d):
    rows = heads(spark, d).select(F.size(F.filter(trees.actions_col("heads", "labels"), lambda a: a == trees.SWAP)).alias("n"))
    return rows.agg(F.count_if(F.col("n") > 0).alias("sentences"), F.sum("n").alias("total"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query()
def mst_decode(spark, d):
    """Every order; no SQL can try all trees of its larger ones, a test does for up to five items."""
    return decoded(order_sizes(spark, d))


def order_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sid")).agg(F.count("*").cast("int").alias("n"))


def decoded(n: DataFrame) -> DataFrame:
    """(sid, score) of the best tree over n words with the surrogate scores."""
    score = lambda w, h: (F.col("sid") * 7 + w * 13 + h * 29 + w * h * 17) % 101
    matrix = F.transform(F.sequence(F.lit(1), F.col("n")), lambda w: F.transform(F.sequence(F.lit(0), F.col("n")), lambda h: score(w, h).cast("double")))
    # one-element explode: keeps the UDF out of the aggregation's own result list, where Spark doesn't extract it
    rows = n.select("sid", F.explode(F.array(matrix)).alias("m")).select("sid", F.posexplode(trees.mst_col("m", F.lit(None).cast("array<int>"))).alias("i", "h"))
    return rows.groupBy("sid").agg(F.sum(score(F.col("i") + 1, F.col("h"))).cast("bigint").alias("score"))


# ---- scores -----------------------------------------------------------------------------------


def judged(spark: SparkSession, d: str) -> DataFrame:
    return scoring.judged(arcs_a(spark, d)).withColumn("other", (F.col("sid") + F.col("tid")) % 6 != 0)


@query(f"{JUDGED} SELECT count(*) AS words, {pct('uas')} AS uas, {pct('las')} AS las, {pct('strict')} AS strict_las, round(100 * avg(CASE WHEN strict THEN 1.0 ELSE 0.0 END) FILTER (upos <> 'U3'), 6) AS strict_las_no_punct FROM j")
def uas_las(spark, d):
    return scoring.overall(judged(spark, d), "U3")


_GROUPED = f"{JUDGED} SELECT {{0}}, count(*) AS words, {pct('uas')} AS uas, {pct('las')} AS las, {pct('strict')} AS strict_las FROM j GROUP BY {{0}}"


@query(_GROUPED.format("bucket"))
def las_by_bucket(spark, d):
    return scoring.grouped(judged(spark, d), "bucket")


@query(_GROUPED.format("deprel"))
def las_by_relation(spark, d):
    return scoring.grouped(judged(spark, d), "deprel")


@query(f"{JUDGED} SELECT deprel AS gold_deprel, pred_deprel, count(*) AS n FROM j WHERE uas AND NOT label_ok GROUP BY deprel, pred_deprel")
def confusion(spark, d):
    return scoring.confusion(judged(spark, d))


@query(f"{JUDGED} SELECT sid, count(*) AS words, count(*) FILTER (NOT strict) AS errors, {pct('strict')} AS las FROM j GROUP BY sid ORDER BY las, words, sid LIMIT 20")
def worst_sentences(spark, d):
    return scoring.worst_sentences(judged(spark, d), 20)


@query(f"""{JUDGED}, s AS (SELECT sid, count(*) AS n, count(*) FILTER (uas) AS u, count(*) FILTER (strict) AS s, count(*) FILTER (label_ok) AS l, bool_and(head <> 0 OR pred_head = 0) AS root FROM j GROUP BY sid)
  SELECT count(*) AS sentences, round(100.0 * sum(u) / sum(n), 6) AS uas, round(100.0 * sum(s) / sum(n), 6) AS las, round(100.0 * sum(l) / sum(n), 6) AS label_accuracy, round(100.0 * count(*) FILTER (s = n) / count(*), 6) AS exact_trees, round(100.0 * count(*) FILTER (root) / count(*), 6) AS root_accuracy FROM s""")
def tree_metrics(spark, d):
    return scoring.tree_metrics(judged(spark, d))


@query(f"""{JUDGED}, x AS (SELECT deprel AS label, 1 AS g, 0 AS p, CASE WHEN strict THEN 1 ELSE 0 END AS t FROM j UNION ALL SELECT pred_deprel, 0, 1, 0 FROM j), c AS (SELECT label, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS tp FROM x GROUP BY label),
  r AS (SELECT *, coalesce(100.0 * tp / nullif(predicted, 0), 0) AS pr, coalesce(100.0 * tp / nullif(gold, 0), 0) AS re FROM c)
  SELECT label, gold, predicted, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM r""")
def relation_prf(spark, d):
    return scoring.relation_prf(judged(spark, d))


@query(f"{JUDGED} SELECT CASE WHEN strict AND other THEN 'stable_correct' WHEN other THEN 'fixed' WHEN strict THEN 'regressed' ELSE 'persistent_error' END AS change, count(*) AS n FROM j GROUP BY 1")
def system_change(spark, d):
    return judged(spark, d).groupBy(scoring.change(F.col("strict"), F.col("other")).alias("change")).agg(F.count("*").alias("n"))


@query(f"{JUDGED} SELECT deprel, count(*) AS words, {pct('strict')} AS before, {pct('other')} AS after, round(100 * avg(CASE WHEN other THEN 1.0 ELSE 0.0 END) - 100 * avg(CASE WHEN strict THEN 1.0 ELSE 0.0 END), 6) AS delta, count(*) FILTER (other AND NOT strict) AS fixed, count(*) FILTER (strict AND NOT other) AS regressed FROM j GROUP BY deprel")
def system_compare(spark, d):
    return scoring.compare(judged(spark, d), "deprel", "strict", "other")


@query(f"{JUDGED} SELECT sid, count(*) AS words, count(*) FILTER (NOT strict) AS errors_before, count(*) FILTER (NOT other) AS errors_after, count(*) FILTER (other AND NOT strict) AS fixed, count(*) FILTER (strict AND NOT other) AS regressed, max(dist) AS max_distance FROM j GROUP BY sid")
def sentence_review(spark, d):
    return scoring.sentence_review(judged(spark, d), "strict", "other")


@query(f"""{JUDGED}, x AS (SELECT least(tid, head) AS lo, greatest(tid, head) AS hi, sid FROM j), np AS (SELECT DISTINCT p.sid FROM x p JOIN x q ON p.sid = q.sid AND p.lo < q.lo AND q.lo < p.hi AND p.hi < q.hi)
  SELECT np.sid IS NULL AS projective, count(*) AS words, {pct('uas')} AS uas, {pct('las')} AS las, {pct('strict')} AS strict_las FROM j LEFT JOIN np ON j.sid = np.sid GROUP BY 1""")
def subgroup_metrics(spark, d):
    s = surrogate.sentences(spark, d).withColumn("projective", trees.projective(F.transform("words", lambda w: w["head"])))
    rows = scoring.judged(s.select("sid", "projective", F.inline("words")))
    return scoring.grouped(rows, "projective")


# ---- ordered reports ------------------------------------------------------------------------------


def _top(sql: str, order: str, top: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({sql})) WHERE rank <= {top}"


@query(_top(ORACLES["relation_distribution"], "abs(per_sentence_difference) DESC NULLS LAST, deprel", 10))
def top_relations(spark, d):
    return reports.ranked(distributions.relation_distribution(*sides(spark, d)), reports.relation_order(), 10)


@query(_top(ORACLES["signature_shifts"], "shift DESC NULLS LAST, upos, head_upos, deprel, direction, bucket", 25))
def top_signatures(spark, d):
    return reports.ranked(distributions.signature_shifts(*sides(spark, d)), reports.signature_order(), 25)


@query(_top(ORACLES["sentence_shifts"], "js_bits DESC NULLS LAST, abs(words_a - words_b) DESC, CAST(sid AS VARCHAR)", 25))
def top_pairs(spark, d):
    return reports.ranked(distributions.sentence_shifts(*sides(spark, d)), reports.pair_order("sid"), 25)


@query(_top("SELECT 'p/' || CAST(l_orderkey AS VARCHAR) AS parallel_id, count(*) AS words FROM lineitem GROUP BY l_orderkey", "CAST(split_part(parallel_id, '/', 2) AS BIGINT), parallel_id", 25))
def first_pairs(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.concat(F.lit("p/"), F.col("l_orderkey").cast("string")).alias("parallel_id")).agg(F.count("*").alias("words"))
    return reports.ranked(rows, reports.numeric_order("parallel_id"), 25)


@query(_top(ORACLES["confusion"], "n DESC, gold_deprel, pred_deprel", 20))
def top_confusions(spark, d):
    return reports.ranked(scoring.confusion(judged(spark, d)), reports.confusion_order(), 20)


@query(_top(ORACLES["las_by_relation"], "las, words DESC, deprel", 20))
def worst_relations(spark, d):
    return reports.ranked(scoring.grouped(judged(spark, d), "deprel"), reports.worst_relation_order(), 20)


@query(_top(ORACLES["las_by_relation"], "words DESC, deprel", 20))
def relations_by_support(spark, d):
    return reports.ranked(scoring.grouped(judged(spark, d), "deprel"), reports.support_order(), 20)


#: A second system, and predicted tags and tokens, by rule.
SECOND = "(sid + tid) % 4 <> 0"
TAG = "CASE WHEN (sid + tid) % 5 = 0 THEN 'X' ELSE upos END"
TOKEN = "CASE WHEN sid % 3 = 0 AND tid = 2 THEN '?' ELSE form END"


@query(f"""{JUDGED} SELECT count(*) AS words, {pct(f"({TAG}) = upos")} AS tag_accuracy, {', '.join(f"{pct(s)} AS {s}, round(100 * avg(CASE WHEN {s} THEN 1.0 ELSE 0.0 END) FILTER (({TAG}) = upos), 6) AS {s}_tag_right, round(100 * avg(CASE WHEN {s} THEN 1.0 ELSE 0.0 END) FILTER (({TAG}) <> upos), 6) AS {s}_tag_wrong" for s in ("uas", "las"))} FROM j""")
def scores_by_tag(spark, d):
    return reports.overall_by_tag(judged(spark, d).withColumn("pred_upos", F.expr(TAG)))


@query(f"""{JUDGED}, k AS (SELECT *, other AND {SECOND} AS other_las, unnest(['bucket', 'deprel']) AS dimension, unnest([bucket, deprel]) AS value FROM j)
  SELECT dimension, value, count(*) AS words, {', '.join(f"{pct(a)} AS {n}_before, {pct(b)} AS {n}_after, round(100 * avg(CASE WHEN {b} THEN 1.0 ELSE 0.0 END) - 100 * avg(CASE WHEN {a} THEN 1.0 ELSE 0.0 END), 6) AS {n}_delta" for n, a, b in (("uas", "uas", "other"), ("las", "las", "other_las")))} FROM k GROUP BY dimension, value""")
def compare_uas_las(spark, d):
    rows = judged(spark, d).withColumn("other_las", F.col("other") & F.expr(SECOND))
    return reports.compare_by(rows, ["bucket", "deprel"], {"uas": ("uas", "other"), "las": ("las", "other_las")})


@query(ORACLES["tree_metrics"].replace("FROM j GROUP BY sid)", f"FROM j GROUP BY sid HAVING bool_and(({TOKEN}) = form))"))
def exact_token_metrics(spark, d):
    return reports.exact_token_metrics(judged(spark, d).withColumn("pred_form", F.expr(TOKEN)))


@query(f"WITH {A} SELECT sid, tid, CASE WHEN head = 0 THEN 'ROOT' ELSE head_upos END AS head_tag, upos AS gold_upos, form FROM a")
def aligned_tokens(spark, d):
    """Gold sentences aligned with two systems' word by word, and head tags looked up in the sentence's own array.

    One pass over the treebank makes the sentences of all three sources; the systems' heads are pred_head."""
    s = surrogate.sentences(spark, d, columns=("tid", "form", "upos", "head", "pred_head"))
    sources = F.array(*[F.struct(F.lit(name).alias("source"), "words") for name in ("gold", "one", "two")])
    rows = scoring.align_sentences(s.select("sid", F.inline(sources)), "gold", ("one", "two"))
    aligned = rows.select("sid", F.col("words.upos").alias("tags"), F.inline("words"))
    return aligned.select("sid", "tid", expr.head_lookup(F.col("tags"), F.col("head"), "?").alias("head_tag"), F.col("upos").alias("gold_upos"), "form")


# ---- histories, pivots ---------------------------------------------------------------------------

HISTORY = "h AS (SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', ts) AS step, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), b AS (SELECT *, max(score) OVER (PARTITION BY event_type ORDER BY step) AS best FROM h), bs AS (SELECT event_type, step, score, best, min(step) OVER (PARTITION BY event_type, best) AS best_step FROM b)"


def history(spark: SparkSession, d: str) -> DataFrame:
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, d, "events").groupBy("event_type", hour.alias("step")).agg(F.round(F.avg("value"), 6).alias("score"))


@query(f"WITH {HISTORY} SELECT event_type, step, score, best, best_step FROM bs")
def running_best(spark, d):
    return selection.running_best(history(spark, d), "step", "score", "event_type").select("event_type", "step", "score", "best", "best_step")


@query(f"WITH {HISTORY}, e AS (SELECT event_type, coalesce(min(step) FILTER (step - best_step >= 24), max(step)) AS stop_step FROM bs GROUP BY event_type) SELECT e.event_type, e.stop_step, bs.best, bs.best_step FROM e JOIN bs ON e.event_type = bs.event_type AND e.stop_step = bs.step")
def early_stop(spark, d):
    return selection.early_stop(history(spark, d), "step", "score", 24, "event_type")


@query(f"""WITH RECURSIVE {HISTORY}, o AS (SELECT event_type, score, CAST(row_number() OVER (PARTITION BY event_type ORDER BY step) AS INTEGER) AS k FROM h),
  f AS (SELECT event_type, k, score AS best, k AS best_epoch FROM o WHERE k = 1
    UNION ALL SELECT o.event_type, o.k, CASE WHEN o.score > f.best + 0.05 THEN o.score ELSE f.best END, CASE WHEN o.score > f.best + 0.05 THEN o.k ELSE f.best_epoch END FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1 WHERE f.k - f.best_epoch < 24)
  SELECT event_type, max(k) AS epochs, max_by(best, k) AS best, max_by(best_epoch, k) AS best_epoch FROM f GROUP BY event_type""")
def early_stop_threshold(spark, d):
    return selection.early_stop_folded(history(spark, d), "step", "score", "event_type", 0.05, 24)


@query(f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, step) AS k FROM h) SELECT event_type, step, score FROM r WHERE k = 1")
def select_best(spark, d):
    return selection.select_best(history(spark, d), "score", "step", ["event_type"])


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS delta FROM orders GROUP BY o_orderpriority")
def method_pivot(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return p.select("o_orderpriority", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"), F.round(F.col("F") - F.col("O"), 4).alias("delta"))


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS aliases FROM nation GROUP BY n_regionkey")
def config_aliases(spark, d):
    return reports.aliases(table(spark, d, "nation"), ["n_regionkey"], "n_name")


# ---- texts -------------------------------------------------------------------------------------------


@query()
def near_duplicates(spark, d):
    return similarity.near_pairs(table(spark, d, "documents"), "doc_id", "text")


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, hyp, ref): the k-th assistant text of a conversation with its k-th user text, for every k that both have."""
    place = (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1).alias("k")
    # one exchange, by conversation, does for the ranks and the pairs
    c = table(spark, d, "conversations").where("role IN ('assistant', 'user') AND conv_id IS NOT NULL").select("conv_id", "role", "turn", "text").repartition("conv_id")
    side = lambda role, name: F.first(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).alias(name)
    pairs = c.select("conv_id", "role", place, "text").groupBy("conv_id", "k").agg(side("assistant", "hyp"), side("user", "ref"))
    return pairs.select(F.struct("conv_id", "k").alias("id"), "hyp", "ref").where("hyp IS NOT NULL AND ref IS NOT NULL")


@query("""WITH k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('assistant', 'user'))
  SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS pairs, count(*) FILTER (b.k IS NULL) AS without_user, count(*) FILTER (a.k IS NULL) AS without_assistant
  FROM (SELECT * FROM k WHERE role = 'assistant') a FULL JOIN (SELECT * FROM k WHERE role = 'user') b ON a.conv_id = b.conv_id AND a.k = b.k""")
def turns_left_out(spark, d):
    """How many turns of either side have no partner of their rank, so that no text score can count them."""
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("k")
    c = table(spark, d, "conversations").where("role IN ('assistant', 'user')").select("conv_id", "role", place)
    per = c.groupBy("conv_id", "k").agg(F.count_if(F.col("role") == "assistant").alias("a"), F.count_if(F.col("role") == "user").alias("b"))
    return per.agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("pairs"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("without_user"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("without_assistant"))


def turn_words(rows: DataFrame) -> DataFrame:
    return rows.select("id", *[F.array_remove(F.split(c, "[ \\t\\n\\r]+"), "").alias(c) for c in ("hyp", "ref")])


def turn_characters(rows: DataFrame) -> DataFrame:
    return rows.select("id", *[F.regexp_replace(c, r"\s+", "").alias(c) for c in ("hyp", "ref")])


TURN_PAIRS = """k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rank FROM conversations WHERE role IN ('assistant', 'user')),
  q AS (SELECT struct_pack(c := a.conv_id, k := a.rank) AS conv_id, a.text AS hyp, b.text AS ref FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.rank = b.rank WHERE a.role = 'assistant' AND b.role = 'user' AND a.text IS NOT NULL AND b.text IS NOT NULL)"""


def _ngram_sql(tokens: str, orders: int, joiner: str) -> str:
    return f"""WITH {TURN_PAIRS}, t AS (SELECT conv_id, 'h' AS side, {tokens.format('hyp')} AS w FROM q UNION ALL SELECT conv_id, 'r', {tokens.format('ref')} FROM q), o AS (SELECT CAST(range AS INTEGER) AS n FROM range(1, {orders + 1})),
  g AS (SELECT conv_id, side, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + n - 1), '{joiner}'))) AS g FROM t, o),
  c AS (SELECT conv_id, n, g, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM g GROUP BY conv_id, n, g)
  SELECT n, CAST(sum(least(h, r)) AS BIGINT) AS matches, CAST(sum(h) AS BIGINT) AS hyp_total, CAST(sum(r) AS BIGINT) AS ref_total FROM c GROUP BY n"""


@query(_ngram_sql("list_filter(string_split_regex({}, '[ \\t\\n\\r]+'), lambda x: x <> '')", 4, " "))
def bleu_counts(spark, d):
    return textmetrics.ngram_counts(turn_words(turn_pairs(spark, d)), "id", "hyp", "ref", 4)


@query(_ngram_sql("string_split(regexp_replace({}, '[ \\t\\n\\r]+', '', 'g'), '')", 6, ""))
def chrf_counts(spark, d):
    return textmetrics.ngram_counts(turn_characters(turn_pairs(spark, d)), "id", "hyp", "ref", 6)


def _chinese_sql() -> str:
    """textmetrics.chinese_words() of {} in SQL; \\x{...} is what its \\u is there."""
    ranges = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", textmetrics.CHINESE)
    t = f"regexp_replace(trim(TEXT), '([{ranges}])', ' \\1 ', 'g')"
    for pattern, by in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), ("([^0-9])([.,])", r"\1 \2 "), ("([.,])([^0-9])", r" \1 \2"), ("([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')".replace("{", "{{").replace("}", "}}").replace("TEXT", "{}")


@query(_ngram_sql(_chinese_sql(), 4, " "))
def bleu_counts_chinese(spark, d):
    """The counts of bleu_counts with Chinese characters and punctuation as tokens of their own."""
    rows = turn_pairs(spark, d).select("id", *[textmetrics.chinese_words(F.col(c)).alias(c) for c in ("hyp", "ref")])
    return textmetrics.ngram_counts(rows, "id", "hyp", "ref", 4)


@query(f"""WITH b AS ({ORACLES["bleu_counts"]}), c AS ({ORACLES["chrf_counts"]}), z AS (SELECT *, sum(CASE WHEN matches = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS zeros FROM b),
  x AS (SELECT CASE WHEN sum(matches) = 0 OR count(*) FILTER (hyp_total > 0) < 4 THEN 0.0 ELSE exp(avg(CASE WHEN matches = 0 THEN ln(100.0 / (pow(2.0, zeros) * hyp_total)) ELSE ln(100.0 * matches / hyp_total) END))
    * max(CASE WHEN n = 1 THEN CASE WHEN hyp_total > ref_total THEN 1.0 ELSE exp(1 - ref_total / hyp_total) END END) END AS bleu FROM z),
  y AS (SELECT avg(matches / hyp_total) AS p, avg(matches / ref_total) AS r FROM c WHERE hyp_total > 0 AND ref_total > 0)
  SELECT round(bleu, 6) AS bleu, round(coalesce(100 * 5 * p * r / nullif(4 * p + r, 0), 0), 6) AS chrf FROM x, y""")
def corpus_scores(spark, d):
    p = turn_pairs(spark, d)
    bleu = textmetrics.ngram_counts(turn_words(p), "id", "hyp", "ref", 4).collect()
    chrf = textmetrics.ngram_counts(turn_characters(p), "id", "hyp", "ref", 6).collect()
    one = next((r for r in bleu if r["n"] == 1), None)
    score = textmetrics.corpus_bleu(bleu, one["hyp_total"], one["ref_total"]) if one else 0.0
    return spark.createDataFrame([(round(score, 6), round(textmetrics.corpus_chrf(chrf), 6))], "bleu double, chrf double")


_W = "unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


def doc_words(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.array_remove(F.split("text", "[ \\t\\n\\r]+"), "")).alias("word"))


@query(f"WITH w AS (SELECT DISTINCT {_W} AS item FROM documents) SELECT item, row_number() OVER (ORDER BY item) + 1 AS index FROM w UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1")
def vocab_index(spark, d):
    return selection.vocabulary(doc_words(table(spark, d, "documents")), "word", ("<pad>", "<unk>"))


@query(f"WITH {SPLIT}, w AS (SELECT split, {_W} AS word FROM ds), t AS (SELECT DISTINCT word FROM w WHERE split = 'train') SELECT split, count(*) AS words, count(*) FILTER (t.word IS NULL) AS unknown, round(100.0 * count(*) FILTER (t.word IS NULL) / count(*), 6) AS oov_pct FROM w LEFT JOIN t ON w.word = t.word GROUP BY split")
def oov_rate(spark, d):
    # one aggregation by word: a word's counts in each split and whether training has it
    words = doc_words(doc_split(spark, d), "split").groupBy("word", "split").agg(F.count("*").alias("n"))
    per = words.groupBy("word").agg(F.collect_list(F.struct("split", "n")).alias("x"), F.bool_or(F.col("split") == "train").alias("known"))
    flat = per.select("known", F.inline("x"))
    return flat.groupBy("split").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("unknown"), F.round(100.0 * F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("oov_pct"))


@query()
def nested_prefixes(spark, d):
    return selection.nested_subsets(doc_split(spark, d), "group_id", "source")


@query("SELECT CAST(NULL AS VARCHAR) AS group_id WHERE 1 = 0")
def nested_check(spark, d):
    s = selection.nested_subsets(doc_split(spark, d), "group_id", "source")
    part = lambda name: s.where(F.col("subset") == name)
    out = audit.not_contained(part("p010"), part("p025"), "group_id")
    return out.union(audit.not_contained(part("p025"), part("p050"), "group_id")).union(audit.not_contained(part("p050"), part("p100"), "group_id"))


#: Subsets by rules that don't nest.
CARELESS_SUBSETS = (("p010", "doc_id % 10 = 0"), ("p025", "doc_id % 4 = 0"), ("p050", "doc_id % 2 = 0"))


@query(f"WITH {SPLIT} SELECT DISTINCT group_id FROM ds x WHERE doc_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM ds y WHERE y.group_id = x.group_id AND y.doc_id % 4 = 0)")
def nested_faults(spark, d):
    """The check of nested_check over subsets that aren't nested: the second lacks groups of the first, the third none of the second."""
    rows = doc_split(spark, d)
    a, b, c = (rows.where(rule) for _, rule in CARELESS_SUBSETS)
    return audit.not_contained(a, b, "group_id").union(audit.not_contained(b, c, "group_id"))


@query(f"WITH {SPLIT}, w AS (SELECT split, {_W} AS word FROM ds) SELECT DISTINCT word FROM w WHERE split = 'test' AND word NOT IN (SELECT word FROM w WHERE split = 'train')")
def words_not_contained(spark, d):
    words = doc_words(doc_split(spark, d), "split")
    return audit.not_contained(words.where("split = 'test'"), words.where("split = 'train'"), "word")


@query()
def set_cover_sample(spark, d):
    wrong = judged(spark, d).where("NOT (strict AND other)")
    kind = scoring.change(F.col("strict"), F.col("other"))
    f = F.explode(F.array(F.concat(F.lit("distance:"), "bucket"), F.concat(F.lit("change:"), kind), F.concat(F.lit("relation:"), "deprel"))).alias("feature")
    weight = wrong.groupBy("sid").agg(F.count("*").alias("errors"))
    return selection.covering_sample(wrong.select("sid", f).distinct().join(weight, "sid"), "sid", "feature", "errors")


# ---- CoNLL-U ---------------------------------------------------------------------------------------------


def conllu_blocks(spark: SparkSession, d: str, ranged: bool = False) -> DataFrame:
    s = surrogate.sentences(spark, d, columns=("form", "head", "deprel", "upos"), ranged=ranged)
    comments = [F.concat(F.lit("# sent_id = "), F.col("sid").cast("string")), F.concat(F.lit("# parallel_id = p/"), F.col("sid").cast("string"))]
    # the arrays are taken out of the words once a sentence, not for every word
    arrays = F.struct(*[F.col(f"words.{n}").alias(n) for n in ("form", "head", "deprel", "upos")])
    text = surrogate.let(arrays, lambda a: conllu.from_arrays(a["form"], a["head"], a["deprel"], comments, upos=a["upos"]))
    return s.select(F.col("sid").alias("position"), text.alias("block"))


@query("SELECT l_orderkey AS sid, count(*) AS words, 'p/' || CAST(l_orderkey AS VARCHAR) AS parallel_id FROM lineitem GROUP BY l_orderkey")
def conllu_roundtrip(spark, d):
    s = conllu.sentences(conllu_blocks(spark, d), "strict", normalize=False)
    return s.select(F.col("sent_id").cast("bigint").alias("sid"), F.size("words").cast("bigint").alias("words"), "parallel_id")


@query(f"""WITH {A}, l AS (SELECT sid, string_agg(concat_ws(chr(9), CAST(tid AS VARCHAR), form, '_', upos, '_', '_', CAST(head AS VARCHAR), deprel, '_', '_'), chr(10) ORDER BY tid) AS rows FROM a GROUP BY sid)
  SELECT row_number() OVER (ORDER BY sid) AS place, sha256('# sent_id = ' || CAST(sid AS VARCHAR) || chr(10) || '# parallel_id = p/' || CAST(sid AS VARCHAR) || chr(10) || rows || chr(10)) AS block_sha256 FROM l""")
def conllu_ranges(spark, d):
    """All blocks written in order as text, read again by byte ranges and numbered through."""
    path = session.folder(spark, "conllu")
    conllu.write_blocks(conllu_blocks(spark, d, ranged=True), path)
    rows = conllu.number_files(conllu.read_blocks(spark, path, whole=False))
    return rows.select("place", F.sha2("block", 256).alias("block_sha256"))


@query(f"WITH {A} SELECT sid, tid, form, upos, head, deprel FROM a")
def conllu_table_function(spark, d):
    """The blocks' words by the SQL table function, laterally."""
    conllu.register_rows(spark)
    conllu_blocks(spark, d).createOrReplaceTempView("dendra_blocks")
    return spark.sql("SELECT b.position AS sid, CAST(w.id AS INT) AS tid, w.form, w.upos, CAST(w.head AS INT) AS head, w.deprel FROM dendra_blocks b, LATERAL conllu_rows(b.block, 'strict') w WHERE w.kind = 'word'")


@query(f"WITH {A} SELECT deprel, pred_deprel AS substituted, count(*) AS n FROM a GROUP BY deprel, pred_deprel")
def substitute_columns(spark, d):
    gold = arcs_a(spark, d).select("sid", "tid", "form", "deprel", F.col("deprel").alias("substituted"))
    pred = arcs_a(spark, d).select("sid", "tid", "form", F.col("pred_deprel").alias("substituted"))
    return conllu.substitute(gold, pred, ["sid", "tid"], ["substituted"]).groupBy("deprel", "substituted").agg(F.count("*").alias("n"))
