"""Parser scores over aligned arcs: one row per word with gold and predicted head and label.

Scores are plain averages of booleans, so every report is one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.functions import expr


def align(gold: DataFrame, systems: dict[str, DataFrame], key: tuple[str, ...] = ("sentence_index", "token_id"), form: str = "form") -> DataFrame:
    """Gold rows joined with each system's by place; a missing row or a different form fails the query. System columns get the suffix _name."""
    out = gold
    for name, rows in systems.items():
        side = rows.select(*key, *[F.col(c).alias(f"{c}_{name}") for c in rows.columns if c not in key])
        out = out.join(side, list(key), "full")
        ok = F.col(form).eqNullSafe(F.col(f"{form}_{name}")) & F.col(form).isNotNull()
        out = out.where(F.when(ok, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit(f"{name} isn't aligned at"), *[F.col(k).cast("string") for k in key]))).cast("boolean"))
    return out


def align_sentences(rows: DataFrame, gold: str, systems: tuple[str, ...], sid: str = "sid", source: str = "source", token: str = "tid", form: str = "form", words: str = "words") -> DataFrame:
    """align() for the sentences of all sources in one table (sid, source, words), words in order as structs of token, form and others:
    (sid, words, words_name ...), the gold sentence and each system's. A sentence or word too few or too many, and a different form, fail the query.

    One aggregation by sid, without an exchange where rows are dealt by it. Absent gold words are empty in the result, so that no
    test of them for null comes before the check."""
    of = lambda name: F.first(F.when(F.col(source) == name, F.col(words)), ignorenulls=True)
    names = {gold: words, **{name: f"{words}_{name}" for name in systems}}
    once = [(F.count_if(F.col(source) == name) == 1).alias(f"__{name}") for name in names]
    known = F.bool_and(F.coalesce(F.col(source).isin(*names), F.lit(False))).alias("__known")
    both = rows.groupBy(sid).agg(*[of(name).alias(c) for name, c in names.items()], *once, known)
    ids, forms = F.col(f"{words}.{token}"), F.col(f"{words}.{form}")
    whole = F.col(sid).isNotNull() & F.col("__known") & F.col(f"__{gold}") & F.forall(ids, lambda x: x.isNotNull()) & F.forall(forms, lambda x: x.isNotNull())
    fault = F.when(whole, F.lit(None)).otherwise(gold)
    for name in reversed(systems):
        ok = F.col(f"__{name}") & (ids == F.col(f"{names[name]}.{token}")) & (forms == F.col(f"{names[name]}.{form}"))
        fault = F.when(ok, fault).otherwise(name)
    message = F.concat_ws(" ", fault, F.lit("isn't aligned at"), F.coalesce(F.col(sid).cast("string"), F.lit("null")))
    checked = both.where(F.when(fault.isNull(), True).otherwise(F.raise_error(message)).cast("boolean"))
    return checked.select(sid, *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in names.values()])


def judged(arcs: DataFrame, head: str = "head", label: str = "deprel", pred_head: str = "pred_head", pred_label: str = "pred_deprel") -> DataFrame:
    """Adds uas, las (base labels, as the shared-task score), strict (full labels) and label_ok as booleans."""
    right = F.col(head) == F.col(pred_head)
    return arcs.select("*", right.alias("uas"), (right & (expr.base_relation(F.col(label)) == expr.base_relation(F.col(pred_label)))).alias("las"), (right & (F.col(label) == F.col(pred_label))).alias("strict"), (F.col(label) == F.col(pred_label)).alias("label_ok"))


def share(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(100 * F.avg(c.cast("double")), 6)


def overall(rows: DataFrame, punct: str | None = None) -> DataFrame:
    """Words, UAS, LAS and strict LAS in percent; with a punctuation tag, strict LAS without it as well."""
    rest = F.when(F.col("upos") != punct, F.col("strict").cast("double")) if punct else F.lit(None).cast("double")
    return rows.agg(F.count("*").alias("words"), share("uas").alias("uas"), share("las").alias("las"), share("strict").alias("strict_las"), F.round(100 * F.avg(rest), 6).alias("strict_las_no_punct"))


def grouped(rows: DataFrame, by: str) -> DataFrame:
    """Per value (null is one): words, UAS, LAS, strict LAS in percent."""
    return rows.groupBy(by).agg(F.count("*").alias("words"), share("uas").alias("uas"), share("las").alias("las"), share("strict").alias("strict_las"))


def confusion(rows: DataFrame, label: str = "deprel", pred: str = "pred_deprel") -> DataFrame:
    """Right head, wrong full label: counts by gold and predicted label."""
    return rows.where(F.col("uas") & ~F.col("label_ok")).groupBy(F.col(label).alias("gold_deprel"), F.col(pred).alias("pred_deprel")).agg(F.count("*").alias("n"))


def by_sentence(rows: DataFrame, sid: str = "sid") -> DataFrame:
    """Per sentence: words, errors and strict LAS; order by las, words, id for the worst first."""
    return rows.groupBy(sid).agg(F.count("*").alias("words"), F.count_if(~F.col("strict")).alias("errors"), share("strict").alias("las"))


def worst_sentences(rows: DataFrame, top: int, sid: str = "sid") -> DataFrame:
    return by_sentence(rows, sid).orderBy("las", "words", sid).limit(top)


def tree_metrics(rows: DataFrame, sid: str = "sid") -> DataFrame:
    """UAS, strict LAS, label accuracy over words; exact trees and right roots over sentences."""
    per = rows.groupBy(sid).agg(F.count("*").alias("n"), F.count_if("uas").alias("u"), F.count_if("strict").alias("s"), F.count_if("label_ok").alias("l"), F.bool_and(~(F.col("head") == 0) | (F.col("pred_head") == 0)).alias("root"))
    pct = lambda a, b: F.round(100 * F.try_divide(a, b), 6)
    return per.agg(F.count("*").alias("sentences"), pct(F.sum("u"), F.sum("n")).alias("uas"), pct(F.sum("s"), F.sum("n")).alias("las"), pct(F.sum("l"), F.sum("n")).alias("label_accuracy"), pct(F.count_if(F.col("s") == F.col("n")), F.count("*")).alias("exact_trees"), pct(F.count_if("root"), F.count("*")).alias("root_accuracy"))


def relation_prf(rows: DataFrame, label: str = "deprel", pred: str = "pred_deprel") -> DataFrame:
    """Per label: gold, predicted and right arcs, precision, recall and F1 in percent (0 where undefined); both sides in one aggregation."""
    both = F.explode(F.array(F.struct(F.col(label).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.col("strict").cast("int").alias("t")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")
    g = rows.select("strict", label, pred).select(both).groupBy("x.label").agg(F.sum("x.g").alias("gold"), F.sum("x.p").alias("predicted"), F.sum("x.t").alias("tp"))
    p, r = F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("gold")), F.lit(0.0))
    return g.select("label", "gold", "predicted", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def change(before: Column, after: Column) -> Column:
    return F.when(before & after, "stable_correct").when(after, "fixed").when(before, "regressed").otherwise("persistent_error")


def compare(rows: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """Two systems' shares by a key, their difference, and how many words changed which way."""
    kind = change(F.col(before), F.col(after))
    a, b = 100 * F.avg(F.col(before).cast("double")), 100 * F.avg(F.col(after).cast("double"))
    return rows.groupBy(by).agg(F.count("*").alias("words"), F.round(a, 6).alias("before"), F.round(b, 6).alias("after"), F.round(b - a, 6).alias("delta"), F.count_if(kind == "fixed").alias("fixed"), F.count_if(kind == "regressed").alias("regressed"))


def sentence_review(rows: DataFrame, before: str, after: str, sid: str = "sid") -> DataFrame:
    kind = change(F.col(before), F.col(after))
    return rows.groupBy(sid).agg(F.count("*").alias("words"), F.count_if(~F.col(before)).alias("errors_before"), F.count_if(~F.col(after)).alias("errors_after"), F.count_if(kind == "fixed").alias("fixed"), F.count_if(kind == "regressed").alias("regressed"), F.max("dist").cast("bigint").alias("max_distance"))
