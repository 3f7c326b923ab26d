"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets base statistics of its whole text. Rules compare ratios of them with
cutoffs. A setting switches some rules on, all at one strictness; it is used in a stratum
(a language) only if labelled good documents prove that it seldom rejects good ones: of n
good documents there, k are rejected by any of its rules, and the exact binomial
(Clopper-Pearson) upper bound of that rate must not exceed ALPHA.

Many settings are tested, so the level DELTA is shared: evenly (Bonferroni) among strata
and among the sets of rules; inside a set strictness goes up from mild, each step at the
set's full level, until the first that fails (a fixed sequence). With probability
1 - DELTA every proven setting loses at most ALPHA of its stratum's good documents,
whichever is then chosen: the one that rejects most labelled bad documents (then fewest
good ones, fewest rules, strictest). A proof takes about 150 good documents; strata
without one have no cutoffs.

Defined cases: null and empty texts have zero counts and fail the base check; a null
language is a stratum of its own; repeated labels of an id count once, the greatest;
null ids are never labelled; repeated rows give repeated results; without labels only
the base check rejects. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import GAP, save, scratch

ALPHA = 0.05
DELTA = 0.05
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words

#: rule -> (ratio of base columns, cutoffs from strict to mild)
RULES = {
    "symbols_per_word": (("n_symbols", "n_words"), (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "duplicate_lines": (("n_dup_lines", "n_lines"), (0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeated_words": (("n_repeat_words", "n_words"), (0.05, 0.1, 0.2, 0.3, 0.4)),
    "word_length": (("word_chars", "n_words"), (7.0, 8.0, 9.0, 10.0, 12.0, 16.0)),
    "capitals": (("n_capitals", "word_chars"), (0.1, 0.2, 0.3, 0.5, 0.7)),
}
SETS = [names for n in range(1, len(RULES) + 1) for names in combinations(RULES, n)]
STEPS = max(len(c) for _, c in RULES.values())


def cutoff_at(rule: str, step: int) -> int:
    """Which of the rule's cutoffs the step (1: mildest) uses; the strictest one stays once it is reached."""
    return max(0, len(RULES[rule][1]) - step)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals.

    Repeated 3-word windows are found by the hashes of all windows; only texts with equal hashes sort their windows, by the words themselves."""
    t = F.col("__t")
    out = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(*keep, F.array_remove(F.split(t, GAP, -1), "").alias("__w"), lines.alias("__l"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"))
    w, n = F.col("__w"), F.size("__w")
    upto = F.sequence(F.lit(0), n - 3)
    hashes = F.when(n >= 3, F.transform(upto, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.select(*keep, "__w", "n_symbols", "n_capitals", F.size("__l").cast("bigint").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"), hashes.alias("__h"))
    windows = F.array_sort(F.transform(upto, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), windows))
    s = F.col("__s")
    twice = F.filter(s, lambda x, j: (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return out.select(
        *keep,
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.when(s.isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"),
        "n_lines",
        "n_capitals",
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), exactly, for the smaller terms first."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def ratio(rule: str) -> Column:
    (a, b), _ = RULES[rule]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def stratum(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def choose(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff. The driver gets counts by stratum and by how many cutoffs of each rule a document is beyond: at most some ten thousand rows a stratum, however many documents."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max(label) > 0).alias("good"))
    rows = stats.where(~base_failed()).join(marked, F.col(id_col) == F.col("__id"))
    beyond = [sum((F.when(ratio(r) > c, 1).otherwise(0) for c in RULES[r][1]), F.lit(0)).alias(r) for r in RULES]
    counts = rows.select(stratum(stratum_col).alias("stratum"), "good", *beyond).groupBy("stratum", "good", *RULES).agg(F.count("*").alias("n")).collect()
    by: dict[str, list] = defaultdict(list)
    for r in counts:
        by[r.stratum].append(r)
    level = delta / max(1, len(by)) / len(SETS)
    out = {}
    for s, own in by.items():
        n = sum(r.n for r in own if r.good)
        proven = []
        for i, names in enumerate(SETS):
            for step in range(1, STEPS + 1):
                hit = [r for r in own if any(r[x] > cutoff_at(x, step) for x in names)]
                k, bad = sum(r.n for r in hit if r.good), sum(r.n for r in hit if not r.good)
                if not n or binomial_tail(k, n, alpha) > level:
                    break
                if bad:
                    proven.append((-bad, k, len(names), -step, i))
        if proven:
            *_, step, i = min(proven)
            out |= {(s, r): RULES[r][1][cutoff_at(r, -step)] for r in SETS[i]}
    return out


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label: str = "quality") -> DataFrame:
    """The statistics of every document with base_failed, kept and the names of the broken rules; texts are read once."""
    spark = docs.sparkSession
    stats = save(statistics(docs, text_col, (id_col, stratum_col)), scratch(spark, "rules"))
    cutoffs = choose(stats, labels, id_col, label, stratum_col)
    s = stratum(stratum_col)
    broken = []
    for rule in RULES:
        # one branch for each proven stratum of this rule
        hit = F.lit(False)
        for (name, r), c in cutoffs.items():
            if r == rule:
                hit = hit | ((s == name) & (ratio(rule) > c))
        broken.append(F.when(hit, F.lit(rule)))
    rows = stats.withColumn("base_failed", base_failed()).withColumn("broken_rules", F.array_compact(F.array(*broken)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))
