"""Running bests, folds and percentiles over long tables, and the table function."""

import hashlib
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dendra.operators import audit, distributions, grouping, reports, selection, similarity
from dendra.sources import conllu


def plain_best(rows):
    out, best, at = [], None, None
    for step, score in rows:
        if score is not None and (best is None or score > best):
            best, at = score, step
        out.append((step, best, at))
    return out


def test_running_best(spark):
    rng = random.Random(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges cut the runs
    rows = [(r, s, rng.choice([None, 1.0, 2.0, 3.0, rng.random() * 4])) for r in ("a", "b", "c", None) for s in rng.sample(range(-50, 400), 90)]
    got = selection.running_best(spark.createDataFrame(rows, "run string, step int, score double"), "step", "score", "run").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for run in ("a", "b", "c", None):
        want = plain_best(sorted((s, x) for r, s, x in rows if r == run))
        assert sorted(((r.step, r.best, r.best_step) for r in got if r.run == run)) == want


def test_one_run_of_a_million_steps(spark):
    """Several tasks work on one run; its best follows from all ranges before."""
    history = spark.range(1_000_000).select(F.col("id").alias("step"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("score"))
    rows = selection.running_best(history, "step", "score")
    score = (np.arange(1_000_000) * 7919) % 1_000_003
    best = np.maximum.accumulate(score)
    sums = rows.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("best").alias("b"), F.sum("best_step").alias("s")).agg(F.sum("b"), F.sum("s"), F.count("*")).first()
    first = np.maximum.accumulate(np.where(np.r_[True, best[1:] > best[:-1]], np.arange(1_000_000), 0))
    assert (sums[0], sums[1]) == (float(best.sum()), int(first.sum())) and sums[2] > 1


@pytest.mark.parametrize("threshold, patience", [(0.0, 1), (0.5, 3), (0.1, 100)])
def test_threshold_fold(spark, threshold, patience):
    rng = random.Random(9)
    rows = [(r, s, rng.choice([None, rng.random() * 3])) for r in ("a", "b", None) for s in range(60)]
    df = spark.createDataFrame(rows, "run string, step int, score double").repartition(5)
    got = {r.run: tuple(r)[1:] for r in selection.early_stop_folded(df, "step", "score", "run", threshold, patience).collect()}
    for run in ("a", "b", None):
        epochs = best_epoch = stale = 0
        best = None
        for x in [x for r, _, x in rows if r == run]:
            if stale < patience:
                epochs += 1
                better = x is not None and (best is None or x > best + threshold)
                best, best_epoch, stale = (x, epochs, 0) if better else (best, best_epoch, stale + 1)
        assert got[run] == (epochs, best, best_epoch)


def test_group_ids_are_streamed(spark):
    rows = [("x", 3, "c"), ("x", 1, "a"), ("x", 1, "b"), ("y", 2, None), (None, 5, "q"), ("é", 1, "ü")]
    df = spark.createDataFrame(rows, "k string, o int, m string").repartition(3)
    got = {r.group_key: (r.group_id, r.size, r.first) for r in grouping.duplicate_groups(df, F.col("k"), "m", "o").collect()}
    name = lambda text: "grp-" + hashlib.sha256(text.encode()).hexdigest()[:16]
    assert got == {"x": (name("a\nb\nc"), 3, 1), "y": (name(""), 1, 2), None: (name("q"), 1, 5), "é": (name("ü"), 1, 1)}
    large = spark.range(1_000_000).select(F.lit("k").alias("k"), "id")
    r = grouping.duplicate_groups(large, F.col("k"), "id", "id").first()
    assert (r.group_id, r.size, r.first) == (name("\n".join(map(str, range(1_000_000)))), 1_000_000, 0)
    assert grouping.duplicate_groups(df.limit(0), F.col("k"), "m", "o").collect() == []


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    shares = [0.0, 0.1, 0.25, 0.5, 0.95, 0.999, 1.0]
    for values in (rng.normal(size=3000) * 1e6, np.r_[np.zeros(500), 1e-300, 1e300, -1e300, rng.random(7)], np.array([4.0]), rng.integers(0, 5, 999).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        assert np.allclose(distributions.percentiles(df, "v", shares), np.quantile(values, shares), rtol=1e-12, atol=0)
    assert distributions.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_signature_of_other_letters():
    assert reports.experiment_signature({"name": "é漢", "n": 1}) == hashlib.sha256(b'{"n": 1, "name": "\\u00e9\\u6f22"}').hexdigest()


def test_parallel_join_fails_for_a_faulty_pair(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert audit.parallel_join(a, a, "k").count() == 2
    for other in (a.where("k = 1"), a.union(a.limit(1)), a.union(spark.createDataFrame([(3, "z")], a.schema))):
        for x, y in ((a, other), (other, a)):
            with pytest.raises(Exception):
                audit.parallel_join(x, y, "k").collect()


def test_table_function(spark):
    conllu.register_rows(spark)
    block = "# a = b\n1-2\tab\t_\t_\t_\t_\t_\t_\t_\t_\n1\ta\t_\tX\t_\t_\t0\troot\t_\t_\n1.1\te\t_\t_\t_\t_\t_\t_\t_\t_\n"
    spark.createDataFrame([(1, block), (2, block + "broken\tline\n"), (3, None), (4, "# only = comments")], "i int, block string").createOrReplaceTempView("b")
    got = spark.sql("SELECT i, kind, id, form, w.row FROM b, LATERAL conllu_rows(block, 'skip') w").collect()
    assert sorted(map(tuple, got)) == [(i, k, x, f, n) for i in (1, 2) for k, x, f, n in (("empty", "1.1", "e", 4), ("multiword", "1-2", "ab", 2), ("word", "1", "a", 3))]
    assert spark.sql("SELECT w.* FROM (SELECT * FROM b WHERE i = 1) x, LATERAL conllu_rows(block, 'strict') w").count() == 3
    for i, what in ((2, "line 5 has 2 columns"), (4, "without rows")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT w.* FROM (SELECT * FROM b WHERE i = {i}) x, LATERAL conllu_rows(block, 'strict') w").collect()
    with pytest.raises(Exception, match="strict"):
        spark.sql("SELECT * FROM b, LATERAL conllu_rows(block, 'other')").collect()


@pytest.mark.parametrize("block", [1_000, 4])
def test_near_pairs_in_blocks(spark, monkeypatch, block):
    """Copies, texts of neighbouring bands, ids whose order isn't that of the blocks; the numbers of pairs that each test leaves."""
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))
    texts = [None, "", "a", "a", "ab", "漢字仮名交", "漢字仮名文", base, base]
    for _ in range(45):
        t = list(base[: rng.randrange(20, 61)])
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz漢")
        texts.append("".join(t))
    texts += texts[9:15]
    rows = [(f"{i:03}", t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i string, t string, id string").repartition(3)
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", block)
    want = set()
    for a, x, _ in rows:
        for b, y, _ in rows:
            if a < b and x and y and x != y and (r := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.85:
                want.add((a, b, round(r, 6)))
    assert len(want) > 20
    got = similarity.near_pairs(df, "i", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    seen = similarity.near_candidates(df, "i", "t").first()
    distinct = len({t for t in texts if t})
    assert distinct * (distinct - 1) // 2 >= seen.met >= seen.by_length >= seen.by_letters >= seen.by_subsequence > 0
    assert similarity.near_pairs(df.limit(0), "i", "t").collect() == []


def test_near_pairs_are_ruled_out_together(monkeypatch):
    """Unrelated texts of like letters never come to the steps that take one pair at a time; near ones do, with their ratio."""
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(240, 280))) for _ in range(60)]
    for i in range(6):
        t = texts[i].split(" ")
        for _ in range(rng.randrange(5, 20)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    calls = []
    blocks = similarity.blocks
    monkeypatch.setattr(similarity, "blocks", lambda *x: calls.append(1) or blocks(*x))
    for index_pairs in (0, 12, 10**9):
        calls.clear()
        monkeypatch.setattr(similarity, "INDEX_PAIRS", index_pairs, raising=False)
        sides = [i % 2 for i in range(len(texts))]
        for two in (False, True):
            t = pa.table({"id": range(len(texts)), "t": texts, "side": sides if two else [0] * len(texts), "two": [two] * len(texts)})
            *found, (*_, seen) = similarity._compare(0.85)(t)
            want = {}
            for j in range(len(texts)):
                for i in range(j) if not two else range(1 - j % 2, len(texts), 2):
                    if (abs(i - j) == 60) and (not two or j % 2):
                        x, y = texts[i], texts[j]
                        want[i, j] = tuple(SequenceMatcher(None, *p, autojunk=False).ratio() for p in ((x, y), (y, x)))
            assert {(a, b): (f, g) for a, b, f, g, _ in found} == {k: v for k, v in want.items() if max(v) >= 0.85}
            assert len(found) == (0 if two else 6) and seen[2] > 900
        assert len(calls) <= 2 * (6 + 3)


def test_common_strings_of_many_pairs():
    """joined() gives what shared() gives, and reached() what blocks() gives, with ties, repeats and texts without strings."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 70))) for _ in range(30)] + ["", "ab漢字ab漢字", "ab" * 40, "漢字ab" * 5]
    for k in (4, 5, 7):
        strings = similarity.Strings(texts, k)
        i, j = np.nonzero(np.array([[rng.random() < 0.5 for _ in texts] for _ in texts]))
        one, many = {}, {}
        for own in np.unique(i):
            for part, known, pair, *v in strings.shared(own, j[i == own]):
                one |= {(own, other): (known[p], {tuple(map(int, x)) for x, q in zip(zip(*v, strict=True), pair, strict=True) if q == p}) for p, other in enumerate(part)}
        for part, known, pair, *v in strings.joined(i, j):
            assert (np.diff(pair) >= 0).all()
            many |= {(i[n], j[n]): (known[p], {tuple(map(int, x)) for x, q in zip(zip(*v, strict=True), pair, strict=True) if q == p}) for p, n in enumerate(part)}
            for p in np.flatnonzero(known):
                a, b = len(texts[i[part[p]]]), len(texts[j[part[p]]])
                found = [tuple(map(int, x)) for x, q in zip(zip(*v, strict=True), pair, strict=True) if q == p]
                for least in {1, min(a, b) // 2, min(a, b)}:
                    got = similarity.reached((np.zeros(len(found), np.int64), *np.array(found, np.int64).reshape(-1, 3).T), np.array([a]), np.array([b]), np.array([least]), k)[0]
                    want = similarity.blocks(found, a, b, least, k)
                    assert got == (-1 if want is None else int(want[0] >= least))
        assert {x for x, (known, _) in one.items() if known} == {x for x, (known, _) in many.items() if known}
        assert all(many[x] == y for x, y in one.items() if y[0]) and len(one) == len(many) == len(i)


def test_near_pairs_by_common_strings():
    """Texts of like letters whose common strings lie in other places are ruled out without a subsequence; those that are left give the ratio of difflib."""
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(140, 160))) for _ in range(30)]
    for i in range(12):
        t = texts[i].split(" ")
        for _ in range(rng.randrange(1, 25)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["ab" * 400, "ab" * 390 + "c", "é漢" * 300]
    t = pa.table({"id": range(len(texts)), "t": texts, "side": [0] * len(texts), "two": [False] * len(texts)})
    *found, (*_, seen) = similarity._compare(0.85)(t)
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {(i, j): (ratio(texts[i], texts[j]), ratio(texts[j], texts[i])) for j in range(len(texts)) for i in range(j)}
    want = {k: v for k, v in want.items() if max(v) >= 0.85}
    assert {(a, b) for a, b, *_ in found} == set(want) and len(want) >= 8
    assert all(x >= 0.85 and want[a, b][way] == x or want[a, b][way] < 0.85 for a, b, *ways, _ in found for way, x in enumerate(ways))
    assert seen[2] > 200 and seen[3] <= len(want) + 3


def test_longest_match_searched_and_by_automaton(monkeypatch):
    rng = random.Random(9)
    for n in range(200):
        monkeypatch.setattr(similarity, "SEARCHED", 0 if n % 2 else 1 << 20)
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in "ab")
        m = SequenceMatcher(None, a, b, autojunk=False)
        if a and b:
            assert similarity.longest_match(a, b) == tuple(m.find_longest_match())
        assert similarity.matched(a, b) == sum(x.size for x in m.get_matching_blocks())
