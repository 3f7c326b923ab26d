"""What keeps the work in proportion to the input: exchanges, scans and tasks of the queries that grew faster."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.operators import grouping, scoring, selection, textmetrics, trees
from dendra.plans import registry, surrogate
from dendra.sources import conllu, ranges

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_ngrams_are_counted_in_their_segment(spark, monkeypatch, most):
    """Strings by code points and arrays of tokens; n-grams are neither exploded nor exchanged."""
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("ab漢😀") for _ in range(rng.randrange(30)))
    rows = [(i, text(), text()) for i in range(40)] + [(40, None, "ab"), (41, "", "")]
    want = Counter()
    for _, h, r in rows:
        for n in range(1, 4):
            a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h or "", r or ""))
            want[n, "m"] += sum((a & b).values())
            want[n, "h"] += sum(a.values())
            want[n, "r"] += sum(b.values())
    monkeypatch.setattr(textmetrics, "TOKENS_AT_ONCE", most)
    strings = spark.createDataFrame(rows, "i int, h string, r string")
    arrays = strings.select("i", *[F.split(c, "").alias(c) for c in "hr"]).select("i", *[F.array_remove(c, "").alias(c) for c in "hr"])
    for df in (strings, arrays):
        counts = textmetrics.ngram_counts(df, "i", "h", "r", 3)
        assert {(r.n, r.matches, r.hyp_total, r.ref_total) for r in counts.collect()} == {(n, want[n, "m"], want[n, "h"], want[n, "r"]) for n in range(1, 4)}
        assert "Generate" not in plan(counts)


def test_turns_are_exchanged_once(spark):
    assert plan(registry.turn_pairs(spark, SMALL)).count("Exchange hashpartitioning") == 1


def test_the_rows_published_again_are_dealt_by_their_number(spark, monkeypatch):
    seen = []
    real = registry.publish.publish_rows
    monkeypatch.setattr(registry.publish, "publish_rows", lambda df, path: seen.append(df) or real(df, path))
    assert {r.outcome for r in registry.published_documents(spark, SMALL).collect()} == {"written", "unchanged", "refused"}
    assert "REPARTITION_BY_NUM" not in plan(seen[1])


def test_members_are_read_once_and_those_without_a_key_listed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b"), (5, None)], "i int, g string")
    found = grouping.group_members(rows, "g", "i")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1, 1), ("a", 2, 3), (None, 1, 2), (None, 2, 5)], key=str)
    assert plan(registry.duplicate_members(spark, SMALL)).count("FileScan") == 1


@pytest.mark.parametrize("side", "ab")
def test_words_are_exchanged_once(spark, side):
    for df in (surrogate.words(spark, SMALL, side), surrogate.sentences(spark, SMALL, side)):
        assert plan(df).count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan(df)


def test_walks_of_many_trees_at_once():
    rng = random.Random(9)
    sents = []
    for n in [1, 2, 3, 60, *[rng.randrange(1, 12) for _ in range(200)]]:
        order = rng.sample(range(1, n + 1), n)
        heads = [0] * n
        for i in range(1, n):
            heads[order[i] - 1] = order[rng.randrange(i)]
        sents.append(heads)
    depth, pre, post = trees.walks(np.array(sum(sents, [])), np.array([len(x) for x in sents]))
    at = 0
    for x in sents:
        mine = slice(at, at := at + len(x))
        assert depth[mine].tolist() == trees.depths(x)
        assert (np.argsort(pre[mine]) + 1).tolist() == trees.preorder(x) and (np.argsort(post[mine]) + 1).tolist() == trees.postorder(x)
    for bad in ([2, 1, 0], [0, 0], [5, 0], [-1, 0], [2, 1]):
        with pytest.raises(ValueError):
            trees.walks(np.array([0, *bad]), np.array([1, len(bad)]))


def test_walk_columns_keep_nulls(spark):
    df = spark.createDataFrame([(1, [2, 0]), (2, None), (3, [0, 1, 1])], "i int, h array<int>").coalesce(1)
    got = df.select("i", trees.preorder_col("h"), trees.postorder_col("h"), trees.depths_col("h")).collect()
    assert sorted(map(tuple, got)) == [(1, [2, 1], [1, 2], [2, 1]), (2, None, None, None), (3, [1, 2, 3], [2, 3, 1], [1, 2, 2])]


def test_hashes_of_all_vectors_come_in_one_job(spark):
    """Groups of many count vectors that tie: jobs don't grow with the number of vectors."""
    rows = [(f"g{i}", f"s{j}") for i in range(60) for j in range(i % 12 + 1)]
    df = spark.createDataFrame(rows, "g string, s string")
    group = "nested-hashes"
    spark.sparkContext.setJobGroup(group, "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    selection.nested_subsets(df, "g", "s")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) - before
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= 20


def test_blocks_are_written_with_one_exchange(spark):
    """Orders are exchanged by ranges before their texts are made, so the text isn't made twice for the bounds of a range sort."""
    text = conllu.ordered_text(registry.conllu_blocks(spark, SMALL, ranged=True))
    assert plan(text).count("Exchange rangepartitioning") == plan(text).count("Exchange") == 1
    want = registry.conllu_blocks(spark, SMALL).collect()
    assert [(r.position, r.value) for r in text.collect()] == sorted((r.position, r.block + "\n") for r in want)


@pytest.mark.parametrize("most", [100_000, 0])
def test_blocks_are_numbered_where_they_lie(spark, monkeypatch, most):
    """The numbers of the files before are broadcast, so the blocks of a large file don't meet in one task."""
    monkeypatch.setattr(conllu, "MOST_FILES", most)
    blocks = spark.createDataFrame([(p, i, f"{p}{i}") for p in "ba" for i in range(1, 4)], "path string, position bigint, block string")
    with_numbers = conllu.number_files(blocks)
    assert sorted(map(tuple, with_numbers.collect())) == [(1, "a1"), (2, "a2"), (3, "a3"), (4, "b1"), (5, "b2"), (6, "b3")]
    assert most == 0 or "BroadcastHashJoin" in plan(with_numbers) and "hashpartitioning" not in plan(with_numbers)


def test_lines_are_cut_a_batch_at_a_time(monkeypatch):
    """Batches with plain line ends aren't gone through line by line; others give the same blocks."""
    import pyarrow as pa

    calls = []
    real = ranges.Range._lines
    monkeypatch.setattr(ranges.Range, "_lines", lambda self, lines: calls.append(lines) or real(self, lines))
    for strict in (True, False):
        for blank in ("", " \t") if strict else ("",):
            calls.clear()
            now = ranges.Range(1, 0, strict)
            now.add(pa.array([x.encode() for x in ("", "", "", "a", "b", blank, "c", "", "", "d", "e", "", "f")]))
            assert now.done == (["c\n", "d\ne\n"] if strict else ["c", "\nd\ne"]) and (now.head, now.lead, now.gap) == ("a\nb\n", 3, 0) and now.current == ["f\n"]
            assert len(calls) == (6 if blank else 4)


def test_sources_are_aligned_with_one_exchange(spark):
    found = plan(registry.aligned_tokens(spark, SMALL))
    assert found.count("Exchange") == found.count("FileScan") == 1 and "Join" not in found


def test_sentences_that_are_not_aligned_fail(spark):
    schema = "sid int, source string, words array<struct<tid int, form string, h int>>"
    good = [(1, "gold", [(1, "a", 0), (2, "b", 1)]), (1, "p", [(1, "a", 2), (2, "b", 0)]), (2, "gold", [(1, "c", 0)]), (2, "p", [(1, "c", 0)]), (3, "gold", []), (3, "p", [])]
    align = lambda rows: scoring.align_sentences(spark.createDataFrame(rows, schema), "gold", ("p",))
    assert sorted((r.sid, [w.h for w in r.words], [w.h for w in r.words_p]) for r in align(good).collect()) == [(1, [0, 1], [2, 0]), (2, [0], [0]), (3, [], [])]
    one, p, *rest = good
    bad = [
        [one, *rest], [p, *rest], [*good, p], [*good, one], [*good, (1, "q", p[2])], [*good, (1, None, p[2])], [one, (1, "p", None), *rest], [one, (1, "p", p[2][:1]), *rest], [one, (1, "p", [*p[2], (3, "c", 0)]), *rest],
        [one, (1, "p", [(1, "a", 2), (2, "x", 0)]), *rest], [one, (1, "p", [(1, "a", 2), (3, "b", 0)]), *rest], [(1, s, [(1, None, 0)]) for s in ("gold", "p")], [(1, s, [(None, "a", 0)]) for s in ("gold", "p")], [(None, s, [(1, "a", 0)]) for s in ("gold", "p")],
    ]
    for rows in bad:
        # whether the words are read, counted or filtered
        for read in (lambda r: r.select("sid", F.inline("words")), lambda r: r.agg(F.count("*")), lambda r: r.where("words IS NOT NULL").select("sid")):
            with pytest.raises(Exception, match="aligned"):
                read(align(rows)).collect()
