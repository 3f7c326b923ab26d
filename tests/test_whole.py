"""Queries do the whole job: rows that earlier versions left out."""

import itertools
import random

from pyspark.sql import functions as F

from dendra.operators import similarity, trees
from dendra.plans import registry

SF = "/root/testdata/sf0.001"


def test_mst_decodes_every_order(spark, tmp_path):
    sizes = {sid: 1 + sid % 5 for sid in range(1, 21)}
    spark.createDataFrame([(sid,) for sid, n in sizes.items() for _ in range(n)], "l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for sid, n in sizes.items():
        s = lambda w, h: (sid * 7 + w * 13 + h * 29 + w * h * 17) % 101  # noqa: B023, E731
        trees_of = (hs for hs in itertools.product(range(n + 1), repeat=n) if sum(h == 0 for h in hs) == 1 and all(h != w for w, h in enumerate(hs, 1)) and not trees.cycles(list(hs)))
        want[sid] = max(sum(s(w, h) for w, h in enumerate(hs, 1)) for hs in trees_of)
    assert {r.sid: r.score for r in registry.QUERIES["mst_decode"](spark, str(tmp_path)).collect()} == want
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.count_distinct("l_orderkey")).first()[0]
    assert registry.QUERIES["mst_decode"](spark, SF).count() == orders


def test_matched_equals_difflib():
    from difflib import SequenceMatcher

    random.seed(4)
    for _ in range(400):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(1, 60))) for _ in "ab")
        m = SequenceMatcher(None, a, b, autojunk=False)
        assert similarity.matched(a, b) == sum(x.size for x in m.get_matching_blocks())
        assert similarity.longest_match(a, b) == tuple(m.find_longest_match())
        assert similarity.may_match(a, b, similarity.matched(a, b)) and not similarity.may_match(a, b, min(len(a), len(b)) + 1)


def test_near_duplicates_runs_over_documents(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(1, text), (2, text.replace("fox", "cat")), (3, text), (4, "x" + text[9:]), (5, "nothing like it"), (6, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b) for r in registry.QUERIES["near_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4)}


def test_every_turn_is_paired(spark, tmp_path):
    said = [("user", "a b c"), ("assistant", "a b x"), ("system", "s"), ("user", "d"), ("user", "e f"), ("assistant", "d e")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(said)] + [(2, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r.id.k, r.hyp, r.ref) for r in registry.turn_pairs(spark, str(tmp_path)).collect()) == [(0, "a b x", "a b c"), (1, "d e", "d")]
    first = next(r for r in registry.QUERIES["bleu_counts"](spark, str(tmp_path)).collect() if r.n == 1)
    assert (first.matches, first.hyp_total, first.ref_total) == (3, 5, 4)


def test_split_keeps_null_texts(spark, tmp_path):
    rows = [(1, "a b", "en", "s"), (2, None, "en", "s"), (3, None, "de", "t"), (4, "c", "de", "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.doc_split(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4]
    assert len({(r.group_id, r.split) for r in got if r.text is None}) == 1
    assert sum(r.n for r in registry.QUERIES["split_stats"](spark, str(tmp_path)).collect() if r.dimension == "all") == 4
