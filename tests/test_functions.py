"""Functions on hand-made rows: each against a plain computation or a stated result."""

import glob
import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from dendra.functions import expr
from dendra.operators import audit, distributions, grouping, reports, scoring, selection, textmetrics, trees
from dendra.sources import conllu
from dendra.streaming import treebank

BLOCK = "# sent_id = s1\n# parallel_id = p/1\n# text = ab\n1\ta\ta\tX\t_\t_\t2\tnsubj\t_\t_\n2\tb\tb\tV\t_\t_\t0\troot\t_\t_\n"

#: Published word counts of two parallel treebanks (803 sentences each) by strict label.
PUBLISHED = {
    "acl": (138, 134), "advcl": (192, 189), "advcl:coverb": (56, 0), "advmod": (1159, 935), "advmod:df": (3, 0), "amod": (102, 97), "appos": (38, 18), "aux": (305, 260), "aux:pass": (0, 2), "case": (275, 291),
    "case:loc": (52, 28), "cc": (62, 63), "ccomp": (323, 191), "clf": (174, 100), "clf:det": (84, 0), "compound": (132, 127), "compound:dir": (46, 27), "compound:ext": (15, 11), "compound:quant": (11, 0), "compound:vo": (12, 5),
    "compound:vv": (89, 63), "conj": (459, 263), "cop": (75, 72), "csubj": (11, 11), "det": (265, 207), "discourse": (272, 24), "discourse:sp": (919, 239), "dislocated": (13, 2), "flat": (19, 33), "iobj": (9, 5),
    "mark": (114, 86), "mark:adv": (8, 4), "mark:rel": (81, 84), "nmod": (193, 146), "nsubj": (721, 639), "nsubj:pass": (1, 1), "nsubj:periph": (13, 0), "nummod": (162, 129), "obj": (732, 636), "obj:periph": (20, 20),
    "obl": (140, 178), "obl:agent": (3, 1), "obl:patient": (2, 5), "obl:tmod": (108, 83), "parataxis": (114, 85), "punct": (2171, 1385), "reparandum": (131, 3), "root": (803, 803), "vocative": (45, 36), "xcomp": (129, 133),
}

#: A folder with the published dev.conllu and test.conllu, if there is one.
FOLDER = os.environ.get("TREEBANK_DIR") or next((os.path.dirname(p) for p in sorted(glob.glob("/root/*/data/processed/*/dev.conllu"))), "")


def scan(spark, text, mode="strict"):
    files = spark.createDataFrame([("f", text)], "path string, text string")
    return conllu.sentences(conllu.split_blocks(files, "path", "text", "lenient" if mode == "lenient" else "strict"), mode)


def test_published_divergences(spark):
    rows = spark.createDataFrame([("strict", k, a, b) for k, (a, b) in PUBLISHED.items()], "d string, key string, n_a bigint, n_b bigint")
    assert tuple(distributions.divergence(rows, ["d"]).first())[1:] == (0.038151, 0.143912)
    base = rows.groupBy(F.lit("base").alias("d"), expr.base_relation(F.col("key")).alias("key")).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    assert distributions.divergence(base, ["d"]).first().js_bits == 0.028698
    assert (sum(a for a, _ in PUBLISHED.values()), PUBLISHED["root"]) == (11_001, (803, 803))


@pytest.mark.skipif(not FOLDER, reason="the published files aren't here")
@pytest.mark.parametrize(
    "part, words, crossing, labels, buckets, directions, distance, lengths",
    [
        ("dev", 1557, 13, (45, 31), {"ROOT": 101, "1-2": 881, "3-5": 319, "6+": 256}, {"ROOT": 101, "head_left": 775, "head_right": 681}, 3.591346, (2, 54, 15.415842, 10.0, 6.0, 23.0, 41.0)),
        ("test", 1360, 13, (43, 31), {"ROOT": 100, "1-2": 767, "3-5": 289, "6+": 204}, {"ROOT": 100, "head_left": 667, "head_right": 593}, 3.525397, (2, 53, 13.6, 9.0, 5.75, 19.25, 38.05)),
    ],
)
def test_published_figures(spark, part, words, crossing, labels, buckets, directions, distance, lengths):
    path = f"{FOLDER}/{part}.conllu"
    n = buckets["ROOT"]
    sents = conllu.sentences(conllu.read_blocks(spark, path)).cache()
    arcs = distributions.describe(sents.select("source_key", F.inline("words")).withColumnRenamed("token_id", "tid").withColumn("head_upos", F.lit(None).cast("string")))
    assert sents.count() == n == conllu.sentences(conllu.read_blocks(spark, path, "lenient"), "lenient").count() == conllu.diagnostics(spark, path).first().sentences
    assert arcs.count() == words and tuple(arcs.agg(F.count_distinct("deprel"), F.count_distinct("base")).first()) == labels
    assert {r.bucket: r["count"] for r in arcs.groupBy("bucket").count().collect()} == buckets
    assert {r.direction: r["count"] for r in arcs.groupBy("direction").count().collect()} == directions
    assert arcs.where("head <> 0").agg(F.round(F.avg("dist"), 6)).first()[0] == distance
    assert sents.where(~trees.projective(F.col("heads"))).count() == crossing
    assert audit.tree_problems(sents, "source_key").isEmpty() and audit.id_problems(sents, "sent_id").isEmpty()
    assert tuple(distributions.length_stats(sents.select(F.size("words").alias("n"))).first()) == (n, *lengths)
    assert sents.groupBy("joined_key").count().where("count > 1").count() == {"dev": 2, "test": 1}[part]
    text = "".join(r.value for r in conllu.block_text(sents).orderBy("position").collect())
    assert text.encode() == open(path, "rb").read()
    again = conllu.sentences(conllu.split_blocks(spark.createDataFrame([("f", text)], "path string, text string"), "path", "text"))
    assert [r.block_sha256 for r in again.orderBy("position").collect()] == [r.block_sha256 for r in sents.orderBy("position").collect()]
    assert all(trees.from_actions(trees.to_actions(r.heads, ["x"] * len(r.heads)), len(r.heads))[0] == r.heads for r in sents.select("heads").collect())


def test_lenient_scan(spark):
    rows = scan(spark, BLOCK + "\n" + BLOCK.replace("1\ta", "1-2\ta") + "\n\n", "lenient").orderBy("position").collect()
    assert [(r.position, len(r.words), r.parallel_id) for r in rows] == [(1, 2, "p/1"), (2, 1, "p/1")]
    with pytest.raises(Exception, match="no parallel_id"):
        scan(spark, BLOCK.replace("# parallel_id = p/1\n", ""), "lenient").collect()


def test_diagnostics_checksums_and_sinks(spark, tmp_path):
    path = tmp_path / "x.conllu"
    path.write_bytes((BLOCK + "\n" + BLOCK.replace("\n", "\r\n") + "\r\n").encode())
    d = conllu.diagnostics(spark, str(path)).first()
    raw = path.read_bytes()
    assert (d.bytes, d.lf, d.crlf, d.sentences) == (len(raw), raw.count(b"\n"), raw.count(b"\r\n"), 2)
    assert conllu.checksums(spark, str(path)).first().sha256 == hashlib.sha256(raw).hexdigest()
    conllu.verify_sha256(str(path), hashlib.sha256(raw).hexdigest())
    with pytest.raises(ValueError):
        conllu.verify_sha256(str(path), "0" * 64)
    many = spark.createDataFrame([(i, BLOCK.replace("s1", f"s{i}")) for i in range(1, 40)], "position bigint, block string").repartition(5)
    conllu.write_blocks(many, f"{tmp_path}/blocks")
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{tmp_path}/blocks/part-*")))
    assert text == "".join(BLOCK.replace("s1", f"s{i}") + "\n" for i in range(1, 40))
    table = spark.createDataFrame([("a", 1.5), ("é", None)], "k string, v double")
    conllu.write_csv(table.coalesce(1), f"{tmp_path}/csv")
    assert open(glob.glob(f"{tmp_path}/csv/part-*")[0], encoding="utf-8").read().split() == ["k,v", "a,1.5", "é,"]
    conllu.write_jsonl(table, f"{tmp_path}/jsonl")
    lines = [json.loads(x) for p in glob.glob(f"{tmp_path}/jsonl/part-*") for x in open(p, encoding="utf-8")]
    assert sorted(lines, key=lambda r: r["k"]) == [{"k": "a", "v": 1.5}, {"k": "é", "v": None}]
    (tmp_path / "one.json").write_bytes(conllu.canonical_json({"b": 1, "a": {"c": ["é"]}}))
    assert (tmp_path / "one.json").read_text().startswith('{\n  "a"') and conllu.read_json(spark, f"{tmp_path}/one.json").first().a.c == ["é"]
    assert conllu.markdown([{"a": 1, "b": None}], "T") == "# T\n\n| a | b |\n| --- | --- |\n| 1 |  |\n" and "No rows" in conllu.markdown([], "T")


def test_archives(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    conllu.archive([str(tmp_path / "a.txt")], str(tmp_path / "z.zip"))
    conllu.safe_extract(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").read_text() == "x"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="leaves"):
        conllu.safe_extract(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_segments(spark):
    # 8 and 9 separate, 2 ends, 0 pads
    cases = [([], [], 0, 0, False), ([2], [], 0, 0, True), ([5, 6, 8, 7, 2], [[5, 6], [7]], 1, 0, True), ([5, 9, 7], [[5], [7]], 1, 0, False), ([8, 5, 8, 2], [[5]], 2, 2, True), ([5, 8, 9, 6, 2], [[5], [6]], 2, 1, True), ([0, 0], [], 0, 0, False), ([8], [], 1, 2, False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, ids array<int>")
    got = df.select("i", expr.segments(F.col("ids"), (8, 9), 2, (0, 2)).alias("x")).orderBy("i").select("x.*").collect()
    assert [(r.words, r.separators, r.empty_segments, r.ended, r.well_formed) for r in got] == [(w, s, e, end, end and e == 0) for _, w, s, e, end in cases]
    places = spark.createDataFrame([([5, 8, 6, 2, 2], 2), ([5, 2], 1), ([5, 8, 6], 2), ([5, 8, 6, 2], 3), ([2, 5, 8, 6], 2)], "ids array<int>, n int")
    assert [r[0] for r in places.select(expr.boundary_positions(F.col("ids"), 8, 2, F.col("n"))).collect()] == [[1, 3], [1], None, None, None]


def test_lookups_and_names(spark):
    df = spark.createDataFrame([(["A", "B"], 0), (["A", "B"], 2), (["A", "B"], 5), (["A", "B"], None)], "t array<string>, h int")
    assert [r[0] for r in df.select(expr.head_lookup(F.col("t"), F.col("h"))).collect()] == ["ROOT", "B", None, None]
    assert [r[0] for r in df.select(expr.head_lookup(F.col("t"), F.col("h"), "?")).collect()] == ["ROOT", "B", "?", "?"]
    ids = spark.createDataFrame([("5",), ("12",), ("99",), ("x1",), (None,)], "i string")
    assert [r[0] for r in ids.select(expr.source_name(F.col("i"), [(1, 10, "first"), (11, 20, "second")])).collect()] == ["first", "second", None, None, None]
    known = spark.createDataFrame([("a", "a"), ("b", None)], "v string, k string")
    assert [r[0] for r in known.select(expr.with_fallback(F.col("v"), F.col("k"), "dep")).collect()] == ["a", "dep"]
    one = spark.createDataFrame([(["a", "é"], "p/17", "s", 3)], "f array<string>, p string, b string, n int")
    r = one.select(expr.join_forms(F.col("f")), expr.pair_number(F.col("p")), expr.compact_json(F.col("f")), expr.source_key("d", "v", F.col("n"), expr.sha256(F.col("b")))).first()
    assert tuple(r) == ("aé", 17, '["a","é"]', "d:v:0003:" + hashlib.sha256(b"s").hexdigest()[:16])
    order = spark.createDataFrame([(x,) for x in ("6+", "ROOT", "3-5", "1-2")], "bucket string").orderBy(*reports.bucket_order()).collect()
    assert [x.bucket for x in order] == ["ROOT", "1-2", "3-5", "6+"]


def test_alignment_fails_on_other_forms(spark):
    gold = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "sentence_index int, token_id int, form string")
    rows = scoring.align(gold, {"p": gold.withColumn("upos", F.lit("X")), "q": gold})
    assert rows.columns == ["sentence_index", "token_id", "form", "form_p", "upos_p", "form_q"] and rows.count() == 2
    for bad in (gold.where("token_id = 1"), gold.withColumn("form", F.lit("a")), gold.union(spark.createDataFrame([(2, 1, "c")], gold.schema))):
        with pytest.raises(Exception, match="aligned"):
            scoring.align(gold, {"p": bad}).collect()


def test_restored_tags(spark):
    schema = "sid int, tid int, form string, upos string, xpos string, feats string, deprel string"
    gold = spark.createDataFrame([(1, 1, "a", "N", "x", None, "root")], schema)
    pred = spark.createDataFrame([(1, 1, "a", "V", "y", "F=1", "obj")], schema)
    assert tuple(conllu.restore_tags(pred, gold, ["sid", "tid"]).first()) == (1, 1, "a", "N", "x", "_", "obj")
    for bad in (gold.withColumn("form", F.lit("b")), gold.where("tid = 2"), gold.union(gold.withColumn("tid", F.lit(2)))):
        with pytest.raises(Exception, match="aligned"):
            conllu.restore_tags(pred, bad, ["sid", "tid"]).collect()


def test_id_problems_and_cell_differences(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "sent_id string")
    assert {tuple(r) for r in audit.id_problems(ids, "sent_id").collect()} == {("repeated", "a", 2), ("missing", None, 2)}
    rows = spark.createDataFrame([("g", 1, 1, "N", "x"), ("g", 1, 2, "V", None), ("g", 2, 1, "N", "y"), ("g", 2, 2, "V", "z"), ("g", 3, 1, "N", "x"), ("h", 4, 1, "A", "x")], "g string, s int, t int, upos string, deprel string")
    got = {tuple(r) for r in grouping.duplicate_cell_differences(rows, "g", "s", "t", ["upos", "deprel"]).collect()}
    assert got == {("g", 2, 1, "deprel", "x", "y"), ("g", 2, 2, "deprel", None, "z")}


def test_vocabulary_grows(spark):
    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "w string")
    vocab = selection.vocabulary(df("b", "a", None, "b"), "w", ("<pad>",))
    grown = selection.expand_vocabulary(vocab, df("c", "a", "aa"), "w")
    assert {r["item"]: r["index"] for r in grown.collect()} == {"<pad>": 0, "a": 1, "b": 2, "aa": 3, "c": 4}


def test_label_under_root(spark):
    rows = spark.createDataFrame([([1.0, 9.0, 9.0], 2), ([1.0, 2.0, 9.0], 0), ([5.0, 5.0, 0.0], 1)], "s array<double>, h int")
    got = [r[0] for r in rows.select(trees.label_under_root(F.col("s"), ["nsubj", "root", "obj"], F.col("h"))).collect()]
    assert got == ["obj", "root", "nsubj"]


def test_chinese_words(spark):
    df = spark.createDataFrame([("你好,world 3.5-4!",), ("",)], "t string")
    assert [r[0] for r in df.select(textmetrics.chinese_words(F.col("t"))).collect()] == [["你", "好", ",", "world", "3.5", "-", "4", "!"], []]


def test_bleu_without_a_match(spark):
    df = spark.createDataFrame([(1, list("abcd"), list("wxyz"))], "i int, h array<string>, r array<string>")
    counts = textmetrics.ngram_counts(df, "i", "h", "r", 4).collect()
    assert textmetrics.corpus_bleu(counts, 4, 4) == 0.0 and textmetrics.corpus_chrf(counts) == 0.0


def test_orders(spark):
    rel = spark.createDataFrame([("b", -2.0), ("a", 2.0), ("c", None), ("d", 3.0)], "deprel string, per_sentence_difference double")
    assert [r.deprel for r in reports.ranked(rel, reports.relation_order(), 3).orderBy("rank").collect()] == ["d", "a", "b"]
    pairs = spark.createDataFrame([("9", 0.5, 3, 1), ("10", 0.5, 1, 3), ("2", 0.5, 1, 1)], "pid string, js_bits double, words_a int, words_b int")
    assert [r.pid for r in pairs.orderBy(*reports.pair_order("pid")).collect()] == ["10", "9", "2"]
    ids = spark.createDataFrame([("p/10",), ("p/9",), ("p/x",)], "p string")
    assert [r.p for r in ids.orderBy(*reports.numeric_order("p")).collect()] == ["p/9", "p/10", "p/x"]
    near = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.9), (4, 5, 1.0)], "a int, b int, similarity double")
    assert [(r.a, r.b) for r in near.orderBy(*reports.near_pair_order()).collect()] == [(4, 5), (1, 2), (1, 3)]


def test_subset_metrics_may_be_empty(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, "root", "root", "a", "b")], "sid int, tid int, head int, pred_head int, deprel string, pred_deprel string, form string, pred_form string")
    r = reports.exact_token_metrics(scoring.judged(rows), "form", "pred_form").first()
    assert (r.sentences, r.uas, r.las, r.exact_trees) == (0, None, None, None)


def test_runs_to_do():
    wanted = {"a": {"lr": 1, "seed": 2}, "b": {"lr": 3}}
    done = {"a": reports.experiment_signature({"seed": 2, "lr": 1})}
    assert reports.pending_runs(wanted, done) == ["b"]
    with pytest.raises(ValueError, match="other settings"):
        reports.pending_runs(wanted, {"b": done["a"]})


def test_shuffle_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(grouping, "MOST_SHUFFLED", 2)
    with pytest.raises(ValueError, match="split by hash"):
        grouping.split_simple(spark.range(3), "id")


def test_simple_split_equals_list_shuffle(spark):
    import random

    order = list(range(37))
    random.Random(42).shuffle(order)
    want = {g: "train" if i < 29 else "dev" if i < 32 else "test" for i, g in enumerate(order)}
    assert {r.id: r.split for r in grouping.split_simple(spark.range(37), "id").collect()} == want


def test_cover_equals_plain_greedy(spark):
    import random

    random.seed(9)
    items = {i: (frozenset(random.sample("abcdefg", random.randint(1, 3))), random.randint(1, 5)) for i in range(60)}
    covered, left, want = set(), dict(items), []
    while len(want) < 7:
        best = max(left, key=lambda i: (len(left[i][0] - covered), left[i][1], -i))
        want.append(best)
        covered |= left.pop(best)[0]
    rows = spark.createDataFrame([(i, f, w) for i, (fs, w) in items.items() for f in fs], "id bigint, feature string, w int")
    got = selection.covering_sample(rows, "id", "feature", "w", 7).orderBy("selection_order").collect()
    assert [r.id for r in got] == want


def test_scores_of_a_stream(spark, tmp_path):
    schema = "bucket string, head int, pred_head int, deprel string, pred_deprel string"
    spark.createDataFrame([("1-2", 1, 1, "a", "a"), ("1-2", 1, 2, "a", "a"), ("6+", 3, 3, "a:x", "a:y")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = treebank.running_scores(stream, "bucket").writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.bucket: (r.words, r.uas, r.las, r.strict_las) for r in spark.table("scores").collect()} == {"1-2": (2, 50.0, 50.0, 50.0), "6+": (1, 100.0, 100.0, 0.0)}
