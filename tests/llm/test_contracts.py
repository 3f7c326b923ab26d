"""Training-data queries against their SQL, and the cases that earlier versions got wrong."""

import glob
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from dendra.llm import common, minhash, mixing, oracles, quality, registry, rules, secrets, substrings, suffixes, textgrams, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    v = float(v) if isinstance(v, Decimal) else v
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def same(df, q):
    cols = sorted(df.columns)
    assert cols == sorted(q.columns)
    at = [q.columns.index(c) for c in cols]
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - {"op4_quality_rules"}))
def test_oracle_on_edge_cases(spark, tmp_path, name):
    """Nulls, ties, repeated texts, control bytes and no rows at all."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", " \t\n", "a", "apple\0 x y z q", "bpple x y z q", passage, passage, f"x {passage}", f"{passage}\n{passage}", "é中😀 " * 30, "password=hunter22 user: bob https://a.example/b " * 3, "token: " + "aB3" * 9, "one two three four", "One TWO three four"]
    rows = [(i if i != 7 else None, t, "en" if i % 2 else None, None if i == 3 else "abcd"[i % 4], i) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k, part in enumerate((rows, rows[:0])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        c = duckdb.connect()
        c.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        same(registry.QUERIES[name](spark, folder), c.sql(registry.ORACLES[name]))


def test_no_scratch_is_left(spark):
    """Each query leaves its result folder alone, and the pipeline its last one."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + f"/dendra-{spark.sparkContext.applicationId}"
    for name, query in registry.QUERIES.items():
        before = set(os.listdir(top)) if os.path.isdir(top) else set()
        query(spark, SF)
        fresh = set(os.listdir(top)) - before
        assert len(fresh) <= 1, (name, fresh)


def test_a_cluster_needs_the_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session(), "x")


# ---- 2


def test_words_do_not_collide_by_rule():
    words = {bytes(w) for n in (1, 2, 3) for w in itertools.product(b"\0\1abq\xff", repeat=n)}
    words |= {b"\0" * n for n in range(1, 300)} | {b"a" * n for n in range(1, 300)}
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    words |= {thue.encode(), thue.translate(str.maketrans("ab", "ba")).encode()}
    hashes = [int(textgrams.word_hashes(w)[2][0]) for w in words]
    assert len(set(hashes)) == len(words)


def test_null_ids_stay_alone(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (5, text), (None, text), (None, None), (9, "other words are here now")]
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter([(3, 4, 3, True), (5, 4, 3, False), (None, 4, None, True), (None, 0, None, True), (9, 2, 9, True)])


def test_links_rest_on_words(monkeypatch):
    """With colliding hashes everywhere, verification still finds exactly the true links."""
    import zstandard

    monkeypatch.setattr(minhash, "shingle_sets", lambda texts, k: [np.zeros(1, np.uint64) for _ in texts])
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:55] + ["x"]), " ".join(f"v{i}" for i in range(60)), " ".join(reversed(base))]
    zip_ = zstandard.ZstdCompressor()
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 4), pa.array([10, 11, 12, 13]), pa.array([zip_.compress(t.encode()) for t in texts], pa.binary())], ["key", "id", "words"])
    found = [tuple(r.values()) for b in minhash._verify(4, 80)(iter([batch])) for r in b.to_pylist()]
    assert found == [(11, 10)]


def test_large_family_and_recall(spark):
    """A family of 300 near copies in a chain of variants, among texts of their own: every link of all pairs is found."""
    random.seed(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(i % 4):
            words[random.randrange(120)] = f"x{random.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(random.choice("abcdefgh") * 3 + str(random.randrange(90)) for _ in range(60))) for i in range(60)]
    sets = {i: set(zip(*(t.split()[k:] for k in range(4)), strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


# ---- 4


def test_rules_prove_cutoffs_and_match_sql(spark, tmp_path):
    """Strata of 400 (proof), 100 (too few) and one whose good documents break every rule."""
    random.seed(12)
    docs, marks = [], []
    for i in range(1200):
        lang = "en" if i < 600 else "de" if i < 800 else "fr"
        good = i % 3 != 0
        words = [random.choice(["plain", "text", "about", "things"]) + str(random.randrange(400)) for _ in range(70)]
        if not good or lang == "fr":
            words = [w + "###" if random.random() < 0.4 else w for w in words]
        docs.append((i, " ".join(words), lang))
        if lang != "de" or i < 700:
            marks.append((i, int(good), 0))
    marks += [(5, None, 0), (None, 1, 0), (4, 0, 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = registry.QUERIES["op4_quality_rules"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same(df, c.sql(oracles.ORACLES["op4_quality_rules"]))
    gone = Counter((docs[r.doc_id][2], r.doc_id % 3 != 0) for r in df.collect() if not r.kept)
    assert gone["en", False] > 190 and gone["en", True] == 0 and not gone.keys() & {("de", True), ("de", False), ("fr", True), ("fr", False)}


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "word " * 60, "en"), (2, " ".join(f"w{i}" for i in range(60)), None), (3, None, "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.report(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}


# ---- 5


def test_segments_equal_all_intervals():
    """The best interval of any sequence, and the recursive definition of all maximal ones."""
    random.seed(13)

    def definition(x, lo, hi):
        best = max(((sum(x[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 1e-9:
            return []
        a, b = best[3:]
        return [*definition(x, lo, a), (a, b - 1, best[0]), *definition(x, b, hi)]

    for _ in range(300):
        x = [random.choice([-3, -2, -1, 1, 2, 4]) + random.random() / 1000 for _ in range(random.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in sorted(toxicity.maximal_segments(x))]
        assert got == [(a, b, round(s, 6)) for a, b, s in sorted(definition(x, 0, len(x)))]


def test_lexicon_equals_a_plain_count(spark):
    random.seed(14)
    bad, fine = [f"vile{i}" for i in range(6)], [f"calm{i}" for i in range(30)]
    rows = []
    for i in range(240):
        y = int(i % 3 == 0)
        words = [random.choice(fine) for _ in range(25)]
        for _ in range(4 * y):
            words.insert(random.randrange(20), random.choice(bad))
        rows.append((i, " ".join(words), y, 1))
    seen = defaultdict(lambda: [set(), set()])
    for _, text, y, _ in rows:
        found, met = ["", *toxicity.tokens(text), ""], set()
        for k in range(1, len(found) - 1):
            for s in toxicity.stems(found[k]):
                if s not in met:
                    met.add(s)
                    seen[s][y].add(zlib.crc32(" ".join(found[k - 1 : k + 2]).encode()))
    want = {t: (len(b), len(a)) for t, (a, b) in seen.items()}
    got = toxicity.counts(spark.createDataFrame([r[1:3] for r in rows], "text string, y int")).collect()
    assert {r.token: (r.a, r.b) for r in got} == want
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y, i % 4) for i, _, y, _ in rows], "doc_id bigint, y int, fold int"))
    assert all(model.odds[w] > 0 for w in bad) and all(model.odds[w] < 0 for w in fine) and model.rate > 0 and model.k > 0
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scored[i] for i, _, y, _ in rows if y) > max(scored[i] for i, _, y, _ in rows if not y)


# ---- 6


def test_linked_spans_equal_all_pairs(spark):
    random.seed(15)
    opaque = lambda: "".join(random.choice("aB3xY7") for _ in range(24))
    makers = [lambda: "login: bob" + str(random.randrange(99)), opaque, lambda: "https://db.example.org/" + str(random.randrange(99)), lambda: "password=hunter22", lambda: "AKIA" + "A1" * 9, lambda: "0f" * 14, lambda: "filler " * random.randrange(40), lambda: "secret=" + ".".join(opaque() for _ in range(random.choice([2, 90])))]
    rows = [(i, " ".join(random.choice(makers)() for _ in range(random.randint(0, 12)))) for i in range(150)]
    rows.append((900, "secret=" + ".".join(opaque() for _ in range(1500)) + " login: bob https://a.example/xyz"))
    want = {}
    for i, t in rows:
        spans = []
        for k, p in enumerate(secrets.PARTS):
            for m in re.finditer(p.pattern, t):
                if len(m.group(p.group)) >= p.shortest and (not p.extra or re.search(p.extra, m.group())):
                    spans.append((m.start(), k, m.end()))
        keep = []
        for s, k, e in spans:
            near = [secrets.PARTS[k2] for s2, k2, e2 in spans if s2 < e + 300 and e2 > s - 300 and not (s2 < e and e2 > s)]
            inside = any(secrets.PARTS[k2].strong and s2 < e and e2 > s for s2, k2, e2 in spans)
            others = {0, 1, 2} - {secrets.PARTS[k].role}
            linked = any(p.strong and p.role in others for p in near) or others <= {p.role for p in near}
            if secrets.PARTS[k].strong or (linked and not inside):
                keep.append((s, k, e))
        want[i] = ",".join(f"{secrets.PARTS[k].name}:{s}:{e}" for s, k, e in sorted(keep))
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and any("opaque" in x for x in want.values())


# ---- 7


def test_quality_approximates_the_kernel(spark):
    """Scores rank as those of an exact Gaussian-kernel ridge over the same statistics."""
    random.seed(16)
    rows = []
    for i in range(400):
        good = i % 2
        words = [random.choice(["green", "river", "runs", "below", "a", "hill"]) if good else random.choice(["BUY", "###", "now", "now", "now"]) for _ in range(random.randint(20, 60))]
        rows.append((i, " ".join(words) + (".\nNext line here." if good else "!!!"), float(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, y double"))
    x, y = np.array([quality.statistics(t) for _, t, _ in rows]), np.array([r[2] for r in rows])
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * quality.N_STATS))
    exact = kernel @ np.linalg.solve(kernel + quality.RIDGE * len(y) * np.eye(len(y)), y - y.mean()) + y.mean()
    assert np.corrcoef(exact, model.raw(x))[0, 1] > 0.97
    assert ((model.score(x) >= quality.THRESHOLD) == (y > 0)).mean() == 1


# ---- 8


def test_flow_is_cheapest():
    """Against all integer flows of small overlapping networks."""
    random.seed(17)
    for _ in range(40):
        patterns = [(p, float(random.randint(1, 3))) for p in random.sample([("a",), ("b",), ("a", "b"), ("b", "c")], random.randint(1, 3))]
        want = {k: float(random.randint(0, 4)) for k in "abc"}
        flow = mixing.route(patterns, want, 2)
        best = None
        arcs = [(j, k) for j, (p, _) in enumerate(patterns) for k in p]
        for xs in itertools.product(*[range(int(2 * patterns[j][1]) + 1) for j, _ in arcs]):
            out = [sum(x for (i, _), x in zip(arcs, xs, strict=True) if i == j) for j in range(len(patterns))]
            to = {k: sum(x for (_, c), x in zip(arcs, xs, strict=True) if c == k) for k in "abc"}
            if all(o <= 2 * s for o, (_, s) in zip(out, patterns, strict=True)) and all(to[k] <= want[k] for k in to):
                key = -sum(xs), sum(max(0, o - s) for o, (_, s) in zip(out, patterns, strict=True))
                best = key if best is None or key < best else best
        assert (-round(sum(flow), 6), round(sum(max(0, f - s) for f, (_, s) in zip(flow, patterns, strict=True)), 6)) == best


def test_every_group_goes_through_the_flow(monkeypatch):
    calls, real = [], mixing.min_cost_flow
    monkeypatch.setattr(mixing, "min_cost_flow", lambda *a, **b: calls.append(1) or real(*a, **b))
    assert mixing.route([(("a",), 4.0), (("b",), 6.0)], {"a": 5.0, "b": 3.0}) == [5.0, 3.0] and len(calls) == 2


# ---- long texts


def test_texts_over_a_block(spark):
    """Texts over a megabyte, with copies across the edges of pieces, and a single word over 64 KB."""
    random.seed(18)
    words = [f"{random.randrange(10**6)}" for _ in range(190_000)]
    copy = words[150_000:150_300]
    long = " ".join(words)
    rows = [(1, long), (2, "start " + " ".join(copy) + " end"), (3, "y" * 200_000 + " " + " ".join(words[:20]))]
    assert len(long) > 1 << 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(df, cuts=()).collect()}
    assert got == {1: (190_000, 0), 2: (302, 300), 3: (21, 20)}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect()}
    shared = " " + " ".join(copy) + " "
    assert got[2][0] >= len(shared) - 1 and got[2][1] == 1 and got[1] == (0, 0) and got[3][0] >= len("y" * 200_000) - 100
