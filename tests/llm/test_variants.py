"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dendra.llm import registry, variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_words(rows, modulus=variants.MODULUS, length=6, count=5):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if modulus and h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= length and n >= count}


def plainly(words, times=5):
    """By the definition, with each word's one-edit neighbourhood looked up; long words with all."""
    alphabet = sorted({c for w in words for c in w})
    out, form = [], {}
    for w, n in words.items():
        if len(w) > 99:
            near = [x for x in words if one_edit(w, x)]
        else:
            around = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in alphabet for d in (0, 1)}
            near = [x for x in around & words.keys() if x != w]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out.append([w, form[w], None, n, len(near), words[form[w]] if form[w] else None])
    for r in out:
        r[2] = r[0]
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plainly(plain_words(rows))


def close_words(seed, count):
    random.seed(seed)
    out = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "abcdef", "abcdefg", "xabcdef", "abcxdef", "éèàüöñ", "éèàüöñé", "×÷×÷×÷"}
    while len(out) < count:
        w = random.choice(sorted(out)) if random.random() < 0.7 else "".join(random.choice("abc") for _ in range(random.randrange(6, 12)))
        i = random.randrange(len(w))
        w = random.choice([w[:i] + random.choice("abcz") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + random.choice("abcz") + w[i:]])
        if len(w) >= 6:
            out.add(w)
    return {w: random.choice([5, 5, 6, 25, 30, 150, 900]) for w in sorted(out)}


@pytest.mark.parametrize("sizes", [{}, {"per_shard": 40}, {"per_shard": 40, "most_points": 3}, {"most_points": 1}])
def test_close_words(spark, monkeypatch, sizes):
    """Many words near each other, in one shard, in many, and in shards cut by points; the last way without a broadcast too."""
    words = close_words(3, 500)
    if "most_points" in sizes:
        monkeypatch.setattr(variants, "MOST_HOT", 0)
    monkeypatch.setattr(variants, "CHUNK", 100)
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), **sizes)
    assert sorted(map(tuple, got.collect())) == plainly(words)


def test_definition_of_near():
    words = close_words(5, 120)
    for w, _, _, _, near, _ in plainly(words):
        assert near == sum(one_edit(w, x) for x in words)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 100):
        v = rng.permutation(n)
        tree = variants.WaveletTree(v)
        q = rng.integers(0, n + 1, (60, 4))
        left, right, low, high = q[:, 0], np.maximum(q[:, 0], q[:, 1]), q[:, 2], np.maximum(q[:, 2], q[:, 3])
        got = sorted(zip(*map(np.ndarray.tolist, tree.report(left, right, low, high)), strict=True))
        assert got == sorted((i, int(x)) for i in range(60) for x in v[left[i] : right[i]] if low[i] <= x < high[i])


def test_edges(spark):
    """Nulls, repeated rows, very long words, other columns; runs that lose a code point."""
    long = "q" * 30_000 + "x"
    rows = [(1, None), (2, ""), (3, "1 2 3"), (None, "Letters letters " * 3), (4, "LETTERS lettérs lettErs-letterz " * 5), (4, "LETTERS lettérs lettErs-letterz " * 5), (5, f"{long} {long[1:]} " * 5), (6, "short words of five " * 9)]
    rows += [(i, "doubled letterss separate seperate") for i in range(7, 300)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    assert sorted(map(tuple, variants.spelling_variants(df).collect()), key=str) == sorted(plainly(plain_words(rows)), key=str)
    assert variants.spelling_variants(df.limit(0)).collect() == []
    kept = variants.vocabulary(df, modulus=None, least_length=3, least_count=2)
    assert {r.word: r.n for r in kept.collect()} == plain_words(rows, None, 3, 2)


def test_long_chain_of_forms(spark):
    n = 40
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(n)], "word string, form string")
    assert {r.word: r.root for r in variants.roots(forms).collect()} == {f"w{i:02}": f"w{n:02}" for i in range(n)}
