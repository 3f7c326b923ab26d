"""Collocations against plain counts, with exact integers."""

import re
from collections import Counter, defaultdict

import pytest

from dendra.llm import collocations

WORD = re.compile(r"[^\x20\x09]+")


def plainly(rows, most, least, absorbed=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = tuple(WORD.findall(piece))
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        inside = {}
        for p in kept:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), counts[p])
        found = []
        for p in kept:
            a = counts[p]
            if 100 * inside.get(p, 0) >= absorbed * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


TEXTS = [
    (None, "en"), ("", "en"), (" \t\n.,", None), ("New York is New York; new york", "en"), ("new\tyork  is new \t york", "en"), ("a a a a a a a", None), ("a a a. a a", "und"),
    ("É é ß é é ß", "fr"), ("x\0y x\0y x\0y", "fr"), ("the cat sat on the mat, the cat sat on the rug! the cat sat", "en"), ("z" * 70_000 + " q " + "z" * 70_000 + " q", "en"),
    ("one two three four five six " * 200, "de"), ("one two three four five six " * 200, "de"), ("👍 👍 ok ok 👍 👍", "de"), ("cat\x0bsat\x0ccat sat\rcat", "en"),
]


@pytest.mark.parametrize(("most", "least", "absorbed", "top"), [(5, 2, 100, 2000), (5, 1, 100, 7), (3, 2, 60, 2000), (2, 3, 100, 1)])
def test_against_plain_counts(spark, most, least, absorbed, top):
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(TEXTS)], "text string, lang string, rank int, score string")
    got = collocations.mine(df, most=most, least=least, absorbed=absorbed, per_lang=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plainly(TEXTS, most, least, absorbed, top)


def test_small_holds_full_maps_and_no_broadcast(spark, monkeypatch):
    """What tasks hold, the map's size and the way totals are joined change no result: not even a map that lets everything through."""
    df = spark.createDataFrame(TEXTS, "text string, lang string").repartition(3)
    want = plainly(TEXTS, 5, 2)
    monkeypatch.setattr(collocations, "MOST_LANGS", 1)
    monkeypatch.setattr(collocations, "BATCH", 3)
    monkeypatch.setattr(collocations, "BATCH_BYTES", 9)
    monkeypatch.setattr(collocations, "HELD_HASHES", 10)
    monkeypatch.setattr(collocations, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 15)
    assert sorted(map(tuple, collocations.mine(df, least=2).collect())) == want
    monkeypatch.setattr(collocations, "_frequent", lambda rows, least: (__import__("numpy").full(1 << 12, 255, "uint8"), 49))
    assert sorted(map(tuple, collocations.mine(df, least=2).collect())) == want


def test_products_beyond_64_bits(spark):
    """Counts as large as a 100 TB corpus gives: 1000 * a * n passes 64 bits and the score is still the floor."""
    a, l, r, n = 3_000_000_007, 50_000_000_021, 40_000_000_003, 16_000_000_000_057
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, words int, phrase string, f bigint")
    row = collocations.scored(counts).first()
    assert (row.a, row.l, row.r, row.n, row.score) == (a, l, r, n, 1000 * a * n // (l * r))


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(df).collect() == []
