"""Language identification against a plain naive Bayes, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dendra.llm import langid, registry

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    out, run = [" "], " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or run != " ":
            out.append(c)
        run = c
    if run != " ":
        out.append(" ")
    return [tuple(out[i : i + k]) for k in langid.ORDERS for i in range(len(out) - k + 1)]


def bucket(gram, n):
    a = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
    return int(langid._buckets(a, len(gram), n)[0])


def plainly(rows, n):
    """Naive Bayes with dictionaries and floating logarithms."""
    counts, docs = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            docs[lang] += 1
            counts[lang].update(bucket(g, n) for g in plain_grams(text or ""))
    out = []
    for i, text, _ in rows:
        if not docs or not any(c.isalpha() for c in text or ""):
            out.append((i, "und", 0.0))
            continue
        x = {}
        for lang in sorted(docs):
            total = counts[lang].total() + langid.PRIOR * n
            x[lang] = math.log(docs[lang] / docs.total()) + sum(math.log((counts[lang][bucket(g, n)] + langid.PRIOR) / total) for g in plain_grams(text))
        best = max(x, key=x.get)
        out.append((i, best, 1 / sum(math.exp(v - x[best]) for v in x.values())))
    return out


ROWS = [
    (0, "Der Hund läuft über die Straße und bellt", "de"), (1, "Die Katze schläft auf dem Sofa im Haus", "de"), (3, "the dog runs over the street and barks", "en"), (4, "a cat sleeps on the sofa in the house", "en"),
    (5, "le chien court dans la rue et aboie", "fr"), (6, "", "fr"), (7, None, "en"), (8, "12 34 !?", "de"), (9, "Straße", None), (10, "the", None), (11, "ΑΒΓ αβγ 漢字 😀", None), (None, "la rue", "fr"),
    (12, "A", None), (12, "A", None), (13, "x\0y\n\nz", "en"), (14, "house " * 900 + "Haus", None), (15, "ǅ İ ŉ", "x'"),
]


def test_against_plain_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 64)
    df = spark.createDataFrame([(*r, 0.5, "q") for r in ROWS], "doc_id bigint, text string, lang string, score double, lang_pred string").repartition(3)
    got = sorted(map(tuple, langid.identify(df).select("doc_id", "lang_pred", "score").collect()), key=str)
    want = sorted(plainly(ROWS, langid.MOST_BUCKETS), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_held_out_marks_and_nulls(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    for r in langid.identify(df).collect():
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.mark.parametrize("rows", [[], [(1, "some text", None), (2, None, None)]])
def test_nothing_to_learn(spark, rows):
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_many_languages_shrink_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_CELLS", 1 << 12)
    monkeypatch.setattr(langid, "HELD_LANGS", 2)
    rows = [(4 * i, f"{chr(97 + i)} " * 9, f"l{i:02}") for i in range(16)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = langid.fit(spark.createDataFrame([r[1:] for r in rows], "text string, lang string").coalesce(1))
    assert model.table.size <= 1 << 12
    letters = langid._letters()
    assert all(model.predict(t, letters)[0] == lang for _, t, lang in rows)
    monkeypatch.setattr(langid, "MOST_CELLS", 1 << 10)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.createDataFrame([r[1:] for r in rows], "text string, lang string"))


def test_batches_and_long_texts(spark, monkeypatch):
    """Equal texts score alike wherever they stand; a text above 1 MiB is read whole."""
    df = spark.createDataFrame([(i, t, x) for i, t, x in ROWS] + [(100 + i, t, None) for i, t, _ in ROWS if i is not None] + [(300, "the house " * 120_000 + "über", "en"), (301, "Haus " * 260_000, None)], "doc_id bigint, text string, lang string")
    one = {r.doc_id: r[2:] for r in langid.identify(df.coalesce(1)).where("doc_id IS NOT NULL").collect()}
    monkeypatch.setattr(langid, "PIECE", 1000)
    many = {r.doc_id: r[2:] for r in langid.identify(df.repartition(5)).where("doc_id IS NOT NULL").collect()}
    assert one == many and one[301][0] == "de"
    assert all(one[i] == one[100 + i] for i, _, _ in ROWS if i is not None)


def test_held_out_accuracy(spark):
    rows = registry.QUERIES["op12_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
