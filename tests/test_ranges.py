"""The scan by byte ranges against a single read of the file."""

import random

import pytest
from pyspark.sql import functions as F

from dendra.sources import conllu, ranges


@pytest.fixture
def narrow(spark):
    """Ranges of a few bytes, so that blocks cross many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def width(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{n}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield width
    for k, v in old.items():
        spark.conf.set(k, v)


def strictly(raw):
    blocks, now = [], ""
    for line in raw.decode().splitlines(keepends=True):
        if line.strip():
            now += line
        elif now:
            blocks.append(now)
            now = ""
    return blocks + [now] * bool(now)


def leniently(raw):
    text = raw.decode().replace("\r\n", "\n").replace("\r", "\n").strip()
    return [b for b in text.split("\n\n") if b.strip()]


def texts():
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("ab é漢#\t1") for _ in range(rng.randrange(1, 9))) + "x"
    ends = ["\n", "\n", "\n", "\r\n", "\n\n", "\n\n\n", "\n\n\n\n", "\r\n\r\n", "\n \t\n", "\n　\n", "\x0b", "\x85", " ", "\r", "\n\x1c\n", "\x0c\x0b", "\n\0\n"]
    yield from (b"", b"\n", b"a", b"a\n", b"\n\na\n\n", b"a\n\nb", b"a\nb\n\n\nc\n   ", b"a\r", b"a\x0b", "﻿a\tb\n\nc\n".encode(), "﻿a\n\nb".encode(), b"a\r\n\r\nb\r\n", b"x" * 500 + b"\n\n" + b"y\n" * 200 + b"\n")
    for _ in range(25):
        yield "".join(line() + rng.choice(ends) for _ in range(rng.randrange(1, 60))).encode()


@pytest.mark.parametrize("mode", ["strict", "lenient"])
@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_ranges_equal_one_read(spark, narrow, tmp_path, mode, width):
    want = {}
    for i, raw in enumerate(texts()):
        (tmp_path / f"f{i:03}").write_bytes(raw)
        want[f"f{i:03}"] = list(enumerate((strictly if mode == "strict" else leniently)(raw), 1))
    narrow(width)
    got = {k: [] for k in want}
    for r in conllu.read_blocks(spark, str(tmp_path), mode, whole=False).collect():
        got[r.path.rsplit("/", 1)[1]].append((r.position, r.block))
    assert {k: sorted(v) for k, v in got.items()} == want
    if mode == "strict" or width == 7:  # and the other way to read them
        alike = {k: [] for k in want}
        for r in conllu.read_blocks(spark, str(tmp_path), mode, whole=True).collect():
            alike[r.path.rsplit("/", 1)[1]].append((r.position, r.block))
        assert {k: sorted(v) for k, v in alike.items()} == want


def test_one_file_several_tasks(spark, narrow, tmp_path, monkeypatch):
    block = "# sent_id = s{0}\n1\ta{0}\t_\tX\t_\t_\t0\troot\t_\t_\n"
    (tmp_path / "x.conllu").write_text("\n".join(block.format(i) for i in range(2_000)))
    narrow(10_000)
    lines = spark.read.text(str(tmp_path), lineSep="\n")
    assert lines.rdd.getNumPartitions() >= 8
    monkeypatch.setattr(conllu, "WHOLE_BYTES", 1_000)
    for limit in (ranges.MOST_RANGES, 0):
        monkeypatch.setattr(ranges, "MOST_RANGES", limit)
        sents = conllu.sentences(conllu.read_blocks(spark, str(tmp_path)))
        assert sents.where(F.col("sent_id") != F.concat(F.lit("s"), (F.col("position") - 1).cast("string"))).isEmpty() and sents.count() == 2_000


@pytest.mark.parametrize("whole", [False, True])
def test_bytes_that_are_not_utf8(spark, narrow, tmp_path, whole):
    (tmp_path / "good").write_bytes("fine é\n\nfine".encode())
    (tmp_path / "bad").write_bytes("é one\ntwo\n\nthree ".encode() + b"\xff\xfe\n\nfour\n")
    narrow(8)
    with pytest.raises(Exception, match="bad is not valid UTF-8 at byte 18"):
        conllu.read_blocks(spark, str(tmp_path), whole=whole).collect()


def test_compressed_files_are_refused(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(f"{tmp_path}/z", compression="gzip")
    with pytest.raises(Exception, match="by ranges"):
        conllu.read_blocks(spark, f"{tmp_path}/z", whole=False).collect()
    assert conllu.read_blocks(spark, f"{tmp_path}/z", whole=True).count() == 1


def test_files_are_numbered_and_written_in_order(spark, tmp_path):
    blocks = spark.createDataFrame([(p, i, f"1\t{p}{i}\n") for p in "ba" for i in range(1, 30)], "path string, position bigint, block string").repartition(4)
    conllu.write_blocks(blocks, f"{tmp_path}/out")
    again = conllu.number_files(conllu.read_blocks(spark, f"{tmp_path}/out", whole=False)).orderBy("place").collect()
    assert [(r.place, r.block) for r in again] == [(k, f"1\t{p}{i}\n") for k, (p, i) in enumerate(((p, i) for p in "ab" for i in range(1, 30)), 1)]
