"""Blocks of large text files, read by several tasks.

Spark's line scan splits a file by byte ranges. Each task folds the lines of a range into
blocks: those that lie inside are whole, the first and the last piece may go on in the
neighbouring ranges. One small row for each range then goes through a fold in file order,
which joins the pieces, numbers the blocks and knows the byte where each range begins. The
lines of a batch are cut at empty lines in one go; only a batch with other line ends or
blanks goes line by line.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.session import checkpoint

#: Ranges whose numbers may be broadcast; beyond it they are joined by a shuffle.
MOST_RANGES = 100_000

#: A line of white space only, between two line feeds.
_BLANK = re.compile(r"\n[^\S\n]+\n")

_FOLDED = "file bigint, start bigint, i bigint, block string, head string, tail string, pieces bigint, lead bigint, trail bigint, bytes bigint, fault bigint"
_PLACED = "path string, file bigint, start bigint, base bigint, position bigint, block string"


@dataclass
class Range:
    """Lines of one range, folded into pieces: runs of lines between blank ones. ``done`` holds pieces that are complete."""

    file: int
    start: int
    strict: bool
    pieces: int = 0
    inner: int = 0  # complete ones that aren't blank
    head: str = ""
    current: list[str] = field(default_factory=list)
    lead: int = 0  # blank lines before the first piece
    gap: int = 0  # blank lines since the last line of a piece
    bytes: int = 0
    fault: int | None = None
    done: list[str] = field(default_factory=list)

    def add(self, values: pa.Array) -> None:
        if self.fault is not None:
            return
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.scalar(b"\n", values.type))[0].as_py() + b"\n"
        try:
            text = raw.decode()
        except UnicodeDecodeError as e:
            self.fault = self.bytes + e.start
            return
        self.bytes += len(raw)
        if not self.strict:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        elif len(lines := text.splitlines(keepends=True)) != len(values) or _BLANK.search("\n" + text):
            for line in lines:
                if line.strip():
                    self._lines(line)
                else:
                    self._blank(1)
            return
        # only empty lines are blank, so a run of lines ends where two line feeds meet
        *runs, last = text.split("\n\n")
        for run in runs:
            if lines := run.lstrip("\n"):
                self._blank(len(run) - len(lines))
                self._lines(lines + "\n")
                self._blank(1)
            else:
                self._blank(len(run) + 2)
        lines = last.lstrip("\n")
        self._blank(len(last) - len(lines))
        if lines:
            self._lines(lines)

    def _lines(self, lines: str) -> None:
        if self.gap or not self.pieces:
            self._close()
            self.pieces += 1
            if self.pieces > 1 and opens_with_line_feed(self.gap, self.strict):
                self.current.append("\n")
            self.gap = 0
        self.current.append(lines)

    def _blank(self, lines: int) -> None:
        if self.pieces:
            self.gap += lines
        else:
            self.lead += lines

    def _close(self) -> None:
        """The current piece ends at a blank line: the first is kept for the range's row, others are complete."""
        if self.pieces == 1:
            self.head = "".join(self.current)
        elif (block := "".join(self.current)).strip():
            self.done.append(ended(block, self.strict))
            self.inner += 1
        self.current = []

    def inside(self) -> Iterator[pa.RecordBatch]:
        if n := len(self.done):
            yield _folded(n, file=[self.file] * n, start=[self.start] * n, i=np.arange(self.inner - n, self.inner), block=self.done)
            self.done = []

    def row(self) -> pa.RecordBatch:
        last = "".join(self.current)
        head, tail = (last, None) if self.pieces == 1 else (self.head, last)
        numbers = {"pieces": min(self.pieces, 2) + self.inner, "lead": self.lead, "trail": self.gap, "bytes": self.bytes, "fault": self.fault}
        return _folded(1, file=[self.file], start=[self.start], head=[head], tail=[tail], **{k: [v] for k, v in numbers.items()})


def opens_with_line_feed(blank: int, strict: bool) -> bool:
    """Whether a block begins with a line feed after so many blank lines: where two line feeds separate, an odd one is left over."""
    return not strict and blank > 0 and blank % 2 == 0


def ended(block: str, strict: bool) -> str:
    """A block whose last line feed belongs to the separator, where that is two line feeds."""
    return block if strict else block.removesuffix("\n")


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000, letters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many rows, or fewer if their texts are long."""
    held: list[tuple] = []
    size = 0
    for r in itertools.chain(rows, [None]):
        if r is not None:
            held.append(r)
            size += sum(len(x) for x in r if isinstance(x, str))
        if held and (r is None or len(held) == most or size > letters):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in ddl.split(", "))])


def _folded(n: int, **columns) -> pa.RecordBatch:
    """So many rows of _FOLDED; columns that aren't given are null."""
    schema = _schema(_FOLDED)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _fold(strict: bool):
    """(file, start, line) in file order within a range -> _FOLDED: complete blocks (i, block), and a row for each range."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Range | None = None
        for b in batches:
            files, starts = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            bounds = [0, *new.tolist(), b.num_rows] if b.num_rows else [0]
            for first, last in itertools.pairwise(bounds):
                if now is None or (now.file, now.start) != (files[first], starts[first]):
                    if now:
                        yield now.row()
                    now = Range(int(files[first]), int(starts[first]), strict)
                now.add(b.column(2).slice(first, last - first))
                yield from now.inside()
        if now:
            yield now.row()

    return fold


def _stitch(strict: bool):
    """Ranges of files in order -> _PLACED: for each range the number of blocks before its own, and the blocks that ranges share.

    ValueError for bytes that aren't UTF-8, with the file and the byte."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        file = path = None
        size = total = count = blank = 0
        opened: str | None = None

        def closed(last: bool) -> Iterator[tuple]:
            nonlocal count, opened
            if opened is None:
                return
            text = ended(opened, strict)
            if last and total > size and strict and not blank:
                text = text.removesuffix("\n")  # the line scan can't tell a file that ends without one
            if not strict:
                text = (text.rstrip() if last else text) if count else (text.strip() if last else text.lstrip())
            opened = None
            if text.strip():
                count += 1
                yield path, file, None, None, count, text

        for b in batches:
            for r in b.to_pylist():
                if r["file"] != file:
                    yield from closed(True)
                    file, path, size, total, count, blank, opened = r["file"], r["path"], r["size"], 0, 0, 0, None
                    if not r["known"]:
                        raise ValueError(f"{path} can't be read by ranges")
                if r["fault"] is not None:
                    raise ValueError(f"{path} is not valid UTF-8 at byte {total + 3 * r['marked'] + r['fault']}")
                mark = "﻿" if total == 0 and r["marked"] else ""
                total += r["bytes"]
                blank += r["lead"]
                if r["pieces"]:
                    if blank:
                        yield from closed(False)
                    if opened is None:
                        opened = mark + ("\n" if count and opens_with_line_feed(blank, strict) else "")
                    opened += r["head"]
                    blank = r["trail"]
                    if r["pieces"] > 1:
                        yield from closed(False)
                        yield path, file, r["start"], count, None, None
                        count += r["pieces"] - 2
                        opened = r["tail"]
        yield from closed(True)

    return lambda batches: _batches(rows(batches), _schema(_PLACED))


def read_ranges(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """(path, position, block) of uncompressed files of any size, positions from 1 per file; the folded blocks are written once into the
    checkpoint folder, and read once for the rows of the ranges, which are kept apart."""
    place = F.xxhash64("_metadata.file_path").alias("file")
    lines = spark.read.text(path, lineSep="\n").select(place, F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    folded = checkpoint(lines.mapInArrow(_fold(strict), _FOLDED))
    ranges = checkpoint(folded.where("i IS NULL").drop("i", "block"))
    # the line scan drops a byte order mark and can't tell whether the last line had an end: the files' sizes do
    sizes = spark.read.format("binaryFile").load(path).select(place, F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))
    read = ranges.groupBy("file").agg(F.sum("bytes").alias("read"), F.max("fault").alias("any_fault"))
    lost = F.col("size") - F.col("read")
    sizes = sizes.join(read, "file").select("file", "path", "size", lost.isin(2, 3).alias("marked"), (lost.isin(-1, 0, 2, 3) | F.col("any_fault").isNotNull()).alias("known"))
    sizes = sizes.withColumn("size", F.when(F.col("marked"), F.col("size") - 3).otherwise(F.col("size")))
    ordered = ranges.join(sizes, "file").repartition("file").sortWithinPartitions("file", "start")
    placed = checkpoint(ordered.mapInArrow(_stitch(strict), _PLACED))
    base = placed.where("base IS NOT NULL").select("path", "file", "start", "base")
    if base.count() <= MOST_RANGES:
        base = F.broadcast(base)
    inside = folded.where("i IS NOT NULL").select("file", "start", "i", "block").join(base, ["file", "start"])
    return inside.select("path", (F.col("base") + F.col("i") + 1).alias("position"), "block").unionByName(placed.where("position IS NOT NULL").select("path", "position", "block"))
