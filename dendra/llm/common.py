"""What the training-data operators share: word rules, size hints, scratch tables."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan: for a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_per_bucket: int, least: int = 16) -> int:
    """Number of buckets that keeps a bucket's share of the input near a fixed size, so memory per task does not grow with the data.

    Where the plan doesn't know its size (Catalyst then assumes the greatest), the texts are measured."""
    size = input_bytes(df)
    if size >= 1 << 55:
        texts = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
        size = df.agg(F.coalesce(F.sum(sum(map(F.coalesce, texts, [F.lit(0)] * len(texts)), F.lit(0))), F.lit(0))).first()[0]
    return max(least, -(-size // bytes_per_bucket))


#: Partitions of one shuffle; with more input a task streams through more buckets, one at a time.
MOST_TASKS = 100_000


def task_count(spark: SparkSession, buckets: int, per_task: int = 8) -> int:
    """Tasks for some ``per_task`` buckets each: as the input grows, tasks grow in number and not in size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-buckets // per_task)))


def dealt(df: DataFrame, buckets: int, per_task: int = 8) -> DataFrame:
    """Rows by key, dealt to task_count() tasks and sorted by key."""
    return df.repartition(task_count(df.sparkSession, buckets, per_task), "key").sortWithinPartitions("key")


#: Scratch folders that this process has made, in order.
CREATED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder, inside one of this application that goes when it ends.

    Only a local session may have no such setting; its executors share the machine's own folders."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        top = "file:/tmp/checkpoints"
    own = f"{top.rstrip('/')}/dendra-{spark.sparkContext.applicationId}"
    p, fs = _path(spark, own)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    CREATED.append(f"{own}/{name}-{uuid.uuid4().hex}")
    return CREATED[-1]


def sweep(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Remove the scratch folders made after the first ``since`` of CREATED, but for those to keep."""
    for path in CREATED[since:]:
        if path not in keep:
            remove(spark, path)
    CREATED[since:] = [path for path in CREATED[since:] if path in keep]


def save(df: DataFrame, path: str, **options) -> DataFrame:
    """Write and reread: cuts lineage with files that outlive any executor."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finish(df: DataFrame, name: str, since: int) -> DataFrame:
    """Write a result and remove the scratch folders that were made for it (all after the first ``since`` of CREATED)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    out = save(df, path)
    sweep(spark, since, (path,))
    return out


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python in batches of so many rows, unless the session has a number of its own: Spark's 10,000 would be gigabytes of long texts in a worker and beside the JVM's heap."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice plans that are no longer used, so that Spark removes their shuffle files now."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, row): the text, and all other columns as one struct, so that no name of theirs meets an operator's own columns."""
    return df.select(column(text_col).alias("text"), F.struct(F.lit(0).alias("0"), *[column(c) for c in df.columns if c != text_col]).alias("row"))


def unpacked(names: list[str], text_col: str = "text", **changed: Column) -> list[Column]:
    """The columns that packed() had, in their old order; some may be changed."""
    return [changed.get(c, F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in names]


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as decimal text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % modulus


class settings:
    """Session settings for the jobs inside a with block; the old values return after it."""

    def __init__(self, spark: SparkSession, **values: str):
        self.spark, self.values = spark, {k.replace("__", "."): v for k, v in values.items()}

    def __enter__(self) -> None:
        self.old = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.old.items():
            self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)


_HELD: dict[str, dict] = {}


def held(owner: str, key: object, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, for one operator at a time: another operator's things go first."""
    if owner not in _HELD:
        _HELD.clear()
    kept = _HELD.setdefault(owner, {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches whose worker gives freed memory back when a task begins and ends; workers outlive tasks and stages."""

    @functools.wraps(run)
    def lighter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return lighter


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it trims by itself
        pass
