"""Tables that appear whole or not at all, and are never replaced by other content.

Writing has two phases. Tasks write their parts into a folder of the run's own, under a name
that readers skip, and sum a digest of the rows on the way; Spark's committer keeps only the
parts of tasks that ended. Then a manifest that names this folder is put in place by a
rename. What has no manifest doesn't exist: a job that fails leaves nothing to be seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.sources import conllu

MANIFEST = "manifest.json"


def row_digest(columns: list[str]) -> list[Column]:
    """Aggregates (rows, q0 .. q3): an order-free digest of rows, from the sums of the four quarters of each row's SHA-256.

    Dates and numbers count as Spark casts them to text; a null differs from every value, and lengths keep neighbours apart."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    value = lambda name: F.col("`" + name.replace("`", "``") + "`")
    digest = F.sha2(F.concat_ws(",", *[text(F.to_json(F.struct(value(c).alias("v")))) for c in columns]), 256)
    quarter = lambda i: F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("rows"), *[quarter(i).alias(f"q{i}") for i in range(4)]]


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published at a path; None if nothing is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    return json.loads(bytes(spark.read.format("binaryFile").load(f"{path}/{MANIFEST}").first().content))


def publish_rows(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> str:
    """Publish a table: ``written`` if nothing was there, ``unchanged`` if the same rows, schema and format were (in any order and
    number of parts); FileExistsError for anything else, which stays as it was."""
    spark = df.sparkSession
    observed = Observation()
    own = f"_data-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, own)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    kept = False
    try:
        df.observe(observed, *row_digest(df.columns)).write.format(fmt).options(**options).save(f"{path}/{own}")
        found = {"rows": observed.get["rows"], "digest": [observed.get[f"q{i}"] for i in range(4)], "format": fmt, "schema": df.schema.simpleString(), "options": options}
        here = manifest(spark, path)
        if here is None:
            content = {**found, "data": own, "fields": json.loads(df.schema.json())}
            try:
                kept = conllu.publish(spark, f"{path}/{MANIFEST}", conllu.canonical_json(content))
            except FileExistsError:  # another run came first
                kept = False
            here = content if kept else manifest(spark, path)
        if {k: here[k] for k in found} != found:
            raise FileExistsError(f"{path} holds something else")
        return "written" if kept else "unchanged"
    finally:
        if not kept:
            fs.delete(folder, True)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published table; FileNotFoundError if there is none. Parts without a manifest aren't looked at."""
    here = manifest(spark, path)
    if here is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.format(here["format"]).options(**here["options"]).schema(T.StructType.fromJson(here["fields"])).load(f"{path}/{here['data']}")
