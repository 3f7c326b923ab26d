"""Structured Streaming over treebank rows: an extension, the batch operators are unchanged.

Row-local operators (scanning, tree algorithms, scalar functions) run as they are on a
streaming DataFrame; grouped scores run in complete or update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators import scoring
from dendra.sources import conllu


def read_files(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    """Sentences of every CoNLL-U file that arrives in a folder; a file is one unit."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return conllu.sentences(conllu.split_blocks(files, "path", "text", "lenient" if mode == "lenient" else "strict"), mode)


def running_counts(sentences: DataFrame, column: str = "deprel") -> DataFrame:
    """Counts by a token column, for complete or update mode."""
    return conllu.tokens(sentences).groupBy(column).agg(F.count("*").alias("n"))


def running_scores(arcs: DataFrame, by: str) -> DataFrame:
    """UAS and LAS by a column of a stream of aligned arcs, for complete mode."""
    return scoring.grouped(scoring.judged(arcs), by)
