"""A training-data pipeline over ``documents``: quality, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet into the shared folder and hands it on. All stages but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.llm import minhash, mixing, pieces, quality, secrets
from dendra.llm.common import CREATED, column, documents, labels, packed, release, save, scratch, sweep, unpacked

#: No SQL: trained scores, signatures and byte-exact piece sequences can't be written in it.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches the threshold; trained on all labels (bounded sample)."""
    model = quality.fit(docs, quality.sample(labels(spark, sf_dir), "quality", F.lit(True), quality.MAX_TRAIN))
    scored = quality.score(packed(docs), model, text_col="text", keep=["text", "row"])
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*unpacked(docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the least id stays; documents without an id stay."""
    gone = minhash.near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id")
    gone = save(gone, scratch(spark, "pipeline-copies"))
    release(spark)
    return docs.join(gone, "doc_id", "left_anti").select(*map(column, docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is replaced in the text; no document goes."""
    out = secrets.redact(docs)
    return out.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else column(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); the plan is one row per source, so texts aren't shuffled."""
    mixed = mixing.mix_documents(docs)
    place = F.struct(mixing.draw("doc_id", mixing.SEED).alias("h"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
    mixed = save(mixed.select("source", "times", place.alias("place")), scratch(spark, "pipeline-mix"))
    ends = mixed.groupBy("source").agg(F.min("times").alias("low"), F.max(F.struct("times", "place")).alias("top"))
    last = ends.select(F.struct("source", "low", F.col("top.times").alias("high"), F.col("top.place").alias("last")).alias("plan"))
    plan = save(last, scratch(spark, "pipeline-mix-plan"))
    if plan.count() <= 100_000:  # a row per source; beyond that a plain join
        plan = F.broadcast(plan)
    rows = packed(docs).join(plan, F.col("row.source").eqNullSafe(F.col("plan.source")))
    own = F.struct(mixing.draw("row.doc_id", mixing.SEED).alias("h"), F.col("row.doc_id").alias("id"), mixing.words("text").alias("size"))
    times = F.when(own <= F.col("plan.last"), F.col("plan.high")).otherwise(F.col("plan.low"))
    return rows.select("text", "row", F.explode(F.array_repeat(F.lit(1), times)).alias("again")).select(*unpacked(docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row, with an end id."""
    import public_tokenizers

    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; intermediate results go once they have been read."""
    docs, since = documents(spark, sf_dir), len(CREATED)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        docs = save(stage(spark, docs, sf_dir), path)
        sweep(spark, since, (path,))
        release(spark)
    return docs
