"""Scalar column expressions over dependency annotations. All are pure Columns but nfc()."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base_relation(deprel: Column) -> Column:
    """Label without its subtype."""
    return F.substring_index(deprel, ":", 1)


def distance(token: Column, head: Column) -> Column:
    """0 for ROOT, else the distance between a word and its head."""
    return F.when(head == 0, F.lit(0)).otherwise(F.abs(token - head))


def distance_bucket(token: Column, head: Column) -> Column:
    d = distance(token, head)
    return F.when(head == 0, "ROOT").when(d <= 2, "1-2").when(d <= 5, "3-5").otherwise("6+")


def distance_bucket_fine(token: Column, head: Column) -> Column:
    d = distance(token, head)
    return F.when(head == 0, "ROOT").when(d == 1, "1").when(d == 2, "2").when(d <= 5, "3-5").when(d <= 10, "6-10").otherwise("11+")


def bucket_rank(bucket: Column) -> Column:
    """Order of either bucket scale, for sorting reports."""
    order = ["ROOT", "1", "1-2", "2", "3-5", "6+", "6-10", "11+"]
    return F.array_position(F.array(*[F.lit(x) for x in order]), bucket).cast("int")


def direction(token: Column, head: Column) -> Column:
    """head_left: the head stands before the word."""
    return F.when(head == 0, "ROOT").when(head < token, "head_left").otherwise("head_right")


def head_lookup(values: Column, head: Column, missing: str | None = None) -> Column:
    """The head's value from a sentence's array: ROOT for head 0; ``missing`` (or null) where there is no such word."""
    found = F.try_element_at(values, F.when(head > 0, head).otherwise(F.lit(None)))
    return F.when(head == 0, "ROOT").otherwise(F.coalesce(found, F.lit(missing)) if missing is not None else found)


def source_name(sent_id: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """Document name of a numeric sentence id, by inclusive ranges; null for ids that aren't digits or lie outside."""
    n = F.when(sent_id.rlike("^[0-9]+$"), sent_id.try_cast("bigint"))
    out = F.lit(None).cast("string")
    for low, high, name in reversed(ranges):
        out = F.when(n.between(low, high), name).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function; ASCII and plain Han text never reaches Python's slow path of normalize()."""
    return _nfc(text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def compact_json(values: Column) -> Column:
    return F.to_json(values)


def exact_key(forms: Column) -> Column:
    return F.sha2(F.to_json(forms), 256)


def joined_key(forms: Column) -> Column:
    return F.sha2(F.array_join(forms, ""), 256)


def source_key(dataset: str, version: str, position: Column, block_sha256: Column) -> Column:
    return F.format_string("%s:%s:%04d:%s", F.lit(dataset), F.lit(version), position, F.substring(block_sha256, 1, 16))


def pair_number(parallel_id: Column) -> Column:
    """The integer after the last slash."""
    return F.substring_index(parallel_id, "/", -1).try_cast("int")


def id_kind(token_id: Column) -> Column:
    """word, multiword (n-m), empty (n.m), or null for anything else."""
    return F.when(token_id.rlike("^[0-9]+$"), "word").when(token_id.rlike("^[0-9]+-[0-9]+$"), "multiword").when(token_id.rlike("^[0-9]+[.][0-9]+$"), "empty")


def safe_field(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("_"))


def join_forms(forms: Column, separator: str = "") -> Column:
    return F.array_join(forms, separator)


def percent(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.try_divide(100.0 * part, whole)


def rate(part: Column, whole: Column, per: float = 1000.0) -> Column:
    return F.try_divide(per * part, whole)


def segments(ids: Column, separators: tuple[int, ...], end: int, specials: tuple[int, ...] = ()) -> Column:
    """Struct of words (arrays of ids between separators, special ids left out), separators, empty_segments, ended, and well_formed: ended without an empty segment. No ids at all are no segments, not an empty one."""
    kept = F.filter(ids, lambda x: ~x.isin(list(specials))) if specials else ids
    cuts = F.filter(F.transform(kept, lambda x, i: F.when(x.isin(list(separators)), i)), lambda i: i.isNotNull())
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda i: i + 1))
    ends = F.concat(cuts, F.array(F.size(kept)))
    parts = F.zip_with(begins, ends, lambda a, b: F.slice(kept, a + 1, b - a))
    parts = F.when(F.size(kept) > 0, parts).otherwise(F.array().cast("array<array<int>>"))
    empty = F.size(F.filter(parts, lambda w: F.size(w) == 0))
    ended = F.array_contains(ids, end)
    return F.struct(F.filter(parts, lambda w: F.size(w) > 0).alias("words"), F.size(cuts).alias("separators"), empty.alias("empty_segments"), ended.alias("ended"), (ended & (empty == 0)).alias("well_formed"))


def boundary_positions(ids: Column, separator: int, end: int, words: Column) -> Column:
    """0-based places after which words end: every separator, then the first end id behind them. Null unless there are words - 1 separators and such an end."""
    at = lambda value: F.filter(F.transform(ids, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())
    seps = at(separator)
    last = F.array_min(F.filter(at(end), lambda i: i > F.coalesce(F.array_max(seps), F.lit(-1))))
    return F.when((F.size(seps) == words - 1) & last.isNotNull(), F.concat(seps, F.array(last)))


def with_fallback(value: Column, known: Column, fallback: str) -> Column:
    """The value where it is known (a non-null vocabulary match), else the fallback label."""
    return F.when(known.isNotNull(), value).otherwise(F.lit(fallback))
