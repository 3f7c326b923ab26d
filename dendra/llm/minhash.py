"""Near-duplicates by SuperMinHash: banding, verification on full sets, union-find groups.

SuperMinHash walks a seeded permutation of the registers for every shingle: step j puts
j plus a fraction into the j-th register of the permutation. The ranks of one element
are thus correlated over the registers, which lowers the variance of the signature, and
an element stops as soon as its step exceeds every register's value.

1. Texts become signatures, a digest of the shingle set, and the compressed words.
2. Documents with equal sets form classes; only the least id of each goes on.
3. Signatures are cut into bands. Members of one band bucket are compared by signature
   and size alone; a pair is looked at in its first common band only.
4. Members with a promising partner get their words; full shingle sets are intersected,
   word by word without hashes, and each bucket reports its links as stars to the least
   member.
5. Stars and classes become components (distributed, ``components``).

At similarity 0.8 a pair shares none of 32 bands of 4 registers with probability 5e-8;
the signature filter drops a true link with probability below 1e-6 (five standard
deviations). Buckets beyond BLOCK members are compared as pairs of blocks.

Set sizes and classes of equal sets rest on 64-bit hashes of all shingles, which have no
regular collisions; links rest on the words.

Defined cases: null and empty texts have no set, are linked with nothing and stay; null
ids are kept without links (component null, kept true), whatever their text; repeated
rows of an id share its result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import CREATED, finish, lean, release, remove, save, scratch, small_batches
from dendra.llm.components import components
from dendra.llm.textgrams import blocks, chained, mix, runs, sequence_hash, sorted_groups, word_hashes

REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
BLOCK = 2048
DEVIATIONS = 5.0
SMALL = 2_000_000  # ids that may be broadcast


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words: the whole sequence as one; none: empty."""
    out: list[np.ndarray] = []
    for first, last, raw, offsets in blocks(texts):
        s, _, h = word_hashes(raw)
        at = np.searchsorted(s, offsets)
        grams = chained(h, k)
        for i in range(last - first):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            else:
                out.append(np.array([sequence_hash(h[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def word_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle sets by the words themselves: equal shingles of these texts, and no others, have equal numbers."""
    number: dict[tuple[bytes, ...], int] = {}
    out = []
    for t in texts:
        words = t.split()
        grams = set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()
        out.append(np.array([number.setdefault(g, len(number)) for g in grams], np.int64))
    return out


def superminhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Signatures (sets x m, uint64: step in the upper half, fraction in the lower); registers of empty sets stay at m << 32."""
    size = np.array([len(x) for x in sets], np.int64)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    registers = np.full(len(sets) * m, m << 32, np.uint64)
    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
    active = np.arange(len(h))
    for j in range(m):
        if j:
            highest = registers.reshape(-1, m).max(1) >> np.uint64(32)
            active = active[highest[owner[active]] >= j]
        if not len(active):
            break
        x = mix(h[active] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = j + ((x >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        place = order[active, pick]
        order[active, pick] = order[active, j]
        np.minimum.at(registers, owner[active] * m + place, np.uint64(j << 32) | (x & np.uint64(0xFFFFFFFF)))
    return registers.reshape(-1, m)


def sign(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, digest, bands, low, words): bands are BANDS 64-bit keys; low is the lowest byte of each register, then the lower halves of the bands; words are compressed."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [(t or "").encode("utf-8").lower() for t in batch.column(1).to_pylist()]
            for first, last, _, _ in blocks(texts, 1 << 20):
                sets = shingle_sets(texts[first:last], k)
                signature = superminhash(sets)
                bands = mix(chained_rows(signature.reshape(len(sets), BANDS, ROWS)) + np.arange(BANDS, dtype=np.uint64))
                low = np.hstack([(signature & np.uint64(255)).astype(np.uint8), bands.astype(np.uint32).view(np.uint8)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        pa.array([b.tobytes() for b in bands], pa.binary()),
                        pa.array([b.tobytes() for b in low], pa.binary()),
                        pa.array([pack.compress(t) for t in texts[first:last]], pa.binary()),
                    ],
                    ["id", "n", "digest", "bands", "low", "words"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, digest binary, bands binary, low binary, words binary")


def chained_rows(x: np.ndarray) -> np.ndarray:
    out = x[..., 0].copy()
    for j in range(1, x.shape[-1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[..., j]
    return mix(out)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], ["key", "id"])


def _similar(a_low, b_low, a_n, b_n, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity and the signatures don't speak against it."""
    p = percent / 100
    least = REGISTERS * p - DEVIATIONS * math.sqrt(REGISTERS * p * (1 - p))
    sizes = 100 * np.minimum(a_n, b_n) >= percent * np.maximum(a_n, b_n)
    return sizes & ((a_low == b_low).sum(-1) >= least)


def _promising(percent: int):
    """Rows (key, own, id, n, low) sorted by key -> (key, id) of members with a similar partner whose first common band this is."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "key"):
            key = table["key"].to_numpy()
            n = table["n"].to_numpy()
            both = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, REGISTERS + 4 * BANDS)
            low, band = both[:, :REGISTERS], np.ascontiguousarray(both[:, REGISTERS:]).view(np.uint32)
            own = table["own"].to_numpy().astype(np.uint64).astype(np.uint32)
            wanted = np.zeros(len(key), bool)
            at = runs(key)
            longest = int(np.diff(at).max())
            for d in range(1, longest):
                i = np.flatnonzero(key[d:] == key[:-d])
                for part in np.array_split(i, max(1, len(i) // 20_000)):
                    j = part + d
                    ok = _similar(low[part], low[j], n[part], n[j], percent)
                    part, j = part[ok], j[ok]
                    same = band[part] == band[j]
                    first = band[part, same.argmax(1)] == own[part]
                    wanted[part[first]] = wanted[j[first]] = True
            if wanted.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[wanted]), table["id"].filter(pa.array(wanted)).combine_chunks()], ["key", "id"])

    return run


def group_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Stars (member, least member) of the components among the sets under 100 * intersection >= percent * union; exact, by blocks of a matrix product."""
    g = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    parent = list(range(g))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if g == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * both >= percent * (n.sum() - both):
            union(0, 1)
    elif g > 2:
        values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        column = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(g), n)
        keep = shared[code]
        owner, code, width = owner[keep], column[code[keep]], int(shared.sum())
        for a in range(0, g, 512):
            rows_a = min(512, g - a)
            common = np.zeros((rows_a, g), np.float32)
            for c in range(0, width, 2048):
                inside = (code >= c) & (code < c + 2048)
                matrix = np.zeros((g, min(2048, width - c)), np.float32)
                matrix[owner[inside], code[inside] - c] = 1
                common += matrix[a : a + rows_a] @ matrix.T
            linked = 100 * common >= percent * (n[a : a + rows_a, None] + n[None] - common)
            for i, j in zip(*np.nonzero(np.triu(linked, a + 1)), strict=True):
                union(a + int(i), int(j))
    return [(i, find(i)) for i in range(g) if find(i) != i]


def _verify(k: int, percent: int):
    """Rows (key, id, words) sorted by key -> links (a, b): within each key, stars to the least id of each component."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for table in sorted_groups(batches, "key"):
            key = table["key"].to_numpy()
            ids = table["id"].to_numpy()
            at = runs(key)
            texts = table["words"].to_pylist()
            a_out, b_out = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                order = lo + np.argsort(ids[lo:hi], kind="stable")
                sets = word_sets([unpack.decompress(texts[i]) for i in order], k)
                for i, j in group_links(sets, percent):
                    a_out.append(ids[order[i]])
                    b_out.append(ids[order[j]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row. The id must be an integer; ids are compared as bigint."""
    spark, since = docs.sparkSession, len(CREATED)
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = save(sign(source, "id", "text", k), scratch(spark, "minhash-signed"))
    # classes of equal sets; the class's least id carries on
    with_set = signed.where("digest is not null and id is not null")
    classes = save(with_set.groupBy("digest").agg(F.min("id").alias("rep")), scratch(spark, "minhash-classes"))
    heads = classes.select(F.col("rep").alias("id"), F.col("digest").alias("head_digest"))
    reps_path, buckets_path, promising_path = (scratch(spark, f"minhash-{x}") for x in ("reps", "buckets", "promising"))
    reps = save(with_set.select("id", "n", "digest", "bands", "low").join(heads, "id").where("digest = head_digest").dropDuplicates(["id"]).select("id", "n", "bands", "low"), reps_path)
    release(spark)
    keyed = reps.select("id", "bands").mapInArrow(_explode, "key bigint, id bigint")
    buckets = keyed.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    # blocks of large buckets: every pair of blocks meets under a key of its own
    width = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), width).cast("int")
    pairs = F.when(width > 1, F.transform(F.sequence(F.lit(0), width - 1), lambda o: F.least(o, block) * width + F.greatest(o, block))).otherwise(F.array(F.lit(0)))
    buckets = save(buckets.select("id", F.col("key").alias("own"), F.explode(pairs).alias("pair"), width.alias("width")), buckets_path)
    release(spark)
    key = F.when(F.col("width") > 1, F.xxhash64("own", "pair")).otherwise(F.col("own"))
    members = buckets.select("id", "own", key.alias("key")).join(reps.select("id", "n", "low"), "id")
    members = members.repartition("key").sortWithinPartitions("key").select("key", "own", "id", "n", "low")
    promising = save(members.mapInArrow(_promising(percent), "key bigint, id bigint"), promising_path)
    remove(spark, reps_path)
    remove(spark, buckets_path)
    release(spark)
    wanted = promising.select("id").distinct()
    words = with_set.select("id", "words")
    if wanted.limit(SMALL + 1).count() <= SMALL:  # checked: at most SMALL ids of 8 bytes; else all words are dealt by id
        words = words.join(F.broadcast(wanted), "id", "left_semi")
    checked = promising.join(words, "id").dropDuplicates(["key", "id"])
    links = checked.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "words").mapInArrow(_verify(k, percent), "a bigint, b bigint")
    found = components(links)
    release(spark)
    head = classes.join(found, classes["rep"] == found["id"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "digest").join(head, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    return finish(out, "minhash-result", since)
