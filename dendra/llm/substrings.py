"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs: window hashes with the document and place of
their first occurrence, cut into buckets by hash range and sorted inside a bucket. A
batch of documents is hashed, sorted and merge-joined with the runs bucket by bucket;
windows that an earlier document holds become hits, new ones a new run, and when FAN
runs have piled up the same merge writes one compacted run in their place. Runs are
bucketed tables, so a merge shuffles the batch alone.

Hits are verified on the words: neighbouring hits with neighbouring sources are one
claim "these words of this document are those words of that one", and both documents
digest their side. A failed claim (a hash collision) sends its windows through an exact
comparison by their words.

Copies inside one map task are settled there: only the least document of equal windows
is sent on, so a passage that many documents share reaches its bucket once per task.

Defined cases: null and empty texts have no words; null ids neither remove nor lose
words; ids are expected to name one text - rows that repeat an id share its marks; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.llm.blobs import pack, unpack
from dendra.llm.common import CREATED, MOST_TASKS, buckets_for, dealt, finish, lean, release, remove, save, scratch, settings, task_count
from dendra.llm.textgrams import blocks, chained, mix, runs, sorted_groups, word_hashes

WINDOW = 13
FAN = 4
#: Where the ids are cut into batches, as shares of the documents: history grows over five batches (the fifth compacts the runs
#: of the first four) to a quarter, against which the rest arrives. A run is read again with every later batch, so early ones are small.
CUTS = (0.02, 0.05, 0.09, 0.15, 0.25)
#: Compressed input bytes per bucket: about 300,000 windows.
BUCKET_BYTES = 1 << 20
CHUNK = 4 << 20

_ROWS = "kind int, key bigint, docs binary, body binary"
_NAMES = ["kind", "key", "docs", "body"]
#: What a merge writes lies in the bucket that it read; hits carry their documents' group beside it.
_MERGED = "kind int, key bigint, grp bigint, docs binary, body binary"
_MERGED_NAMES = ["kind", "key", "grp", "docs", "body"]
_FOUND = "key bigint, grp bigint, body binary"
RUN, ENTRY, HIT = 0, 1, 2


def doc_group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


_ARROW = {"kind": pa.int32(), "key": pa.int64(), "grp": pa.int64(), "docs": pa.binary(), "body": pa.binary()}


def _emit(rows: list[tuple], names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def entry_rows(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, kind: int) -> list[tuple]:
    """Sorted hashes as one row per bucket; documents as a table and indices."""
    names, index = np.unique(doc, return_inverse=True)
    table = pack(names)
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    at = runs(bucket)
    index, pos = index.astype(np.uint32), pos.astype(np.uint32)
    small = len(names) > 64
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if small:
            own, ix = np.unique(index[lo:hi], return_inverse=True)
            if len(own) < len(names) // 2:
                out.append((kind, int(bucket[lo]), pack(names[own]), pack(h[lo:hi], ix.astype(np.uint32), pos[lo:hi])))
                continue
        out.append((kind, int(bucket[lo]), table, pack(h[lo:hi], index[lo:hi], pos[lo:hi])))
    return out


def hit_rows(doc: np.ndarray, pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray, groups: int) -> list[tuple]:
    if not len(doc):
        return []
    g = doc_group(doc, groups)
    order = np.lexsort((pos, doc, g))
    g = g[order]
    at = runs(g)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        o = order[lo:hi]
        out.append((HIT, int(g[lo]), b"", pack(doc[o], pos[o].astype(np.uint32), src[o], src_pos[o].astype(np.uint32))))
    return out


def settle(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows sorted by hash: (whether the window's document is the least with that hash, least document, its first place, group starts)."""
    at = runs(h)[:-1]
    size = np.diff(np.append(at, len(h)))
    least = np.minimum.reduceat(doc, at)
    mine = doc == np.repeat(least, size)
    place = np.minimum.reduceat(np.where(mine, pos, np.iinfo(np.int64).max), at)
    return mine, np.repeat(least, size), np.repeat(place, size), at


def _fingerprint(window: int, buckets: int, groups: int, bits: int):
    """(id, text) -> ENTRY rows of each chunk's windows and HIT rows of what the chunk settles itself."""

    def chunk(docs: list[int], hashes: list[np.ndarray], lengths: list[int]) -> list[tuple]:
        h = np.concatenate(hashes)
        if not len(h):
            return []
        doc = np.repeat(np.array(docs, np.int64), lengths)
        pos = np.concatenate([np.arange(n) for n in lengths])
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        mine, least, place, _ = settle(h, doc, pos)
        rows = entry_rows(h[mine], doc[mine], pos[mine], buckets, ENTRY)
        other = ~mine
        return rows + hit_rows(doc[other], pos[other], least[other], place[other], groups)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hashes, lengths, have = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            for first, last, raw, offsets in blocks(texts):
                s, _, h = word_hashes(raw)
                at = np.searchsorted(s, offsets)
                grams = truncate(chained(h, window), bits)
                for i in range(last - first):
                    n = int(at[i + 1] - at[i]) - window + 1
                    if n > 0 and ids[first + i] is not None:
                        docs.append(ids[first + i])
                        hashes.append(grams[at[i] : at[i] + n])
                        lengths.append(n)
                have += len(raw)
                if have >= CHUNK and docs:
                    if rows := chunk(docs, hashes, lengths):
                        yield _emit(rows)
                    docs, hashes, lengths, have = [], [], [], 0
        if docs and (rows := chunk(docs, hashes, lengths)):
            yield _emit(rows)

    return run


def truncate(h: np.ndarray, bits: int) -> np.ndarray:
    """Keep the upper bits (tests use few bits to force collisions)."""
    return h if bits == 64 else h >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _merge(buckets: int, groups: int, earlier: int, keep: bool, compact: bool):
    """One row per bucket (key, a batch's rows, the sorted entries of each earlier run) -> RUN rows of new (or all, when compacting)
    first occurrences, and HIT rows.

    Runs are sorted and share no hash, so the batch's sorted hashes are looked up in each of them in one pass."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for i in range(table.num_rows):
                key = table.column(0)[i].as_py()
                rows, parts, olds = [], [], []
                for part in table.column(1)[i].as_py() or ():
                    if part["kind"] == HIT:
                        rows.append((HIT, key, key, b"", part["body"]))
                        continue
                    parts.append(_entries(part["docs"], part["body"]))
                for k in range(earlier):
                    body = table.column(3 + 2 * k)[i].as_py()
                    if body is not None:
                        olds.append(_entries(table.column(2 + 2 * k)[i].as_py(), body))
                fresh = []
                if parts:
                    h, doc, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
                    order = np.argsort(h, kind="stable")
                    h, doc, pos = h[order], doc[order], pos[order]
                    mine, src, place, first = settle(h, doc, pos)
                    hashes, size = h[first], np.diff(np.append(first, len(h)))
                    known = np.zeros(len(hashes), bool)
                    for old_h, old_doc, old_pos in olds:
                        at = np.minimum(np.searchsorted(old_h, hashes), len(old_h) - 1)
                        found = old_h[at] == hashes
                        known |= found
                        each = np.repeat(found, size)
                        src = np.where(each, np.repeat(old_doc[at], size), src)
                        place = np.where(each, np.repeat(old_pos[at], size), place)
                    hit = ~mine | np.repeat(known, size)
                    rows += [(kind, key, group, d, body) for kind, group, d, body in hit_rows(doc[hit], pos[hit], src[hit], place[hit], groups)]
                    take = first[~known]
                    fresh = [(h[take], src[take], place[take])]
                kept = (olds if compact else []) + fresh
                if keep and kept:
                    h, doc, pos = (np.concatenate(c) for c in zip(*kept, strict=True))
                    if len(kept) > 1:
                        order = np.argsort(h, kind="stable")  # of sorted pieces: a merge
                        h, doc, pos = h[order], doc[order], pos[order]
                    if len(h):
                        rows += [(kind, b, b, d, body) for kind, b, d, body in entry_rows(h, doc, pos, buckets, RUN)]
                if rows:
                    yield _emit(rows, _MERGED_NAMES)

    return run


def _entries(docs: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place) of the windows in a row of entry_rows()."""
    names = unpack(docs, np.int64)[0]
    h, index, pos = unpack(body, np.uint64, np.uint32, np.uint32)
    return h, names[index], pos.astype(np.int64)


class FingerprintIndex:
    """Runs of window hashes in a shared folder. add() returns the hits of a batch of later documents.

    A run is a table bucketed by the same hash of the key by which a batch is exchanged, one row per key: runs are joined to the
    batch where they lie, and only the batch is shuffled."""

    def __init__(self, spark: SparkSession, buckets: int, window: int = WINDOW, bits: int = 64):
        self.spark, self.buckets, self.window, self.bits = spark, buckets, window, bits
        self.tasks = min(MOST_TASKS, task_count(spark, buckets))
        self.runs: list[tuple[str, str]] = []

    def meet(self, batch: DataFrame, whole: bool) -> DataFrame:
        """One row per bucket: its rows of the batch and its row in each run; with ``whole`` buckets that the batch doesn't touch too."""
        rows = batch.mapInArrow(_fingerprint(self.window, self.buckets, self.buckets, self.bits), _ROWS).repartition(self.tasks, "key")
        rows = rows.groupBy("key").agg(F.collect_list(F.struct("kind", "docs", "body")).alias("batch"))
        if whole:
            rows = self.spark.range(self.buckets).select(F.col("id").alias("key")).repartition(self.tasks, "key").join(rows.hint("merge"), "key", "left")
        for k, (name, _) in enumerate(self.runs):
            run = self.spark.table(name).where(F.col("kind") == RUN).select("key", F.col("docs").alias(f"docs_{k}"), F.col("body").alias(f"body_{k}"))
            rows = rows.join(run.hint("merge"), "key", "left")
        return rows

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """batch: (id bigint, text). Rows (group, blob of document, window, source document, source window)."""
        compact = keep and len(self.runs) >= FAN
        rows = self.meet(batch, compact)
        path = scratch(self.spark, "substrings-merge")
        name = "dendra_" + path.rsplit("-", 1)[1]
        with settings(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
            out = rows.mapInArrow(_merge(self.buckets, self.buckets, len(self.runs), keep, compact), _MERGED)
            out.write.partitionBy("kind").bucketBy(self.tasks, "key").sortBy("key").option("compression", "none").option("path", path).saveAsTable(name)
        del rows, out
        release(self.spark)
        empty = self.spark.createDataFrame([], _MERGED).drop("kind")  # a kind without rows has no folder yet
        empty.write.mode("append").parquet(f"{path}/kind={HIT}")
        if compact:
            self.drop()
        if keep:
            self.runs.append((name, path))
        else:
            self.spark.sql(f"DROP TABLE {name}")
        return self.spark.read.schema(_FOUND).parquet(f"{path}/kind={HIT}").select(F.col("grp").alias("key"), "body")

    def drop(self) -> None:
        """Forget the runs; the hits that lie beside them stay."""
        for name, path in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{path}/kind={RUN}")
        self.runs = []


def _claims(groups: int):
    """Hit blobs sorted by group -> claims (doc, start, n, src, src_start): n neighbouring windows with neighbouring sources."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "key"):
            key = table["key"].to_numpy()
            at = runs(key)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                parts = [unpack(table["body"][i].as_py(), np.int64, np.uint32, np.int64, np.uint32) for i in range(int(lo), int(hi))]
                doc, pos, src, place = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))
                order = np.lexsort((pos, doc))
                doc, pos, src, place = doc[order], pos[order], src[order], place[order]
                one = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])  # a window may be a hit in two ways: keep one
                doc, pos, src, place = doc[one], pos[one], src[one], place[one]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (place[1:] != place[:-1] + 1)])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(doc)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], pos[first], n, src[first], place[first])], ["doc", "start", "n", "src", "src_start"])

    return run


def _apply(window: int):
    """Rows of a group (key, kind, id, start, n, src, src_start, words): documents, their claims and what others claim of them ->
    (id, n_words, n_removed, kept_sha256, checks)."""
    check = pa.struct([("src", pa.int64()), ("src_start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for table in sorted_groups(batches, "key"):
            kind, ids = table["kind"].to_numpy(), table["id"].to_numpy(zero_copy_only=False)
            start, n, src, place = (table[c].to_numpy(zero_copy_only=False) for c in ("start", "n", "src", "src_start"))
            about: dict[int, list[int]] = {}
            for i in np.flatnonzero(kind != 0):
                about.setdefault(int(ids[i]), []).append(int(i))
            out = []
            for i in np.flatnonzero(kind == 0):
                name = table["id"][int(i)].as_py()
                words = unzip.decompress(table["words"][int(i)].as_py()).split()
                gone = np.zeros(len(words) + 1, np.int64)
                checks = []
                for j in about.get(name, ()) if name is not None else ():
                    a, m = int(start[j]), int(n[j]) + window - 1
                    if a + m > len(words):
                        continue
                    if kind[j] == 1:
                        gone[a] += 1
                        gone[a + m] -= 1
                        to = int(src[j]), int(place[j])
                    else:
                        to = name, a
                    checks.append({"src": to[0], "src_start": to[1], "n": int(n[j]), "digest": hashlib.blake2b(b" ".join(words[a : a + m]), digest_size=16).digest()})
                removed = np.cumsum(gone)[:-1] > 0
                kept = [w for w, r in zip(words, removed.tolist(), strict=True) if not r] if removed.any() else words
                out.append((name, len(words), int(removed.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), checks))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.list_(check))], ["id", "n_words", "n_removed", "kept_sha256", "checks"])

    return run


_APPLIED = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, checks array<struct<src:bigint,src_start:bigint,n:bigint,digest:binary>>"


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack_ = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack_.compress((t or "").encode("utf-8")) for t in b.column(1).to_pylist()], pa.binary())], ["id", "words"])


#: Bits of the maps by which a second look at the corpus passes over what has no failed claim: 2 MB, whatever the input.
MAP_BITS = 24
_MAP_PART = 1 << 15


def _bit_map(bits: DataFrame) -> bytes:
    """A map of MAP_BITS bits with the column ``bit`` set: at most 512 rows of 4 KB reach the driver."""
    part = F.floor(F.col("bit") / _MAP_PART).cast("int").alias("part")
    rows = bits.groupBy(part).agg(F.bitmap_construct_agg(F.col("bit") % _MAP_PART).alias("map")).collect()
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for row in rows:
        at = row["part"] * _MAP_PART // 8
        out[at : at + _MAP_PART // 8] = np.frombuffer(row["map"], np.uint8)
    return out.tobytes()


def _set_in(map_: bytes, bit: np.ndarray) -> np.ndarray:
    return np.frombuffer(map_, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 != 0


def _exact(source: DataFrame, failed: DataFrame, window: int, bits: int) -> DataFrame:
    """True hits of the windows whose hashes occur in failed claims (doc, start, n): compared by their words.

    Two looks at the texts, neither of which shuffles them. The first hashes the documents of failed claims only; the second
    hands on the words of windows whose hash may be one of theirs. Both pass over the rest by a map of a fixed size; joins on
    the ids and hashes themselves follow, so what the map lets through too much changes nothing."""
    spark = source.sparkSession

    def windows(ids_map: bytes | None, hash_map: bytes | None):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    name = b.column(0)[i].as_py()
                    if ids_map is not None and not _set_in(ids_map, np.array([name % (1 << MAP_BITS)]))[0]:
                        continue
                    raw = (b.column(1)[i].as_py() or "").encode("utf-8")
                    h = truncate(chained(word_hashes(raw)[2], window), bits)
                    pos = np.arange(len(h))
                    if hash_map is not None:
                        pos = np.flatnonzero(_set_in(hash_map, (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)))
                    words = raw.split() if hash_map is not None and len(pos) else None
                    for part in np.array_split(pos, -(-len(pos) // 10_000)) if len(pos) else ():
                        texts = [b" ".join(words[k : k + window]) for k in part] if words else [None] * len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(np.full(len(part), name, np.int64)), pa.array(part), pa.array(texts, pa.binary())], ["h", "id", "pos", "text"])

        return run

    rows, named = source.where("id is not null"), "h bigint, id bigint, pos bigint, text binary"
    bad = failed.select(F.col("doc").alias("id"), F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    own = rows.mapInArrow(windows(_bit_map(failed.select(F.pmod("doc", F.lit(1 << MAP_BITS)).alias("bit"))), None), named)
    hashes = save(own.join(bad, ["id", "pos"], "left_semi").select("h").distinct(), scratch(spark, "substrings-hashes"))
    upper = F.shiftrightunsigned("h", 64 - MAP_BITS)
    some = rows.mapInArrow(windows(None, _bit_map(hashes.select(upper.alias("bit")))), named).join(hashes, "h", "left_semi")
    some = save(some.select("id", "pos", "text"), scratch(spark, "substrings-windows"))
    least = some.groupBy("text").agg(F.min("id").alias("least"))
    # the least document's first place isn't needed: these claims are true by construction
    return some.join(least, "text").where("id > least").select(F.col("id").alias("doc"), F.col("pos").alias("start"), F.lit(1).cast("bigint").alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cuts: tuple[float, ...] = CUTS, bits: int = 64) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row; documents enter the index in batches of ascending ids, cut at these shares."""
    spark, since = docs.sparkSession, len(CREATED)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    buckets = buckets_for(docs.select(id_col, text_col), BUCKET_BYTES)
    edges = sorted(set(source.approxQuantile("id", list(cuts), 0.002))) if cuts else []
    index = FingerprintIndex(spark, buckets, window, bits)
    hits, low = [], None
    for k, high in enumerate([*edges, None]):
        part = source.where("id is not null")
        part = part.where(F.col("id") > int(low)) if low is not None else part
        part = part.where(F.col("id") <= int(high)) if high is not None else part
        hits.append(index.add(part, keep=k < len(edges)))
        low = high
    index.drop()
    rows = hits[0]
    for more in hits[1:]:
        rows = rows.union(more)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        claims = dealt(rows, buckets).mapInArrow(_claims(buckets), "doc bigint, start bigint, n bigint, src bigint, src_start bigint")
        claims = save(claims, scratch(spark, "substrings-claims"))
    applied = save(_applied(source, claims, buckets, window), scratch(spark, "substrings-applied"))
    checks = applied.select(F.explode("checks").alias("c")).groupBy("c.src", "c.src_start", "c.n").agg(F.min("c.digest").alias("a"), F.max("c.digest").alias("b"))
    wrong = checks.where("a <> b").select("src", "src_start", "n")
    if not wrong.isEmpty():
        failed = claims.join(wrong, ["src", "src_start", "n"])
        hashes_again = _exact(source, failed, window, bits)
        good = claims.join(wrong, ["src", "src_start", "n"], "left_anti").select("doc", "start", "n")
        true = good.union(hashes_again).select("doc", "start", "n", F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("src_start"))
        applied = save(_applied(source, true, buckets, window, asked=False), scratch(spark, "substrings-applied"))
    return finish(applied.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256"), "substrings-result", since)


def _applied(source: DataFrame, claims: DataFrame, groups: int, window: int, asked: bool = True) -> DataFrame:
    group = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(0))), F.lit(groups))
    null = F.lit(None).cast("bigint")
    texts = source.mapInArrow(_zip, "id bigint, words binary").select(group("id").alias("key"), F.lit(0).alias("kind"), "id", null.alias("start"), null.alias("n"), null.alias("src"), null.alias("src_start"), "words")
    none = F.lit(None).cast("binary").alias("words")
    own = claims.select(group("doc").alias("key"), F.lit(1).alias("kind"), F.col("doc").alias("id"), "start", "n", F.coalesce("src", F.lit(-1)).alias("src"), F.coalesce("src_start", F.lit(-1)).alias("src_start"), none)
    rows = texts.union(own)
    if asked:
        wanted = claims.select("src", "src_start", "n").distinct()
        rows = rows.union(wanted.select(group("src").alias("key"), F.lit(2).alias("kind"), F.col("src").alias("id"), F.col("src_start").alias("start"), "n", null.alias("src"), null.alias("src_start"), none))
    return dealt(rows, groups).mapInArrow(_apply(window), _APPLIED)
