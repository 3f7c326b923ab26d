"""Exact removal of repeated byte strings with suffix arrays of shards.

Every LENGTH-byte string has one anchor: its KGRAM-byte substring with the least hash,
the leftmost of equals. Equal strings have equal anchors at equal offsets, so all
occurrences of a string meet where its anchor's hash is sent to.

1. Anchors of whole texts are counted by hash; neighbouring strings with one anchor are
   one context. Only contexts whose anchor occurs again anywhere go on.
2. Documents and their contexts meet; equal contexts of a task are settled there (the
   earliest stays), the others are dealt to shards by the anchor's hash.
3. A shard settles equal contexts again. Different contexts of one anchor are cut by finer
   anchors, and what still shares one becomes the shard's text: its suffix array is built by induced sorting, the common prefix of each
   suffix with its predecessor is computed in text order (permuted), and suffixes that
   share LENGTH bytes form groups whose earliest member stays.
4. Marked ranges return to their documents.

Earlier means a smaller id, or the same id and a smaller start. Hashes only choose where
strings meet; equality is always that of bytes.

Defined cases: null and empty texts have no bytes; null ids neither remove nor lose
bytes; ids are expected to name one text - rows that repeat an id share its marks; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.blobs import pack, unpack
from dendra.llm.common import buckets_for, dealt, lean, release, remove, scratch, settings
from dendra.llm.textgrams import blocks, digits, mix, runs, sorted_groups, tables

LENGTH = 100
#: Bytes of an anchor: the longer, the fewer strings share one without being equal, and the more anchors there are (a share of
#: 2 / (LENGTH - KGRAM + 2) of all places).
KGRAM = 32
#: Inside a shard contexts are cut once more, by anchors so many bytes shorter than a string.
FINE = 8
BUCKET_BYTES = 1 << 20
#: Letters of a shard's text: anchors are added up to this size (one anchor's contexts stay together).
SHARD = 1 << 20
CHUNK = 4 << 20
PLACE_BITS = 21  # places inside a block
BLOCK = 1 << 20

ENTRY, KNOWN, FOUND = 0, 1, 2
_ROWS = "kind int, key bigint, body binary"


# ---- suffix arrays -------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last one is S."""
    change = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))
    up = np.concatenate([t[change[:-1]] < t[change[:-1] + 1], [True]])
    return np.repeat(up, np.diff(np.concatenate([[-1], change])))


def _deal(sa: np.ndarray, slot: np.ndarray, j: np.ndarray, c: np.ndarray, step: int) -> None:
    """Put suffixes j with first letters c, in order, at the next slots of their letters."""
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    at = runs(c)
    sizes = np.diff(at)
    letters = c[at[:-1]]
    rank = np.arange(len(c)) - np.repeat(at[:-1], sizes)
    if step > 0:
        sa[slot[c] + rank] = j
        slot[letters] += sizes
    else:
        sa[slot[c] - 1 - rank] = j
        slot[letters] -= sizes


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in order: larger types left to right, then smaller types right to left, a letter at a time."""
    n, starts = len(t), np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    tail = ends.copy()
    _deal(sa, tail, lms[::-1], t[lms[::-1]], -1)
    seeds = tail.copy()  # where each letter's LMS suffixes begin
    head = starts.copy()
    letters = np.flatnonzero(ends > starts)
    for c in letters:
        at = starts[c]
        while at < head[c]:  # suffixes of this letter that came from this letter come round again
            stop = head[c]
            j = sa[at:stop] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            at = stop
            if len(j):
                _deal(sa, head, j, t[j], 1)
        j = sa[seeds[c] : ends[c]] - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            _deal(sa, head, j, t[j], 1)
    for c in letters:  # LMS suffixes give way: they are induced again
        sa[seeds[c] : ends[c]] = -1
    tail = ends.copy()
    sa[0] = n - 1  # the sentinel
    for c in letters[::-1]:
        at = ends[c]
        while at > tail[c]:
            stop = tail[c]
            j = sa[stop:at][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            at = stop
            if len(j):
                _deal(sa, tail, j, t[j], -1)
        j = sa[starts[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            _deal(sa, tail, j, t[j], -1)
    return sa


def _induce_plain(t: list[int], small: list[bool], lms: list[int], ends: list[int], n_letters: int) -> list[int]:
    """The same for large alphabets, suffix by suffix."""
    n = len(t)
    sa = [-1] * n
    tail = ends[:]
    for i in reversed(lms):
        tail[t[i]] -= 1
        sa[tail[t[i]]] = i
    head = [0, *ends[:-1]]
    for x in range(n):
        j = sa[x] - 1
        if j >= 0 and not small[j]:
            c = t[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends[:]
    for x in range(n - 1, -1, -1):
        j = sa[x] - 1
        if j >= 0 and small[j]:
            c = tail[t[j]] = tail[t[j]] - 1
            sa[c] = j
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last one is a single least 0, by induced sorting, linear in the length."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    letters = int(t.max()) + 1
    ends = np.cumsum(np.bincount(t, minlength=letters))
    if letters <= 1024:
        induce = lambda order: _induce(t, small, order, ends)
    else:
        lists = t.tolist(), small.tolist(), ends.tolist()
        induce = lambda order: np.array(_induce_plain(lists[0], lists[1], order.tolist(), lists[2], letters), np.int64)
    sa = induce(lms)
    mark = np.zeros(n, bool)
    mark[lms] = True
    sorted_lms = sa[mark[sa]]
    # names: equal LMS substrings (up to and with the next LMS letter) share one
    stop = np.zeros(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1)
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = stop[a] - a == stop[b] - b
    depth, live = 0, np.flatnonzero(same)
    while len(live):
        x, y = a[live] + depth, b[live] + depth
        inside = x <= stop[a[live]]
        live, x, y = live[inside], x[inside], y[inside]
        unequal = t[x] != t[y]
        same[live[unequal]] = False
        live = live[~unequal]
        depth += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(lms):
        name_of = np.zeros(n, np.int64)
        name_of[sorted_lms] = names
        reduced = name_of[lms]  # the sentinel's name is 0 and single
        sorted_lms = lms[suffix_array(reduced)]
    return induce(sorted_lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text position, the common prefix of each suffix with its predecessor in the suffix array, up to ``most``; the last letter differs from all."""
    n = len(t)
    before = np.full(n, n - 1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.zeros(8 + most, t.dtype)]).astype(np.uint16)
    live = np.flatnonzero(before != n - 1)
    # words of eight letters first, then letter by letter
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(live):
        x, y = live + out[live], before[live] + out[live]
        ok = (words[x] == words[y]).all(1) & (out[live] + 8 <= most)
        out[live[ok]] += 8
        live = live[ok]
    live = np.flatnonzero((before != n - 1) & (out < most))
    while len(live):
        ok = (padded[live + out[live]] == padded[before[live] + out[live]]) & (out[live] < most)
        out[live[ok]] += 1
        live = live[ok]
    return out


# ---- anchors ---------------------------------------------------------------------------


def anchors(raw: bytes, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Contexts of the texts in a block (each followed by one byte): (hash of the anchor, first string, last string), by place in the block."""
    power, inverse = tables()
    a = np.frombuffer(raw, np.uint8)
    n, w = len(a), length - k + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(digits(a) * power[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    v = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < w:
        v = np.minimum(v[: len(v) - (w - size)], v[w - size :])
    place = (v & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)  # anchor of the string at each place
    ends = offsets[1:] - 1
    owner = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    inside = np.arange(len(place)) + length <= ends[owner]
    s = np.flatnonzero(inside)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (place[s[1:]] != place[s[:-1]]) | (s[1:] != s[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return h[place[s[first]]], s[first], s[last]


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cut(key: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple]:
    """One row per key from columns in any order."""
    order = np.argsort(key, kind="stable")
    at = runs(key[order])
    return [(kind, int(key[order[lo]]), pack(*[c[order[lo:hi]] for c in columns])) for lo, hi in zip(at[:-1], at[1:], strict=True)] if len(key) else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], ["kind", "key", "body"])


#: hash, document, first string, number of strings less one
_ENTRY = (np.uint64, np.int64, np.uint32, np.uint8)


def _find(length: int, k: int, buckets: int):
    """(id, text) -> ENTRY rows (contexts whose anchor the chunk holds once), KNOWN rows (hashes it holds again), FOUND rows (their contexts)."""

    def chunk(parts: list[tuple]) -> list[tuple]:
        h, doc, first, more = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(h, kind="stable")
        h, doc, first, more = h[order], doc[order], first[order].astype(np.uint32), more[order].astype(np.uint8)
        at = runs(h)
        single = np.repeat(np.diff(at) == 1, np.diff(at)) if len(h) else np.zeros(0, bool)
        rows = _cut(_bucket(h[single], buckets), ENTRY, h[single], doc[single], first[single], more[single])
        again = ~single
        known = h[at[:-1][np.diff(at) > 1]]
        rows += _cut(_bucket(known, buckets), KNOWN, known)
        return rows + _cut(_group(doc[again], buckets), FOUND, h[again], doc[again], first[again], more[again])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode("utf-8") if i is not None else b"" for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            for start, _, raw, offsets in blocks(texts, BLOCK):
                names = np.array([i if i is not None else 0 for i in ids[start : start + len(offsets) - 1]], np.int64)
                for base, piece, cut in _pieces(raw, offsets, length):
                    h, first, last = anchors(piece, cut, length, k)
                    owner = np.searchsorted(cut, first, side="right") - 1
                    parts.append((h, names[owner] if base == 0 else np.full(len(h), names[0]), first - cut[owner] + base, last - first))
                have += len(raw)
                if have >= CHUNK:
                    if rows := chunk(parts):
                        yield _batch(rows)
                    parts, have = [], 0
        if parts and (rows := chunk(parts)):
            yield _batch(rows)

    return run


def _pieces(raw: bytes, offsets: np.ndarray, length: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """A block as it is, or one long text in pieces that share length - 1 bytes: (where it begins, bytes, offsets)."""
    if len(raw) <= BLOCK or len(offsets) > 2:
        yield 0, raw, offsets
        return
    for at in range(0, max(1, len(raw) - length + 1), BLOCK):
        piece = raw[at : at + BLOCK + length - 1]
        yield at, piece, np.array([0, len(piece) + 1])


def _again(buckets: int):
    """Rows sorted by key -> FOUND rows of the contexts whose anchor occurs again anywhere."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "key"):
            key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
            at = runs(key)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                rows = [(FOUND, int(key[lo]), table["body"][i].as_py()) for i in range(int(lo), int(hi)) if kind[i] == FOUND]
                entries = [unpack(table["body"][i].as_py(), *_ENTRY) for i in range(int(lo), int(hi)) if kind[i] == ENTRY]
                if entries:
                    known = [unpack(table["body"][i].as_py(), np.uint64)[0] for i in range(int(lo), int(hi)) if kind[i] == KNOWN]
                    h, doc, first, more = (np.concatenate([e[c] for e in entries]) for c in range(4))
                    values, counts = np.unique(np.concatenate([h, *known, *known]), return_counts=True)
                    take = np.isin(h, values[counts > 1])
                    rows += _cut(_group(doc[take], buckets), FOUND, h[take], doc[take], first[take], more[take])
                if rows:
                    yield _batch(rows)

    return run


# ---- contexts and shards -----------------------------------------------------------------


def _marks(doc: list[int], start: list[int], size: list[int], groups: int) -> list[tuple]:
    d, s, n = np.array(doc, np.int64), np.array(start, np.uint32), np.array(size, np.uint32)
    order = np.lexsort((s, d))
    d, s, n = d[order], s[order], n[order]
    if not len(d):
        return []
    # neighbouring and overlapping ranges of a document become one
    stop = s.astype(np.int64) + n
    reach = np.empty_like(stop)
    at = runs(d)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        reach[lo:hi] = np.maximum.accumulate(stop[lo:hi])
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return _cut(_group(d[first], groups), FOUND, d[first], s[first], (reach[last] - s[first]).astype(np.uint32))


def _contexts(length: int, buckets: int):
    """Per group: texts and their FOUND contexts -> ENTRY rows for shards (contexts with bytes) and FOUND rows (marked ranges)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for table in sorted_groups(batches, "key"):
            kind = table["kind"].to_numpy()
            found = [unpack(table["body"][i].as_py(), *_ENTRY) for i in np.flatnonzero(kind == FOUND).tolist()]
            if not found:
                continue
            h, doc, first, more = (np.concatenate([f[c] for f in found]) for c in range(4))
            order = np.lexsort((first, doc))
            h, doc, first, more = h[order], doc[order], first[order].astype(np.int64), more[order].astype(np.int64)
            texts = {table["id"][i].as_py(): i for i in np.flatnonzero(kind == 0).tolist()}
            at = runs(doc)
            seen: dict[bytes, int] = {}
            marks: tuple[list, list, list] = ([], [], [])
            take, bodies = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):  # ids ascend, starts ascend: the first one seen is the earliest
                name = int(doc[lo])
                raw = unzip.decompress(table["body"][texts[name]].as_py())
                for i, a, m in zip(range(int(lo), int(hi)), first[lo:hi].tolist(), more[lo:hi].tolist(), strict=True):
                    body = raw[a : a + m + length]
                    if body in seen:
                        marks[0].append(name)
                        marks[1].append(a)
                        marks[2].append(len(body))
                    else:
                        seen[body] = i
                        take.append(i)
                        bodies.append(body)
            t = np.array(take)
            b = _bucket(h[t], buckets)
            order = np.argsort(b, kind="stable")
            cut = runs(b[order])
            rows = _marks(*marks, buckets)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = order[lo:hi]
                x = t[own]
                head = pack(h[x], doc[x], first[x].astype(np.uint32), more[x].astype(np.uint8))
                rows.append((ENTRY, int(b[own[0]]), len(head).to_bytes(4, "little") + head + zip_.compress(b"".join(bodies[j] for j in own.tolist()))))
            if rows:
                yield _batch(rows)

    return run


def _first_seen(doc: np.ndarray, first: np.ndarray, bodies: list[bytes], marks: tuple[list, list, list]) -> np.ndarray:
    """Places of the different bodies; those seen before, in order of document and start, are marked."""
    seen: set[bytes] = set()
    own = []
    for i, body in enumerate(bodies):
        if body in seen:
            marks[0].append(int(doc[i]))
            marks[1].append(int(first[i]))
            marks[2].append(len(body))
        else:
            seen.add(body)
            own.append(i)
    return np.array(own, np.int64)


def _shared(h: np.ndarray) -> np.ndarray:
    values, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    return counts[back] > 1


def finer(x: np.ndarray, h: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Contexts x cut by anchors of FINE bytes: (key, context, offset, strings less one) of the parts whose key occurs twice.

    Equal strings have equal fine anchors too, so a frequent anchor that stands in thousands of surroundings falls apart here."""
    parts = []
    for lo, _, raw, offsets in blocks([bodies[i] for i in x.tolist()], BLOCK):
        g, a, b = anchors(raw, offsets, length, length - FINE)
        owner = np.searchsorted(offsets, a, side="right") - 1
        i = x[lo + owner]
        parts.append((mix(h[i]) ^ g, i, a - offsets[owner], b - a))
    key, i, offset, more = (np.concatenate([p[c] for p in parts]) for c in range(4))
    keep = _shared(key)
    return key[keep], i[keep], offset[keep], more[keep]


def shard_marks(h: np.ndarray, doc: np.ndarray, first: np.ndarray, bodies: list[bytes], length: int) -> tuple[list, list, list]:
    """Ranges (document, start, size) of contexts that are repeated; contexts come in order of document and start."""
    marks: tuple[list, list, list] = ([], [], [])
    x = _first_seen(doc, first, bodies, marks)
    x = x[_shared(h[x])]  # different contexts of one anchor
    if not len(x):
        return marks
    x = x[np.argsort(h[x], kind="stable")]
    at, upto = runs(h[x]), np.cumsum([len(bodies[i]) + 1 for i in x.tolist()])
    lo = 0
    for hi in at[1:].tolist():
        if hi == len(x) or upto[hi - 1] - (upto[lo - 1] if lo else 0) >= SHARD:
            _cut_and_mark(np.sort(x[lo:hi]), h, doc, first, bodies, length, marks)
            lo = hi
    return marks


def _cut_and_mark(x: np.ndarray, h: np.ndarray, doc: np.ndarray, first: np.ndarray, bodies: list[bytes], length: int, marks: tuple[list, list, list]) -> None:
    key, i, offset, more = finer(x, h, bodies, length)
    if not len(key):
        return
    doc, first = doc[i], first[i] + offset
    parts = [bodies[j][o : o + m + length] for j, o, m in zip(i.tolist(), offset.tolist(), more.tolist(), strict=True)]
    own = _first_seen(doc, first, parts, marks)
    own = own[_shared(key[own])]
    if len(own):
        _mark_shard(own, doc, first, parts, length, marks)


def _mark_shard(x: np.ndarray, doc: np.ndarray, first: np.ndarray, bodies: list[bytes], length: int, marks: tuple[list, list, list]) -> None:
    # letters 2..257 and a separator 1 after each context; strings never reach over it
    sizes = np.array([len(bodies[i]) for i in x.tolist()])
    text = np.frombuffer(b"".join(bodies[i] for i in x.tolist()), np.uint8).astype(np.int64) + 2
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + np.arange(len(x))
    t = np.concatenate([np.insert(text, np.cumsum(sizes), 1), [0]])
    _, t = np.unique(t, return_inverse=True)  # bytes in use, in order; the sentinel stays 0
    sa = suffix_array(t)
    prefix = common_prefixes(t, sa, length)
    owner = np.append(np.repeat(np.arange(len(x)), sizes + 1), 0)
    offset = np.arange(len(t)) - at[owner]
    starts_string = (offset + length <= sizes[owner]) & (np.arange(len(t)) < len(t) - 1)
    # groups of suffixes that share a whole string
    group = np.cumsum(prefix[sa] < length)
    chosen = starts_string[sa]
    place, group = sa[chosen], group[chosen]
    d, s = doc[x[owner[place]]], first[x[owner[place]]] + offset[place]
    order = np.lexsort((s, d, group))
    group, d, s = group[order], d[order], s[order]
    late = np.concatenate([[False], group[1:] == group[:-1]])
    late[1:] &= (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | late[:-1]
    marks[0].extend(d[late].tolist())
    marks[1].extend(s[late].tolist())
    marks[2].extend([length] * int(late.sum()))


def _shards(length: int, buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for table in sorted_groups(batches, "key"):
            key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
            at = runs(key)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                rows, heads, bodies = [], [], []
                for i in range(int(lo), int(hi)):
                    blob = table["body"][i].as_py()
                    if kind[i] == FOUND:
                        rows.append((FOUND, int(key[i]), blob))
                        continue
                    n = int.from_bytes(blob[:4], "little")
                    head = unpack(blob[4 : 4 + n], *_ENTRY)
                    raw, edge = unzip.decompress(blob[4 + n :]), 0
                    for m in head[3].tolist():
                        bodies.append(raw[edge : edge + m + length])
                        edge += m + length
                    heads.append(head)
                if heads:
                    h, doc, first = (np.concatenate([x[c] for x in heads]) for c in range(3))
                    order = np.lexsort((first, doc))
                    marks = shard_marks(h[order], doc[order], first[order].astype(np.int64), [bodies[j] for j in order.tolist()], length)
                    rows += _marks(*marks, buckets)
                if rows:
                    yield _batch(rows)

    return run


@lean
def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group: texts and marked ranges -> (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    for table in sorted_groups(batches, "key"):
        kind = table["kind"].to_numpy()
        marks: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(kind == FOUND).tolist():
            d, s, n = unpack(table["body"][i].as_py(), np.int64, np.uint32, np.uint32)
            for x, a, m in zip(d.tolist(), s.tolist(), n.tolist(), strict=True):
                marks.setdefault(x, []).append((a, a + m))
        out = []
        for i in np.flatnonzero(kind == 0).tolist():
            name = table["id"][i].as_py()
            raw = unzip.decompress(table["body"][i].as_py())
            at, spans, kept, gone = 0, 0, [], 0
            for a, b in sorted(marks.get(name, ())) if name is not None else ():
                b = min(b, len(raw))
                if a > at or (a == at and spans == 0):
                    spans += a < b
                    kept.append(raw[at:a])
                if b > at:
                    gone += b - max(a, at)
                    at = b
            kept.append(raw[at:])
            out.append((name, len(raw), gone, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        if out:
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _zipped(groups: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0)
            key = _group(np.array([i if i is not None else 0 for i in ids.to_pylist()], np.int64), groups)
            bodies = [zip_.compress((t or "").encode("utf-8")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(key), pa.array(bodies, pa.binary()), ids], ["kind", "key", "body", "id"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    buckets = buckets_for(docs.select(id_col, text_col), BUCKET_BYTES)
    texts = source.mapInArrow(_zipped(buckets), _ROWS + ", id bigint")
    null = F.lit(None).cast("bigint").alias("id")

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        found = scratch(spark, "suffixes-found")
        dealt(source.mapInArrow(_find(length, k, buckets), _ROWS), buckets).mapInArrow(_again(buckets), _ROWS).write.option("compression", "none").parquet(found)
        release(spark)
        marked = scratch(spark, "suffixes-marked")
        contexts = dealt(texts.union(spark.read.schema(_ROWS).parquet(found).select("kind", "key", "body", null)), buckets).mapInArrow(_contexts(length, buckets), _ROWS)
        dealt(contexts, buckets, 4).mapInArrow(_shards(length, buckets), _ROWS).write.option("compression", "none").parquet(marked)
        remove(spark, found)
        del contexts
        release(spark)
        stripped = scratch(spark, "suffixes-stripped")
        dealt(texts.union(spark.read.schema(_ROWS).parquet(marked).select("kind", "key", "body", null)), buckets).mapInArrow(_strip, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").write.parquet(stripped)
        remove(spark, marked)
        release(spark)
    return spark.read.parquet(stripped).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
