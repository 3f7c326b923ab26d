"""Vectorised word and byte hashes of whole texts, and streaming over sorted groups.

Hashes are 64-bit and depend only on the bytes hashed, never on where they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; bounds memory for any length of text.
PIECE = 1 << 20
LONG_WORD = 1 << 16
#: Longer words are hashed by BLAKE2b: polynomials modulo 2^64 have regular collisions from about a thousand letters on.
POLYNOMIAL = 256

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    if not _TABLES:
        n = PIECE + 2 * LONG_WORD + 2
        _TABLES.extend([_powers(_MULT, n), _powers(pow(_MULT, -1, 1 << 64), n)])
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(a: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~gap[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def digits(a: np.ndarray) -> np.ndarray:
    """Bytes as the digits 1..256 of a polynomial: none is 0, so no two words of any lengths are the same polynomial."""
    return a.astype(np.uint64) + np.uint64(1)


def word_hashes(raw: bytes, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words (runs without gap bytes; space and controls unless others are given) of a text of any length."""
    power, inverse = tables()
    starts, ends, hashes = [], [], []
    at, n = 0, len(raw)
    whole = np.frombuffer(raw, np.uint8)
    while at < n:
        a = whole[at : at + PIECE]
        if at + PIECE < n:  # cut after the last gap; a word over a whole piece is taken with its rest
            gaps = np.flatnonzero(gap[a[-LONG_WORD:]])
            if len(gaps):
                a = a[: len(a) - min(LONG_WORD, len(a)) + int(gaps[-1]) + 1]
            else:
                rest = np.flatnonzero(gap[whole[at + len(a) :]])
                a = whole[at : at + len(a) + (int(rest[0]) if len(rest) else n)]
        s, e = _spans(a, gap)
        if len(a) < len(power):
            sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(digits(a) * power[: len(a)], out=sums[1:])
            h = mix((sums[e] - sums[s]) * inverse[s])
        else:
            h = np.zeros(len(s), np.uint64)
            for k in np.flatnonzero(e - s < POLYNOMIAL):
                w = digits(a[s[k] : e[k]])
                h[k] = mix(np.array([(w * power[: len(w)]).sum(dtype=np.uint64)]))[0]
        for k in np.flatnonzero(e - s >= POLYNOMIAL):
            h[k] = int.from_bytes(hashlib.blake2b(a[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at += len(a)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def blocks(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Neighbouring texts joined by line feeds, about ``size`` bytes at a time: (first, one past the last, joined, where each begins)."""
    first, have = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (have and have + len(texts[i]) > size):
            if i > first:
                part = texts[first:i]
                offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
                yield first, i, b"\n".join(part), offsets
            first, have = i, 0
        if i < len(texts):
            have += len(texts[i]) + 1


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring hashes: element i covers i .. i+k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_MULT)
        out += h[j : j + n]
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a short sequence as a whole, apart from all k-grams."""
    return chained(np.concatenate([h, np.array([len(h) + 0x5EED], np.uint64)]), len(h) + 1)[0]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``key``: a group that a batch cuts is carried on."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        keys = b.column(b.schema.get_field_index(key))
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values == values[-1])[0]) if values[0] != values[-1] else 0
        if cut == 0:
            if held:
                last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
                if last != keys[0].as_py():
                    yield pa.Table.from_batches(held)
                    held = []
            held.append(b)
            continue
        head = b.slice(0, cut)
        if held:
            yield pa.Table.from_batches([*held, head])
        else:
            yield pa.Table.from_batches([head])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, with the length at the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
