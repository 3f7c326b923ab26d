"""Arrays as compressed byte planes: sorted and small integers shrink, random bytes stay."""

from __future__ import annotations

import struct

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    """Equally long integer arrays as one blob."""
    import zstandard

    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns) if n else b""
    return struct.pack("<I", n) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of pack(), of the given types."""
    import zstandard

    (n,) = struct.unpack("<I", blob[:4])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out
