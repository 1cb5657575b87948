"""Vectorised hashes of words, shingles and byte windows over Arrow string buffers.

A polynomial prefix hash modulo 2**64 with an odd base gives the hash of any byte
range by one subtraction and one multiplication with an inverse power; a finaliser
spreads it.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What separates runs of letters: every byte that is neither an ASCII letter nor part of a longer character.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}
_lean = False


def powers(kind: str, n: int) -> np.ndarray:
    have = _tables.get(kind)
    if have is None or len(have) < n:
        step = BASE if kind == "up" else _INVERSE
        have = np.full(max(n, 1 << 16), step, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _tables[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lean() -> None:
    """In a Python worker, which lives from task to task, once: large blocks go back to the system when
    they are freed.  The driver's process is left as it is."""
    global _lean
    if not _lean and TaskContext.get() is not None:
        _lean = True
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            pa.set_memory_pool(pa.system_memory_pool())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string or binary array; nulls are empty."""
    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of documents whose bytes come to about ``limit``; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers("up", len(buf)), out=h[1:])
    return h


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, document) of each word; documents do not run into each other."""
    if lower:
        buf = _LOWER[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    gap = gaps[buf]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = True
    after[filled[1:] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    h = prefix_hash(buf)
    hashes = mix((h[ends] - h[starts]) * powers("down", len(buf))[starts])
    return hashes, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of each run of ``k`` words; a document with fewer words
    gives its whole sequence as one, one without words none."""
    hashes, _, _, doc = words(buf, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    total = len(hashes)
    acc = np.zeros(max(0, total - k + 1), np.uint64)
    for i in range(k):
        acc = acc * BASE + hashes[i : i + len(acc)]
    whole = np.flatnonzero(doc[: len(acc)] == doc[k - 1 : k - 1 + len(acc)]) if len(acc) else np.zeros(0, np.int64)
    out, owner, at = mix(acc[whole]), doc[whole], whole
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = 0
            for w in hashes[first[d] : first[d + 1]].tolist():
                x = (x * int(BASE) + w) & 0xFFFFFFFFFFFFFFFF
            extra[i] = x
        out = np.concatenate((out, mix(extra ^ count[short].astype(np.uint64))))
        owner, at = np.concatenate((owner, short)), np.concatenate((at, first[short]))
    return out, owner, at


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) sorted by owner, then hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        keep = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner = hashes[keep], owner[keep]
    return hashes, owner


def windows(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` bytes."""
    if len(buf) < k:
        return np.zeros(0, np.uint64)
    h = prefix_hash(buf)
    return mix((h[k:] - h[:-k]) * powers("down", len(buf) + 1)[: len(buf) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by doubling."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def rows_of(owner_count: np.ndarray) -> np.ndarray:
    """Indices 0..n-1, each repeated as often as its count says."""
    return np.repeat(np.arange(len(owner_count)), owner_count)
