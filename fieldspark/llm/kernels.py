"""Numpy kernels shared by the text operators (run inside Arrow tasks).

Texts arrive as Arrow string columns; ``Block`` exposes the whole column as
one byte buffer with document offsets, so words and fingerprints of many
documents are computed by a few vector operations instead of a Python loop
per word.
"""

from __future__ import annotations

import ctypes
import functools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
MASK = 2**64 - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (spreads polynomial hashes over all bits)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@functools.lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


_POW: dict[str, np.ndarray] = {}


def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least n of each."""
    p, i = f"p{base}", f"i{base}"
    if p not in _POW or len(_POW[p]) < n:
        size = -(-n // (1 << 16)) * (1 << 16)
        for name, b in ((p, base), (i, pow(base, -1, 2**64))):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW[p], _POW[i]


class Rolling:
    """Polynomial prefix hash of a value sequence: any window in O(1)."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        self.pow, self.inv = _powers(n + 1, base)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * self.pow[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inv[start])

    def windows(self, start: np.ndarray, length: int) -> np.ndarray:
        return self.spans(start, start + length)


class Block:
    """A column of texts as one UTF-8 buffer; NULL texts count as empty."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        _, off, data = texts.buffers()
        off = np.frombuffer(off, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset:] \
            if n else np.zeros(1, dtype=np.int64)
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = buf[off[0]:off[-1]]
        self.offsets = off - off[0]

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text of a block.

    ``start``/``end`` are byte positions in the block, ``hash`` a 64-bit
    hash of each word's bytes (A-Z folded with ``lower=True``), ``offsets``
    the word positions at which documents begin.
    """

    def __init__(self, block: Block, lower: bool = False):
        data = block.data
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = block.offsets[:-1]
        begins = begins[begins < len(data)]
        first[begins] = inside[begins]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = begins[begins > 0] - 1
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        roll = Rolling(_byte_values(lower)[data])
        self.hash = roll.spans(self.start, self.end)
        self.offsets = np.searchsorted(self.start, block.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def tidy(run):
    """Wraps a function over Arrow batches: a finished task gives its memory
    back, as its Python worker lives on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _POW.clear()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def byte_values(data: np.ndarray) -> np.ndarray:
    return _byte_values(False)[data]


def starts_within(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window of ``length`` fits into its document, and the
    document of each."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    base = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(len(doc)) + base, doc


def split_bytes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte plane by byte plane."""
    return np.ascontiguousarray(
        a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def join_bytes(b: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def pack(*arrays: tuple[np.ndarray, int]) -> bytes:
    """(numbers, bytes kept of each) pairs of one length -> compressed payload."""
    n = len(arrays[0][0])
    raw = b"".join(split_bytes(a, w) for a, w in arrays)
    return n.to_bytes(4, "little") + bytes(pa.compress(raw, codec="zstd", asbytes=True))


def unpack(payload: bytes, *widths: int) -> list[np.ndarray]:
    n = int.from_bytes(payload[:4], "little")
    raw = pa.decompress(payload[4:], n * sum(widths), codec="zstd", asbytes=True)
    out, at = [], 0
    for w in widths:
        out.append(join_bytes(raw[at:at + n * w], n, w))
        at += n * w
    return out


def pack_sorted(positions: np.ndarray) -> bytes:
    """Ascending positions, as compressed differences."""
    return pack((np.diff(positions.astype(np.int64), prepend=0), 4))


def unpack_sorted(payload: bytes) -> np.ndarray:
    return np.cumsum(unpack(payload, 4)[0]).astype(np.int64)


def merge_spans(pos: np.ndarray, before: int, after: int, offsets: np.ndarray,
                limit: np.ndarray | None = None):
    """Union of [p - before, p + after) for ascending ``pos``, cut to each
    document (its end, or ``limit``).  Returns start, end, document."""
    doc = np.searchsorted(offsets, pos, side="right") - 1
    top = (offsets[1:] if limit is None else limit)[doc]
    start = np.maximum(pos - before, offsets[doc])
    end = np.minimum(pos + after, top)
    ok = end > start
    start, end, doc = start[ok], end[ok], doc[ok]
    if not len(start):
        return start, end, doc
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return start[at], np.concatenate([end[at[1:] - 1], end[-1:]]), doc[at]
