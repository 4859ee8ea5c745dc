"""Vectorised text primitives shared by the Arrow operators of this package.

Everything works on the UTF-8 buffer of an Arrow string column: no Python object is
made per word.  A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; no
byte of a multi-byte UTF-8 character is in that set, so byte scanning is exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time; temporaries are a small multiple of it.
CHUNK_BYTES = 2 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lane(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words from a seed, the same on every machine."""
    start = _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        return mix(start + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Texts:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = n

    def raw(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Word spans of some texts: starts, ends, the row of each, and first[i] the first word of row i.

    between marks the bytes that part words."""

    def __init__(self, texts: Texts, between: np.ndarray = _SPACE):
        buf, offsets = texts.buf, texts.offsets
        self.texts = texts
        self.is_word = ~between[buf]
        edge = np.empty(len(buf) + 1, dtype=bool)
        edge[:-1] = ~self.is_word
        edge[-1] = True
        begin = self.is_word.copy()
        begin[1:] &= edge[:-2] if len(buf) else edge[:0]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        begin[inner] = self.is_word[inner]
        end = self.is_word & edge[1:]
        end[inner - 1] = self.is_word[inner - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(texts.n), self.count)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower folds A-Z."""
        buf = self.texts.buf
        return span_hashes(fold(buf) if lower else buf, self.starts, self.ends, which)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of row i, or those marked in keep (over all words), joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep[a:b]], e[keep[a:b]]
        buf = self.texts.buf
        return b" ".join([buf[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)])


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in a byte array; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte spans, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, _U)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(_U) + _U(0x9E6C63D0876A9A35 if which == 0 else 0xC2B2AE3D27D4EB4F))
    h = mix(h ^ (eight[starts] & _KEEP[np.minimum(length, 8)]))
    more = np.flatnonzero(length > 8)
    at = 8
    while len(more):
        rest = length[more] - at
        h[more] = mix(h[more] * _U(0xA0761D6478BD642F) ^ (eight[starts[more] + at] & _KEEP[np.minimum(rest, 8)]))
        at += 8
        more = more[rest > 8]
    return h


def span_strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans of UTF-8 text as strings."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)])
    data = buf[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, length)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def joined_hash(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of a sequence from those of its two parts, in order."""
    c, d = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB) if which == 0 else (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
    return mix(a * _U(c) + mix(b ^ _U(d)))


def window_hashes(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every window of size consecutive entries, by doubling.  Windows across rows are the caller's to mask."""
    if len(h) < size:
        return np.zeros(0, _U)
    out, done, level, width = None, 0, h, 1
    todo = size
    while todo:
        if todo & 1:
            if out is None:
                out = level
            else:  # windows so far, then this one
                n = len(h) - (done + width) + 1
                out = joined_hash(out[:n], level[done : done + n], which)
            done += width
        todo >>= 1
        if todo:
            level = joined_hash(level[:-width], level[width:], which) if len(level) > width else level[:0]
            width *= 2
    return out[: len(h) - size + 1]


def bit_majorities(h: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of count hashes from at on: a word with the bits that more than half of them have.

    Bits are counted eight at a time in the bytes of a word, over pieces of at most 255 hashes that cannot overflow.
    """
    pieces = -(-count // 255)
    first = np.cumsum(pieces) - pieces
    step = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    begin = np.repeat(at, pieces) + 255 * step
    out = np.zeros(len(count), dtype=_U)
    for k in range(8):
        eight = np.add.reduceat((h >> _U(k)) & _U(0x0101010101010101), begin).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(eight, first, axis=0, dtype=np.int64) if len(begin) > len(first) else eight.astype(np.int64)
        more = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").reshape(-1).astype(_U)
        # bit of byte lane i is bit 8 i + k
        for i in range(8):
            out |= (more >> _U(i) & _U(1)) << _U(8 * i + k)
    return out


def valid_windows(words: Words, size: int) -> np.ndarray:
    """Of all windows over the concatenated words, those inside one row."""
    n = len(words) - size + 1
    return words.row[:n] == words.row[size - 1 :] if n > 0 else np.zeros(0, bool)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most limit bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = Texts(batch.column(batch.schema.get_field_index(column))).offsets[1:]
        i = 0
        while i < n:
            base = at[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(at, base + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j


def release() -> None:
    """Gives freed memory back at the end of a task, as the worker process lives on beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: their lengths, types and bytes."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes | pa.Buffer) -> list[np.ndarray]:
    blob = memoryview(blob)
    n = int.from_bytes(blob[:4], "little")
    at, out = 4 + n, []
    for part in bytes(blob[4:at]).decode().split(";"):
        kind, count = part.split(",")
        d = np.dtype(kind)
        out.append(np.frombuffer(blob, dtype=d, count=int(count), offset=at))
        at += d.itemsize * int(count)
    return out


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    change = np.empty(len(sorted_values), dtype=bool)
    change[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=change[1:])
    return np.flatnonzero(change)
