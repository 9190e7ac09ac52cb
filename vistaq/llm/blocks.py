"""Byte-level text kernels on Arrow string columns.

A string column of an Arrow batch is one byte buffer with offsets, so a slice of
many documents is split into words and hashed by a handful of NumPy calls, with
no Python object per word.  All separators used here are ASCII, and every byte
of a multi-byte UTF-8 sequence is above 0x7F, so byte classes equal character
classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one round of NumPy calls (a longer document is a round of its own).
CHUNK_BYTES = 1_000_000
#: Bytes hashed at once; bounds the table of powers.
SEGMENT = 1 << 18

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables[name] = {
            "up": lambda: _powers(_BASE, SEGMENT + 1),
            "down": lambda: _powers(_INVERSE, SEGMENT + 1),
            "byte": lambda: mix64(np.arange(1, 257, dtype=U) * _BASE),
        }[name]()
    return _tables[name]


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: [^\x20\x09-\x0D]
VISIBLE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of text whose A-Z are lower-cased
FOLDED_ALNUM = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: everything but \n
IN_LINE = ~_class((0x0A, 0x0A))
#: A-Z to a-z
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over slices of at most ``limit`` bytes, or of one row."""
    data, off = column_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice of documents: byte spans, and where each document's words begin (n + 1 entries)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document's row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``word``, never across two documents."""
    inside = word[data]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    begins[off[:-1][full]] = inside[off[:-1][full]]
    ends[off[1:][full] - 1] = inside[off[1:][full] - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint ascending byte spans, equal for equal bytes wherever they stand."""
    out = np.zeros(len(start), U)
    at = 0
    up, down, byte = _table("up"), _table("down"), _table("byte")
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT, side="right")))
        if end[stop - 1] - start[at] > SEGMENT:  # one very long span
            out[at] = _hash_long(data[start[at] : end[at]])
        else:
            base = start[at]
            part = byte[data[base : end[stop - 1]]] * up[: end[stop - 1] - base]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=sums[1:])
            s, e = start[at:stop] - base, end[at:stop] - base
            out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return mix64(out + (end - start).astype(U) * _LENGTH)


def _hash_long(span: np.ndarray) -> np.uint64:
    up, byte = _table("up"), _table("byte")
    total, scale, step = U(0), U(1), U(pow(int(_BASE), SEGMENT, 1 << 64))
    with np.errstate(over="ignore"):
        for i in range(0, len(span), SEGMENT):
            part = span[i : i + SEGMENT]
            total = total + scale * np.sum(byte[part] * up[: len(part)], dtype=U)
            scale = scale * step
    return total


def hash_texts(texts: list[bytes]) -> np.ndarray:
    """The same hashes for separate byte strings."""
    length = np.array([len(x) for x in texts], np.int64)
    end = np.cumsum(length)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return hash_spans(data, end - length, end) if len(texts) else np.zeros(0, U)


#: Odd and 3 mod 8, so that differences of its powers have few factors of two.
_STEP = U(0xC2B2AE3D27D4EB4B)
_STEP_INVERSE = U(pow(0xC2B2AE3D27D4EB4B, -1, 1 << 64))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``width`` consecutive words of one document.

    Returns the hashes and the position of each window's first word.  A prefix
    sum of word hash times power gives each window by one subtraction, and the
    inverse power removes its position.
    """
    n = len(hashes)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, U), np.zeros(0, np.int64)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    out = np.zeros(total, U)
    lo = 0
    while lo < total:  # powers for SEGMENT words at a time
        base = begin[lo]
        hi = int(np.searchsorted(begin, base + SEGMENT - width, side="right"))
        part = hashes[base : min(n, begin[hi - 1] + width)] * _window_table("up")[: min(n, begin[hi - 1] + width) - base]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=sums[1:])
        s = begin[lo:hi] - base
        out[lo:hi] = (sums[s + width] - sums[s]) * _window_table("down")[s]
        lo = hi
    return mix64(out + U(width)), begin


def _window_table(name: str) -> np.ndarray:
    key = f"window {name}"
    if key not in _tables:
        _tables[key] = _powers(_STEP if name == "up" else _STEP_INVERSE, SEGMENT + 1)
    return _tables[key]


def cover(n: int, start: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in any span [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return np.cumsum(edge[:-1]) > 0


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each span [first[i], first[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns."""
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)
