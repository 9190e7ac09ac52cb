"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents.  Its words become symbols: the number of a
benchmark word, or the separator for any other word and between documents.  A
window has no separator, so stretches of benchmark words shorter than the
shortest window can't hold one and are left out of the index.  The shard's
suffix array gives the Burrows-Wheeler transform; ranks come from a wavelet
matrix; all windows are searched backward together; occurrences are located by
walking to sampled suffix positions; their spans are merged by a difference
array.  Tasks pack the benchmark into blocks of bounded size.  Each block passes
through the driver by itself into a broadcast of its own, and a task searches its
shard for one block after the other, keeping a few of them unpacked: neither the
driver's Python memory nor a task's nor the plan grows with the benchmark.

Edge cases: null and empty texts have no words and no hits; items without words
have no window; items of fewer words than ``width`` are one window; rows of
one item_id are one item, rows without an item_id are no item; repeated documents are judged one by one; an
empty benchmark leaves every document clean; an empty table gives an empty
result; columns named as those that are added are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import extended, in_small_batches, stored

#: Words in a window.
WIDTH = 13
#: Characters of benchmark text in a block, and blocks that a task keeps unpacked; the others it reads again for the next shard.
BLOCK_CHARS, KEPT = 2_000_000, 4
#: Every so many text positions of a shard keep their suffix position.
SAMPLE = 8


@dataclass
class Patterns:
    """The windows of a block of benchmark items as rows of word numbers, padded by 0 on the right."""

    keys: np.ndarray  # sorted word hashes; word number = place + 1
    rows: np.ndarray
    length: np.ndarray
    owner: np.ndarray  # for each (window, item) pair the window ...
    item: np.ndarray  # ... and the item's place in ``items``
    items: list

    @classmethod
    def of(cls, items: list, texts: list[str | None], width: int) -> Patterns:
        column = pa.array([x or "" for x in texts], pa.string())
        data, off = blocks.column_bytes(column)
        data = blocks.FOLD[data]
        words = blocks.split(data, off, blocks.FOLDED_ALNUM)
        hashes = blocks.hash_spans(data, words.start, words.end)
        keys, number = np.unique(hashes, return_inverse=True)
        number = number + 1
        rows, item = [], []
        for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if hi > lo:
                take = min(width, hi - lo)
                at = np.arange(lo, hi - take + 1)[:, None] + np.arange(width)
                inside = np.arange(width) < take
                rows.append(np.where(inside, number[np.minimum(at, len(number) - 1)], 0))
                item.append(np.full(len(at), i))
        if not rows:
            z = np.zeros(0, np.int64)
            return cls(keys, np.zeros((0, width), np.int32), z, z, z, items)
        unique, owner = np.unique(np.concatenate(rows).astype(np.int32), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([owner.ravel(), np.concatenate(item)], 1), axis=0)
        return cls(keys, unique, (unique > 0).sum(1), pairs[:, 0], pairs[:, 1], items)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, h = new, 2 * h
        if h >= n or rank[order[-1]] == n - 1:
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, a level of bits for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start, at = np.zeros_like(at), at.copy()
        for level, ones, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            up, low = ones[at], ones[start]
            at = np.where(one, zeros + up, at - up)
            start = np.where(one, zeros + low, start - low)
        return at - start


class FMIndex:
    """Backward search and location over a sequence of small integers (0: separator).

    Symbols are stored one higher, behind a unique smallest end mark, which the
    step from a suffix to the one before it needs.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        self.text = np.concatenate([text + 1, [0]])
        order = suffix_array(self.text)
        self.bwt = self.text[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, (symbols + 1).bit_length())
        counts = np.bincount(self.text, minlength=symbols + 3)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = order % sample == 0
        self.place = np.cumsum(self.sampled) - 1
        self.kept = order[self.sampled]

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern; empty where lo >= hi."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.text), np.int64)
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero((length > step) & (lo < hi))
            if not len(live):
                break
            symbol = rows[live, length[live] - 1 - step] + 1
            base = self.before[symbol]
            lo[live] = base + self.wavelet.rank(symbol, lo[live])
            hi[live] = base + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one."""
        at, walked = at.copy(), np.zeros(len(at), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            symbol = self.bwt[at[open_]]
            at[open_] = self.before[symbol] + self.wavelet.rank(symbol, at[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return (self.kept[self.place[at]] + walked) % len(self.text)


def shard_words(data: np.ndarray, off: np.ndarray) -> tuple[blocks.Words, np.ndarray]:
    """Words of the shard and their hashes."""
    data = blocks.FOLD[data]
    words = blocks.split(data, off, blocks.FOLDED_ALNUM)
    return words, blocks.hash_spans(data, words.start, words.end)


def shard_hits(words: blocks.Words, hashes: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of the shard are hit, and the distinct (document row, item place) pairs."""
    none = np.zeros(0, np.int64)
    n = len(words.start)
    if not n or not len(patterns.rows):
        return np.zeros(n, bool), none, none
    slots = np.zeros(1 << 18, bool)
    slots[(patterns.keys & blocks.U(0x3FFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(slots[(hashes & blocks.U(0x3FFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(patterns.keys, hashes[maybe]), len(patterns.keys) - 1)
    same = patterns.keys[at] == hashes[maybe]
    known = maybe[same]
    number = at[same] + 1
    if not len(known):
        return np.zeros(n, bool), none, none
    doc = words.docs()
    breaks = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc[known]) != 0)) + 1
    run = np.diff(np.concatenate([[0], breaks, [len(known)]]))
    long_enough = np.repeat(run >= patterns.length.min(), run)
    if not long_enough.any():
        return np.zeros(n, bool), none, none
    # each stretch is followed by a separator
    ends = np.zeros(len(known), bool)
    ends[np.concatenate([breaks, [len(known)]]) - 1] = True
    kept, number, ends = known[long_enough], number[long_enough], ends[long_enough]
    shift = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(ends)[:-1]])
    text = np.zeros(int(shift[-1]) + 2, np.int64)
    origin = np.full(len(text), -1, np.int64)
    text[shift], origin[shift] = number, kept
    index = FMIndex(text, len(patterns.keys))
    lo, hi = index.search(patterns.rows, patterns.length)
    found = np.maximum(hi - lo, 0)
    total = int(found.sum())
    if not total:
        return np.zeros(n, bool), none, none
    window = np.repeat(np.arange(len(found)), found)
    suffix = np.repeat(lo, found) + np.arange(total) - np.repeat(np.cumsum(found) - found, found)
    start = origin[index.locate(suffix)]
    hit = blocks.cover(n, start, patterns.length[window])
    pairs = np.unique(doc[start] * len(found) + window)
    doc_at, window_at = pairs // len(found), pairs % len(found)
    first = np.searchsorted(patterns.owner, window_at)
    many = np.searchsorted(patterns.owner, window_at, side="right") - first
    place = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    pairs = np.unique(np.repeat(doc_at, many) * len(patterns.items) + patterns.item[place])
    return hit, pairs // len(patterns.items), pairs % len(patterns.items)


def packed_blocks(benchmark: DataFrame, item: str, text: str, width: int, block_chars: int) -> DataFrame:
    """One row a block: its number and its Patterns, pickled by a task.  Equal rows count once and are no hot block."""
    bench = stored(benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).distinct())
    total = bench.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    count = -(-total // block_chars)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        made = Patterns.of(group.column("item").to_pylist(), group.column("text").to_pylist(), width)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

    dealt = bench.where("text is not null").withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(count, 1))).cast("long"))
    return stored(dealt.groupBy("block").applyInArrow(pack, "block long, packed binary"))


class _Blocks:
    """The blocks as a task sees them, a few kept unpacked; the others are read again from the worker's copy of their broadcast."""

    def __init__(self, handles: list):
        self.handles, self.kept = handles, {}

    def __iter__(self) -> Iterator[Patterns]:
        for n, handle in enumerate(self.handles):
            made = self.kept.get(n)
            if made is None:
                made = pickle.loads(handle.load_from_path(handle._path))  # .value would keep every block
                if len(self.kept) < KEPT:
                    self.kept[n] = made
            yield made


FIELDS = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<start:long,end:long>>, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, share: int = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``docs`` followed by those of FIELDS.

    ``spans`` are the merged removal spans in words; a document is contaminated
    if words are hit and at least one in ``share`` of all.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]
    docs = in_small_batches(docs).drop(*[x for x in names if x in docs.columns])
    context = docs.sparkSession.sparkContext
    # one block at a time in the driver; what it has sent is no longer held by its Python process
    handles = [context.broadcast(bytes(r.packed)) for r in packed_blocks(benchmark, item, item_text, width, block_chars).select("packed").toLocalIterator()]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _Blocks(handles)
        for batch in batches:
            for lo, hi, data, off in blocks.chunks(batch.column(text)):
                words, hashes = shard_words(data, off)
                hit = np.zeros(len(words.start), bool)
                names: list[list[str]] = [[] for _ in range(hi - lo)]
                for patterns in every:
                    own, doc, place = shard_hits(words, hashes, patterns)
                    hit |= own
                    for d, p in zip(doc.tolist(), place.tolist(), strict=True):
                        names[d].append(patterns.items[p])
                yield blocks.appended(batch.slice(lo, hi - lo), **_final(words, hit, names, share))

    return docs.mapInArrow(rows, extended(docs.schema, FIELDS))


def _final(words: blocks.Words, hit: np.ndarray, names: list[list[str]], share: int) -> dict[str, pa.Array]:
    n, n_hit = words.counts, blocks.sums_by(words.first, hit)
    spans = []
    for a, b, k in zip(words.first[:-1].tolist(), words.first[1:].tolist(), n_hit.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))) if k else np.zeros(0, np.int64)
        spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
    names = [sorted(set(x)) for x in names]
    return {
        "n_words": pa.array(n, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in names], pa.int64()),
        "items": pa.array(names, pa.list_(pa.string())),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        "contaminated": pa.array((n_hit > 0) & (share * n_hit >= n)),
    }
