"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

Documents are dealt into blocks by a hash of the row and of the task that read
it, so that a row repeated without end is no hot block.  A block hashes all its
windows and sends its distinct window hashes, packed by hash range, to the
counting step, so a passage that stands in a third of all rows arrives once for
each block, not once for each row.  The count answers every block with one bit a
hash (seen in another block too); the block adds its own repeats and cuts the
maximal intervals of covered words.  Hashes have 64 bits.

Blocks and ranges both grow with the data, so packed rows would grow with its
square.  From more than ``COARSE`` ranges on there are two levels: blocks send
coarse ranges, and groups of blocks merge these, mark what repeats inside the
group and send its distinct hashes on in fine ranges; the answers come back the same way.

Edge cases: null and empty texts have no words; a text shorter than the window
has no window and stays; repeated rows repeat all their windows and lose them
all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import as_text, text_bytes

WIDTH = 35
#: Estimated bytes of stored text in a block, and in a range of hashes.
BLOCK_BYTES = 3_000_000
RANGE_BYTES = 12_000_000
#: Ranges up to which one level of counting does; with two, the coarse ranges.
COARSE = 4096
#: Most tasks that an exchange is dealt to on its own account.
MAX_TASKS = 20_000


def _edges(lo: int, hi: int, n: int) -> np.ndarray:
    """Where each of n equal parts of [lo, hi) of the 64-bit space begins."""
    return np.array([lo + (hi - lo) * i // n for i in range(n)], blocks.U)


def _ranges(hashes: np.ndarray, n: int, lo: int = 0, hi: int = 1 << 64) -> np.ndarray:
    """Where each of n equal parts of [lo, hi) begins among sorted hashes of it; n + 1 entries."""
    return np.concatenate([np.searchsorted(hashes, _edges(lo, hi, n)), [len(hashes)]])


def block_windows(column: pa.Array, width: int) -> tuple[blocks.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column; begin and hash of its windows; the distinct hashes, ascending."""
    data, off = blocks.column_bytes(column)
    words = blocks.split(data, off, blocks.VISIBLE)
    hashes = blocks.hash_spans(data, words.start, words.end)
    found, begin = blocks.windows(hashes, words.first, width)
    return words, begin, found, np.unique(found)


def _send(width: int, n_ranges: int):
    def rows(key: tuple, group: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table:
        _, _, _, distinct = block_windows(group.column("text"), width)
        at = _ranges(distinct, n_ranges)
        used = np.flatnonzero(np.diff(at))
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(used), pa.int64()),
            "range": pa.array(used, pa.int64()),
            "hashes": pa.array([distinct[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()),
        })

    return rows


def _repeated(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes that are in two parts or more, ascending."""
    every = np.sort(np.concatenate(parts))
    return np.unique(every[1:][every[1:] == every[:-1]])


def _among(part: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which hashes of the part are among the sorted ones."""
    if not len(sorted_):
        return np.zeros(len(part), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, part), len(sorted_) - 1)] == part


def _hashes(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, blocks.U) for x in group.column("hashes").to_pylist()]


def _answers(group: pa.Table, masks: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": group.column("block"), "range": group.column("range"), "shared": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())})


def _count(key: tuple, group: pa.Table) -> pa.Table:
    """For each block's hashes of one range: which of them another block has."""
    parts = _hashes(group)
    shared = _repeated(parts)
    return _answers(group, [_among(part, shared) for part in parts])


def _merge(coarse: int, fine: int):
    """The hashes of one coarse range in a group of blocks: distinct ones, in ``fine`` parts."""

    def rows(key: tuple, group: pa.Table) -> pa.Table:
        own, part = key[0].as_py(), key[1].as_py()
        distinct = np.unique(np.concatenate(_hashes(group)))
        at = _ranges(distinct, fine, *_span(part, coarse))
        used = np.flatnonzero(np.diff(at))
        # "block" is the group here, and the range a fine one
        return pa.table({
            "block": pa.array([own] * len(used), pa.int64()),
            "range": pa.array(part * fine + used, pa.int64()),
            "hashes": pa.array([distinct[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()),
        })

    return rows


def _span(part: int, coarse: int) -> tuple[int, int]:
    return (part << 64) // coarse, ((part + 1) << 64) // coarse


def _answer_blocks(coarse: int, fine: int):
    """The answers for the group's blocks, from those for the group and from what its blocks share."""

    def rows(key: tuple, group: pa.Table, masks: pa.Table) -> pa.Table:
        parts = _hashes(group)
        distinct = np.unique(np.concatenate(parts)) if parts else np.zeros(0, blocks.U)
        seen = np.zeros(len(distinct), bool)
        part = key[1].as_py()
        at = _ranges(distinct, fine, *_span(part, coarse))
        for i, mask in zip(masks.column("range").to_pylist(), masks.column("shared").to_pylist(), strict=True):
            i -= part * fine
            seen[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=at[i + 1] - at[i])
        if parts:
            seen |= _among(distinct, _repeated(parts))
        known = distinct[seen]
        return _answers(group, [_among(x, known) for x in parts])

    return rows


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """The rows dealt by key to as many tasks as there are groups, where the session has fewer: else a task would get more of them with more data."""
    tasks = min(groups, MAX_TASKS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


SENT, ANSWERED = "block long, range long, hashes binary", "block long, range long, shared binary"


def counted(sent: DataFrame, n_blocks: int, n_ranges: int, coarse: int) -> DataFrame:
    """The answers (ANSWERED) for packed rows (SENT) of ``coarse`` ranges; on two levels if more ranges are due."""
    if n_ranges <= coarse:
        return _dealt(sent, "range", n_ranges).groupBy("range").applyInArrow(_count, ANSWERED)
    fine = -(-n_ranges // coarse)
    # a group's hashes of a coarse range are as many as a fine range's of all groups
    groups = max(1, n_blocks * BLOCK_BYTES // (RANGE_BYTES * coarse))
    grouped = sent.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("group", "range")
    merged = grouped.applyInArrow(_merge(coarse, fine), SENT)
    shared = _dealt(merged, "range", n_ranges).groupBy("range").applyInArrow(_count, ANSWERED)
    back = shared.withColumn("coarse", F.floor(F.col("range") / fine).cast("long")).groupBy("block", "coarse")
    return grouped.cogroup(back).applyInArrow(_answer_blocks(coarse, fine), ANSWERED)


FIELDS = "doc_id {id}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
DIGEST = "doc_id {id}, n_words long, n_removed long, kept_sha256 string"


def _cut(width: int, n_ranges: int, digest: bool):
    def rows(key: tuple, docs: pa.Table, masks: pa.Table) -> pa.Table:
        texts = docs.column("text")
        words, begin, found, distinct = block_windows(texts, width)
        at = _ranges(distinct, n_ranges)
        repeated = np.zeros(len(distinct), bool)
        for i, mask in zip(masks.column("range").to_pylist(), masks.column("shared").to_pylist(), strict=True):
            n = at[i + 1] - at[i]
            repeated[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=n)
        place = np.searchsorted(distinct, found)
        repeated |= np.bincount(place, minlength=len(distinct)) > 1
        gone = blocks.cover(len(words.start), begin[repeated[place]], width)
        n_removed = blocks.sums_by(words.first, gone)
        kept, spans = [], []
        for d, (text, k, a, b) in enumerate(zip(texts, n_removed.tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            own = (text.as_py() or "").encode().split()  # bytes split at the same six separators
            if k:
                own = [own[i] for i in np.flatnonzero(~gone[a:b]).tolist()]
            joined = b" ".join(own)
            if digest:
                kept.append(hashlib.sha256(joined).hexdigest())
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                kept.append(joined.decode())
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        if digest:
            return pa.table(out | {"kept_sha256": pa.array(kept, pa.string())})
        return pa.table(out | {"removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string())})

    return rows


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """One row per document: counts, the maximal removal intervals in words and the kept words joined by a space.

    With ``digest`` the kept words are given by their SHA-256 alone.
    """
    rows = as_text(docs, key, text)
    size = text_bytes(rows)
    n_blocks, n_ranges = max(1, size // BLOCK_BYTES), max(1, size // RANGE_BYTES)
    first = min(n_ranges, COARSE)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks)))
    tasks = -(-n_blocks // 8)  # some 24 MB of stored text each
    by_block = _dealt(dealt, "block", tasks).groupBy("block")
    sent = by_block.applyInArrow(_send(width, first), SENT)
    shared = counted(sent, n_blocks, n_ranges, COARSE)
    schema = (DIGEST if digest else FIELDS).format(id=rows.schema["doc_id"].dataType.simpleString())
    return by_block.cogroup(_dealt(shared, "block", tasks).groupBy("block")).applyInArrow(_cut(width, first, digest), schema)
