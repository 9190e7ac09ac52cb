"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

A document up to ``GIANT`` characters is segmented in one task.  A giant one is
cut into chunks.  A piece may straddle a cut, so the state at a cut is how many
characters of the next chunk the last piece covers.  Each chunk yields its
transfer matrix, the best score from each entry state to each exit state.  The
matrices are combined associatively (max of sums) up a tree, ``FAN`` neighbours at
a time, and entry scores come down it to every chunk, so no task ever sees more
than ``FAN`` matrices of a document.  With its entry scores known, each chunk tells from which entry each
exit is reached; these maps are composed up and down the same tree, which fixes
every exit, and every chunk is backtraced on its own.

Edge cases: null and empty texts have no ids; unknown characters become bytes;
U+2581 in a text is a space afterwards, as in the library, so such a text is the
only one that doesn't come back the same; repeated rows are encoded each; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, in_small_batches, stored
from .unigram import MARK, Vocabulary, decode, forward, normalise, segment_unit, trace, units

#: Characters of a chunk; longer documents are giants.
GIANT = 32_768
NONE = np.iinfo(np.int64).min // 4
#: Neighbours that are combined in one step of the tree.
FAN = 16


class Encoder:
    """Segments texts, remembering units."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = vocabulary.remembered("ids")

    def _make(self, unit: str) -> bytes:
        return array("i", segment_unit(unit, self.vocabulary)[1]).tobytes()

    def _unit(self, unit: str) -> bytes:
        return self.known.get(unit, self._make)

    def of_units(self, found: list[str]) -> bytes:
        """Ids of units one after the other, as little-endian 32-bit numbers."""
        young, make = self.known.young.get, self._unit
        return b"".join([young(unit) or make(unit) for unit in found])  # a unit has at least one id

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text."""
        return self.of_units(units(normalise(text or ""), self.vocabulary))

    def score(self, ids: bytes) -> int:
        """The score of a segmentation, from its ids alone."""
        return int(self.vocabulary.id_scores[np.frombuffer(ids, np.int32)].sum())


def cuts(text: str, size: int) -> list[tuple[str, str]]:
    """(body, characters behind it) of the chunks of a normalised text."""
    return [(text[i : i + size], text[i + size : i + size + 64]) for i in range(0, len(text), size)]


def _sync(body: str, backward: bool = False) -> int | None:
    """The first (or last) place in the chunk that no piece crosses; at least 1."""
    places = range(len(body) - 1, 0, -1) if backward else range(1, len(body))
    return next((i for i in places if body[i] == MARK and body[i - 1] != MARK), None)


class Chunk:
    """One chunk: its head up to the first sync place, whole units, and the tail with the characters behind."""

    def __init__(self, body: str, behind: str, encoder: Encoder):
        self.body, self.encoder, self.vocabulary = body, encoder, encoder.vocabulary
        self.states = self.vocabulary.longest
        self.first = _sync(body)
        self.last = _sync(body, backward=True)
        self.tail_text = body[self.last or 0 :] + behind[: self.states - 1]

    @cached_property
    def middle(self) -> bytes:
        """Ids of the whole units between the head and the tail."""
        return self.encoder.of_units(units(self.body[self.first : self.last], self.vocabulary)) if self.first is not None and self.last > self.first else b""

    def _entries(self, scores: np.ndarray) -> dict[int, int]:
        return {d: int(s) for d, s in enumerate(scores.tolist()) if s > NONE // 2}

    def _exits(self, best: list, stop: int) -> np.ndarray:
        own = [best[stop + d] if stop + d < len(best) else None for d in range(self.states)]
        return np.array([NONE if x is None else x for x in own], np.int64)

    def _tail(self, entries: dict[int, int]) -> tuple[list, list, int]:
        stop = len(self.body) - (self.last or 0)
        best, back = forward(self.tail_text, stop, entries, self.vocabulary)
        return best, back, stop

    def matrix(self) -> np.ndarray:
        """Best scores from each entry state (row) to each exit state (column)."""
        out = np.full((self.states, self.states), NONE, np.int64)
        if self.first is None:
            for d in range(self.states):
                best, _, stop = self._tail({d: 0})
                out[d] = self._exits(best, stop)
            return out
        middle = self.encoder.score(self.middle)
        best, _, stop = self._tail({0: 0})
        exits = self._exits(best, stop)
        for d in range(self.states):
            best, _ = forward(self.body[: self.first], self.first, {d: 0}, self.vocabulary)
            if d <= self.first and best[self.first] is not None:
                out[d] = np.where(exits > NONE // 2, exits + middle + best[self.first], NONE)
        return out

    def entry_of_exit(self, scores: np.ndarray) -> list[int]:
        """For each exit state the entry state on its best path, -1 if none reaches it."""
        entries = self._entries(scores)
        if self.first is None:
            best, back, stop = self._tail(entries)
            return [trace(self.tail_text, stop + d, back, self.vocabulary)[0] if stop + d < len(best) and best[stop + d] is not None else -1 for d in range(self.states)]
        head = {d: s for d, s in entries.items() if d <= self.first}
        _, back = forward(self.body[: self.first], self.first, head, self.vocabulary)
        entry = trace(self.body, self.first, back, self.vocabulary)[0]
        best, _, stop = self._tail({0: 0})
        return [entry if x > NONE // 2 else -1 for x in self._exits(best, stop).tolist()]

    def ids(self, scores: np.ndarray, exit_: int) -> bytes:
        """Ids of the pieces that start in this chunk, on the best path to the exit."""
        entries = self._entries(scores)
        if self.first is None:
            _, back, stop = self._tail(entries)
            return np.array(trace(self.tail_text, stop + exit_, back, self.vocabulary)[1], np.int32).tobytes()
        head = {d: s for d, s in entries.items() if d <= self.first}
        _, back = forward(self.body[: self.first], self.first, head, self.vocabulary)
        out = [np.array(trace(self.body, self.first, back, self.vocabulary)[1], np.int32).tobytes()]
        out.append(self.middle)
        _, back, stop = self._tail({0: 0})
        out.append(np.array(trace(self.tail_text, stop + exit_, back, self.vocabulary)[1], np.int32).tobytes())
        return b"".join(out)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices (or of an entry row and a matrix)."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NONE)


def entry_scores(matrices: list[np.ndarray], row: np.ndarray | None = None) -> list[np.ndarray]:
    """Scores of the entry states of each chunk: the exclusive scan from state 0, or from a row.

    Later chunks need only differences, so each row is brought down to a best
    score of 0, which keeps any length within 64 bits.
    """
    if row is None:
        row = start_row(len(matrices[0]))
    out = []
    for matrix in matrices:
        out.append(row)
        row = combine(row, matrix)
        row = np.where(row > NONE // 2, row - row.max(), NONE)
    return out


def start_row(states: int) -> np.ndarray:
    """A text is entered in state 0."""
    row = np.full(states, NONE, np.int64)
    row[0] = 0
    return row


def compose(maps: list[np.ndarray]) -> np.ndarray:
    """The entry of the first chunk from which each exit of the last one is reached, -1 if none."""
    out = maps[-1]
    for before in reversed(maps[:-1]):
        out = np.where(out >= 0, before[out], -1)
    return out


def encode_giant(text: str, encoder: Encoder, size: int) -> bytes:
    """All steps for one text in one place; the plan below deals the same steps to tasks."""
    chunks = [Chunk(*x, encoder) for x in cuts(normalise(text), size)]
    scores = entry_scores([c.matrix() for c in chunks])
    exits = exit_states([c.entry_of_exit(s) for c, s in zip(chunks, scores, strict=True)])
    return b"".join(c.ids(s, e) for c, s, e in zip(chunks, scores, exits, strict=True))


def exit_states(entry_of_exit: list, state: int = 0) -> list[int]:
    """The exit state of each chunk on the best path, which ends in the given state."""
    out = []
    for reached in reversed(entry_of_exit):
        out.append(state)
        state = int(reached[state])
    return out[::-1]


def through_tree(values: DataFrame, most: int, fan: int, fold: Callable[[list[bytes]], bytes], spread: Callable[[bytes, list[bytes]], list[bytes]], top: bytes) -> DataFrame:
    """(row, chunk, given): what ``spread`` deals each chunk from ``top``.

    ``values`` (row, chunk, out; at most ``most`` chunks a row) are folded,
    ``fan`` neighbours at a time, until that many are left of a row; then what
    a group is given is spread over its members, level by level down again.
    """

    def up(key: tuple, group: pa.Table) -> pa.Table:
        ordered = group.sort_by("chunk").column("out").to_pylist()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int64()), "out": pa.array([fold(ordered)], pa.binary())})

    def down(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        dealt = spread(group.column("given")[0].as_py(), group.column("out").to_pylist())
        return pa.table({"row": group.column("row"), "chunk": group.column("chunk"), "given": pa.array(dealt, pa.binary())})

    above = F.floor(F.col("chunk") / fan).cast("long")
    levels = [values]
    while most > fan:
        levels.append(stored(levels[-1].withColumn("above", above).groupBy("row", "above").applyInArrow(up, "row long, chunk long, out binary")))
        most = -(-most // fan)
    given = levels[-1].withColumn("given", F.lit(top)).groupBy("row").applyInArrow(down, GIVEN)
    for level in reversed(levels[:-1]):
        parents = given.select("row", F.col("chunk").alias("above"), "given")
        given = level.withColumn("above", above).join(parents, ["row", "above"]).groupBy("row", "above").applyInArrow(down, GIVEN)
    return given


GIVEN = "row long, chunk long, given binary"


def _encoders(vocabulary: Vocabulary):
    """A function over (body, behind) columns; one encoder for each task."""

    def over(method: str, keep: list[str]):
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(vocabulary)
            for batch in batches:
                out = []
                cols = [batch.column(c).to_pylist() for c in batch.schema.names if c not in keep]
                for body, behind, *more in zip(*cols, strict=True):
                    chunk = Chunk(body, behind, encoder)
                    args = [np.frombuffer(more[0], np.int64)] if more else []
                    out.append(getattr(chunk, method)(*args, *[int(np.frombuffer(x, np.int64)[0]) for x in more[1:]]))
                if method != "ids":
                    out = [np.asarray(x, np.int64).tobytes() for x in out]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "out"])

        return rows

    return over


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text", giant: int = GIANT, fan: int = FAN) -> DataFrame:
    """The columns ``keep``, then ids (little-endian 32-bit numbers) and same: whether decoding gives the text again."""
    source = in_small_batches(docs).select(*dict.fromkeys([*keep, text]))
    shape = extended(source.select(*keep).schema, "ids binary, same boolean")
    small = source.where(F.col(text).isNull() | (F.length(F.col(text).cast("string")) <= giant))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, same = [], []
                for value in part.column(text):
                    own = value.as_py() or ""
                    ids.append(encoder.ids(own))
                    same.append(decode(np.frombuffer(ids[-1], np.int32).tolist(), vocabulary) == own)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(same)], names=[*keep, "ids", "same"])

    giants = source.where(F.length(F.col(text).cast("string")) > giant).withColumn("__row", F.monotonically_increasing_id())

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column("__row").to_pylist(), batch.column(text), strict=True):
                parts = cuts(normalise(value.as_py()), giant)
                for lo in range(0, len(parts), 64):
                    some = parts[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int64()), pa.array([x for x, _ in some], pa.string()), pa.array([y for _, y in some], pa.string())],
                        names=["row", "chunk", "body", "behind"],
                    )

    # row numbers are drawn once, in a written table
    held = stored(giants)
    chunks = held.select("__row", text).mapInArrow(cut, "row long, chunk long, body string, behind string").repartition("row", "chunk")
    chunks = stored(chunks)
    most = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    over, ids, side = _encoders(vocabulary), ["row", "chunk"], vocabulary.longest

    def matrices_of(values: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.int64).reshape(side, side) for x in values]

    def fold_matrices(values: list[bytes]) -> bytes:
        return functools.reduce(combine, matrices_of(values)).tobytes()

    def spread_scores(given: bytes, values: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in entry_scores(matrices_of(values), np.frombuffer(given, np.int64))]

    def fold_maps(values: list[bytes]) -> bytes:
        return compose([np.frombuffer(x, np.int64) for x in values]).tobytes()

    def spread_exits(given: bytes, values: list[bytes]) -> list[bytes]:
        return [np.int64(x).tobytes() for x in exit_states([np.frombuffer(x, np.int64) for x in values], int(np.frombuffer(given, np.int64)[0]))]

    shape_out = "row long, chunk long, out binary"
    matrices = stored(chunks.mapInArrow(over("matrix", ids), shape_out))
    scores = stored(through_tree(matrices, most, fan, fold_matrices, spread_scores, start_row(side).tobytes()))
    known = chunks.join(scores.withColumnRenamed("given", "scores"), ids).select("row", "chunk", "body", "behind", "scores")
    reached = stored(known.mapInArrow(over("entry_of_exit", ids), shape_out))
    exits = stored(through_tree(reached, most, fan, fold_maps, spread_exits, np.int64(0).tobytes()))
    traced = known.join(exits.withColumnRenamed("given", "exit"), ids).select("row", "chunk", "body", "behind", "scores", "exit")
    pieces = traced.mapInArrow(over("ids", ids), shape_out)
    whole_ids = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "out"))).alias("__parts")).select("row", F.transform("__parts", lambda x: x["out"]).alias("__parts"))
    joined = held.join(whole_ids, held["__row"] == whole_ids["row"]).select(*source.columns, "__parts")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b"".join(x) for x in batch.column("__parts").to_pylist()]
            same = [decode(np.frombuffer(i, np.int32).tolist(), vocabulary) == t.as_py() for i, t in zip(found, batch.column(text), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.binary()), pa.array(same, pa.bool_())], names=[*keep, "ids", "same"])

    return small.mapInArrow(whole, shape).union(joined.mapInArrow(check, shape))


def digest(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and same of the rows of encode."""
    return encoded.select(F.col(key).alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "same")
