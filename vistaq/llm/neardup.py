"""MinHash near-dedup with odd sketches.

Rows with equal shingle sets form a class; only classes are compared.  A class
has banded MinHash values, and the buckets they share with others are searched
for links.  Each class in a shared bucket has an odd sketch: its ``SAMPLE``
smallest shingle hashes (a bottom-k MinHash sample, the whole set if it is no
larger) folded into a bitmap by parity.  The population count of the XOR of two
sketches estimates the difference of the samples, hence the similarity, closely
enough that a candidate far from the threshold never reaches the exact check.

Bands are searched in passes (``PASSES``).  A pass looks only at buckets that
still hold several components, cut into pieces of bounded size.  A piece first
meets as sketches and returns the members that are in some candidate pair; then
their full sets meet in the same piece, which checks the candidates exactly and
returns what it has linked as stars: at most one row for each component it met.
So rows grow with the members of buckets, never with their pairs.  The first
passes compare within tiles of crowded buckets; the last takes all the bands, and
there each member outside a bucket's first component meets all members, tile by
tile, so no link between components is lost.

Edge cases: null and empty texts have no shingles and link with nothing; fewer
words than a shingle make one shingle; a null doc_id is never linked; repeated
rows share a class, hence a component; doc_id is an integer key (other ids have to be
numbered before), so of different texts under one doc_id any one may stand for it
in comparisons, and its rows may get different components; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import as_text, sent_if_small, stored

SHINGLE = 4
THRESHOLD = (80, 100)
BANDS, ROWS = 32, 4
#: Shingle hashes in an odd sketch, and its bits.
SAMPLE, BITS = 1024, 2048
#: Bands looked at up to the end of each pass.
PASSES = (2, 8, BANDS)
#: Members of a bucket in a tile of the first passes, which spread a crowded bucket over tasks, and of the
#: last, where members are copied to each tile they meet; and the shingles that a tile may have in all.
TILE, CROSSED, TILE_SHINGLES = 64, 512, 4_000_000

#: Rows up to which ids (8 bytes) and members of pieces (some 50) are sent to the texts and sets, instead of dealing these anew.
SENT_IDS, SENT_MEMBERS = 1_000_000, 200_000

_HASHES = blocks.mix64(np.arange(1, BANDS * ROWS + 1, dtype=blocks.U) * blocks.U(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, one after the other, and their n + 1 offsets."""
    data = blocks.FOLD[data]
    words = blocks.split(data, off, blocks.VISIBLE)
    hashes = blocks.hash_spans(data, words.start, words.end)
    found, begin = blocks.windows(hashes, words.first, width)
    doc = words.docs()[begin]
    for d in np.flatnonzero((words.counts > 0) & (words.counts < width)):  # the whole sequence is one shingle
        a, b = words.first[d], words.first[d + 1]
        whole, _ = blocks.windows(hashes[a:b], np.array([0, b - a]), int(b - a))
        at = np.searchsorted(doc, d)
        found, doc = np.insert(found, at, whole[0]), np.insert(doc, at, d)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(off)))


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of the bands of each document with shingles: documents x BANDS."""
    at = first[:-1][np.diff(first) > 0]
    keys = np.zeros((len(at), BANDS), blocks.U)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, blocks.U)
        for row in range(ROWS):
            salt = _HASHES[band * ROWS + row]
            least = np.minimum.reduceat((hashes ^ salt) * (salt | blocks.U(1)), at)
            key = blocks.mix64(key ^ least)
        keys[:, band] = key
    return keys


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the sample of one sorted set."""
    spot = (blocks.mix64(hashes[:SAMPLE]) >> blocks.U(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def similarity(odd: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the bits in which two sketches differ and the set sizes."""
    share = np.minimum(2 * odd / BITS, 0.999)
    differ = -BITS / 2 * np.log1p(-share)
    in_a, in_b = np.minimum(a, SAMPLE), np.minimum(b, SAMPLE)
    larger = np.maximum(a, b)
    both = np.maximum((in_a + in_b - differ) / 2, 0) * larger / np.minimum(larger, SAMPLE)
    both = np.minimum(both, np.minimum(a, b))
    return both / np.maximum(a + b - both, 1)


def least_estimate(threshold: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates below this have no chance to reach the threshold: six deviations of parity, and of sampling if any."""
    sampled = np.maximum(a, b) > SAMPLE
    return threshold - 6 * 0.0065 - np.where(sampled, 6 * np.sqrt(threshold * (1 - threshold) / SAMPLE), 0)


SIGNATURE = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """Per row: set size, 128-bit fingerprint of the set and band keys (null without shingles)."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks.chunks(batch.column("text")):
                hashes, first = shingle_sets(data, off, width)
                size = np.diff(first)
                full = np.flatnonzero(size > 0)
                a = np.zeros(len(size), np.int64)
                b, bands = a.copy(), [None] * len(size)
                if len(full):
                    for out, salt in ((a, blocks.U(0x51ED270B)), (b, blocks.U(0xA3EC6471))):
                        out[full] = np.add.reduceat(blocks.mix64(hashes ^ salt), first[:-1][full]).view(np.int64)
                    keys = band_keys(hashes, first).view(np.int64)
                    for d, key in zip(full.tolist(), keys, strict=True):
                        bands[d] = key
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(a), pa.array(b), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "bands"],
                )

    return rows.mapInArrow(sign, SIGNATURE)


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """rep, n_shingles, sketch and the sorted shingle hashes of each row."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks.chunks(batch.column("text")):
                hashes, first = shingle_sets(data, off, width)
                parts = [hashes[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array([odd_sketch(x) for x in parts], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())],
                    names=["rep", "n_shingles", "sketch", "hashes"],
                )

    return rows.mapInArrow(sets, "rep long, n_shingles long, sketch binary, hashes binary")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def candidate_pairs(comp: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each left member of a piece with any, the right members of other components whose estimate may reach the threshold."""
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    step = max(1, (1 << 20) // max(1, len(rights) * sketch.shape[1]))
    for at in range(0, len(lefts), step):
        i = lefts[at : at + step]
        odd = np.bitwise_count(sketch[i][:, None, :] ^ sketch[rights][None, :, :]).sum(2, dtype=np.int64)
        a, b = sizes[i][:, None], sizes[rights][None, :]
        due = (comp[i][:, None] != comp[rights][None, :]) & (similarity(odd, a, b) >= least_estimate(threshold, a, b))
        for k in np.flatnonzero(due.any(1)).tolist():
            yield int(i[k]), rights[due[k]]


class _Shared:
    """Sizes of intersections of one set of a piece with others."""

    #: Pairs from which on numbering all shingles of the piece pays.
    MANY = 8

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.asked = sets, 0
        self.number = None

    def counts(self, i: int, others: list[int]) -> np.ndarray:
        self.asked += len(others)
        if self.number is None and self.asked < self.MANY:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in others])
        if self.number is None:
            unique, inverse = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.number = np.split(inverse, np.cumsum([len(x) for x in self.sets])[:-1])
            self.mark = np.zeros(len(unique), bool)
        self.mark[self.number[i]] = True
        found = np.array([np.count_nonzero(self.mark[self.number[j]]) for j in others])
        self.mark[self.number[i]] = False
        return found


def linked(comp: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between the components of a piece, checked on full sets, as (smallest component, other) rows."""
    part, whole = threshold
    names, group = np.unique(comp, return_inverse=True)
    group = group.tolist()
    trees, shared = _Forest(len(names)), _Shared(sets)
    for i, others in candidate_pairs(comp, sizes, sketch, left, right, part / whole):
        others = [j for j in others.tolist() if trees.root(group[j]) != trees.root(group[i])]
        if others:
            both = shared.counts(i, others)
            for j in np.array(others)[whole * both >= part * (sizes[i] + sizes[others] - both)].tolist():
                trees.join(group[i], group[j])
    roots = [trees.root(k) for k in range(len(names))]
    return [(int(names[r]), int(names[k])) for k, r in enumerate(roots) if r != k]


PIECE = ["bucket", "tile_x", "tile_y"]
MEMBER = "bucket long, tile_x long, tile_y long, rep long, comp long, is_left boolean, is_right boolean"


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal PIECE."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        keys = np.stack([part.column(c).to_numpy() for c in PIECE], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[lo].tolist())
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(part.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


def _columns(piece: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """comp, sizes, sketches, left and right of a piece."""
    sketch = np.frombuffer(b"".join(piece.column("sketch").to_pylist()), np.uint64).reshape(piece.num_rows, -1)
    comp, sizes = (piece.column(c).to_numpy() for c in ("comp", "n_shingles"))
    left, right = (np.array(piece.column(c).to_pylist(), bool) for c in ("is_left", "is_right"))
    return comp, sizes, sketch, left, right


def _pieces(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members by piece, sorted within partitions, so that many small pieces cost no call each."""
    return members.select(*[x.split()[0] for x in MEMBER.split(", ")], *columns).repartition(*PIECE).sortWithinPartitions(*PIECE, "rep")


def candidates(members: DataFrame, threshold: float) -> DataFrame:
    """The members, with sketches, that are in a candidate pair of their piece; columns of MEMBER."""

    def needed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _groups(batches):
            keep = np.zeros(piece.num_rows, bool)
            for i, others in candidate_pairs(*_columns(piece), threshold):
                keep[i] = True
                keep[others] = True
            if keep.any():
                yield from piece.select([x.split()[0] for x in MEMBER.split(", ")]).filter(pa.array(keep)).combine_chunks().to_batches()

    return _pieces(members, ["n_shingles", "sketch"]).mapInArrow(needed, MEMBER)


def verified(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): components that the full sets of members of a piece link, a the smallest of those it met."""

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _groups(batches):
            comp, sizes, sketch, left, right = _columns(piece)
            sets = [np.frombuffer(x, blocks.U) for x in piece.column("hashes").to_pylist()]
            if found := linked(comp, sizes, sketch, sets, left, right, threshold):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _pieces(members, ["n_shingles", "sketch", "hashes"]).mapInArrow(links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id on an edge.

    Smallest neighbour labels, with a jump to the label's own label each round;
    every round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("comp", "near").alias("next"), "comp")
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("beyond"))
        new = stored(step.join(jump, "next").select("id", F.least("next", "beyond").alias("new"), "comp"))
        changed = new.where("new <> comp").limit(1).count()
        labels = new.select("id", F.col("new").alias("comp"))
        if not changed:
            return labels


def _salted(tiles: str, salt: str) -> Column:
    """The member's tile; another one in each bucket, so that what one bucket keeps apart meets in the next."""
    return F.pmod(F.xxhash64("rep", "bucket", F.lit(salt)), F.col(tiles))


def _tiles(count: str, sizes: str, most: int) -> Column:
    return F.greatest(F.ceil(F.col(count) / most), F.ceil(F.col(sizes) / TILE_SHINGLES)).cast("long")


def diagonal(mixed: DataFrame) -> DataFrame:
    """The members of MEMBER, each in one tile of its bucket."""
    tiled = mixed.withColumn("tiles", _tiles("members", "shingles", TILE))
    return tiled.select("bucket", _salted("tiles", "tile").alias("tile_x"), F.lit(0).cast("long").alias("tile_y"), "rep", "comp", F.lit(True).alias("is_left"), F.lit(True).alias("is_right"))


def crossed(mixed: DataFrame) -> DataFrame:
    """The members of MEMBER in every tile pair they are due in: those outside the bucket's first component meet all members."""
    outside = stored(mixed.where("comp <> main").groupBy("bucket").agg(F.count("*").alias("outsiders"), F.sum("n_shingles").alias("outside")))
    tiled = mixed.join(outside, "bucket").withColumn("tiles_x", _tiles("outsiders", "outside", CROSSED)).withColumn("tiles_y", _tiles("members", "shingles", CROSSED))
    tiled = tiled.withColumn("out", F.col("comp") != F.col("main")).withColumn("x", _salted("tiles_x", "left")).withColumn("y", _salted("tiles_y", "right"))
    places = F.expr(
        """CASE WHEN tiles_x = 1 AND tiles_y = 1 THEN array(struct(0L AS tile_x, 0L AS tile_y, out AS is_left, true AS is_right))
           ELSE concat(IF(out, transform(sequence(0L, tiles_y - 1), k -> struct(x AS tile_x, k AS tile_y, true AS is_left, false AS is_right)), array()),
                       transform(sequence(0L, tiles_x - 1), k -> struct(k AS tile_x, y AS tile_y, false AS is_left, true AS is_right))) END"""
    )
    return tiled.select("bucket", "rep", "comp", F.explode(places).alias("place")).select("bucket", "place.tile_x", "place.tile_y", "rep", "comp", "place.is_left", "place.is_right")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable, itself included) and kept for every row."""
    rows = as_text(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stored(signatures(rows, width))
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(sets.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")))

    spread = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    # counts of buckets are written before they are joined: then a join has two plain exchanges, and a crowded bucket can be split
    full = stored(spread.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")).where("members > 1"))
    held = stored(spread.join(full, "bucket"))
    needed = stored(held.select(F.col("rep").alias("doc_id")).distinct())
    made = full_sets(rows.join(sent_if_small(needed, SENT_IDS), "doc_id", "left_semi").select("doc_id", "text"), width)
    # a doc_id that stands twice has one set here
    known = stored(made.groupBy("rep").agg(F.max(F.struct("hashes", "n_shingles", "sketch")).alias("set")).select("rep", "set.*"))

    labels = None  # of the components so far: comp by class
    for k, bands in enumerate(PASSES):
        last = k == len(PASSES) - 1
        start = PASSES[k - 1] if k else 0
        # earlier passes have settled their buckets, but those of several tiles
        due = held.where(F.col("band") < bands).where((F.col("band") >= start) | (_tiles("members", "shingles", TILE) > 1)) if last else held.where(F.col("band").between(start, bands - 1))
        if labels is not None:
            due = due.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        else:
            due = due.withColumn("comp", F.col("rep"))
        split = stored(due.groupBy("bucket").agg(F.min("comp").alias("main"), F.max("comp").alias("other")).where("main <> other").select("bucket", "main"))
        mixed = due.join(split, "bucket")
        dealt = crossed(stored(mixed)) if last else diagonal(mixed)
        found = stored(candidates(dealt.join(known.select("rep", "n_shingles", "sketch"), "rep"), threshold[0] / threshold[1]))
        links = stored(verified(known.join(sent_if_small(found, SENT_MEMBERS), "rep"), threshold))
        if not links.limit(1).count():
            continue
        # links stand between components; their components relabel the classes
        moved = components(links)
        if labels is None:
            labels = moved
        else:
            labels = labels.join(moved.select(F.col("id").alias("comp"), F.col("comp").alias("onto")), "comp", "left").select("id", F.coalesce("onto", "comp").alias("comp"))
            labels = stored(labels.union(moved.join(labels.select("id"), "id", "left_anti")))

    # from classes to rows
    several = classes.where("copies > 1").select("print_a", "print_b", "rep")
    out = signed.select("doc_id", "n_shingles", "print_a", "print_b")
    if labels is None:
        out = out.join(several, ["print_a", "print_b"], "left").withColumn("comp", F.lit(None).cast("long"))
        one = F.coalesce("rep", "doc_id")
    else:
        several = stored(several.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("print_a", "print_b", F.coalesce("comp", "rep").alias("of_class")))
        out = out.join(several, ["print_a", "print_b"], "left").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        one = F.coalesce("of_class", "comp", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), one).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
