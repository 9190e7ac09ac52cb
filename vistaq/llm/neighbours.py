"""Quality classifier: similarity-weighted votes of nearest labelled neighbours.

Terms are bigrams of character classes plus four layout terms: the rates of
words equal to the one before, of words that came earlier in the text, of words
without a letter and of words with two capitals or more.  A bounded, hash-ordered sample of labelled documents gives term weights and the
latent directions (truncated SVD of the sample's term matrix); its vectors and
labels, at most ``MAX_LABELLED`` x ``DIRECTIONS`` numbers, are sent to every
task.  Every document is projected and compared with all of them in blocks of
exact cosine products in double precision; the labels of the nearest are averaged with a power of
their similarity as weight.  A document of the sample is its own nearest
neighbour, so only the scores of held-out documents say how good the model is.

Edge cases: null and empty texts have no terms and get the labelled share of
label 1; ties in similarity (rounded to 2^-16) are broken by the order of the sample; repeated rows
are scored each; without any labelled row every score is 0.5; null labels are
left out; doc_id is an integer key; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import as_text

#: Labelled rows used at most; the least by a hash of the id are taken.
MAX_LABELLED = 4000
DIRECTIONS = 48
NEIGHBOURS = 15
POWER = 4
CUT = 0.3
#: Similarities are rounded to this fraction, far above the noise of double precision.
STEPS = 1 << 16
#: Similarities held at once.
BLOCK_CELLS = 2_000_000


def _classes() -> np.ndarray:
    of = np.zeros(256, np.int64)  # 0: other marks and controls
    for i, b in enumerate(range(97, 123)):
        of[b] = 1 + i
    of[65:91], of[48:58], of[0x20], of[0x0A], of[0x09] = 27, 28, 29, 30, 29
    for i, b in enumerate(b"#*$%&|!.,"):
        of[b] = 31 + i
    of[0x80:0xC0], of[0xC0:] = 40, 41
    return of


_CLASS = _classes()
_SIDE = int(_CLASS.max()) + 1
LAYOUT = 4
#: Weight of a layout term against a bigram, of which a text has hundreds.
LAYOUT_WEIGHT = 5
TERMS = _SIDE * _SIDE + LAYOUT
_LETTER = (np.arange(256) >= 0x80) | np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Damped term rates of each document."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(off))
    cls = _CLASS[data]
    pair = cls[:-1] * _SIDE + cls[1:]
    inside = doc[:-1] == doc[1:]
    width = _SIDE * _SIDE
    counts = np.bincount((doc[:-1] * width + pair)[inside], minlength=n * width).reshape(n, width)
    length = np.maximum(np.diff(off), 1)[:, None]
    out[:, :width] = counts * (1000.0 / length)
    words = blocks.split(data, off, blocks.VISIBLE)
    hashes = blocks.hash_spans(data, words.start, words.end)
    word_doc = words.docs()
    n_words = np.maximum(words.counts, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    again = np.ones(len(hashes), bool)
    again[np.unique(blocks.mix64(hashes ^ blocks.mix64(word_doc.astype(blocks.U) + blocks.U(1))), return_index=True)[1]] = False
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    bare = letters[words.end] == letters[words.start]
    upper = np.concatenate([[0], np.cumsum(cls == 27)])
    shout = upper[words.end] - upper[words.start] >= 2
    for i, flag in enumerate((same, again, bare, shout)):
        out[:, width + i] = np.bincount(word_doc[flag], minlength=n) * 1000.0 / n_words
    out = np.log1p(out)
    out[:, width:] *= LAYOUT_WEIGHT
    return out


@dataclass
class Model:
    """idf: TERMS; directions: TERMS x k; vectors: labelled x k of length 1; labels: 0 or 1."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counted: np.ndarray) -> np.ndarray:
        latent = (counted * self.idf).astype(np.float64) @ self.directions.astype(np.float64)
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, counted: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counted), 0.5)
        prior = float(self.labels.mean())
        out = np.empty(len(counted))
        k = min(NEIGHBOURS, len(self.labels))
        step = max(1, BLOCK_CELLS // len(self.labels))
        for lo in range(0, len(counted), step):
            near = self.project(counted[lo : lo + step]) @ self.vectors.T
            # one number for similarity, then sample order: no two are equal, so the nearest are the same in any block
            whole = np.rint(near * STEPS).astype(np.int64)
            key = np.arange(len(self.labels)) - whole * len(self.labels)
            top = np.sort(np.argpartition(key, k - 1, axis=1)[:, :k], axis=1)
            weight = (np.maximum(np.take_along_axis(whole, top, 1), 0) / STEPS) ** POWER
            total = weight.sum(1)
            out[lo : lo + step] = np.where(total > 1e-12, (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-12), prior)
        out[~counted.any(1)] = prior
        return np.clip(out, 0, 1)


def fit(counted: np.ndarray, labels: np.ndarray, k: int = DIRECTIONS) -> Model:
    """Term weights and latent directions of the sample, by the eigenvectors of its term products."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), labels)
    idf = np.log((1 + len(counted)) / (1 + (counted > 0).sum(0))).astype(np.float32) + 0.5
    weighted = counted * idf
    used = np.flatnonzero(weighted.any(0))
    _, vectors = np.linalg.eigh((weighted[:, used].T @ weighted[:, used]).astype(np.float64))
    directions = np.zeros((TERMS, min(k, len(used))), np.float32)
    directions[used] = vectors[:, ::-1][:, : directions.shape[1]]
    model = Model(idf, directions, np.zeros((0, 1)), labels.astype(np.float64))
    model.vectors = model.project(counted)
    return model


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Term rows and labels of the fitting sample."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    both = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # ``most`` rows at most

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks.chunks(batch.column("text")):
                rows = terms(data, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "terms"])

    found = both.mapInArrow(count, "doc_id long, label int, terms binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("terms").alias("terms")).toArrow().sort_by("doc_id")
    rows = np.stack([np.frombuffer(x, np.float16) for x in found.column("terms").to_pylist()]).astype(np.float32) if found.num_rows else np.zeros((0, TERMS), np.float32)
    return rows, found.column("label").to_numpy().astype(np.int64)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = as_text(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    model = fit(*sample(rows, known, label, most))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks.chunks(batch.column("text")):
                found = model.score(terms(data, off))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = rows.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
