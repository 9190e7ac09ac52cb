"""Quality rules: distribution divergence against language references.

Every document gets word, symbol, repeated-line and repeated-word counts and the
base verdict.  The method's verdict compares two histograms of the document,
character classes and common words, with the reference of its language by the
Jensen-Shannon distance (base 2, so 0 to 1).  Some 70 % of the words of a language
are in no list, so the divergence of the words is taken apart: how many of them
are common counts in full, which of the common ones they are counts less.
References are sums over the whole corpus: each task adds its documents, and the tasks' sums meet in one row per
language and bin.

Edge cases: null and empty texts have no words and fail the base rule; a null or
unlisted language shares the reference ``other``; documents under ``min_words``
words or ``min_chars`` characters in words are not judged by distance (too little
evidence) and keep the base verdict; repeated rows are judged one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import extended, in_small_batches

# The most frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux mais comme on tout nous sa fait être cette ses leur si elle deux même ces".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está".split(),
}
OTHER = "other"
LANGUAGES = [*COMMON_WORDS, OTHER]
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80


def _char_classes() -> tuple[list[str], np.ndarray]:
    names = ["lower", "upper", "digit", "letter_above_ascii", "continuation", "blank", "newline", "period_comma", "quote_dash", "other_mark", "symbol", "control"]
    of = np.full(256, names.index("other_mark"), np.int64)
    for name, values in {
        "lower": range(97, 123),
        "upper": range(65, 91),
        "digit": range(48, 58),
        "letter_above_ascii": range(0xC0, 0x100),
        "continuation": range(0x80, 0xC0),
        "control": [*range(0x20), 0x7F],
        "blank": [0x20, 9, 11, 12, 13],
        "newline": [10],
        "period_comma": b".,",
        "quote_dash": b"'\"-:;()?",
        "symbol": b"#*$%&|<>!~^_=+@{}[]\\/`",
    }.items():
        of[list(values)] = names.index(name)
    return names, of


CLASS_NAMES, _CLASS_OF = _char_classes()
N_CLASSES = len(CLASS_NAMES)
#: common words of any listed language, then "any other word"
N_WORD_BINS = len(VOCABULARY) + 1
BINS = N_CLASSES + N_WORD_BINS


@dataclass(frozen=True)
class Limits:
    min_words: int = 50  # base rule
    repeat_percent: int = 50  # base rule
    judged_words: int = 50  # minimum length of the distance rules
    judged_chars: int = 200
    char_distance: float = 0.28  # limits for a long document ...
    word_distance: float = 0.10  # from labelled rows: the clean ones stay, and so do those half in another language
    slack: float = 0.8  # ... and what the root of the characters takes off it: short texts vary more
    word_slack: float = 0.9  # the same of the words for word_distance


#: Weight of the divergence among the common words against that of their share in all words.
AMONG_COMMON = 0.1


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    h = blocks.hash_texts([w.encode() for w in VOCABULARY])
    order = np.argsort(h)
    return h[order], order


def _lookup(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
    """values of the hashes that are among the sorted keys, else ``missing``."""
    out = np.full(len(hashes), missing, np.int64)
    slots = np.zeros(1 << 16, bool)
    slots[(keys & blocks.U(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(slots[(hashes & blocks.U(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
    found = keys[at] == hashes[maybe]
    out[maybe[found]] = values[at[found]]
    return out


def histograms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per document: counts of character classes, then of common words."""
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros((n, BINS), np.int64)
    out[:, :N_CLASSES] = np.bincount(rows * N_CLASSES + _CLASS_OF[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    folded = blocks.FOLD[data]
    words = blocks.split(folded, off, blocks.FOLDED_ALNUM)
    keys, values = _vocabulary()
    ids = _lookup(blocks.hash_spans(folded, words.start, words.end), keys, values, len(VOCABULARY))
    out[:, N_CLASSES:] = np.bincount(words.docs() * N_WORD_BINS + ids, minlength=n * N_WORD_BINS).reshape(n, N_WORD_BINS)
    return out


def language_rows(column: pa.Array) -> np.ndarray:
    index = {x: i for i, x in enumerate(LANGUAGES)}
    return np.array([index.get(x, index[OTHER]) for x in column.to_pylist()], np.int64)


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Histogram sums of the whole corpus by language: LANGUAGES x BINS, a size fixed by this module."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES), BINS), np.int64)
        for batch in batches:
            langs = language_rows(batch.column(1))
            for lo, hi, data, off in blocks.chunks(batch.column(0)):
                np.add.at(total, langs[lo:hi], histograms(data, off))
        lang_at, bin_at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang_at), pa.array(bin_at), pa.array(total[lang_at, bin_at])], names=["lang_at", "bin_at", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(add, "lang_at long, bin_at long, n long")
    out = np.zeros((len(LANGUAGES), BINS), np.int64)
    for row in parts.groupBy("lang_at", "bin_at").agg(F.sum("n").alias("n")).collect():  # at most LANGUAGES x BINS rows
        out[row.lang_at, row.bin_at] = row.n
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of count rows; 0 where either row is empty."""
    p, q = p.astype(float), q.astype(float)
    sp, sq = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    usable = (sp[:, 0] > 0) & (sq[:, 0] > 0)
    p, q = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        out = np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))
    return np.where(usable, out, 0.0)


def word_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of rows of common words and "any other word", by the two parts of their divergence."""
    share = [np.stack([x[:, :-1].sum(1), x[:, -1]], 1) for x in (p, q)]
    how_many = js_distance(*share) ** 2
    return np.sqrt(how_many + AMONG_COMMON * np.maximum(js_distance(p, q) ** 2 - how_many, 0))


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of a slice of documents."""
    n = len(off) - 1
    words = blocks.split(data, off, blocks.VISIBLE)
    visible = blocks.VISIBLE[data]
    hashes = blocks.hash_spans(data, words.start, words.end)
    grams, begin = blocks.windows(hashes, words.first, 3)
    doc = words.docs()
    keyed = blocks.mix64(grams ^ blocks.mix64(doc[begin].astype(blocks.U) + blocks.U(1)))
    order = np.argsort(keyed)
    same = np.zeros(len(keyed) + 1, bool)
    same[1:-1] = keyed[order][1:] == keyed[order][:-1]
    repeated = begin[order[same[:-1] | same[1:]]]
    covered = blocks.cover(len(hashes), repeated, 3)

    lines = blocks.split(data, off, blocks.IN_LINE)
    inked = blocks.sums_by(np.concatenate([lines.start, [len(data)]]), visible) > 0 if len(lines.start) else np.zeros(0, bool)
    start, end, line_doc = lines.start[inked], lines.end[inked], lines.docs()[inked]
    line_hash = blocks.mix64(blocks.hash_spans(data, start, end) ^ blocks.mix64(line_doc.astype(blocks.U) + blocks.U(1)))
    first_seen = np.zeros(len(line_hash), bool)
    first_seen[np.unique(line_hash, return_index=True)[1]] = True
    return {
        "n_words": words.counts,
        "word_chars": blocks.sums_by(off, visible & ~_CONTINUATION[data]),
        "n_symbols": blocks.sums_by(off, _SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_doc[~first_seen], minlength=n),
        "n_repeat_words": blocks.sums_by(words.first, covered),
    }


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(), reference: np.ndarray | None = None) -> DataFrame:
    """All columns of ``docs`` followed by those of FIELDS (earlier columns of the same names are replaced)."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    docs = in_small_batches(docs).drop(*[x for x in names if x in docs.columns])
    ref = references(docs, text, lang) if reference is None else reference

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(text), language_rows(batch.column(lang))
            for lo, hi, data, off in blocks.chunks(texts):
                found = base_counts(data, off)
                n, repeats = found["n_words"], found["n_repeat_words"]
                failed = (n < limits.min_words) | (100 * repeats > limits.repeat_percent * n)
                counts = histograms(data, off)
                own = ref[langs[lo:hi]]
                chars = js_distance(counts[:, :N_CLASSES], own[:, :N_CLASSES])
                common = word_distance(counts[:, N_CLASSES:], own[:, N_CLASSES:])
                judged = (n >= limits.judged_words) & (found["word_chars"] >= limits.judged_chars)
                slack = limits.slack / np.sqrt(np.maximum(found["word_chars"], 1))
                word_slack = limits.word_slack / np.sqrt(np.maximum(counts[:, N_CLASSES:].sum(1), 1))
                far = judged & ((chars > limits.char_distance + slack) | (common > limits.word_distance + word_slack))
                yield blocks.appended(
                    batch.slice(lo, hi - lo),
                    **{k: pa.array(v, pa.int64()) for k, v in found.items()},
                    base_failed=pa.array(failed),
                    char_distance=pa.array(chars),
                    word_distance=pa.array(common),
                    kept=pa.array(~failed & ~far),
                )

    return docs.mapInArrow(rows, extended(docs.schema, FIELDS))
