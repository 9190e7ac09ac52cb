"""Token counts without tokens: count-only Viterbi.

Each unit's best score and its piece count are carried from position to
position; Aho-Corasick enumerates the vocabulary matches.  Counts of units are
remembered, since most units of a text are common words.

Edge cases: null and empty texts count 0; an unknown character counts its UTF-8
bytes; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text
from .unigram import Vocabulary, count_unit, normalise, units


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, vocabulary.remembered("counts")

    def count(self, text: str | None) -> int:
        young, make = self.known.young.get, self._unit
        return sum([young(unit) or make(unit) for unit in units(normalise(text or ""), self.vocabulary)])  # a unit has at least one piece

    def _unit(self, unit: str) -> int:
        return self.known.get(unit, self._make)

    def _make(self, unit: str) -> int:
        return count_unit(unit, self.vocabulary)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens of every row."""
    rows = as_text(docs, key, text)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            chars, tokens = [], []
            for value in batch.column("text"):
                own = value.as_py() or ""
                chars.append(len(own))
                tokens.append(counter.count(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long")
