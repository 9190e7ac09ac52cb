"""A unigram tokenizer on the pieces of a SentencePiece vocabulary file.

The public vocabulary file holds merge ranks, and tokenizers are never trained
here, so a piece's log score is minus the logarithm of its rank, rounded to
1/64.  Scores are whole multiples of 1/64 and added as integers: ties are real
ties, at any length of text, and the tie rule is the tokenizer's own: of equal
scores the piece that starts first, the longer one, wins.

Text is normalised as the file says: a space is put in front, spaces become
U+2581, nothing else changes.  No piece holds that mark behind another
character, so a run of marks with what follows up to the next mark, a unit, is
segmented on its own; where no piece mixes letters with other characters, units
end there too.
An unknown character costs the least score less ten and becomes its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

MARK = "▁"
SCALE = 64
UNKNOWN_PENALTY = 10 * SCALE
#: Below every score of a text.
UNREACHED = -(1 << 62)
#: Units in a generation of those whose segmentation a worker remembers; it keeps two.
REMEMBERED = 160_000


@dataclass
class Vocabulary:
    """Pieces by id; ``scores`` holds whole 64ths, None for pieces that text can't match."""

    pieces: list[str]
    scores: list[int | None]
    byte_ids: list[int]
    _memo: dict = field(default_factory=dict, repr=False)

    def __reduce__(self):
        return _in_process, (self.pieces, self.scores, self.byte_ids)

    def remembered(self, kind: str) -> Remembered:
        """What this process has segmented so far, kept over its tasks."""
        return self._memo.setdefault(kind, Remembered())

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        scores: list[int | None] = []
        bytes_at: dict[int, int] = {}
        rank = 0
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                bytes_at[int(piece[1:-1], 16)] = i
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                scores.append(None)
            else:
                rank += 1
                scores.append(-round(SCALE * math.log(rank)))
        return cls(pieces, scores, [bytes_at[b] for b in range(256)])

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True)) if s is not None}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def unit_pattern(self) -> re.Pattern:
        """Marks with the letters, or the other characters, behind them; a line end by itself.

        It holds if no piece would be cut by it.  Whether a place is a cut
        depends on the two characters around it alone, so then no piece crosses
        a cut in any text.  Else a unit ends at the next mark only.
        """
        numeric = re.escape("".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
        fine = re.compile(rf"{MARK}*(?:[^\W\d_{numeric}]+|(?:[\d_{numeric}]|[^\w{MARK}\n])+)|{MARK}+|\n")
        if all(fine.findall(p) == [p] for p in self.ids):
            return fine
        return re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")

    @cached_property
    def unknown(self) -> int:
        return min(s for s in self.scores if s is not None) - UNKNOWN_PENALTY

    @cached_property
    def id_scores(self) -> np.ndarray:
        """What each id adds to the score of a text; of an unknown character's bytes the first one counts."""
        out = np.array([s or 0 for s in self.scores], np.int64)
        for b, i in enumerate(self.byte_ids):
            out[i] = 0 if 0x80 <= b < 0xC0 else self.unknown
        return out

    @cached_property
    def automaton(self):
        """Aho-Corasick over all pieces; a match carries (length, score, id)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, (len(piece), self.scores[i], i))
        found.make_automaton()
        return found

    @cached_property
    def plain(self) -> list[str]:
        """Text of each id; a byte above 0x7F as the lone surrogate that stands for it."""
        out = [p.replace(MARK, " ") for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i, s in enumerate(self.scores):
            if s is None and i not in set(self.byte_ids):
                out[i] = ""
        return out


_held: list[Vocabulary] = []


def _in_process(pieces: list[str], scores: list[int | None], byte_ids: list[int]) -> Vocabulary:
    """The process's own copy of a vocabulary that arrives with a task, so that what it remembers lasts."""
    if not _held or (_held[0].pieces, _held[0].scores) != (pieces, scores):
        _held[:] = [Vocabulary(pieces, scores, byte_ids)]
    return _held[0]


class Remembered:
    """A bounded memory of two generations: what is asked for again moves to the young one, the old one is dropped when that is full."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, unit: str, make: Callable):
        found = self.young.get(unit)
        if found is None:
            found = self.old.get(unit)
            if found is None:
                found = make(unit)
            if len(unit) < 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[unit] = found
        return found


def normalise(text: str) -> str:
    """Spaces as marks, and one more mark in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def units(text: str, vocabulary: Vocabulary) -> list[str]:
    """The units of a normalised text."""
    return vocabulary.unit_pattern.findall(text)


def _whole(text: str, vocabulary: Vocabulary) -> tuple[list, list]:
    """Best scores, and the matches they come from, at the ends of pieces, over all of ``text``; None is an unknown character.

    The automaton reports the matches at each end from the longest to the
    shortest, the order of the tie rule.
    """
    n = len(text)
    best: list[int] = [UNREACHED] * (n + 1)
    via: list[tuple | None] = [None] * (n + 1)
    best[0] = 0
    at, single = 1, False  # the end that is being filled
    unknown = vocabulary.unknown
    for last, match in vocabulary.automaton.iter(text):
        while at <= last:
            if not single and best[at - 1] + unknown > best[at]:  # an unknown character, if no piece of one character ends here
                best[at], via[at] = best[at - 1] + unknown, None
            at, single = at + 1, False
        length, score, _ = match
        if length == 1:
            single = True
        score += best[at - length]
        if score > best[at]:
            best[at], via[at] = score, match
    while at <= n:
        if not single and best[at - 1] + unknown > best[at]:
            best[at], via[at] = best[at - 1] + unknown, None
        at, single = at + 1, False
    return best, via


def count_unit(text: str, vocabulary: Vocabulary) -> int:
    """Pieces of a unit: best score and piece count are carried along, no piece is kept."""
    n = len(text)
    best: list[int | None] = [None] * (n + 1)
    count = [0] * (n + 1)
    best[0] = 0
    at, single = 1, False
    unknown = vocabulary.unknown

    def close() -> None:
        own = best[at - 1] + unknown
        if best[at] is None or own > best[at]:
            best[at], count[at] = own, count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))

    for last, (length, score, _) in vocabulary.automaton.iter(text):
        while at <= last:
            if not single:
                close()
            at, single = at + 1, False
        start = at - length
        if length == 1:
            single = True
        score += best[start]
        own = best[at]
        if own is None or score > own:
            best[at], count[at] = score, count[start] + 1
    while at <= n:
        if not single:
            close()
        at, single = at + 1, False
    return count[n]


def forward(text: str, stop: int, entries: dict[int, int], vocabulary: Vocabulary) -> tuple[list, list]:
    """Best scores and back steps of the positions of ``text`` reached by pieces that start before ``stop``.

    ``entries`` are the scores of positions reached from outside; they come
    first, so an equal score from inside doesn't replace them.  A back step is
    (start, id or None for an unknown character), or None at an entry.
    """
    ids, scores, longest, unknown = vocabulary.ids, vocabulary.scores, vocabulary.longest, vocabulary.unknown
    n = len(text)
    best: list[int | None] = [None] * (max(n, *entries) + 1)
    back: list[tuple | None] = [None] * len(best)
    for place, score in entries.items():
        best[place] = score
    for start in range(min(stop, n)):
        base = best[start]
        if base is None:
            continue
        single = False
        for end in range(start + 1, min(start + longest, n) + 1):
            piece = ids.get(text[start:end])
            if piece is not None:
                single = single or end == start + 1
                score = base + scores[piece]
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (start, piece)
        if not single:
            score = base + unknown
            if best[start + 1] is None or score > best[start + 1]:
                best[start + 1], back[start + 1] = score, (start, None)
    return best, back


def trace(text: str, end: int, back: list, vocabulary: Vocabulary) -> tuple[int, list[int]]:
    """The entry reached from ``end`` and the ids on the way, in order."""
    out: list[int] = []
    while back[end] is not None:
        start, piece = back[end]
        if piece is None:
            out += [vocabulary.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass"))]
        else:
            out.append(piece)
        end = start
    return end, out[::-1]


def segment_unit(text: str, vocabulary: Vocabulary) -> tuple[int, list[int]]:
    """Score and ids of a unit."""
    best, via = _whole(text, vocabulary)
    out: list[int] = []
    end = len(text)
    while end:
        match = via[end]
        if match is None:
            out += [vocabulary.byte_ids[b] for b in reversed(text[end - 1 : end].encode("utf-8", "surrogatepass"))]
            end -= 1
        else:
            out.append(match[2])
            end -= match[0]
    return best[len(text)], out[::-1]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of the ids, without the space that was put in front."""
    text = "".join(map(vocabulary.plain.__getitem__, ids)).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text
