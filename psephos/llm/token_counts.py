"""Token counts of a unigram tokenizer without its pieces: a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary yields, at each character, all
pieces that end there; dynamic programming over the characters carries the
best score and the number of pieces of the best segmentation, nothing else.
The tie rule is the tokenizer's: among equal scores the piece that starts
first (the longest) stays.  A character without a piece of its own counts as
one unknown piece scored ten under the lowest score; with byte fallback it
counts as its bytes.

Blanks become the blank mark and one is put in front (only that; models with a
character map are refused).  No piece reaches over the cut before a run of
marks, which is checked, so every such run is counted once and kept in a
bounded cache.  Scores are summed in double precision within a run; a library
that sums a whole text in single precision may round otherwise in long texts.

A null text counts as empty: 0 tokens.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos.llm.piece_encoding import BLANK, read_pieces

UNKNOWN_PENALTY = 10.0
#: Runs kept in a worker's cache before it is emptied.
CACHE_RUNS = 1_000_000


def rank_vocabulary(blob: bytes) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a model file's plain pieces, each scored by the negative of its place
    in the file (the commoner a piece, the earlier), and whether bytes stand in for unknown characters."""
    pieces, _, kinds, charmap, fallback = read_pieces(blob)
    if charmap or any(k in (4, 5) for k in kinds):
        raise ValueError("models with a character map, user-defined or unused pieces are not handled")
    return [(p, -float(i)) for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1], fallback


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        if any(BLANK in p.lstrip(BLANK) for p, _ in vocabulary):
            raise ValueError("pieces of several words are not handled")
        self.byte_fallback = byte_fallback
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.singles = frozenset(p for p, _ in vocabulary if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, s in vocabulary:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def count_run(self, run: str) -> int:
        """Pieces of the best segmentation of ``run``."""
        n = len(run)
        best, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
        if self.singles.issuperset(run):
            # The automaton reports the pieces that end at a place from the longest, which starts first.
            for end, (size, score) in self.automaton.iter(run):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[end + 1 - size] + 1
            return pieces[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(run):
            ends[end].append(found)
        unknown = [False] * (n + 1)
        for end in range(n):
            for size, score in ends[end]:
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[end + 1 - size] + 1
            if run[end] not in self.singles and best[end] + self.unknown > best[end + 1]:
                best[end + 1], unknown[end + 1] = best[end] + self.unknown, True
                # Unknown characters side by side are one token, unless bytes stand in for them.
                pieces[end + 1] = pieces[end] + (len(run[end].encode()) if self.byte_fallback else not unknown[end])
        return pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, marks, cache = 0, 1, self.cache  # the mark put in front
        words = text.replace(" ", BLANK).split(BLANK)
        for i, w in enumerate(words):
            if i:
                marks += 1
            if not w and i < len(words) - 1:
                continue
            run = BLANK * marks + w
            marks = 0
            hit = cache.get(run)
            if hit is None:
                hit = self.count_run(run)
                if len(run) <= 64:
                    if len(cache) >= CACHE_RUNS:
                        cache.clear()
                    cache[run] = hit
            total += hit
        return total


#: A Python worker's counter, kept between its tasks with its cache.
_COUNTERS: dict[int, Counter] = {}


def count_tokens(texts: Column, vocabulary: list[tuple[str, float]], byte_fallback: bool) -> Column:
    """Number of tokens of each text."""
    key = hash((tuple(vocabulary), byte_fallback))

    @F.arrow_udf("bigint")
    def counted(batch: pa.Array) -> pa.Array:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(vocabulary, byte_fallback)
        counter = _COUNTERS[key]
        return pa.array(np.fromiter((counter.count(t.as_py()) for t in batch), np.int64, len(batch)))

    return counted(texts)
