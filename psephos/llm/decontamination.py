"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Words are lower-cased (A-Z) runs of non-blank characters; shingles are five of
them (an item or text with fewer words is one shingle).  For each item length,
windows of that many words slide over a text.  A window's 64-bit SimHash adds
up the weighted bits of its shingles; weights are the inverse document
frequencies of the items' shingles.  It is compared with the fingerprints of
all items of that length, in four blocks of 16 bits: a linear scan that takes
the place of a multi-index.  (Two fingerprints within radius 19 agree within 4
bits in at least one block, so a look-up by block would find the same items.)
Candidates are verified by exact weighted Jaccard similarity of the shingles
(0.8 or more).

A window without any shingle of the items has similarity 0 with all of them;
such windows are not fingerprinted.  The items travel to the texts, in passes
of at most ``MAX_ITEM_WORDS`` words, so what is broadcast stays bounded for a
benchmark of any size.  Weights come from the whole benchmark in every pass:
those of up to ``MAX_COMMON`` shingles that several items hold are broadcast
too, and nothing is shuffled.  Beyond that a pass is sent the weights of its own
shingles, and each text that holds one of them gets those of its other
shingles by a join, so no weight is left out.

Null and empty texts match nothing, nor do items without words; repeated items
count each under its id; of a text's windows the best for an item counts (the
first of equals).  Rows of ``docs`` with the same id are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import WORD, ship, written

SIZE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 4  # BLOCKS * (BLOCK_RADIUS + 1) > RADIUS
#: Words of the items of a pass, at most, and shingles of several items up to which the weights of all travel with it.
MAX_ITEM_WORDS, MAX_COMMON = 2_000_000, 2_000_000
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def lower_words(text: str | None) -> list[str]:
    """Words with A-Z, and nothing else, lower-cased (bytes know no other case)."""
    return WORD.findall(text.encode().lower().decode()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A hash of each run of ``size`` words; with fewer words, of all of them."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _M1 + words[i : n - k + 1 + i])
    return out


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 weighted sums: the bits with a sum over 0."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def signed_bits(sh: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of 64 signed weights for each shingle."""
    bits = np.unpackbits(_mix(sh ^ _M1).view(np.uint8).reshape(-1, 8), axis=1)
    return np.where(bits, weights[:, None], -weights[:, None])


def near_blocks(index: list[np.ndarray], fp: np.ndarray) -> np.ndarray:
    """Distances (fingerprints, items) of those within BLOCK_RADIUS in at least one block
    and within RADIUS in all; 255 for the others."""
    total = np.zeros((len(fp), len(index[0])), np.uint8)
    hit = np.zeros(total.shape, bool)
    for b in range(BLOCKS):
        part = (fp >> np.uint64(b * BLOCK_BITS)).astype(np.uint16)
        away = _POP16[part[:, None] ^ index[b][None, :]]
        hit |= away <= BLOCK_RADIUS
        total += away
    return np.where(hit & (total <= RADIUS), total, 255)


@dataclass
class Items:
    """The items of one pass."""

    ids: list[int]
    shingle: np.ndarray  # all shingles of the items, ascending
    common: np.ndarray  # shingles that several items of the whole benchmark hold, ascending
    weight: np.ndarray  # theirs
    unseen: float  # weight of any other shingle
    own: list[tuple[np.ndarray, np.ndarray]]  # each item's distinct shingles and counts
    by_length: dict[int, tuple[np.ndarray, list[np.ndarray], np.ndarray]]  # words: item numbers, blocks of their fingerprints, their shingles
    known: dict[str, int]  # words of the items, from 1
    hash_of: np.ndarray  # their hashes
    n: int  # items of the whole benchmark
    more: tuple[np.ndarray, np.ndarray] | None = None  # further common shingles, ascending, and their weights

    def with_counts(self, sh: np.ndarray, held: np.ndarray) -> Items:
        """These items where shingles ``sh``, too, are held by several: by as many as ``held``."""
        order = np.argsort(sh)
        return replace(self, more=(sh[order], np.log((1 + self.n) / held[order])))

    def may_match(self, words: list[str]) -> bool:
        """Does a text hold a shingle of the items?  Only runs of their words are hashed."""
        n, k = len(words), min(SIZE, *self.by_length)
        if n < k:
            return False
        get = self.known.get
        number = np.fromiter(map(get, words, repeat(0, n)), np.int64, n)
        run = number[: n - k + 1] > 0
        for i in range(1, k):
            run = run & (number[i : n - k + 1 + i] > 0)
        at = np.flatnonzero(run)
        if k < SIZE or not len(at):
            return len(at) > 0
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = _mix(h * _M1 + self.hash_of[number[at + i]])
        return bool((self.shingle[np.minimum(np.searchsorted(self.shingle, h), len(self.shingle) - 1)] == h).any())

    def weights(self, sh: np.ndarray) -> np.ndarray:
        out = np.full(len(sh), self.unseen)
        for common, weight in ((self.common, self.weight), *([self.more] if self.more else [])):
            if len(common):
                at = np.minimum(np.searchsorted(common, sh), len(common) - 1)
                out = np.where(common[at] == sh, weight[at], out)
        return out

    def similarity(self, item: int, sh: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and the shingles of a window."""
        a, na = self.own[item]
        b, nb = np.unique(sh, return_counts=True)
        both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        low = float(self.weights(both) @ np.minimum(na[ia], nb[ib]))
        return low / (float(self.weights(a) @ na) + float(self.weights(b) @ nb) - low)


def make_items(rows: list[tuple[int, str | None]], counts: tuple[int, np.ndarray, np.ndarray] | None = None) -> Items | None:
    """Items of (id, text) rows; None if no text has a word.

    ``counts``: where the rows are a part of the benchmark, the number of all its items, and the shingles
    that several of them hold (ascending) with how many; those of the rows at least.
    """
    words = [(i, lower_words(t)) for i, t in rows]
    known = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}), 1)}
    words = [(i, word_hashes(w)) for i, w in words]
    words = [(i, w) for i, w in words if len(w)]
    if not words:
        return None
    own = [np.unique(shingles(w), return_counts=True) for _, w in words]
    every, with_it = np.unique(np.concatenate([s for s, _ in own]), return_counts=True)
    n, common, held = counts if counts else (len(words), every[with_it > 1], with_it[with_it > 1])
    out = Items([i for i, _ in words], every, common, np.log((1 + n) / held), math.log(1 + n), own, {}, known, word_hashes(["", *known]), n)
    lengths: dict[int, list[int]] = {}
    for k, (_, w) in enumerate(words):
        lengths.setdefault(len(w), []).append(k)
    for size, members in lengths.items():
        sums = np.stack([signed_bits(s, out.weights(s) * c).sum(axis=0) for s, c in (own[k] for k in members)])
        fp = fingerprints(sums)
        blocks = [(fp >> np.uint64(b * BLOCK_BITS)).astype(np.uint16) for b in range(BLOCKS)]
        out.by_length[size] = np.array(members), blocks, np.unique(np.concatenate([own[k][0] for k in members]))
    return out


def find(items: Items, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item number, similarity, first word, end) of the items in a text, the best window of each."""
    words = lower_words(text)
    if not items.may_match(words):
        return []
    words = word_hashes(words)
    sh = shingles(words)
    at = np.minimum(np.searchsorted(items.shingle, sh), len(items.shingle) - 1)
    shared = np.flatnonzero(items.shingle[at] == sh)
    best: dict[int, tuple[float, int, int]] = {}
    signed = None
    for size, (members, index, own) in items.by_length.items():
        span = max(size - SIZE + 1, 1)  # shingles of a window
        if size < SIZE:  # such an item is one shingle of its own length
            sh_of = shingles(words, size)
            for k in members:
                first = np.flatnonzero(sh_of == items.own[k][0][0])
                if len(first):
                    best[int(k)] = (1.0, int(first[0]), int(first[0]) + size)
            continue
        here = shared[np.isin(sh[shared], own)]  # with the shingles of items of this length
        if not len(here):
            continue
        if len(sh) < span:
            starts = np.zeros(1, np.int64)  # the whole text is the window
        else:
            marks = np.zeros(len(sh) + 1, np.int64)  # windows that hold one of them
            np.add.at(marks, np.maximum(here - span + 1, 0), 1)
            np.add.at(marks, here + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[: len(sh) - span + 1]) > 0)
        if signed is None:
            # Running sums over the stretches around shared shingles only.
            reach = max(items.by_length)
            keep = np.zeros(len(sh) + 1, np.int64)
            np.add.at(keep, np.maximum(shared - reach, 0), 1)
            np.add.at(keep, np.minimum(shared + reach + 1, len(sh)), -1)
            near = np.flatnonzero(np.cumsum(keep[: len(sh)]) > 0)
            place = np.full(len(sh) + 1, -1)
            place[near] = np.arange(len(near))
            signed = np.zeros((len(near) + 1, 64))
            np.cumsum(signed_bits(sh[near], items.weights(sh[near])), axis=0, out=signed[1:])
        candidates = []  # distance, item, first shingle
        for part in np.array_split(starts, -(-len(starts) // 4096)) if len(starts) else []:
            last = np.minimum(part + span, len(sh)) - 1
            away = near_blocks(index, fingerprints(signed[place[last] + 1] - signed[place[part]]))
            candidates += [(int(away[w, k]), int(members[k]), int(part[w])) for w, k in zip(*np.nonzero(away < 255))]
        # The nearest first: a window equal to the item has distance 0, and no other can be better.
        for _, item, first in sorted(candidates):
            if item in best and best[item][0] >= 1 - 1e-9:
                continue
            s = items.similarity(item, sh[first : first + span])
            if s >= SIMILARITY and (item not in best or (-s, first) < (-best[item][0], best[item][1])):
                best[item] = s, first, min(first + size, len(words))
    return [(k, *v) for k, v in sorted(best.items())]


def passes(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most MAX_ITEM_WORDS words (or one item), streamed by the driver."""
    batch, n = [], 0
    for r in benchmark.select(F.col(id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        words = len(r["t"].split()) + 1
        if batch and n + words > MAX_ITEM_WORDS:
            yield batch
            batch, n = [], 0
        batch.append((r["i"], r["t"]))
        n += words
    yield batch


def _shingles_of(texts: Column) -> Column:
    """The distinct shingles of each text."""

    @F.arrow_udf("array<bigint>")
    def held(texts: pa.Array) -> pa.Array:
        hashed = [word_hashes(lower_words(t.as_py())) for t in texts]
        return pa.array([np.unique(shingles(w)).view(np.int64) if len(w) else [] for w in hashed], pa.list_(pa.int64()))

    return held(texts)


def item_counts(benchmark: DataFrame, text: str) -> tuple[int, DataFrame]:
    """Over the whole benchmark: the items with a word, and the shingles ``h`` that several hold with how many, ``k`` (written)."""
    each = benchmark.select(_shingles_of(F.col(f"`{text}`")).alias("h")).where(F.size("h") > 0)
    several = each.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    return each.count(), written(several, "item-shingles")


def _fetched(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``item_counts`` (a bounded number) as shingles, ascending, and numbers of items."""
    got = counts.toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got["k"].to_numpy()[order]


def pass_counts(several: DataFrame, rows: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the shingles that several items hold, those of the items of one pass: as many as their words at most."""
    held = [shingles(word_hashes(lower_words(t))) for _, t in rows]
    own = pa.table({"h": np.unique(np.concatenate(held)).view(np.int64)}) if held else pa.table({"h": pa.array([], pa.int64())})
    return _fetched(several.join(F.broadcast(several.sparkSession.createDataFrame(own)), "h", "left_semi"))


def _digest(text: str) -> Column:
    return F.sha2(F.col(f"`{text}`").cast("binary"), 256)


def text_counts(docs: DataFrame, text: str, sent, several: DataFrame) -> DataFrame:
    """Of the shingles that several items hold, those of each text that may match the pass ``sent``: rows of the text's
    digest, ``_text``, and an array of (h, k), ``_held`` (written).

    Copies of a text are looked up once; texts without a shingle of the pass are not shuffled.
    """

    @F.arrow_udf("boolean")
    def may_match(texts: pa.Array) -> pa.Array:
        items = sent.value
        return pa.array([bool(items) and items.may_match(lower_words(t.as_py())) for t in texts], pa.bool_())

    near = docs.select(_digest(text).alias("_text"), F.col(f"`{text}`").alias("t")).where(may_match("t"))
    near = near.select("_text", _shingles_of(F.col("t")).alias("h")).groupBy("_text").agg(F.first("h").alias("h"))
    held = near.select("_text", F.explode("h").alias("h")).join(several, "h")
    return written(held.groupBy("_text").agg(F.collect_list(F.struct("h", "k")).alias("_held")), "text-shingles")


def _matcher(sent):
    """An Arrow UDF from texts, and what ``with_weights`` found for them, to the items found; ``sent`` is a broadcast of the items."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    @F.arrow_udf("array<struct<item_id:bigint,similarity:double,first_word:int,end_word:int>>")
    def matches(texts: pa.Array, *more: pa.Array) -> pa.Array:
        items = sent.value
        found = []
        for i, t in enumerate(texts):
            its = items
            if items and more and more[0][i].is_valid:
                got = more[0][i].values
                its = items.with_counts(got.field("h").to_numpy().view(np.uint64), got.field("k").to_numpy())
            found.append(find(its, t.as_py()) if items else [])
        return pa.array([[{"item_id": items.ids[k], "similarity": s, "first_word": a, "end_word": b} for k, s, a, b in f] for f in found], type=kind)

    return matches


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column has it."""
    while name in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def found_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Iterator[tuple[Callable[[DataFrame], DataFrame], Column]]:
    """For each pass over the items what prepares rows of ``docs``, and a column of the prepared rows: an array of
    (item_id, similarity, first_word, end_word).

    A shingle's weight comes from the whole benchmark, so the passes, and the order of its rows, change nothing.
    """
    ship(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast
    column = F.col(f"`{text}`")
    key, weights = _free(docs, "_text"), _free(docs, "_held")
    batches = passes(benchmark, item_id, item_text)
    first = next(batches)
    second = next(batches, None)
    if second is None:
        yield lambda rows: rows, _matcher(send(make_items(sorted(first))))(column)
        return
    n, several = item_counts(benchmark, item_text)
    every = _fetched(several) if several.count() <= MAX_COMMON else None
    for rows in chain((first, second), batches):
        sent = send(make_items(sorted(rows), (n, *(every or pass_counts(several, rows)))))
        if every:
            yield lambda rows: rows, _matcher(sent)(column)
        else:
            held = text_counts(docs, text, sent, several).toDF(key, weights)
            yield lambda rows, held=held: rows.join(held, _digest(text) == held[key], "left"), _matcher(sent)(column, F.col(weights))


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each text and item found in it: doc_id, item_id, similarity, first_word, end_word."""
    docs = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for prepared, found in found_items(docs, benchmark, "text", item_id, item_text):
        one = prepared(docs).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    kept = docs
    for prepared, found in found_items(docs, benchmark, text, item_id, item_text):
        kept = prepared(kept).where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept
