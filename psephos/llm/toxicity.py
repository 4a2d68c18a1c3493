"""Toxicity: votes of the nearest labelled texts by exact TF-IDF cosine.

The examples are a sample of at most ``max_labelled`` labelled texts, clean
ones included (repeated texts count once).  With ``max_terms=None``, as the
queries have it, the cosine is taken over all terms of the texts: those of a
text that no example holds count in its length.  With a number, vectors hold
only that many terms, those that the log-likelihood ratio ties to the label,
and only texts with such terms are examples: a lexicon, not the whole texts.

The examples lie in blocks of 64, alike in frequent terms and length.  Their
vectors form an inverted index: postings by term for most terms, and for the
``DENSE`` terms found in most examples, whose postings would fill every block, a
matrix, with the greatest weight of every such term in each block.  A batch of
texts first adds up the postings of its rarer terms, exactly, for all examples.
A bound on the cosine of every block follows from the block's best sum and the
greatest weights of the dense terms; blocks are opened (their rows of the matrix multiplied):
a text's highest bound first, whose k-th best cosine is a floor, then those that the floor of some text
of the batch leaves; the others stay closed.
What comes near the k-th best is computed again in double precision, so the k
nearest are exact (equal cosines: the smaller id).  Their votes, weighted by
cosine and shrunk to the sample's rate, are mapped to probabilities by an
isotonic fit on leave-one-out votes.

The sample has at most ``max_labelled`` rows, and with them at most
``MAX_CHARACTERS`` characters, so the index is bounded in bytes; what is sent to a
worker is the terms as 64-bit hashes and the examples' terms with their counts.
An executor holds an index for each of its workers, so a weight in double precision
is not kept but made of its parts (the count's logarithm, the idf, the example's
length), which take a byte or two an entry instead of eight, and a worker fills
the postings and the matrix by ``ENTRIES`` entries at a time.

Null and empty texts, and texts without any of the terms, get the rate of
label 1 among the sampled texts without such terms, and no evidence.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import labelled_sample, ship, written

TERM = re.compile(r"[^\W\d_]+")
#: Labelled rows that are learnt from, and terms that are kept, at most.
MAX_LABELLED, MAX_TERMS = 10_000, 1_024
#: Characters of the sampled texts, at most (rows are taken in the order of the sample until then).
MAX_CHARACTERS = 100_000_000
#: Least texts with a term, and least log-likelihood ratio (chance of one in 100,000).
LEAST_TEXTS, LEAST_RATIO = 5, 19.5
#: Least share of label 1 among the texts with a term.
LEAST_SHARE = 0.5
#: Examples whose leave-one-out votes are fitted, at most (evenly spaced).
MAX_CALIBRATION = 2_000
NEIGHBOURS, BLOCK, SHRINK = 16, 64, 1.0
#: Terms whose postings are a matrix; texts that are looked up together.
DENSE, TOGETHER = 512, 128
#: More than single precision can be off by.
EPS = 1e-5
#: Examples are put in blocks by groups, found from their most frequent terms in a few passes.
GROUPS, FREQUENT_TERMS, PASSES = 16, 512, 3
#: Answers kept in a worker before they are dropped.
CACHE = 4_000
#: Entries that are put into the postings, and rows of the matrix that are multiplied, at once.
ENTRIES, ROWS = 100_000, 2_048


def terms(text: str | None) -> list[str]:
    """Words, lower-cased."""
    return TERM.findall(text.lower()) if text else []


def ratio(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of a term in ``a`` of n1 texts of label 1 and ``b`` of n0 others."""

    def part(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)

    if not n1 or not n0:
        return 0.0
    p = (a + b) / (n1 + n0)
    if p >= 1:
        return 0.0
    return 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, p) - part(b, n0, p))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y by x (pool adjacent violators)."""
    xs, at = np.unique(x, return_inverse=True)
    w = np.bincount(at).astype(float)
    pools: list[list[float]] = []  # mean, weight, first, last
    for i, (m, n) in enumerate(zip(np.bincount(at, weights=y) / w, w)):
        pools.append([m, n, i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, n2, _, last = pools.pop()
            m1, n1, first, _ = pools.pop()
            pools.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, first, last])
    knots = sorted({int(k) for p in pools for k in (p[2], p[3])})
    value = {int(k): p[0] for p in pools for k in (p[2], p[3])}
    return xs[knots], np.array([value[k] for k in knots])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, end) of rows with about ``ENTRIES`` entries; a row's first entry is at ``starts``, whose last number is their number."""
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], ENTRIES)), len(starts) - 1)).tolist()
    return list(zip(edges[:-1], edges[1:]))


def hashes(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Index:
    """Examples (in the order of their ids) by term; see the module's text."""

    vocabulary: list[str] | None  # the terms' words, where they are known
    hashed: np.ndarray  # hashes of the terms, ascending
    numbers: np.ndarray  # and the terms' numbers
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    base: float  # label 1 among sampled texts without terms
    rate: float  # and among the examples
    unseen: float = 0.0  # idf of a term without examples; 0: such terms do not count
    examples: np.ndarray | None = None  # example number by place
    starts: np.ndarray | None = None  # by place: its first entry
    cols: np.ndarray | None = None  # by entry: the term, ascending within a place
    codes: np.ndarray | None = None  # by entry: the number of its count's logarithm in logs
    logs: np.ndarray | None = None  # 1 + log of the counts that there are
    lengths: np.ndarray | None = None  # by place: of the vector before it got unit length
    knots: tuple[np.ndarray, np.ndarray] | None = None
    cache: dict = field(default_factory=dict)
    ready: dict = field(default_factory=dict)  # what a worker derives

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "ready": {}}

    def vector(self, counts: dict[int, int], rest: float = 0.0) -> tuple[list[int], np.ndarray]:
        """Terms, ascending, and weights (1 + log of the count, by idf) of unit length with ``rest``, a sum of squares."""
        found = sorted(counts)
        w = (1 + np.log([counts[t] for t in found])) * self.idf[found]
        return found, w / np.sqrt(w @ w + rest)

    def numbered(self, words: list[str]) -> np.ndarray:
        """The terms' numbers, -1 for words that no example holds."""
        if not len(self.hashed):
            return np.full(len(words), -1, np.int64)
        h = hashes(words)
        at = np.minimum(np.searchsorted(self.hashed, h), len(self.hashed) - 1)
        return np.where(self.hashed[at] == h, self.numbers[at], -1).astype(np.int64)

    def counts(self, text: str | None) -> tuple[dict[int, int], float]:
        """Counts of the terms, and the sum of squared weights of those without examples."""
        t, n, rest = self._counts(text)
        return dict(zip(t.tolist(), n.tolist())), rest

    def _counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
        found = Counter(terms(text))
        t, n = self.numbered(list(found)), np.fromiter(found.values(), np.int64, len(found))
        known = t >= 0
        return t[known], n[known], float((((1 + np.log(n[~known])) * self.unseen) ** 2).sum())

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Terms and weights of unit length of a text; None without any term."""
        t, n, rest = self._counts(text)
        if not len(t):
            return None
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt(w @ w + rest)

    def build(self, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray) -> None:
        """Weights of the terms ``cols`` of the examples ``rows``, ascending, put in the places' order."""
        n, size = len(self.labels), len(self.idf)
        there = np.unique(counts)
        self.logs = 1 + np.log(there)
        starts = np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int64)
        codes, w = np.empty(len(cols), np.min_scalar_type(len(there))), np.empty(len(cols), np.float32)
        lengths = np.ones(n)
        for first, end in runs(starts):
            some = slice(starts[first], starts[end])
            codes[some] = np.searchsorted(there, counts[some])
            x, row = self.logs[codes[some]] * self.idf[cols[some]], rows[some] - first
            length = np.sqrt(np.bincount(row, weights=x * x, minlength=end - first))
            lengths[first:end] = np.where(length > 0, length, 1)  # 0: an example without terms
            w[some] = x / lengths[first:end][row]
        self.examples = arrange(rows, cols, w, n, size)
        del w
        sizes = np.diff(starts)[self.examples]
        self.starts, self.lengths = np.append(0, np.cumsum(sizes)).astype(np.int64), lengths[self.examples]
        self.cols, self.codes = np.empty(len(cols), np.int32), np.empty_like(codes)
        for first, end in runs(self.starts):
            entries = ranges(starts[self.examples[first:end]], sizes[first:end])
            entries = entries[np.lexsort((cols[entries], np.repeat(np.arange(end - first), sizes[first:end])))]
            some = slice(self.starts[first], self.starts[end])
            self.cols[some], self.codes[some] = cols[entries], codes[entries]

    def weights(self, places: np.ndarray, entries: np.ndarray | slice) -> np.ndarray:
        """Weights of the ``entries``, each of the place beside it."""
        return self.logs[self.codes[entries]] * self.idf[self.cols[entries]] / self.lengths[places]

    def prepared(self) -> dict:
        """Matrix and greatest weights of the dense terms, and the others' postings."""
        if not self.ready:
            n, size = len(self.labels), len(self.idf)
            blocks = -(-n // BLOCK)
            held = np.bincount(self.cols, minlength=size)
            dense = np.argsort(-held, kind="stable")[:DENSE]
            column = np.full(size, -1, np.int32)
            column[dense] = np.arange(len(dense), dtype=np.int32)
            matrix = np.zeros((blocks * BLOCK, len(dense)), np.float32)
            held[dense] = 0
            firsts = np.append(0, np.cumsum(held))
            places, weights = np.empty(firsts[-1], np.min_scalar_type(n)), np.empty(firsts[-1], np.float32)
            free = firsts[:-1].copy()
            for first, end in runs(self.starts):  # a term's postings stay in the order of their places
                entries = slice(self.starts[first], self.starts[end])
                place = np.repeat(np.arange(first, end), np.diff(self.starts[first : end + 1]))
                cols, w = self.cols[entries], self.weights(place, entries)
                some = np.flatnonzero(column[cols] >= 0)
                matrix[place[some], column[cols[some]]] = w[some]
                some = np.flatnonzero(column[cols] < 0)
                some = some[np.argsort(cols[some], kind="stable")]
                term, sizes = np.unique(cols[some], return_counts=True)
                at = ranges(free[term], sizes)
                places[at], weights[at] = place[some], w[some]
                free[term] += sizes
            self.ready = {
                "column": column,
                "matrix": matrix,
                "tops": matrix.reshape(blocks, BLOCK, -1).max(axis=1) if n else matrix,
                "places": places,
                "weights": weights,
                "firsts": firsts,
                "query": np.zeros(size),
                "place_of": np.argsort(self.examples),
            }
        return self.ready

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS, leave: int = -1, rest: float = 0.0) -> list[tuple[float, int]]:
        """The k nearest examples with a cosine over 0: (cosine, example number), best first."""
        return self.nearest_many([self.vector(counts, rest)], k, [leave])[0]

    def nearest_many(self, queries: list[tuple[list[int], np.ndarray]], k: int = NEIGHBOURS, leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The same for many vectors; ``leave``: an example (or -1) that each of them leaves out."""
        out = []
        for at in range(0, len(queries), TOGETHER):
            out += self._nearest_group(queries[at : at + TOGETHER], k, leave[at : at + TOGETHER] if leave else None)
        return out

    def _nearest_group(self, queries, k: int, leave) -> list[list[tuple[float, int]]]:
        if not len(self.labels):
            return [[] for _ in queries]
        r = self.prepared()
        matrix, tops, firsts, column = r["matrix"], r["tops"], r["firsts"], r["column"]
        m, n, blocks = len(queries), len(matrix), len(tops)
        x, sums = np.zeros((m, matrix.shape[1]), np.float32), np.empty((m, n), np.float32)
        for j, (t, q) in enumerate(queries):
            t = np.array(t, np.int64)
            c = column[t]
            x[j, c[c >= 0]] = q[c >= 0]
            sizes = firsts[t + 1] - firsts[t]  # 0 for dense terms
            p = ranges(firsts[t], sizes)
            sums[j] = np.bincount(r["places"][p], weights=np.repeat(q, sizes) * r["weights"][p], minlength=n)
        bound = sums.reshape(m, blocks, BLOCK).max(axis=2) + x @ tops.T
        left = np.full(m, -1) if leave is None else np.array([r["place_of"][e] if e >= 0 else -1 for e in leave])
        # First every text's best block: the k-th best there is a floor for the k-th best of all.
        best, floor = bound.argmax(axis=1), np.zeros(m, np.float32)
        for b in np.unique(best):
            some, at = np.flatnonzero(best == b), slice(b * BLOCK, (b + 1) * BLOCK)
            first = sums[some, at] + x[some] @ matrix[at].T
            own = np.flatnonzero((left[some] >= at.start) & (left[some] < at.stop))
            first[own, left[some][own] - b * BLOCK] = -1
            floor[some] = np.partition(first, -k, axis=1)[:, -k] if BLOCK >= k else 0
        # Then the blocks that some text's bound leaves, together.
        floor = np.maximum(floor, 0)
        opened = np.flatnonzero((bound + EPS >= floor[:, None]).any(axis=0))
        rows = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        cosines = np.take(sums, rows, axis=1) if len(opened) < blocks else sums  # by rows in memory, as the steps below go
        for at in range(0, len(rows), ROWS):
            cosines[:, at : at + ROWS] += x @ matrix[rows[at : at + ROWS]].T
        own = np.flatnonzero(left >= 0)
        at = np.searchsorted(rows, left[own])
        there = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == left[own])
        cosines[own[there], at[there]] = -1
        cosines[:, rows >= len(self.labels)] = -1
        floor = np.maximum(floor, np.partition(cosines, -k, axis=1)[:, -k] if cosines.shape[1] >= k else 0) - EPS
        found = []
        for j, (t, q) in enumerate(queries):
            place = rows[np.flatnonzero(cosines[j] >= floor[j])]
            r["query"][t] = q
            sizes = self.starts[place + 1] - self.starts[place]
            entry = ranges(self.starts[place], sizes)
            by = np.repeat(np.arange(len(place)), sizes)
            exact = np.round(np.bincount(by, weights=r["query"][self.cols[entry]] * self.weights(place[by], entry), minlength=len(place)), 12)
            r["query"][t] = 0
            number = self.examples[place]
            best = np.lexsort((number, -exact))[:k]
            found.append([(float(exact[b]), int(number[b])) for b in best if exact[b] > 0])
        return found

    def vote(self, near: list[tuple[float, int]]) -> float:
        cos = np.array([c for c, _ in near])
        y = self.labels[[e for _, e in near]] if near else np.zeros(0)
        return float((cos @ y + SHRINK * self.rate) / (cos.sum() + SHRINK))

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """Probability of label 1, and the nearest examples (cosine, id)."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """The same for many texts; equal ones are looked up once."""
        keys = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        got, missing = {}, []
        for key, text in zip(keys, texts):
            if key in got:
                continue
            got[key] = self.cache.get(key)
            if got[key] is None:
                query = self.query(text)
                if query is None:
                    got[key] = self.base, []
                else:
                    missing.append((key, query))
        for (key, _), near in zip(missing, self.nearest_many([q for _, q in missing])):
            got[key] = self.cache[key] = float(np.interp(self.vote(near), *self.knots)), [(c, int(self.ids[e])) for c, e in near]
        return [got[key] for key in keys]


def arrange(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """An order of the n examples that puts like ones side by side: by groups (k-means over frequent terms), then by the number of terms."""
    if not n:
        return np.zeros(0, np.int64)
    top = np.argsort(-np.bincount(cols, minlength=size), kind="stable")[:FREQUENT_TERMS]
    column = np.full(size, -1, np.int32)
    column[top] = np.arange(len(top), dtype=np.int32)
    x = np.zeros((n, len(top)), np.float32)
    held = np.flatnonzero(column[cols] >= 0)
    x[rows[held], column[cols[held]]] = weights[held]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[np.linspace(0, n - 1, GROUPS).astype(int)]
    for _ in range(PASSES):
        group = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[group == g].sum(axis=0) for g in range(GROUPS)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.lexsort((np.bincount(rows, minlength=n), group))


def make_index(ids, texts_counts, labels, vocabulary: list[str], texts_with: list[int], sampled: int, base: float) -> Index:
    """An index of the examples given as ids, {term: count} and labels, in ascending order of ids."""
    rows = np.repeat(np.arange(len(texts_counts)), [len(c) for c in texts_counts])
    cols = np.array([t for c in texts_counts for t in c], np.int64)
    counts = np.array([k for c in texts_counts for k in c.values()], np.int64)
    return index_of(ids, rows, cols, counts, labels, vocabulary, texts_with, sampled, base)


def index_of(ids, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, labels, vocabulary, texts_with, sampled: int, base: float, whole: bool = False) -> Index:
    """The same from the examples' terms as flat arrays, by example; the vocabulary is words, or their hashes;
    ``whole``: terms outside the vocabulary count in the length."""
    idf = np.log((1 + sampled) / (1 + np.array(texts_with, float))) + 1
    y = np.array(labels, float)
    words = None if isinstance(vocabulary, np.ndarray) else list(vocabulary)
    h = vocabulary if words is None else hashes(words)
    order = np.argsort(h, kind="stable")
    out = Index(words, h[order], order.astype(np.int32), idf, y, np.array(ids, np.int64), base, float(y.mean()) if len(y) else base)
    out.unseen = math.log(1 + sampled) + 1 if whole else 0.0
    out.build(rows, cols, counts)
    if len(y):
        some = range(0, len(y), -(-len(y) // MAX_CALIBRATION))
        edges = np.append(0, np.cumsum(np.bincount(rows, minlength=len(y))))
        of = lambda e: dict(zip(cols[edges[e] : edges[e + 1]].tolist(), counts[edges[e] : edges[e + 1]].tolist()))
        near = out.nearest_many([out.vector(of(e)) for e in some], leave=list(some))
        out.knots = isotonic(np.array([out.vote(x) for x in near]), y[some])
        out.ready = {}
    else:
        out.knots = np.array([0.0, 1.0]), np.array([base, base])
    return out


def fit_whole(sample: DataFrame) -> Index:
    """An index of all rows of ``sample`` (id, y, text) over all their terms."""

    @F.arrow_udf("struct<terms:array<bigint>,counts:array<int>>")
    def counted(texts: pa.Array) -> pa.Array:
        found = [Counter(terms(t.as_py())) for t in texts]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32())]
        hashed = [hashes(list(c)).view(np.int64) for c in found]
        return pa.StructArray.from_arrays([pa.array(hashed, kinds[0]), pa.array([list(c.values()) for c in found], kinds[1])], ["terms", "counts"])

    got = sample.select("id", "y", counted("text").alias("c")).select("id", "y", "c.terms", "c.counts").toArrow().sort_by("id")  # at most max_labelled rows
    ids, y = got["id"].to_numpy(), got["y"].to_numpy()
    sizes = np.array(pc.list_value_length(got["terms"]), np.int64)
    counts = pc.list_flatten(got["counts"]).to_numpy()
    hashed = pc.list_flatten(got["terms"]).to_numpy().view(np.uint64)
    vocabulary, cols = np.unique(hashed), np.empty(len(hashed), np.int32)
    for at in range(0, len(cols), ENTRIES):
        cols[at : at + ENTRIES] = np.searchsorted(vocabulary, hashed[at : at + ENTRIES])
    del got, hashed
    pa.default_memory_pool().release_unused()
    held = sizes > 0
    rows = np.repeat(np.arange(int(held.sum()), dtype=np.int32), sizes[held])
    n, n1, rest, rest1 = len(y), int(y.sum()), int((~held).sum()), int(y[~held].sum())
    base = (rest1 + 0.5 * (n1 / n if n else 0.5)) / (rest + 0.5)
    return index_of(ids[held], rows, cols, counts, y[held], vocabulary, np.bincount(cols, minlength=len(vocabulary)), n, base, whole=True)


def give_back() -> None:
    """Memory that the fit has freed goes back to the system, where the C library can do that; the driver's later stages need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(sample: DataFrame, most: int = MAX_CHARACTERS) -> DataFrame:
    """The rows of ``sample`` (id, text, y), in the order of a hash of the id, until their texts have ``most`` characters."""
    sizes = sample.select(F.col("id"), F.length("text").alias("n")).collect()  # at most max_labelled rows of two numbers
    if sum(r["n"] or 0 for r in sizes) <= most:
        return sample
    spark, total, kept = sample.sparkSession, 0, []
    for r in sample.select("id", F.xxhash64(F.col("id").cast("string")).alias("h"), F.length("text").alias("n")).orderBy("h", "id").collect():
        total += r["n"] or 0
        if total > most:
            break
        kept.append((r["id"],))
    chosen = spark.createDataFrame(kept, sample.select("id").schema)
    return sample.join(F.broadcast(chosen), "id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_terms: int | None = MAX_TERMS) -> Index:
    """An index learnt from at most ``max_labelled`` rows of ``labels`` (id, label); over all terms if ``max_terms`` is None."""

    ship(docs.sparkSession)

    @F.arrow_udf("array<string>")
    def distinct_terms(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(terms(t.as_py()))) for t in texts], type=pa.list_(pa.string()))

    sample = labelled_sample(docs, labels, label, max_labelled, id, text).withColumnRenamed(id, "id")
    sample = bounded(written(sample, "toxicity-labelled"))
    # Copies of a text are one example, with the label most of them have.
    copies = sample.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("id").alias("id"), F.round(F.avg("y")).cast("int").alias("y"))
    if max_terms is None:
        index = fit_whole(copies)
        give_back()
        return index
    sample = written(copies.select("id", "y", "text", distinct_terms("text").alias("terms")), "toxicity-sample")
    n1, n = sample.agg(F.sum("y"), F.count("y")).first()
    n1, n = int(n1 or 0), int(n)
    by_term = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count("y").alias("n"))
    by_term = by_term.where((F.col("n") >= LEAST_TEXTS) & (F.col("a") >= LEAST_SHARE * F.col("n")))
    # Only terms of at least LEAST_TEXTS sampled texts remain; those most tied to the label are few.
    share = F.col("a") / F.col("n")
    kept = by_term.orderBy(-(share - n1 / max(n, 1)) * F.sqrt("n"), "term").limit(4 * max_terms).collect()
    scored = sorted(((-ratio(r["a"], r["n"] - r["a"], n1, n - n1), r["term"], r["n"]) for r in kept))
    scored = sorted((t, k) for r, t, k in scored[:max_terms] if -r >= LEAST_RATIO)
    vocabulary = [t for t, _ in scored]
    known = {t: i for i, t in enumerate(vocabulary)}

    @F.arrow_udf("array<struct<t:int,k:int>>")
    def known_counts(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("t", pa.int32()), ("k", pa.int32())]))
        return pa.array([[{"t": t, "k": k} for t, k in Counter(known[w] for w in terms(x.as_py()) if w in known).items()] for x in texts], type=kind)

    with_terms = sample.select("id", "y", known_counts("text").alias("counts"))
    examples = with_terms.where(F.size("counts") > 0).collect() if vocabulary else []  # at most max_labelled
    rows = sorted(((r["id"], {c["t"]: c["k"] for c in r["counts"]}, r["y"]) for r in examples), key=lambda r: r[0])
    rest, rest1 = n - len(rows), n1 - sum(y for _, _, y in rows)
    base = (rest1 + 0.5 * (n1 / n if n else 0.5)) / (rest + 0.5)
    return make_index([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], vocabulary, [k for _, k in scored], n, base)


def score_texts(texts: Column, index, evidence: bool = False) -> Column:
    """Struct of ``score`` and ``nearest`` (id and cosine); ``index`` is a broadcast of an ``Index``."""
    kind = pa.struct([("score", pa.float64()), ("nearest", pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())])))])

    @F.arrow_udf("struct<score:double,nearest:array<struct<id:bigint,cosine:double>>>")
    def scored(batch: pa.Array) -> pa.Array:
        out = []
        for s, near in index.value.scores(batch.to_pylist()):
            out.append({"score": s, "nearest": [{"id": i, "cosine": c} for c, i in near] if evidence else []})
        return pa.array(out, type=kind)

    return scored(texts)
