"""MinHash near-duplicates: banded candidates, sequential Bayesian verification,
exact confirmation, connected components.

A text's set holds its distinct shingles of ``size`` words (A-Z lower-cased;
with fewer words the whole sequence is one; without words the set is empty and
linked with nothing).  Two texts are linked if the Jaccard similarity of their
sets is at least ``percent`` / 100.

1. Texts with the same set are one class, stood for by its smallest id.
2. Classes get bands of ``ROWS`` minimum hashes, and a further signature for
   verification.  Classes that share a band's key are in one bucket; there are
   so many bands that a pair at the threshold shares none with a chance of at
   most ``NO_BAND``.
3. Of the classes in buckets of two or more, the shingles that no other of
   them has are counted.  A class of n shingles with c shared ones has a
   similarity of c / n at most to any other.  The shared ones are also counted by
   ``PARTS`` parts of the hashes' space: a pair overlaps in the sum of the smaller
   counts at most.  Both are exact bounds, so what falls short of the threshold goes
   without being compared.  Heavily edited copies, and texts that share only a
   template, go here, whatever the size of their bucket; it is done ``PEELS``
   times, as what is gone leaves others' shingles unshared.
4. In every bucket the first members, its leaders, are paired with the others
   that are not yet in their component; the leaders are then done with and
   leave the bucket.  First come those with the greatest share of shared
   shingles: the text that the others are copies of.  A round's pairs are
   verified, the links it finds are
   contracted to components, and the next round takes ``GROWTH`` times as
   many leaders, up to ``MOST_LEADERS``.  A bucket whose members are in one component is done; once the
   pairs of all others are few for the number of documents (``PAIRS_A_ROW``), the last round takes
   every member as a leader.  So no pair is skipped but those that the bounds rule out, and those whose ends a chain of
   links already joins, and a bucket of n copies costs about n pairs.
5. A pair's signatures are compared in batches; after each, it is given up if
   the posterior chance (uniform prior) that its similarity reaches the
   threshold is under ``MISS``.  Survivors are confirmed on full sets.  A link is
   missed with a chance of at most ``NO_BAND`` + (batches x ``MISS``), about 4 in 10**7.
6. Components are found by passing on the least id, with shortcuts.

Leaders are rows, joined with the members of their bucket; those of a bucket
with very many members are repeated over ``SALTS`` numbers, over which its
members are spread.

Null texts count as empty.  Ids are whole numbers.  Rows of one id are one document, linked if any of
them is, with the largest n_shingles.  Null ids are left out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm.common import WORD, attach, hot_limit, ship, written

ROWS, NO_BAND, MOST_BANDS = 4, 1e-9, 64
VERIFY, BATCH, MISS = 64, 16, 1e-7
#: Leaders of a bucket in the first round, growth by round, and the most (under Spark's limit for a window's group limit).
LEADERS, GROWTH, MOST_LEADERS = 1, 4, 512
PEELS, PARTS, SALTS = 2, 32, 32
#: Pairs of members to look at for each document (and at least), up to which all buckets are done in one round.
PAIRS_A_ROW, LEAST_PAIRS = 1_000, 10_000_000
_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(1, 1 << 63, VERIFY + MOST_BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VERIFY + MOST_BANDS * ROWS, np.uint64)
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


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending."""
    words = WORD.findall(text.encode().lower().decode()) if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _M1 + h[i : n - k + 1 + i])
    return np.unique(out)


def bands_for(percent: int) -> int:
    """Bands that a pair of that similarity all misses with a chance of at most NO_BAND."""
    n = math.ceil(math.log(NO_BAND) / math.log(1 - min(percent / 100, 0.999) ** ROWS))
    if n > MOST_BANDS:
        raise ValueError(f"a similarity of {percent} % would take {n} bands")
    return n


def signature(shingles: np.ndarray, length: int, first: int = 0) -> np.ndarray:
    """Minimum of each of ``length`` hash functions, from number ``first`` on, over a set (uint32)."""
    out = np.full(length, 0xFFFFFFFF, np.uint32)
    a, b = _A[first : first + length, None], _B[first : first + length, None]
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048]
        out = np.minimum(out, ((part * a + b) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def least_matches(percent: int, n: int, miss: float = MISS) -> int:
    """Fewest equal values among n for which the chance of a similarity of ``percent`` or more is ``miss`` or more."""
    t = percent / 100
    for m in range(n + 1):
        # Beta(m+1, n-m+1) beyond t, as a binomial sum.
        tail = math.fsum(math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
        if tail >= miss:
            return m
    return n


def _features(texts: Column, size: int, bands: int) -> Column:
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:bigint,digest:binary,bands:array<bigint>>")
    def made(batch: pa.Array) -> pa.Array:
        import xxhash

        out = []
        for t in batch:
            s = shingle_set(t.as_py(), size)
            if not len(s):
                out.append({"n": 0, "digest": None, "bands": []})
                continue
            sig = signature(s, bands * ROWS, VERIFY)
            key = np.arange(bands, dtype=np.uint64)
            for r in range(ROWS):
                key = _mix(key * _M1 + sig[r::ROWS])
            out.append({"n": len(s), "digest": xxhash.xxh3_128_digest(s.tobytes()), "bands": key.view(np.int64)})
        return pa.array(out, type=kind)

    return made(texts)


def _signatures(sets: Column) -> Column:
    """Minimum hashes for verification, of functions that no band uses."""

    @F.arrow_udf("binary")
    def made(batch: pa.Array) -> pa.Array:
        return pa.array([signature(s.values.to_numpy().view(np.uint64), VERIFY).tobytes() for s in batch], pa.binary())

    return made(sets)


def _sets(texts: Column, size: int) -> Column:
    """The shingles, and how many of them are in each part."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32())]

    @F.arrow_udf("struct<s:array<bigint>,p:array<int>>")
    def made(batch: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch]
        parts = [np.bincount(s & (PARTS - 1), minlength=PARTS).astype(np.int32) for s in sets]
        return pa.StructArray.from_arrays([pa.array(sets, kinds[0]), pa.array(parts, kinds[1])], ["s", "p"])

    return made(texts)


def _promising(a: Column, b: Column, percent: int) -> Column:
    """Do the signatures survive every batch?"""
    least = [(n, least_matches(percent, n)) for n in range(BATCH, VERIFY + 1, BATCH)]

    @F.arrow_udf("boolean")
    def compared(x: pa.Array, y: pa.Array) -> pa.Array:
        n = len(x)
        left = np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(n, VERIFY)
        right = np.frombuffer(b"".join(y.to_pylist()), np.uint32).reshape(n, VERIFY)
        alive, equal = np.arange(n), np.zeros(n, np.int64)
        for upto, fewest in least:  # the next batch is compared for those alive only
            cols = slice(upto - BATCH, upto)
            equal[alive] += (left[alive, cols] == right[alive, cols]).sum(axis=1)
            alive = alive[equal[alive] >= fewest]
        out = np.zeros(n, bool)
        out[alive] = True
        return pa.array(out)

    return compared(a, b)


def _confirmed(a: Column, b: Column, percent: int) -> Column:
    @F.arrow_udf("boolean")
    def exact(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            left, right = p.values.to_numpy(), q.values.to_numpy()
            both = len(np.intersect1d(left, right, assume_unique=True))
            out.append(100 * both >= percent * (len(left) + len(right) - both))
        return pa.array(out)

    return exact(a, b)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b): the smallest id it is joined with.

    Every vertex takes the least of its label, its neighbours' labels and its
    label's label, until nothing changes; a label's label halves the way to
    go each time.  Both joins are plain, so a vertex with many neighbours and
    a label of many vertices are split when skewed.
    """
    there = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = written(there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        own = labels.join(near, "id")
        of_label = labels.select(F.col("id").alias("c"), F.col("c").alias("l"))
        new = written(own.join(of_label, "c").select("id", F.least("c", "m", "l").alias("now"), "c"), "labels")
        labels = new.select("id", F.col("now").alias("c"))
        if new.where(F.col("now") != F.col("c")).isEmpty():
            return labels.withColumnRenamed("c", "component")


def _crowded(members: DataFrame, limit: int) -> DataFrame:
    """The rows of the buckets (``key``) with two members or more."""
    sizes = members.groupBy("key").agg(F.count("id").alias("size")).where(F.col("size") > 1).withColumn("many", F.lit(True))
    return attach(members, written(sizes, "near-crowded"), "key", "size", limit).where(F.col("many")).drop("many")


def _peeled(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, c, v, s, several): of the sets, those of whose n shingles enough (c, v by part) are in another one too;
    several: true for an id with several sets, else null."""
    several = sets.groupBy("id").agg(F.count("id").alias("k")).where(F.col("k") > 1).select("id", F.lit(True).alias("several"))
    sets = written(sets.join(several, "id", "left"), "near-sets")
    part = F.col("h").bitwiseAND(F.lit(PARTS - 1))
    for _ in range(PEELS):
        alone = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("id").alias("k"), F.min("id").alias("id")).where(F.col("k") == 1)
        alone = alone.groupBy("id").agg(F.count("h").alias("u"), *[F.count_if(part == k).alias(f"u{k}") for k in range(PARTS)])
        alone = alone.select("id", "u", F.array(*[f"u{k}" for k in range(PARTS)]).alias("by_part"))
        # An id with several texts has no count for each of them: nothing is taken off.
        u = F.when(F.col("several"), F.lit(0)).otherwise(F.coalesce("u", F.lit(0)))
        v = F.when(F.col("several") | F.col("by_part").isNull(), F.col("p")).otherwise(F.zip_with("p", "by_part", lambda x, y: (x - y).cast("int")))
        shared = sets.join(alone, "id", "left").select("id", "s", "p", "several", (F.size("s") - u).alias("c"), v.alias("v"))
        sets = written(shared.where(100 * F.col("c") >= percent * F.size("s")), "near-shared")
    return sets.select("id", F.size("s").alias("n"), "c", "v", "s", "several")


def _figures(sets: DataFrame) -> DataFrame:
    """(id, n, c, v, r) of each id, r the share of its shingles that no other set has.

    One row stands for all sets of an id, with the least n and the greatest c and v, so that the bounds leave a pair
    if they leave it for any of them.
    """
    sets = sets.select("id", "n", "c", "v", "several")
    v = F.array(*[F.max(F.get("v", F.lit(k))) for k in range(PARTS)])
    many = sets.where(F.col("several")).groupBy("id").agg(F.min("n").alias("n"), F.max("c").alias("c"), v.alias("v"))
    one = sets.where(F.col("several").isNull()).drop("several")
    return one.unionByName(many).withColumn("r", F.greatest((F.col("n") - F.col("c")) / F.col("n"), F.lit(0.0)))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each id: id, n_shingles, component_id (the smallest id it is joined with), kept (its own)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull())
    made = written(texts.select("id", _features(F.col("text"), size, bands_for(percent)).alias("f")).select("id", "f.*"), "near-features")
    rows = made.count()
    limit, limit_pairs = hot_limit(rows), max(LEAST_PAIRS, PAIRS_A_ROW * rows)
    classes = made.where(F.col("n") > 0).groupBy("digest").agg(F.min("id").alias("rep"), F.count("id").alias("rows")).where(F.col("rows") > 1)
    classes = written(classes, "near-classes")
    # A class is a member of each of its buckets once, whatever its copies.
    one = attach(made.where(F.col("n") > 0).select("id", "digest", "bands"), classes, "digest", "rows", limit)
    one = written(one.where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).dropDuplicates(["id", "digest"]).select("id", "bands"), "near-one")
    buckets = written(_crowded(one.select(F.explode("bands").alias("key"), "id"), limit), "near-buckets")
    # Only these classes can be linked.  (A text of a class' id may be another one, if ids repeat: the set decides.)
    near = buckets.select("id").distinct()
    sets = texts.join(near, "id", "left_semi").select("id", _sets(F.col("text"), size).alias("x")).select("id", "x.s", "x.p")
    sets = _peeled(written(sets.where(F.size("s") > 0), "near-sets"), percent)
    buckets = written(_crowded(buckets.join(_figures(sets), "id"), limit), "near-buckets")
    signatures = written(sets.select("id", _signatures(F.col("s")).alias("signature")), "near-signatures")
    known = links = None
    leaders = LEADERS
    while True:
        state = _state(buckets, known, limit)
        if state.isEmpty():
            break
        # Not in the first round: most pairs within a cluster go once its members are one component.
        every = leaders > LEADERS and state.agg(F.sum("size")).first()[0] <= limit_pairs  # the sum of the squares of the buckets' sizes
        first = _leaders(state, None if every else leaders)
        found = _links(_pairs(state, first, percent), signatures, sets, percent)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            known = components(links)
        if every:
            break
        last = written(first.groupBy("key").agg(F.max("at").alias("last"), F.max("size").alias("size")), "near-last")
        rest = attach(state, last, "key", "size", limit).where(F.struct("r", "id") > F.struct("last.r", "last.id"))
        buckets = rest.select("key", "id", "n", "c", "v", "r")
        leaders = min(leaders * GROWTH, MOST_LEADERS)
    joined = attach(made.select("id", "n", "digest"), classes, "digest", "rows", limit)
    joined = joined.select("id", "n", F.coalesce("rep", "id").alias("rep"))
    if known is not None:
        joined = joined.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left")
    else:
        joined = joined.withColumn("component", F.lit(None).cast("bigint"))
    out = joined.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _state(buckets: DataFrame, known: DataFrame | None, limit: int) -> DataFrame:
    """Members (key, id, n, c, v, r) of the buckets whose members are in several components, with their component and the bucket's size."""
    if known is None:
        state = buckets.withColumn("component", F.col("id"))
    else:
        state = buckets.join(known.select("id", F.col("component").alias("k")), "id", "left").withColumn("component", F.coalesce("k", "id")).drop("k")
    state = written(state, "near-state")
    mixed = state.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("id").alias("size")).where(F.col("lo") < F.col("hi"))
    mixed = written(mixed.select("key", "size", F.col("size").alias("members")), "near-mixed")
    state = attach(state, mixed, "key", "size", limit).where(F.col("members").isNotNull())
    # Members of a bucket over the limit are spread over SALTS numbers; the others keep 0.
    salts = F.when(F.col("members") > limit, F.lit(SALTS)).otherwise(F.lit(1))
    return written(state.select("key", "id", "n", "c", "v", "r", "component", F.col("members").alias("size"), salts.alias("salts")), "near-state")


def _leaders(state: DataFrame, leaders: int | None) -> DataFrame:
    """The first members of every bucket (None: all); the greatest share of shared shingles first, then the smallest id."""
    if leaders is None:
        return state.withColumn("at", F.struct("r", "id"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("r", "id"))
    first = state.withColumn("place", place).where(F.col("place") <= leaders)
    return written(first.select("key", "id", "n", "c", "v", "component", "size", "salts", F.struct("r", "id").alias("at")), "near-leaders")


def _pairs(state: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a leader and a later member of its bucket, of other components, that the bounds leave."""
    mine = first.select(
        "key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("v").alias("va"), F.col("component").alias("of_a"), "at",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    theirs = state.select("key", salt.alias("salt"), F.col("id").alias("b"), "n", "c", "v", "component", F.struct("r", "id").alias("after"))
    enough = lambda overlap: 100 * overlap >= percent * (F.col("n") + F.col("na") - overlap)
    by_part = F.aggregate(F.zip_with("v", "va", lambda x, y: F.least(x, y)), F.lit(0), lambda sum, x: sum + x)
    possible = F.when(enough(F.least("c", "ca")), enough(by_part)).otherwise(False)  # the cheaper one first
    pairs = mine.join(theirs, ["key", "salt"]).where((F.col("at") < F.col("after")) & (F.col("component") != F.col("of_a")) & possible)
    return written(pairs.select("a", "b").distinct(), "near-pairs")


def _links(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed links (a, b) among the pairs."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("x"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    alive = written(pairs.join(left, "a").join(right, "b").where(_promising(F.col("x"), F.col("y"), percent)).select("a", "b").distinct(), "near-alive")
    x, y = (sets.select(F.col("id").alias(k), F.col("s").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return written(alive.join(x, "a").join(y, "b").where(_confirmed(F.col("x"), F.col("y"), percent)).select("a", "b").distinct(), "near-links")
