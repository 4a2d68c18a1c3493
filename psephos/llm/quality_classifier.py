"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Tokens are runs of letters and digits, and runs of other characters that are
not blank.  Features are hashed single tokens and pairs of neighbours (all
pairs of equal tokens are one feature), valued by the log of their count and
scaled to unit norm, so long and short texts weigh alike.  Training reads a bounded sample of the labelled
texts (``max_examples``, in the order of a hash of the id) in one task and
updates each weight by the follow-the-regularised-leader rule; scoring is a
sparse dot product for every text.

Null and empty texts score as the bias alone.  Rows without a label, and
label rows of an id beyond its smallest label, are not learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import labelled_sample, ship

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BITS = 18
MAX_EXAMPLES = 6_000
#: Tokens kept in a worker's cache of hashes before it is emptied.
CACHE = 100_000
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 0.02, 0.0, 4


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = self[token] = xxhash.xxh32_intdigest(token)
        return h


_HASHES = _Hashes()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text, ascending, and their values (norm 1); feature 0 is the bias."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1)
    one = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    two[one[:-1] == one[1:]] = 1  # a token repeated at once, whichever it is
    every = np.concatenate([np.zeros(1, np.int64), (one & np.uint64((1 << bits) - 1)).astype(np.int64), two.astype(np.int64)])
    found, counts = np.unique(every, return_counts=True)
    x = np.log1p(counts)
    return found, x / np.sqrt(x @ x)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> np.ndarray:
    """FTRL-proximal over (features, values, label) in order, ``epochs`` times."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(n[f])) / alpha + l2))

    for _ in range(epochs):
        for f, x, y in examples:
            w = weights(f)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    return weights(np.arange(1 << bits))


def fit(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", max_examples: int = MAX_EXAMPLES, bits: int = BITS, **rates) -> np.ndarray:
    """Weights learnt from at most ``max_examples`` rows of ``labels`` (id, label).

    Features are made in parallel; the sample's features (not its texts) meet
    in one task, which trains and returns the 2**bits weights.
    """

    ship(docs.sparkSession)

    @F.arrow_udf("struct<f:array<int>,x:array<double>>")
    def made(texts: pa.Array) -> pa.Array:
        both = [features(t.as_py(), bits) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f for f, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.float64()))], ["f", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            f, x = b["fx"].field("f"), b["fx"].field("x")
            rows += [(np.asarray(f[i].values), np.asarray(x[i].values), y) for i, y in enumerate(b["y"].to_pylist())]
        w = train(rows, bits, **rates)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["at", "w"])

    sample = labelled_sample(docs, labels, label, max_examples, id, text).select(id, made("text").alias("fx"), "y")
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.col(id).cast("string")), id).select("fx", "y")
    got = one.mapInArrow(learn, "at long, w double").toArrow()  # at most 2**bits rows
    out = np.zeros(1 << bits)
    out[got["at"].to_numpy()] = got["w"].to_numpy()
    return out


def score_texts(texts: Column, weights, bits: int = BITS) -> Column:
    """Probability of label 1; ``weights`` is a broadcast of the array that ``fit`` returns."""

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        w, out = weights.value, np.zeros(len(batch))
        for i, t in enumerate(batch):
            f, x = features(t.as_py(), bits)
            out[i] = w[f] @ x
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score(texts)
