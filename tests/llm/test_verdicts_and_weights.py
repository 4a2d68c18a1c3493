"""Host verdicts that all occur, held against SQL on whole tables; classifier weights against a plain learner."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from psephos.llm import host_quality, quality_classifier, queries
from psephos.llm.common import table
from tests.conftest import ORACLE_SF
from tests.llm.test_operators import ODD, SCHEMA, rows_of


def test_every_verdict_against_sql(spark):
    """Hosts made of the text's length: short ones fail, long ones pass, some do either, and some texts are with hosts of others; all rows of the table."""
    docs = table(spark, ORACLE_SF, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    host = F.when(F.col("doc_id") % 101 == 0, "h0").otherwise(F.concat(F.lit("h"), F.least(F.floor(size / 60), F.lit(40)).cast("string")))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 17 != 0, host))
    judged = host_quality.judge(docs.select("doc_id", "source", "text"))
    got = judged.select("doc_id", *host_quality.FIGURES, "base_failed", "kept", "host_verdict").collect()
    con = duckdb.connect()
    con.execute(
        f"CREATE VIEW documents AS SELECT doc_id, text, CASE WHEN doc_id % 17 <> 0 THEN CASE WHEN doc_id % 101 = 0 THEN 'h0' ELSE "
        f"'h' || CAST(least(length(coalesce(text, '')) // 60, 40) AS VARCHAR) END END AS source FROM '{ORACLE_SF}/documents.parquet'"
    )
    want = con.execute(queries.ORACLE_SQL["op2_quality_rules"])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want.fetchall())
    verdicts = Counter(r["host_verdict"] for r in got)
    assert set(verdicts) == {"accept", "suspect", "reject"}, verdicts
    assert any(not r["kept"] and not r["base_failed"] for r in got)  # a verdict decides, not a rule
    assert any(r["kept"] and r["host_verdict"] == "suspect" for r in got)


def plain_ftrl(examples, alpha, beta, l1, l2, epochs):
    """One coordinate at a time, with dicts."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for f, x, y in examples:
            w = {i: weight(i) for i in f}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in zip(f, x))))))
            for i, v in zip(f, x):
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_weights_equal_a_plain_learner(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: 30 + 30 * (i % 2)]) for _ in range(rng.randint(0, 40))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    got = quality_classifier.fit(docs, labels, "quality", bits=12)
    order = [r["doc_id"] for r in docs.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect()]
    examples = [(*(a.tolist() for a in quality_classifier.features(texts[i], 12)), i % 2) for i in order]
    q = quality_classifier
    want = plain_ftrl(examples, q.ALPHA, q.BETA, q.L1, q.L2, q.EPOCHS)
    assert {i: float(got[i]) for i in got.nonzero()[0].tolist()} == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-9)
    sent = spark.sparkContext.broadcast(got)
    scored = rows_of(docs.select("doc_id", quality_classifier.score_texts(F.col("text"), sent, 12).alias("s")))
    for i, t in enumerate(texts):
        f, x = q.features(t, 12)
        assert scored[i]["s"] == pytest.approx(1 / (1 + math.exp(-sum(want.get(a, 0.0) * b for a, b in zip(f.tolist(), x.tolist())))), rel=1e-9)


def test_features_equal_plain_counts():
    """Counts of hashed tokens and of pairs of neighbours, each through its own number."""
    import xxhash

    for text in [*ODD, "a a b a a b c", "x y"]:
        tokens = quality_classifier.TOKEN.findall(text or "")
        h = [xxhash.xxh32_intdigest(t) for t in tokens]
        want = Counter([0]) if tokens else Counter([0])
        for a in h:
            want[a & 0xFFF] += 1
        for a, b in zip(h, h[1:]):
            want[1 if a == b else ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1) >> 52] += 1
        f, x = quality_classifier.features(text, 12)
        assert f.tolist() == sorted(want)
        raw = [math.log1p(want[i]) for i in sorted(want)]
        assert x.tolist() == pytest.approx([v / math.sqrt(sum(r * r for r in raw)) for v in raw])


def test_repeated_ids_and_labels(spark):
    """Repeated documents and label rows are one example, with the smallest label and text."""
    docs = spark.createDataFrame([(1, "b c"), (1, "a d"), (2, "e f"), (2, "e f")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (3, 1)], "doc_id bigint, quality int")
    once = spark.createDataFrame([(1, "a d"), (2, "e f")], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")
    assert (quality_classifier.fit(docs, labels, "quality", bits=8) == quality_classifier.fit(once, one, "quality", bits=8)).all()
