"""Near-duplicates of large groups: equal to brute force, and without a pair for every two members."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from psephos.llm import near_dedup
from tests.llm.test_operators import plain_components

SCHEMA = "doc_id bigint, text string"


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**7)}"
    return words


def cluster(rng, n, most):
    """Copies of one text with up to ``most`` changed words each."""
    base = [f"b{rng.randrange(300)}" for _ in range(150)]
    return [" ".join(edited(rng, base, rng.randint(0, most))) for _ in range(n)]


def template(rng, n):
    """Texts of which two thirds are one template, the rest each one's own."""
    shared = [f"t{i}" for i in range(80)]
    return [" ".join(shared + [f"own{k}x{i}" for i in range(40)]) for k in range(n)]


def mixed(rng, n):
    """Texts put together from few passages: every shingle is shared, hardly a pair is alike."""
    passages = [[f"p{k}w{i}" for i in range(25)] for k in range(14)]
    return [" ".join(sum(rng.sample(passages, 5), [])) for _ in range(n)]


def run(spark, texts, monkeypatch, **more):
    """Result by id, and the number of pairs that were made in all rounds."""
    made = []
    plain = near_dedup._pairs

    def counted(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_pairs", counted)
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    rows = near_dedup.near_duplicates(docs, **more).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}, sum(made)


@pytest.mark.parametrize("size,percent,at_once", [(3, 85, True), (5, 80, False)])
def test_large_cluster_and_template(spark, monkeypatch, size, percent, at_once):
    """300 copies of one text, many of them too far off, 300 texts of a template, and mixed ones, with hot buckets from 20 members on."""
    monkeypatch.setattr(near_dedup, "hot_limit", lambda rows: 20)
    if not at_once:  # rounds of leaders to the end
        monkeypatch.setattr(near_dedup, "PAIRS_A_ROW", 0)
        monkeypatch.setattr(near_dedup, "LEAST_PAIRS", 0)
    rng = random.Random(9)
    texts = dict(enumerate([*cluster(rng, 300, 12), *template(rng, 300), *mixed(rng, 60)]))
    got, pairs = run(spark, texts, monkeypatch, size=size, percent=percent)
    assert got == plain_components(texts, size, percent)
    assert pairs < 300 * 40  # all pairs of a group: 44,850


def test_template_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(2)
    got, pairs = run(spark, dict(enumerate(template(rng, 400))), monkeypatch)
    assert pairs == 0 and all(c == i for i, (_, c) in got.items())


def test_pairs_grow_with_the_cluster(spark, monkeypatch):
    """Four times the copies: not sixteen times the pairs."""
    made = []
    for n in (100, 400):
        with monkeypatch.context() as m:
            made.append(run(spark, dict(enumerate(cluster(random.Random(n), n, 10))), m, size=3, percent=85)[1])
    assert made[1] <= 8 * max(made[0], 100)


def test_many_leaders(spark, monkeypatch):
    """With few leaders a round, later rounds still compare every pair that the bounds leave."""
    monkeypatch.setattr(near_dedup, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(near_dedup, "LEAST_PAIRS", 0)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    monkeypatch.setattr(near_dedup, "GROWTH", 2)
    monkeypatch.setattr(near_dedup, "MOST_LEADERS", 3)
    texts = dict(enumerate(mixed(random.Random(5), 40)))
    got, _ = run(spark, texts, monkeypatch, size=3, percent=85)
    assert got == plain_components(texts, 3, 85)


def test_ids_of_several_texts(spark):
    """A document is linked if any of its texts is; the bounds of one text take nothing from another."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    near = " ".join(edited(rng, base, 2))
    rows = [(1, " ".join(base)), (2, " ".join(f"v{i}" for i in range(100))), (2, near), (3, " ".join(f"v{i}" for i in range(100))), (4, "alone " * 9)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("x"))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
