"""Counts and verdicts of disclosing terms against a plain count; copies change nothing; sanitised texts."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from psephos.llm import personal_data
from tests.llm.test_operators import plain_components

SCHEMA = "doc_id bigint, text string"


def corpus(seed, n=260):
    """Texts of rare and common words, some with addresses, copies and near copies of some."""
    rng = random.Random(seed)
    people = [f"p{i}@x.org" for i in range(6)]
    secret = {p: [f"alias{i}q{j}" for j in range(3)] for i, p in enumerate(people)}
    texts = []
    for _ in range(n):
        words = [f"w{min(rng.randrange(60), rng.randrange(60))}ab" for _ in range(rng.randint(12, 40))]
        if rng.random() < 0.3:
            p = rng.choice(people)
            words += [p, rng.choice(secret[p]), rng.choice(secret[p])] + ([rng.choice(sum(secret.values(), []))] if rng.random() < 0.2 else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
    for t in rng.sample(texts, 25):
        texts.append(t)
        texts.append(t + " tail")
    return [*texts, "", None]


def plain(texts):
    """(e, t): n_e, n_et, n_t, action, of all pairs that disclose."""
    n = len({t for t in texts if t})
    mentions = {i: t for i, t in enumerate(texts) if personal_data.base_spans(t)}
    group = {i: c for i, (_, c) in plain_components(mentions, 5, 80).items()}
    by_e, by_et, n_t, tested = {}, {}, {}, {}
    for t in {t for t in texts if t}:
        for w in {x.lower() for x in personal_data.TERM.findall(t)}:
            h = personal_data._hash(w)
            n_t[h] = n_t.get(h, 0) + 1
    for i, t in mentions.items():
        found = personal_data.base_spans(t)
        for e in {personal_data._hash(personal_data.entity(k, t[a:b])) for k, a, b in found}:
            by_e.setdefault(e, set()).add(group[i])
            ts = personal_data.term_places(t, found)
            tested[e, group[i]] = max(tested.get((e, group[i]), 0), len(ts))
            for h in ts:
                by_et.setdefault((e, h), set()).add(group[i])
    out = {}
    for (e, t), groups in by_et.items():
        n_e, n_et = len(by_e[e]), len(groups)
        if n_et < personal_data.SUPPORT or n_e >= n:
            continue
        share = math.log2(n_et * n / (n_e * n_t[t])) / math.log2(n / n_e)
        p = n_et / n_e
        h = -(p * math.log(p) + (1 - p) * math.log(1 - p)) if p < 1 else 0.0
        m = sum(v for (x, _), v in tested.items() if x == e)
        if share >= personal_data.GENERALISE and n_e * h + n_et * math.log(n_t[t] / n) + math.log(m) <= math.log(personal_data.CHANCE):
            out[e, t] = (n_e, n_et, n_t[t], "remove" if share >= personal_data.REMOVE else "generalise")
    return out


def test_counts_and_verdicts_equal_a_plain_count(spark):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {(r["e"], r["t"]): (r["n_e"], r["n_et"], r["n_t"], r["action"]) for r in personal_data.disclosures(docs).collect()}
    want = plain(texts)
    assert got == want and len(want) >= 5 and {v[3] for v in want.values()} <= {"remove", "generalise"}


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["action"]) for s in r["personal_spans"]] for r in personal_data.find_personal_data(docs).collect()}


def test_copies_are_no_evidence(spark):
    texts = [t for t in dict.fromkeys(corpus(5, 200)) if not (t or "").endswith(" tail")]
    before = spans(spark, texts)
    mentioned = [i for i, t in enumerate(texts) if personal_data.base_spans(t)]
    copied = [*texts, *(texts[i] for i in mentioned for _ in range(3))]
    after = spans(spark, copied)
    assert {i: after[i] for i in before} == before and any(s[0] == "term" for x in before.values() for s in x)
    one = "reach jo@x.org or the qzorb of vlimpt " + " ".join(f"odd{i}" for i in range(40))
    pair = spans(spark, [*texts, one, one + " again", one])
    assert [s[0] for s in pair[len(texts)]] == ["email"]


def test_sanitised_column_equals_the_plain_one(spark):
    texts = corpus(7, 120) + ["Alias mail jo@x.org 4111 1111 1111 1111 +1 (555) 123-4567 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("spans", F.lit(1)).withColumn("own", F.lit("o"))
    rows = personal_data.find_personal_data(docs, keep_text=True).select("text", "personal_spans", personal_data.sanitised(F.col("text"), F.col("personal_spans")).alias("out")).collect()
    assert all(r["out"] == (personal_data.sanitise(r["text"], [s.asDict() for s in r["personal_spans"]]) if r["text"] is not None else None) for r in rows)
    out = personal_data.sanitise_documents(docs)
    assert out.columns == docs.columns and "x.org" not in "".join(r["text"] or "" for r in out.collect())
    assert out.where("spans = 1 and own = 'o'").count() == len(texts)
