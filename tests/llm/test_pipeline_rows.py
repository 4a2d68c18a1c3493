"""Rows of the pipeline's near-duplicate stage; how the URL filter's join and the toxicity stage treat theirs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from psephos.llm import queries, toxicity, url_filter
from psephos.llm.common import table
from tests.conftest import ORACLE_SF, SMOKE
from tests.test_skew import SORT_MERGE, assert_spread, rows_by_task, settings

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"


def test_repeated_and_missing_ids(spark):
    """One document of each group stays, whatever its id; texts without words and unlike texts under one id all stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, a.upper()), (3, b), (None, b), (None, c), (None, c), (4, None), (None, ""), (5, "x"), (5, "y"), (None, a + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA).withColumn("row", F.lit("r")).withColumn("spans", F.lit(1))
    out = pipeline.drop_near_duplicates(spark, docs, SMOKE)
    assert out.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert kept[(2, a.upper())] == 1 and (1, a) not in kept  # of the group of a, the row whose id is its own
    assert kept[(3, b)] == 1 and (None, b) not in kept
    assert kept[(None, c)] == 1 and (None, a + " more") not in kept
    assert kept[(4, None)] == kept[(None, "")] == kept[(5, "x")] == kept[(5, "y")] == 1
    assert sum(kept.values()) == 7
    masked = pipeline.mask_secrets(spark, docs, SMOKE)
    assert masked.columns == docs.columns and {(r["row"], r["spans"]) for r in masked.collect()} == {("r", 1)}


def test_rejected_documents_go(spark):
    docs, labels = table(spark, ORACLE_SF, "documents"), table(spark, ORACLE_SF, "labels")
    index = queries.toxicity_index(docs, labels)
    rows = docs.collect()
    want = {r["doc_id"] for r, (s, _) in zip(rows, index.scores([r["text"] for r in rows])) if s < queries.TOXIC_FROM}
    got = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, ORACLE_SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_pages_that_miss_the_filter_are_spread(spark, tmp_out):
    pages = spark.range(0, 4000, 1, 8).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/p"), F.col("id")).alias("url"))
    pages = pages.unionByName(spark.range(0, 2000, 1, 1).select((F.col("id") + 10_000).alias("page_id"), F.lit("no url").alias("url")))
    listed = pages.where("page_id = 7").select(url_filter.canonical(F.col("url")).alias("canonical"))
    with settings(spark, SORT_MERGE):
        judged = url_filter.judge(pages, listed)
        parts = rows_by_task(spark, judged, f"{tmp_out}/judged", F.col("may_be_listed"))
        got = spark.read.parquet(f"{tmp_out}/judged")
        assert got.where("verdict = 'block'").select("page_id").collect() == [(7,)] and got.count() == 6000
    assert sum(parts[False]) > 5900
    assert_spread(parts[False])


def test_the_sample_is_bounded_in_characters(spark):
    sample = spark.createDataFrame([(i, "t" * 10, i % 2) for i in range(100)], "id bigint, text string, y int")
    assert toxicity.bounded(sample, 1_000).count() == 100
    few = {r["id"] for r in toxicity.bounded(sample, 305).collect()}
    assert len(few) == 30 and {r["id"] for r in toxicity.bounded(sample, 305).collect()} == few


def test_token_counts_of_odd_rows(spark):
    """Null, empty, long and repeated texts, an empty table, columns of any name: one count a row."""
    import sentencepiece

    from psephos.llm import piece_encoding, token_counts
    from psephos.llm.common import ship
    from tests.llm.test_operators import ODD

    ship(spark)
    model = piece_encoding.load_model(queries.model_path())
    vocabulary, byte_fallback = token_counts.rank_vocabulary(model)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *ODD])], "doc_id bigint, text string").withColumn("n_tokens", F.lit("x")).withColumn("vocabulary", F.lit(1))
    rows = docs.select("doc_id", "vocabulary", "n_tokens", token_counts.count_tokens(F.col("text"), vocabulary, byte_fallback).alias("n")).orderBy("doc_id").collect()
    n = [r["n"] for r in rows]
    assert n[: len(ODD)] == n[len(ODD) :] and n[0] == n[1] == 0 and all(x > 0 for x in n[3 : len(ODD)])
    assert docs.where("doc_id < 0").select(token_counts.count_tokens(F.col("text"), vocabulary, byte_fallback).alias("n")).count() == 0
    assert sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size() >= len(vocabulary) > 0
