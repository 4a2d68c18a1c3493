"""The registered queries of this folder's operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import (
    conversation_repair,
    decontamination,
    host_quality,
    license_scan,
    near_dedup,
    personal_data,
    piece_encoding,
    prefix_trie,
    quality_classifier,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
)
from psephos.llm.license_rules import rules
from psephos.llm.common import count_kind, crc32_mod, ship, spans_sha256, spans_text, table, written

TOXIC_FROM, GOOD_FROM = 0.7, 0.3
TOXIC_FOLDS, QUALITY_FOLDS = 3, 5
#: Hosts whose pages, and a campaign parameter whose carriers, make up the URL list.
LISTED_HOSTS = r"^(www\.|m\.|blog\.)?(casino-win|free-bets|cheap-pills|ads-track)\."
LISTED_PARAMETER = "utm_source="


def model_path() -> str:
    """The vocabulary file, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return docs.select(
        "doc_id",
        *[count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        spans_sha256(base).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *host_quality.FIGURES, "base_failed", "kept", "host_verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    return decontamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("personal_spans")
    return found.select(
        "doc_id",
        *[count_kind(spans, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        spans_sha256(personal_data.spans_by_kind(spans)).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list: canonical URLs of pages on listed hosts, or seen with a campaign parameter."""
    host, _ = url_filter.host_path(F.col("url"))
    on_list = host.rlike(LISTED_HOSTS) | F.col("url").contains(LISTED_PARAMETER)
    return pages.where(on_list).select(url_filter.canonical(F.col("url")).alias("canonical"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def toxicity_index(docs: DataFrame, labels: DataFrame) -> toxicity.Index:
    return toxicity.fit(docs, labels.where(crc32_mod(F.col("doc_id"), TOXIC_FOLDS) != 1).select("doc_id", "toxic"), "toxic", max_terms=None)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = spark.sparkContext.broadcast(toxicity_index(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", toxicity.score_texts(F.col("text"), index, evidence=True).alias("s"))
    return scored.select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), TOXIC_FOLDS) == 1).alias("held_out"),
        F.col("s.score").alias("score"),
        (F.col("s.score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.transform("s.nearest", lambda n: n["id"]).alias("evidence"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary, byte_fallback = token_counts.rank_vocabulary(piece_encoding.load_model(model_path()))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_counts.count_tokens(F.col("text"), vocabulary, byte_fallback).alias("n_tokens"))


def encoded_digest(docs: DataFrame) -> DataFrame:
    coded = piece_encoding.encode_digest(docs.select("doc_id", "text"), piece_encoding.load_model(model_path()))
    return coded.select("doc_id", "encoded.*")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digest(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod(F.col("doc_id"), QUALITY_FOLDS) != 0).select("doc_id", "quality")
    weights = spark.sparkContext.broadcast(quality_classifier.fit(docs, labels, "quality"))
    scored = docs.select("doc_id", quality_classifier.score_texts(F.col("text"), weights).alias("score"))
    held_out = crc32_mod(F.col("doc_id"), QUALITY_FOLDS) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = license_scan.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found, base = F.col("licenses"), F.col("base")
    docs = docs.select("doc_id", "n_words", "licenses", license_scan.base(found).alias("base"))
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return docs.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.labels(base).alias("base_labels"),
        license_scan.labels(found).alias("labels"),
        license_scan.confidence(found).alias("score"),
    )


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): conversations begun with the first turns of the conversation at the next lower multiple of 5."""
    own = written(prefix_trie.sequences(turns), "conversations")
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9)).cast("int")
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("lead"))
    both = own.withColumn("base", c - c % 5).join(first, "base", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(0)))
    return both.select("conv_id", F.concat(lead, rest).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


def damaged_conversations(turns: DataFrame) -> DataFrame:
    """Rows dropped (column ``dropped``), emptied, without sentence ends, repeated, or turned to the user's."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    text = or_space("text")
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(or_space("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damaged_conversations(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(damaged, gone=F.col("dropped"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_quality_rules,
        op3_decontamination,
        op4_personal_data,
        op5_url_filter,
        op6_toxicity,
        op7_token_counts,
        op8_sentencepiece,
        op9_minhash_dedup,
        op10_quality_classifier,
        op11_license_scan,
        op12_prefix_trie,
        op13_structure_repair,
    )
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"({r.number}, '{r.label}', {r.level}, [{', '.join(map(_quoted, r.words))}], {_quoted(r.pattern)})" for r in rules())
_SPAM = "'^((www|m|blog)[.])?(casino-win|free-bets|cheap-pills|ads-track)[.]'"
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT doc_id, source, text,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (SELECT *, len(w) AS n, row_number() OVER () AS r FROM f),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, n - 1)) AS i FROM g WHERE n >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS k FROM win) WHERE k > 1),
covered AS (SELECT r, count(*) AS n_repeat FROM (SELECT DISTINCT r, i + d AS p FROM twice, (SELECT unnest([0, 1, 2]) AS d)) GROUP BY r),
figures AS (
  SELECT doc_id, source, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM g LEFT JOIN covered USING (r)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS soft_failed
  FROM figures),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS k FROM failed WHERE source IS NOT NULL GROUP BY source),
mv AS (SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v FROM hosts),
prior AS (SELECT m, greatest(1.0, least(1000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS s FROM mv),
post AS (SELECT source, m, m * s + k AS a, (1 - m) * s + n - k AS b FROM hosts, prior),
low AS (SELECT source, m, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM post),
verdicts AS (SELECT source, CASE WHEN low > 0.5 THEN 'reject' WHEN low > least(2.0 * m, 0.5) THEN 'suspect' ELSE 'accept' END AS host_verdict FROM low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_verdict, 'accept') <> 'reject' AND NOT (coalesce(host_verdict, 'accept') = 'suspect' AND soft_failed) AS kept,
  coalesce(host_verdict, 'accept') AS host_verdict
FROM failed LEFT JOIN verdicts USING (source)""",
    "op5_url_filter": rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^#?]*[?]([^#]*)', 1) AS query FROM u),
c AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept FROM p),
k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM c),
listed AS (SELECT DISTINCT canonical FROM k WHERE canonical IS NOT NULL AND (regexp_matches(host, {_SPAM}) OR contains(url, 'utm_source='))),
r AS (
  SELECT page_id, host, path, canonical,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM k)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op11_license_scan": rf"""
WITH rules(number, label, level, need, pattern) AS (VALUES {_RULES}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS (SELECT r, doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
hit AS (SELECT r, number, label, level, regexp_replace(t, pattern, chr(1), 'g') AS cut, regexp_extract_all(t, pattern) AS found
  FROM j, rules WHERE list_has_all(w, need) AND regexp_matches(t, pattern)),
place AS (
  SELECT r, number, label, level, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
    'at': CAST(list_sum(list_transform(string_split(cut, chr(1))[1:i], lambda x: length(x) - length(replace(x, ' ', '')))) / 2
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x) - length(replace(x, ' ', '')))) / 2, 0) AS BIGINT),
    'n': CAST((length(found[i]) - length(replace(found[i], ' ', ''))) / 2 AS BIGINT)}})) AS m FROM hit),
span AS (SELECT r, number, label, level, m['at'] AS s, m['at'] + m['n'] AS e FROM place),
kept AS (
  SELECT * FROM span x WHERE NOT EXISTS (
    SELECT 1 FROM span y WHERE y.r = x.r AND y.s <= x.s AND y.e >= x.e AND y.level >= x.level
      AND (y.s < x.s OR y.e > x.e OR y.level > x.level OR y.number < x.number))),
per AS (
  SELECT r, count(*) FILTER (WHERE level = 4) AS n_base, min(s) FILTER (WHERE level = 4) AS first_word, max(s) FILTER (WHERE level = 4) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE level = 4)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(level) AS level FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE level WHEN 4 THEN 1.0 WHEN 3 THEN 0.95 WHEN 2 THEN 0.8 WHEN 1 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM j LEFT JOIN per USING (r)""",
}
