"""Quality rules judged by host, with DataFrame functions only.

Every text gets the figures of four rules: few words, repeated words (in
three-word windows found more than once), symbols, repeated lines.  A host's
failures are counted, its failure rate is shrunk by a beta prior fitted to the
rates of all hosts (method of moments), and the host's verdict joins its
documents again:

* ``reject``: the rate's lower bound (mean less 1.645 standard deviations of
  the beta posterior) is over ``REJECT_RATE``; none of its documents is kept;
* ``suspect``: that bound is over the prior's mean times ``SUSPECT_TIMES``; its
  documents are kept if they pass every rule;
* ``accept``: its documents are kept if they pass the base rules.

A null text has no words and fails.  Documents without a host are judged like
those of an accepted one.  Repeated rows count each.  Windows are compared by
64-bit hashes (two different windows of a text of 20,000 words share one with
a chance of 1 in 10**11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import WORD_SQL, attach, hot_limit, written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 50, 50, 10, 30  # the last three in percent
REJECT_RATE, SUSPECT_TIMES, Z = 0.5, 2.0, 1.645
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(sorted_windows: Column) -> Column:
    """Words within windows that occur twice or more; of (hash, place) structs in order."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter(
        sorted_windows,
        lambda w, i: same(w, F.get(sorted_windows, i + 1)) | same(w, F.get(sorted_windows, i - 1)),
    )
    places = F.sort_array(F.transform(twice, lambda w: w["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the figures of the rules and ``n_lines`` (columns of these names are replaced)."""
    kept = [c for c in docs.columns if c != text and c not in (*FIGURES, "n_lines")]
    own = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(
        own,
        t.alias("t"),
        F.filter(F.split(t, BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_SQL)).alias("lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    words = F.col("words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "own",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        windows.alias("windows"),
    )
    # Most texts repeat no window: only the others are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    places = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("sorted", F.when(repeats, F.sort_array(places)))
    count = F.when(F.col("sorted").isNotNull(), _repeat_words(F.col("sorted"))).otherwise(0)
    return df.select(*[F.col(f"own.`{c}`") for c in kept], "n_words", "word_chars", "n_symbols", "n_dup_lines", count.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def soft_failed() -> Column:
    return (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))


def host_verdicts(figures: DataFrame, host: str) -> DataFrame:
    """For each host: n_docs, n_failed, rate (shrunk), rate_low and host_verdict."""
    by_host = figures.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("n_failed")
    )
    prior = by_host.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v")
    )
    # Strength of the prior by the method of moments, between 1 and 1,000 documents.
    spread = F.col("m") * (1 - F.col("m"))
    prior = prior.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.when(F.col("v") > 0, spread / F.col("v") - 1).otherwise(1000.0))).alias("k"))
    two = prior.first()  # two numbers, of all hosts
    m, k = (0.5, 1.0) if two["m"] is None else (two["m"], two["k"])
    a = F.lit(m * k) + F.col("n_failed")
    b = F.lit((1 - m) * k) + F.col("n_docs") - F.col("n_failed")
    rate = a / (a + b)
    low = rate - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    verdict = F.when(low > REJECT_RATE, "reject").when(low > F.lit(min(SUSPECT_TIMES * m, REJECT_RATE)), "suspect").otherwise("accept")
    return by_host.select(host, "n_docs", "n_failed", rate.alias("rate"), low.alias("rate_low"), verdict.alias("host_verdict"))


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without its text, with the figures, base_failed, soft_failed, host_verdict and kept."""
    added = ("base_failed", "soft_failed", "host_verdict", "kept")
    figures = with_figures(docs.drop(*[c for c in docs.columns if c in added]), text)
    figures = written(figures.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()), "host-quality")
    verdicts = written(host_verdicts(figures, host).select(host, "n_docs", "host_verdict"), "host-verdicts")
    judged = attach(figures, verdicts, host, "n_docs", hot_limit(figures.count()))
    at = F.coalesce("host_verdict", F.lit("accept"))
    kept = ~F.col("base_failed") & (at != "reject") & ~((at == "suspect") & F.col("soft_failed"))
    return judged.withColumn("host_verdict", at).withColumn("kept", kept)
