"""Contest search and contest detail (O-18, O-19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.columns import rank_order
from psephos.functions.text import contains_pattern
from psephos.schema import CONTEST_KEY


# Trigrams looked up for one pattern, and names of the rarest one beyond which the index is scanned.
MOST_GRAMS = 3
MOST_NAMES = 1_000_000


def clean_query(q: str) -> str:
    """The reference's sanitising of the search text: drop single quotes, strip whitespace."""
    return q.replace("'", "").strip()


def contest_grams(index: DataFrame, keys: Sequence[str] = CONTEST_KEY) -> DataFrame:
    """(gram, contest, name): the distinct trigrams of every contest name, lower-cased as ``ilike`` does."""
    name = F.lower("ac_name")
    places = F.sequence(F.lit(1), F.length(name) - 2)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(3))))
    named = index.where(F.length(name) >= 3)
    return named.select(*keys, "ac_name", F.explode(grams).alias("gram")).select("gram", *keys, "ac_name")


def gram_counts(grams: DataFrame) -> DataFrame:
    """(gram, names): in how many contest names a trigram stands."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that every text matching a LIKE pattern holds: those of its literal runs (``\\`` escapes)."""
    runs, run, escaped = [], "", False
    for c in pattern:
        if escaped or c not in "%_\\":
            run, escaped = run + c, False
        elif c == "\\":
            escaped = True
        else:
            runs, run = [*runs, run], ""
    return sorted({r[i : i + 3] for r in [*runs, run] for i in range(len(r) - 2)})


def search_contests(
    candidates: DataFrame,
    q: str,
    limit: int | None = 10,
    keys: Sequence[str] = CONTEST_KEY,
    grams: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Contests whose name contains ``q`` (any case) or whose number is exactly ``q``; first ``limit`` by key (None: all).

    ``candidates`` is the entries table or its distinct (contest, name)
    index: the result is the same, the index is far smaller.  ``%`` and
    ``_`` in ``q`` act as wildcards.  A blank ``q`` gives no rows.

    With the written ``contest_grams`` and ``gram_counts`` of the same names,
    the names that hold the rarest trigrams of the pattern (``MOST_GRAMS``) are
    looked up and only those are matched; a pattern without a trigram, or whose
    rarest one stands in very many names, scans the index as before.
    """
    keys = list(keys)
    qc = clean_query(q)
    out = candidates.select(*keys, "ac_name")
    if not qc:
        return out.where(F.lit(False))
    pattern = contains_pattern(qc)
    by_name = F.col("ac_name").ilike(pattern)
    by_number = F.col("ac_no").cast("string") == F.lit(qc)
    found = out.where(by_name | by_number)
    if grams is not None and counts is not None:
        lowered = grams.sparkSession.range(1).select(F.lower(F.lit(pattern))).first()[0]  # by the engine's own rule
        wanted = pattern_grams(lowered)
        if wanted:
            known = {r["gram"]: r["names"] for r in counts.where(F.col("gram").isin(wanted)).collect()}  # one row a trigram of the pattern
            rarest = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:MOST_GRAMS]
            if known.get(rarest[0], 0) <= MOST_NAMES:
                hold = grams.where(F.col("gram").isin(rarest)).groupBy(*keys, "ac_name").agg(F.count(F.lit(1)).alias("_n"))
                hold = hold.where(F.col("_n") == len(rarest)).select(*keys, "ac_name")
                found = hold.where(by_name).unionByName(out.where(by_number))
    found = found.distinct().orderBy(*[F.col(c).asc_nulls_last() for c in (*keys, "ac_name")])
    return found if limit is None else found.limit(limit)


def contest_detail(enriched: DataFrame, ac_no: int, state: str | None = None) -> DataFrame:
    """Every entry of one contest number (in one state when given), in finish order."""
    cond = F.col("ac_no") == F.lit(ac_no)
    if state is not None:
        cond = cond & (F.col("state") == F.lit(state))
    return enriched.where(cond).orderBy(F.col("state").asc_nulls_last(), *rank_order())
