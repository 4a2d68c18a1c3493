"""License scan by ordered signature rules, with DataFrame functions only.

A text's words are its runs of letters, digits and signs beyond ASCII, with A-Z
lower-cased (a null text has none).  Each rule (``license_rules``: over three
hundred) is a regular expression over those words and names words that each of
its matches holds.

1. The text's words are met with the words of all rules; a rule is tried on a
   text only if all its words are there.  Most texts hold none and are done.
2. A rule's matches (leftmost, not overlapping) are found over the words joined
   by blanks, and turned into word places.
3. Detections are sorted by start, longest first, then by level and rule order.
   One is suppressed if one before it of its level or a higher one reaches to its end
   or beyond: if it lies within a longer, or a higher-ranking, detection.  One
   pass that carries the furthest end of each level decides it, so n
   detections cost n steps, not n x n.  Base phrases have the highest level.

All of it is per row: no shuffle, and the rules travel in the plan (bounded by
the table in ``license_rules``).  Repeated rows are scanned each; an empty
table gives an empty one; columns named like the added ones are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.license_rules import BASE, EXACT, MENTION, NAME, Rule, rules

#: What parts words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Confidence of a detection by its level.
CONFIDENCE = {BASE: 1.0, EXACT: 0.95, NAME: 0.8, MENTION: 0.5}
ADDED = ("n_words", "licenses")
_SPAN = "start:int,end:int,level:int,rule:int,label:string"


def _word_count(part: Column) -> Column:
    """Words in a part of the joined text, where every word has a blank on either side."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def _matches(joined: Column, rule: Column) -> Column:
    """The rule's detections, as (start, -end, -level, rule, label): in the order they are sorted by."""
    found = F.regexp_extract_all(joined, rule["pattern"], F.lit(0))
    between = F.split(joined, rule["pattern"], -1)
    none = F.array().cast("array<struct<start:int,less_end:int,less_level:int,rule:int,label:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _word_count(pair["before"])
        end = start + _word_count(pair["found"])
        one = F.struct(
            start.alias("start"), (-end).alias("less_end"), (-rule["level"]).alias("less_level"), rule["number"].alias("rule"), rule["label"].alias("label")
        )
        return F.struct(end.alias("at"), F.array_append(acc["spans"], one).alias("spans"))

    pairs = F.zip_with(between, found, lambda b, f: F.struct(b.alias("before"), f.alias("found")))
    pairs = F.filter(pairs, lambda p: p["found"].isNotNull())  # the last part has no match after it
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def _unsuppressed(detections: Column) -> Column:
    levels = (BASE, EXACT, NAME, MENTION)
    kept = F.array().cast(f"array<struct<{_SPAN}>>")

    def step(acc: Column, d: Column) -> Column:
        end, level = -d["less_end"], -d["less_level"]
        reach = F.lit(-1)
        for one in levels:
            reach = F.greatest(reach, F.when(F.lit(one) >= level, acc[f"end{one}"]).otherwise(F.lit(-1)))
        one = F.struct(d["start"].alias("start"), end.alias("end"), level.alias("level"), d["rule"].alias("rule"), d["label"].alias("label"))
        ends = [F.when(level == x, F.greatest(acc[f"end{x}"], end)).otherwise(acc[f"end{x}"]).alias(f"end{x}") for x in levels]
        return F.struct(*ends, F.when(reach >= end, acc["kept"]).otherwise(F.array_append(acc["kept"], one)).alias("kept"))

    start = F.struct(*[F.lit(-1).alias(f"end{x}") for x in levels], kept.alias("kept"))
    return F.aggregate(F.sort_array(detections), start, step, lambda acc: acc["kept"])


def find_licenses(docs: DataFrame, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: the detections left, as (start, end, level, rule, label).

    Places are words from 0, the end exclusive; ``rule`` is the number in ``table`` (by default ``license_rules.rules()``).
    """
    table = rules() if table is None else table
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    lower = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    ruled = F.from_json(
        F.lit(json.dumps([{"number": r.number, "label": r.label, "level": r.level, "words": r.words, "pattern": r.pattern} for r in table])),
        "array<struct<number:int,label:string,level:int,words:array<string>,pattern:string>>",
    )
    needed = F.array(*[F.lit(w) for w in sorted({w for r in table for w in r.words})])
    df = docs.select(F.struct(*own).alias("own"), F.filter(F.split(lower, SEPARATORS), lambda w: w != "").alias("words"))
    df = df.withColumn("there", F.array_intersect(needed, "words"))
    tried = F.filter(ruled, lambda r: F.size(F.array_except(r["words"], F.col("there"))) == 0)
    df = df.select("own", F.size("words").cast("long").alias("n_words"), "words", F.when(F.size("there") > 0, tried).alias("tried"))
    joined = F.when(F.size("tried") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    df = df.select("own", "n_words", "tried", joined.alias("joined"))
    hits = F.filter("tried", lambda r: F.regexp_like(F.col("joined"), r["pattern"]))
    df = df.select("own", "n_words", "joined", F.when(F.col("joined").isNotNull(), hits).alias("hits"))
    detections = F.flatten(F.transform("hits", lambda r: _matches(F.col("joined"), r)))
    df = df.select("own", "n_words", F.when(F.size("hits") > 0, detections).alias("detections"))
    none = F.array().cast(f"array<struct<{_SPAN}>>")
    licenses = F.when(F.col("detections").isNotNull(), _unsuppressed(F.col("detections"))).otherwise(none)
    names = [c for c in docs.columns if c not in ADDED]
    return df.select(*[F.col(f"own.`{c}`") for c in names], "n_words", licenses.alias("licenses"))


def labels(licenses: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(licenses, lambda x: x["label"]))), ",")


def base(licenses: Column) -> Column:
    return F.filter(licenses, lambda x: x["level"] == BASE)


def confidence(licenses: Column) -> Column:
    """Of the surest detection; 0 without one."""
    level = F.coalesce(F.array_max(F.transform(licenses, lambda x: x["level"])), F.lit(0))
    out = F.lit(0.0)
    for one, value in CONFIDENCE.items():
        out = F.when(level == one, F.lit(value)).otherwise(out)
    return out
