"""Secret scan: named credential forms, and sliding-window entropy for the rest.

Base kinds (``assign``, ``access``, ``hex``) are leftmost, non-overlapping
matches.  The kind ``entropy`` is found by its own method: maximal runs of a
character class (base64 letters, hexadecimal letters) are candidates; a window
of fixed length slides over each, and its Shannon entropy is kept up to date
from the counts of the letter that enters and the one that leaves.  Windows at
or over the class's threshold that mix letters and digits are merged into
spans.  A match of the allow-list leaves out the windows that overlap it, and
no others: what is glued to a known form is still looked at.

Nulls and empty texts have no span.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import ship

KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<kind:string,start:int,end:int>>"

# The ten letters of each word in either case, without Unicode folding.
_NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c + "?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
ASSIGN = re.compile(rf"({_NAME})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


@dataclass(frozen=True)
class CharClass:
    """A character class with its window length and least entropy in bits."""

    name: str
    chars: str
    window: int
    bits: float


CLASSES = (CharClass("base64", "A-Za-z0-9+/=_-", 20, 3.9), CharClass("hexadecimal", "0-9A-Fa-f", 24, 3.0))
#: The parts of candidates that match one of these are known forms without a secret.
ALLOW = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"^(sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==)",
    r"^[A-Za-z]+$",
    r"^[0-9=+/_-]+$",
)


def window_entropies(run: str, window: int) -> list[float]:
    """Entropy in bits of every window of ``run``, by incremental counts."""
    counts: dict[str, int] = {}
    xlog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    total, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += xlog[n + 1] - xlog[n]
        if i >= window:
            old = run[i - window]
            m = counts[old]
            counts[old] = m - 1
            total += xlog[m - 1] - xlog[m]
        if i >= window - 1:
            out.append(math.log2(window) - total / window)
    return out


def _mixed(run: str, window: int) -> list[bool]:
    """For every window: does it hold both a letter and a digit?"""
    letters = [0]
    digits = [0]
    for c in run:
        letters.append(letters[-1] + c.isalpha())
        digits.append(digits[-1] + c.isdigit())
    return [letters[i + window] > letters[i] and digits[i + window] > digits[i] for i in range(len(run) - window + 1)]


def _known(run: str, allow: list[re.Pattern]) -> list[int]:
    """For every place up to the end: the letters before it that lie in a match of the allow-list."""
    edges = [0] * (len(run) + 1)
    for a in allow:
        for m in a.finditer(run):
            edges[m.start()] += 1
            edges[m.end()] -= 1
    out, depth = [0], 0
    for e in edges[:-1]:
        depth += e
        out.append(out[-1] + (depth > 0))
    return out


class Scanner:
    """Finds the spans of one text; ``classes`` and ``allow`` as above."""

    def __init__(self, classes=CLASSES, allow=ALLOW, allow_texts=()):
        self.classes = [(c, re.compile(rf"(?<![{c.chars}])[{c.chars}]{{{c.window},}}")) for c in classes]
        self.allow = [re.compile(a) for a in allow]
        self.allow_texts = frozenset(allow_texts)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the base kinds."""
        found = []
        if ":" in text or "=" in text:
            low = text.lower()
            if any(n in low for n in NAMES):
                found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return found

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        """(start, 3, end) of merged high-entropy windows."""
        found = []
        for cls, runs in self.classes:
            for m in runs.finditer(text):
                run = m[0]
                if run in self.allow_texts:
                    continue
                known = _known(run, self.allow)
                if known[-1] == len(run):
                    continue
                mixed = _mixed(run, cls.window)
                for i, h in enumerate(window_entropies(run, cls.window)):
                    if h >= cls.bits and mixed[i] and known[i] == known[i + cls.window]:
                        found.append((m.start() + i, m.start() + i + cls.window))
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, 3, b) for a, b in merged]

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(self.base(text) + self.entropy(text))]


def secret_spans(text: Column, classes=CLASSES, allow=ALLOW, allow_texts=()) -> Column:
    """Spans of all kinds in a text column, by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    made: list[Scanner] = []

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(classes, allow, allow_texts))
        return pa.array([made[0].scan(t.as_py()) for t in texts], type=kind)

    return spans(text)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans", **options) -> DataFrame:
    """``docs`` with the spans in column ``out`` (a column of that name is replaced)."""
    ship(docs.sparkSession)
    return docs.withColumn(out, secret_spans(F.col(f"`{text}`"), **options))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each span, overlapping ones as one, replaced by ``mask``; a null text stays null."""

    def step(acc, s):
        start = F.greatest(s["start"], acc["at"])
        kept = F.substring(text, acc["at"] + 1, start - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["done"], kept, F.lit(mask))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    return F.when(
        F.size(spans) > 0,
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))),
    ).otherwise(text)
