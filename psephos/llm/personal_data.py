"""Personal data: named forms, and terms that disclose them by co-occurrence.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are leftmost,
non-overlapping matches.  Their values are the protected entities.  The terms
(letters and digits, three at least) of a text that mentions an entity are
tested against the corpus: with n(e) texts that mention the entity, n(t) texts
that hold the term, n(e,t) texts with both and N texts, a term discloses

    PMI(e,t) = log2(n(e,t) N / (n(e) n(t)))   of the   IC(e) = log2(N / n(e))

bits that name the entity.  From ``GENERALISE`` of that information on, a term
is generalised to its shape, from ``REMOVE`` on it is removed; either is a span
of kind ``term``.  A disclosing term is treated wherever it stands outside base
spans, also in texts without the entity; where it discloses several, the
stricter holds.

Copies are no evidence of their own: N and n(t) count distinct texts, and n(e)
and n(e,t) count groups of near-duplicates (five-word shingles, 0.8) among the
texts with an entity.  A term needs ``SUPPORT`` groups with the entity, and their
number must be beyond chance: the chance that n(e,t) or more of n(e) texts hold
the term, bounded from above, times the terms tested for the entity, is at most ``CHANCE``.

All counts run over all rows.  Null and empty texts
have no span.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import attach, hot_limit, ship, written
from psephos.llm.near_dedup import near_duplicates

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, GENERALISE, REMOVE, CHANCE = 2, 0.9, 0.98, 0.01
#: Terms whose counts a task keeps before it hands them on.
TERMS_HELD = 300_000
#: Bits of the filter of disclosing terms: so many a term (so it lets few others by), and at least and at most (32 MB).
BITS_PER_TERM, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 28

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the form around each @ in turn: no long run is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        elif start < at:
            free = start  # what precedes this @ may not precede another
        at = text.find("@", max(at + 1, free))


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds, by kind, then start."""
    if not text:
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _only_digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return found


def _hash(s: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _only_digits(value)}"


def term_places(text: str, spans: list[tuple[int, int, int]], wanted=None) -> dict[int, list[tuple[int, int]]]:
    """(start, end) of every term outside ``spans``, by hash; ``wanted`` tells of a list of hashes which to look for."""
    words = list(set(TERM.findall(text)))
    if not words:
        return {}
    hashes = [_hash(w.lower()) for w in words]
    known = {w: h for w, h, k in zip(words, hashes, wanted(hashes) if wanted else [True] * len(words)) if k}
    if not known:
        return {}
    starts, ends = [], []  # of the spans by start, with the greatest end up to there
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)
    out: dict[int, list[tuple[int, int]]] = {}
    for m in TERM.finditer(text):
        h = known.get(m[0])
        if h is not None:
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                out.setdefault(h, []).append(m.span())
    return out


def _mentions(column: Column) -> Column:
    """Entities of a text and, if it has any, its terms."""

    @F.arrow_udf("struct<es:array<bigint>,ts:array<bigint>>")
    def mentions(texts: pa.Array) -> pa.Array:
        es, ts = [], []
        for t in texts:
            text = t.as_py()
            found = base_spans(text)
            es.append(sorted({_hash(entity(k, text[a:b])) for k, a, b in found}))
            ts.append(sorted(term_places(text, found)) if found else [])
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(es, kind), pa.array(ts, kind)], ["es", "ts"])

    return mentions(column)


PLACES = "array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
NEAR = pa.list_(pa.struct([("t", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
BOTH = f"struct<spans:array<struct<kind:string,start:int,end:int>>,near:array<struct<t:bigint,places:{PLACES}>>>"


def _term_filter(telling: DataFrame) -> np.ndarray:
    """Bits (64 a word) of the hashes in ``t``, ``MOST_BITS`` at most: what misses it is no such term."""
    n, bits = telling.count(), LEAST_BITS
    while bits < min(n * BITS_PER_TERM, MOST_BITS):
        bits *= 2
    at = F.col("t").bitwiseAND(F.lit(bits - 1))
    words = telling.select(at.alias("at")).select(F.expr("cast(at div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.uint64)
    return out


def _in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that were not put in."""
    at = hashes & (len(words) * 64 - 1)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _scan_column(column: Column, sent) -> Column:
    """Base spans, and the places of the terms that pass the filter (``sent`` is a broadcast of it)."""

    @F.arrow_udf(BOTH)
    def scan(texts: pa.Array) -> pa.Array:
        words = sent.value

        def wanted(hashes: list[int]) -> list[bool]:
            return _in_filter(words, np.array(hashes, np.int64)).tolist()

        spans, near = [], []
        for t in texts:
            text = t.as_py()
            found = base_spans(text)
            spans.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found])
            places = term_places(text, found, wanted) if text else {}
            near.append([{"t": h, "places": [{"start": a, "end": b} for a, b in p]} for h, p in sorted(places.items())])
        return pa.StructArray.from_arrays([pa.array(spans, SPANS), pa.array(near, NEAR)], ["spans", "near"])

    return scan(column)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each term, summed up over some texts at a time."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in held], pa.int64()), pa.array(list(held.values()), pa.int64())], ["t", "n"])

    held: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            text = t.as_py()
            if text:
                held.update({w.lower() for w in set(TERM.findall(text))})
            if len(held) > TERMS_HELD:
                yield out(held)
                held = Counter()
    yield out(held)


def _distinct_texts(column: Column, docs: DataFrame) -> tuple[int, DataFrame]:
    """The number of distinct texts that are not empty, and (t, n): how many of them hold each term.

    Only texts that may have a copy (a filter of bounded size, of the digests found twice, says so) meet their copies.
    """
    texts = docs.select(column.alias("text")).where(F.length("text") > 0).withColumns({"d": F.xxhash64("text"), "e": F.xxhash64("text", F.lit(1))})
    digests = written(texts.groupBy("d", "e").agg(F.count(F.lit(1)).alias("k")), "text-digests")
    sent = docs.sparkSession.sparkContext.broadcast(_term_filter(digests.where(F.col("k") > 1).select(F.col("d").alias("t"))))

    @F.arrow_udf("boolean")
    def may_have_copy(d: pa.Array) -> pa.Array:
        return pa.array(_in_filter(sent.value, d.to_numpy()))

    marked = texts.withColumn("copied", may_have_copy("d"))
    copied = marked.where("copied").groupBy("d", "e").agg(F.first("text").alias("text"))
    counted = [x.select("text").mapInArrow(_count_terms, "t long, n long") for x in (marked.where(~F.col("copied")), copied)]
    return digests.count(), counted[0].unionByName(counted[1]).groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(e, t, n_e, n_et, n_t, share, action): the terms that disclose an entity, both as hashes; counts as in the module's text."""
    ship(docs.sparkSession)
    column = F.col(f"`{text}`")
    # Texts with entities only: few hold any.
    mentions = docs.select(column.alias("text"), _mentions(column).alias("m")).where(F.size("m.es") > 0)
    mentions = written(mentions.select(F.monotonically_increasing_id().alias("row"), "text", "m.es", "m.ts"), "mentions")
    groups = near_duplicates(mentions, id="row", size=5, percent=80).select("row", F.col("component_id").alias("group"))
    groups = written(mentions.select("row", "es", "ts").join(groups, "row"), "mention-groups")
    n, n_t = _distinct_texts(column, docs)
    rows = groups.count()
    by_e = groups.select("group", F.explode("es").alias("e"), F.size("ts").alias("tested"))
    # No term can have SUPPORT groups with an entity that has fewer.
    n_e = by_e.groupBy("e", "group").agg(F.max("tested").alias("tested")).groupBy("e").agg(F.count("group").alias("n_e"), F.sum("tested").alias("tested"))
    n_e = written(n_e.where(F.col("n_e") >= SUPPORT).withColumn("size", F.col("n_e")), "entities")
    often = attach(groups.select("group", F.explode("es").alias("e"), "ts"), n_e, "e", "size", hot_limit(rows)).where(F.col("n_e").isNotNull())
    pairs = often.select("e", "n_e", "tested", "group", F.explode("ts").alias("t")).groupBy("e", "t", "group").agg(F.first("n_e").alias("n_e"), F.first("tested").alias("tested"))
    pairs = pairs.groupBy("e", "t").agg(F.count("group").alias("n_et"), F.first("n_e").alias("n_e"), F.first("tested").alias("tested")).where(F.col("n_et") >= SUPPORT)
    every = F.lit(float(max(n, 1)))
    information = F.log2(every / F.col("n_e"))
    disclosed = F.log2(F.col("n_et") * every / (F.col("n_e") * F.col("n_t")))
    share = F.when(information > 0, disclosed / information).otherwise(0.0)
    # At least n_et of n_e texts, each with a chance of n_t / N: at most exp(n_e H(n_et / n_e)) (n_t / N) ** n_et.
    part = F.col("n_et") / F.col("n_e")
    entropy = F.when(part < 1, -(part * F.log(part) + (1 - part) * F.log(1 - part))).otherwise(0.0)
    chance = F.col("n_e") * entropy + F.col("n_et") * F.log(F.col("n_t") / every) + F.log(F.col("tested"))
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    told = pairs.join(n_t, "t").withColumn("share", share).where((F.col("share") >= GENERALISE) & (chance <= math.log(CHANCE)))
    return told.select("e", "t", "n_e", "n_et", "n_t", "share", action.alias("action"))


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "personal_spans", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless ``keep_text``) with ``out``: spans (kind, start, end, action) by kind, then start.

    ``action`` is null for base kinds, ``generalise`` or ``remove`` for terms.
    A column named ``out`` is replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != out and (keep_text or c != text)]
    column = F.col(f"`{text}`")
    telling = written(disclosures(docs, text).groupBy("t").agg(F.max("action").alias("action"), F.max("n_t").alias("n_t")), "telling-terms")
    rows = docs.count()
    sent = docs.sparkSession.sparkContext.broadcast(_term_filter(telling))
    found = written(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own") if kept else F.lit(None).alias("own"), F.monotonically_increasing_id().alias("row"), _scan_column(column, sent).alias("s"))
        .select("own", "row", "s.spans", "s.near"),
        "personal-data",
    )
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("c")).select("row", "c.*")
    told = attach(near, telling, "t", "n_t", hot_limit(rows)).where(F.col("action").isNotNull())
    terms = told.select("row", F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.col("action").alias("action"))).alias("terms"))
    terms = terms.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("action")))
    extra = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("action")))
    spans = F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, extra))
    return found.join(terms, "row", "left").select(*[F.col(f"own.`{c}`") for c in kept], spans.alias(out))


def sanitise(text: str, spans: list[dict]) -> str:
    """``text`` with base spans replaced by their kind, generalised terms by their shape, removed terms left out."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            continue
        term = text[s["start"] : s["end"]]
        shape = "[NAME]" if term[:1].isupper() else "[WORD]"
        out += [text[at : s["start"]], {"generalise": shape, "remove": ""}.get(s.get("action"), f"[{s['kind'].upper()}]")]
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitised(text: Column, spans: Column) -> Column:
    """The same as a column, over the spans of ``find_personal_data``; a null text stays null."""

    def step(acc: Column, s: Column) -> Column:
        first = F.substring(text, s["start"] + 1, F.lit(1))
        shape = F.when(first != F.lower(first), "[NAME]").otherwise("[WORD]")
        mask = F.when(s["action"] == "generalise", shape).when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["done"], kept, mask)).otherwise(acc["done"]).alias("done"), F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"))

    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    whole = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its texts sanitised: base spans become their kind, terms that disclose an entity their shape, or nothing."""
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    found = find_personal_data(docs, text, out=spans, keep_text=True)
    return found.withColumn(text, sanitised(F.col(f"`{text}`"), F.col(spans))).select(*[F.col(f"`{c}`") for c in docs.columns])


def spans_by_kind(spans: Column) -> Column:
    """The base spans alone."""
    return F.filter(spans, lambda s: s["kind"] != "term")
