"""License scan, prefix trie and structure repair against brute force; nulls, empty tables, clashing columns."""

from __future__ import annotations

import binascii
import hashlib
import random
import re
from collections import defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.llm import conversation_repair, license_rules, license_scan, prefix_trie, queries
from psephos.llm.common import table
from tests.conftest import SMOKE

TURNS = "conv_id bigint, turn bigint, role string, text string"
TEXTS = ["", " ", "Yes.", "No", "Why? ", "So\n", "Well!", None]
ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "", None]


def some_turns(seed, n, conversations=12):
    """Turns with nulls, few texts (so prefixes and whole conversations are shared), gaps, ties of unequal rows kept out."""
    rng, rows, seen = random.Random(seed), [], set()
    for _ in range(n):
        c = rng.choice([*range(conversations), -3, None])
        t = rng.choice([*range(7), None])
        if (c, t) not in seen:
            seen.add((c, t))
            rows.append((c, t, rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def clashing(df, names):
    for name in names:
        df = df.withColumn(name, F.lit(7))
    return df


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


# ---------------------------------------------------------------- prefix trie


def plain_trie(rebuilt):
    nodes, kids, out = defaultdict(list), defaultdict(list), {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = [out[q] for q in kids[p]]
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        out[p] = (1 if not below else sum(b[0] for b in below), own + sum(b[1] for b in below))
    ends = lambda p: ",".join(str(c) for c in sorted(nodes[p]) if len(rebuilt[c]) == len(p))
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -99, len(m), len(kids[p]), *out[p], hashlib.sha256(ends(p).encode()).hexdigest())
        for p, m in nodes.items()
    )


def trie_rows(df):
    return sorted(
        (r["conv_id"], r["depth"], -99 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
        for r in df.collect()
    )


def plain_sequences(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    return {c: tuple((r[2] or "", r[3] or "") for r in by_turn(rs)) for c, rs in own.items()}


def plain_rebuilt(rows):
    own = plain_sequences(rows)
    h = {c: binascii.crc32(str(c).encode()) % 9 for c in own}
    base = lambda c: c - int(np.fmod(c, 5))
    return {c: own.get(base(c), ())[: h[c]] + own[c][h[c] :] for c in own}


@pytest.mark.parametrize("block_turns, most_broadcast", [(10**6, 10**6), (5, 10**6), (5, -1)])
def test_trie_in_any_blocks(spark, block_turns, most_broadcast):
    rows = some_turns(3, 70, 25)
    turns = clashing(spark.createDataFrame(rows, TURNS), ("turns", "digest", "key", "sizes", "node", "parent", "block", "n"))
    got = trie_rows(prefix_trie.trie(prefix_trie.sequences(turns), block_turns, most_broadcast))
    assert got == plain_trie(plain_sequences(rows))
    rebuilt = queries.rebuilt_conversations(turns)
    assert trie_rows(prefix_trie.trie(rebuilt, block_turns, most_broadcast)) == plain_trie(plain_rebuilt(rows))


def test_trie_of_many_copies_and_long_conversations(spark):
    """A group of copies of a third of all conversations spans chunks of ids; a long text, and a long conversation and its copy cut short."""
    copies = [(c, t, "user", "same " * 3) for c in range(0, 900, 2) for t in range(3)]
    long = [(c, t, "user", f"turn {t}") for c, n in ((1, 700), (3, 400), (5, 699)) for t in range(n)]
    rows = [*copies, *long, (7, 0, "user", "x" * 100_000), (9, None, None, None)]
    got = trie_rows(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)), 100))
    assert got == plain_trie(plain_sequences(rows))


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([], TURNS)
    assert trie_rows(queries.op12_prefix_trie.__globals__["prefix_trie"].trie(queries.rebuilt_conversations(turns))) == []
    nobody = spark.createDataFrame([(None, 0, "user", "a")], TURNS)
    assert trie_rows(prefix_trie.trie(prefix_trie.sequences(nobody))) == []


def test_repeated_turns_are_turns(spark):
    rows = [(1, 0, "user", "a")] * 2 + [(2, 0, "user", "a")]
    got = trie_rows(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, TURNS))))
    assert [r[1] for r in got] == [0, 1, 2] and [r[3] for r in got] == [2, 2, 1]


def test_range_minima_and_extents():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 33):
        lcp = rng.integers(0, 4, n)
        lcp[0] = rng.integers(-1, 3)
        t = prefix_trie.sparse_table(lcp)
        for i in range(n):
            for d in range(5):
                left = i
                while left >= 0 and lcp[left] >= d:
                    left -= 1
                right = i
                while right + 1 < n and lcp[right + 1] >= d:
                    right += 1
                at, depth = np.array([i]), np.array([d])
                assert prefix_trie.left_extent(t, at, depth)[0] == left
                assert prefix_trie.right_extent(t, at, depth)[0] == right
            for j in range(i, n):
                assert prefix_trie.range_min(t, np.array([i]), np.array([j]))[0] == lcp[i : j + 1].min()


def test_trie_query_on_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SMOKE, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op12_prefix_trie(spark, SMOKE)) == plain_trie(plain_rebuilt(rows))


# ----------------------------------------------------------- structure repair

LANGUAGE = re.compile(r"(s?(ua)+)?\Z")


def every_edit(rows, most):
    """(cost, audit, repaired) of every edit of cost ``most`` or less that gives the language; rows are (role, text, fault)."""
    out = []

    def go(i, cost, audit, made):
        if cost > most:
            return
        if i == len(rows) and LANGUAGE.match("".join(m[0][:1] or "-" for m in made)):
            out.append((cost, audit, "\n".join(f"{a}:{b}" for a, b in made)))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*made, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(i + 1, cost + more, audit + "K", [*made, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*made, (to, text)])

    go(0, 0, "", [])
    return out


def plain_report(rows):
    """Of the rows (turn, role, text) of one conversation after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    edits = every_edit([(r[1], r[2], f) for r, f in zip(rows, faults)], 2 * len(rows)) if rows else [(0, "", "")]
    cost, audit, repaired = min(edits)
    assert {e[2] for e in edits if e[:2] == (cost, audit)} == {repaired}
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256(repaired.encode()).hexdigest(),
    )


def plain_damage(rows):
    out = {}
    text_of = lambda v: " " if v is None else str(v)
    for c, turn, role, text in by_turn(rows):
        kind = binascii.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(c, [])
        if kind:
            out[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def report_rows(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_repair_equals_every_edit(spark):
    rows = [r for r in some_turns(11, 75, 30)]
    damaged = plain_damage(rows)
    rows = [r for r in rows if len(damaged[r[0]]) <= 5]  # all edits are listed for short ones
    turns = clashing(spark.createDataFrame(rows, TURNS), ("part", "key", "code", "place", "edit", "audit", "cost", "gaps", "dropped"))
    got = report_rows(conversation_repair.report(queries.damaged_conversations(turns), gone=F.col("dropped")))
    assert got == {c: plain_report(r) for c, r in plain_damage(rows).items()}


def by_dp(codes):
    """Cheapest (cost, audit) by the exact table of the rest, from the end."""
    best = None
    for i in range(len(codes), -1, -1):
        now = {}
        for q in range(4):
            options = [(0, "")] if i == len(codes) and q in conversation_repair.ACCEPTING else []
            if i < len(codes):
                for name, cost, passed, to in conversation_repair._moves(codes[i], q):
                    if passed and best[to]:
                        options.append((cost + best[to][0], name + best[to][1]))
            now[q] = min(options) if options else None
        for _ in range(3):
            for q in range(4):
                z = now[conversation_repair.NEXT_INSERT[q]]
                if z and (now[q] is None or (5 + z[0], "I" + z[1]) < now[q]):
                    now[q] = (5 + z[0], "I" + z[1])
        best = now
    return best[0]


def test_search_equals_exact_table():
    for n in range(4):
        for codes in product(range(9), repeat=n):
            assert conversation_repair.cheapest_edits(bytes(codes)) == by_dp(codes)
    rng = random.Random(2)
    for n in (9, 40, 150):
        for _ in range(8):
            codes = bytes(rng.choice([1, 2, 1, 2, 0, 3, 5, 6, 8]) for _ in range(n))
            assert conversation_repair.cheapest_edits(codes) == by_dp(codes)


def test_lower_bounds_hold():
    rng = random.Random(3)
    for _ in range(50):
        codes = bytes(rng.randrange(9) for _ in range(rng.randrange(12)))
        cost = by_dp(codes)[0]
        assert cost - 10 <= conversation_repair.lower_bounds(codes)[0][0] <= cost


def test_long_conversation_is_repaired(spark):
    """30,000 turns with faults everywhere, and a very long text: one pass, whole."""
    rng = random.Random(4)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + rng.choice([".", ".", ".", ""])) for t in range(30_000) if rng.random() > 0.02]
    rows.append((2, 0, "user", "y" * 500_000 + "."))
    got = report_rows(conversation_repair.report(spark.createDataFrame(rows, TURNS)))
    codes = bytes((1 if r[2] == "user" else 2) + (0 if r[3].endswith(".") else 4) for r in rows if r[0] == 1)
    assert got[1][5:7] == by_dp(codes) and got[1][0] == rows[-2][1] - rows[0][1] + 1 - (len(rows) - 1)
    assert got[2][5:7] == (4 - 2, "D")


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "Yes."), (1, 4, "system", "Be kind."), (2, 0, "user", " ")]
    got = [tuple(r) for r in conversation_repair.repair(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Be kind.")]  # KDDR comes before KDRD
    assert conversation_repair.repair(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_repair.report(spark.createDataFrame([], TURNS)).count() == 0


def test_repair_of_null_conversation(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (None, 2, "assistant", "B."), (5, None, "user", "A.")]
    got = report_rows(conversation_repair.report(spark.createDataFrame(rows, TURNS)))
    assert got[None][:7] == (0, 1, 0, 0, 1, 2, "DKK") and got[5][:7] == (0, 0, 0, 0, 0, 2, "D")


def test_repair_query_on_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SMOKE, "conversations").select("conv_id", "turn", "role", "text").collect()]
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r)
    got = report_rows(queries.op13_structure_repair(spark, SMOKE))
    assert set(got) == set(by_id)
    damaged = {c: plain_damage(rs)[c] for c, rs in by_id.items()}
    assert all(got[c] == plain_report(damaged[c]) for c in by_id if len(damaged[c]) <= 5)


# --------------------------------------------------------------- license scan

SCHEMA = "doc_id bigint, text string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_detections(text, table):
    """Every rule on every text, without a prefilter; suppression over all pairs."""
    words = plain_words(text)
    joined = " " + "  ".join(words) + " " if words else ""
    found = []
    for r in table:
        for m in re.finditer(r.pattern, joined):
            start = joined[: m.start()].count(" ") // 2
            found.append((start, start + m[0].count(" ") // 2, r.level, r.number, r.label))
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or y[2] == x[2] and ((y[0], y[1]) != (x[0], x[1]) or y[3] < x[3]))
    return sorted(x for x in found if not any(inside(x, y) for y in found))


LICENSED = [
    None,
    "",
    " \n\t",
    "Under the MIT License, under-the-mit-license; UNDER THE MIT LICENSE",
    "CC BY-NC cc by nc CC-BY-NC-SA 4.0",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-3.0-or-later\nThis work is licensed under the GNU General Public License, version 3.",
    "the GNU General Public License and the GNU Lesser General Public License v2.1",
    "ünder the mit license; mit licenseé; mit lizenz mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X nor the names of its contributors may be used to endorse or promote products.",
    "see https://creativecommons.org/licenses/by-nc-nd/4.0/ and http://www.gnu.org/licenses/old-licenses/gpl-2.0.html",
    "Released into the public domain. All rights reserved. all rights reserved",
    "word " * 30_000 + "Apache License Version 2" + " under the mit license" * 2_000,
]


def detections(df):
    return {r["doc_id"]: sorted((d["start"], d["end"], d["level"], d["rule"], d["label"]) for d in r["licenses"]) for r in df.collect()}


def test_licenses_equal_plain_scan(spark):
    rules = license_rules.rules()
    docs = clashing(spark.createDataFrame(list(enumerate(LICENSED)), SCHEMA), ("words", "licenses", "n_words", "own", "hits", "base", "joined"))
    out = license_scan.find_licenses(docs)
    assert out.columns == ["doc_id", "text", "words", "own", "hits", "base", "joined", "n_words", "licenses"]
    got = detections(out)
    short = {i: t for i, t in enumerate(LICENSED) if len(t or "") < 1_000}
    assert {i: got[i] for i in short} == {i: plain_detections(t, rules) for i, t in short.items()}
    assert len(got[12]) == 2_001 and got[12][-1] == (30_004 + 1_999 * 4 - 0, 30_008 + 1_999 * 4, 4, 0, "mit")
    assert {r["doc_id"]: r["n_words"] for r in out.collect()} == {i: len(plain_words(t)) for i, t in enumerate(LICENSED)}


def test_every_rule_is_found_behind_its_words(spark):
    """A text made from each rule's own pattern is detected, so the prefilter's words are in all of its matches."""
    rules = license_rules.rules()
    assert len(rules) > 300 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    rng = random.Random(6)
    texts = [" ".join(one_match(r.pattern, rng).split()) for r in rules for _ in range(3)]
    assert all(re.search(r.pattern, " " + "  ".join(t.split()) + " ") for r, t in zip((r for r in rules for _ in range(3)), texts))
    got = detections(license_scan.find_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)))
    for i, t in enumerate(texts):
        assert got[i] == plain_detections(t, rules), t


def one_match(pattern, rng):
    """A random text that a pattern of groups, classes and repeats matches."""
    import re._parser as parser

    def made(parts):
        out = ""
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "q"
            elif name == "IN":
                out += "q" if str(arg[0][0]) == "NEGATE" else chr(rng.choice([c for n, v in arg for c in ([v] if str(n) == "LITERAL" else range(v[0], v[1] + 1))]))
            elif name == "BRANCH":
                out += made(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name == "MAX_REPEAT":
                least, most, what = arg
                out += "".join(made(what) for _ in range(rng.randint(least, min(most, least + 2))))
            else:
                raise ValueError(name)
        return out

    return made(parser.parse(pattern))


def test_licenses_of_nothing(spark):
    assert license_scan.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_query_equals_oracle(spark):
    docs = f"CREATE VIEW documents AS FROM '{SMOKE}/documents.parquet'"
    con = duckdb.connect()
    con.execute(docs)
    want = con.execute(queries.ORACLE_SQL["op11_license_scan"])
    columns = [c[0] for c in want.description]
    got = queries.op11_license_scan(spark, SMOKE)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_license_scan_is_native(spark):
    plan = queries.op11_license_scan(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
