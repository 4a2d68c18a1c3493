"""Repair of conversation structure: the cheapest edits that make the roles alternate.

The rows of a conversation are taken by turn (nulls first; rows of one turn by
a digest of role and text, so that equal rows lie side by side).  A row's
first fault counts:

* ``blank``: its text has no character but the six ASCII blanks;
* ``duplicate``: an earlier row has its role and text;
* ``truncated``: its last character that is no blank is none of ``.!?``.

Edits, in ASCII order of their initials: Delete (2; blank and duplicate rows
must go), Insert an empty ``user`` or ``assistant`` turn (5), Keep (0), Rerole
to ``user`` or ``assistant`` (1).  A truncated row that is not deleted adds 5.
The initials of the roles that are left have to read ``(s?(ua)+)?``.

The search is iterative-deepening A*: depth first in the order above, under a
bound on cost so far plus a lower bound of the rest; a state (rows done, last
role) that failed at some cost fails at every cost from that up, under the same
bound; if all fails, the bound rises to the least total that was over it.  The
lower bound is the cost of the remaining rows with the end left open (a
conversation may then stop anywhere), so it never exceeds the true cost and
falls short of it by two inserted turns at most: few bounds are needed, and a
conversation of n rows costs on the order of n steps.  The first accepting
path under the first bound that has one is the ASCII-least of the cheapest.

On Spark every row goes once through one exchange by conversation, sorted: its
short code first (before any text of the conversation), its text after those.
A task reads a conversation's codes (a byte and a digest each), searches, and
then passes the texts by, a batch at a time; texts are never gathered.  One
conversation is one task's: the digest of its repaired text is one chain.

Nulls: a null role or text counts as one space, a null turn comes first and
takes no part in ``gaps``, rows with a null id are one conversation.  A role
without a character can't be kept.  Repeated rows are duplicates.  An empty
table gives no rows.  Columns beside the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from psephos.llm.common import WORD_SQL, ship

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Last role: none yet, s, u, a.  The state after a role, or None where it may not follow.
AFTER_S, AFTER_U, AFTER_A = (1, None, None, None), (2, 2, None, 2), (None, None, 3, None)
ACCEPTING = (0, 3)
NEXT_INSERT = (2, 2, 3, 2)
#: Codes of rows: 0 to 3 a role's initial (s, u, a, another), 4 more if truncated; blank (must go); no row.
CLEAN, MUST_GO, GONE = 4, 8, 9
_FAR = 1 << 60


@lru_cache(maxsize=4096)
def _moves(code: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(initial, cost, rows passed, state after) of every edit, in ASCII order; code -1: no row is left."""
    moves = [] if code < 0 else [("D", DELETE, 1, state)]
    moves.append(("I", INSERT, 0, NEXT_INSERT[state]))
    if 0 <= code < MUST_GO:
        more = TRUNCATED if code >= CLEAN else 0
        kept = (AFTER_S, AFTER_U, AFTER_A, (None,) * 4)[code % CLEAN][state]
        if kept is not None:
            moves.append(("K", more, 1, kept))
        moves.append(("R", REROLE + more, 1, NEXT_INSERT[state]))
    return tuple(moves)


def lower_bounds(codes: bytes) -> list[tuple[int, ...]]:
    """For each number of rows done and each state, the cost of the rest if it may end in any state."""
    out = [(0, 0, 0, 0)]
    for code in reversed(codes):
        rest = out[-1]
        own = [min(cost + rest[to] for _, cost, passed, to in _moves(code, q) if passed) for q in range(4)]
        for _ in range(2):  # an insert, and a second one before it
            own = [min(own[q], INSERT + own[NEXT_INSERT[q]]) for q in range(4)]
        out.append(tuple(own))
    out.reverse()
    return out


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, audit): the least cost, and the ASCII-least of the edits' initials at that cost."""
    n = len(codes)
    least = lower_bounds(codes)
    bound = least[0][0]
    while True:
        failed = [_FAR] * (4 * n + 4)  # least cost at which a state failed under this bound
        over = _FAR
        failed[0] = 0
        path: list[str] = []
        stack = [(0, 0, 0, iter(_moves(codes[0] if n else -1, 0)))]
        if not n:
            return 0, ""
        while stack:
            row, state, cost, moves = stack[-1]
            for name, more, passed, to in moves:
                at, g = row + passed, cost + more
                total = g + least[at][to]
                if total > bound:
                    over = min(over, total)
                elif failed[4 * at + to] > g:
                    path.append(name)
                    if at == n and to in ACCEPTING:
                        return g, "".join(path)
                    failed[4 * at + to] = g
                    stack.append((at, to, g, iter(_moves(codes[at] if at < n else -1, to))))
                    break
            else:
                stack.pop()
                if path:
                    path.pop()
        bound = over


_short_edits = lru_cache(maxsize=1 << 16)(cheapest_edits)


class _Conversation:
    """What a task keeps of the conversation it reads: codes, digests seen, figures; then the running text digest."""

    def __init__(self, id):
        self.id = id
        self.codes, self.seen = bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.turns, self.before = 0, None
        self.audit: str | None = None

    def code(self, code: int, turn, key: bytes) -> None:
        if code == GONE:
            return
        initial = code % 10
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last or self.turns == 0
            self.last = turn
        if code >= 10:  # blank: the initial counts for adjacent roles only
            self.blank += 1
            code = MUST_GO
        elif key in self.seen:
            self.duplicate += 1
            code = MUST_GO
        elif code >= CLEAN:
            self.truncated += 1
        self.seen.add(key)
        role = initial % CLEAN
        if self.before is not None:
            self.illegal += (self.before, role) not in ((0, 1), (1, 2), (2, 1))
        self.before = role
        self.codes.append(code)

    def search(self) -> None:
        codes = bytes(self.codes)
        self.seen.clear()
        self.cost, self.audit = (_short_edits if len(codes) <= 64 else cheapest_edits)(codes)
        self.at, self.place = 0, 0
        self.system = (len(codes) and len(self.audit) - self.audit.count("D")) % 2  # an odd number of turns starts with s
        self.digest = hashlib.sha256()

    def _turn(self, edit: str, role: str | None, text: str):
        if role is None:
            role = "assistant" if (self.place - self.system) % 2 else "user"
        if self.place:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode())
        self.place += 1
        return self.id, self.place - 1, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn("I", None, "")

    def text(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(edit, role if edit == "K" else None, text)

    def report(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.digest.hexdigest()


def _read(turns: DataFrame, id: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """Each row's code, and after all codes of its conversation its text; dealt by conversation, in order."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.when(r == "", "-").otherwise(F.substring(r, 1, 1))), F.lit(0)) - 1, F.lit(3))
    whole = t.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = F.when(~t.rlike(WORD_SQL), 10 + initial).when(whole, initial).otherwise(CLEAN + initial)
    is_gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = turns.select(
        F.col(f"`{id}`").alias("id"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        r.alias("role"),
        t.alias("text"),
        F.when(is_gone, GONE).otherwise(code).cast("int").alias("code"),
        F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))).alias("key"),
    )
    none = F.lit(None).cast("string")
    codes = F.struct(F.lit(0).alias("part"), none.alias("role"), none.alias("text"))
    texts = F.struct(F.lit(1).alias("part"), F.col("role"), F.col("text"))
    parts = F.when(F.col("code") == GONE, F.array(codes)).otherwise(F.array(codes, texts))
    sent = rows.select("id", "turn", "code", "key", F.explode(parts).alias("p")).select("id", "p.part", "turn", "key", "code", "p.role", "p.text")
    return sent.repartition("id").sortWithinPartitions("id", "part", "turn", "key")


def _passed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Repaired turns, or reports, of the conversations of a sorted partition."""
    now: _Conversation | None = None

    def ended() -> Iterator[tuple]:
        if now.audit is None:
            now.search()
        rest = list(now.inserted())
        if turns:
            yield from rest
        else:
            yield now.report()

    for batch in batches:
        for id, part, turn, key, code, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or id != now.id:
                if now is not None:
                    yield from ended()
                now = _Conversation(id)
            if part == 0:
                now.code(code, turn, key)
            else:
                if now.audit is None:
                    now.search()
                for made in now.text(role, text):
                    if turns:
                        yield made
    if now is not None:
        yield from ended()


def _run(turns: DataFrame, id: str, turn: str, role: str, text: str, gone: Column | None, want_turns: bool) -> DataFrame:
    ship(turns.sparkSession)
    more = "place bigint, edit string, role string, text string" if want_turns else (
        "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    )
    schema = T.StructType([T.StructField(id, turns.schema[id].dataType), *T.StructType.fromDDL(more).fields])
    arrow = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for made in _passed(batches, want_turns):
            held.append(made)
            size += 64 + len(made[-1])
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return _read(turns, id, turn, role, text, gone).mapInArrow(mapped, schema)


def repair(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired turns: id, place (from 0), edit (I, K or R), role and text.

    Rows for which ``gone`` holds name their conversation but are no rows of it.
    """
    return _run(turns, id, turn, role, text, gone, True)


def report(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """For every id: gaps between turns, faults, adjacent roles that are not su, ua or au, the
    cost and audit of the cheapest edits, and the digest of the repaired ``role:text`` lines."""
    return _run(turns, id, turn, role, text, gone, False)
