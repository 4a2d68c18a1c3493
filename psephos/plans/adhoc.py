"""Ad-hoc read-only SQL over the named datasets (S-9).

A statement must pass the word rule (``READ_ONLY_PATTERN``).  It is parsed
before it runs: a command anywhere in its tree is refused.  Of the analysed
plan every node is looked at, in expressions and subqueries too: leaves that
read anything have to lie under a named view, and functions that call into the
JVM or read files are refused.  The trees themselves are walked, not their
text, so names, line breaks and print limits make no difference.  Spark's parser
refuses a second statement.  The result is a lazy DataFrame; nothing is
collected here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from psephos.functions.text import READ_ONLY_PATTERN

# Leaves that read nothing; expressions that reach outside the data.
HARMLESS_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation")
REACHING_EXPRESSIONS = ("CallMethodViaReflection", "InputFileName", "InputFileBlockStart", "InputFileBlockLength")
REACHING_FUNCTIONS = ("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length")


class UnsafeQueryError(ValueError):
    pass


def is_read_only_sql(sql: str) -> bool:
    """The read-only rule on one statement."""
    return re.search(READ_ONLY_PATTERN, sql.strip().lower()) is not None


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _is_command(node) -> bool:
    kinds, cls = {node.getClass().getName()}, node.getClass()
    while cls is not None:
        kinds |= {i.getName() for i in cls.getInterfaces()}
        cls = cls.getSuperclass()
    return any(k.endswith(("plans.logical.Command", "plans.logical.ParsedStatement", "InsertIntoStatement")) for k in kinds)


def _expressions(node) -> Iterator:
    """Every expression of a node, however deep."""
    stack = list(_each(node.expressions()))
    while stack:
        e = stack.pop()
        yield e
        stack.extend(_each(e.children()))


def _nodes(plan) -> Iterator[tuple[object, bool]]:
    """(node, lies under a view) of a plan: children, hidden plans and subqueries in expressions."""
    stack = [(plan, False)]
    while stack:
        node, viewed = stack.pop()
        yield node, viewed
        viewed = viewed or _kind(node) == "View"
        for below in (node.children(), node.innerChildren(), node.subqueries()):
            stack.extend((n, viewed) for n in _each(below))


def refused_command(spark: SparkSession, sql: str) -> str | None:
    """The first command in the parsed statement, or function by a name that reaches outside the data."""
    for node, _ in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        if _is_command(node):
            return _kind(node)
        for e in _expressions(node):
            if _kind(e) == "UnresolvedFunction" and (name := str(e.nameParts().last()).lower()) in REACHING_FUNCTIONS:
                return name
    return None


def outside_views(df: DataFrame) -> list[str]:
    """Of the analysed plan: leaves that read something and lie under no view, and expressions that reach outside."""
    found = []
    for node, viewed in _nodes(df._jdf.queryExecution().analyzed()):
        if viewed:
            continue
        kind = _kind(node)
        if node.children().isEmpty() and kind not in HARMLESS_LEAVES and kind != "View":
            found.append(kind)
        found += [_kind(e) for e in _expressions(node) if _kind(e) in REACHING_EXPRESSIONS]
    return found


def adhoc_query(spark: SparkSession, sql: str, args: Mapping[str, object] | Sequence[object] | None = None) -> DataFrame:
    """Run a read-only query over the registered views; raises ``UnsafeQueryError`` otherwise.

    ``args`` are values by name (``:name``) or by position (``?``).
    """
    if not is_read_only_sql(sql):
        raise UnsafeQueryError("only a single read-only SELECT / WITH query is allowed")
    if refused := refused_command(spark, sql):
        raise UnsafeQueryError(f"{refused} is not allowed in a read-only query")
    df = spark.sql(sql, args=dict(args) if isinstance(args, Mapping) else list(args) if args else None)
    if outside := outside_views(df):
        raise UnsafeQueryError(f"only the named datasets can be read, not {outside[0]}")
    return df
