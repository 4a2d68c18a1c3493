"""The trie of conversation prefixes, from sorted sequences and their LCPs.

A conversation is the sequence of its turns' digests (16 bytes of role and
text).  Equal sequences are one class; the classes are sorted, and the LCP of a
class is the number of turns it shares with the one before it.  A node of the
trie is a prefix of some class: its members are the classes of one interval of
the sorted table, namely those the prefix reaches without crossing an LCP
shorter than itself.

1. Turns are digested where they are read; texts are not shuffled.  A
   conversation's digests and text sizes (24 bytes a turn) are one row.
2. Ids of equal sequences meet in chunks of ``CHUNK`` neighbouring numbers
   before the chunks of a class meet, so a class of a third of all
   conversations sends few rows; its ids pass by in order into one digest.
3. Classes are dealt out by ranges of the sequence into blocks and written.
   Each block learns the LCPs at its two ends from its neighbours (two
   sequences a block go to the driver).
4. In a block, a sparse table holds the least LCP of every run of 2**k
   neighbours.  Every prefix of every class is a candidate; it searches its
   left extent by halving, and the one that finds itself there is the node,
   which searches its right extent the same way.  Members, leaves and tokens of a node are
   differences of running sums over its interval; the least id is a second
   sparse table's.  No stack, and no order between the searches.
5. A node whose interval crosses the end of its block leaves a part in each
   block it reaches (at most its own prefix in each, so at most depth x blocks
   parts); the parts are added up.  Sums need no other exchange: tokens saved
   in a subtree are sums over classes, with each class' new bytes behind its LCP.

Nulls: a null role or text is empty; a null turn comes first; turns of one
number follow their digests; rows with a null id belong to no conversation.
Repeated rows are turns of their own.  An empty table has no node.  Columns
beside the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import ship, written

#: Bytes of a turn's digest.
WIDE = 16
#: Ids, from a multiple of it on, that are put together before the chunks of a class meet.
CHUNK = 256
#: Turns of a block, about: what a task holds as arrays.
BLOCK_TURNS = 500_000
#: Nodes across blocks up to which their table is broadcast (about 100 bytes each).
MOST_BROADCAST = 500_000
NO_IDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's (digest as hex, bytes of text) in order."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("digest"),
        F.octet_length(t).cast("bigint").alias("bytes"),
    )
    rows = turns.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("bigint").alias("conv_id"), one.alias("one"))
    in_order = F.sort_array(F.collect_list("one"))
    return rows.groupBy("conv_id").agg(F.transform(in_order, lambda x: F.struct(x["digest"], x["bytes"])).alias("turns"))


def _classes(conversations: DataFrame, block_turns: int) -> DataFrame:
    """(block, key, sizes, n, least, ends): the distinct sequences, sorted within blocks that follow one another."""
    keyed = conversations.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key"),
        F.transform("turns", lambda x: x["bytes"]).alias("sizes"),
    )
    chunks = written(
        keyed.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
            F.first("sizes").alias("sizes"), F.sort_array(F.collect_list("conv_id")).alias("ids")
        ),
        "trie-chunks",
    )
    turns = chunks.agg(F.sum(F.size("sizes"))).first()[0] or 0
    least = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_chunks = chunks.repartitionByRange(max(least, turns // block_turns + 1), "key").sortWithinPartitions("key", "chunk")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        key, out, digest = None, [], None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = pa.schema([("block", pa.int32()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
        for batch in batches:
            for k, sizes, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "ids"))):
                text = ",".join(map(str, ids)).encode()
                if k == key:
                    digest.update(b"," + text)
                    out[-1]["n"] += len(ids)
                else:
                    if out:
                        out[-1]["ends"] = digest.hexdigest()
                    if len(out) >= 5_000:
                        yield made()
                        out.clear()
                    key, digest = k, hashlib.sha256(text)
                    out.append({"block": block, "key": k, "sizes": sizes, "n": len(ids), "least": ids[0]})
        if out:
            out[-1]["ends"] = digest.hexdigest()
            yield made()

    made = sorted_chunks.select("key", "sizes", "ids").mapInArrow(joined, "block int, key binary, sizes array<bigint>, n bigint, least bigint, ends string")
    return written(made, "trie-classes")


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns at the start of both."""
    n = min(len(a), len(b)) // WIDE
    x, y = (np.frombuffer(s, f"V{WIDE}", n) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def block_ends(classes: DataFrame) -> dict[int, tuple[int, int]]:
    """For each block, the LCP of its first class and of the first one after it (-1 at the table's ends)."""
    ends = classes.groupBy("block").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("block").collect()  # two rows a block
    out, before = {}, -1
    for i, e in enumerate(ends):
        after = shared_turns(e["b"], ends[i + 1]["a"]) if i + 1 < len(ends) else -1
        out[e["block"]] = (before, after)
        before = after
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k holds the least of every 2**k neighbours."""
    table = [values]
    while 2 * (half := 1 << (len(table) - 1)) <= len(values):
        last = table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def range_min(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value from ``first`` to ``last``, both included."""
    k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[level][first[at]], table[level][last[at] - (1 << int(level)) + 1])
    return out


def right_extent(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place reached from ``at`` to the right over LCPs of ``depth`` or more (LCP i is between i - 1 and i)."""
    pos = at.copy()
    for k in range(len(table) - 1, -1, -1):
        row = table[k]
        ok = pos + 1 < len(row)  # LCPs pos + 1 to pos + 2**k
        ok[ok] = row[pos[ok] + 1] >= depth[ok]
        pos[ok] += 1 << k
    return pos


def left_extent(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place reached from ``at`` to the left; -1 if the block's own first LCP is passed too."""
    pos = at.copy()
    for k in range(len(table) - 1, -1, -1):
        row, wide = table[k], 1 << k
        ok = pos - wide >= -1  # LCPs pos - 2**k + 1 to pos
        ok[ok] = row[pos[ok] - wide + 1] >= depth[ok]
        pos[ok] -= wide
    return pos


_NODE = pa.schema(
    [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary())]
)
_NODE_SQL = (
    "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint,"
    " ends_sha256 string, node binary, parent binary"
)


def _prefix_names(key: bytes, most: int) -> list[bytes]:
    """A digest of every prefix of up to ``most`` turns."""
    h = hashlib.md5()
    out = [h.digest()]
    for d in range(most):
        h.update(key[d * WIDE : (d + 1) * WIDE])
        out.append(h.digest())
    return out


def block_nodes(keys: list[bytes], sizes: list[list[int]], n: list[int], least: list[int], ends: list[str], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a sorted block, and its parts of the nodes that cross its ends (those have a ``node`` name).

    A node inside the block whose parent crosses an end has the parent's name instead of its id.
    """
    count = len(keys)
    length = np.array([len(k) // WIDE for k in keys], np.int64)
    start = np.concatenate([[0], np.cumsum(length)])
    flat = np.frombuffer(b"".join(keys), f"V{WIDE}") if start[-1] else np.empty(0, f"V{WIDE}")
    size = np.fromiter((s for row in sizes for s in row), np.int64, int(start[-1]))
    upto = np.concatenate([[0], np.cumsum(size)])  # bytes before each turn of the block
    # LCPs: of each class with the one before it; the first with the block before.
    lcp = np.empty(count, np.int64)
    lcp[0] = before
    if count > 1:
        m = np.minimum(length[:-1], length[1:])
        pair = np.repeat(np.arange(count - 1), m)
        j = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
        differ = np.flatnonzero(flat[start[pair] + j] != flat[start[pair + 1] + j])
        lcp[1:] = m
        np.minimum.at(lcp, pair[differ] + 1, j[differ])
    following = np.append(lcp[1:], after)

    weight, ids = np.array(n, np.int64), sparse_table(np.array(least, np.int64))
    total = upto[start[1:]] - upto[start[:-1]]
    new = total - (upto[start[:-1] + np.maximum(lcp, 0)] - upto[start[:-1]])  # bytes behind the LCP
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    weights, weighted, news, leaves = run(weight), run(weight * total), run(new), run(length > following)
    table = sparse_table(lcp)
    by_lcp = np.lexsort((np.arange(count), lcp))  # places in order of their LCP: for counting children
    place_of = lcp[by_lcp] * (count + 1) + by_lcp

    # Every prefix of every class is a candidate: class at, depth 0 to its length.
    at = np.repeat(np.arange(count), length + 1)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1)
    left = left_extent(table, at, depth)
    right = right_extent(table, at, depth)
    # It is the node itself if it reaches no class on its left, and the block's part of one if it comes from the left.
    own = (left == at) & (depth > lcp[at])
    part = (left == -1) & (at == 0)
    keep = own | part
    open_right = (right == count - 1) & (depth <= after)

    i, d, r = at[keep], depth[keep], right[keep]
    first_bytes = upto[start[i] + np.maximum(d - 1, 0)] - upto[start[i]]
    members = weights[r + 1] - weights[i]
    # A node starts its own branch at its first class; a part does where the LCP with the block before is its depth.
    behind = news[r + 1] - news[i + 1] + np.where(own[keep], total[i] - first_bytes, new[i])
    saved = weighted[r + 1] - weighted[i] - members * first_bytes - behind
    place = d * (count + 1)
    children = np.searchsorted(place_of, place + r, "right") - np.searchsorted(place_of, place + i, "right")
    children = children + np.where(own[keep], length[i] > d, (lcp[i] == d) & (length[i] > d))
    node_leaves = leaves[r + 1] - leaves[i]
    smallest = range_min(ids, i, r)
    closed = own[keep] & ~open_right[keep]

    # The parent is the same class' candidate one turn up.
    up = np.flatnonzero(keep) - 1
    has_parent = d > 0
    up[~has_parent] = 0
    pl, pr = left[up], right[up]
    crossing = has_parent & ((pl == -1) | open_right[up])
    inside = closed & has_parent & ~crossing
    parent_id = np.zeros(len(i), np.int64)
    parent_id[inside] = range_min(ids, np.maximum(pl[inside], 0), pr[inside])

    names: dict[int, list[bytes]] = {}
    named = np.flatnonzero(~closed | crossing)
    node, parent = [None] * len(i), [None] * len(i)
    deepest: dict[int, int] = {}
    for x in named:
        c = int(i[x])
        deepest[c] = max(deepest.get(c, 0), int(d[x]))
    for x in named:
        c, e = int(i[x]), int(d[x])
        if c not in names:
            names = {c: _prefix_names(keys[c], deepest[c])}
        if not closed[x]:
            node[x] = names[c][e]
        if e:
            parent[x] = names[c][e - 1]
    is_end = own[keep] & (length[i] == d)
    ended = np.array(ends, object)[i]
    arrays = [d, smallest, pa.array(parent_id, pa.int64(), mask=~inside), members, children, node_leaves, saved]
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()) if isinstance(a, np.ndarray) else a for a in arrays]
        + [pa.array(np.where(is_end, ended, np.where(own[keep], NO_IDS, None)), pa.string()), pa.array(node, pa.binary()), pa.array(parent, pa.binary())],
        schema=_NODE,
    )


def _blocks(ends: dict[int, tuple[int, int]]):
    """Rows sorted by (block, key) to the nodes of each block."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, [[] for _ in range(5)]
        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "sizes", "n", "least", "ends"))):
                if b != block:
                    if block is not None:
                        yield from sliced(block_nodes(*held, *ends[block]))
                    block, held = b, [[] for _ in range(5)]
                for h, v in zip(held, row):
                    h.append(v)
        if block is not None:
            yield from sliced(block_nodes(*held, *ends[block]))

    def sliced(made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, made.num_rows, 10_000):
            yield made.slice(at, 10_000)

    return mapped


def trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turns as ``sequences`` makes them; one row an id).

    conv_id (the smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens (bytes of text that members
    share with an earlier one, over the subtree) and ends_sha256 (of the ids
    that end at the node).
    """
    ship(conversations.sparkSession)
    classes = _classes(conversations, block_turns)
    ends = block_ends(classes)
    made = written(classes.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_blocks(ends), _NODE_SQL), "trie-nodes")
    inside = made.where(F.col("node").isNull()).drop("node")
    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    across = (
        made.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in figures],
            F.max("ends_sha256").alias("ends_sha256"),
            F.max("parent").alias("parent"),
        )
    )
    out = ("conv_id", "depth", "parent_conv_id", *figures, "ends_sha256")
    across = written(across, "trie-across")
    parents = across.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent"))
    # A node across blocks is a prefix that two neighbouring blocks share.
    if sum(before + 1 for before, _ in ends.values()) <= most_broadcast:
        parents = F.broadcast(parents)
    every = inside.unionByName(across.withColumn("parent_conv_id", F.lit(None).cast("bigint")).drop("node"))
    to_find = every.where(F.col("parent").isNotNull()).join(parents, "parent", "left").withColumn("parent_conv_id", F.col("_parent"))
    return every.where(F.col("parent").isNull()).select(*out).unionByName(to_find.select(*out))
