"""The trie of all conversations: who begins alike, how far, and what sharing saves.

Turns become ids of a dictionary, a conversation its list of ids. Equal lists are one.
The lists are dealt into shards by their order, so a subtree is a run of shards, and a
shard holds a bounded number of turns however many conversations begin alike. Each shard
has a ternary search tree, balanced by inserting the median list first; one pass over its
nodes, children before parents, adds up members, leaves and savings without recursion.

Only the beginnings that a shard's first list shares with the shard before, and its last
list with the shard after, are nodes of several shards. These boundary nodes are merged
by a digest of their ids. A node counts as a child, and its bytes as kept once, in the
first shard that has it, so all figures of a boundary node are plain sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import stored

SHARD_TURNS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
EMPTY = "array<long>"


# -- conversations as lists of turn ids


def sequences(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation: ``conv_id``, ``ids`` of its turns in order and their ``bytes``.

    Turns are alike if role and text are (NULL counts as empty); they are told apart by
    SHA-256, so texts never leave the scan. Turns go by number, NULL first; those of one
    number by that digest. A repeated row is a turn of its own. Rows without a
    ``conv_id`` belong to no conversation. No other column is read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = stored(
        conversations.select(
            F.col(conv_col).cast("long").alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.unhex(F.sha2(marked.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).where(F.col("conv_id").isNotNull()),
        "turns",
    )
    known = turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id())
    dictionary = stored(known, "dictionary")
    placed = F.struct(
        F.col("turn").isNotNull().alias("numbered"), "turn", "digest", "id", "bytes"
    )
    listed = (
        turns.join(dictionary, "digest")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(placed)).alias("turns"))
    )
    return listed.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("bytes"))


def spliced(lists: DataFrame, step: int = 5, most: int = 8) -> DataFrame:
    """Conversations begun by turns of another: that of their own step's multiple.

    The first ``h`` turns come from the conversation ``conv_id - conv_id % step`` (all if
    it has fewer, none if there is none), those after its first ``h`` from the
    conversation itself; ``h`` is crc32 of the id's decimal text modulo ``most + 1``.
    """
    lists = stored(lists, "lists")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = lists.select(
        F.col("conv_id").alias("base"),
        F.slice("ids", 1, most).alias("head_ids"),
        F.slice("bytes", 1, most).alias("head_bytes"),
    )
    own = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % step, "h": h})

    def joined(name: str) -> Column:
        head = F.coalesce(F.col(f"head_{name}"), F.array().cast(EMPTY))
        rest = F.slice(F.col(name), F.col("h") + 1, F.size(name))
        return F.concat(F.slice(head, F.lit(1), F.col("h")), rest).alias(name)

    return own.join(heads, "base", "left").select("conv_id", joined("ids"), joined("bytes"))


# -- equal lists


def _ends(members: DataFrame) -> DataFrame:
    """Per list (``key``): members, the smallest, and the digest of all, ascending.

    A digest reads its ids one after the other; so that a list with very many members
    is no burden to the task that does so, range-sorted tasks join the ids first.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            runs = list(zip(cuts, [*cuts[1:], len(keys)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[a] for a, _ in runs], pa.binary()),
                    pa.array([ids[a] for a, _ in runs], pa.int64()),
                    pa.array([b - a for a, b in runs], pa.int64()),
                    pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string()),
                ],
                ["key", "first", "n", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, state = None, 0, 0, hashlib.sha256()

        def done(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "first", "n", "ends"]
            )

        for batch in batches:
            rows = []
            for k, f, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        rows.append((key, first, n, state.hexdigest()))
                    key, first, n, state = k, f, 0, hashlib.sha256()
                else:
                    state.update(b",")
                n += m
                state.update(ids.encode())
            yield done(rows)
        if key is not None:
            yield done([(key, first, n, state.hexdigest())])

    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ranged.mapInArrow(join, "key binary, first long, n long, ids string")
    gathered = joined.repartition("key").sortWithinPartitions("key", "first")
    return gathered.mapInArrow(digest, "key binary, first long, n long, ends string")


def _distinct(lists: DataFrame) -> DataFrame:
    """One row per different list: ``ids``, ``bytes``, its members' number, first and digest."""
    text = F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))
    keyed = stored(lists.withColumn("key", F.unhex(F.sha2(text.cast("binary"), 256))), "keyed")
    whole = keyed.groupBy("key").agg(F.first("ids").alias("ids"), F.first("bytes").alias("bytes"))
    return whole.join(_ends(keyed.select("key", "conv_id")), "key").drop("key")


# -- one shard


class Tree:
    """Ternary search tree of id lists; node 0 is the root, parents precede children."""

    def __init__(self) -> None:
        self.symbol, self.low, self.high, self.down = [0], [-1], [-1], [-1]
        self.up, self.depth, self.bytes = [-1], [0], [0]

    def _new(self, symbol: int, up: int, size: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1),
            (self.up, up), (self.depth, self.depth[up] + 1), (self.bytes, size),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node a list ends at."""
        symbols, low, high, down = self.symbol, self.low, self.high, self.down
        node = 0
        for x, size in zip(ids, sizes, strict=True):
            at, side, before = down[node], down, node
            while at >= 0 and symbols[at] != x:
                side, before = (low if x < symbols[at] else high), at
                at = side[at]
            if at < 0:
                at = self._new(x, node, size)
                side[before] = at
            node = at
        return node

    def path(self, end: int) -> list[int]:
        """From the root to a node."""
        nodes = [end]
        while nodes[-1] > 0:
            nodes.append(self.up[nodes[-1]])
        return nodes[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before what lies on its sides."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(middle + 1, b), (a, middle)]


def _shared(a: list[int], b: list[int] | None) -> int:
    """Length of the common beginning, -1 if there is no other list."""
    if b is None:
        return -1
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


_NODES = pa.schema(
    [
        ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.int64()), ("n", pa.int64()),
        ("children", pa.int64()), ("leaves", pa.int64()), ("sent", pa.int64()), ("once", pa.int64()),
        ("ends", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ]
)


def shard_nodes(
    lists: list[tuple[list[int], list[int], int, int, str]],
    before: list[int] | None,
    after: list[int] | None,
) -> pa.Table:
    """All nodes of one shard's lists (ids, sizes, members, first, ends).

    ``before`` is the last list of the shard before, ``after`` the first of the one
    after. Boundary nodes have a ``key`` and this shard's part of the figures; their
    children a ``parent_key`` in place of a ``parent``.
    """
    lists = sorted(lists, key=lambda row: row[0])
    tree, end_of = Tree(), [0] * len(lists)
    for i in medians(len(lists)):
        end_of[i] = tree.insert(lists[i][0], lists[i][1])
    size = len(tree.symbol)
    n, children, leaves, sent, once = ([0] * size for _ in range(5))
    first: list[int | None] = [None] * size
    ends: list[str | None] = [None] * size
    for node, (_, _, members, least, digest) in zip(end_of, lists, strict=True):
        n[node], first[node], ends[node] = members, least, digest
    earlier, later = tree.path(end_of[0]), tree.path(end_of[-1])
    with_before = earlier[: _shared(lists[0][0], before) + 1]
    reach = _shared(lists[-1][0], after)
    with_after = later[: reach + 1]
    elsewhere, goes_on = set(with_before), end_of[-1] if reach == len(lists[-1][0]) else -1
    keys: list[bytes | None] = [None] * size
    for nodes in (with_before, with_after):
        state = hashlib.sha256()
        for node in nodes:
            if node:
                state.update(tree.symbol[node].to_bytes(8, "little", signed=True))
            keys[node] = state.copy().digest()
    for i in range(size - 1, -1, -1):
        sent[i] += n[i] * tree.bytes[i]
        owned = i not in elsewhere
        once[i] += tree.bytes[i] if owned else 0
        if tree.down[i] < 0 and i != goes_on:
            leaves[i] = 1
        if i:
            up = tree.up[i]
            n[up] += n[i]
            first[up] = first[i] if first[up] is None else min(first[up], first[i])
            children[up] += owned
            leaves[up] += leaves[i]
            sent[up] += sent[i]
            once[up] += once[i]
    up = tree.up
    columns = [
        tree.depth, first, [None if not i or keys[up[i]] else first[up[i]] for i in range(size)],
        n, children, leaves, sent, once, ends, keys, [keys[up[i]] if i else None for i in range(size)],
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)


def _neighbours(shards: DataFrame) -> DataFrame:
    """Per shard the last list of the one before it and the first of the one after."""
    bounds = stored(shards.groupBy("shard").agg(F.min("ids").alias("least"), F.max("ids").alias("most")), "bounds")
    filled = sorted(row["shard"] for row in bounds.select("shard").collect())
    around = [None, *filled, None]
    order = list(zip(filled, around, around[2:], strict=False))
    schema = "shard int, before int, after int"
    return (
        shards.sparkSession.createDataFrame(order, schema)
        .join(bounds.select(F.col("shard").alias("before"), "most"), "before", "left")
        .join(bounds.select(F.col("shard").alias("after"), "least"), "after", "left")
        .select("shard", "most", "least")
    )


# -- the whole trie


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per distinct beginning of the lists (``conv_id``, ``ids``, ``bytes``): its figures.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id``
    NULL for the root. Conversations without turns end at the root. Without
    conversations there is no node, not even a root. ``conv_id`` is unique in ``lists``.
    """
    distinct = stored(_distinct(lists), "distinct")
    total = distinct.agg(F.sum(F.size("ids") + 1).alias("turns")).first()["turns"] or 0
    count = int(-(-total // shard_turns)) or 1
    dealt = distinct.repartitionByRange(count, "ids").withColumn("shard", F.spark_partition_id())
    shards = stored(dealt, "shards")

    def build(own: pa.Table, edge: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _NODES.empty_table()
        names = ("ids", "bytes", "n", "first", "ends")
        rows = list(zip(*(own[c].to_pylist() for c in names), strict=True))
        return shard_nodes(rows, edge["most"][0].as_py(), edge["least"][0].as_py())

    made = shards.groupBy("shard").cogroup(_neighbours(shards).groupBy("shard")).applyInArrow(
        build,
        "depth long, conv_id long, parent long, n long, children long, leaves long, sent long, "
        "once long, ends string, key binary, parent_key binary",
    )
    nodes = stored(made, "nodes")
    inner = nodes.where(F.col("key").isNull())
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "sent", "once")]
    merged = stored(
        nodes.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums,
            F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"),
        ),
        "boundary",
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    beneath = inner.where(F.col("parent_key").isNotNull()).drop("parent", "key")
    hung = beneath.unionByName(merged.drop("key")).join(parents, "parent_key", "left")
    every = inner.where(F.col("parent_key").isNull()).drop("key").unionByName(hung)
    return every.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("sent") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), coded AS (
  SELECT conv_id, pos, dense_rank() OVER (ORDER BY role, text) AS sym,
    octet_length(encode(text)) AS size
  FROM own
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda x, b: xor(xor(x, b) >> 1, (xor(x, b) & 1) * 3988292384)), 4294967295::BIGINT) % 9 AS h
  FROM coded
), rebuilt AS (
  SELECT c.conv_id, t.pos, t.sym, t.size FROM convs c JOIN coded t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.sym, t.size FROM convs c JOIN coded t ON t.conv_id = c.conv_id AND t.pos > c.h
), lists AS (
  SELECT c.conv_id, coalesce(list(r.sym ORDER BY r.pos) FILTER (r.sym IS NOT NULL), []) AS syms,
    coalesce(list(r.size ORDER BY r.pos) FILTER (r.sym IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), begun AS (
  SELECT conv_id, len(syms) AS whole, unnest(range(0, len(syms) + 1)) AS depth, syms, sizes FROM lists
), nodes AS (
  SELECT syms[1:depth] AS beginning, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    max(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
    max(whole) > depth AS has_children,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = depth), '')) AS ends_sha256
  FROM begun GROUP BY syms[1:depth], depth
), above AS (
  SELECT beginning, n_convs, size, has_children, unnest(range(0, depth + 1)) AS level FROM nodes
), sums AS (
  SELECT beginning[1:level] AS beginning, level AS depth, count(*) FILTER (NOT has_children) AS n_leaves,
    sum((n_convs - 1) * size) AS saved
  FROM above GROUP BY beginning[1:level], level
), kids AS (
  SELECT beginning[1:depth - 1] AS beginning, depth - 1 AS depth, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY beginning[1:depth - 1], depth - 1
)
SELECT n.conv_id, n.depth, p.conv_id::DOUBLE AS parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n
JOIN sums s ON s.depth = n.depth AND s.beginning = n.beginning
LEFT JOIN kids k ON k.depth = n.depth AND k.beginning = n.beginning
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.beginning = n.beginning[1:n.depth - 1]
"""
