"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is a number of WIDTH bytes, the first of its role's and text's
SHA-256, written with its highest byte first; so conversations are byte
strings in which a common prefix of turns is a common prefix of bytes. They
are range-sorted by these bytes, and every task builds trees over runs of
neighbours. A tree's nodes grow from 4 to 16, 48 and 256 children, and chains
without a branch are kept as one compressed path. Only depths at whole turns
are nodes of the result.

A hot first turn or a conversation that many share is cut between tasks like
any other range. What trees of different runs have in common lies on the path
at which one run ends and the next begins, so it is made whole by sums over
partial nodes and a few corrections for each such border. The ids that end at
a node come in pieces, one for each tree, and are hashed as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import crc32_sql, shuffle_parts, stored

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations, and turns, of one tree.
TREE_ROWS, TREE_TURNS = 20_000, 200_000
#: Conversations borrow turns from the one whose id is a multiple of this; up to BORROWED - 1 of them.
FAMILY = 100
BORROWED = 6

_ROOT = b"\0" * WIDTH
_NODE, _BORDER = 0, 1
_PART = (
    "kind int, tree long, id binary, parent binary, depth long, conv_id long, n_convs long, n_leaves long, saved long, ends binary, "
    "first binary, first_chars array<int>, last binary"
)


class _Node4:
    """Up to four children: a sorted list of bytes and one of nodes."""

    __slots__ = ("path", "here", "keys", "kids")
    most = 4

    def __init__(self, path: bytes):
        self.path, self.here, self.keys, self.kids = path, None, bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node) -> None:
        at = self.keys.find(byte)
        if at >= 0:
            self.kids[at] = node
            return
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.kids.insert(at, node)

    def full(self) -> bool:
        return len(self.keys) >= self.most

    def grown(self):
        wider = _Node16(self.path) if self.most == 4 else _Node48(self.path)
        wider.here = self.here
        for byte, node in self.children():
            wider.put(byte, node)
        return wider

    def children(self):
        return zip(self.keys, self.kids, strict=True)


class _Node16(_Node4):
    __slots__ = ()
    most = 16


class _Node48:
    """Up to 48 children: a byte's place in the list of nodes is looked up in a table of 256."""

    __slots__ = ("path", "here", "at", "kids")

    def __init__(self, path: bytes):
        self.path, self.here, self.at, self.kids = path, None, bytearray(256), []

    def get(self, byte: int):
        return self.kids[self.at[byte] - 1] if self.at[byte] else None

    def put(self, byte: int, node) -> None:
        if self.at[byte]:
            self.kids[self.at[byte] - 1] = node
        else:
            self.kids.append(node)
            self.at[byte] = len(self.kids)

    def full(self) -> bool:
        return len(self.kids) >= 48

    def grown(self):
        wider = _Node256(self.path)
        wider.here = self.here
        for byte, node in self.children():
            wider.put(byte, node)
        return wider

    def children(self):
        return ((byte, self.kids[at - 1]) for byte, at in enumerate(self.at) if at)


class _Node256:
    """A place for each byte."""

    __slots__ = ("path", "here", "kids")

    def __init__(self, path: bytes):
        self.path, self.here, self.kids = path, None, [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, node) -> None:
        self.kids[byte] = node

    def full(self) -> bool:
        return False

    def grown(self):
        return self

    def children(self):
        return ((byte, node) for byte, node in enumerate(self.kids) if node is not None)


def _met(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class RadixTree:
    """An adaptive radix tree: each key's entry is a list, given by ``entry`` once for a key."""

    def __init__(self):
        self.root = _Node4(b"")

    def entry(self, key: bytes) -> list:
        above, byte, node, at = None, 0, self.root, 0
        while True:
            same = _met(node.path, key[at:])
            if same < len(node.path):
                # The path is split: what both have in common becomes a node of its own.
                top = _Node4(node.path[:same])
                first, node.path = node.path[same], node.path[same + 1 :]
                top.put(first, node)
                above.put(byte, top)
                node = top
            at += same
            if at == len(key):
                if node.here is None:
                    node.here = []
                return node.here
            child = node.get(key[at])
            if child is None:
                child = _Node4(key[at + 1 :])
                if node.full():
                    node = node.grown()
                    if above is None:
                        self.root = node
                    else:
                        above.put(byte, node)
                node.put(key[at], child)
                child.here = []
                return child.here
            above, byte, node, at = node, key[at], child, at + 1

    def walk(self):
        """(bytes that this node adds, its entry or None) in key order, with None where a node's subtree ends."""
        todo = [(b"", self.root)]
        while todo:
            item = todo.pop()
            if item is None:
                yield None
                continue
            before, node = item
            yield before + node.path, node.here
            todo.append(None)
            todo.extend(reversed([(bytes([byte]), child) for byte, child in node.children()]))


def _summaries(tree: RadixTree):
    """A dict for each node at a whole number of turns below ``tree``'s root or at it: sums over its subtree.

    An entry is a list of (conv_id, code points of each turn). Nodes come
    after all nodes below them.
    """

    def opened(node_id, parent, depth, chars):
        return {"id": node_id, "parent": parent, "depth": depth, "chars": chars, "conv_id": None, "n_convs": 0, "n_leaves": 0, "saved": 0, "ends": None, "childless": True}

    # The bytes after the last whole turn, and both as they were above each node.
    turns, pending, above_it = [opened(_ROOT, None, 0, 0)], b"", []
    for step in tree.walk():
        if step is None:
            depth, pending = above_it.pop()
            while len(turns) > depth:
                yield _closed(turns)
            continue
        added, here = step
        above_it.append((len(turns), pending))
        pending += added
        while len(pending) >= WIDTH:
            mine, pending = pending[:WIDTH], pending[WIDTH:]
            above = turns[-1]
            above["childless"] = False
            turns.append(opened(hashlib.sha256(above["id"] + mine).digest()[:WIDTH], above["id"], len(turns), None))
        if here:
            ids = sorted(c for c, _ in here)
            for t, n in zip(turns[1:], here[0][1], strict=True):
                t["chars"] = n
            turns[-1]["ends"] = ids
            turns[-1]["n_convs"] += len(ids)
            turns[-1]["conv_id"] = ids[0]
    yield _closed(turns)


def _closed(turns: list) -> dict:
    """The innermost open node, whose sums go to the one above."""
    t = turns.pop()
    t["n_leaves"] += t["childless"]
    if t["depth"]:
        t["saved"] += (t["n_convs"] - 1) * t["chars"]
    if turns:
        above = turns[-1]
        above["n_convs"] += t["n_convs"]
        above["n_leaves"] += t["n_leaves"]
        above["saved"] += t["saved"]
        above["conv_id"] = t["conv_id"] if above["conv_id"] is None else min(above["conv_id"], t["conv_id"])
    return t


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_pydict({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in (c.split() for c in _PART.split(", "))})


def _trees(batches, tree_rows: int, tree_turns: int):
    """Partial nodes of the trees over runs of the sorted conversations, and a row for each run's borders."""
    number, tree, n_rows, n_turns, first, last = 0, RadixTree(), 0, 0, None, None
    part = None

    def done():
        rows = []
        for t in _summaries(tree):
            ends = None if t["ends"] is None else ",".join(map(str, t["ends"])).encode()
            rows.append({"kind": _NODE, "tree": part + number, **{k: t[k] for k in ("id", "parent", "depth", "conv_id", "n_convs", "n_leaves", "saved")}, "ends": ends})
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        rows.append({"kind": _BORDER, "tree": part + number, "first": first[0], "first_chars": first[1], "last": last})
        yield _batch(rows)

    for batch in batches:
        for conv_id, key, chars, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n_rows and (n_rows >= tree_rows or n_turns + len(chars) > tree_turns):
                yield from done()
                number, tree, n_rows, n_turns, first = number + 1, RadixTree(), 0, 0, None
            part = p << 32
            first, last = first or (key, chars), key
            tree.entry(key).append((conv_id, chars))
            n_rows, n_turns = n_rows + 1, n_turns + len(chars)
    if n_rows:
        yield from done()


def _corrections(batches):
    """What partial nodes of neighbouring runs count twice, from (tree, first, first_chars, before): before is the end of the run before.

    A node of both runs counts (members - 1) in each; and where the run before
    ends is no leaf of its own if the next begins there or below.
    """
    for batch in batches:
        rows = []
        for tree, first, chars, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            both, ended = _met(first, before) // WIDTH, len(before) // WIDTH
            node, ids = _ROOT, [(_ROOT, None)]
            for d in range(both):
                node = hashlib.sha256(node + first[WIDTH * d : WIDTH * (d + 1)]).digest()[:WIDTH]
                ids.append((node, ids[-1][0]))
            more = 0
            for d in range(both, -1, -1):
                more += chars[d - 1] if d else 0
                rows.append({"kind": _NODE, "tree": tree, "id": ids[d][0], "parent": ids[d][1], "depth": d, "n_convs": 0, "n_leaves": -int(ended <= both), "saved": more})
        yield _batch(rows)


def _hashed(batches):
    """The SHA-256 of all pieces of each id, which come one after another."""
    now, state = None, None
    for batch in batches:
        ids, out = [], []
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    ids.append(now)
                    out.append(state.hexdigest())
                now, state = node, hashlib.sha256()
            state.update(ends)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.binary()), "ends_sha256": pa.array(out, pa.string())})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"id": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_id, chars): the turns of every rebuilt conversation, at from 0; a turnless one is one row with nulls.

    Conversation c takes the first h turns of c - c % FAMILY, h being the
    checksum of its number modulo BORROWED, and goes on with its own turns
    after the first h. The remainder has the sign of c, as in SQL.
    """
    spark = conversations.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    # A turn's place without a window over its conversation: its place in a range-sorted partition, and what lies before that.
    own = own.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    digest = F.unhex(F.substr(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), F.lit(1), F.lit(2 * WIDTH)))
    own = own.select("conv_id", digest.alias("turn_id"), F.length("text").alias("chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    own = stored(own, "turns")
    held = stored(own.groupBy("conv_id", "part").agg(F.min("nth").alias("least"), F.count(F.lit(1)).alias("n")), "held")
    # Only conversations that reach over several partitions have turns before; a window over a row for each of these.
    ahead = held.select("conv_id", "part", "least", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("ahead"))
    own = stored(own.join(ahead, ["conv_id", "part"]).select("conv_id", "turn_id", "chars", (F.col("ahead") + F.col("nth") - F.col("least")).alias("at")), "placed")

    total = held.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    takes = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    convs = total.select("conv_id", base.alias("base"), takes.alias("takes"))
    convs = stored(convs.join(total.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").select("conv_id", "base", "takes", F.least("takes", F.coalesce("there", F.lit(0))).alias("taken")), "convs")
    lent = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < BORROWED - 1)).select(F.col("conv_id").alias("base"), "at", "turn_id", "chars")
    # A lent turn goes to the FAMILY - 1 others of its hundred at most.
    borrowed = convs.where("taken > 0").join(lent, "base").where("at < taken").select("conv_id", "at", "turn_id", "chars")
    kept = own.join(convs, "conv_id").where("at >= takes").select("conv_id", (F.col("at") - F.col("takes") + F.col("taken")).alias("at"), "turn_id", "chars")
    turns = stored(borrowed.unionByName(kept), "rebuilt")
    none = convs.select("conv_id").join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    return turns.unionByName(none.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).alias("chars")))


def trie(turns: DataFrame, tree_rows: int = TREE_ROWS, tree_turns: int = TREE_TURNS) -> DataFrame:
    """One row per node over ``turns`` (conv_id, at, turn_id, chars), see prefix_trie()."""
    spark = turns.sparkSession
    each = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("turn_id").isNotNull(), F.struct("at", "turn_id", "chars")))).alias("t"))
    # Ids of fixed width one after another; the hex of no turn is empty.
    each = stored(each.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["turn_id"])), "")).alias("key"), F.col("t.chars").alias("chars")), "keys")
    ordered = each.repartitionByRange(shuffle_parts(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    parts = stored(ordered.select("conv_id", "key", "chars", "part").mapInArrow(lambda batches: _trees(batches, tree_rows, tree_turns), _PART), "trees")

    # A row for each tree, so the window is over few.
    borders = parts.where(F.col("kind") == _BORDER).select("tree", "first", "first_chars", F.lag("last").over(Window.orderBy("tree")).alias("before")).where("before is not null")
    fixes = borders.mapInArrow(_corrections, _PART)
    partial = parts.where(F.col("kind") == _NODE).unionByName(fixes)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved")]
    nodes = stored(partial.groupBy("id").agg(F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums), "nodes")

    pieces = parts.where("ends is not null").select("id", "ends", "tree")
    ends = pieces.repartition(shuffle_parts(spark), "id").sortWithinPartitions("id", "tree").select("id", "ends").mapInArrow(_hashed, "id binary, ends_sha256 string")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    named = stored(nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parents")
    out = nodes.join(named, "parent", "left").join(children, "id", "left").join(ends, "id", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first), then role and text; a null role or text is
    empty, repeated rows are turns of their own, and rows without a conv_id
    belong to no conversation. An empty table has no node; other columns are
    not read. A conversation's ids, WIDTH bytes a turn, are one value of up to
    2 GB, that is some 10^8 turns.
    """
    return trie(rebuilt(conversations))


SQL = rf"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, [coalesce(role, ''), coalesce(text, '')] AS turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(turn ORDER BY place) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, {crc32_sql("conv_id::VARCHAR")} % {BORROWED} AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(o.ts, [])[1:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % {FAMILY}),
m AS (SELECT conv_id, d AS depth, ts[1:d] AS p, len(ts) AS n FROM b, unnest(range(len(ts) + 1)) u(d)),
n AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends,
             (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(any_value(p)[depth][2]) END AS saved FROM m GROUP BY p, depth),
k AS (SELECT c.p[1:c.depth - 1] AS p, count(*) AS n_children FROM n c WHERE depth > 0 GROUP BY 1),
l AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
s AS (SELECT p[1:d] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM l, unnest(range(depth + 1)) u(d) GROUP BY 1)
SELECT l.conv_id, l.depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM l JOIN s ON s.p = l.p LEFT JOIN l q ON q.depth = l.depth - 1 AND q.p = l.p[1:l.depth - 1]
"""
