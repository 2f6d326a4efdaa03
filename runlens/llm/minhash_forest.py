"""MinHash near-dedup by an LSH forest.

A document's set of word shingles has a signature of TREES * DEPTH minima, a
tree's DEPTH of them being its place in that tree. A tree is one sorted order
of all signatures, range-partitioned, so that neighbours are those with the
longest common prefix. Documents that share LEAST_DEPTH leading minima are a
region. Candidates are taken in two steps.

First every set meets two others: the neighbour in the orders and the hub of
its regions whose prefixes agree most with its own. A hub is the member that
shares most with others, as the origin of edited copies does, so thousands of
copies cost as many comparisons as there are copies.

Then regions that still hold several components are searched whole. Where few
members are outside the region's largest component, all are compared with it
and with each other; a crowded region is searched deeper instead, in the
regions that more minima make of it, down to DEPTH, where whatever is left
is compared. Two sets at the threshold share a region of
depth 3 in one of 24 trees but for 1 in 10^10, and one of depth 8 but for 5 in
10^4. Parity sketches, whose bound loses no link, thin these candidates
out. All candidates are confirmed on full sets.

Equal sets are one node from the start, so exact copies cost nothing here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import bitmap, components, corpus, has_bit, shuffle_parts, slices, stored
from runlens.llm.shingles import common, parity_sketch, word_shingles

WORDS = 3
#: Two sets link when 100 * intersection >= SIMILAR * union.
SIMILAR = 85
#: Sets of fewer shingles link with equal ones only: 1 of 6 is more than 100 - SIMILAR in a hundred of them.
LEAST_SET = SIMILAR // (100 - SIMILAR) + 1
TREES, DEPTH, LEAST_DEPTH = 24, 8, 3
#: Depths at which regions are searched.
DEPTHS = (LEAST_DEPTH, 5, DEPTH)
#: A region with more members outside its largest component is searched deeper.
CROWD = 256
#: Minima that a set and a first partner share in common prefixes, summed over the trees; at the threshold of similarity it is some 90.
LEAST_WEIGHT = 36
#: Members of a side that one group compares.
BLOCK = 512
#: Bits of the map that preselects the documents whose sets are made again.
DOC_BITS = 26
#: Rows of the arrays in which minima are taken.
_ROWS = 1024

_NODE = "doc_id long, text_hash long, n int, k1 long, k2 long, sig binary, sketch binary"
_ORDER = "tree int, sig binary, node long, n int, next long, next_n int, shared int, size int, part long, edge int"

_draw = np.random.default_rng(20_011)
_TIMES = _draw.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def minima(tokens: np.ndarray) -> bytes:
    """The signature: minima of TREES * DEPTH hashes of the tokens, big-endian, so that bytes sort as numbers do."""
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _ROWS):
        h = x[at : at + _ROWS, None] ^ _FLIP
        h *= _TIMES
        np.minimum(least, h.min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def _key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    k = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (k >> 64) - (1 << 63), (k & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _signed(docs: DataFrame) -> DataFrame:
    """A row per document with its set's size and key; signature and sketch where the task meets a set for the first time."""

    def rows(batches):
        seen = set()
        for batch in slices(batches):
            out = {"n": [], "k1": [], "k2": [], "sig": [], "sketch": []}
            for text in batch.column(1).to_pylist():
                tokens = word_shingles(text, WORDS)
                key = _key(tokens) if len(tokens) else (0, 0)
                new = len(tokens) >= LEAST_SET and key not in seen
                if new:
                    seen.add(key)
                for name, value in zip(out, (len(tokens), *key, minima(tokens) if new else None, parity_sketch(tokens) if new else None), strict=True):
                    out[name].append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(2)} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, _NODE)


def _neighbours(batches):
    """Of rows (tree, sig, node, n, part) in order: those that share LEAST_DEPTH minima with a neighbour, and the first and last of the partition."""
    held, before, first = None, 0, True

    def out(rows, shared, ahead, edge):
        tree, sig, node, n, part = rows
        keep = (np.maximum(shared, ahead) >= LEAST_DEPTH) | (edge > 0)
        after = np.concatenate([ahead[:-1] >= LEAST_DEPTH, [False]])
        follow, follow_n = np.roll(node, -1), np.roll(n, -1)
        at = np.flatnonzero(keep)
        # Members of the same region that lie in this batch.
        run = np.cumsum(shared < LEAST_DEPTH)
        size = np.bincount(run)[run]
        return pa.RecordBatch.from_pydict({
            "tree": pa.array(tree[at], pa.int32()), "sig": pa.array([sig[i] for i in at], pa.binary()), "node": pa.array(node[at]), "n": pa.array(n[at], pa.int32()),
            "next": pa.array(follow[at], pa.int64(), mask=~after[at]), "next_n": pa.array(follow_n[at], pa.int32(), mask=~after[at]),
            "shared": pa.array(ahead[at], pa.int32()), "size": pa.array(size[at], pa.int32()), "part": pa.array(part[at]), "edge": pa.array(edge[at], pa.int32()),
        })

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(0).to_numpy(), batch.column(1).to_pylist(), *(batch.column(c).to_numpy() for c in (2, 3, 4))]
        if held is not None:
            rows = [h + r if isinstance(r, list) else np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        flat = np.frombuffer(b"".join(rows[1]), ">u4").reshape(len(rows[1]), -1)
        ahead = np.cumprod(flat[1:] == flat[:-1], axis=1).sum(axis=1) * (rows[0][1:] == rows[0][:-1])
        # The last row waits for its successor in the next batch.
        shared, edge = np.concatenate([[before], ahead[:-1]]), np.zeros(len(ahead), np.int64)
        if len(ahead):
            edge[0] = int(first)
            made = out([r[:-1] for r in rows], shared, ahead, edge)
            # out() knows the successor of all rows but the last, which is the one that waits.
            if ahead[-1] >= LEAST_DEPTH:
                made = made.set_column(4, "next", pa.array([*made.column(4).to_pylist()[:-1], int(rows[2][-1])], pa.int64()))
                made = made.set_column(5, "next_n", pa.array([*made.column(5).to_pylist()[:-1], int(rows[3][-1])], pa.int32()))
            yield made
            first, before = False, int(ahead[-1])
        held = [r[-1:] for r in rows]
    if held is not None:
        yield out(held, np.array([before]), np.array([0]), np.array([2 + first]))


def _orders(nodes: DataFrame) -> DataFrame:
    """Every tree's sorted order, without those that share no region: _ORDER."""
    each = nodes.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    each = each.select("tree", F.substring("sig", 4 * DEPTH * F.col("tree") + 1, F.lit(4 * DEPTH)).alias("sig"), "node", "n")
    order = ["tree", "sig", "node"]
    each = each.repartitionByRange(shuffle_parts(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return each.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_neighbours, _ORDER)


def _sizes_fit(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {SIMILAR} * greatest({a}, {b})"


def _region(depth: int) -> Column:
    return F.xxhash64("tree", F.substring("sig", 1, 4 * depth))


def _partners(shared: DataFrame) -> DataFrame:
    """(a, b) with a < b: each set with the neighbour in the orders and the hub of its regions whose prefixes agree most with its own."""
    # Where one partition ends and the next begins: two rows for each, so the window is over few.
    ends = shared.where("edge > 0").select("part", "tree", "sig", "node", "n", F.explode(F.filter(F.array(F.when(F.col("edge") != 2, 0), F.when(F.col("edge") >= 2, 1)), lambda e: e.isNotNull())).alias("end"))
    follow = F.lead(F.struct("tree", "sig", "node", "n", "end")).over(Window.orderBy("part", "end"))
    over = ends.withColumn("f", follow).where((F.col("end") == 1) & (F.col("f.end") == 0) & (F.col("f.tree") == F.col("tree")))
    over = over.withColumn("f_region", F.substring("f.sig", 1, 4 * LEAST_DEPTH)).where(F.col("f_region") == F.substring("sig", 1, 4 * LEAST_DEPTH)).select("node", "n", F.col("f.node").alias("next"), F.col("f.n").alias("next_n"), F.lit(LEAST_DEPTH).alias("shared"))
    beside = shared.where("next is not null").select("node", "n", "next", "next_n", "shared").unionByName(over).where(_sizes_fit("n", "next_n"))
    both = beside.select(F.col("node").alias("a"), F.col("next").alias("b"), "shared").unionByName(beside.select(F.col("next").alias("a"), F.col("node").alias("b"), "shared"))

    scores = stored(shared.groupBy("node").agg(F.sum(F.log2(F.col("size") + F.lit(1))).alias("score")), "scores")
    # Sizes are classed twice, half a class apart, so that like sizes share a class.
    like = F.explode(F.array(*(F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / SIMILAR)) + x).cast("int") * 2 + F.lit(int(2 * x)) for x in (0.0, 0.5))))
    rated = stored(shared.join(scores, "node").select(_region(LEAST_DEPTH).alias("region"), like.alias("like"), "node", "n", "score"), "rated")
    # Stored tables on both sides, so that a large region may be split.
    best = stored(rated.groupBy("region", "like").agg(F.max(F.struct("score", "n", "node")).alias("hub")), "hubs")
    hubs = rated.join(best, ["region", "like"]).where("hub.node <> node").where(_sizes_fit("n", "hub.n")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.lit(LEAST_DEPTH).alias("shared"), F.lit(True).alias("is_hub"))
    weighed = both.withColumn("is_hub", F.lit(False)).unionByName(hubs).groupBy("a", "is_hub", "b").agg(F.sum("shared").alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    # Of each kind the best, which is all that a node keeps.
    best = lambda kind: F.max(F.when(F.col("is_hub") == kind, F.struct("weight", "b"))).getField("b")
    chosen = weighed.groupBy("a").agg(best(True).alias("hub"), best(False).alias("beside"))
    chosen = chosen.select("a", F.explode(F.array_compact(F.array_distinct(F.array("hub", "beside")))).alias("b"))
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sets, made anew from the texts, are similar enough."""
    pairs = stored(pairs, "pairs")
    wanted = stored(nodes.select("node", "doc_id", "k1", "k2").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), "node", "left_semi"), "wanted")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "doc_id", DOC_BITS))

    def sets(batches):
        for batch in slices(batches):
            # Nulls are filled first, as an array with nulls comes as floats. Rows without an id are always looked at.
            ids = batch.column(0)
            keep = has_bit(sent.value, DOC_BITS, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            made = [x for t in batch.column(1).filter(pa.array(keep)).to_pylist() if len(x := word_shingles(t, WORDS)) >= LEAST_SET]
            keys = [_key(x) for x in made]
            yield pa.RecordBatch.from_pydict({"k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()), "tokens": pa.array([x.tobytes() for x in made], pa.binary())})

    def linked(batches):
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = common(x, y)
                keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    held = docs.select("doc_id", "text").mapInArrow(sets, "k1 long, k2 long, tokens binary").join(wanted.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "tokens").dropDuplicates(["node"])
    held = stored(held, "sets")
    a, b = (held.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(linked, "a long, b long"), "links")


def _search(members: DataFrame, regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within ``regions`` (region, main, n_main, n_others) whose sizes and sketches allow a link.

    Members outside the main component are compared with it and with each
    other, in blocks: they go to every block, the main ones to as many groups
    as the others have blocks. Only pairs that may link leave a group. Small
    regions are compared a few hundred at a time.
    """
    main_blocks, other_blocks = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int") for c in ("n_main", "n_others"))
    rows = members.join(regions, "region").select("region", "node", "n", "root", (F.col("root") == F.col("main")).alias("is_main"), main_blocks.alias("mains"), other_blocks.alias("others"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)

    def group(i: Column, j: Column, across: bool) -> Column:
        return F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))

    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_main = F.when(F.col("is_main"), F.transform(upto("others"), lambda j: group(F.col("own"), j, True))).otherwise(F.transform(upto("mains"), lambda i: group(i, F.col("own"), True)))
    each_other = F.when(F.col("is_main"), F.array().cast("array<struct<across:boolean,i:int,j:int>>")).otherwise(F.transform(upto("others"), lambda k: group(F.least("own", k), F.greatest("own", k), False)))
    rows = rows.select("region", "node", "n", "root", "is_main", "own", F.explode(F.concat(with_main, each_other)).alias("g")).select("region", "node", "n", "root", "is_main", "own", "g.*")
    deal = F.pmod(F.xxhash64("region", "across", "i", "j"), F.lit(16 * shuffle_parts(nodes.sparkSession)))
    rows = rows.withColumn("deal", deal).join(nodes.select("node", "sketch"), "node")

    def compare(table):
        table = table.sort_by([("region", "ascending"), ("across", "ascending"), ("i", "ascending"), ("j", "ascending")])
        region, node, n, root, main, own, across, i, j = (table.column(c).to_numpy() for c in ("region", "node", "n", "root", "is_main", "own", "across", "i", "j"))
        n, sketches, found = n.astype(np.int64), table.column("sketch").to_pylist(), [np.zeros((2, 0), np.int64)]
        new = np.concatenate([[True], (region[1:] != region[:-1]) | (across[1:] != across[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        starts = np.flatnonzero(new)
        for start, end in zip(starts, np.concatenate([starts[1:], [len(n)]]), strict=True):
            at = np.arange(start, end)
            if across[start]:
                left, right = at[~main[at]], at[main[at]]
            else:
                left, right = at[own[at] == i[start]], at[own[at] == j[start]]
            if not len(left) or not len(right):
                continue
            # Sets that may link have sketches of one length, or of two neighbouring ones, where the longer is folded.
            length = np.array([len(sketches[k]) for k in right])
            theirs = {}
            for size in np.unique(length):
                own_size = right[length == size]
                flags = np.frombuffer(b"".join(sketches[k] for k in own_size), np.uint8).reshape(len(own_size), size)
                theirs[int(size)] = (own_size, flags, flags[:, : size // 2] ^ flags[:, size // 2 :])
            for k in left:
                mine = np.frombuffer(sketches[k], np.uint8)
                for size, (own_size, flags, folded) in theirs.items():
                    if size not in (len(mine) // 2, len(mine), 2 * len(mine)):
                        continue
                    fits = np.flatnonzero((100 * np.minimum(n[own_size], n[k]) >= SIMILAR * np.maximum(n[own_size], n[k])) & (root[own_size] != root[k]))
                    if len(fits):
                        x, against = (mine, flags) if size == len(mine) else (mine, folded) if size > len(mine) else (mine[:size] ^ mine[size:], flags)
                        apart = np.bitwise_count(against[fits] ^ x).sum(axis=1, dtype=np.int64)
                        y = own_size[fits[(100 + SIMILAR) * apart <= (100 - SIMILAR) * (n[own_size[fits]] + n[k])]]
                        found.append(np.stack([np.full(len(y), k), y]))
        x, y = np.concatenate(found, axis=1)
        # Two sets may share regions of several trees.
        pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
        return pa.Table.from_pydict({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return rows.groupBy("deal").applyInArrow(compare, "a long, b long").distinct()


def _apart(shared: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different components that share a region, searched at the depth at which the region is no longer crowded."""
    left = stored(shared.join(roots.withColumnRenamed("node", "key"), F.col("node") == F.col("key"), "left").select("tree", "sig", "node", "n", F.coalesce("root", "node").alias("root")), "placed")
    found = None
    for depth in DEPTHS:
        members = left.withColumn("region", _region(depth))
        counts = stored(members.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n")), "counts")
        regions = counts.groupBy("region").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        regions = stored(regions.select("region", F.col("most.root").alias("main"), F.col("most.n").alias("n_main"), (F.col("size") - F.col("most.n")).alias("n_others")), "regions")
        here = regions if depth == DEPTH else regions.where(F.col("n_others") <= CROWD)
        pairs = _search(members.select("region", "node", "n", "root"), here, nodes)
        found = stored(pairs if found is None else found.unionByName(pairs), "near")
        deeper = regions.where(F.col("n_others") > CROWD).select("region")
        if depth == DEPTH or not deeper.limit(1).count():
            return found.distinct()
        left = stored(members.join(deeper, "region", "left_semi").drop("region"), "placed")


def _components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id."""
    docs = corpus(docs)
    rows = stored(_signed(docs), "rows")
    sets = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.max("sig").alias("sig"), F.max("sketch").alias("sketch"))
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = sets.where("sig is not null")
    shared = stored(_orders(nodes), "orders")
    links = _confirmed(docs, _partners(shared), nodes)
    # Rows at the ends of a partition may share no region at all; they do no harm.
    roots = stored(components(links), "roots")
    more = _confirmed(docs, _apart(shared, roots, nodes), nodes)
    # What is found now joins whole components: only their roots are looked at again.
    by = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    more = more.join(by[0], "a", "left").join(by[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = stored(components(more), "joined").select(F.col("node").alias("root"), F.col("root").alias("top"))

    last = sets.select("k1", "k2", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(joined, "root", "left")
    # Every set is of the component of its root, or is one by itself; stored, so that joins may be split.
    placed = stored(last.select("k1", "k2", "doc_id", F.coalesce("top", "root").alias("root")), "placed")
    heads = stored(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "heads")
    named = stored(placed.join(heads, "root").select("k1", "k2", "component_id"), "named")
    out = rows.select("doc_id", "text_hash", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links; the row that has
    it for its own stays. Null and empty texts have no shingles, link with
    nothing and stay; rows with equal sets are linked, so of repeated rows
    each is kept if one is; a null doc_id never names a component unless all
    its members lack one. An empty table gives an empty result; other columns
    are not read.
    """
    found = _components(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i+{WORDS - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILAR} * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, documents.doc_id = min(r.b) AS kept
FROM documents JOIN r ON r.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
