"""N-gram Jaccard join: prefixes of rarest shingles first, with shingle pairs where shingles are common.

Two sets link when their Jaccard similarity is 0.8 or more. Under one global
order of all shingles, two linked sets share at least K shingles among the
first ``n - ceil(0.8 n) + K`` of each. If the posting list of one of those is
short, the two meet there. Else K shingles with long lists are shared; dealt
into CLASSES = K - 1 classes by their hash, two of them fall in one class, so
the sets meet in the list of that pair of shingles. Small sets, which may
share fewer than K, take all pairs of a prefix for which K is 2. The order
puts shingles that many documents hold last.

Sets equal in all shingles are one node throughout. Each posting list first
proposes only its members against one member of like size, the one with most
of its prefix in other documents too, as the origin of edited copies has; so
thousands of near copies cost as many comparisons as there are copies. What
these links leave in different components is then compared within the lists,
which makes the components exact. Every link lies in one component, so the
links of a set are counted by comparing each component's sets with each other
in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import bitmap, components, corpus, has_bit, shuffle_parts, slices, stored
from runlens.llm.shingles import common, fewest_apart, parity_sketch, set_key, word_shingles

#: Classes of long-listed shingles within which pairs are formed.
CLASSES = 8
#: Shingles that two linked sets share in their extended prefixes at least, if they have SMALL shingles or more.
K = CLASSES + 1
SMALL = 11
#: A shingle in so many rows counts as common and comes late in the order.
COMMON_ROWS = 24
#: Bits of the map of common shingles; the threshold doubles until no more than a sixteenth of them are set.
COMMON_BITS = 25
#: Bits of the map that preselects shingles that several prefixes have.
SHARED_BITS = 26
#: Bits of the map that preselects the documents whose sets are to be compared.
DOC_BITS = 24
#: Members of a posting list up to which single shingles are used.
SHORT_LIST = 32
#: Members of a long list that one task compares with as many others.
BLOCK = 512
#: Members, and their shingles, of a component that one task compares with as many others to count links.
COUNT_BLOCK = 1024
COUNT_SHINGLES = 1 << 22
#: Shingles that the count of common ones takes at once.
COLUMNS = 2048

_NODE = "doc_id long, text_hash long, n int, key long, sketch binary, prefix array<long>"


def _texts(batch):
    ids = batch.column(0).to_pylist()
    texts = batch.column(1).to_pylist()
    return zip(ids, texts, strict=True)


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the shingles in COMMON_ROWS rows or more, and how far a shingle is shifted to its place in it.

    Every shingle of every row is counted: tasks send packed 32-bit
    remainders, dealt by the leading bits, and each range is counted by itself.
    A shingle that several rows of a slice hold is sent once with its count, so
    one that a third of all rows hold is a small part of its range.
    """
    lead = max(6, (4 * shuffle_parts(docs.sparkSession) - 1).bit_length())
    shift = 64 - lead - 32

    def spread(batches):
        for batch in slices(batches, 2000):
            sets = [word_shingles(t) for _, t in _texts(batch)]
            if not sets:
                continue
            all_ = np.sort(np.concatenate(sets) >> np.uint64(shift))
            first = np.flatnonzero(np.concatenate([all_[:1] == all_[:1], all_[1:] != all_[:-1]]))
            times = np.diff(np.concatenate([first, [len(all_)]]))
            parts = []
            for chosen in (times == 1, times > 1):
                held = all_[first[chosen]]
                ends = np.searchsorted(held, (np.arange(1, (1 << lead) + 1, dtype=np.uint64)) << np.uint64(32))
                parts.append((held.astype(np.uint32), times[chosen].astype(np.uint32), np.concatenate([[0], ends[:-1]]), ends))
            (once, _, s1, e1), (more, n, s2, e2) = parts
            used = np.flatnonzero((e1 > s1) | (e2 > s2))
            out = {"range": pa.array(used, pa.int32()), "once": pa.array([once[s1[i] : e1[i]].tobytes() for i in used], pa.binary())}
            yield pa.RecordBatch.from_pydict(out | {k: pa.array([x[s2[i] : e2[i]].tobytes() for i in used], pa.binary()) for k, x in (("more", more), ("times", n))})

    def count(key, group):
        def held(name):
            return np.concatenate([np.frombuffer(x, np.uint32) for x in group.column(name).to_pylist()])

        low = np.sort(held("once"))
        first = np.flatnonzero(np.concatenate([low[:1] == low[:1], low[1:] != low[:-1]]))
        values, rows = low[first], np.diff(np.concatenate([first, [len(low)]]))
        more, at = np.unique(held("more"), return_inverse=True)
        n = np.bincount(at, weights=held("times"), minlength=len(more)).astype(np.int64)
        # Those sent both ways count together.
        n[np.isin(more, values)] += rows[np.isin(values, more)]
        alone = ~np.isin(values, more)
        values, rows = np.concatenate([values[alone], more]), np.concatenate([rows[alone], n])
        often = rows >= COMMON_ROWS
        v = values[often].astype(np.int64) + (int(key[0].as_py()) << 32)
        return pa.Table.from_pydict({"v": pa.array(v, pa.int64()), "n_rows": pa.array(rows[often], pa.int64())})

    found = docs.mapInArrow(spread, "range int, once binary, more binary, times binary").groupBy("range").applyInArrow(count, "v long, n_rows long")
    found = stored(found, "common")
    scale = found.groupBy(F.floor(F.log2(F.col("n_rows") / COMMON_ROWS)).cast("int").alias("times")).count().orderBy(F.desc("times")).collect()
    total, least = 0, None
    for row in scale:
        total += row["count"]
        if total > 1 << (COMMON_BITS - 4):
            break
        least = COMMON_ROWS << row["times"]
    flags = bitmap(found.where(F.col("n_rows") >= least), "v", COMMON_BITS) if least else np.zeros(1 << (COMMON_BITS - 3), np.uint8)
    return flags, shift


def _nodes(docs: DataFrame, flags: np.ndarray, shift: int) -> DataFrame:
    """A row per document with its set's size, key, sketch and extended prefix (empty where the task met an equal set before)."""
    sent = docs.sparkSession.sparkContext.broadcast(flags)

    def rows(batches):
        seen = set()
        for batch in slices(batches):
            out = {"doc_id": batch.column(0), "text_hash": batch.column(2), "n": [], "key": [], "sketch": [], "prefix": []}
            for _, text in _texts(batch):
                tokens = word_shingles(text)
                n, key = len(tokens), set_key(tokens) if len(tokens) else 0
                new = n > 1 and (key, n) not in seen
                out["n"].append(n)
                out["key"].append(key)
                out["sketch"].append(parity_sketch(tokens) if new else None)
                if new:
                    seen.add((key, n))
                    often = has_bit(sent.value, COMMON_BITS, tokens >> np.uint64(shift))
                    ordered = np.concatenate([tokens[~often], tokens[often]])
                    out["prefix"].append(ordered[: n - -(-4 * n // 5) + (K if n >= SMALL else 2)].view(np.int64))
                else:
                    out["prefix"].append([])
            yield pa.RecordBatch.from_pydict(out | {"n": pa.array(out["n"], pa.int32()), "key": pa.array(out["key"], pa.int64()), "sketch": pa.array(out["sketch"], pa.binary()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, _NODE)


def _near_sizes(a: str, b: str) -> str:
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, an, b, bn) whose sketches allow a link; no link is lost."""

    def allowed(batches):
        for batch in batches:
            an, bn = (batch.column(c).to_numpy() for c in ("an", "bn"))
            apart = np.array([fewest_apart(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "an", "b", "bn"]).filter(pa.array(9 * apart <= an.astype(np.int64) + bn))

    both = pairs.join(sketches.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("sa")), ["a", "an"]).join(sketches.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("sb")), ["b", "bn"])
    return both.select("a", "an", "b", "bn", "sa", "sb").mapInArrow(allowed, "a long, an int, b long, bn int")


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs whose sets, made anew from the texts, have a Jaccard similarity of 0.8 or more; and those sets."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    chosen = bitmap(nodes.join(wanted, "key", "left_semi").select("doc_id"), "doc_id", DOC_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def sets(batches):
        for batch in slices(batches):
            # Nulls are filled first, as an array with nulls comes as floats. Rows without an id are always looked at.
            ids = batch.column(0)
            keep = has_bit(sent.value, DOC_BITS, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            made = [x for t in batch.column(1).filter(pa.array(keep)).to_pylist() if len(x := word_shingles(t)) > 1]
            yield pa.RecordBatch.from_pydict({"key": pa.array([set_key(x) for x in made], pa.int64()), "tokens": pa.array([x.tobytes() for x in made], pa.binary())})

    def linked(batches):
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = common(x, y)
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = docs.mapInArrow(sets, "key long, tokens binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    held = stored(held, "sets")
    both = pairs.select("a", "b").join(held.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a").join(held.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(linked, "a long, b long"), "links"), held


def _linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Which of the sets x link with which of y, as a matrix of flags."""
    sizes = np.array([len(s) for s in (*x, *y)])
    _, column, rows = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    met = rows[column] > 1
    row, column = row[met], (np.cumsum(rows > 1) - 1)[column[met]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(x), len(y)), np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, n_columns, COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        held = np.zeros((len(sizes), min(COLUMNS, n_columns - at)), np.float32)
        held[row[part], column[part] - at] = 1
        both += held[: len(x)] @ held[len(x) :].T
    return 100 * both >= 80 * (sizes[: len(x), None] + sizes[None, len(x) :] - both)


def _degrees(roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, count): the links of each set that links with another.

    Every pair of sets of one component is compared once. Small components
    share a group; a large one is cut into blocks and every two blocks are
    compared in a group of their own. Only counts leave a group.
    """
    members = stored(roots.select(F.col("node").alias("key"), "root").join(sets.dropDuplicates(["key"]), "key"), "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK), F.ceil(F.sum(F.length("tokens") / 8) / COUNT_SHINGLES)).cast("int").alias("blocks"))
    rows = members.join(stored(sizes, "sizes"), "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    deals = max(shuffle_parts(roots.sparkSession), members.count() // COUNT_BLOCK)
    alone = F.col("blocks") > 1
    rows = rows.select(alone.alias("alone"), F.when(alone, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(deals))).alias("deal"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "key", "tokens")

    def compare(group):
        group = group.sort_by("root")
        root, key, own, i, j = (group.column(c).to_numpy() for c in ("root", "key", "own", "i", "j"))
        tokens = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        count = np.zeros(len(key), np.int64)
        ends = np.flatnonzero(np.concatenate([root[1:] != root[:-1], [True]])) + 1
        for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            x = np.arange(start, end)
            if i[start] == j[start]:
                # Every set is found to link with itself.
                count[x] = _linked([tokens[k] for k in x], [tokens[k] for k in x]).sum(axis=1) - 1
            else:
                x, y = x[own[x] == i[start]], x[own[x] == j[start]]
                if len(x) and len(y):
                    yes = _linked([tokens[k] for k in x], [tokens[k] for k in y])
                    count[x], count[y] = yes.sum(axis=1), yes.sum(axis=0)
        return pa.Table.from_pydict({"key": pa.array(key), "n": pa.array(count)})

    return rows.groupBy("alone", "deal", "i", "j").applyInArrow(compare, "key long, n long").groupBy("key").agg(F.sum("n").alias("count"))


def _across(lists: DataFrame, by: str) -> DataFrame:
    """Rows of those posting lists that hold more than one component, with the list's length.

    An aggregation and a join of stored tables: neither brings a long list into one task.
    """
    lists = stored(lists, "lists")
    ends = lists.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    return lists.join(stored(ends.where("low < high").select(by, "size"), "ends"), by)


def _shared(rows: DataFrame) -> DataFrame:
    """(token, key, n, pos): the entries of prefixes whose shingle more than one set has in its prefix."""
    entries = rows.where("n > 1").select("key", F.explode("prefix").alias("token"))
    met = stored(entries.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token"), "met")
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(met, "token", SHARED_BITS))

    def kept(batches):
        for batch in batches:
            prefix = batch.column(2)
            size = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten().to_numpy()
            yes = has_bit(sent.value, SHARED_BITS, tokens)
            row = np.repeat(np.arange(len(size)), size)[yes]
            pos = (np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size))[yes]
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[yes]), "key": batch.column(0).take(pa.array(row)), "n": batch.column(1).take(pa.array(row)), "pos": pa.array(pos, pa.int32())})

    near = rows.where("n > 1").select("key", "n", "prefix").mapInArrow(kept, "token long, key long, n int, pos int")
    return near.groupBy("token", "key", "n").agg(F.min("pos").alias("pos")).join(met, "token", "left_semi")


def _pairwise(lists: DataFrame) -> DataFrame:
    """Pairs within a short list whose components differ and whose sizes allow a link."""
    a = lists.select("token", F.col("key").alias("a"), F.col("n").alias("an"), F.col("root").alias("ra"))
    b = lists.select("token", F.col("key").alias("b"), F.col("n").alias("bn"), F.col("root").alias("rb"))
    return a.join(b, "token").where("a < b and ra <> rb").where(_near_sizes("an", "bn")).select("a", "an", "b", "bn").distinct()


def _shingle_pairs(lists: DataFrame) -> DataFrame:
    """(key, n, root, two) of the members of long lists: pairs within a class, for small sets also all of a shorter prefix."""
    held = lists.groupBy("key", "n", "root").agg(F.array_sort(F.collect_list(F.struct((F.pmod(F.shiftrightunsigned("token", 8), F.lit(CLASSES))).alias("class"), "token", "pos"))).alias("t"))
    first = held.select("key", "n", "root", F.posexplode("t").alias("i", "first"), "t")
    both = first.select("key", "n", "root", "first", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("second"))
    short = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 2
    in_class = both.where((F.col("n") >= SMALL) & (F.col("first.class") == F.col("second.class"))).select("key", "n", "root", F.xxhash64(F.lit(1), "first.token", "second.token").alias("two"))
    small = both.where((F.col("n") <= SMALL * 5 // 4) & (F.greatest("first.pos", "second.pos") < short))
    small = small.select("key", "n", "root", F.xxhash64(F.lit(2), F.least("first.token", "second.token"), F.greatest("first.token", "second.token")).alias("two"))
    return in_class.unionByName(small)


def _within(lists: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs within long lists whose components differ and whose sizes and sketches allow a link.

    A list is cut into blocks and every two blocks are compared in a group of
    their own; only the pairs that may link leave it.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    rows = lists.withColumn("blocks", blocks).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("two", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "root").join(sketches, ["key", "n"])

    def compare(group):
        key, n, root, own, i, j = (group.column(c).to_numpy() for c in ("key", "n", "root", "own", "i", "j"))
        n = n.astype(np.int64)
        raw = group.column("sketch").to_pylist()
        size = min(map(len, raw))
        flags = np.empty((len(raw), size), np.uint8)
        for at, x in enumerate(raw):
            x = np.frombuffer(x, np.uint8)
            while len(x) > size:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            flags[at] = x
        values, counts = np.unique(root, return_counts=True)
        most = values[np.argmax(counts)]
        found = []
        for x in np.flatnonzero(root != most):
            y = (root != root[x]) & (5 * np.minimum(n, n[x]) >= 4 * np.maximum(n, n[x]))
            if i[x] != j[x]:
                y &= own != own[x]
            y = np.flatnonzero(y)
            y = y[9 * np.bitwise_count(flags[y] ^ flags[x]).sum(axis=1, dtype=np.int64) <= n[y] + n[x]]
            found.append(np.stack([np.full(len(y), x), y]))
        x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
        return pa.Table.from_pydict({"a": pa.array(key[x]), "an": pa.array(n[x], pa.int32()), "b": pa.array(key[y]), "bn": pa.array(n[y], pa.int32())})

    return rows.groupBy("two", "i", "j").applyInArrow(compare, "a long, an int, b long, bn int").distinct()


def _components(docs: DataFrame, count: bool) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id and, if ``count``, n_links."""
    docs = corpus(docs)
    flags, shift = _common_shingles(docs)
    rows = stored(_nodes(docs, flags, shift), "nodes")
    nodes = stored(rows.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("doc_id")), "sets")
    # Stored, so that joins with them may be split where very many pairs share a member.
    sketches = stored(rows.where("sketch is not null").select("key", "n", "sketch").dropDuplicates(["key", "n"]), "sketches")

    shared = stored(_shared(rows), "shared")

    # Stars: members of a list against the one of like size that has most of its prefix in common with others.
    common_part = shared.groupBy("key", "n").agg((100 * F.count(F.lit(1)) / (F.col("n") - F.ceil(F.col("n") * 4 / 5) + K)).cast("int").alias("part"))
    rated = stored(shared.join(common_part, ["key", "n"]), "rated")
    stars = []
    for shift_by in (0.0, 0.5):
        like = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + shift_by).cast("int")
        star = rated.withColumn("like", like)
        star = star.join(stored(star.groupBy("token", "like").agg(F.max(F.struct("part", "n", "key")).alias("hub")), "hubs"), ["token", "like"])
        stars.append(star.where("hub.key <> key").select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("hub.key").alias("b"), F.col("hub.n").alias("bn")).where(_near_sizes("an", "bn")))
    links, sets = _links(docs, _close(stars[0].unionByName(stars[1]).distinct(), sketches), nodes)
    roots = stored(components(links), "roots")

    # What is still apart: short lists by single shingles, long ones by pairs of shingles.
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = stored(_across(placed, "token"), "apart")
    short = _close(_pairwise(apart.where(F.col("size") <= SHORT_LIST)), sketches)
    long = _within(_across(_shingle_pairs(apart.where(F.col("size") > SHORT_LIST)), "two"), sketches)
    more, others = _links(docs, short.unionByName(long).distinct(), nodes)

    roots = stored(components(links.unionByName(more)), "roots")
    placed = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Stored, so that the join below may be split where very many sets have one root.
    heads = stored(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "heads")
    named = placed.join(heads, "root")
    if count:
        named = named.join(_degrees(roots, sets.unionByName(others)), "key", "left").withColumn("n_links", F.coalesce("count", F.lit(0)))
    named = stored(named.select("key", "n", "component_id", *["n_links"] * count), "named")
    out = rows.select("doc_id", "text_hash", "n", "key").join(named, ["key", "n"], "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * count)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable over links, n_links the
    number of other shingle sets that the row's set links with. Null and empty
    texts have no shingles and link with nothing; rows with equal sets are
    linked; a null doc_id never names a component unless all its members lack
    one. An empty table gives an empty result; other columns are not read.
    """
    return _components(docs, count=True).drop("text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that head their component, those without words included; all columns stay.

    Rows are told by id and text, as ids may repeat or be null.
    """
    found = _components(docs, count=False)
    # The list grows with the corpus: a merge join at every size.
    gone = stored(found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "text_hash").distinct(), "gone").hint("merge")
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (F.xxhash64(docs.text) == gone.text_hash), "left_anti").select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
d AS (SELECT a, count(*) AS n_links FROM (SELECT DISTINCT l.a, h.b FROM l JOIN (SELECT doc_id, hash(list(g ORDER BY g)) AS b FROM s GROUP BY doc_id) h ON h.doc_id = l.b JOIN (SELECT doc_id, hash(list(g ORDER BY g)) AS b FROM s GROUP BY doc_id) o ON o.doc_id = l.a WHERE h.b <> o.b) GROUP BY a)
SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, coalesce(any_value(d.n_links), 0) AS n_links
FROM documents JOIN r ON r.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN d ON d.a = documents.doc_id GROUP BY documents.doc_id
"""
