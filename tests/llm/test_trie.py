import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import pytest

from runlens.llm import prefix_trie
from runlens.llm.prefix_trie import BORROWED, FAMILY, RadixTree


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % BORROWED
        whole[c] = tuple(own.get(c - int(math.fmod(c, FAMILY)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in ids if whole[c] == p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), sum(len(q) == len(p) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted(df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect(), key=str)


@pytest.fixture(scope="module")
def talk():
    """Prefixes that many share, a conversation of which there are many copies, nulls, repeated rows and no family head."""
    r = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(207, 230), -3, 1000]:
        same = c % 3 == 0
        for turn in range(5 if same else r.randrange(1, 9)):
            rows.append((c, turn, "user" if turn % 2 else "system", "often said" if same else r.choice("ab") * r.randrange(3)))
    rows += [(50, None, None, None), (51, 2, "user", "x"), (51, 2, "user", "x"), (None, 1, "user", "lost"), (300, 0, None, ""), (1000, 99, "user", "😀é")]
    return rows


@pytest.mark.parametrize("tree_rows", [1, 4, 20_000])
def test_nodes_equal_brute_force_however_trees_are_cut(spark, talk, tree_rows):
    df = spark.createDataFrame([(*x, i, b"k", 1) for i, x in enumerate(talk)], "conv_id long, turn long, role string, text string, n int, id binary, part int").repartition(5)
    got = rows_of(prefix_trie.trie(prefix_trie.rebuilt(df), tree_rows))
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(talk)


def test_conversations_without_turns(spark):
    # A checksum of 1 or more takes the own turn away; the family has no head to lend another.
    rows = [(c, 0, "user", "x") for c in range(1, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert set(map(tuple, rows_of(prefix_trie.prefix_trie(df)))) == brute(rows)
    alone = [r for r in rows if crc32(str(r[0]).encode()) % BORROWED][:3]
    got = rows_of(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")), 1))
    assert set(map(tuple, got)) == brute(alone) and len(got) == 1
    assert rows_of(prefix_trie.prefix_trie(df.where("false"))) == []


def test_radix_tree_grows_through_all_layouts():
    r, tree, kept = random.Random(1), RadixTree(), {}
    kinds = set()
    for _ in range(6000):
        key = bytes(r.randrange(256) if r.random() < 0.5 else r.randrange(3) for _ in range(r.choice([0, 1, 2, 4, 8])))
        tree.entry(key).append(key)
        kept.setdefault(key, []).append(key)
    found, path = {}, []
    for step in tree.walk():
        if step is None:
            path.pop()
            continue
        path.append(step[0])
        if step[1] is not None:
            found[b"".join(path)] = step[1]
    assert found == kept and list(found) == sorted(kept)
    todo = [tree.root]
    while todo:
        node = todo.pop()
        kinds.add(type(node).__name__)
        todo += [child for _, child in node.children()]
    assert kinds == {"_Node4", "_Node16", "_Node48", "_Node256"}
