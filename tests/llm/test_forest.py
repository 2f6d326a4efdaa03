import random

import numpy as np
import pytest

from runlens.llm import minhash_forest
from runlens.llm.minhash_forest import DEPTH, SIMILAR, TREES, WORDS, minima
from runlens.llm.shingles import word_shingles


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text), by comparing all pairs."""
    def words(text):
        return bytes(text or "", "utf-8").lower().split()

    sets = [frozenset(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and top(i) != top(j) and 100 * len(a & b) >= SIMILAR * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and (top(i) not in least or doc < least[top(i)]):
            least[top(i)] = doc
    out = []
    for i, (doc, _) in enumerate(rows):
        head = least.get(top(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), head, doc == head))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, minhash_forest.near_duplicates(df).collect()), key=str)


@pytest.fixture(scope="module")
def copies():
    """A large group of edited copies, chains of edits at the threshold, small sets, and many short texts of one phrase."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []

    def put(words):
        rows.append((len(rows) * 7 % 1009 + 1009 * (len(rows) // 1009), " ".join(words)))

    origin = r.choices(vocabulary, k=120)
    for _ in range(90):
        words = list(origin)
        for at in r.sample(range(120), r.randrange(6)):
            words[at] = r.choice(vocabulary)
        put(words)
    for _ in range(12):
        words = r.choices(vocabulary, k=r.choice([8, 9, 20, 60, 300]))
        for _ in range(8):
            put(words)
            words = list(words)
            words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.4:
                words.append(r.choice(vocabulary))
    phrase = r.choices(vocabulary, k=40)
    for _ in range(60):
        put(phrase + r.choices(vocabulary, k=r.choice([6, 7, 8, 40])))
    return rows


def test_components_equal_brute_force(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(7)
    assert found(df) == brute(copies)


def test_crowded_regions_are_searched_deeper(spark, copies, monkeypatch):
    monkeypatch.setattr(minhash_forest, "CROWD", 2)
    monkeypatch.setattr(minhash_forest, "BLOCK", 16)
    df = spark.createDataFrame(copies[:150], "doc_id long, text string")
    assert found(df) == brute(copies[:150])


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert minhash_forest.near_duplicates(nothing).collect() == []


def test_minima_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(4)
    words = [f"t{i}" for i in r.integers(0, 10_000, 3000)]
    changed = [w if r.random() > 0.02 else f"u{i}" for i, w in enumerate(words)]
    a, b = (word_shingles(" ".join(w), WORDS) for w in (words, changed))
    similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = (np.frombuffer(minima(a), ">u4") == np.frombuffer(minima(b), ">u4")).mean()
    assert abs(agree - similar) < 0.1 and len(minima(a)) == 4 * TREES * DEPTH
