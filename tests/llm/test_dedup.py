import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import exact_dedup, jaccard_join, line_dedup
from runlens.llm.common import components
from runlens.llm.shingles import common, fewest_apart, parity_sketch, word_shingles

from .conftest import ODD


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_exact_dedup_on_odd_rows(odd):
    out = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[digest(t)].append(i)
    expected = Counter((i, min((x for x in groups[digest(t)] if x is not None), default=None), len(groups[digest(t)]), digest(t)) for i, t in ODD)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == expected
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_dedup_many_runs(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(150)
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    assert len(out) == 500 and {out[i].keep_id for i in range(0, 500, 3)} == {0}
    assert sum(r.kept for r in out.values()) == len({t for _, t in rows})


def test_kept_rows_have_their_columns(odd, nothing):
    out = exact_dedup.keep_first(odd)
    assert out.columns == odd.columns and out.count() == len({digest(t) for _, t in ODD})
    assert exact_dedup.exact_dedup(nothing).count() == exact_dedup.keep_first(nothing).count() == 0


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    heads = defaultdict(list)
    for a in range(len(rows)):
        heads[find(a)].append(rows[a][0])
    return Counter((rows[a][0], len(sets[a][1]), min((x for x in heads[find(a)] if x is not None), default=None)) for a in range(len(rows)))


def test_jaccard_on_odd_rows(odd, nothing):
    out = jaccard_join.jaccard_components(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(ODD)
    assert jaccard_join.jaccard_components(nothing).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and {4, 5, 9, 11} <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("short_list", [2, 32])
def test_jaccard_against_brute_force(spark, monkeypatch, short_list):
    """Edited copies, a passage that most texts share, and small sets; long lists from three members on in one case."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard_join, "COMMON_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(3000)}"
    passage, rows = [word() for _ in range(40)], []
    for i in range(160):
        if i % 4 == 0:
            text = [word() for _ in range(int(rng.integers(5, 60)))] + passage
        elif i % 4 == 1 and rows:
            text = rows[int(rng.integers(len(rows)))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = word()
        elif i % 4 == 2:
            text = ["s", "t", "u", "v", "x", "y", "z"][: int(rng.integers(1, 8))] + [word() for _ in range(int(rng.integers(0, 3)))]
        else:
            text = list(passage)
            for at in rng.choice(40, int(rng.integers(0, 3)), replace=False):
                text[at] = word()
        rows.append((1000 - i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = jaccard_join.jaccard_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows)


def test_jaccard_rows_without_an_id_and_repeated_ids(spark):
    """A near copy that only rows without an id hold, an id beyond what floats tell, and a clean text with a near copy's id."""
    text = [f"w{i}" for i in range(80)]
    edited = lambda at: " ".join([*text[:at], "other", *text[at + 1 :]])
    clean, big = "quite another text with words of its own", (1 << 53) + 1
    rows = [(5, " ".join(text)), (None, edited(20)), (big, edited(60)), (9, edited(40)), (9, clean), (None, "no copy of any other text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = jaccard_join.jaccard_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows)
    assert Counter(map(tuple, jaccard_join.keep_one(df).collect())) == Counter([rows[0], rows[4], rows[5]])


@pytest.mark.parametrize("block", [8, 1024])
def test_jaccard_counts_all_links(spark, monkeypatch, block):
    """Dozens of near copies, whose links are far more than those to one of them, and components of two."""
    monkeypatch.setattr(jaccard_join, "COUNT_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rng = np.random.default_rng(6)
    origin, rows = [f"w{i}" for i in range(80)], []
    for i in range(60):
        text = list(origin)
        for at in rng.choice(80, int(rng.integers(0, 3)), replace=False):
            text[at] = f"x{rng.integers(3000)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(f"{i // 2}y{k}" for k in range(40 + i % 2))) for i in range(20)] + [(200, None), (201, rows[0][1])]
    grams = lambda w: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    sets = {d: grams((t or "").split()) for d, t in rows}
    links = {d: len({y for y in sets.values() if x and y and x != y and 100 * len(x & y) >= 80 * len(x | y)}) for d, x in sets.items()}
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.n_links for r in out} == links and max(links.values()) > 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=120), st.lists(st.integers(0, 40), max_size=60))
def test_sketches_never_overstate(a, b):
    x, y = (word_shingles(" ".join(map(str, t))) for t in (a, b))
    both = len(set(x.tolist()) & set(y.tolist()))
    assert common(x, y) == both
    if len(x) and len(y):
        assert fewest_apart(parity_sketch(x), parity_sketch(y)) <= len(x) + len(y) - 2 * both


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (103, 103)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in (100, 101, 102)} == {100}


def test_line_dedup_drops_templates(spark):
    rows = [(i, f"own words {'abcdefghij'[i]} here\nPosted on 2024-0{i} by user{i} under news items today\n\nthe end of file {'abcdefghij'[i]}xyz") for i in range(10)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((r.n_lines, r.n_dropped, r.text) == (4, 2, f"own words {'abcdefghij'[i]} here\n") for i, r in out.items())


def test_line_dedup_on_odd_rows(odd, nothing):
    out = line_dedup.line_dedup(odd).collect()
    assert len(out) == len(ODD)
    assert Counter((r.doc_id, r.n_lines) for r in out) == Counter((i, len((t or "").split("\n"))) for i, t in ODD)
    assert all(r.text == "" and r.n_dropped == 0 for r in out if r.doc_id == 5)
    assert line_dedup.line_dedup(nothing).count() == 0


def test_line_dedup_whatever_else_a_leaf_holds(spark):
    """A line of 20 documents goes, alone or among thousands of other lines of its leaf."""
    same = "one two three four five six seven eight"
    alone = [(i, same) for i in range(20)]
    crowd = [(100 + i, f"one two three four a{i} b{i} c{i} d{i}") for i in range(3000)]
    for rows in (alone, alone + crowd):
        out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id for r in out if r.n_dropped} == set(range(20))


def test_line_dedup_looks_at_all_of_a_long_line(spark):
    """Lines that only share their first tokens are not one template, however long what they share."""
    head = " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}" for i in range(200))
    rows = [(i, head + " " + " ".join(f"{'abcdefghij'[i]}{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}" for k in range(200))) for i in range(8)]
    rows += [(100 + i, head) for i in range(8)]
    out = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 and out[100 + i] == 1 for i in range(8))


def test_line_dedup_takes_apart_lines_of_busy_leaves_only(spark, monkeypatch):
    """Leaves that share a bucket with a busy one change neither the result nor which lines are split into tokens."""
    rows = [(i, f"one two three four {'abcdefghij'[i]} six seven eight\n{'abcdefghij'[i]} own words that nobody else has") for i in range(10)]
    docs, kept, write = spark.createDataFrame(rows, "doc_id long, text string"), {}, line_dedup.stored

    def counted(df, name):
        out = write(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    results = []
    for buckets in (line_dedup.BUCKETS, 1):
        monkeypatch.setattr(line_dedup, "BUCKETS", buckets)
        results.append(sorted((r.doc_id, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs).collect()))
        assert kept["distinct"] == 10
    assert kept["lines"] == 20
    assert results[0] == results[1] == [(i, 1, f"{'abcdefghij'[i]} own words that nobody else has") for i in range(10)]


def test_line_dedup_splits_a_line_once_whatever_its_length(spark, monkeypatch, capsys):
    """No expression over a line's tokens splits the line again for each of them."""
    write = line_dedup.stored

    def shown(df, name):
        if name == "kept":
            df.explain(True)
        return write(df, name)

    monkeypatch.setattr(line_dedup, "stored", shown)
    line_dedup.line_dedup(spark.createDataFrame([(i, "one two three four five six") for i in range(6)], "doc_id long, text string")).collect()
    plans = capsys.readouterr().out
    assert "transform(tokens" in plans and "transform(split(" not in plans
