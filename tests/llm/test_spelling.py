from collections import Counter
from zlib import crc32

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from runlens.llm import spelling
from runlens.llm.spelling import FORM_RATIO, LEAST_COUNT, LEAST_LENGTH, NOISE


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    p = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[p + 1 :] == (b[p + 1 :] if len(a) == len(b) else b[p:])


def brute(counts: dict[str, int]) -> dict:
    forms, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min((v for v in near if counts[v] >= FORM_RATIO * n), key=lambda v: (-counts[v], v), default=None)
        forms[w] = best
        out[w] = (best, len(near), counts.get(best))
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (root,)
    return out


def found(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {r.word: r for r in spelling.near_words(df).collect()}
    ends = {r.word: r.root for r in spelling.roots(spelling.near_words(df).where("form is not null")).collect()}
    return {w: (near[w].form, near[w].n_near, near[w].form_n, ends.get(w, w)) if w in near else (None, 0, None, w) for w in counts}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text("abé", min_size=6, max_size=11), st.sampled_from([1, 2, 10, 20, 100, 2000]), min_size=2, max_size=60))
def test_near_words_equal_brute_force(spark, counts):
    assert found(spark, counts) == brute(counts)


def test_runs_of_letters_chains_and_ties(spark):
    counts = {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "baaaaaaaa": 500, "aaaaaaaab": 5, "zzzzzzz": 1, "ÿzzzzzz": 10, "zzzzzzÿ": 10}
    got = found(spark, counts)
    assert got == brute(counts)
    assert got["aaaaaaa"][3] == "aaaaaaaaa" and got["zzzzzzz"][0] == "zzzzzzÿ"


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 7)
    counts = {f"prefix{a}{b}{c}suffix": 1 + 20 * (a == b) for a in "abcde" for b in "abcde" for c in "abc"} | {f"prefix{a}{b}suffix": 300 for a in "abc" for b in "abcde"}
    assert found(spark, counts) == brute(counts)


def test_words_of_odd_texts(spark, odd):
    counts = Counter()
    import re

    for r in odd.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % NOISE == 0 else run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= LEAST_LENGTH and n >= LEAST_COUNT}
    got = {r.word: (r.form, r.n_near, r.form_n, r.root, r.n) for r in spelling.spelling_variants(odd).collect()}
    assert got == {w: (*x, want[w]) for w, x in brute(want).items()}


def test_nothing_and_repeated_rows(spark, nothing):
    assert spelling.spelling_variants(nothing).collect() == []
    twice = spark.createDataFrame([(1, "ÉCOLEsup Straßenname"), (1, "ÉCOLEsup Straßenname"), (2, None), (None, "STRAßenname")], "doc_id long, text string")
    assert {(r.word, r.n) for r in spelling.spelling_variants(twice).collect()} >= {("Écolesup", 2)}


@pytest.mark.parametrize("a, b, near", [("abcdefg", "abcdefh", 1), ("abcdefg", "abcdefgh", 1), ("abcdefg", "bcdefga", 0), ("aaaaaaa", "aaaaaaaaa", 0), ("abababa", "bababab", 0)])
def test_pairs(spark, a, b, near):
    assert found(spark, {a: 1, b: 1})[a][1] == near
