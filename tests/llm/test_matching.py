import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import chat, decontaminate, license_scan

from .conftest import ODD


def windows(words, n, k):
    """Multisets of the shingles of every window of n words, the whole text if it is shorter."""
    n = min(n, len(words))
    for s in range(len(words) - n + 1):
        w = words[s : s + n]
        yield s, Counter(tuple(w[i : i + k]) for i in range(n - k + 1))


def tokens(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w]


def brute_contaminated(docs, items):
    out = set()
    for d, text in docs:
        words = tokens(text)
        for i, item in items:
            own = tokens(item)
            k = min(5, len(own))
            if not own or len(words) < k:
                continue
            goal = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
            for _, held in windows(words, len(own), k):
                both = sum((held & goal).values())
                if both >= 0.8 * (sum(held.values()) + sum(goal.values()) - both):
                    out.add((d, i))
                    break
    return out


FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"
ITEM = "the quick brown fox jumps over the lazy dog while forty two small birds sing loudly from a very old crooked tree near the river bank at dawn every single day of spring"


def test_decontamination_against_brute_force(spark):
    words = ITEM.split()
    edited = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    docs = [(1, f"{FILL} {ITEM} {FILL}"), (2, f"{FILL} {ITEM.upper().replace(' ', ', ')}!"), (3, f"{FILL} {edited(0)}"), (4, f"{edited(31)} {FILL}"), (5, f"{FILL} {edited(10, 20)} {FILL}"),
            (6, " ".join(words[:15])), (7, f"{FILL} {' '.join(words[:14] + ['extra'] + words[14:])} {FILL}"), (8, FILL), (9, "tiny item"), (10, f"{FILL} tiny item {FILL}"), (11, " ".join(words[2:])), (12, ITEM + " " + ITEM)]
    items = [(1, ITEM), (2, "tiny item"), (3, None), (4, ""), (5, FILL.replace("sit", "sat")), (6, ITEM)]
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = out.collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_contaminated(docs, items)
    assert {r.start_word for r in found if (r.doc_id, r.item_id) == (1, 1)} == {15}
    assert all(r.similarity == 1.0 and r.distance == 0 for r in found if r.doc_id in (1, 2))


def test_decontamination_of_reordered_items(spark):
    """An item whose halves are swapped in the middle of a text shares most shingles, at no common offset."""
    item = [f"word{i}" for i in range(60)]
    swapped, thirds = " ".join(item[30:] + item[:30]), " ".join(item[40:] + item[20:40] + item[:20])
    docs = [(1, f"{FILL} {swapped} {FILL}"), (2, f"{FILL} {thirds} {FILL}"), (3, f"{FILL} {' '.join(item)} {FILL}"), (4, f"{FILL} {' '.join(item[:50])}"), (5, " ".join(item[6:])), (6, " ".join(item[4:])), (None, f"{FILL} {swapped}"), (7, f"{FILL} {swapped} {FILL} {' '.join(item)}")]
    items = [(1, " ".join(item)), (2, " ".join(item[:20])), (3, "word7 word8")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_contaminated(docs, items)
    assert {r.start_word for r in found if (r.doc_id, r.item_id) == (1, 1)} == {15}


def test_decontamination_against_brute_force_on_documents(spark, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    small = small.where("doc_id < 60")
    out = decontaminate.contaminated(small, items)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == brute_contaminated([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_decontamination_on_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine"), (None, "short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()} == brute_contaminated(ODD, [(1, "two three four five six seven eight nine"), (None, "short")])
    kept = decontaminate.keep_unmatched(odd, items)
    assert kept.columns == odd.columns and {4, 5, 7} <= {r.doc_id for r in kept.collect()} and not {1, 2, 9} & {r.doc_id for r in kept.collect()}
    assert decontaminate.contaminated(nothing, items).count() == decontaminate.contaminated(odd, items.where("false")).count() == 0
    assert decontaminate.keep_unmatched(odd, items.where("false")).count() == len(ODD)


def test_fingerprints_within_the_radius_meet(spark):
    """Whatever bits differ, up to RADIUS of them; most of those that differ in half do not meet."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a = rng.integers(0, 2, 128)
        n = int(rng.integers(0, decontaminate.RADIUS + 1)) if i < 200 else 64
        b = a.copy()
        at = rng.choice(128, n, replace=False)
        b[at] = 1 - b[at]
        rows.append((i, *([int(np.packbits(x[k : k + 64]).view(">i8")[0]) for k in (0, 64)] for x in (a, b))))
    df = spark.createDataFrame(rows, "i int, fp array<long>, gp array<long>")
    blocks = df.select("i", F.inline(decontaminate._block(F.col("fp"))))
    other = decontaminate._entered(df.select("i", F.inline(decontaminate._block(F.col("gp")))))
    met = {r.i for r in blocks.join(other, ["i", "block", "bits"]).select("i").distinct().collect()}
    assert set(range(200)) <= met and len(met) < 230
    assert all(r.d == bin(int(r.fp[0]) % 2**64 ^ int(r.gp[0]) % 2**64).count("1") + bin(int(r.fp[1]) % 2**64 ^ int(r.gp[1]) % 2**64).count("1") for r in df.withColumn("d", decontaminate._apart(F.col("fp"), F.col("gp"))).collect())


def test_recall_at_the_threshold(spark):
    """Windows with words exchanged at random, as similar as 0.8 to 1: nine of ten that brute force finds are found at least."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"i{i}w{rng.integers(10**6)}" for _ in range(int(rng.integers(30, 90))))) for i in range(20)]
    docs = []
    for d in range(300):
        w = items[d % 20][1].split()
        for at in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 30)), replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        docs.append((d, f"{FILL} {' '.join(w)} {FILL}"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    true = brute_contaminated(docs, [items[0]]) | {p for i in items[1:] for p in brute_contaminated(docs, [i])}
    assert len(true) > 150 and found <= true and len(found) >= 0.98 * len(true)


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "The mit\nlicense and the MIT-license; Apache License"), (3, "GNU General Public License"), (4, "nothing"), (5, None), (6, "licensed under the very apache license version 2.0"), (7, "ÉMIT license mit licensed"), (8, "mit license mit license")]
    out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (5, 1, 3, 3, "mit")
    assert (out[2].n_base, out[2].base_labels, out[2].first_word, out[2].last_word) == (3, "apache,mit", 1, 7)
    assert out[3].base_labels == "gpl" and "mit-notice" in out[1].labels
    assert (out[4].n_base, out[4].first_word, out[4].labels, out[4].score, out[5].n_words) == (0, None, "", 0.0, 0)
    assert "apache-2.0" in out[6].labels and out[7].n_base == 0 and out[8].n_base == 2


def test_license_texts(spark):
    """Each notice is found whole, with a word changed, and not by a third of it."""
    held = [(text.split(), label) for text, label in license_scan.TEMPLATES.items()]
    rows = []
    for i, (w, _) in enumerate(held):
        changed = [x if k != len(w) // 2 else "other" for k, x in enumerate(w)]
        rows += [(3 * i, f"{FILL} {' '.join(w)} {FILL}"), (3 * i + 1, f"{FILL} {' '.join(changed)} {FILL}"), (3 * i + 2, f"{FILL} {' '.join(w[: len(w) // 3])} {FILL}")]
    out = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (w, label) in enumerate(held):
        assert label in out[3 * i] and label not in out[3 * i + 2]
        assert label in out[3 * i + 1] or len(w) < 25


def test_licenses_on_odd_rows(odd, nothing):
    out = license_scan.license_scan(odd).collect()
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if w]
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((i, len(split(t))) for i, t in ODD)
    assert license_scan.license_scan(nothing).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|end|>yo"), (1, 2, "bob", "<|end|>yo"), (1, 70, None, None), (2, 0, "system", "alone"), (None, None, "ann", "x"), (3, 0, "ann", "")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, masks string")
    out = {(r.conv_id, r.perspective, r.part): r for r in chat.perspectives(df).collect()}
    assert set(out) == {(1, p, k) for p in ("ann", "bob", "unknown") for k in (0, 1)} | {(None, "ann", -1), (3, "ann", 0)}
    for r in out.values():
        said = [r.text[m.start : m.end] for m in r.masks]
        assert len(said) == r.n_own and all(s.endswith(chat.END) for s in said)
    bob = out[1, "bob", 0]
    assert bob.text == "<|system|>\nrules<|end|>\n<|user ann|>\nhi<|end|>\n<|assistant|>\n< |end|>yo<|end|>\n"
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["< |end|>yo<|end|>\n"]
    assert out[1, "bob", 1].chars_before == len(bob.text)
    assert chat.perspectives(df.where("false")).count() == 0


def test_chat_of_many_and_long_turns(spark):
    """A dialogue over many parts, a very long turn, and many texts under one turn number: the parts in order are the whole."""
    rows = [(1, i, "ab"[i % 2], f"turn {i}") for i in range(300)] + [(1, 7, "a", f"same number {i:04d}") for i in range(200)] + [(1, 300, "a", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted((r for r in chat.perspectives(df).collect() if r.perspective == "a"), key=lambda r: r.part)
    whole = "".join(("<|assistant|>\n" if role == "a" else f"<|user {role}|>\n") + text + chat.END for _, _, role, text in sorted(rows))
    assert "".join(r.text for r in out) == whole and sum(r.n_turns for r in out) == len(rows)
    assert [r.chars_before for r in out] == [sum(len(x.text) for x in out[:k]) for k in range(len(out))]
