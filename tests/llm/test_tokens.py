import json
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import packing, token_files
from runlens.llm.queries import vocabulary
from runlens.llm.tokens import PieceTokenizer, tokenizer

from .conftest import ODD

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def whole(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_library(path, small):
    texts = [t for _, t in ODD] + [r.text for r in small.collect()]
    assert [ids_of(x) for x in tokenizer(path)(texts)] == whole(path, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab éÉÅß²½1'-.\n\t\r\x85\xa0\x1ćΣſK İ日<|>s"), max_size=30), st.sampled_from([BYTE, WORD]))
def test_any_text_equals_the_library(text, path):
    assert ids_of(tokenizer(path)([text])[0]) == whole(path, [text])[0]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_tokens_are_the_librarys(path):
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|startoftext|>", "<|endoftext|", "<| endoftext |>", "x<|endoftext|>y <|startoftext|> \u2019"]
    assert [ids_of(x) for x in tokenizer(path)(texts)] == whole(path, texts)
    assert 50256 in whole(BYTE, texts)[0] and 49407 in whole(WORD, texts)[0]
    assert ids_of(PieceTokenizer(BYTE, special_as_text=True)(["<|endoftext|>"])[0]) != [50256]


def test_other_vocabularies_are_encoded_whole(tmp_path, small):
    """A file whose settings cut texts in another way is never cut here."""
    settings = json.loads(Path(BYTE).read_text())
    settings["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    texts = [t for _, t in ODD] + [r.text for r in small.limit(20).collect()]
    make = PieceTokenizer(str(path))
    assert make.kind is None and [ids_of(x) for x in make(texts)] == whole(str(path), texts)


def test_forgetting_changes_nothing():
    make = PieceTokenizer(BYTE, kept=3)
    for text in ("a b c d e f", "g h i a b", "a b c d e f"):
        assert ids_of(make([text])[0]) == whole(BYTE, [text])[0]


def test_files_round_trip(spark, odd, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(odd, path, BYTE, 2)
    out = token_files.read_tokens(spark, path).collect()
    expected = Counter((i, tuple(ids) + (2,)) for (i, _), ids in zip(ODD, whole(BYTE, [t for _, t in ODD]), strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == expected
    out.sort(key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in out]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_files.read_tokens(spark, path).where("doc_id = 7").count() == 1
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(token_files.read_tokens(spark, path)).collect()}
    assert sums == {(r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in out}


def test_files_can_be_read_in_parts(spark, tmp_path, monkeypatch):
    """Stripes, row indexes and Bloom filters are in the files, and what a filter cannot match is not read."""
    from pyarrow import orc

    monkeypatch.setattr(token_files, "INDEX_ROWS", 1000)
    monkeypatch.setattr(token_files, "STRIPE", 1 << 16)
    # The writer looks at the size of a stripe every 5,000 rows.
    rows = spark.range(48_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    token_files.write_tokens(rows, f"file://{tmp_path}/tokens", BYTE, 2)
    files = [orc.ORCFile(p) for p in tmp_path.glob("tokens/*.orc")]
    assert sum(f.nrows for f in files) == 48_000 and all(f.row_index_stride == 1000 for f in files) and max(f.nstripes for f in files) > 1
    spans = sorted((f.read_stripe(i, ["doc_id"])["doc_id"][0].as_py(), f.read_stripe(i, ["doc_id"])["doc_id"][-1].as_py()) for f in files for i in range(f.nstripes))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    found = token_files.read_tokens(spark, f"file://{tmp_path}/tokens").where("doc_id = 12345")
    assert "EqualTo(doc_id,12345)" in found._jdf.queryExecution().toString() and found.count() == 1


def rows_read(df):
    """Rows that the scan of ``df`` hands on, once what the files' own indexes rule out is skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().apply(0).metrics().get("numOutputRows").get().value()


def test_indexes_and_bloom_filters_skip_rows(spark, tmp_path):
    """Even ids only: an id's group of rows is found by least and greatest ids, and an odd one, which these cannot rule out, by the Bloom filter."""
    rows = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_tokens(rows, f"file://{tmp_path}/tokens", BYTE, 2)
    held = spark.read.orc(f"file://{tmp_path}/tokens").select("doc_id", "n_tokens")
    assert rows_read(held) == 20_000
    assert 0 < rows_read(held.where("doc_id = 12344")) <= 2 * token_files.INDEX_ROWS
    skipped = [rows_read(held.where(f"doc_id = {i}")) for i in range(101, 39_000, 3_900 + 2)]
    assert sum(n == 0 for n in skipped) >= len(skipped) - 1


def test_files_of_nothing(spark, nothing, tmp_path):
    token_files.write_tokens(nothing, f"file://{tmp_path}/tokens", BYTE, 2)
    assert token_files.digests(token_files.read_tokens(spark, f"file://{tmp_path}/tokens")).count() == 0


def best_fit_decreasing(sizes, length):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= s]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= s
        else:
            gaps.append(length - s)
    return len(gaps)


CASES = {
    "many sizes": (lambda r: r.integers(1, 65, 300), 64), "small": (lambda r: r.integers(1, 9, 500), 64), "middle": (lambda r: r.integers(18, 40, 200), 64), "ones": (lambda r: np.ones(130, int), 64),
    "full": (lambda r: np.full(50, 64), 64), "equal": (lambda r: np.full(41, 22), 64), "up to 200": (lambda r: r.integers(1, 201, 6000), 2048), "long tail": (lambda r: np.minimum(2048, r.lognormal(5.5, 1.2, 6000).astype(int) + 1), 2048),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("sequences", [packing.SEQUENCES, 25])
def test_packing_is_within_a_hundredth_of_best_fit_decreasing(spark, name, sequences):
    make, length = CASES[name]
    sizes = make(np.random.default_rng(4)).tolist()
    rows = spark.createDataFrame([(i % 97, i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing._PIECE)
    out = packing.pack(rows, length, sequences).collect()
    assert sorted(r.row for r in out) == list(range(len(sizes)))
    used = _by(out, "sequence_id")
    for places in used.values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at and r.length == sizes[r.row]
            at += r.length
        assert at <= length
    # Small shards leave a sequence each partly filled.
    best = best_fit_decreasing(sizes, length)
    assert len(used) <= 1.01 * best + 1 + (best // sequences + 1 if sequences < best else 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60), st.lists(st.integers(1, 19), max_size=20))
def test_sweeps_fill_gaps_before_sequences_are_opened(sizes, gaps):
    sizes = np.array(sorted(sizes, reverse=True))
    at, offset, left = packing.sweep(sizes, np.array(gaps, np.int64), 20)
    filled = defaultdict(int)
    for k, g in enumerate(at):
        filled[g] += sizes[k]
    before = gaps + [20] * (len(left) - len(gaps))
    assert all(left[g] == before[g] - filled[g] >= 0 for g in range(len(left)))
    spans = sorted((at[k], offset[k], offset[k] + sizes[k]) for k in range(len(sizes)))
    assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))
    # A sequence is opened only for pieces that no gap takes.
    opened = range(len(gaps), len(left))
    assert all(filled[g] for g in opened)


def test_packing_on_odd_rows(odd, nothing):
    out = packing.best_fit(odd, WORD, 0, 64).collect()
    texts = whole(WORD, [t for _, t in ODD])
    pieces = Counter((i, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for (i, _), ids in zip(ODD, texts, strict=True) for k, p in enumerate([(ids + [0])[a : a + 64] for a in range(0, len(ids) + 1, 64)]))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == pieces
    for _, rows in _by(out, "sequence_id").items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.best_fit(nothing, WORD, 0).count() == 0


def _by(rows, name):
    out = defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out
