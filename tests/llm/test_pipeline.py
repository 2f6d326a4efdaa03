import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from runlens.llm import decontaminate, exact_dedup, jaccard_join, toxicity
from runlens.llm.queries import vocabulary

from .test_dedup import brute_components, digest
from .test_matching import brute_contaminated, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, small, labels):
    """Each stage drops what its operator marks, keeps all columns, and the last packs what is left."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = small
    marks = [
        lambda d: toxicity.toxicity(d, labels).where("predicted = 0"),
        lambda d: exact_dedup.exact_dedup(d).where("kept"),
        lambda d: jaccard_join.jaccard_components(d).where("component_id = doc_id"),
        lambda d: d.join(decontaminate.contaminated(d, items), "doc_id", "left_anti"),
    ]
    for (_, stage), kept in zip(corpus_pipeline.STAGES, marks, strict=False):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema
        out = out.cache()
        assert ids(out) == ids(kept(docs))
        docs = out
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, docs, SF).columns == docs.columns
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= docs.count()


def test_run_against_brute_force(spark, small):
    """All rows of run(): what each stage keeps by its definition, then a whole packing of the last documents."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(small, labels).where("predicted = 1").collect()}  # its scores have a brute-force test of their own
    docs = sorted((r.doc_id, r.text) for r in small.collect() if r.doc_id not in toxic)
    first = {}
    for i, t in docs:
        first.setdefault(digest(t), i)
    docs = [(i, t) for i, t in docs if first[digest(t)] == i]
    heads = {i: head for i, _, head in brute_components(docs)}
    docs = [(i, t) for i, t in docs if heads[i] == i]
    hit = set()
    for i, t in docs:
        words = tokens(t)
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        near = [x for x in items if len(tokens(x[1])) < 5 or own & {tuple(tokens(x[1])[k : k + 5]) for k in range(len(tokens(x[1])) - 4)}]
        hit |= {d for d, _ in brute_contaminated([(i, t)], near)}
    docs = [(i, t) for i, t in docs if i not in hit]
    out = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = Counter()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected.update((i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
