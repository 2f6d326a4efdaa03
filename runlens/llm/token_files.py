"""Token-ID output: ORC files of integer runs, sorted by document, with row indexes and Bloom filters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.common import corpus, shuffle_parts
from runlens.llm.tokens import CHUNK, tokenizer

#: Pieces that a worker remembers; no other stage of this job needs the memory.
KEPT_PIECES = 800_000
#: Rows between the entries of a row index, and bytes of a stripe: what a reader may skip, and read by itself.
INDEX_ROWS, STRIPE = 1000, 16 << 20


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int) -> None:
    """Encode every text, append ``end`` and write (doc_id, part, before, n_tokens, ids) as ORC in ascending doc_id order.

    Files are the ranges of a range sort, part numbers them in order and
    before counts the ids that stand earlier in the same part. ORC keeps ids
    as run-length encoded integers, an index entry per INDEX_ROWS rows and a
    Bloom filter on doc_id. A null text is empty, a null doc_id sorts first,
    rows that share an id stay next to each other.
    """

    def encode(batches):
        make, last = tokenizer(vocabulary, KEPT_PIECES), np.uint32(end).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                ids = [x for raw in make(rows.column(1).to_pylist()) for x in (raw, last)]
                size = np.array([len(x) // 4 + 1 for x in ids[::2]], np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "part": pa.array(np.full(len(size), part), pa.int32()), "before": pa.array(before + np.cumsum(size) - size), "n_tokens": pa.array(size), "ids": held})
                before += int(size.sum())

    # The texts are sorted, not the ids, which take more room.
    rows = corpus(docs).repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(encode, "doc_id long, part int, before long, n_tokens long, ids array<int>").write.options(**{
        "compression": "none", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE),
    }).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before. Filters on doc_id skip stripes and index entries."""
    kind = "doc_id long, part int, before long, n_tokens long, ids array<int>"
    files = spark.read.schema(kind).orc(path)
    # One row per part; only two columns of the files are read for it.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return files.join(F.broadcast(ahead), "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that read_tokens() gives, n_tokens counted anew from the ids."""

    def crc(batches):
        for batch in batches:
            ids = batch.column(2)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": pa.array(np.diff(at).astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())})

    return tokens.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
