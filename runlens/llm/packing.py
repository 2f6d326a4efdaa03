"""Bulk-synchronous best-fit packing.

Pieces go in bands of sizes, large ones first; a band is a superstep. Its
pieces and the gaps (what is left of open sequences) are sorted by range and
dealt in turn to shards, so that every shard has like sizes and a bounded
number of rows, whatever the corpus. All shards sweep at once: each piece goes
to the smallest gap that it fits, its successor, conflicts are resolved by
rank, gaps are updated, and this repeats until no gap takes a piece. What is
left opens some of the sequences that it would fill, and the sweeps go on until
all pieces of the band are placed. Then the gaps of all shards are sorted and
dealt anew for the next band.

A shard leaves one sequence partly filled at the end, of some SEQUENCES. The
driver sees a row of counters for each band.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, shuffle_parts, stored
from runlens.llm.tokens import CHUNK, tokenizer

LENGTH = 2048
#: Lower bounds of the bands of sizes, as parts of a sequence; the last band goes down to the smallest.
PARTS = (2, 4, 16)
#: Of the sequences that the pieces left would fill, one in so many is opened at a time.
OPENED = 4
#: Sequences that the pieces of one shard fill, and its rows for each of them at most.
SEQUENCES = 2000
ROWS_A_SEQUENCE = 10

_PIECE = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end: int, length: int = LENGTH) -> DataFrame:
    """The ids of each text and ``end``, cut into pieces of ``length`` ids; only the last may be shorter."""

    def cut(batches):
        make, last = tokenizer(vocabulary), np.uint32(end).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                out = {k.split()[0]: [] for k in _PIECE.split(", ")}
                for doc_id, row, ids in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), make(rows.column(1).to_pylist()), strict=True):
                    ids += last
                    for k, first in enumerate(range(0, len(ids) // 4, length)):
                        held = ids[4 * first : 4 * (first + length)]
                        for name, value in zip(out, (doc_id, row, k, first, len(held) // 4, zlib.crc32(held)), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "row": pa.array(out["row"], pa.int64()), "piece": pa.array(out["piece"], pa.int32()), "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int32()), "ids_crc32": pa.array(out["ids_crc32"], pa.int64())})

    return corpus(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(cut, _PIECE)


_STEP = "is_gap boolean, size int, sequence_id long, offset long, " + _PIECE


def sweep(sizes: np.ndarray, gaps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gap and place of every piece, and what is left of the gaps; ``sizes`` descends, opened sequences are added to ``gaps``.

    In descending order of size, gaps before pieces, a gap opens a bracket
    and a piece closes the innermost open one. So each piece goes to the
    smallest gap that it fits, and of pieces that want one gap the first in
    rank, which is the largest, has it; the others go to the gaps around.
    Brackets are matched by their level. Gaps are updated and swept again until
    none takes a piece. Only then sequences are opened, a part of those that
    the pieces left would fill.
    """
    at, offset, left = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64), np.arange(len(sizes))
    while len(left):
        live = np.flatnonzero(gaps >= sizes[left[-1]])
        both = np.concatenate([gaps[live], sizes[left]])
        order = np.argsort(-both, kind="stable")
        piece = (order >= len(live)).astype(np.int64)
        level = np.cumsum(1 - 2 * piece) + piece
        by_level = np.argsort(level, kind="stable")
        first, then = by_level[:-1], by_level[1:]
        met = (level[first] == level[then]) & (piece[first] == 0) & (piece[then] == 1)
        gap, mine = live[order[first[met]]], order[then[met]] - len(live)
        if not len(gap):
            gaps = np.concatenate([gaps, np.full(max(1, int(sizes[left].sum()) // (OPENED * length)), length, np.int64)])
            continue
        taken = left[mine]
        at[taken], offset[taken] = gap, length - gaps[gap]
        gaps[gap] -= sizes[taken]
        left = np.delete(left, mine)
    return at, offset, gaps


def _dealt(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``df`` with a shard for each row: sorted by range, rows are dealt in turn, so that every shard has like sizes."""
    ordered = df.repartitionByRange(shuffle_parts(df.sparkSession), *order).sortWithinPartitions(*order)
    # The number within the partition is the lower 33 bits.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("shard", F.pmod(nth + F.spark_partition_id(), F.lit(shards)))


def _superstep(gaps: DataFrame, wants: DataFrame, shards: int, band: int, length: int) -> DataFrame:
    """Sweep all shards of a band: rows _STEP of placed pieces and of what is left of each gap."""
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in _PIECE.split(", "))]
    held = _dealt(gaps, ["size", "sequence_id"], shards).select("shard", F.lit(True).alias("is_gap"), "size", "sequence_id", F.lit(None).cast("long").alias("offset"), *nulls)
    wanted = _dealt(wants, ["length", "doc_id", "row", "piece"], shards).select("shard", F.lit(False).alias("is_gap"), F.col("length").alias("size"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), *(c.split()[0] for c in _PIECE.split(", ")))
    names = [c.split()[0] for c in _STEP.split(", ")]

    def swept(key, table):
        shard, is_gap = key[0].as_py(), table.column("is_gap")
        open_ = table.filter(is_gap).sort_by([("size", "ascending"), ("sequence_id", "ascending")])
        pieces_ = table.filter(pc.invert(is_gap)).sort_by([("size", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        at, offset, left = sweep(pieces_.column("size").to_numpy().astype(np.int64), open_.column("size").to_numpy().astype(np.int64), length)
        # Numbers of sequences that this shard opens begin where no other's do.
        own = ((band + 1) << 52) + (shard << 24) + np.arange(len(left) - len(open_), dtype=np.int64)
        sequence = np.concatenate([open_.column("sequence_id").to_numpy().astype(np.int64), own])
        placed = pieces_.set_column(names.index("sequence_id") + 1, "sequence_id", pa.array(sequence[at])).set_column(names.index("offset") + 1, "offset", pa.array(offset)).select(names)
        some = np.flatnonzero(left > 0)
        rest = {n: pa.nulls(len(some), placed.schema.field(n).type) for n in names} | {"is_gap": pa.array(np.ones(len(some), bool)), "size": pa.array(left[some], pa.int32()), "sequence_id": pa.array(sequence[some])}
        return pa.concat_tables([placed, pa.Table.from_pydict(rest, schema=placed.schema)])

    return held.unionByName(wanted).groupBy("shard").applyInArrow(swept, _STEP)


def pack(rows: DataFrame, length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """``rows`` (doc_id, row, piece, start, length, ids_crc32), a stored table, with sequence_id and offset.

    Every piece lies in one sequence, pieces of a sequence do not overlap and
    leave no hole before the last. Ties in size go by doc_id, row and piece.
    An empty table packs into nothing.
    """
    bounds = [length // p for p in PARTS] + [0]
    band = F.lit(0)
    for b in bounds[:-1]:
        band = band + (F.col("length") <= b).cast("int")
    held = {r.band: r for r in rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("ids")).collect()}
    spark = rows.sparkSession
    gaps, n_gaps = spark.createDataFrame([], "size int, sequence_id long"), 0
    placed = spark.createDataFrame([], _STEP)
    for i, b in enumerate(bounds):
        if i not in held:
            continue
        shards = max(1, -(-held[i].ids // (length * sequences)), -(-(held[i].n + n_gaps) // (ROWS_A_SEQUENCE * sequences)))
        # Gaps that no piece of the band fits wait for the next.
        done = stored(_superstep(gaps.where(F.col("size") > b), rows.where(band == i), shards, i, length), "packing")
        placed = placed.unionByName(done.where(~F.col("is_gap")))
        gaps = gaps.where(F.col("size") <= b).unionByName(done.where("is_gap").select("size", "sequence_id"))
        n_gaps = gaps.count() if i < max(held) else 0
    return placed.select("doc_id", "row", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def best_fit(docs: DataFrame, vocabulary: str, end: int, length: int = LENGTH) -> DataFrame:
    """Pack all rows of ``docs``; null text is empty and still holds ``end``; repeated rows are packed each."""
    return pack(stored(pieces(docs, vocabulary, end, length), "pieces"), length)
