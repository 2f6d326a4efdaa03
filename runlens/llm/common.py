"""What the corpus operators share: scratch tables, fixed-size bitmaps, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one row of a bitmap on its way to the driver.
_BITMAP_PIECE = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that no further column can clash with those that operators add."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The folder of our own of each application that names none.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        path = _own_dirs[app]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The scratch tables of each application that are still there.
_scratch: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables(spark: SparkSession) -> int:
    """How many scratch tables this application has written so far."""
    return len(_scratch.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int) -> int:
    """Delete the tables that stored() wrote after the first ``since``; call it once the results that read them are written. Returns their number."""
    made = _scratch.get(spark.sparkContext.applicationId, [])
    paths, made[since:] = made[since:], []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = hadoop(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def slices(batches, rows: int = 1000):
    """Arrow batches cut smaller, so that a task holds the Python objects of few rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a worker process keeps between tasks, by the operator's part that keeps it, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, drop: Callable[[], None]) -> None:
    _kept[name] = drop


def claim(name: str) -> None:
    """Called in a worker by a part that begins to fill its own store: the stores of other parts are dropped, so that stages share one budget."""
    for other, drop in _kept.items():
        if other != name:
            drop()
    pa.default_memory_pool().release_unused()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits flags with those set that ``column`` (long, any value) names modulo its size.

    Its size is fixed by ``bits`` whatever the number of rows, so it may be
    sent to every task. Tasks OR their own copies; the driver joins at most
    2**bits / 8 bytes.
    """
    size = 1 << (bits - 3)
    piece = min(_BITMAP_PIECE, size)

    def own(batches):
        flags = np.zeros(size, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(flags, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        parts = flags.reshape(-1, piece)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "flags": pa.array([parts[i].tobytes() for i in used], pa.binary())})

    def merge(key, group):
        flags = np.zeros(piece, np.uint8)
        for x in group.column("flags").to_pylist():
            flags |= np.frombuffer(x, np.uint8)
        return pa.Table.from_pydict({"piece": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([flags.tobytes()], pa.binary())})

    kind = "piece int, flags binary"
    pieces = df.select(F.col(column).cast("long").alias("v")).where("v is not null").mapInArrow(own, kind)
    out = np.zeros(size, np.uint8).reshape(-1, piece)
    for row in pieces.groupBy("piece").applyInArrow(merge, kind).collect():
        out[row.piece] = np.frombuffer(row.flags, np.uint8)
    return out.reshape(-1)


def has_bit(flags: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): root is the smallest node reachable.

    Alternating large-star and small-star rounds, each a grouped minimum over
    (node, neighbour) pairs, so no node's neighbours are ever gathered in one
    place; each round is written to the shared folder, and rounds go on until
    nothing changes. Self-loops are allowed.
    """
    spark = edges.sparkSession
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour of a node links to the node's smallest neighbour (or itself).
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = stored(new, "edges")
        # Settled when no pair has changed: their number and the sum of their hashes stay.
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))).distinct()


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8: bit by bit, by the reversed polynomial."""
    digits = f"hex(encode({text}))"
    at = "instr('0123456789ABCDEF', substr({0}, i{1}, 1)) - 1"
    data = f"list_transform(range(1, length({digits}), 2), lambda i: 16 * ({at.format(digits, '')}) + {at.format(digits, ' + 1')})"
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform({data}, lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
