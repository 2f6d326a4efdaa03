"""Scoring requests in the order in which a model takes them, and the positions of a forward that each request reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.sources.scratch import new_folder


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rank from 0 in a total order, without bringing all rows into one task.

    Rows are sorted by range and written with their partition and their place
    in it to the shared folder; a partition's first rank is the number of rows
    before it, which comes from one count a partition. Ranges are drawn anew,
    and partitions put together by their size, each time a plan runs, so both
    sides must read what one run gave.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    held = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    held = held.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    held = held.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = new_folder(df.sparkSession, "ranked")
    held.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(held.schema).parquet(path)
    # One row for each partition.
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def batched(requests: DataFrame, index: str, context: str, continuation: str, share: bool = True) -> DataFrame:
    """``requests`` with the row of the model's input that serves each: longest first, then by tokens, then by ``index``.

    Where rows are shared, requests with the same context and continuation but
    for its last token are served by the first of them, and only these are
    ranked. The rows' order inverts by joining answers on ``row``.
    """
    tokens = F.concat(context, continuation)
    prefix = F.concat(context, F.slice(continuation, 1, F.size(continuation) - 1)) if share else F.array(F.col(index))
    rows = requests.withColumn("_prefix", prefix)
    first = rows.groupBy("_prefix").agg(F.min_by(F.struct(F.col(index).alias("i"), tokens.alias("tokens")), index).alias("_r")).select("_prefix", "_r.*")
    placed = ranked(first, [-F.size("tokens"), F.col("tokens"), F.col("i")], "row").select("_prefix", "row", F.size("tokens").alias("row_tokens"))
    return rows.join(placed, "_prefix").drop("_prefix")


def scored_positions(rows: DataFrame, index: str, keys: list[str], context: str, continuation: str, max_length: int) -> DataFrame:
    """A row per token that a request scores: keys, row, step, position, target and the input's length and offset.

    ``rows`` are those of batched(). The input is the last max_length + 1
    tokens less the last one, and the token at position p predicts the next:
    a request of k tokens reads the last k positions, one with fewer than its
    row's own the trailing part of the same span.
    """
    length = F.least(F.col("row_tokens") - 1, F.lit(max_length))
    held = rows.select(index, *keys, "row", F.posexplode(continuation).alias("step", "target"), F.size(continuation).alias("_k"), length.alias("input_length"), (F.col("row_tokens") - 1 - length).alias("input_offset"))
    return held.withColumn("position", F.col("input_length") - F.col("_k") + F.col("step")).drop("_k")
