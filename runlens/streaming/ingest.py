"""Structured Streaming: ingest that repeats safely, tables rolled at one boundary, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.requests import ranked
from runlens.sources.runs import write_json


def ingest(source: DataFrame, tables: dict, out: str, checkpoint: str) -> None:
    """Write every micro-batch into several tables, once.

    ``tables`` maps a name to a function of the batch. Each batch writes under
    its own batch_id, overwriting what an attempt before it left, so a batch
    that is repeated after a failure does not repeat its rows.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, make in tables.items():
            make(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch_id={batch_id}")
        batch.unpersist()

    source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").drop("batch_id")


def _committed(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, n_docs) of the batches whose tables are all written."""
    commits = f"{out}/_commits"
    if not _exists(spark, commits):
        return spark.createDataFrame([], "batch_id long, n_docs long")
    return spark.read.schema("batch_id long, n_docs long").json(f"{commits}/batch-*.json")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def roll_batch(batch: DataFrame, batch_id: int, tables: dict, out: str, keys: list[str], per_shard: int) -> None:
    """Write one batch into all tables, cut into shards at the same documents, and then its commit record.

    Documents are numbered on from those of the batches before, in the order
    of their keys, so a shard holds ``per_shard`` documents of the whole
    stream and every table puts a document into the shard of that number. The
    record is one small file that takes its place in one step: readers see all
    tables of a batch or none. A batch that is committed is not written again.
    """
    spark = batch.sparkSession
    done = {r.batch_id: r.n_docs for r in _committed(spark, out).collect()}
    if batch_id in done:
        return
    numbered = f"{out}/_documents/batch_id={batch_id}"
    ranked(batch.select(*keys).distinct(), [F.col(k) for k in keys], "_ordinal").write.mode("overwrite").parquet(numbered)
    documents = spark.read.parquet(numbered)
    first = sum(n for b, n in done.items() if b < batch_id)
    for name, make in tables.items():
        rows = make(batch).join(documents, keys).withColumn("shard", F.floor((F.col("_ordinal") + first) / per_shard)).drop("_ordinal")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{out}/{name}/batch_id={batch_id}")
    write_json(spark, f"{out}/_commits/batch-{batch_id}.json", {"batch_id": batch_id, "n_docs": documents.count()})


def roll(source: DataFrame, tables: dict, out: str, checkpoint: str, keys: list[str], per_shard: int = 500) -> None:
    """roll_batch() of every micro-batch."""
    put = lambda batch, batch_id: roll_batch(batch, batch_id, tables, out, keys, per_shard)
    source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_rolled(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of a table with their shard, of committed batches only."""
    rows = spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch_id=*")
    return rows.join(F.broadcast(_committed(spark, out).select("batch_id")), "batch_id", "left_semi").drop("batch_id")


def event_windows(events: DataFrame, ts: str, keys: list[str], value: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window of event time; rows later than the watermark are left out."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def module_counters(events: DataFrame, module: str, event: str) -> DataFrame:
    """Calls, observations and exclusions of each module so far, as counters kept in the state store (output mode update)."""
    kinds = {"calls": "enter", "observations": "observe", "exclusions": "exclude"}
    return events.groupBy(module).agg(*(F.count_if(F.col(event) == kind).alias(name) for name, kind in kinds.items()))
