"""Exact dedup: a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, free_name, shuffle_parts, stored

#: Runs that one merge takes in: rounds are binomial.
FAN_IN = 2

#: Ranges of digests for each shuffle partition; a merged run is spread over all of them.
SLOTS_EACH = 4

_KEY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, run, digest, n_bytes, check) per row; run numbers the partition that read it."""
    return docs.select("doc_id", normalised(F.col("text")).alias("t")).select(
        "doc_id",
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2("t", 256).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def merge_runs(rows: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, n_bytes, check, first, group_size): the smallest (doc_id, row) of every distinct text.

    A run holds one row per distinct text that its partition met. In every
    round the runs pair up (more at once with a larger ``fan_in``), are
    exchanged by (run, digest range), laid out in digest order and merged, so
    a text repeated in a third of all rows sends at most one row per run. A digest only matches together with
    its byte length and a second, independent hash, at every level.
    """
    spark = rows.sparkSession
    # As many ranges as the cluster has room for, by the digest's first 32 bits.
    slots = SLOTS_EACH * shuffle_parts(spark)
    slot = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * slots / (1 << 32)).cast("int")
    # A null id sorts after every other id.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = rows.withColumn("slot", slot).groupBy("run", "slot", *_KEY).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(shuffle_parts(spark), "run", "slot")
            .sortWithinPartitions("run", "slot", *_KEY)
            .groupBy("run", "slot", *_KEY)
            .agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
        )
        runs = -(-runs // fan_in)
    return level.drop("run", "slot")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is normalised. Null text
    counts as empty, so null and blank-free empty rows are one group. Of equal
    texts the row with the smallest doc_id stays (a null doc_id sorts last); of
    rows that repeat both id and text exactly one stays. An empty table gives
    an empty result; further columns of ``docs`` are not read.
    """
    rows = stored(digests(corpus(docs)), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    groups = stored(merge_runs(rows, runs).where("group_size > 1"), "copies").select(*_KEY, "first", "group_size")
    # A plain join, so that adaptive execution may split the partition of a text with very many copies.
    return rows.join(groups, _KEY, "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller doc_id has; all columns stay."""
    found = exact_dedup(docs)
    dropped = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    kept = found.where("kept and group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    repeated = dropped.join(kept, (dropped._id.eqNullSafe(kept._id)) & (dropped._digest == kept._digest), "left_semi")
    gone = stored(dropped.join(repeated, (dropped._id.eqNullSafe(repeated._id)) & (dropped._digest == repeated._digest), "left_anti"), "gone")
    digest = free_name(docs, "digest")
    rows = docs.withColumn(digest, F.sha2(normalised(F.col("text")), 256))
    # The list grows with the corpus: a merge join at every size.
    gone = gone.hint("merge")
    out = rows.join(gone, rows.doc_id.eqNullSafe(gone._id) & (rows[digest] == gone._digest), "left_anti")
    if repeated.limit(1).count():
        out = out.dropDuplicates(["doc_id", digest])
    return out.drop(digest)


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
