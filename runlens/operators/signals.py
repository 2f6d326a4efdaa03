"""Per-layer signals: joining them to documents, depth curves and prediction depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalar import is_finite, relative_depth
from runlens.operators import selection
from runlens.operators.checks import refuse_duplicates


def join_docs(signals: DataFrame, docs: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Signals with their document's columns, null without one; repeated document keys are refused, as they would multiply rows."""
    if check:
        refuse_duplicates(docs, keys)
    return signals.join(docs, keys, "left")


def adjacent(df: DataFrame) -> DataFrame:
    return df.where(F.col("layer_j") == F.col("layer_i") + 1)


def curve(df: DataFrame, keys: list[str], index: str, value: str, n_blocks: F.Column, domain: str) -> DataFrame:
    """Mean and number of the values of each layer, null and NaN left out, with the layer's relative depth."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    n_blocks = n_blocks if isinstance(n_blocks, F.Column) else F.lit(n_blocks)
    out = kept.groupBy(*keys, index).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("depth", relative_depth(F.col(index), n_blocks, F.lit(domain)))


def comparison(df: DataFrame, keys: list[str], index: str, signals: list[str], n_blocks: int, domain: str, comparable: DataFrame | None = None) -> DataFrame:
    """The curves of several signals in one long table; ``comparable`` (signal) names those that may be compared."""
    long = df.unpivot([*keys, index], [F.col(s).cast("double").alias(s) for s in signals], "signal", "value")
    if comparable is not None:
        long = long.join(comparable, "signal", "left_semi")
    return curve(long, [*keys, "signal"], index, "value", F.lit(n_blocks), domain)


def prediction_depth(df: DataFrame, keys: list[str], layer: str, token: str, n_blocks: F.Column | None = None) -> DataFrame:
    """Where the last run of layers that give the final token begins, and its relative depth.

    The final token is that of the largest layer. One shuffle by the keys: the
    last layer with another token comes from a window, the settled layer from
    an aggregation over the same partitioning.
    """
    whole = Window.partitionBy(*keys)
    final = F.max_by(token, layer).over(whole)
    marked = df.where(F.col(layer).isNotNull()).withColumn("_final", final)
    marked = marked.withColumn("_last_other", F.max(F.when(~F.col(token).eqNullSafe(F.col("_final")), F.col(layer))).over(whole))
    out = marked.groupBy(*keys).agg(F.min(F.when(F.col("_last_other").isNull() | (F.col(layer) > F.col("_last_other")), F.col(layer))).alias("settled_layer"), F.max(layer).alias("last_layer"), F.max("_final").alias("final_token"))
    blocks = F.col("last_layer") if n_blocks is None else n_blocks
    return out.withColumn("depth", relative_depth(F.col("settled_layer"), blocks, F.lit("residual")))


def target_rows(df: DataFrame, run: list[str], flag: str) -> DataFrame:
    """Rows of the target choice, of runs that have one; all rows of the others."""
    has = F.coalesce(F.max(F.col(flag).cast("int")).over(Window.partitionBy(*run)), F.lit(0))
    return df.withColumn("_has", has).where((F.col("_has") == 0) | F.col(flag)).drop("_has")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median of the finite values of each group and their number."""
    return selection.median(df.where(is_finite(F.col(value))), keys, value).select(*keys, "median", "n")


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def document_depth(depths: DataFrame, keys: list[str], order: list[str], depth: str = "depth") -> DataFrame:
    """One depth per document: that of the last choice and step."""
    return depths.groupBy(*keys).agg(F.max_by(depth, F.struct(*order)).alias(depth))


def join_metrics(signals: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Signals with a metric of their document, null without one; several metric rows of a document are refused."""
    refuse_duplicates(metrics, keys)
    return signals.join(metrics, keys, "left")
