"""Exact ranks of values per group without holding a group in one task: a sketch brackets the rank, and only the bracket is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of the sketch is one in so many rows.
ACCURACY = 10_000


def at_ranks(df: DataFrame, keys: list[str], value: str, share: float, ranks: dict[str, Column]) -> DataFrame:
    """keys, n and for each of ``ranks`` the value that has this rank (from 1) among the n values that are not null.

    ``ranks`` are expressions over n near share * n. The quantile sketch, which
    combines on the map side, is off by n / ACCURACY ranks at most, so two of
    its quantiles bracket them. Rows below the bracket are one count, those
    within are counted by value, and only these counts, some 4 in ACCURACY of
    the rows or fewer, are ordered.
    """
    x = F.col(value)
    # Keys may be null: as fields of a struct they are equal all the same.
    rows = df.where(x.isNotNull()).select(F.struct(*keys, F.lit(0).alias("_")).alias("_k"), x.cast("double").alias("_x"))
    edge = 2 / ACCURACY
    bracket = F.percentile_approx("_x", F.array(F.lit(max(0.0, share - edge)), F.lit(min(1.0, share + edge))), F.lit(ACCURACY))
    sketch = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), bracket.alias("_b"))
    near = rows.join(sketch, "_k").withColumn("_in", F.when(F.col("_x") >= F.col("_b")[0], F.col("_x"))).where(F.col("_x") <= F.col("_b")[1])
    counts = near.groupBy("_k", "n", "_in").agg(F.count(F.lit(1)).alias("_times"))
    upto = F.sum("_times").over(Window.partitionBy("_k").orderBy(F.col("_in").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).where("_in IS NOT NULL")
    out = placed.groupBy("_k", "n").agg(*(F.min(F.when(F.col("_upto") >= rank, F.col("_in"))).alias(name) for name, rank in ranks.items()))
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), "n", *ranks)


def lower_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and the smallest value that at least half of the values do not exceed."""
    return at_ranks(df, keys, value, 0.5, {name: F.ceil(F.col("n") / 2)})


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and the mean of the middle value, or of the two middle ones."""
    out = at_ranks(df, keys, value, 0.5, {"_low": F.floor((F.col("n") + 1) / 2), "_high": F.floor(F.col("n") / 2) + 1})
    return out.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias(name))
