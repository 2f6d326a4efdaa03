"""Moments that keep non-finite values apart, merged from calls to documents to data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalar import is_finite
from runlens.operators.selection import lower_median


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, finite_count, nan, posinf, neginf and, over finite values only, mean, m2, min and max; null without any."""
    x = F.col(value).cast("double")
    finite = F.when(is_finite(x), x)
    return df.groupBy(*keys).agg(
        F.count(x).alias("count"),
        F.count(finite).alias("finite_count"),
        F.count_if(F.isnan(x)).alias("nan"),
        F.count_if(x == float("inf")).alias("posinf"),
        F.count_if(x == float("-inf")).alias("neginf"),
        F.avg(finite).alias("mean"),
        (F.var_pop(finite) * F.count(finite)).alias("m2"),
        F.min(finite).alias("min"),
        F.max(finite).alias("max"),
    )


def merge(parts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The moments of all rows behind partial moments; a part without finite values changes counts only.

    Squares are taken about the common mean, in a second aggregation, so that
    nothing is lost to cancellation. Both combine on the map side, so a group
    with very many parts costs no more than others. ``more`` are further
    aggregates over the parts, taken along.
    """
    whole = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        *(F.sum(c).alias(c) for c in ("count", "finite_count", "nan", "posinf", "neginf")),
        (F.sum(F.col("finite_count") * F.col("mean")) / F.nullif(F.sum("finite_count"), F.lit(0))).alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        *more,
    )
    apart = parts.join(whole.select(*keys, F.col("mean").alias("_mean")), keys)
    squares = apart.groupBy(*keys).agg(F.sum(F.col("m2") + F.col("finite_count") * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("m2"))
    return whole.join(squares, keys)


def _deviation(m2: Column, n: Column) -> Column:
    return F.sqrt(m2 / F.nullif(n, F.lit(0)))


def pool_calls(observations: DataFrame, forwards: DataFrame, group: list[str], doc: str = "doc_id") -> DataFrame:
    """Moments per group and document over complete forwards, with the number of observations and std."""
    done = observations.join(forwards.where(F.col("status") == "complete").select("forward"), "forward", "left_semi")
    return merge(done, [*group, doc]).withColumn("std", _deviation(F.col("m2"), F.col("finite_count")))


def pool_documents(samples: DataFrame, group: list[str]) -> DataFrame:
    """Per group: pooled moments over all values, and moments of the documents' means, each document counting once."""
    mean, n = F.col("mean"), F.count("mean")
    each = (
        F.sum("observations").alias("_observations"),
        n.alias("finite_documents"),
        F.avg(mean).alias("sample_mean"),
        F.stddev_pop(mean).alias("sample_mean_std"),
        (F.var_pop(mean) * n).alias("sample_mean_m2"),
        F.min(mean).alias("sample_mean_min"),
        F.max(mean).alias("sample_mean_max"),
        F.when(n > 1, F.stddev_samp(mean)).alias("sample_mean_sample_std"),
        F.when(n > 1, F.stddev_samp(mean) / F.sqrt(n)).alias("sample_mean_sem"),
    )
    pooled = merge(samples, group, *each).withColumnsRenamed({"mean": "pooled_mean", "m2": "pooled_m2", "observations": "documents", "_observations": "observations"})
    return pooled.withColumn("pooled_std", _deviation(F.col("pooled_m2"), F.col("finite_count")))


def overflowing(parts: DataFrame) -> Column:
    """Whether finite values gave a mean or squares that are not: such moments are left out, not kept as null or infinite."""
    return (F.col("finite_count") > 0) & ~F.coalesce(is_finite(F.col("mean")) & is_finite(F.col("m2")), F.lit(False))


def recorded(parts: DataFrame, keys: list[str], reason: str = "moment_overflow") -> tuple[DataFrame, DataFrame]:
    """(the moments that may be kept, how many were left out by keys and reason)."""
    out = parts.where(overflowing(parts)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).withColumn("reason", F.lit(reason))
    return parts.where(~overflowing(parts)), out


def observe_arrays(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Moments of each row's array, taken within the row: nothing is shuffled."""
    x = F.transform(array, lambda v: v.cast("double"))
    out = df.select(*keys, x.alias("_x")).withColumn("_f", F.filter("_x", is_finite))
    n = F.size("_f")
    mean = F.when(n > 0, F.aggregate("_f", F.lit(0.0), lambda s, v: s + v) / n)
    out = out.withColumn("mean", mean)
    m2 = F.when(n > 0, F.aggregate("_f", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))))
    counts = {"nan": F.isnan, "posinf": lambda v: v == float("inf"), "neginf": lambda v: v == float("-inf")}
    return out.select(*keys, F.size("_x").cast("long").alias("count"), n.cast("long").alias("finite_count"), *(F.size(F.filter("_x", f)).cast("long").alias(k) for k, f in counts.items()), "mean", m2.alias("m2"), F.array_min("_f").alias("min"), F.array_max("_f").alias("max"))


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What a trace tells of a tensor: non-finite counts, then min, max, mean, std and the lower median of the finite."""
    x = F.col(value).cast("double")
    finite = F.when(is_finite(x), x)
    out = df.groupBy(*keys).agg(F.count_if(F.isnan(x)).alias("nan"), F.count_if(F.abs(x) == float("inf")).alias("inf"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"))
    # Groups without a finite value have no median.
    middle = lower_median(df.withColumn("_finite", finite), keys, "_finite").select(F.struct(*keys).alias("_k"), "median")
    return out.withColumn("_k", F.struct(*keys)).join(middle, "_k", "left").drop("_k")


def axis_moments(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Moments per place of an array column: keys, axis_index and the moments."""
    return moments(df.select(*keys, F.posexplode(array).alias("axis_index", "_value")), [*keys, "axis_index"], "_value")


def extremes(df: DataFrame, keys: list[str], array: str, k: int, features: int | None = None) -> DataFrame:
    """The k finite elements of largest magnitude per row: flat place, signed value, rank from 0; the first place wins a tie.

    With the number of features in a position, the position and feature of
    each too. Each row's array is ranked in place, so nothing is shuffled.
    """
    held = F.transform(F.col(array), lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("order"), i.alias("place"), x.cast("double").alias("value")))
    place = [] if features is None else [F.floor(F.col("s.place") / features).alias("position"), (F.col("s.place") % features).alias("feature")]
    top = F.slice(F.array_sort(F.filter(held, lambda s: is_finite(s["value"]))), 1, k)
    return df.select(*keys, F.posexplode(top).alias("abs_rank", "s")).select(*keys, "abs_rank", F.col("s.place").alias("flat_index"), *place, F.col("s.value").alias("value"))


def coverage(modules: DataFrame, observations: DataFrame, exclusions: DataFrame, key: str = "module") -> DataFrame:
    """Every module with its numbers of observations, of the calls they come from and of exclusions, 0 without any."""
    calls = [F.countDistinct("call").alias("call_count")] if "call" in observations.columns else []
    seen = observations.groupBy(key).agg(F.count(F.lit(1)).alias("observation_count"), *calls)
    out = exclusions.groupBy(key).agg(F.sum("count").alias("exclusion_count"))
    return modules.join(seen, key, "left").join(out, key, "left").fillna(0, ["observation_count", "exclusion_count", *["call_count"] * len(calls)])


def exclusion_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def metric_mean_and_error(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and standard error of a metric; no error for a single value."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("stderr"))


def running_rank(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
