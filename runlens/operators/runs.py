"""Which runs may be compared: screening, grouping, scores and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.checks import reasons


def majority(df: DataFrame, value: str, order: str) -> DataFrame:
    """The most frequent value, the one met first among equals: one row."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(1).select(F.col(value).alias("majority"))


def screen(runs: DataFrame, schema_version: str, versions: str = "reducer_versions", order: str = "path") -> DataFrame:
    """Runs with the reason why each may not be compared, null if it may; the majority is of completed runs of this schema."""
    fit = runs.where(F.col("completed") & (F.col("schema_version") == schema_version))
    most = majority(fit, versions, order)
    joined = runs.join(F.broadcast(most), F.lit(True), "left")
    return joined.withColumn("reason", reasons((~F.coalesce(F.col("completed"), F.lit(False)), "not completed"), (~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "another schema version"), (~F.col(versions).eqNullSafe(F.col("majority")), "reducer versions of a minority"))).drop("majority")


def groups_of_runs(runs: DataFrame, by: list[str], vocab: str = "vocab_size") -> DataFrame:
    """Groups of runs equal in ``by``: size and whether vocabularies mix."""
    groups = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct(vocab).alias("n_vocab"))
    return groups.withColumn("mixed_vocab", F.col("n_vocab") > 1)


def labelled_groups(runs: DataFrame, by: list[str], vocab: str = "vocab_size") -> DataFrame:
    """The groups of one report with their letter, A for the largest; after Z come AA, AB and so on."""
    # A report has a handful of groups: the window over all of them is small.
    nth = F.row_number().over(Window.orderBy(F.desc("n_runs"), *by)) - 1
    letter = F.concat(F.when(nth >= 26, F.char(64 + F.floor(nth / 26))).otherwise(""), F.char(65 + nth % 26))
    return groups_of_runs(runs, by, vocab).withColumn("label", letter)


def language_groups(runs: DataFrame, by: list[str], task: str) -> DataFrame:
    """Runs of one model over several declared tasks; groups with fewer than two tasks are no comparison."""
    return runs.groupBy(*by).agg(F.countDistinct(task).alias("n_datasets"), F.count(F.lit(1)).alias("n_runs")).where("n_datasets >= 2")


def vocab_gate(signals: DataFrame, groups: DataFrame, columns: DataFrame, key: list[str]) -> DataFrame:
    """Signals (key, signal) that may be compared: where vocabularies mix, only those that do not depend on one."""
    return signals.join(groups.select(*key, "mixed_vocab"), key).join(F.broadcast(columns), "signal").where(F.col("comparable") | ~F.col("mixed_vocab")).drop("mixed_vocab", "comparable")


def headline_scores(results: DataFrame, keys: list[str], metric: str, value: str, preferred: tuple[str, ...] = ("acc_norm", "acc", "exact_match")) -> DataFrame:
    """One score per run: the mean over the rows of its most preferred metric; stderr rows and keys without a filter are skipped.

    ``metric`` holds metric,filter; all filters of a metric are averaged.
    """
    rows = results.where(F.contains(F.col(metric), F.lit(",")) & ~F.contains(F.col(metric), F.lit("stderr"))).withColumn("_m", F.substring_index(metric, ",", 1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("_m")), F.lit(0)), F.lit(len(preferred) + 1))
    each = rows.groupBy(*keys, "_m").agg(F.avg(value).alias("score"), F.min(rank).alias("_rank"))
    return each.groupBy(*keys).agg(F.min_by(F.struct(F.col("_m").alias("metric"), "score"), F.struct("_rank", "_m")).alias("s")).select(*keys, "s.*")


def protocol_scores(results: DataFrame, protocols: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, score, higher) of runs that declare a protocol: the declared metric and filter of their only task, else null, and whether more of it is better.

    ``results`` is (run, task, metric, value) with metric,filter names,
    ``protocols`` (run, task, primary_metric, primary_filter, higher_is_better,
    which null means true), ``runs`` (run, tasks). Runs without a protocol are left out: headline_scores() has theirs.
    """
    single = runs.join(protocols.select("run").distinct(), "run", "left_semi").select("run", F.when(F.size("tasks") == 1, F.get("tasks", F.lit(0))).alias("task"))
    wanted = single.join(protocols, ["run", "task"], "left").withColumn("metric", F.concat_ws(",", "primary_metric", "primary_filter"))
    return wanted.join(results, ["run", "task", "metric"], "left").select("run", F.col("value").alias("score"), F.coalesce("higher_is_better", F.lit(True)).alias("higher"))


def named_reference(runs: DataFrame, group: list[str], series: str, text: str) -> DataFrame:
    """The run of each group whose series contains a text; more or fewer than one is an error."""
    found = runs.where(F.contains(series, F.lit(text)))
    if bad := runs.select(*group).distinct().join(found.groupBy(*group).count(), group, "left").where("count IS NULL OR count <> 1").take(1):
        raise ValueError(f"{text!r} names {bad[0]['count'] or 0} runs of {bad[0].asDict()}")
    return found


def reference_runs(scores: DataFrame, group: list[str], score: str, run: str, higher: Column | bool = True) -> DataFrame:
    """The best run of each group; the first run among equals, runs without a score last."""
    signed = F.when(F.lit(higher) if isinstance(higher, bool) else higher, F.col(score)).otherwise(-F.col(score))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(signed.desc_nulls_last(), run))
    return scores.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def series_names(runs: DataFrame, group: list[str], label: str, run: str) -> DataFrame:
    """Labels, with the run's name added where a group repeats one."""
    times = F.count(F.lit(1)).over(Window.partitionBy(*group, label))
    return runs.withColumn("series", F.when(times > 1, F.concat(F.col(label), F.lit(" ("), F.col(run), F.lit(")"))).otherwise(F.col(label)))


def parse_datasets(text: str) -> list[tuple[str, str]]:
    """LANG=TASK,...: at least two, none repeated; a bare name labels itself."""
    out = [((p.partition("=")[0] or p).strip(), (p.partition("=")[2] or p).strip()) for p in text.split(",") if p.strip()]
    if len(out) < 2 or len({a for a, _ in out}) < len(out) or len({b for _, b in out}) < len(out):
        raise ValueError("two or more data sets are needed, each named once")
    return out
