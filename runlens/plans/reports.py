"""The analyses end to end: comparison, pairing, examples and module statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalar import doc_key, relative_depth
from runlens.operators import docs as documents
from runlens.operators import moments, pairing, runs, signals
from runlens.plans import attach
from runlens.schema import AXIS_GROUP, GROUP, TABLES


def partition_runs(candidates: DataFrame, schema_version: str, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grouped runs, groups, excluded runs with reasons)."""
    screened = runs.screen(candidates, schema_version)
    fit = screened.where("reason IS NULL").drop("reason")
    groups = runs.labelled_groups(fit, by)
    return fit.join(groups.select(*by, "label"), by), groups, screened.where("reason IS NOT NULL")


#: The signals of a comparison (fixed values): table, column, layer column, layer domain.
COMPARISON = (
    ("signals", "lens_prob", "layer", "residual"),
    ("signals", "target_percentile", "layer", "residual"),
    ("signals", "target_rank", "layer", "residual"),
    ("similarity", "cos", "layer_i", "pair"),
    ("attn_norm", "value_norm", "block", "block"),
)


def comparison_report(tables: dict[str, DataFrame], runs_: DataFrame) -> DataFrame:
    """Depth curves of all grouped runs, every signal of COMPARISON that a run has.

    ``tables`` holds signals, similarity and attn_norm with the path of each
    row's run; ``runs_`` (run, label, n_blocks, mixed_vocab). Similarity
    counts between neighbouring layers only. Signals tied to a vocabulary are
    left out of groups where vocabularies mix.
    """
    parts = []
    for table, column, index, domain in COMPARISON:
        rows = tables[table]
        rows = signals.adjacent(rows) if table == "similarity" else rows
        if not TABLES[table][column].metadata["comparable_across_vocab"]:
            rows = rows.join(F.broadcast(runs_.where("NOT mixed_vocab").select("run")), "run", "left_semi")
        long = rows.select("run", F.col(index).alias("layer_index"), F.col(column).cast("double").alias("value"))
        curve = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("run", "layer_index").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_rows"))
        parts.append(curve.withColumn("signal", F.lit(column)).withColumn("layer_domain", F.lit(domain)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # A row per run of one report.
    out = out.join(F.broadcast(runs_), "run")
    depth_domain = F.when(F.col("layer_domain") == "residual", "residual").otherwise("block")
    return out.withColumn("relative_depth", relative_depth(F.col("layer_index"), F.col("n_blocks"), depth_domain))


def pairing_report(docs: DataFrame, series: DataFrame, fields: DataFrame | None = None, mapping: DataFrame | None = None, pair_on: str | None = None, strict: bool = False, mapping_sha256: str | None = None, label: str = "A") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the pairing table, the alignment, the statuses by pair key) of the documents of one group's runs.

    ``docs`` has the columns of the table of documents and run; ``mapping``
    (run, doc, canonical, choice_ids, answer_id) brings canonical ids.
    ``series`` (run, series, model, num_fewshot, language) may have declared,
    the task that a run's language was declared by: a document's position is
    its number and what its own task's name has after that.
    """
    rows = docs.withColumn("doc", F.concat_ws("#", "task_name", F.col("doc_id").cast("string")))
    each = rows.groupBy("run", "doc").agg(F.min("task_name").alias("task_name"), F.min("doc_id").alias("doc_id"))
    declared = series.select("run", "declared") if "declared" in series.columns else series.select("run", F.lit("").alias("declared"))
    placed = each.join(declared, "run", "left").select("run", "doc", doc_key(F.col("task_name"), F.col("doc_id"), F.coalesce("declared", F.lit(""))).alias("position"))
    paired, kind = attach.attach_pairing(placed, fields, mapping.select("run", "doc", "canonical") if mapping is not None else None, pair_on, strict)
    gold = pairing.choices_of_documents(rows)
    if mapping is None:
        gold = pairing.gold_positions(gold, ["run", "doc"])
    else:
        gold = pairing.gold_positions(gold.join(mapping.select("run", "doc", "choice_ids", "answer_id").dropDuplicates(["run", "doc"]), ["run", "doc"], "left"), ["run", "doc"], F.col("choice_ids"), F.col("answer_id"))
    table = attach.pairing_table(paired.join(each, ["run", "doc"]), gold, series.drop("declared"), kind, pair_on if kind == "field" else None, mapping_sha256, label)
    status = attach.answer_statuses(paired, gold)
    return table, pairing.alignment(status), status


def settled(rows: DataFrame, docs: DataFrame, n_blocks: DataFrame) -> DataFrame:
    """(run, task_name, doc_id, settle_depth): where in its own blocks each run settled on a document.

    ``rows`` are signals with run, ``n_blocks`` (run, n_blocks). Only rows of
    the target choice count in runs whose ``docs`` mark one; the last choice
    and step tell the document's depth.
    """
    targets = docs.where("is_target_choice").select("run", "task_name", "doc_id", "choice_idx", F.lit(True).alias("is_target")).distinct()
    rows = rows.join(targets, ["run", "task_name", "doc_id", "choice_idx"], "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    rows = signals.target_rows(rows, ["run"], "is_target").join(F.broadcast(n_blocks), "run")
    depth = signals.prediction_depth(rows, ["run", "n_blocks", "task_name", "doc_id", "choice_idx", "step"], "layer", "lens_token_id", F.coalesce("n_blocks", F.lit(0)))
    return signals.document_depth(depth, ["run", "task_name", "doc_id"], ["choice_idx", "step"]).withColumnRenamed("depth", "settle_depth")


def _buckets(docs: DataFrame, keys: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys that compare, and the bucket of each key."""
    held = docs.join(keys.distinct(), "key", "left_semi")
    verdicts = documents.last_verdicts(held, ["run", "key"], "is_correct", "choice_idx")
    return held, pairing.agreement(verdicts, "key", "run", "is_correct", reference)


def examples_report(docs: DataFrame, keys: DataFrame, reference: str, depths: DataFrame | None = None, per_bucket: int = 3, about: DataFrame | None = None, axis: str = "model") -> DataFrame:
    """What every run made of a few documents of each bucket, where it settled, and which run is the reference.

    ``docs`` has the columns of the table of documents, run and key; ``keys``
    (key) are those that compare; ``about`` (run, series, model, language,
    n_blocks, tasks) tells of the runs, and ``axis`` what they differ by.
    """
    held, buckets = _buckets(docs, keys, reference)
    chosen = pairing.stratified(buckets.where("bucket <> 'mixed'"), ["bucket"], "key", per_bucket)
    answers = documents.first_answers(held, ["run", "key"], ["task_name", "doc_id", "predicted", "target", "is_correct"], "choice_idx")
    out = pairing.example_rows(chosen, held.select("run"), answers, depths).withColumn("is_reference", F.col("run") == reference)
    if about is None:
        return out
    # A run's tasks stand in where it has no answer to the document.
    out = out.join(F.broadcast(about), "run", "left").withColumn("run_task", F.coalesce("task_name", F.array_join("tasks", "+"))).drop("tasks")
    return out.withColumn("axis", F.lit(axis))


def draw(docs: DataFrame, keys: DataFrame, reference: str, per_bucket: int = 3) -> DataFrame:
    """How the examples were drawn: per bucket its documents and how many were taken; mixed ones are never taken."""
    _, buckets = _buckets(docs, keys, reference)
    pools = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("pool"))
    return pools.withColumn("taken", F.when(F.col("bucket") == "mixed", 0).otherwise(F.least("pool", F.lit(per_bucket))))


def module_statistics(observations: DataFrame, forwards: DataFrame, axis_stats: DataFrame | None = None) -> dict[str, DataFrame]:
    """samples and dataset, and the same per axis where axis statistics were kept."""
    samples = moments.pool_calls(observations, forwards, GROUP)
    out = {"samples": samples, "dataset": moments.pool_documents(samples, GROUP)}
    if axis_stats is not None:
        axis = moments.pool_calls(axis_stats, forwards, AXIS_GROUP)
        out |= {"axis_samples": axis, "axis_dataset": moments.pool_documents(axis, AXIS_GROUP)}
    return out
