"""Which documents of one run correspond to which of another, and what the runs make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalar import stripped
from runlens.operators.docs import choices_of


#: Seed of the draw of examples.
SEED = 1234


def shared_by_all(docs: DataFrame, run: str, key: str) -> DataFrame:
    """Keys that every run has."""
    n_runs = docs.select(run).distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    held = docs.groupBy(key).agg(F.countDistinct(run).alias("n"))
    return held.join(F.broadcast(n_runs), F.col("n") == F.col("n_runs")).select(key)


def field_report(values: DataFrame, run: str, field: str, value: str) -> DataFrame:
    """Per field of long rows (run, doc, field, value): whether it pairs documents.

    It does if every document of every run has it, it is unique within each
    run and all runs have the same values.
    """
    n_docs = values.groupBy(run).agg(F.countDistinct("doc").alias("n_docs"))
    each = values.where(F.col(value).isNotNull()).groupBy(run, field).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("n_values"), F.sum(F.xxhash64(value).cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(F.xxhash64(value)).alias("xor_hash"))
    each = each.join(n_docs, run)
    n_runs = values.select(run).distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    out = each.groupBy(field).agg(
        F.count(F.lit(1)).alias("in_runs"), F.bool_and(F.col("n") == F.col("n_docs")).alias("everywhere"), F.bool_and(F.col("n_values") == F.col("n")).alias("is_unique"),
        ((F.countDistinct("n_values") == 1) & (F.countDistinct("sum_hash") == 1) & (F.countDistinct("xor_hash") == 1)).alias("same_values"),
    ).join(F.broadcast(n_runs), F.lit(True))
    return out.select(field, "everywhere", "is_unique", "same_values", (F.col("everywhere") & F.col("is_unique") & F.col("same_values") & (F.col("in_runs") == F.col("n_runs"))).alias("qualifies"))


def same_fields(values: DataFrame, run: str, field: str, value: str) -> bool:
    """Whether fields of long rows (run, doc, field, value) all have the same values in each run, however often."""
    hash_ = F.xxhash64(value)
    each = values.groupBy(run, field).agg(F.count(value).alias("n"), F.sum(hash_.cast("decimal(38,0)")).alias("total"), F.bit_xor(hash_).alias("mixed"))
    return each.groupBy(run).agg(F.countDistinct("n", "total", "mixed").alias("kinds")).where("kinds > 1").limit(1).count() == 0


def mapped(docs: DataFrame, mapping: DataFrame, run: str, doc: str, canonical: str) -> DataFrame:
    """Documents with their canonical id and status by a mapping (run, doc, canonical).

    unmapped; duplicate_mapping_rows where a document has several rows;
    many_to_one where several documents of a run have one canonical id;
    counterpart_many_to_one where that is so in another run;
    not_in_every_language where a run lacks it; else paired.
    """
    rows = mapping.groupBy(run, doc).agg(F.count(F.lit(1)).alias("n_rows"), F.min(canonical).alias(canonical))
    held = docs.select(run, doc).distinct().join(rows, [run, doc], "left")
    single = held.where("n_rows = 1")
    per_run = single.groupBy(run, canonical).agg(F.count(F.lit(1)).alias("n_docs"))
    per_id = per_run.groupBy(canonical).agg(F.count(F.lit(1)).alias("in_runs"), F.max("n_docs").alias("most_docs"))
    n_runs = docs.select(run).distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    out = held.join(per_run, [run, canonical], "left").join(per_id, canonical, "left").join(F.broadcast(n_runs), F.lit(True))
    status = F.when(F.col("n_rows").isNull(), "unmapped").when(F.col("n_rows") > 1, "duplicate_mapping_rows").when(F.col("n_docs") > 1, "many_to_one").when(F.col("most_docs") > 1, "counterpart_many_to_one").when(F.col("in_runs") < F.col("n_runs"), "not_in_every_language").otherwise("paired")
    return out.select(run, doc, F.when(F.col("n_rows") == 1, F.col(canonical)).alias(canonical), status.alias("pairing_status"))


def evidence(choice_idx: Column, choice_ids: Column, answer_id: Column, target: Column, invalid: Column | None = None) -> Column:
    """What tells the gold answer, as kind:value: the named choice, its place, an answer id or the target's text."""
    named = F.try_element_at(choice_ids, choice_idx + 1)
    out = F.when(F.lit(False) if invalid is None else invalid, F.lit("invalid:canonical_choice_ids_do_not_match_choices")).when(named.isNotNull(), F.concat(F.lit("choice_id:"), named))
    return out.when(choice_idx.isNotNull(), F.concat(F.lit("choice:"), choice_idx.cast("string"))).when(answer_id.isNotNull(), F.concat(F.lit("answer_id:"), answer_id)).when(target.isNotNull(), F.concat(F.lit("target:"), stripped(target)))


def choices_of_documents(docs: DataFrame) -> DataFrame:
    """choices_of() for the table of documents with run and doc."""
    return choices_of(docs, ["run", "doc"], "choice_idx", "is_target_choice", "target")


def gold_positions(choices: DataFrame, keys: list[str], choice_ids: Column | None = None, answer_id: Column | None = None) -> DataFrame:
    """(keys, gold) of rows that choices_of() gives: where the gold answer is, by canonical ids where a mapping has them.

    Ids that repeat, or do not fit the document's choices one to one, are
    invalid; a document without a gold choice tells its target only if it is
    a single row, else nothing.
    """
    ids = F.lit(None).cast("array<string>") if choice_ids is None else choice_ids
    wrong = ids.isNotNull() & ~(F.col("is_whole") & (F.size(ids) == F.col("n_choices")) & (F.size(F.array_distinct(ids)) == F.size(ids)))
    gold = evidence(F.col("gold_choice"), ids, F.lit(None).cast("string") if answer_id is None else answer_id, F.col("target"), F.col("gold_choice").isNotNull() & wrong)
    return choices.where(F.col("gold_choice").isNotNull() | (F.col("n_rows") == 1)).select(*keys, gold.alias("gold"))


def mapping_of_runs(mapping: DataFrame, datasets: DataFrame) -> DataFrame:
    """Mapping rows with the run that each language names: a data set's label or its task, the first in order.

    ``datasets`` has run, label, task and nth. Languages that name none are left out.
    """
    names = datasets.select("run", "nth", F.explode(F.array(F.struct(F.col("label").alias("language"), F.lit(0).alias("kind")), F.struct(F.col("task").alias("language"), F.lit(1).alias("kind")))).alias("n")).select("run", "nth", "n.*")
    first = names.groupBy("language").agg(F.min_by("run", F.struct("nth", "kind")).alias("run"))
    return mapping.join(first, "language")


def answer_status(rows: DataFrame, key: str, run: str, gold: str) -> DataFrame:
    """Per key of which every run of ``rows`` tells the gold answer: agree, disagree or unverifiable by that evidence (kind:value).

    A key that a run tells nothing of has no status, and neither has any where
    a whole run tells nothing.
    """
    n_runs = rows.select(run).distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    kind = F.substring_index(gold, ":", 1)
    each = rows.where(F.col(gold).isNotNull()).groupBy(key).agg(F.countDistinct(run).alias("n"), F.countDistinct(gold).alias("n_values"), F.countDistinct(kind).alias("n_kinds"), F.count_if(kind == "invalid").alias("n_bad"))
    each = each.join(F.broadcast(n_runs), F.col("n") == F.col("n_runs"))
    status = F.when((F.col("n_bad") > 0) | (F.col("n_kinds") > 1), "unverifiable").when(F.col("n_values") > 1, "disagree").otherwise("agree")
    return each.select(key, status.alias("answer_status"))


def alignment(status: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Counts, the share of agreement among keys that can be checked (0 without any), and whether it reaches the threshold: one row."""
    n = {s: F.count_if(F.col("answer_status") == s) for s in ("agree", "disagree", "unverifiable")}
    rate = F.coalesce(n["agree"] / F.nullif(n["agree"] + n["disagree"], F.lit(0)), F.lit(0.0))
    return status.agg(F.count(F.lit(1)).alias("shared"), *(c.alias(s) for s, c in n.items()), rate.alias("rate"), (rate >= threshold).alias("aligned"))


def agreement(verdicts: DataFrame, key: str, run: str, correct: str, reference: str) -> DataFrame:
    """Keys that all runs judged, in five buckets by the reference run against the others."""
    n_runs = verdicts.select(run).distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    is_ref = F.col(run) == reference
    each = verdicts.where(F.col(correct).isNotNull()).groupBy(key).agg(F.countDistinct(run).alias("n"), F.bool_or(F.when(is_ref, F.col(correct))).alias("ref"), F.bool_and(F.when(~is_ref, F.col(correct))).alias("all_others"), F.bool_or(F.when(~is_ref, F.col(correct))).alias("any_other"))
    each = each.join(F.broadcast(n_runs), F.col("n") == F.col("n_runs"))
    ref, every, some = F.col("ref"), F.coalesce(F.col("all_others"), F.lit(True)), F.coalesce(F.col("any_other"), F.lit(False))
    bucket = F.when(ref & every, "all_correct").when(~ref & ~some, "all_wrong").when(ref & ~some, "only_reference").when(~ref & every, "only_others").otherwise("mixed")
    return each.select(key, bucket.alias("bucket"))


def same_prompts(docs: DataFrame, key: str, run: str, prompt_hash: str) -> DataFrame:
    """Keys whose prompt is identical in every run."""
    n_runs = docs.select(run).distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    each = docs.where(F.col(prompt_hash) != "").groupBy(key).agg(F.countDistinct(run).alias("n"), F.countDistinct(prompt_hash).alias("n_hashes"))
    return each.join(F.broadcast(n_runs), F.col("n") == F.col("n_runs")).where("n_hashes = 1").select(key)


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows of each stratum, by the order of a seeded hash of their keys."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).where(F.col("_nth") <= n).drop("_nth")


def coverage_counts(table: DataFrame, series: str, status: str) -> DataFrame:
    return table.groupBy(series, status).agg(F.count(F.lit(1)).alias("n"))


def new_work(asked: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """What is asked for and not recorded yet."""
    return asked.join(recorded.select(*keys), keys, "left_anti")


def example_rows(chosen: DataFrame, runs: DataFrame, answers: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Every chosen document (bucket, key) with every run: what it answered and where it settled, nulls where it has neither.

    ``chosen`` is a few documents of each bucket and ``runs`` a few runs, so
    each document is given the list of runs and laid out.
    """
    every = runs.agg(F.array_sort(F.collect_set("run")).alias("_runs"))
    out = chosen.join(F.broadcast(every), F.lit(True)).withColumn("run", F.explode("_runs")).drop("_runs").join(answers, ["run", "key"], "left")
    return out if depths is None else out.join(depths, ["run", "key"], "left")
