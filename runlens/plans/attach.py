"""How documents of several runs are paired: a mapping, their position, or a field, by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import pairing

#: Why a document is left out, in the order in which it is told.
EXCLUSIONS = ("unmapped", "duplicate_mapping_rows", "many_to_one", "counterpart_many_to_one", "no_identity_field", "strict_no_identity", "not_in_every_language")


def attach_pairing(docs: DataFrame, fields: DataFrame | None = None, mapping: DataFrame | None = None, pair_on: str | None = None, strict: bool = False) -> tuple[DataFrame, str]:
    """(rows run, doc, pair_key, pairing_status; the kind of pairing) of rows (run, doc) or (run, doc, position).

    A mapping comes first, then "position" if it is asked for, then the named
    field, then the field that qualifies; several that qualify are ambiguous
    and refused unless they have the same values in every run, where the first
    stands for all; with none, documents pair by position or not at all where
    strict. Their position is ``position``, or else their own id.
    """
    if mapping is not None and pair_on is not None:
        raise ValueError("a mapping and a field cannot both be given")
    if strict and pair_on == "position":
        raise ValueError("strict pairing and pairing by position cannot both be asked for")
    if mapping is not None:
        out = pairing.mapped(docs, mapping, "run", "doc", "canonical")
        return out.withColumnRenamed("canonical", "pair_key"), "mapping"
    kind, chosen = "position", None
    if pair_on != "position" and fields is not None:
        good = sorted(r.field for r in pairing.field_report(fields, "run", "field", "value").where("qualifies").select("field").collect())
        if pair_on is not None:
            if pair_on not in good:
                raise ValueError(f"{pair_on} does not pair the documents; these do: {', '.join(good) or 'none'}")
            good = [pair_on]
        if len(good) > 1 and pairing.same_fields(fields.where(F.col("field").isin(*good)), "run", "field", "value"):
            good = good[:1]
        if len(good) > 1:
            raise ValueError(f"several fields pair the documents: {', '.join(good)}")
        if good:
            kind, chosen = "field", good[0]
    if chosen is None and strict:
        # Nothing identifies a document, and its position may not.
        return docs.select("run", "doc", F.lit(None).cast("string").alias("pair_key"), F.lit("strict_no_identity").alias("pairing_status")), "none"
    if chosen is None:
        keyed = docs.select("run", "doc", F.col("position" if "position" in docs.columns else "doc").cast("string").alias("pair_key"))
    else:
        keyed = docs.select("run", "doc").join(fields.where(F.col("field") == chosen).select("run", "doc", F.col("value").alias("pair_key")), ["run", "doc"], "left")
    shared = pairing.shared_by_all(keyed, "run", "pair_key").withColumn("_shared", F.lit(True))
    out = keyed.join(shared, "pair_key", "left")
    status = F.when(F.col("_shared"), "paired").when(F.col("pair_key").isNull(), "no_identity_field").otherwise("not_in_every_language")
    return out.select("run", "doc", "pair_key", status.alias("pairing_status")), kind


def answer_statuses(paired: DataFrame, gold: DataFrame) -> DataFrame:
    """(pair_key, answer_status) of the paired documents of which every run tells the gold answer, by that evidence (run, doc, gold)."""
    rows = paired.where("pairing_status = 'paired'").join(gold, ["run", "doc"], "left")
    return pairing.answer_status(rows, "pair_key", "run", "gold")


def pairing_table(paired: DataFrame, gold: DataFrame, series: DataFrame, kind: str, field: str | None = None, mapping_sha256: str | None = None, label: str = "A") -> DataFrame:
    """A row per graded document of every run: whether and how it pairs, why not, and what its answer key tells.

    ``paired`` is (run, doc, task_name, doc_id, pair_key, pairing_status),
    ``gold`` (run, doc, gold) with evidence as kind:value, ``series`` (run,
    series, model, num_fewshot, language). Pairing and answers are told apart:
    a paired document may have an answer key that disagrees.
    """
    rows = paired.join(gold, ["run", "doc"], "left")
    rows = rows.join(answer_statuses(paired, gold), "pair_key", "left").join(series, "run", "left")
    is_paired = F.col("pairing_status") == "paired"
    return rows.select(
        F.lit(label).alias("group"), "model", "num_fewshot", "series", "language", F.col("run").alias("run_path"), "task_name", "doc_id", F.lit(kind).alias("pairing_source"),
        F.lit(field).cast("string").alias("pairing_field"), F.lit(mapping_sha256).cast("string").alias("mapping_sha256"), F.col("pair_key").alias("canonical_doc_id"),
        F.when(is_paired, "paired").otherwise("excluded").alias("pairing_status"), F.when(~is_paired, F.col("pairing_status")).alias("exclusion_reason"),
        F.substring_index("gold", ":", 1).alias("gold_evidence"), F.when(F.col("gold").isNotNull(), F.expr("substr(gold, locate(':', gold) + 1)")).alias("gold_value"),
        F.when(is_paired, F.coalesce("answer_status", F.lit("no_gold_evidence"))).alias("answer_status"),
    )


def comparable_keys(table: DataFrame, statuses: DataFrame, assume_aligned: bool = False) -> DataFrame:
    """Keys of a pairing table whose documents may be compared across languages.

    Where the group is aligned these are all paired keys but those whose
    answers disagree or cannot be checked; all of them where alignment is
    asserted of another group, else none.
    """
    shared = table.where("pairing_status = 'paired'").select(F.col("canonical_doc_id").alias("pair_key")).distinct()
    refused = statuses.where(F.col("answer_status").isin("disagree", "unverifiable")).select("pair_key", F.lit(True).alias("refused"))
    out = shared.join(refused, "pair_key", "left").join(F.broadcast(pairing.alignment(statuses).select("aligned")), F.lit(True))
    keep = F.col("aligned") & F.col("refused").isNull()
    return out.where(keep | ~F.col("aligned") if assume_aligned else keep).select("pair_key")


def coverage(table: DataFrame) -> DataFrame:
    """Per series: its documents, how many are paired and a map of what excludes the others."""
    counts = table.groupBy("group", "series", "run_path", F.coalesce("exclusion_reason", F.lit("paired")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    excluded = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("outcome") != "paired", F.struct("outcome", "n")))))
    return counts.groupBy("group", "series", "run_path").agg(F.sum("n").alias("documents"), F.sum(F.when(F.col("outcome") == "paired", F.col("n")).otherwise(0)).alias("paired"), excluded.alias("excluded"))


def evidence_kinds(gold: DataFrame) -> DataFrame:
    """How many documents tell their gold answer by which kind of evidence."""
    return gold.where("gold IS NOT NULL").groupBy(F.substring_index("gold", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def provenance(table: DataFrame) -> DataFrame:
    """Per run: documents by what excludes them, or by what their answers tell."""
    return table.groupBy("run_path", F.coalesce("exclusion_reason", "answer_status", F.lit("paired")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
