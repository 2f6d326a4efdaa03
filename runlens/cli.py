"""Command line: python -m runlens.cli report | module-stats | debug."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.scalar import task_doc
from runlens.operators import collect, pairing, runs, trace
from runlens.operators import docs as documents
from runlens.plans import attach, reports
from runlens.schema import SCHEMA_VERSION
from runlens.sources import runs as source

#: Columns of a run that its manifest holds, as paths into it.
_MANIFEST = {"completed": "boolean", "reducers": "string", "tasks": "array<string>", "doc_id_set_hash": "string", "vocab_size": "long", "n_blocks": "int", "model_id": "string", "num_fewshot": "int", "benchmarks": "string"}
#: Columns of a statistics report (fixed values).
_STATISTICS = ("task_name", "module", "io", "tensor_path", "stage", "layout")
_OF_DOCUMENT = ("doc_id", "count", "finite_count", "mean", "std", "min", "max", "nan", "posinf", "neginf")
_OF_DATASET = ("documents", "finite_count", "sample_mean", "sample_mean_std", "pooled_mean", "pooled_std", "nan", "posinf", "neginf", "finite_documents", "sample_mean_m2", "sample_mean_sample_std", "sample_mean_sem")
_EVENT = "i long, event string, module string, forward long, call long, phase string, depth long, args string, samples array<struct<task_name:string,doc_id:long,choice_idx:int>>"


def _runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = source.discover_runs(spark, *paths)
    held = found.select("path", "schema_version", "results", *(F.try_variant_get("manifest", f"$.{k}", t).alias(k) for k, t in _MANIFEST.items()))
    return held.withColumnRenamed("reducers", "reducer_versions").withColumn("benchmarks", F.coalesce("benchmarks", F.lit("{}")))


def _scores(fit: DataFrame) -> DataFrame:
    """(run, score, higher): by the declared protocol where a run has one, else its preferred metric over the tasks it asked for."""
    long = fit.select(F.col("path").alias("run"), "tasks", F.explode("results").alias("task", "metrics")).select("run", "tasks", "task", F.explode("metrics").alias("metric", "value"))
    asked = long.where(F.array_contains("tasks", F.col("task")))
    rows = asked.unionByName(long.join(asked.select("run").distinct(), "run", "left_anti"))
    protocols = fit.select(F.col("path").alias("run"), F.explode(F.from_json(F.get_json_object("benchmarks", "$.protocols"), "map<string,struct<primary_metric:string,primary_filter:string,higher_is_better:boolean>>")).alias("task", "p")).select("run", "task", "p.*")
    declared = runs.protocol_scores(long, protocols, fit.select(F.col("path").alias("run"), "tasks"))
    others = runs.headline_scores(rows.join(protocols.select("run").distinct(), "run", "left_anti"), ["run"], "metric", "value").select("run", "score", F.lit(True).alias("higher"))
    return declared.unionByName(others)


def _series(fit: DataFrame, datasets: list[tuple[str, str]] | None) -> DataFrame:
    """Grouped runs with language and series: the model, or the language where runs differ by it."""
    if not datasets:
        return runs.series_names(fit.withColumn("language", F.lit(None).cast("string")), ["label"], "model_id", "path")
    names = F.create_map(*(F.lit(x) for label, task in datasets for x in (task, label)))
    return runs.series_names(fit.withColumn("language", F.try_element_at(names, F.get("tasks", F.lit(0)))), ["label"], "language", "path")


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    """Which runs compare and why others do not; then curves, pairing and examples as tables below the output."""
    found, datasets = _runs(spark, args.paths), runs.parse_datasets(args.multilingual) if args.multilingual else None
    if datasets:
        found = found.where((F.size("tasks") == 1) & F.get("tasks", F.lit(0)).isin(*(t for _, t in datasets)))
    by = ["model_id", "num_fewshot"] if datasets else ["tasks", "doc_id_set_hash", "benchmarks"]
    fit, groups, excluded = reports.partition_runs(found, SCHEMA_VERSION, by)
    for r in excluded.select("path", "reason").orderBy("path").collect():
        print(f"left out: {r.path}: {r.reason}")

    def put(df: DataFrame, name: str) -> DataFrame:
        """What several tables below are made of is written once and read again, so that plans stay short."""
        df.write.mode("overwrite").parquet(f"{args.output}/_work/{name}")
        return spark.read.parquet(f"{args.output}/_work/{name}")

    fit, groups = put(_series(fit.join(groups.select("label", "mixed_vocab"), "label"), datasets), "runs"), put(groups, "groups")
    # A report compares a handful of runs: what is asked of each below is a driver's list of paths.
    paths = [r.path for r in fit.select("path").orderBy("path").collect()]
    if not paths:
        raise LookupError("no run can be compared")
    for r in groups.orderBy("label").collect():
        print(f"group {r.label}: {r.n_runs} runs of {', '.join(str(r[k]) for k in by[:1])}" + ("; vocabularies differ" if r.mixed_vocab else ""))
    about = fit.select(F.col("path").alias("run"), "label", "n_blocks", "mixed_vocab", "series", "model_id", "language", "vocab_size")
    tables = {t: source.read_runs_table(spark, paths, t) for t in ("signals", "similarity", "attn_norm")}
    reports.comparison_report(tables, about).write.mode("overwrite").parquet(f"{args.output}/comparison")

    docs = source.read_runs_table(spark, paths, "docs").persist()
    scores = _scores(fit)
    mapping = digest = None
    if args.pair_mapping:
        rows = pairing.mapping_of_runs(source.load_mapping(spark, args.pair_mapping), fit.select(F.col("path").alias("run"), F.col("language").alias("label"), F.get("tasks", F.lit(0)).alias("task"), F.lit(0).alias("nth")))
        mapping = rows.select("run", F.concat_ws("#", "task_name", F.col("doc_id").cast("string")).alias("doc"), F.col("canonical_doc_id").alias("canonical"), F.col("canonical_choice_ids").alias("choice_ids"), F.col("canonical_answer_id").alias("answer_id"))
        digest = source.mapping_digest(spark, args.pair_mapping)
    told, pairs, examples, drawn = [], [], [], []
    for g in groups.select("label").orderBy("label").collect():
        own = fit.where(F.col("label") == g.label)
        held = docs.join(F.broadcast(own.select(F.col("path").alias("run"))), "run", "left_semi")
        candidates = own.select(F.col("path").alias("run"), "label", "series").join(scores, "run", "left")
        best = runs.named_reference(candidates, ["label"], "series", args.reference) if args.reference else runs.reference_runs(candidates, ["label"], "score", "run", F.coalesce("higher", F.lit(True)))
        reference = best.first().run
        task_doc_key = F.concat_ws("#", "task_name", F.col("doc_id").cast("string"))
        if datasets:
            series = own.select(F.col("path").alias("run"), "series", F.col("model_id").alias("model"), "num_fewshot", "language", F.get("tasks", F.lit(0)).alias("declared"))
            own_mapping = mapping.join(own.select(F.col("path").alias("run")), "run", "left_semi") if mapping is not None else None
            table, aligned, status = reports.pairing_report(held, series, _fields(spark, own) if mapping is None else None, own_mapping, args.pair_on, args.pair_strict, digest, g.label)
            table, status = put(table, f"{g.label}/pairing"), put(status, f"{g.label}/answers")
            aligned = pairing.alignment(status)
            pairs.append(table)
            told.append({"group": g.label, "alignment": aligned.first().asDict(), "coverage": [r.asDict(True) for r in attach.coverage(table).collect()], "pair_on": args.pair_on, "strict": args.pair_strict, "mapping_sha256": digest})
            keyed = held.join(table.where("pairing_status = 'paired'").select(F.col("run_path").alias("run"), "task_name", "doc_id", F.col("canonical_doc_id").alias("key")), ["run", "task_name", "doc_id"])
            keys = attach.comparable_keys(table, status, args.assume_aligned).withColumnRenamed("pair_key", "key")
        else:
            keyed = held.withColumn("key", task_doc_key)
            keys = pairing.same_prompts(_hashes(spark, own), "key", "run", "prompt_hash")
        keyed, keys = put(keyed, f"{g.label}/documents"), put(keys, f"{g.label}/keys")
        depth = reports.settled(tables["signals"].join(F.broadcast(own.select(F.col("path").alias("run"))), "run", "left_semi"), held, own.select(F.col("path").alias("run"), "n_blocks"))
        depth = depth.join(keyed.select("run", "task_name", "doc_id", "key").distinct(), ["run", "task_name", "doc_id"]).select("run", "key", "settle_depth")
        depth = put(depth, f"{g.label}/depths")
        facts = own.select(F.col("path").alias("run"), "series", F.col("model_id").alias("model"), "language", "n_blocks", "tasks")
        axis = "language" if datasets else "model"
        examples.append(reports.examples_report(keyed, keys, reference, depth, args.examples_per_category, facts, axis).withColumn("group", F.lit(g.label)))
        pools = {r.bucket: r for r in reports.draw(keyed, keys, reference, args.examples_per_category).collect()}
        drawn.append({
            "group": g.label, "axis": axis, "datasets": [f"{a}={b}" for a, b in datasets or []], "reference": reference, "seed": pairing.SEED, "per_category": args.examples_per_category, "eligible": keys.distinct().count(),
            "pool_sizes": {b: r.pool for b, r in pools.items() if b != "mixed"}, "taken": {b: r.taken for b, r in pools.items() if b != "mixed"}, "mixed_not_sampled": pools["mixed"].pool if "mixed" in pools else 0,
            "eligibility": "gold-answer alignment across languages" if datasets else "identical prompt_hash per document",
        })
    for name, parts in (("pairing", pairs), ("examples", examples)):
        if parts:
            reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{args.output}/{name}")
    source.write_json(spark, f"{args.output}/examples.json", {"groups": drawn})
    if told:
        source.write_json(spark, f"{args.output}/pairing.json", {"pairing_schema": 1, "groups": told})
    source.remove(spark, f"{args.output}/_work")


def _per_run(spark: SparkSession, own: DataFrame, read) -> DataFrame:
    """What ``read`` makes of the samples of each of a group's few runs."""
    parts = [read(source.read_samples(spark, r.path)).withColumn("run", F.lit(r.path)) for r in own.select("path").collect()]
    return reduce(DataFrame.unionByName, parts)


def _fields(spark: SparkSession, own: DataFrame) -> DataFrame:
    """(run, doc, field, value): the scalar fields of each sample's document."""

    def read(samples: DataFrame) -> DataFrame:
        rows = samples.select(F.concat_ws("#", F.try_variant_get("record", "$.task_name", "string"), F.try_variant_get("record", "$.doc_id", "string")).alias("doc"), F.to_json(F.try_variant_get("record", "$.doc", "variant")).alias("document"))
        return documents.scalar_fields(rows.dropDuplicates(["doc"]), ["doc"], "document")

    return _per_run(spark, own, read)


def _hashes(spark: SparkSession, own: DataFrame) -> DataFrame:
    """(run, key, prompt_hash) of each document, the last that is not empty."""

    def read(samples: DataFrame) -> DataFrame:
        rows = samples.select(F.concat_ws("#", F.try_variant_get("record", "$.task_name", "string"), F.try_variant_get("record", "$.doc_id", "string")).alias("key"), F.try_variant_get("record", "$.prompt_hash", "string").alias("prompt_hash"), F.monotonically_increasing_id().alias("line"))
        return collect.prompt_hashes(rows, ["key"], "prompt_hash", "line")

    return _per_run(spark, own, read)


def module_stats(spark: SparkSession, args: argparse.Namespace) -> None:
    out = source.read_statistics(spark, args.path, args.table, args.pass_name)
    if args.module:
        out = out.where(F.col("module").rlike(args.module))
    if args.doc:
        ref = spark.range(1).select(task_doc(F.lit(args.doc)).alias("r")).first().r
        out = out.where(F.col("doc_id") == ref.doc_id)
        if ref.task_name:
            out = out.where(F.col("task_name") == ref.task_name)
    # Of a session's own tables these columns are shown, of others all.
    wanted = [*_STATISTICS, *(_OF_DOCUMENT if args.doc else _OF_DATASET)]
    if {"module", "io"} <= set(out.columns):
        out = out.select(*(c for c in wanted if c in out.columns))
    out.show(args.limit, truncate=False)


def debug(spark: SparkSession, args: argparse.Namespace) -> None:
    path = args.path
    if not path.endswith(".jsonl"):
        traces = source.list_traces(spark, path)
        if not traces:
            raise FileNotFoundError(f"no trace in {path}")
        print("traces: " + ", ".join(traces))
        path = traces[0]
    events = source.read_trace(spark, path, _EVENT).withColumn("session", F.lit(0))
    if args.doc:
        ref = spark.range(1).select(task_doc(F.lit(args.doc)).alias("r")).first().r
        wanted = trace.forwards_of(events.where("samples IS NOT NULL"), "samples", ref.doc_id, ref.task_name).select("forward").distinct()
        events = events.join(wanted, "forward", "left_semi")
    if args.forward is not None:
        events = events.where(F.col("forward") == args.forward)
    if args.module:
        events = events.where(F.col("module").rlike(args.module))
    trace.forward_index(events, ["forward"], "i", "event", "phase").orderBy("forward").show(20)
    trace.calls(events, ["session"], "i", "event").where("status <> 'closed'").orderBy("enter").show(20)
    trace.tail(events, ["session"], "i", args.events).orderBy("i").show(args.events, truncate=False)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="runlens")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("report", help=report.__doc__)
    one.add_argument("paths", nargs="+")
    one.add_argument("--output", required=True)
    one.add_argument("--reference", help="part of the name of the run that others are set against")
    one.add_argument("--examples-per-category", type=int, default=3)
    one.add_argument("--multilingual", help="LANG=TASK,...: compare languages of one model")
    one.add_argument("--pair-on", help="a field, or position")
    one.add_argument("--pair-strict", action="store_true")
    one.add_argument("--pair-mapping")
    one.add_argument("--assume-aligned", action="store_true")
    one.set_defaults(run=report)
    one = commands.add_parser("module-stats")
    one.add_argument("path")
    one.add_argument("--table", choices=source.STATISTICS, default="dataset")
    one.add_argument("--module")
    one.add_argument("--pass", dest="pass_name", choices=source.PASSES, default="trace")
    one.add_argument("--doc", help="TASK#ID or ID")
    one.add_argument("--limit", type=int, default=50)
    one.set_defaults(run=module_stats)
    one = commands.add_parser("debug")
    one.add_argument("path")
    one.add_argument("--events", type=int, default=10)
    one.add_argument("--forward", type=int)
    one.add_argument("--doc", help="TASK#ID or ID")
    one.add_argument("--module")
    one.set_defaults(run=debug)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("runlens").getOrCreate()
    try:
        args.run(spark, args)
    except (LookupError, ValueError, RuntimeError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
