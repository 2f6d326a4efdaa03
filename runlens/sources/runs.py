"""Run directories: manifests, declared tables, samples, traces, mappings and statistics as DataFrames, and their writers."""

from __future__ import annotations

import json
import math
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from runlens.operators.checks import reasons, refuse_differences, refuse_duplicates, refuse_missing
from runlens.operators.docs import sample_metrics
from runlens.schema import TABLES, key_of

#: Tables of module statistics that may be read by name.
PASSES = ("trace", "collection")
STATISTICS = ("metadata", "modules", "coverage", "forwards", "observations", "extremes", "axis_stats", "routing", "exclusions", "samples", "dataset", "axis_samples", "axis_dataset")

_RUN = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("manifest", T.VariantType()), T.StructField("results", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))), T.StructField("_corrupt_record", T.StringType())])
_MAPPING = "language string, task_name string, doc_id string, canonical_doc_id string, canonical_choice_ids string, canonical_answer_id string"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def discover_runs(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, schema_version, manifest, results) of every readable results.json below the roots, each once, by path."""
    found = spark.read.schema(_RUN).options(multiLine=True, recursiveFileLookup=True, pathGlobFilter="results.json").json(list(roots))
    rows = found.select(F.regexp_replace("_metadata.file_path", "/results\\.json$", "").alias("path"), "*").where("_corrupt_record IS NULL AND manifest IS NOT NULL").drop("_corrupt_record")
    return rows.dropDuplicates(["path"]).orderBy("path")


def read_table(spark: SparkSession, run: str, table: str) -> DataFrame:
    """A declared table of a run with its declared columns; empty where the run has none."""
    if table not in TABLES:
        raise KeyError(f"{table} is not a declared table")
    try:
        return spark.read.schema(TABLES[table]).parquet(f"{run}/{table}")
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], TABLES[table])


def load_signals(spark: SparkSession, run: str, table: str = "signals", docs: bool = True) -> DataFrame:
    """A table of signals, joined to its documents after a check that these are unique."""
    rows = read_table(spark, run, table)
    if not docs:
        return rows
    held, keys = read_table(spark, run, "docs"), key_of("docs")
    refuse_duplicates(held, keys)
    return rows.join(held, keys, "left")


def existing_keys(spark: SparkSession, run: str, table: str) -> DataFrame:
    return read_table(spark, run, table).select(*key_of("docs")).distinct()


def check_recorded(spark: SparkSession, run: str, tables: list[str]) -> None:
    """Tables of one run must cover the same documents before it is resumed."""
    refuse_differences({t: read_table(spark, run, t) for t in tables}, key_of("docs"))


def read_samples(spark: SparkSession, run: str, schema: str | None = None) -> DataFrame:
    """The harness records of a run; blank lines are skipped. Without a schema each record is a VARIANT."""
    path = f"{run}/samples.jsonl"
    if schema:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def read_sample_metrics(spark: SparkSession, run: str, metric: str, name: str = "none") -> DataFrame:
    """(task_name, doc_id, value) of one metric and filter; several rows of one document are refused."""
    rows = read_samples(spark, run, f"task_name string, doc_id long, filter string, metrics array<string>, `{metric}` string").withColumn("values", F.create_map(F.lit(metric), F.col(metric)))
    out = sample_metrics(rows, ["task_name", "doc_id"], metric, "metrics", "values", "filter", name)
    refuse_duplicates(out, ["task_name", "doc_id"])
    return out


def trace_path(run: str, name: str = "trace") -> str:
    """Where a run keeps the trace of a pass."""
    return f"{run.rstrip('/')}/debug/{name}.jsonl"


def list_traces(spark: SparkSession, run: str) -> list[str]:
    """The trace files of a run, that of the scoring pass first."""
    return sorted(_listed(spark, trace_path(run, "*")), key=lambda p: (not p.endswith("/trace.jsonl"), p))


def graded_documents(spark: SparkSession, run: str) -> DataFrame:
    """(task_name, doc_id) of every document that a run graded: by its table of documents or, where it has no rows, its samples."""
    docs = read_table(spark, run, "docs").select("task_name", "doc_id")
    if not docs.take(1):
        docs = read_samples(spark, run).select(F.try_variant_get("record", "$.task_name", "string").alias("task_name"), F.try_variant_get("record", "$.doc_id", "long").alias("doc_id"))
    return docs.distinct()


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Trace events; each enter carries the arguments of the last numeric record of its call."""
    events = spark.read.schema(schema).json(path)
    last = events.where("event = 'input_numeric'").groupBy("call").agg(F.max_by("args", "i").alias("numeric_args"))
    return events.where("event <> 'input_numeric'").join(last, "call", "left")


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A pairing mapping from CSV or JSON lines, its choice ids split; rows without a field or with an id that is no whole number fail."""
    read = spark.read.schema(_MAPPING)
    rows = read.option("header", True).csv(path) if path.endswith(".csv") else read.json(path)
    bad = F.col("language").isNull() | F.col("task_name").isNull() | F.col("canonical_doc_id").isNull() | ~F.coalesce(F.col("doc_id").rlike("^\\d+$"), F.lit(False))
    if found := rows.where(bad).take(1):
        raise ValueError(f"not a mapping row: {found[0].asDict()}")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("canonical_choice_ids", F.split("canonical_choice_ids", "\\|"))


def mapping_digest(spark: SparkSession, path: str) -> str:
    """The hash over the bytes of a mapping, which a report keeps beside what it paired."""
    return fingerprints(spark, path).first().sha256


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value): lines that are not blank with their real numbers in their file.

    A file is read in blocks by many tasks: the lines of a block are numbered
    where they are read, and the number of those before it is added from a
    table with a row per block.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    ahead = blocks.select("file", "block", "first", before.alias("before"))
    return lines.join(ahead, ["file", "block"]).where(F.trim("value") != "").select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def split_problems(spark: SparkSession, paths: list[str], kind: str, id_field: str, judged: bool = False) -> DataFrame:
    """(file, line, problem) of the documents of one split, over all its files: the first rule that each breaks, null if none.

    Documents are JSON objects with a text or whole number for an id, unique
    by its text within the split. multiple_choice needs a question, two or
    more choices that are texts and not blank, and a label that is the place
    of one; generate_until a prompt, and an answer that is a text or a list
    of texts (none at all where a judge scores).
    """
    doc = F.try_parse_json("value")
    rows = numbered_lines(spark, *paths).withColumn("doc", doc)
    get = lambda path, t="variant": F.try_variant_get("doc", path, t)
    is_a = lambda path, *kinds: F.coalesce(F.schema_of_variant(get(path)).isin(*kinds), F.lit(False))
    rows = rows.withColumn("id", F.when(is_a(f"$.{id_field}", "STRING", "BIGINT"), get(f"$.{id_field}", "string")))
    times = rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(times, "id", "left")
    text = "question" if kind == "multiple_choice" else "prompt"
    blank = lambda c: c.isNull() | (F.regexp_replace(c, "\\s+", "") == "")
    texts = lambda path: F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>"))
    not_text = lambda v: F.schema_of_variant(v) != "STRING"
    rules = [
        (F.col("doc").isNull() | ~F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False)), "not a JSON object"),
        (F.col("id").isNull() | (F.col("id") == ""), "no id"),
        (F.col("times") > 1, "repeated id"),
        (~is_a(f"$.{text}", "STRING") | blank(get(f"$.{text}", "string")), f"no {text}"),
    ]
    if kind == "multiple_choice":
        choices = texts("$.choices")
        rules += [
            ((F.size(choices) < 2) | F.exists(choices, not_text) | F.exists(choices, lambda v: blank(F.try_variant_get(v, "$", "string"))), "choices are not two or more texts"),
            (~is_a("$.label", "BIGINT") | (get("$.label", "long") < 0) | (get("$.label", "long") >= F.size(choices)), "the label is no choice"),
        ]
    else:
        answers, wrong = texts("$.answer"), ~is_a("$.answer", "STRING")
        wrong = wrong & ((F.size(answers) == 0) | F.exists(answers, not_text))
        rules.append((wrong & get("$.answer").isNotNull() if judged else wrong, "the answer is no text"))
    return rows.select("file", "line", reasons(*rules).alias("problem"))


def discover_tasks(spark: SparkSession, *roots: str, builtin: tuple[str, ...] = ()) -> tuple[dict[str, dict], DataFrame]:
    """(the settings of each task by its name, the code and settings files with their hashes) of YAML task files below the roots.

    Functions that settings name are not loaded. A name that repeats, or that
    is built in, is refused.
    """
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!function", lambda loader, node: loader.construct_scalar(node))
    out: dict[str, dict] = {}
    # Settings files: small, and few.
    files = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml}").select(F.col("_metadata.file_path").alias("file"), "value")
    for row in files.orderBy("file").collect():
        task = yaml.load(row.value, Loader=Loader)  # noqa: S506
        if not isinstance(task, dict) or not isinstance(task.get("task"), str):
            raise ValueError(f"{row.file} does not name a task")
        if task["task"] in out or task["task"] in builtin:
            raise ValueError(f"there are two tasks {task['task']}")
        out[task["task"]] = task | {"file": row.file}
    found = [fingerprints(spark, root, "*.{py,yaml,yml}") for root in roots]
    hashes = found[0]
    for df in found[1:]:
        hashes = hashes.unionByName(df)
    return out, hashes.dropDuplicates(["path"])


def fingerprints(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file below a root."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def resolve_statistics(spark: SparkSession, path: str, pass_name: str = "trace") -> str:
    """The session that a path names: itself, or the latest session of a pass below a run."""
    if pass_name not in PASSES:
        raise ValueError(f"{pass_name} is not a pass")
    if _listed(spark, f"{path}/observations") or _listed(spark, f"{path}/samples"):
        return path
    root = f"{path}/debug/module_stats"
    if found := _listed(spark, f"{root}/{pass_name}/*"):
        return found[-1]
    other = [p.rsplit("/", 1)[1] for p in _listed(spark, f"{root}/*") if _listed(spark, f"{p}/*")]
    raise FileNotFoundError(f"no {pass_name} statistics below {path}" + (f"; there are those of {', '.join(other)}" if other else ""))


def read_statistics(spark: SparkSession, path: str, table: str, pass_name: str = "trace") -> DataFrame:
    """One table of statistics; a table that the session has not got is told from a name that is none."""
    if table not in STATISTICS:
        raise ValueError(f"{table} is not a table of statistics")
    session = resolve_statistics(spark, path, pass_name)
    if not _listed(spark, f"{session}/{table}"):
        raise RuntimeError(f"{session} has no {table}: it was not recorded, or is not aggregated yet")
    return spark.read.parquet(f"{session}/{table}")


def export_tables(tables: dict[str, DataFrame], session: str) -> None:
    """Statistics as typed tables of one session: counts are whole numbers, moments doubles."""
    whole = {"count", "finite_count", "nan", "posinf", "neginf", "observations", "documents", "finite_documents"}
    for name, df in tables.items():
        if name not in STATISTICS:
            raise ValueError(f"{name} is not a table of statistics")
        typed = df.withColumns({c: F.col(c).cast("long") for c in df.columns if c in whole})
        typed.write.mode("overwrite").option("compression", "zstd").parquet(f"{session}/{name}")


def read_results(spark: SparkSession, run: str) -> dict:
    """results.json of one run."""
    if not _listed(spark, f"{run}/results.json"):
        raise FileNotFoundError(f"{run} is no run: it has no results.json")
    return json.loads(spark.read.text(f"{run}/results.json", wholetext=True).first().value)


def read_manifest(spark: SparkSession, run: str) -> dict:
    return read_results(spark, run)["manifest"]


def _plain(value):
    """What JSON can hold: non-finite numbers by their names, which Spark reads as doubles again."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return value


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A small JSON file in one piece: it is written aside and takes the old one's place in one step."""
    text = json.dumps(_plain(document), ensure_ascii=False, default=str)
    jvm = spark._jvm.org.apache.hadoop.fs
    made, target = jvm.Path(f"{path}.{uuid.uuid4().hex}.tmp"), jvm.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    out = made.getFileSystem(conf).create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.FileContext.getFileContext(target.toUri(), conf).rename(made, target, how)


def write_results(spark: SparkSession, run: str, document: dict) -> None:
    """results.json in one piece; a manifest that lacks a required key is refused."""
    refuse_missing(document.get("manifest", {}))
    write_json(spark, f"{run}/results.json", document)


def mark_complete(spark: SparkSession, run: str, **more) -> None:
    """Stamp a run as finished, with what else its manifest should tell."""
    document = read_results(spark, run)
    document["manifest"] |= {"completed": True, "finished_at": datetime.now(timezone.utc).isoformat()} | more
    write_json(spark, f"{run}/results.json", document)


def append(df: DataFrame, run: str, table: str) -> None:
    """Rows of a declared table: missing columns become null, further ones are dropped, types are the declared."""
    schema = TABLES[table]
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema]
    df.select(*columns).write.mode("append").option("compression", "zstd").parquet(f"{run}/{table}")


def write_docs(df: DataFrame, run: str) -> None:
    """The rebuilt table of documents in place of the old one."""
    df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES["docs"])).write.mode("overwrite").option("compression", "zstd").parquet(f"{run}/docs")


def write_samples(df: DataFrame, run: str) -> None:
    df.write.mode("overwrite").json(f"{run}/samples.jsonl")


_NAME = re.compile("[A-Za-z][A-Za-z0-9_]*")
_COMMITS = "unit string, attempt string, contract string, files map<string,string>"


def _named(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} cannot name a table")
    return name


def _parquet_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return None


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256) of the data files of a folder, named as below it."""
    return fingerprints(spark, folder, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")


def ensure_contract(spark: SparkSession, run: str, name: str, contract: dict) -> str:
    """Keep what a user's table was collected under, or refuse if that has changed or is missing beside data; its hash."""
    root = f"{run}/custom/{_named(name)}"
    text = json.dumps(contract, sort_keys=True)
    if _listed(spark, f"{root}/contract.json"):
        held = json.loads(spark.read.text(f"{root}/contract.json", wholetext=True).first().value)
        if json.dumps(held, sort_keys=True) != text:
            raise ValueError(f"the contract of {name} has changed")
    elif _listed(spark, f"{root}/rows/*"):
        raise ValueError(f"{name} has rows and no contract")
    else:
        write_json(spark, f"{root}/contract.json", contract)
    return uuid.uuid5(uuid.NAMESPACE_OID, text).hex


def append_custom(df: DataFrame, run: str, name: str, unit: str, contract: dict | None = None) -> bool:
    """A unit of a user's table; whether it was written. Its rows count only once its marker is written, with the hashes of its files.

    Every call is an attempt of its own, so one that failed before its marker
    leaves nothing that counts, and a unit that has a marker is not written
    again. The columns of the first unit are those of all.
    """
    spark, root = df.sparkSession, f"{run}/custom/{_named(name)}"
    agreed = ensure_contract(spark, run, name, contract or {})
    if committed(spark, run, name).where(F.col("unit") == unit).take(1):
        return False
    held = _parquet_or_none(spark, f"{root}/rows")
    if held is not None and {(f.name, f.dataType) for f in held.drop("attempt").schema} != {(f.name, f.dataType) for f in df.schema}:
        raise ValueError(f"the schema of {name} has changed")
    attempt = f"u{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/rows/attempt={attempt}")
    files = _hashes(spark, f"{root}/rows/attempt={attempt}").agg(F.map_from_entries(F.collect_list(F.struct("file", "sha256"))).alias("files"))
    files.select(F.lit(unit).alias("unit"), F.lit(attempt).alias("attempt"), F.lit(agreed).alias("contract"), "files").coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return True


def committed(spark: SparkSession, run: str, name: str) -> DataFrame:
    """One attempt per committed unit: of writers that met, the first by name counts."""
    found = _parquet_or_none(spark, f"{run}/custom/{_named(name)}/commits", _COMMITS)
    if found is None:
        return spark.createDataFrame([], _COMMITS)
    return found.groupBy("unit").agg(F.min_by(F.struct("attempt", "contract", "files"), "attempt").alias("c")).select("unit", "c.*")


def refuse_damage(spark: SparkSession, run: str, name: str) -> None:
    """Files of committed units that are gone, changed or of an unknown attempt, and markers without a contract, are refused."""
    root, marks = f"{run}/custom/{_named(name)}", committed(spark, run, name)
    if marks.where("attempt IS NULL OR files IS NULL OR NOT attempt RLIKE '^u[0-9a-f]{32}$'").take(1):
        raise ValueError(f"{name} has a marker that is not whole")
    if not _listed(spark, f"{root}/contract.json"):
        raise ValueError(f"{name} has units and no contract")
    told = marks.select("attempt", F.explode("files").alias("file", "sha256"))
    there = fingerprints(spark, f"{root}/rows", "*.parquet").select(F.regexp_extract("path", "attempt=(u[0-9a-f]+)/", 1).alias("attempt"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("sha256").alias("now"))
    there = there.join(marks.select("attempt"), "attempt", "left_semi")
    if bad := told.join(there, ["attempt", "file"], "full").where("NOT sha256 <=> now").take(1):
        raise ValueError(f"a committed file of {name} is missing or damaged: {bad[0].file}")


def read_custom(spark: SparkSession, run: str, name: str, verify: bool = True) -> DataFrame:
    """The rows of committed units only, with their unit; their files are checked first."""
    root = f"{run}/custom/{_named(name)}"
    if verify and _listed(spark, f"{root}/commits"):
        refuse_damage(spark, run, name)
    rows = _parquet_or_none(spark, f"{root}/rows")
    if rows is None:
        raise FileNotFoundError(f"{run} has no {name}")
    return rows.join(committed(spark, run, name).select("unit", "attempt"), "attempt").drop("attempt")


_TENSOR_KEY = ["task_name", "doc_id", "choice_idx", "key"]


def save_tensors(df: DataFrame, run: str, name: str, limit: int = 1 << 40) -> None:
    """Array rows (task_name, doc_id, choice_idx, key, shape, values) as an artefact that stays as it is, then its index.

    The index tells type, shape, size and hash of each. A key saved again
    replaces what it had; more bytes than the limit are refused. An artefact
    whose index was not written is an orphan and never read.
    """
    spark, root = df.sparkSession, f"{run}/tensors/{_named(name)}"
    attempt = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    held = df.select(*_TENSOR_KEY, "shape", F.col("values").cast("array<float>").alias("values")).withColumn("sha256", F.sha2(F.to_json("values").cast("binary"), 256)).withColumn("tensor_id", F.concat(F.lit(f"{attempt}/"), F.sha2(F.to_json(F.struct(*_TENSOR_KEY)), 256)))
    held.write.option("compression", "zstd").parquet(f"{root}/artefacts/attempt={attempt}")
    saved = spark.read.parquet(f"{root}/artefacts/attempt={attempt}")
    if (saved.agg(F.sum(4 * F.size("values"))).first()[0] or 0) > limit:
        raise ValueError("the tensors are larger than the limit")
    index = saved.select(*_TENSOR_KEY, "tensor_id", "shape", "sha256", F.lit("float32").alias("dtype"), (4 * F.size("values")).alias("bytes"), F.lit(attempt).alias("saved"))
    index.write.mode("append").option("compression", "zstd").parquet(f"{root}/index")


def _tensor_index(spark: SparkSession, run: str, name: str) -> DataFrame:
    """The last entry of each key."""
    rows = spark.read.parquet(f"{run}/tensors/{_named(name)}/index")
    return rows.groupBy(*_TENSOR_KEY).agg(F.max_by(F.struct("tensor_id", "shape", "sha256", "dtype", "bytes"), "saved").alias("t")).select(*_TENSOR_KEY, "t.*")


def tensor_problems(spark: SparkSession, run: str, name: str) -> DataFrame:
    """(key columns, problem) of indexed tensors that are missing, or no longer match their hash, type or shape."""
    held = spark.read.parquet(f"{run}/tensors/{name}/artefacts").select("tensor_id", "values", F.col("shape").alias("_shape"))
    size = F.aggregate("shape", F.lit(1), lambda n, x: (n * x).cast("int"))
    problem = reasons(
        (F.col("values").isNull(), "missing"),
        (F.sha2(F.to_json("values").cast("binary"), 256) != F.col("sha256"), "damaged"),
        ((F.size("values") != size) | (F.col("_shape") != F.col("shape")), "another shape"),
        (F.col("dtype") != "float32", "another type"),
    )
    return _tensor_index(spark, run, name).join(held, "tensor_id", "left").select(*_TENSOR_KEY, problem.alias("problem"))


def read_tensors(spark: SparkSession, run: str, name: str) -> DataFrame:
    """(task_name, doc_id, choice_idx, key, shape, values) of indexed tensors, after a check of every one."""
    if bad := tensor_problems(spark, run, name).where("problem IS NOT NULL").take(1):
        raise ValueError(f"a tensor of {name} is {bad[0].problem}: {bad[0].asDict()}")
    held = spark.read.parquet(f"{run}/tensors/{name}/artefacts").select("tensor_id", "values")
    return _tensor_index(spark, run, name).join(held, "tensor_id").select(*_TENSOR_KEY, "shape", "values")


def audit_tensors(spark: SparkSession, run: str, name: str) -> DataFrame:
    """(kind, item): artefacts that no index names, indexed tensors that are missing or damaged, and files left over from writing."""
    root = f"{run}/tensors/{_named(name)}"
    held = spark.read.parquet(f"{root}/artefacts").select("tensor_id")
    known = spark.read.parquet(f"{root}/index").select("tensor_id")
    orphans = held.join(known, "tensor_id", "left_anti").select(F.lit("orphan").alias("kind"), F.col("tensor_id").alias("item"))
    bad = tensor_problems(spark, run, name).where("problem IS NOT NULL").select(F.col("problem").alias("kind"), F.to_json(F.struct(*_TENSOR_KEY)).alias("item"))
    left = [(p,) for p in [*_listed(spark, f"{root}/*/_temporary"), *_listed(spark, f"{root}/*/*/_temporary"), *_listed(spark, f"{root}/*/*.tmp")]]
    return orphans.unionByName(bad).unionByName(spark.createDataFrame(left, "item string").select(F.lit("temporary").alias("kind"), "item"))


def run_files(spark: SparkSession, run: str) -> DataFrame:
    """(path, length, sha256) of what a run produced, paths as below it; what is still being written is left out."""
    found = fingerprints(spark, run, "*.{parquet,jsonl,json}").where(~F.contains("path", F.lit("/_temporary/")))
    return found.withColumn("path", F.regexp_extract("path", f"{re.escape(run.rstrip('/').rsplit('/', 1)[-1])}/(.*)$", 1))


def write_trace(events: DataFrame, path: str, order: str, last: int = 5000) -> int:
    """The last events of a session as JSON lines, as a ring of that size leaves them; how many it dropped."""
    total = events.count()
    kept = events.orderBy(F.desc(order)).limit(last)
    kept.orderBy(order).coalesce(1).write.mode("overwrite").json(path)
    return max(0, total - last)


def read_runs_table(spark: SparkSession, runs: list[str], table: str) -> DataFrame:
    """A declared table of many runs as one scan, with the path of each row's run."""
    there = [f"{r}/{table}" for r in runs if _listed(spark, f"{r}/{table}/*.parquet")]
    if not there:
        return spark.createDataFrame([], TABLES[table]).withColumn("run", F.lit(None).cast("string"))
    found = spark.read.schema(TABLES[table]).parquet(*there)
    return found.withColumn("run", F.regexp_replace("_metadata.file_path", f"/{table}/[^/]*$", ""))
