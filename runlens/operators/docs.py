"""From graded samples to rows per document and choice."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalar import argmax, number, stripped

#: Metrics that tell a verdict, in order of preference.
VERDICT_METRICS = ("acc", "exact_match", "acc_norm", "em", "f1")


def available_filters(samples: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """The filters of each task in the order in which they first appear."""
    first = samples.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(order).alias("_first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", name))), lambda s: s[name]).alias("filters"))


def primary_filters(samples: DataFrame, keys: list[str], name: str, order: str, declared: str | None = None) -> DataFrame:
    """The first filter of each task, or the last one that a contract declares."""
    first = F.min_by(name, order)
    chosen = first if declared is None else F.coalesce(F.max_by(F.col(declared), F.when(F.col(declared).isNotNull(), F.col(order))), first)
    return samples.where(F.col(name).isNotNull()).groupBy(*keys).agg(chosen.alias("primary_filter"))


def verdict(metrics: dict[str, Column], declared: Column | None = None) -> Column:
    """Whether the first metric that is present says 1; null if none is, or it is no number.

    ``metrics`` has for each name an expression that is null where the metric
    is absent and its text otherwise ("null" for a null). ``declared``, a
    struct with is_correct, comes first wherever it is there.
    """
    held = [metrics[m] for m in VERDICT_METRICS if m in metrics]
    value = F.coalesce(*held) if held else F.lit(None).cast("string")
    truth = F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true").otherwise(number(value) == 1.0)
    return truth if declared is None else F.when(declared.isNotNull(), declared["is_correct"]).otherwise(truth)


def gold_choice(target: Column, choices: Column, n_choices: Column | None = None) -> Column:
    """The place a target names: a whole number, null out of range; else the first choice with its text, white space aside; else null."""
    n = F.size(choices) if n_choices is None else n_choices
    place = F.when(stripped(target).rlike("^[+-]?\\d+$"), stripped(target).try_cast("int"))
    at = (F.array_position(F.transform(choices, stripped), stripped(target)) - 1).cast("int")
    return F.when(stripped(target).rlike("^[+-]?\\d+$"), F.when((place >= 0) & (place < n), place)).otherwise(F.when((at >= 0) & (at < n), at))


def choice_rows(samples: DataFrame, keys: list[str], logprobs: str, choices: str, target: str, passed: list[str] = ()) -> DataFrame:
    """A row per choice: its log probability, whether it is the target, and the text of the likeliest choice (the first of equals)."""
    gold = gold_choice(F.col(target), F.col(choices))
    best = F.get(F.col(choices), argmax(F.col(logprobs)).cast("int"))
    rows = samples.withColumn("_gold", gold).withColumn("predicted", best)
    rows = rows.select(*keys, *passed, "_gold", "predicted", F.posexplode(F.arrays_zip(F.col(logprobs).alias("p"), F.col(choices).alias("c"))).alias("choice_idx", "_c"))
    return rows.select(*keys, *passed, "choice_idx", F.coalesce(F.col("choice_idx") == F.col("_gold"), F.lit(False)).alias("is_target_choice"), "predicted", F.col("_c.p").cast("float").alias("choice_logprob"))


def generated_rows(samples: DataFrame, keys: list[str], response: str, passed: list[str] = ()) -> DataFrame:
    """One row per generated answer, which counts as the target choice and has no log probability."""
    return samples.select(*keys, *passed, F.lit(0).alias("choice_idx"), F.lit(True).alias("is_target_choice"), F.col(response).alias("predicted"), F.lit(None).cast("float").alias("choice_logprob"))


def sample_metrics(samples: DataFrame, keys: list[str], metric: str, metrics: str, values: str, name: str = "filter", wanted: str = "none") -> DataFrame:
    """The value of a metric per document, of one filter's records that carry it (values: map or JSON text)."""
    kept = samples.where((F.coalesce(name, F.lit("none")) == wanted) & F.array_contains(metrics, metric))
    value = F.get_json_object(values, f"$.{metric}") if dict(samples.dtypes)[values] == "string" else F.try_element_at(values, F.lit(metric)).cast("string")
    return kept.select(*keys, value.alias("value"))


def last_verdicts(docs: DataFrame, keys: list[str], verdict_column: str, *order: str) -> DataFrame:
    """The last verdict that is not null."""
    return docs.where(F.col(verdict_column).isNotNull()).groupBy(*keys).agg(F.max_by(verdict_column, F.struct(*order)).alias(verdict_column))


def first_answers(docs: DataFrame, keys: list[str], columns: list[str], *order: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def choice_ordinals(requests: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Choices numbered from 0 in the order of their requests."""
    return requests.withColumn("choice_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def collapsed_choices(df: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """Aliases of one row: the sorted distinct choices as a JSON list."""
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_set(choice))).alias("choices"))


def _hashed_in_order(batches):
    """The SHA-256 of the lines of each run, which come in order, one after another."""
    run, state = None, None
    for batch in batches:
        done = {"run": [], "digest": []}
        for r, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and r == run:
                state.update(b"\n")
            else:
                if state is not None:
                    done["run"].append(run)
                    done["digest"].append(state.hexdigest())
                run, state = r, hashlib.sha256()
            state.update((line or "").encode())
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in done.items()})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"run": pa.array([run], pa.string()), "digest": pa.array([state.hexdigest()], pa.string())})


def doc_set_hash(docs: DataFrame, keys: list[str], task: str, doc: str) -> DataFrame:
    """The first 16 hex digits of the hash over the sorted task:doc lines of each run, repeats included.

    Sorted lines pass through the hash one by one, so no task holds a run's lines.
    """
    line = F.concat_ws(":", F.col(task).cast("string"), F.col(doc).cast("string"))
    rows = docs.select(F.to_json(F.struct(*keys)).alias("run"), line.alias("line"))
    rows = rows.repartition("run").sortWithinPartitions("run", "line").mapInArrow(_hashed_in_order, "run string, digest string")
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(F.from_json("run", kinds).alias("k"), F.substring("digest", 1, 16).alias("doc_id_set_hash")).select("k.*", "doc_id_set_hash")


def is_scored(responses: Column) -> Column:
    """Whether an array of VARIANT responses tells choices by their log probabilities: the first is a list. None is generated."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.get(responses, F.lit(0))), F.lit("ARRAY")), F.lit(False))


def docs_from_samples(samples: DataFrame, record: str = "record", order: str = "line") -> DataFrame:
    """The table of documents from harness records (VARIANT), in their order.

    Of each task the records of the primary filter count, and those without
    one: a row per choice where responses carry log probabilities, else one
    row per document. The verdict is the record's own contract or that of the
    first metric present.
    """
    v = F.col(record)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    # The JSON values true and false are numbers; the texts are none.
    worded = lambda m: (F.schema_of_variant(get(f"$.{m}", "variant")) == "STRING") & F.lower(get(f"$.{m}", "string")).isin("true", "false")
    metrics = {m: F.when(get(f"$.{m}", "variant").isNotNull(), F.when(worded(m), "null").otherwise(F.coalesce(get(f"$.{m}", "string"), F.lit("null")))) for m in VERDICT_METRICS}
    contract = F.when(get("$._eval_framework", "variant").isNotNull(), F.struct(get("$._eval_framework.is_correct", "boolean").alias("is_correct")))
    rows = samples.select(
        F.col(order).alias("_order"), get("$.task_name", "string").alias("task_name"), get("$.doc_id", "long").alias("doc_id"), get("$.filter", "string").alias("filter"), get("$._eval_framework.primary_filter", "string").alias("_declared"),
        F.coalesce(get("$.target", "string"), F.lit("None")).alias("target"), F.coalesce(get("$.filtered_resps", "array<variant>"), F.array().cast("array<variant>")).alias("_resps"),
        F.coalesce(get("$.arguments", "array<array<string>>"), F.array().cast("array<array<string>>")).alias("_args"), verdict(metrics, contract).alias("is_correct"),
    )
    first = primary_filters(rows, ["task_name"], "filter", "_order", "_declared")
    rows = rows.join(first, "task_name", "left").where(F.col("filter").isNull() | (F.col("filter") == F.col("primary_filter")))
    rows = rows.withColumn("_scored", is_scored(F.col("_resps"))).withColumn("_text", F.transform("_args", lambda a: F.get(a, F.lit(1))))
    rows = rows.withColumn("_p", F.when(F.col("_scored"), F.transform("_resps", lambda r: F.try_variant_get(r, "$[0]", "double"))))
    rows = rows.withColumn("_best", argmax(F.col("_p")).cast("int")).withColumn("_gold", gold_choice(F.col("target"), F.array_compact("_text"), F.size("_p")))
    scored, kept = F.col("_scored"), ["task_name", "doc_id"]
    rows = rows.select(
        *kept, "is_correct", "_scored", "_gold", "filter",
        F.when(scored, F.coalesce(F.get("_text", F.col("_best")), F.col("_best").cast("string"))).otherwise(F.coalesce(F.try_variant_get(F.get("_resps", F.lit(0)), "$", "string"), F.lit(""))).alias("predicted"),
        F.when(scored, F.coalesce(F.get("_text", F.col("_gold")), "target")).otherwise(F.col("target")).alias("target"),
        F.posexplode(F.when(scored, F.col("_p")).otherwise(F.array(F.lit(None).cast("double")))).alias("choice_idx", "choice_logprob"),
    )
    is_target = F.when(F.col("_scored"), F.coalesce(F.col("choice_idx") == F.col("_gold"), F.lit(False))).otherwise(True)
    return rows.select(*kept, "choice_idx", "is_correct", is_target.alias("is_target_choice"), "predicted", "target", "choice_logprob", "filter")


def scalar_fields(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, field, value): the texts, numbers and booleans of a JSON document, as text; lists, objects and nulls are left out.

    True and False are written so; numbers keep their JSON text.
    """
    kinds = F.from_json(document, "map<string,variant>")
    texts = F.from_json(document, "map<string,string>")
    each = rows.select(*keys, F.explode(texts).alias("field", "value"), kinds.alias("_kinds"))
    kind = F.schema_of_variant(F.try_element_at("_kinds", F.col("field")))
    value = F.when(kind == "BOOLEAN", F.initcap("value")).otherwise(F.col("value"))
    return each.where(~F.startswith(kind, F.lit("ARRAY")) & ~F.startswith(kind, F.lit("OBJECT")) & (kind != "VOID")).select(*keys, "field", value.alias("value"))


def choices_of(docs: DataFrame, keys: list[str], choice: str, flag: str, target: str) -> DataFrame:
    """Per document: its number of rows, whether its choices are numbered from 0 without a hole, its last gold choice and its target."""
    c = F.col(choice)
    return docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), ((F.min(c) == 0) & (F.max(c) + 1 == F.countDistinct(c))).alias("is_whole"), F.countDistinct(c).alias("n_choices"),
        F.max(F.when(F.col(flag), c)).alias("gold_choice"), F.min_by(target, c).alias("target"),
    )
