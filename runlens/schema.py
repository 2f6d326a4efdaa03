"""Declared tables: their Spark schemas, keys and what each column means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = "0.4"

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType()}
_AXES = ["task_name string", "doc_id long", "choice_idx int"]
#: Columns whose values only compare between runs of one vocabulary.
OWN_VOCABULARY = {"choice_logprob", "token_id", "token", "lens_token_id", "lens_prob", "lens_token", "lens_is_special", "target_rank"}

_COLUMNS = {
    "docs": [*_AXES, "is_correct boolean", "is_target_choice boolean", "predicted string", "target string", "choice_logprob float", "filter string"],
    "steps": [*_AXES, "step int", "token_id long", "token string", "position int"],
    "signals": [*_AXES, "step int", "layer int", "lens_token_id long", "lens_prob float", "lens_token string", "lens_is_special boolean", "target_rank long", "target_percentile float"],
    "similarity": [*_AXES, "step int", "layer_i int", "layer_j int", "cos float"],
    "attn_norm": [*_AXES, "step int", "block int", "head int", "value_norm float"],
}
KEYS = {"docs": 3, "steps": 4, "signals": 5, "similarity": 6, "attn_norm": 6}
DOMAINS = {"docs": "none", "steps": "none", "signals": "residual", "similarity": "residual", "attn_norm": "block"}

MOMENTS = ["count", "finite_count", "nan", "posinf", "neginf", "mean", "m2", "min", "max"]
GROUP = ["task_name", "module", "io", "tensor_path", "dtype", "stage", "layout"]
AXIS_GROUP = [*GROUP, "axis", "axis_role", "axis_index"]


def _schema(columns: list[str]) -> T.StructType:
    out = T.StructType()
    for name, kind in (c.split() for c in columns):
        out.add(T.StructField(name, _TYPES[kind], True, {"comparable_across_vocab": name not in OWN_VOCABULARY}))
    return out


TABLES = {name: _schema(columns) for name, columns in _COLUMNS.items()}


def key_of(table: str) -> list[str]:
    return TABLES[table].names[: KEYS[table]]


def hook_schema(metrics: list[str], extended: bool = False) -> T.StructType:
    """The schema of a table of user metrics; a metric may not take the name of a context column."""
    context = [*_AXES, *([] if extended else ["step int"]), "module_path string", "call_index long", "stage string", "pass_name string"]
    if extended:
        context += ["forward_index long", "position long", "step long", "input_token_id long", "input_length long", "input_offset long", "token_role string"]
    taken = {c.split()[0] for c in context} & set(metrics)
    if taken or len(set(metrics)) < len(metrics):
        raise ValueError(f"metric names clash: {sorted(taken) or metrics}")
    return _schema([*context, *(f"{m} double" for m in metrics)])


def describe_schema(spark: SparkSession) -> DataFrame:
    """A row per declared column."""
    rows = [(t, DOMAINS[t], f.name, f.dataType.simpleString(), i < KEYS[t], f.metadata["comparable_across_vocab"]) for t, s in TABLES.items() for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "table string, layer_domain string, column string, type string, is_key boolean, comparable_across_vocab boolean")
