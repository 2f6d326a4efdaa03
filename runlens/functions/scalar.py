"""Scalar expressions and small parsers shared by the operators."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_depth(index: Column, n_blocks: Column, domain: Column) -> Column:
    """Residual layer i of L blocks stands at i / L, block j at (j + 0.5) / L; without blocks at 0."""
    place = F.when(domain == "block", index + 0.5).otherwise(index.cast("double"))
    return F.when(n_blocks <= 0, F.lit(0.0)).otherwise(place / F.nullif(n_blocks, F.lit(0)))


def model_slug(model: Column) -> Column:
    """A name that is safe in paths: / becomes __, other unusual characters _."""
    return F.regexp_replace(F.replace(model, F.lit("/"), F.lit("__")), "[^A-Za-z0-9._-]", "_")


def tensor_name(task: Column, doc_id: Column, choice: Column) -> Column:
    """The file name of a tensor; letters and digits of any script stay."""
    return F.format_string("%s__%06d__%d", F.regexp_replace(task, "[^\\p{L}\\p{N}_.-]", "_"), doc_id, choice)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def key_values(args: Column) -> Column:
    """k=v,k=v as a map; parts without = are dropped, the first = splits."""
    parts = F.filter(F.split(args, ","), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(stripped(F.substring_index(p, "=", 1)).alias("k"), stripped(F.substr(p, F.position(F.lit("="), p) + 1)).alias("v")))
    return F.map_from_entries(pairs)


def task_doc(ref: Column) -> Column:
    """TASK#ID split at the last #; the task may be missing."""
    return F.struct(F.nullif(F.regexp_extract(ref, "^(?:(.*)#)?(\\d+)$", 1), F.lit("")).alias("task_name"), F.try_to_number(F.nullif(F.regexp_extract(ref, "^(?:(.*)#)?(\\d+)$", 2), F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id"))


def doc_key(task: Column, doc_id: Column, declared: Column | None = None) -> Column:
    """task#doc, less a declared task prefix: runs of sibling tasks then share their keys."""
    if declared is not None:
        task = F.when(F.startswith(task, declared), F.substr(task, F.length(declared) + 1)).otherwise(task)
    return F.concat_ws("#", task, doc_id.cast("string"))


def weight_state(x: Column) -> Column:
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "posinf").when(x == float("-inf"), "neginf").when(x.isNotNull(), "finite")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


#: How a number may be written, exponents included.
_NUMBER = "^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"


def number(text: Column) -> Column:
    """A text as a double: any way of writing a number, and nan, inf or infinity with or without a sign; else null."""
    name = F.lower(stripped(text))
    special = F.when(name.rlike("^[+-]?nan$"), float("nan")).when(name.rlike("^[+]?inf(inity)?$"), float("inf")).when(name.rlike("^-inf(inity)?$"), float("-inf"))
    return F.when(text.rlike(_NUMBER), stripped(text).try_cast("double")).otherwise(special)


def json_number(x: Column) -> Column:
    """A double as text that JSON can hold; non-finite values by name."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def from_json_number(x: Column) -> Column:
    """The double that json_number() wrote; null for what is no number."""
    return number(x)


def dot(a: Column, b: Column) -> Column:
    """Both arrays in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def argmax(a: Column) -> Column:
    """0-based place of the largest element; the first wins a tie."""
    return F.array_position(a, F.array_max(a)) - 1


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a).cast("double")
    return top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))


def soft_cap(x: Column, cap: float) -> Column:
    return cap * F.tanh(x / cap)


def parse_layers(spec: str, n_layers: int) -> list[int]:
    """all, or a comma list of numbers and ascending ranges; negatives count from the end."""
    if spec.strip() == "all":
        return list(range(n_layers))
    out = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        if re.fullmatch(r"-?\d+", part):
            found = [int(part)]
        elif m := re.fullmatch(r"(-?\d+)-(-?\d+)", part):
            first, last = (int(x) + n_layers * (int(x) < 0) for x in m.groups())
            found = list(range(first, last + 1))
        else:
            raise ValueError(f"not a layer: {part!r}")
        for i in found:
            at = i + n_layers if i < 0 else i
            if not 0 <= at < n_layers:
                raise ValueError(f"layer {i} is outside 0..{n_layers - 1}")
            out.add(at)
    return sorted(out)


def parse_batch_size(text: str) -> int | str:
    text = str(text).strip()
    if text == "auto" or re.fullmatch(r"auto:[1-9]\d*", text):
        return text
    if re.fullmatch(r"[1-9]\d*", text):
        return int(text)
    raise ValueError(f"not a batch size: {text!r}")


def config_hash(config: dict) -> str:
    """The first eight hex digits over the sorted JSON of a configuration; what JSON lacks goes by its text."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]


def output_path(tasks: Column, model: Column, day: Column, digest: Column) -> Column:
    """results/TASKS/MODEL/DAY-DIGEST, tasks sorted and joined by +."""
    names = F.coalesce(F.nullif(F.array_join(F.array_sort(tasks), "+"), F.lit("")), F.lit("unknown-task"))
    return F.concat_ws("/", F.lit("results"), names, model_slug(model), F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), digest))


#: Bytes of an element by the name of its type.
WIDTHS = {"float64": 8, "int64": 8, "float32": 4, "int32": 4, "float16": 2, "bfloat16": 2, "int16": 2, "int8": 1, "uint8": 1, "bool": 1}


def n_bytes(shape: Column, dtype: Column) -> Column:
    """Size of a tensor: elements times the width of its type, null for a type not known."""
    width = F.create_map(*(F.lit(x) for p in WIDTHS.items() for x in p))
    return F.aggregate(shape, F.lit(1).cast("long"), lambda n, x: n * x) * F.try_element_at(width, dtype)


def brief(values: Column, width: int = 8) -> Column:
    """The first elements of an array as JSON, and how many more there are."""
    more = F.greatest(F.size(values) - width, F.lit(0))
    return F.concat(F.to_json(F.slice(values, 1, width)), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def session_id(ts: Column, key: Column) -> Column:
    """A name that sorts by time, made unique by eight hex digits of a key (a uuid for a new session)."""
    return F.concat_ws("-", F.date_format(ts, "yyyyMMdd'T'HHmmssSSSSSS"), F.substring(F.sha2(key, 256), 1, 8))
