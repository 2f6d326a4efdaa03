"""Users' metrics of local tasks: chains of filters over responses, scores as Arrow UDFs, aggregations of declared kinds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a filter gives where its pattern is not found (fixed value).
INVALID = "[invalid]"

#: Filters by name: each makes, of its settings, a function from an array of responses to another.
FILTERS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def filter_named(name: str):
    def put(make):
        if name in FILTERS:
            raise ValueError(f"there is a filter {name} already")
        FILTERS[name] = make
        return make

    return put


@filter_named("take_first")
def _take_first():
    return lambda r: F.slice(r, 1, 1)


@filter_named("take_first_k")
def _take_first_k(k: int):
    return lambda r: F.slice(r, 1, k)


@filter_named("strip")
def _strip():
    return lambda r: F.transform(r, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))


@filter_named("lowercase")
def _lowercase():
    return lambda r: F.transform(r, F.lower)


@filter_named("regex")
def _regex(pattern: str, group_select: int = 0, fallback: str = INVALID):
    """The chosen match of the pattern's group in each response; counted from the end where negative."""

    def one(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(1 if "(" in pattern.replace("\\(", "").replace("(?:", "") else 0))
        at = F.lit(group_select) if group_select >= 0 else F.size(found) + group_select
        return F.coalesce(F.trim(F.get(found, at)), F.lit(fallback))

    return lambda r: F.transform(r, one)


@filter_named("map")
def _map(mapping: dict[str, str], default: str | None = None):
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return lambda r: F.transform(r, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(default)))


@filter_named("majority_vote")
def _majority_vote():
    """The response that occurs most often, the first of equals."""

    def vote(r: Column) -> Column:
        counted = F.transform(F.array_distinct(r), lambda x: F.struct(F.size(F.filter(r, lambda y: y == x)).alias("n"), (-F.array_position(r, x)).alias("at"), x.alias("x")))
        return F.filter(F.array(F.array_max(counted)["x"]), lambda x: x.isNotNull())

    return vote


@filter_named("function")
def _function(apply: Callable[[pd.Series], pd.Series]):
    """A user's function from a series of lists of texts to another, over Arrow batches."""
    return F.pandas_udf(apply, "array<string>")


def filtered(responses: Column, chain: list[dict]) -> Column:
    """Responses through a chain of filters, each {"function": name, **settings}."""
    for step in chain:
        settings = {k: v for k, v in step.items() if k != "function"}
        if step.get("function") not in FILTERS:
            raise ValueError(f"no such filter: {step.get('function')}")
        responses = FILTERS[step["function"]](**settings)(responses)
    return responses


#: Aggregations that combine on the map side.
BUILT_IN = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Metric:
    """A user's metric: ``score`` maps series of responses and targets to numbers, ``aggregation`` is a name of BUILT_IN or maps a group's numbers to one."""

    name: str
    score: Callable[[pd.Series, pd.Series], pd.Series]
    aggregation: str | Callable[[pd.Series], float] = "mean"
    higher_is_better: bool = True

    def __post_init__(self):
        if not callable(self.aggregation) and self.aggregation not in BUILT_IN:
            raise ValueError(f"metric {self.name}: no aggregation {self.aggregation!r}")


def scored(df: DataFrame, metrics: list[Metric], response: str, target: str) -> DataFrame:
    """``df`` with a double for each metric."""
    if len({m.name for m in metrics}) < len(metrics):
        raise ValueError("metric names repeat")
    schema = T.StructType([*df.schema.fields, *(T.StructField(m.name, T.DoubleType()) for m in metrics)])

    def rows(batches):
        for batch in batches:
            said, wanted = (batch.column(batch.schema.get_field_index(c)).to_pandas() for c in (response, target))
            scores = [pd.Series(m.score(said, wanted)).astype(float) for m in metrics]
            if wrong := [m.name for m, x in zip(metrics, scores, strict=True) if len(x) != batch.num_rows]:
                raise ValueError(f"{wrong[0]} has not one value per row")
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.Array.from_pandas(x, type=pa.float64()) for x in scores)], names=schema.names)

    # A pass of its own: users' scores cannot be merged into users' aggregations.
    return df.mapInArrow(rows, schema)


def aggregated(df: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    """keys and each metric over its scores.

    A user's aggregation sees a whole group of scores in one task (8 bytes a
    row), which is what such a function is; built-in ones never do.
    """
    def one(m: Metric) -> Column:
        return BUILT_IN[m.aggregation](m.name) if isinstance(m.aggregation, str) else F.pandas_udf(_typed(m.aggregation), "double")(m.name)

    # Spark aggregates either built-in or users' functions at once.
    own = [m for m in metrics if not isinstance(m.aggregation, str)]
    parts = [df.groupBy(*keys).agg(*(one(m).alias(m.name) for m in some)) for some in ([m for m in metrics if m not in own], own) if some]
    if len(parts) == 1:
        return parts[0]
    key = F.struct(*keys).alias("_k")
    return parts[0].withColumn("_k", key).join(parts[1].select(key, *(m.name for m in own)), "_k").drop("_k")


def _typed(f: Callable[[pd.Series], float]) -> Callable[[pd.Series], float]:
    """f with the annotations that make it an aggregation."""

    def apply(v: pd.Series) -> float:
        return float(f(v))

    apply.__annotations__ = {"v": pd.Series, "return": float}
    return apply
