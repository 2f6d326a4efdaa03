"""Collecting rows of a forward pass: which positions count, whose they are, and what is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_role(position: Column, prompt_length: Column, kind: Column) -> Column:
    """prompt before the prompt's end, then continuation, or generated for generated documents."""
    return F.when(position < prompt_length, "prompt").when(kind == "generate", "generated").otherwise("continuation")


def selected_contexts(positions: DataFrame, documents: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), start: int | None = None, stop: int | None = None, scored_only: bool = False) -> DataFrame:
    """Positions of chosen documents in the half-open range [start, stop), all or only those with a step, with their role."""
    out = positions if documents is None else positions.join(documents.select(*keys).distinct(), list(keys), "left_semi")
    if start is not None:
        out = out.where(F.col("position") >= start)
    if stop is not None:
        out = out.where(F.col("position") < stop)
    if scored_only:
        out = out.where(F.col("step").isNotNull())
    return out.withColumn("token_role", token_role(F.col("position"), F.col("prompt_length"), F.col("kind")))


def valid_part(array: Column, offset: Column, length: Column) -> Column:
    """The elements of one document among padding."""
    return F.slice(array, offset + 1, length)


def gathered(array: Column, places: Column) -> Column:
    """The elements at 0-based places, in their order; null where there is none."""
    return F.transform(places, lambda i: F.get(array, i))


def request_documents(requests: DataFrame, forwards: DataFrame, prefix: str, document: list[str]) -> DataFrame:
    """Forwards with the documents they serve: requests that share a prefix share one forward."""
    return requests.select(*document, prefix).join(forwards, prefix)


def emitted_tokens(steps: DataFrame, wanted: DataFrame, keys: list[str], step: str, token: str) -> DataFrame:
    """The ids that each wanted document emitted, in step order, of its first choice."""
    own = steps.where("choice_idx = 0").join(wanted.select(*keys).distinct(), keys, "left_semi")
    return own.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, token))), lambda s: s[token]).alias("token_ids"))


def incomplete(rows: DataFrame, expected: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, keys) that ``expected`` asks of every ``by`` and ``rows`` lacks.

    What each key has is gathered first (of the few modules that are hooked),
    so only what is missing is ever laid out.
    """
    modules = rows.agg(F.array_sort(F.collect_set(by)).alias("_all"))
    held = rows.groupBy(*keys).agg(F.collect_set(by).alias("_held"))
    asked = expected.select(*keys).distinct().join(held, keys, "left").join(F.broadcast(modules), F.lit(True))
    return asked.select(F.explode(F.array_except("_all", F.coalesce("_held", F.array().cast(dict(modules.dtypes)["_all"])))).alias(by), *keys)


def verdict_counts(docs: DataFrame, keys: list[str], correct: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count_if(F.col(correct)).alias("correct"), F.count_if(~F.col(correct)).alias("incorrect"), F.count_if(F.col(correct).isNull()).alias("unknown"))


def prompt_hashes(samples: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last hash that is not empty."""
    return samples.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def feature_role(is_router_logits: Column, is_router_choice: Column) -> Column:
    """What a feature index means: an expert in a router's logits, a rank in its weights or choices, else a channel."""
    return F.when(is_router_logits, "expert").when(is_router_choice, "router_rank").otherwise("channel")


def absolute_position(prompt_length: Column, step: Column) -> Column:
    """Where the token of a step stands in the whole input."""
    return prompt_length - 1 + step


def contexts_by_document(contexts: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The contexts of each document as one list in their order (those of one forward, a few choices)."""
    return contexts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("contexts"))


def next_ordinal(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One more than the largest number so far."""
    return df.groupBy(*keys).agg((F.max(column) + 1).alias("next"))


def rolled_shards(docs: DataFrame, order: str, per_shard: int = 500) -> DataFrame:
    """The number of the shard that each row goes to, by a 0-based ordinal column."""
    return docs.withColumn("shard", F.format_string("part-%04d", F.floor(F.col(order) / per_shard)))
