"""Reductions of array columns: logits, hidden states, values and router weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalar import argmax, dot, log_sum_exp, norm, weight_state


def logit_lens(df: DataFrame, keys: list[str], logits: str, target: str) -> DataFrame:
    """Likeliest token and its probability, rank of the target (logits strictly above its own) and that rank's share of the vocabulary."""
    a = F.col(logits)
    gold = F.get(a, F.col(target).cast("int"))
    out = df.withColumn("_lse", log_sum_exp(a)).withColumn("lens_token_id", argmax(a).cast("long"))
    rank = F.when(gold.isNotNull(), F.size(F.filter(a, lambda x: x > gold))).cast("long")
    out = out.withColumn("lens_prob", F.exp(F.array_max(a).cast("double") - F.col("_lse"))).withColumn("target_rank", rank)
    return out.select(*keys, "lens_token_id", "lens_prob", "target_rank", (F.col("target_rank") / F.size(a)).alias("target_percentile"))


def similarity(df: DataFrame, keys: list[str], layer: str, vector: str, eps: float = 0.0) -> DataFrame:
    """Cosine of every two layers i <= j of one key, the diagonal included.

    The norms are taken once per layer; the join meets rows of one key only.
    """
    held = df.select(*keys, F.col(layer).alias("_l"), F.col(vector).alias("_v"), norm(F.col(vector)).alias("_n"))
    a, b = (held.select(*keys, F.col("_l").alias(f"layer_{s}"), F.col("_v").alias(f"_v{s}"), F.col("_n").alias(f"_n{s}")) for s in "ij")
    both = a.join(b, keys).where("layer_i <= layer_j")
    return both.select(*keys, "layer_i", "layer_j", (dot(F.col("_vi"), F.col("_vj")) / F.nullif(F.col("_ni") * F.col("_nj"), F.lit(0.0))).alias("cos"))


def value_norms(df: DataFrame, keys: list[str], values: str, kv_heads: int, heads: int) -> DataFrame:
    """Norm of each key-value head's part, repeated for the query heads that share it."""
    if heads % kv_heads:
        raise ValueError(f"{heads} heads are no multiple of {kv_heads}")
    part = F.size(values) / F.lit(kv_heads)
    each = F.transform(F.sequence(F.lit(0), F.lit(kv_heads - 1)), lambda h: norm(F.slice(F.col(values), (h * part).cast("int") + 1, part.cast("int"))))
    spread = F.flatten(F.transform(each, lambda x: F.array_repeat(x, heads // kv_heads)))
    return df.select(*keys, F.posexplode(spread).alias("head", "value_norm"))


def routing(df: DataFrame, keys: list[str], logits: str, k: int) -> DataFrame:
    """The k likeliest experts of each row with their softmax weights, the lower number first among equals."""
    a = F.col(logits)
    held = F.transform(a, lambda x, i: F.struct((-x.cast("double")).alias("order"), i.alias("expert")))
    out = df.withColumn("_lse", log_sum_exp(a)).withColumn("_top", F.slice(F.array_sort(held), 1, k))
    out = out.select(*keys, "_lse", F.posexplode("_top").alias("rank", "_s"))
    return out.select(*keys, "rank", F.col("_s.expert").alias("expert"), F.exp(-F.col("_s.order") - F.col("_lse")).alias("weight")).withColumn("weight_state", weight_state(F.col("weight")))


def step_rows(df: DataFrame, keys: list[str], steps: str, tokens: str, positions: str) -> DataFrame:
    """Parallel arrays of one forward as a row per step."""
    return df.select(*keys, F.inline(F.arrays_zip(F.col(steps).alias("step"), F.col(tokens).alias("token_id"), F.col(positions).alias("position"))))


def attention_rows(df: DataFrame, keys: list[str], block: str, head: str, weights: str, kind: str, step: str) -> DataFrame:
    """Last-query weights per block, heads in order; generated documents keep their first step only."""
    kept = df.where((F.col(kind) != "generate") | (F.col(step) == 0))
    return kept.groupBy(*keys, step, block).agg(F.transform(F.array_sort(F.collect_list(F.struct(head, weights))), lambda s: s[weights]).alias("heads"))


def split_values(values: Column, layout: str, heads: int, head_dim: int, parts: int = 3, at: int = 2) -> Column:
    """The value part of a projection: separate, fused_contiguous (after others) or fused_per_head (interleaved by head)."""
    if layout == "separate":
        return values
    if layout == "fused_contiguous":
        return F.slice(values, F.size(values) - heads * head_dim + 1, heads * head_dim)
    if layout == "fused_per_head":
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(values, h * parts * head_dim + at * head_dim + 1, head_dim)))
    raise ValueError(f"unknown layout {layout!r}")


def with_token_text(lens: DataFrame, vocabulary: DataFrame, token: str = "lens_token_id") -> DataFrame:
    """The likeliest token's text and whether it is special, from a vocabulary (token_id, text, is_special); null for ids it lacks."""
    held = vocabulary.select(F.col("token_id").alias(token), F.col("text").alias("lens_token"), F.col("is_special").alias("lens_is_special"))
    return lens.join(held, token, "left")


def hidden_rows(df: DataFrame, keys: list[str], layer: str, step: str, vector: str, layers: list[int]) -> DataFrame:
    """The vectors of the chosen layers, as one list per document and layer in the order of their steps."""
    kept = df.where(F.col(layer).isin(*layers))
    return kept.groupBy(*keys, layer).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, vector))), lambda s: s[vector]).alias("steps"))


@dataclass(frozen=True)
class Reducer:
    """A named, versioned reduction of array rows to a table; runs compare only if their versions agree."""

    name: str
    version: str
    table: str
    reduce: Callable[[DataFrame], DataFrame]


#: Reducers by name; register() adds a user's.
REDUCERS: dict[str, Reducer] = {}


def register(reducer: Reducer) -> Reducer:
    if reducer.name in REDUCERS:
        raise ValueError(f"there is a reducer {reducer.name} already")
    REDUCERS[reducer.name] = reducer
    return reducer


def descriptors(names: list[str]) -> list[dict[str, str]]:
    """What a manifest tells of the reducers of a run."""
    return [{"name": n, "version": REDUCERS[n].version, "table": REDUCERS[n].table} for n in sorted(names)]


def reduce_all(df: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The table of each reducer; two may not write one table."""
    chosen = [REDUCERS[n] for n in names]
    if len({r.table for r in chosen}) < len(chosen):
        raise ValueError("two reducers write one table")
    return {r.table: r.reduce(df) for r in chosen}


_LENS_KEYS = ["task_name", "doc_id", "choice_idx", "step", "layer"]
register(Reducer("logit_lens", "1", "signals", lambda df: logit_lens(df, _LENS_KEYS, "logits", "target")))
register(Reducer("layer_similarity", "1", "similarity", lambda df: similarity(df, _LENS_KEYS[:4], "layer", "hidden")))
