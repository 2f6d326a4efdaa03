"""Traces of module calls: pairing, nesting, tails and summaries of an ordered event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enriched(enters: DataFrame, details: DataFrame, call: list[str], order: str, columns: list[str]) -> DataFrame:
    """Enter events with the columns of the last detail of the same call, null without one."""
    last = details.groupBy(*call).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(*call, "_last.*")
    return enters.join(last, call, "left")


def forward_index(events: DataFrame, keys: list[str], order: str, event: str, phase: str, headers: DataFrame | None = None) -> DataFrame:
    """Per forward: the number of calls that began, the phase of the first event and what its header tells (samples, batch rows)."""
    out = events.groupBy(*keys).agg(F.count_if(F.col(event) == "enter").alias("n_enters"), F.min_by(phase, order).alias("phase"))
    return out if headers is None else out.join(headers, keys, "left")


def numbered_calls(events: DataFrame, session: list[str], order: str, event: str) -> DataFrame:
    """Events numbered from 0 in their session, with the number of the call (enter) and of the forward (header) they fall in."""
    w = Window.partitionBy(*session).orderBy(order)
    return events.withColumn("i", F.row_number().over(w) - 1).withColumn("call", F.count_if(F.col(event) == "enter").over(w)).withColumn("forward_id", F.count_if(F.col(event) == "forward").over(w))


def session_summary(events: DataFrame, session: list[str], order: str, event: str) -> DataFrame:
    """Per session: whether it failed (calls that were unwound, exits that close nothing), and its deepest open call."""
    held = calls(events, session, order, event)
    out = held.groupBy(*session).agg(F.count_if(F.col("status") == "closed").alias("n_closed"), F.count_if(F.col("status") == "unwound").alias("n_unwound"), F.count_if(F.col("status") == "orphan").alias("n_orphans"), F.max("depth").alias("deepest"), F.max_by("enter", F.when(F.col("status") == "unwound", F.struct("depth", "enter"))).alias("deepest_open"))
    return out.withColumn("healthy", (F.col("n_unwound") == 0) & (F.col("n_orphans") == 0))


def depths(events: DataFrame, session: list[str], order: str, event: str) -> DataFrame:
    """Height of the call stack after each event, never below 0 by an exit that nothing opened.

    One session is ordered by itself; sessions are spread over the cluster.
    """
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col(event) == "enter", 1).when(F.col(event) == "exit", -1).otherwise(0)
    height = F.sum(step).over(w)
    marked = events.withColumn("_height", height)
    # What the running sum fell below 0 so far is exits without an enter.
    return marked.withColumn("depth", F.col("_height") - F.least(F.lit(0), F.min("_height").over(w))).drop("_height")


def calls(events: DataFrame, session: list[str], order: str, event: str, restart: str | None = None) -> DataFrame:
    """Each enter with the exit that closes it: the first later exit that brings the stack to the enter's own floor.

    status is closed, unwound (no exit) or orphan (an exit that closes
    nothing). At each event ``restart`` whatever is open is unwound.
    """
    if restart is not None:
        segment = F.count_if(F.col(event) == restart).over(Window.partitionBy(*session).orderBy(order))
        return calls(events.withColumn("_segment", segment), [*session, "_segment"], order, event).drop("_segment")
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = events.where(F.col(event).isin("enter", "exit"))
    height = F.sum(F.when(F.col(event) == "enter", 1).otherwise(-1)).over(w)
    moved = moved.withColumn("_h", height).withColumn("_low", F.least(F.lit(0), F.min("_h").over(w)))
    # An enter reaches level h, its exit leaves level h: pairs alternate within a level over the same floor.
    moved = moved.withColumn("level", F.when(F.col(event) == "enter", F.col("_h")).otherwise(F.col("_h") + 1))
    at = Window.partitionBy(*session, "level").orderBy(order)
    moved = moved.withColumn("_next_event", F.lead(event).over(at)).withColumn("_next", F.lead(order).over(at)).withColumn("_before", F.lag(event).over(at))
    opened = moved.where(F.col(event) == "enter").select(*session, F.col(order).alias("enter"), F.when(F.col("_next_event") == "exit", F.col("_next")).alias("exit"), (F.col("level") - F.col("_low")).alias("depth"), F.when(F.col("_next_event") == "exit", "closed").otherwise("unwound").alias("status"))
    orphans = moved.where((F.col(event) == "exit") & ~F.col("_before").eqNullSafe(F.lit("enter"))).select(*session, F.lit(None).cast("long").alias("enter"), F.col(order).alias("exit"), F.lit(0).cast("long").alias("depth"), F.lit("orphan").alias("status"))
    return opened.unionByName(orphans)


def tail(events: DataFrame, session: list[str], order: str, n: int) -> DataFrame:
    """The last n events of each session, with the number that a ring of that size would have dropped."""
    nth = F.row_number().over(Window.partitionBy(*session).orderBy(F.desc(order)))
    total = events.groupBy(*session).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("dropped"))
    return events.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth").join(total, session)


def carried(events: DataFrame, session: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value that is not null, carried to the events that follow."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def generation_steps(events: DataFrame, doc: list[str], order: str) -> DataFrame:
    """Forwards of one document numbered from 0; the first is the prefill, the others decode."""
    step = F.row_number().over(Window.partitionBy(*doc).orderBy(order)) - 1
    return events.withColumn("step", step).withColumn("stage", F.when(F.col("step") == 0, "prefill").otherwise("decode"))


def sample_counts(events: DataFrame, keys: list[str], shown: int = 8) -> DataFrame:
    """Choices per document and how many documents a display would leave out."""
    each = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_choices"))
    return each.withColumn("nth", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]))).withColumn("shown", F.col("nth") <= shown)


def forwards_of(headers: DataFrame, samples: str, doc_id: int, task: str | None = None) -> DataFrame:
    """Forwards whose samples cover a document."""
    return headers.where(F.exists(samples, lambda s: (s["doc_id"] == doc_id) & (F.lit(True) if task is None else s["task_name"] == task)))


def hook_pairs(events: DataFrame, key: list[str], order: str, event: str, given: str, made: str) -> DataFrame:
    """Calls of a module with what went in and what came out, last in first out, so that recursive calls meet their own results.

    ``key`` tells a module of a session. An enter is call 0, 1, ... of its
    module and waits at its level of recursion; an exit takes the innermost
    one that waits. Rows: key, call, level, enter, exit, input, output,
    status; calls that never return have no output, and a result that no call
    waits for is an orphan without a call.
    """
    w = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enters = F.col(event) == "enter"
    moved = events.where(F.col(event).isin("enter", "exit")).select(*key, F.col(order).alias("_i"), enters.alias("_in"), F.col(given).alias("_given"), F.col(made).alias("_made"))
    moved = moved.withColumn("_h", F.sum(F.when(F.col("_in"), 1).otherwise(-1)).over(w)).withColumn("_call", F.count_if("_in").over(w) - 1)
    moved = moved.withColumn("_low", F.least(F.lit(0), F.min("_h").over(w))).withColumn("_level", F.when(F.col("_in"), F.col("_h")).otherwise(F.col("_h") + 1))
    at = Window.partitionBy(*key, "_level").orderBy("_i")
    moved = moved.withColumn("_then", F.lead(F.struct("_in", "_i", "_made")).over(at)).withColumn("_met", F.coalesce(F.lag("_in").over(at), F.lit(False)))
    back = F.col("_in") & F.coalesce(~F.col("_then._in"), F.lit(False))
    out = moved.where(F.col("_in") | ~F.col("_met"))
    return out.select(
        *key, F.when(F.col("_in"), F.col("_call")).alias("call"), F.when(F.col("_in"), F.col("_level") - F.col("_low")).alias("level"), F.when(F.col("_in"), F.col("_i")).alias("enter"),
        F.when(back, F.col("_then._i")).when(~F.col("_in"), F.col("_i")).alias("exit"), F.when(F.col("_in"), F.col("_given")).alias("input"), F.when(back, F.col("_then._made")).when(~F.col("_in"), F.col("_made")).alias("output"),
        F.when(back, "paired").when(F.col("_in"), "pending").otherwise("orphan").alias("status"),
    )


def innermost(events: DataFrame, session: list[str], order: str, opens: Column, closes: Column, value: Column, name: str) -> DataFrame:
    """``events`` with columns ``name`` and ``name_at``: the value and the order of the innermost bracket open after each event, null where none is.

    Levels replace a stack: the bracket open at level h is the last one that
    was opened to that level. A close that nothing opened does nothing.
    """
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = events.withColumn("_h", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    moved = moved.withColumn("_h", F.col("_h") - F.least(F.lit(0), F.min("_h").over(w)))
    at = Window.partitionBy(*session, "_h").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(opens, F.struct(F.col(order).alias("at"), value.alias("v"))), ignorenulls=True).over(at)
    moved = moved.withColumn("_b", F.when(F.col("_h") > 0, last))
    return moved.withColumn(name, F.col("_b.v")).withColumn(f"{name}_at", F.col("_b.at")).drop("_h", "_b")


def sticky_samples(events: DataFrame, session: list[str], order: str, sets: Column, value: Column, suppresses: Column, ends: Column, name: str) -> DataFrame:
    """``events`` with the samples they belong to: the last that were noted, for all events that follow.

    Inside a bracket of probes nothing is attributed unless noted there, and
    after it what held before holds again, however brackets nest.
    """
    inside = innermost(events, session, order, suppresses, ends, F.col(order), "_probe")
    w = Window.partitionBy(*session, "_probe_at").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return inside.withColumn(name, F.last(F.when(sets, value), ignorenulls=True).over(w)).drop("_probe", "_probe_at")
