"""Reductions over a stream of captured arrays: kept as state until a forward is whole, reset when its document ends.

A stream carries three kinds of rows, in any order and over any number of
batches: arrays of a layer or block, the header of a forward (how many arrays
of each source it has, and its target), and the end of a document (how many
forwards it has). A document is a key of ``transformWithStateInPandas`` with
four state variables. When the last part of a forward arrives its arrays go to
every reducer in the order of their index, the forward's rows are emitted and
its arrays released; when all forwards of a document are done the reducers'
own rows are emitted and nothing of it stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Columns of the stream.
INPUT = "doc_id long, kind string, forward int, source string, index int, array array<double>, n_arrays map<string,int>, target int, n_forwards int"
#: Columns of what comes out: what a reducer says of an index, or of two; forward is null in rows of a document.
OUTPUT = "doc_id long, reducer string, forward int, i int, j int, token_id long, value double, vector array<double>"

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Forward:
    """What a reducer is told of the forward it is fed."""

    doc_id: int
    number: int
    target: int | None


@dataclass
class StreamReducer:
    """Base of the reducers: ``update`` takes one array, ``end_forward`` and ``finalize`` give rows (i, j, token_id, value, vector).

    ``memory`` is the reducer's own state of the document, of JSON types; it
    is kept between batches and ends with the document.
    """

    name: str = ""
    version: int = 1
    source: str = "residual"
    arrays: dict[int, np.ndarray] = field(default_factory=dict)

    def update(self, index: int, array: np.ndarray, forward: Forward, memory: dict[str, Any]) -> None:
        self.arrays[index] = array

    def end_forward(self, forward: Forward, memory: dict[str, Any]) -> Iterable[tuple]:
        return ()

    def finalize(self, doc_id: int, memory: dict[str, Any]) -> Iterable[tuple]:
        return ()


@dataclass
class LogitLens(StreamReducer):
    """Likeliest token of each layer with its probability, and the rank of the target."""

    name: str = "logit_lens"
    source: str = "logits"

    def end_forward(self, forward, memory):
        for layer, a in sorted(self.arrays.items()):
            p = np.exp(a - a.max())
            known = forward.target is not None and 0 <= forward.target < len(a)
            yield layer, int((a > a[forward.target]).sum()) if known else None, int(a.argmax()), float(p.max() / p.sum()), None


@dataclass
class Similarity(StreamReducer):
    """Cosine of every two layers, the diagonal included; null where a vector is zero."""

    name: str = "layer_similarity"

    def end_forward(self, forward, memory):
        layers = sorted(self.arrays)
        norms = {k: float(np.sqrt((self.arrays[k] ** 2).sum())) for k in layers}
        for n, i in enumerate(layers):
            for j in layers[n:]:
                size = norms[i] * norms[j]
                yield i, j, None, float(self.arrays[i] @ self.arrays[j]) / size if size else None, None


@dataclass
class ValueNorm(StreamReducer):
    """Norm of each key-value head's part of a block's values, repeated for the query heads that share it."""

    name: str = "value_norm"
    source: str = "value"
    kv_heads: int = 1
    heads: int = 1

    def end_forward(self, forward, memory):
        for block, a in sorted(self.arrays.items()):
            norms = np.sqrt((a.reshape(self.kv_heads, -1) ** 2).sum(axis=1))
            for head, x in enumerate(np.repeat(norms, self.heads // self.kv_heads)):
                yield block, head, None, float(x), None


@dataclass
class AttentionWeights(StreamReducer):
    """Last-query weights of each block and head; of a document's forwards only the first is kept."""

    name: str = "attention_weights"
    source: str = "attention"
    heads: int = 1

    def end_forward(self, forward, memory):
        if forward.number == 0:
            for block, a in sorted(self.arrays.items()):
                for head, weights in enumerate(a.reshape(self.heads, -1)):
                    yield block, head, None, None, weights.tolist()


@dataclass
class HiddenStates(StreamReducer):
    """The vectors of chosen layers."""

    name: str = "hidden_states"
    layers: tuple[int, ...] = ()

    def end_forward(self, forward, memory):
        for layer in self.layers:
            if layer in self.arrays:
                yield layer, None, None, None, self.arrays[layer].tolist()


@dataclass
class LastLayerDrift(StreamReducer):
    """A reducer whose state outlives a forward: how far the last layer moved from each forward to the one before it, on average."""

    name: str = "last_layer_drift"

    def end_forward(self, forward, memory):
        memory.setdefault("last", {})[str(forward.number)] = self.arrays[max(self.arrays)].tolist()
        return ()

    def finalize(self, doc_id, memory):
        last = [np.array(v) for _, v in sorted(memory.get("last", {}).items(), key=lambda x: int(x[0]))]
        if len(last) > 1:
            yield None, None, None, float(np.mean([np.sqrt(((b - a) ** 2).sum()) for a, b in zip(last, last[1:], strict=False)])), None


class _Documents(StatefulProcessor):
    """The arrays of open forwards, their headers, the reducers' memory and the document's counters, each a typed state variable."""

    def __init__(self, reducers: list[StreamReducer]):
        self.reducers = reducers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arrays = handle.getMapState("arrays", "forward int, source string, index int", "array array<double>")
        self.headers = handle.getMapState("headers", "forward int", "n_arrays map<string,int>, target int, n_held int, done boolean")
        self.memory = handle.getMapState("memory", "reducer string", "state string")
        self.document = handle.getValueState("document", "n_forwards int, n_done int, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        doc_id = int(key[0])
        total, n_done, ended = self.document.get() if self.document.exists() else (None, 0, False)
        out, touched = [], set()
        # A part that comes again, in this batch or a later one, changes nothing; after the end nothing is taken up.
        for r in (r for frame in rows if not ended for r in frame.itertuples(index=False)):
            if r.kind == "document":
                total = int(r.n_forwards)
                continue
            forward = int(r.forward)
            counts, target, held, done = self.headers.getValue((forward,)) if self.headers.containsKey((forward,)) else (None, None, 0, False)
            if done:
                continue
            if r.kind == "forward":
                counts, target = dict(r.n_arrays), None if pd.isna(r.target) else int(r.target)
            else:
                at = (forward, r.source, int(r.index))
                if not self.arrays.containsKey(at):
                    self.arrays.updateValue(at, (list(r.array),))
                    held += 1
            self.headers.updateValue((forward,), (counts, target, held, False))
            touched.add(forward)
        for forward in sorted(touched):
            counts, target, held, _ = self.headers.getValue((forward,))
            if counts is not None and held >= sum(counts.values()):
                out += self._end_forward(Forward(doc_id, forward, target), counts)
                self.headers.updateValue((forward,), (None, None, 0, True))
                n_done += 1
        if total is not None and n_done >= total and not ended:
            for reducer in self.reducers:
                out += [(doc_id, reducer.name, None, *row) for row in reducer.finalize(doc_id, self._memory(reducer))]
            for state in (self.arrays, self.headers, self.memory):
                state.clear()
            # A marker stays so that a part that comes late opens nothing; it is a few bytes.
            ended = True
        self.document.update((total, n_done, ended))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({c: "Int64" for c in ("forward", "i", "j", "token_id")})

    def _memory(self, reducer: StreamReducer) -> dict:
        at = (reducer.name,)
        return json.loads(self.memory.getValue(at)[0]) if self.memory.containsKey(at) else {}

    def _end_forward(self, forward: Forward, counts: dict[str, int]) -> list[tuple]:
        """Feed every reducer its arrays by index, take its rows and release the arrays."""
        held = {source: {i: np.array(self.arrays.getValue((forward.number, source, i))[0]) for i in range(n)} for source, n in counts.items()}
        out = []
        for reducer in self.reducers:
            memory, reducer.arrays = self._memory(reducer), {}
            for index, array in sorted(held.get(reducer.source, {}).items()):
                reducer.update(index, array, forward, memory)
            out += [(forward.doc_id, reducer.name, forward.number, *row) for row in reducer.end_forward(forward, memory)]
            reducer.arrays = {}
            if memory:
                self.memory.updateValue((reducer.name,), (json.dumps(memory),))
        for source, n in counts.items():
            for i in range(n):
                self.arrays.removeKey((forward.number, source, i))
        return out

    def close(self) -> None:
        pass


def reduced(stream: DataFrame, reducers: list[StreamReducer]) -> DataFrame:
    """Rows OUTPUT of a stream INPUT, each once, as forwards and documents end. The session must keep state in RocksDB (PROVIDER)."""
    names = [r.name for r in reducers]
    if len(set(names)) < len(names):
        raise ValueError("two reducers have one name")
    held = stream.select(*(c.split()[0] for c in INPUT.split(", ")))
    return held.groupBy("doc_id").transformWithStateInPandas(_Documents(reducers), OUTPUT, "append", "None")


def layer_rows(arrays: DataFrame, headers: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows INPUT of three tables: arrays (doc_id, forward, source, index, array), headers (doc_id, forward, n_arrays, target), documents (doc_id, n_forwards)."""
    names = [c.split() for c in INPUT.replace("map<string,int>", "map<string-int>").split(", ")]

    def filled(df: DataFrame, kind: str) -> DataFrame:
        df = df.withColumn("kind", F.lit(kind))
        return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t.replace("-", ",")).alias(n) for n, t in names))

    return filled(arrays, "array").unionByName(filled(headers, "forward")).unionByName(filled(documents, "document"))
