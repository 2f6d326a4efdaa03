import datetime
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import requests, selection, trace
from runlens.streaming import ingest, reducers, traces


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reducers.PROVIDER)


def run(spark, tmp_path, parts, transform):
    """What a stream leaves in its sink, going on after each part."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in")
        transform(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_stacks_unwind_and_their_state_ends(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    schema = "s long, i long, event string, ts timestamp"
    first = [(1, 2, "enter", at(2)), (1, 1, "exit", at(1)), (1, 4, "enter", at(4)), (2, 1, "enter", at(1)), (2, 2, "enter", at(2)), (1, 3, "enter", at(3))]
    second = [(1, 6, "enter", at(6)), (1, 5, "restart", at(5)), (1, 7, "exit", at(7)), (1, 8, "exit", at(8))]
    clock = [(-1, 0, "beat", at(600))]
    parts = [spark.createDataFrame(p, schema) for p in (first, second, clock)]
    out = run(spark, tmp_path, parts, lambda s: traces.open_calls(s, "s", "i", "event", "ts", "2 minutes", "1 hour", "restart"))
    got = sorted(((r.s, r.enter, r.exit, r.depth, r.status, r.deepest, r.reason) for r in out.collect()), key=str)
    again, ended = "a new batch was declared", "the session ended"
    assert got == sorted([(1, None, 1, 0, "orphan", None, None), (1, 2, None, 1, "unwound", False, again), (1, 3, None, 2, "unwound", False, again), (1, 4, None, 3, "unwound", True, again), (1, 6, 7, 1, "closed", None, None), (1, None, 8, 0, "orphan", None, None), (2, 1, None, 1, "unwound", False, ended), (2, 2, None, 2, "unwound", True, ended)], key=str)
    for state in ("stack", "last", "waiting"):
        held = spark.read.format("statestore").option("stateVarName", state).load(f"{tmp_path}/c")
        assert {r.key.session for r in held.select("key").collect()} <= {-1}


def test_a_session_costs_few_requests_to_its_state():
    asked = []

    class Handle:
        """A state that counts what is asked of it."""

        def __init__(self, name=None):
            self.name, self.value = name, None

        def __getattr__(self, call):
            def ask(*args):
                if call.startswith("get") and args:
                    return Handle(args[0])
                asked.append((self.name, call))
                if call in ("put", "update"):
                    self.value = args[0]
                return {"exists": self.value is not None, "get": self.value, "listTimers": []}.get(call)

            return ask

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815

    stack = traces._Stack("restart", 1000)
    stack.init(Handle())
    rows = [(7, None, i, i + 1, ("enter", "view", "exit")[i % 3]) for i in range(300)]
    assert list(stack.handleInputRows((7,), iter(rows), Times)) == []
    assert sorted(asked, key=str) == [("last", "get"), ("last", "update"), ("waiting", "update"), (None, "registerTimer")]
    # Events that neither open nor close a call are not kept.
    assert len(stack.waiting.value[0]) == 200


def test_reducers_hold_a_forward_until_it_is_whole(spark, tmp_path):
    arrays = spark.createDataFrame([(1, f, "residual", k, [float(f + k), 1.0]) for f in range(2) for k in range(3)], "doc_id long, forward int, source string, index int, array array<double>")
    headers = spark.createDataFrame([(1, f, {"residual": 3}, None) for f in range(2)], "doc_id long, forward int, n_arrays map<string,int>, target int")
    ends = spark.createDataFrame([(1, 2)], "doc_id long, n_forwards int")
    rows = reducers.layer_rows(arrays, headers, ends)
    # The end comes first, the last layer of the first forward last, and one part twice.
    late = (F.col("forward") == 0) & (F.col("index") == 2)
    parts = [rows.where("kind = 'document'"), rows.where((F.col("kind") != "document") & ~F.coalesce(late, F.lit(False))), rows.where("forward = 1 AND index = 0"), rows.where(late)]
    chosen = [reducers.HiddenStates(layers=(2,)), reducers.LastLayerDrift(), reducers.Similarity()]
    out = run(spark, tmp_path, parts, lambda s: reducers.reduced(s, chosen)).collect()
    assert {(r.forward, tuple(r.vector)) for r in out if r.reducer == "hidden_states"} == {(0, (2.0, 1.0)), (1, (3.0, 1.0))}
    assert [r.value for r in out if r.reducer == "last_layer_drift"] == [1.0]
    assert sorted((r.forward, r.i, r.j) for r in out if r.reducer == "layer_similarity") == [(f, i, j) for f in range(2) for i in range(3) for j in range(i, 3)]
    for state in ("arrays", "headers", "memory"):
        assert spark.read.format("statestore").option("stateVarName", state).load(f"{tmp_path}/c").count() == 0
    with pytest.raises(ValueError, match="one name"):
        reducers.reduced(rows, [reducers.Similarity(), reducers.Similarity()])


def test_tables_of_a_batch_are_seen_together(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    batches = [spark.createDataFrame([(d, c) for d in range(k, k + 7) for c in range(2)], "doc long, c int") for k in (0, 10)]

    def fails(batch):
        raise RuntimeError("killed")

    good = {"a": lambda b: b, "b": lambda b: b.where("c = 0")}
    ingest.roll_batch(batches[0], 0, good, out, ["doc"], 5)
    with pytest.raises(RuntimeError, match="killed"):
        ingest.roll_batch(batches[1], 1, {"a": good["a"], "b": fails}, out, ["doc"], 5)
    assert {t: ingest.read_rolled(spark, out, t).count() for t in "ab"} == {"a": 14, "b": 7}
    for _ in range(2):  # a batch that is repeated changes nothing
        ingest.roll_batch(batches[1], 1, good, out, ["doc"], 5)
    assert {t: ingest.read_rolled(spark, out, t).count() for t in "ab"} == {"a": 28, "b": 14}
    shards = [{(r.doc, r.shard) for r in ingest.read_rolled(spark, out, t).select("doc", "shard").collect()} for t in "ab"]
    assert shards[0] == shards[1] == {(d, n // 5) for n, d in enumerate([*range(7), *range(10, 17)])}


def test_recursive_modules_meet_their_own_results(spark):
    events = [("enter", 1.0), ("enter", 2.0), ("exit", 20.0), ("exit", 10.0), ("exit", 99.0), ("enter", 3.0)]
    df = spark.createDataFrame([("m", i, e, v) for i, (e, v) in enumerate(events)], "m string, i long, event string, v double")
    got = {(r.status, r.call, r.level, r.input, r.output) for r in trace.hook_pairs(df, ["m"], "i", "event", "v", "v").collect()}
    assert got == {("paired", 0, 1, 1.0, 10.0), ("paired", 1, 2, 2.0, 20.0), ("orphan", None, None, None, 99.0), ("pending", 2, 1, 3.0, None)}


def test_samples_hold_again_after_probes(spark):
    events = ["note a", "x", "probe", "x", "note b", "probe", "x", "end", "x", "end", "x", "end", "x"]
    df = spark.createDataFrame([("s", i, e.split()[0], (e.split() + [None])[1]) for i, e in enumerate(events)], "s string, i long, event string, v string")
    is_ = lambda name: F.col("event") == name
    out = trace.sticky_samples(df, ["s"], "i", is_("note"), F.col("v"), is_("probe"), is_("end"), "samples").orderBy("i").collect()
    assert [r.samples for r in out if r.event == "x"] == ["a", None, None, "b", "a", "a"]


def test_medians_are_exact(spark):
    r = random.Random(2)
    rows = [(k, x) for k, n in (("a", 1), ("b", 2), ("c", 1001), ("d", 5000), (None, 4)) for x in (r.choice([r.gauss(0, 1), float(r.randrange(3)), -1e300]) for _ in range(n))] + [("e", None), ("f", 7.0), ("f", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    held = {}
    for k, x in rows:
        if x is not None:
            held.setdefault(k, []).append(x)
    low = {r.k: (r.n, r.median) for r in selection.lower_median(df, ["k"], "x").collect()}
    assert low == {k: (len(v), sorted(v)[(len(v) + 1) // 2 - 1]) for k, v in held.items()}
    middle = {r.k: r.median for r in selection.median(df, ["k"], "x").collect()}
    assert middle == {k: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 for k, v in held.items()}
    assert selection.median(df, [], "x").first().n == sum(map(len, held.values()))


def test_ranks_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    got = sorted(requests.ranked(df, [-F.col("y"), F.col("x")], "row").collect(), key=lambda r: r.row)
    assert [r.row for r in got] == list(range(1000)) and [(r.y, r.x) for r in got] == sorted(((r.y, r.x) for r in got), key=lambda t: (-t[0], t[1]))


def test_ranks_when_the_counts_take_fewer_partitions_than_the_rows(spark):
    # The counts need no payload: alone, the keys fit one partition, the rows don't.
    payload = F.concat(*(F.sha2(F.concat_ws("|", F.lit(k), "id"), 512) for k in range(8)))
    df = spark.range(20000).select((F.col("id") * 37 % 20000).alias("x"), payload.alias("payload")).repartition(7)
    got = requests.ranked(df, [F.col("x")], "row").select("x", "row", F.md5("payload")).collect()
    assert sorted((r.x, r.row) for r in got) == [(x, x) for x in range(20000)]


def test_shared_forwards_read_the_trailing_part(spark):
    rows = [(0, [1, 2], [3, 4]), (1, [1, 2, 3], [9]), (2, [1], [2, 3, 7]), (3, [5], [6])]
    df = spark.createDataFrame(rows, "i long, ctx array<int>, cont array<int>")
    out = requests.scored_positions(requests.batched(df, "i", "ctx", "cont"), "i", [], "ctx", "cont", 10).collect()
    assert sorted((r.i, r.row, r.step, r.position, r.target) for r in out) == [(0, 0, 0, 1, 3), (0, 0, 1, 2, 4), (1, 0, 0, 2, 9), (2, 0, 0, 0, 2), (2, 0, 1, 1, 3), (2, 0, 2, 2, 7), (3, 1, 0, 0, 6)]
    short = requests.scored_positions(requests.batched(df, "i", "ctx", "cont"), "i", [], "ctx", "cont", 2).where("i = 1").first()
    assert (short.position, short.input_length, short.input_offset) == (1, 2, 1)
    assert {r.row for r in requests.batched(df, "i", "ctx", "cont", share=False).collect()} == {0, 1, 2, 3}
