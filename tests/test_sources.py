import http.server
import io
import time
import threading
import json
import math
import urllib.error
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runlens.operators import checks
from runlens.operators.checks import REQUIRED_MANIFEST
from runlens.plans import reports
from runlens.schema import TABLES
from runlens.functions import metrics
from runlens.sources import judges
from runlens.sources import runs as source
from runlens.streaming import ingest


@pytest.fixture
def run(tmp_path):
    return f"file://{tmp_path}/run"


def test_missing_table_is_empty(spark, run):
    assert source.read_table(spark, run, "signals").schema.names == TABLES["signals"].names
    with pytest.raises(KeyError):
        source.read_table(spark, run, "nothing")


def test_tables_round_trip(spark, run):
    rows = spark.createDataFrame([("t", 1, 0, True, "dropped")], "task_name string, doc_id long, choice_idx int, is_correct boolean, more string")
    source.append(rows, run, "docs")
    source.append(spark.createDataFrame([("t", 1, 0, 0, 2, 0.5)], "task_name string, doc_id long, choice_idx int, step int, layer int, lens_prob double"), run, "signals")
    (r,) = source.load_signals(spark, run).collect()
    assert (r.layer, r.is_correct, r.predicted) == (2, True, None)
    source.check_recorded(spark, run, ["docs", "signals"])
    source.append(rows, run, "docs")
    with pytest.raises(ValueError, match="not unique"):
        source.load_signals(spark, run)
    source.write_docs(source.read_table(spark, run, "docs").distinct().cache(), f"{run}2")
    assert source.existing_keys(spark, f"{run}2", "docs").count() == 1


def test_manifests(spark, run, tmp_path):
    document = {"schema_version": "0.4", "manifest": dict.fromkeys(REQUIRED_MANIFEST, 1), "results": {"t": {"acc,none": 0.5}}}
    source.write_results(spark, run, document)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/results.json").write_text("{")
    (r,) = source.discover_runs(spark, f"file://{tmp_path}").collect()
    assert r.path.endswith("/run") and r.results == {"t": {"acc,none": 0.5}}
    with pytest.raises(ValueError):
        source.write_results(spark, run, {"manifest": {}})
    document["results"]["t"]["acc_stderr,none"] = float("nan")
    source.write_results(spark, run, document)
    source.mark_complete(spark, run, more=1)
    manifest = source.read_manifest(spark, run)
    assert (manifest["completed"], manifest["more"]) == (True, 1) and "finished_at" in manifest
    (r,) = source.discover_runs(spark, f"file://{tmp_path}").collect()
    assert math.isnan(r.results["t"]["acc_stderr,none"])
    with pytest.raises(FileNotFoundError):
        source.read_results(spark, f"{run}/none")


def test_a_whole_manifest_is_accepted():
    """Every key that a run writes (fixed values), and none that it does not."""
    manifest = {
        "schema_version": "0.4", "tool_version": "1", "lm_eval_version": "0.4.9", "model_id": "m", "tokenizer_id": "m", "tasks": ["t"], "num_fewshot": 0, "limit": None, "doc_id_set_hash": "h",
        "reducers": [], "n_blocks": 2, "layer_index_convention": "c", "attn_index_convention": "c", "fixed_settings": {}, "seed": 1234, "started_at": "now", "completed": False,
    }
    checks.refuse_missing(manifest)
    for key in manifest:
        with pytest.raises(ValueError, match=key):
            checks.refuse_missing({k: v for k, v in manifest.items() if k != key})


def test_samples(spark, run, tmp_path):
    (tmp_path / "run").mkdir()
    lines = [{"task_name": "t", "doc_id": i, "filter": f, "metrics": ["acc"], "acc": 1.0} for i, f in ((1, "none"), (2, None), (3, "strict"))]
    (tmp_path / "run/samples.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    assert source.read_samples(spark, run).count() == 3
    assert sorted(r.doc_id for r in source.read_sample_metrics(spark, run, "acc").collect()) == [1, 2]
    assert [r.line for r in source.numbered_lines(spark, f"{run}/samples.jsonl").orderBy("line").collect()] == [1, 3, 5]


def test_mapping(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("language,task_name,doc_id,canonical_doc_id,canonical_choice_ids,canonical_answer_id\nen,t,1,c,a|b,\n")
    (r,) = source.load_mapping(spark, f"file://{path}").collect()
    assert (r.doc_id, r.canonical_choice_ids) == (1, ["a", "b"])
    path.write_text("language,task_name,doc_id,canonical_doc_id,canonical_choice_ids,canonical_answer_id\nen,t,true,c,,\n")
    with pytest.raises(ValueError):
        source.load_mapping(spark, f"file://{path}")


def test_traces(spark, tmp_path):
    lines = [{"i": 1, "event": "enter", "call": 1}, {"i": 2, "event": "input_numeric", "call": 1, "args": "a"}, {"i": 3, "event": "input_numeric", "call": 1, "args": "b"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (r,) = source.read_trace(spark, f"file://{tmp_path}/t.jsonl", "i long, event string, call long, args string").collect()
    assert r.numeric_args == "b"


def test_units_are_written_once(spark, run):
    rows = spark.createDataFrame([(1, 0.5)], "doc_id long, m double")
    for _ in range(2):
        source.append_custom(rows, run, "mine", "t/1")
    assert [tuple(r) for r in source.read_custom(spark, run, "mine").select("doc_id", "m", "unit").collect()] == [(1, 0.5, "t/1")]
    with pytest.raises(ValueError, match="schema"):
        source.append_custom(rows.withColumn("more", F.lit(1)), run, "mine", "t/2")
    with pytest.raises(ValueError, match="contract"):
        source.append_custom(rows, run, "mine", "t/2", {"other": 1})


def test_units_without_a_marker_do_not_count(spark, run):
    """An attempt that failed before its marker, in the same application, and the one that follows."""
    rows = spark.createDataFrame([(1, 0.5)], "doc_id long, m double")
    source.append_custom(rows, run, "mine", "t/1")
    rows.write.parquet(f"{run}/custom/mine/rows/attempt=u{'0' * 32}")
    assert source.append_custom(rows, run, "mine", "t/2") and not source.append_custom(rows, run, "mine", "t/2")
    assert source.read_custom(spark, run, "mine").count() == 2
    (path, *_) = Path(run.removeprefix("file://")).glob("custom/mine/rows/attempt=*/*.parquet")
    for path in Path(run.removeprefix("file://")).glob("custom/mine/rows/attempt=*/*.parquet"):
        if "0" * 32 not in str(path):
            path.unlink()
            break
    with pytest.raises(ValueError, match="damaged"):
        source.read_custom(spark, run, "mine")


def test_tensors(spark, run):
    rows = spark.createDataFrame([("t", 1, 0, "h", [2, 1], [1.0, 2.0])], "task_name string, doc_id long, choice_idx int, key string, shape array<int>, values array<float>")
    source.save_tensors(rows, run, "hidden")
    assert source.audit_tensors(spark, run, "hidden").count() == 0
    with pytest.raises(ValueError):
        source.save_tensors(rows, run, "hidden", limit=4)
    # What was refused has no index.
    assert [r.kind for r in source.audit_tensors(spark, run, "hidden").collect()] == ["orphan"]
    source.save_tensors(rows.withColumn("values", F.array(F.lit(3.0), F.lit(4.0))), run, "hidden")
    assert [r.values for r in source.read_tensors(spark, run, "hidden").collect()] == [[3.0, 4.0]]
    source.save_tensors(rows.withColumn("shape", F.array(F.lit(3))), run, "hidden")
    with pytest.raises(ValueError, match="shape"):
        source.read_tensors(spark, run, "hidden")
    assert source.run_files(spark, run).where("path LIKE 'tensors/hidden/index/%'").count() >= 1
    assert source.fingerprints(spark, f"{run}/tensors", "*.parquet").count() >= 1
    with pytest.raises(ValueError):
        source.read_statistics(spark, run, "passwords")
    with pytest.raises(FileNotFoundError, match="no trace"):
        source.read_statistics(spark, run, "samples")
    source.export_tables({"samples": spark.createDataFrame([(1,)], "count int")}, f"{run}/debug/module_stats/collection/s1")
    with pytest.raises(FileNotFoundError, match="collection"):
        source.read_statistics(spark, run, "samples")
    assert source.read_statistics(spark, run, "samples", "collection").dtypes == [("count", "bigint")]
    with pytest.raises(RuntimeError, match="no extremes"):
        source.read_statistics(spark, run, "extremes", "collection")


def test_judge_retries_and_checks():
    replies = [urllib.error.HTTPError("u", 429, "secret", {}, io.BytesIO()), urllib.error.URLError("x"), io.BytesIO(b'{"a": 1}')]

    def opener(request, timeout):
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    waits = []
    assert judges.ask({"endpoint": "http://judge", "model": "m", "max_retries": 3}, [], opener=opener, wait=waits.append) == {"a": 1} and waits == [1, 2]
    with pytest.raises(ValueError):
        judges.checked_scores({"a": float("inf")}, ["a"])
    with pytest.raises(ValueError):
        judges.checked_scores({"b": 1}, ["a"])


def test_judge_over_http(spark, monkeypatch):
    """What a server is sent, and what becomes of a refusal, an answer that comes too late and one that is no object."""
    monkeypatch.setenv("RUNLENS_TEST_KEY", "k1")
    seen, tries = [], {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            what = body["messages"][0]["content"]
            seen.append((self.headers["Authorization"], body["model"], body["temperature"], body["stream"]))
            tries[what] = tries.get(what, 0) + 1
            if what == "late":
                time.sleep(1.5)
            status = {"busy": 503 if tries[what] == 1 else 200, "wrong": 400}.get(what, 200)
            answer = b"[1]" if what == "list" else b'{"a": 1e999}' if what == "huge" else b'{"error": {"param": "temperature", "message": "k1"}}' if status == 400 else b'{"a": 0.5}'
            try:
                self.send_response(status)
                self.end_headers()
                self.wfile.write(answer)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = {"endpoint": f"http://127.0.0.1:{server.server_port}/v1", "model": "m", "api_key_env": "RUNLENS_TEST_KEY", "generation_kwargs": {"temperature": 0}, "timeout": 0.5, "max_retries": 1}
    with pytest.raises(RuntimeError, match="status 400, for temperature$"):
        judges.ask(config, [{"content": "wrong"}])
    with pytest.raises(RuntimeError, match="cannot be reached"):
        judges.ask(config, [{"content": "late"}])
    with pytest.raises(ValueError, match="no_key"):
        judges.ask(config | {"api_key_env": "no_key"}, [])
    assert tries == {"wrong": 1, "late": 2}
    work = spark.createDataFrame([(x, x) for x in ("fine", "busy", "late", "list", "huge", "wrong")], "identity string, record string")
    config.pop("api_key_env")
    out = judges.judge(work, config, lambda record: [{"content": record}], lambda record, answer: {"a": answer["a"]}, ["a"])
    assert {r.identity: (r.status, r.scores) for r in out.collect()} == {x: ("success", {"a": 0.5}) for x in ("fine", "busy")} | {x: ("failed", {}) for x in ("late", "list", "huge", "wrong")}
    assert set(seen) == {("Bearer k1", "m", 0, False), (None, "m", 0, False)}
    server.shutdown()


def test_judge_journal(spark):
    asked = spark.createDataFrame([("x",), ("y",)], "identity string")
    journal = spark.createDataFrame([("x", "success"), ("y", "failed")], "identity string, status string")
    assert [r.identity for r in judges.to_ask(asked, journal).collect()] == ["y"]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables = {"clicks": lambda b: b.where("event_type = 'click'"), "ids": lambda b: b.select("event_id")}
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream, tables, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert ingest.read_ingested(spark, f"{tmp_path}/out", "ids").count() == events.count()
    assert ingest.read_ingested(spark, f"{tmp_path}/out", "clicks").exceptAll(events.where("event_type = 'click'")).count() == 0


def test_windows_over_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = ingest.event_windows(stream, "ts", ["event_type"], "value", size="1 day").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
    q = ingest.sessions(stream, "ts", ["user_id"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == events.count()


def test_tasks_and_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.yaml").write_text("task: one\ndoc_to_text: !function helpers.text\n")
    (tmp_path / "a/helpers.py").write_text("raise AssertionError\n")
    tasks, files = source.discover_tasks(spark, f"file://{tmp_path}/a")
    assert tasks["one"]["doc_to_text"] == "helpers.text" and files.count() == 2
    with pytest.raises(ValueError, match="two tasks"):
        source.discover_tasks(spark, f"file://{tmp_path}/a", builtin=("one",))
    lines = [{"id": 1, "prompt": "p", "answer": "a"}, {"id": "1", "prompt": "p", "answer": "a"}, {"id": 2, "prompt": "p"}, {"id": 3, "prompt": "p", "answer": []}, {"id": 4, "prompt": "p", "answer": ["x"]}, {"id": True, "prompt": "p", "answer": "a"}]
    (tmp_path / "s.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    out = {r.line: r.problem for r in source.split_problems(spark, [f"file://{tmp_path}/s.jsonl"], "generate_until", "id").collect()}
    assert out == {1: "repeated id", 3: "repeated id", 5: "the answer is no text", 7: "the answer is no text", 9: None, 11: "no id"}
    judged = {r.line: r.problem for r in source.split_problems(spark, [f"file://{tmp_path}/s.jsonl"], "generate_until", "id", judged=True).collect()}
    assert judged[5] is None and judged[7] == "the answer is no text"


def test_trace_rings(spark, tmp_path):
    events = spark.range(20).select(F.col("id").alias("i"))
    assert source.write_trace(events, f"file://{tmp_path}/t", "i", 5) == 15
    assert sorted(r.i for r in spark.read.json(f"file://{tmp_path}/t").collect()) == list(range(15, 20))


def test_statistics_of_modules(spark):
    obs = spark.createDataFrame([("t", "m", "out", "0", "f32", "prefill", "bsh", 1, f, 2, 2, 0, 0, 0, 1.5, 0.5, 1.0, 2.0) for f in (1, 2)], "task_name string, module string, io string, tensor_path string, dtype string, stage string, layout string, doc_id long, forward long, count long, finite_count long, nan long, posinf long, neginf long, mean double, m2 double, min double, max double")
    out = reports.module_statistics(obs, spark.createDataFrame([(1, "complete"), (2, "incomplete")], "forward long, status string"))
    assert (out["samples"].first().observations, out["dataset"].first().documents) == (1, 1)


def test_traces_and_documents_of_a_run(spark, tmp_path):
    run = f"file://{tmp_path}/run"
    source.write_samples(spark.createDataFrame([("t", 1), ("t", 1), ("u", 2)], "task_name string, doc_id long"), run)
    assert sorted(tuple(r) for r in source.graded_documents(spark, run).collect()) == [("t", 1), ("u", 2)]
    source.append(spark.createDataFrame([("t", 5, 0)], "task_name string, doc_id long, choice_idx int"), run, "docs")
    assert [tuple(r) for r in source.graded_documents(spark, run).collect()] == [("t", 5)]
    assert source.list_traces(spark, run) == []
    (tmp_path / "run/debug").mkdir()
    for name in ("collection", "trace", "zzz"):
        (tmp_path / f"run/debug/{name}.jsonl").write_text("{}\n")
    assert [p.rsplit("/", 1)[1] for p in source.list_traces(spark, run)] == ["trace.jsonl", "collection.jsonl", "zzz.jsonl"]
    assert source.trace_path(run) == f"{run}/debug/trace.jsonl"


def test_user_metrics_and_filters(spark):
    df = spark.createDataFrame([(1, ["a 1", "b 2", "c 1"], "1"), (1, ["none", " X "], "x"), (2, [], "1"), (2, None, "1")], "k int, r array<string>, t string")
    chain = lambda *steps: metrics.filtered(F.col("r"), [{"function": s} if isinstance(s, str) else s for s in steps])
    got = df.select(chain({"function": "regex", "pattern": "([0-9])"}, "majority_vote").alias("a"), chain("take_first", "strip", "lowercase").alias("b"), chain({"function": "take_first_k", "k": 2}, {"function": "map", "mapping": {"a 1": "A"}, "default": "?"}).alias("c"), chain({"function": "function", "apply": lambda s: s.map(lambda x: None if x is None else list(x)[:1])}).alias("d")).collect()
    assert [r.a for r in got] == [["1"], ["[invalid]"], [], []] and [r.b for r in got] == [["a 1"], ["none"], [], None]
    assert [r.c for r in got] == [["A", "?"], ["?", "?"], [], None] and [r.d for r in got] == [["a 1"], ["none"], [], None]
    with pytest.raises(ValueError, match="no such filter"):
        chain("other")
    two = [metrics.Metric("same", lambda r, t: r == t), metrics.Metric("spread", lambda r, t: r.str.len().astype(float), lambda v: v.max() - v.min())]
    rows = spark.createDataFrame([(None, "1", "1"), (None, "22", "1"), (2, "1", "1")], "k int, r string, t string")
    out = {r.k: (r.same, r.spread) for r in metrics.aggregated(metrics.scored(rows, two, "r", "t"), ["k"], two).collect()}
    assert out == {None: (0.5, 1.0), 2: (1.0, 0.0)}
    with pytest.raises(ValueError, match="no aggregation"):
        metrics.Metric("m", len, "other")
