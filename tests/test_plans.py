import json
import random

import duckdb
import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from runlens import cli
from runlens.operators.checks import REQUIRED_MANIFEST
from runlens.plans import attach
from runlens.plans.queries import ORACLE_SQL, QUERIES
from runlens.sources import runs as source


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def docs(spark):
    return frame(spark, [("a", 1), ("a", 2), ("b", 1), ("b", 3)], "run string, doc long")


def fields(spark, **columns):
    rows = [(run, doc, name, value) for name, values in columns.items() for (run, doc), value in zip([("a", 1), ("a", 2), ("b", 1), ("b", 3)], values, strict=True)]
    return frame(spark, rows, "run string, doc long, field string, value string")


def test_one_field_pairs(spark, docs):
    out, kind = attach.attach_pairing(docs, fields(spark, name=["x", "y", "y", "x"], other=["p", "p", "q", "q"]))
    assert kind == "field" and {(r.run, r.doc): r.pair_key for r in out.collect()} == {("a", 1): "x", ("a", 2): "y", ("b", 1): "y", ("b", 3): "x"}


def test_precedence_and_refusals(spark, docs):
    two = fields(spark, name=["x", "y", "y", "x"], other=["p", "q", "p", "q"])
    with pytest.raises(ValueError, match="several"):
        attach.attach_pairing(docs, two)
    assert attach.attach_pairing(docs, two, pair_on="name")[1] == "field"
    with pytest.raises(ValueError, match="does not pair"):
        attach.attach_pairing(docs, two, pair_on="absent")
    out, kind = attach.attach_pairing(docs, strict=True)
    assert kind == "none" and {r.pairing_status for r in out.collect()} == {"strict_no_identity"}
    with pytest.raises(ValueError, match="strict"):
        attach.attach_pairing(docs, two, pair_on="position", strict=True)
    same = fields(spark, name=["x", "y", "y", "x"], other=["y", "x", "x", "y"])
    assert {(r.run, r.doc): r.pair_key for r in attach.attach_pairing(docs, same)[0].collect()}[("a", 1)] == "x"
    out, kind = attach.attach_pairing(docs, two, pair_on="position")
    assert kind == "position" and sorted(r.pairing_status for r in out.collect()) == ["not_in_every_language"] * 2 + ["paired"] * 2
    mapping = frame(spark, [("a", 1, "k"), ("b", 3, "k")], "run string, doc long, canonical string")
    with pytest.raises(ValueError):
        attach.attach_pairing(docs, two, mapping, "name")
    out, kind = attach.attach_pairing(docs, two, mapping)
    assert kind == "mapping" and sorted(r.pairing_status for r in out.collect()) == ["paired", "paired", "unmapped", "unmapped"]


def test_assumed_alignment(spark, docs):
    paired, kind = attach.attach_pairing(docs, pair_on="position")
    gold = frame(spark, [("a", 1, "choice:0"), ("b", 1, "choice:1")], "run string, doc long, gold string")
    status = attach.answer_statuses(paired, gold)
    series = frame(spark, [("a", "s1", "m", 0, "en"), ("b", "s2", "m", 0, "ko")], "run string, series string, model string, num_fewshot int, language string")
    table = attach.pairing_table(paired.selectExpr("*", "'t' AS task_name", "doc AS doc_id"), gold, series, kind)
    assert len(table.columns) == 17 and sorted((r.exclusion_reason or "", r.answer_status or "") for r in table.collect()) == [("", "disagree")] * 2 + [("not_in_every_language", "")] * 2
    assert {(r.series, r.documents, r.paired): r.excluded for r in attach.coverage(table).collect()} == {("s1", 2, 1): {"not_in_every_language": 1}, ("s2", 2, 1): {"not_in_every_language": 1}}
    assert {(r.run_path, r.outcome): r.n for r in attach.provenance(table).collect()} == {(r, o): 1 for r in "ab" for o in ("disagree", "not_in_every_language")}
    assert attach.comparable_keys(table, status).count() == 0 and attach.comparable_keys(table, status, True).count() == 1
    assert {r.kind: r.n for r in attach.evidence_kinds(gold).collect()} == {"choice": 2}


def test_command_line(spark, tmp_path, capsys):
    for name, done in (("one", True), ("two", True), ("three", False)):
        path = f"file://{tmp_path}/{name}"
        source.write_results(spark, path, {"schema_version": "0.4", "results": {}, "manifest": dict.fromkeys(REQUIRED_MANIFEST, "x") | {"tasks": ["t"], "model_id": name, "completed": done, "n_blocks": 2, "vocab_size": 10 if name == "one" else 20}})
        source.write_samples(frame(spark, [("t", 1, "h")], "task_name string, doc_id long, prompt_hash string"), path)
        source.append(frame(spark, [("t", 1, 0, 0, layer, 0.5, 0.25) for layer in range(3)], "task_name string, doc_id long, choice_idx int, step int, layer int, lens_prob double, target_percentile double"), path, "signals")
    assert cli.main(["report", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out"]) == 0
    said = capsys.readouterr().out
    assert "three: not completed" in said and "group A: 2 runs" in said and "vocabularies differ" in said
    out = spark.read.parquet(f"file://{tmp_path}/out/comparison")
    assert {(r.signal, r.relative_depth) for r in out.where(F.col("run").endswith("one")).collect()} == {("target_percentile", d) for d in (0.0, 0.5, 1.0)}
    (tmp_path / "t.jsonl").write_text('{"i": 1, "event": "enter", "call": 1, "forward": 1, "module": "m"}\n')
    assert cli.main(["debug", f"file://{tmp_path}/t.jsonl"]) == 0 and "unwound" in capsys.readouterr().out
    frame(spark, [("t", 1, "m")], "task_name string, doc_id long, module string").write.parquet(f"file://{tmp_path}/stats/samples")
    assert cli.main(["module-stats", f"file://{tmp_path}/stats", "--table", "samples", "--doc", "t#1", "--module", "^m"]) == 0


def test_report_across_languages(spark, tmp_path):
    """Two languages of one model: pairing by a field, a document whose answer differs, examples of what agrees."""
    for name, task, shift in (("en", "t_en", 0), ("ko", "t_ko", 10)):
        path = f"file://{tmp_path}/{name}"
        source.write_results(spark, path, {"schema_version": "0.4", "results": {task: {"acc,none": 0.5 + shift / 100}}, "manifest": dict.fromkeys(REQUIRED_MANIFEST, "x") | {"tasks": [task], "model_id": "m", "num_fewshot": 0, "completed": True, "n_blocks": 2}})
        rows = [(task, d + shift, c, d % 2 == 0, c == (1 if name == "ko" and d == 19 else 0), "p", "t", -1.0) for d in range(20) for c in range(2)]
        source.append(frame(spark, rows, "task_name string, doc_id long, choice_idx int, is_correct boolean, is_target_choice boolean, predicted string, target string, choice_logprob double"), path, "docs")
        source.append(frame(spark, [(task, d + shift, 0, 0, layer, 5) for d in range(20) for layer in range(3)], "task_name string, doc_id long, choice_idx int, step int, layer int, lens_token_id long"), path, "signals")
        samples = frame(spark, [(task, d + shift, f"id{d}", name) for d in range(20)], "task_name string, doc_id long, key string, own string").selectExpr("task_name", "doc_id", "named_struct('key', key, 'own', own || doc_id) AS doc")
        source.write_samples(samples, path)
    assert cli.main(["report", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out", "--multilingual", "en=t_en,ko=t_ko"]) == 0
    table = spark.read.parquet(f"file://{tmp_path}/out/pairing")
    assert {(r.pairing_status, r.answer_status): r["count"] for r in table.groupBy("pairing_status", "answer_status").count().collect()} == {("paired", "agree"): 38, ("paired", "disagree"): 2}
    assert {(r.pairing_source, r.language) for r in table.collect()} == {("field", "en"), ("field", "ko")}
    examples = spark.read.parquet(f"file://{tmp_path}/out/examples").collect()
    assert {r.bucket for r in examples} == {"all_correct", "all_wrong"} and len(examples) == 12 and all(r.settle_depth == 0.0 for r in examples)
    assert {r.is_reference for r in examples if r.run.endswith("/ko")} == {True}
    assert json.loads((tmp_path / "out/pairing.json").read_text())["groups"][0]["alignment"]["aligned"] is True
    assert cli.main(["report", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out2", "--multilingual", "en=t_en,ko=t_ko", "--pair-on", "nothing"]) == 1


def test_report_pairs_by_position(spark, tmp_path):
    """No field identifies a document: subtasks meet by what they add to the declared task; one language lacks some gold answers, and less is better."""
    for name, task, shift in (("en", "t_en", 0.0), ("ko", "t_ko", 0.2)):
        path = f"file://{tmp_path}/{name}"
        manifest = dict.fromkeys(REQUIRED_MANIFEST, "x") | {"tasks": [task], "model_id": "m", "num_fewshot": 0, "completed": True, "n_blocks": 4, "benchmarks": {"protocols": {task: {"primary_metric": "loss", "primary_filter": "none", "higher_is_better": False}}}}
        source.write_results(spark, path, {"schema_version": "0.4", "results": {task: {"loss,none": 0.5 + shift}}, "manifest": manifest})
        rows = [(f"{task}_{part}", d, c, d % 2 == 0, c == 0 and (name == "en" or d < 15), "p", "t", -1.0) for part in "ab" for d in range(20) for c in range(2)]
        source.append(frame(spark, rows, "task_name string, doc_id long, choice_idx int, is_correct boolean, is_target_choice boolean, predicted string, target string, choice_logprob double"), path, "docs")
        tokens = [(f"{task}_{part}", d, c, 0, layer, 5 if c == 0 and layer > 0 else layer) for part in "ab" for d in range(20) for c in range(2) for layer in range(3)]
        source.append(frame(spark, tokens, "task_name string, doc_id long, choice_idx int, step int, layer int, lens_token_id long"), path, "signals")
        samples = frame(spark, [(f"{task}_{part}", d, f"{name} text {part} {d}") for part in "ab" for d in range(20)], "task_name string, doc_id long, own string").selectExpr("task_name", "doc_id", "named_struct('own', own) AS doc")
        source.write_samples(samples, path)
    assert cli.main(["report", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out", "--multilingual", "en=t_en,ko=t_ko"]) == 0
    table = spark.read.parquet(f"file://{tmp_path}/out/pairing")
    assert {(r.pairing_status, r.answer_status): r["count"] for r in table.groupBy("pairing_status", "answer_status").count().collect()} == {("paired", "agree"): 60, ("paired", "no_gold_evidence"): 20}
    assert {r.canonical_doc_id for r in table.collect()} == {f"_{part}#{d}" for part in "ab" for d in range(20)} and {r.pairing_source for r in table.collect()} == {"position"}
    examples = spark.read.parquet(f"file://{tmp_path}/out/examples").collect()
    assert {r.series for r in examples if r.is_reference} == {"en"}
    # Where a run marks targets, a document without one has no row that counts.
    assert all(r.settle_depth == (None if r.series == "ko" and r.doc_id >= 15 else 0.25) for r in examples)
    assert {(r.axis, r.model, r.n_blocks) for r in examples} == {("language", "m", 4)} and {r.run_task for r in examples} <= {f"t_{x}_{y}" for x in ("en", "ko") for y in "ab"}
    drawn = json.loads((tmp_path / "out/examples.json").read_text())["groups"][0]
    assert drawn["pool_sizes"] == {"all_correct": 20, "all_wrong": 20} and drawn["taken"] == {"all_correct": 3, "all_wrong": 3} and drawn["eligible"] == 40 and drawn["datasets"] == ["en=t_en", "ko=t_ko"]


@pytest.mark.parametrize("name", ["agreement_buckets", "examples_report"])
def test_means_at_the_threshold_are_summed_in_the_order_of_the_rows(spark, tmp_path, name):
    # Every mean is 0.05 but for rounding, and the rows of each document lie in several files.
    r = random.Random(3)
    rows = [(doc, float(r.randrange(1, 51)), x / 100, run) for doc in range(200) for run in "ANR" for _ in range(4) for k in [r.randrange(11)] for x in (k, 10 - k)]
    r.shuffle(rows)
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql("CREATE TABLE t (nth BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(n, *row) for n, row in enumerate(rows)])
    (tmp_path / "lineitem.parquet").mkdir()
    for part in range(6):
        c.sql(f"COPY (SELECT * EXCLUDE nth FROM t WHERE nth % 6 = {part} ORDER BY nth) TO '{tmp_path}/lineitem.parquet/part-{part}.parquet'")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df, found = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
