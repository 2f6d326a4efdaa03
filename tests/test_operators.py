import hashlib
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runlens import schema
from runlens.functions import hooks, scalar
from runlens.operators import checks, docs, moments, pairing, runs, signals, tensors, trace

NAN, INF = float("nan"), float("inf")


def one(df):
    (row,) = df.collect()
    return row


def test_settlement(spark):
    rows = [(d, i, t) for d, tokens in enumerate(([5, 7, 9, 9, 9], [9, 9, 9, 1, 9], [9, 9, 9, 9])) for i, t in enumerate(tokens)]
    out = signals.prediction_depth(spark.createDataFrame(rows, "doc int, layer int, token int"), ["doc"], "layer", "token")
    assert {r.doc: (r.settled_layer, r.depth) for r in out.collect()} == {0: (2, 0.5), 1: (4, 1.0), 2: (0, 0.0)}


def test_settlement_with_null_tokens(spark):
    rows = [(0, 0, 1), (0, 1, None), (0, 2, 1), (1, 0, None)]
    out = signals.prediction_depth(spark.createDataFrame(rows, "doc int, layer int, token int"), ["doc"], "layer", "token")
    assert {r.doc: r.settled_layer for r in out.collect()} == {0: 2, 1: 0}


def test_relative_depth(spark):
    df = spark.createDataFrame([(0, 32, "residual"), (32, 32, "residual"), (0, 32, "block"), (3, 0, "residual")], "i int, n int, d string")
    assert [r[0] for r in df.select(scalar.relative_depth(F.col("i"), F.col("n"), F.col("d"))).collect()] == [0.0, 1.0, 0.015625, 0.0]


def test_repeated_documents_are_refused(spark):
    held = spark.createDataFrame([("t", 1, 0), ("t", 1, 0)], "task_name string, doc_id long, choice_idx int")
    with pytest.raises(ValueError, match="not unique"):
        signals.join_docs(held, held, ["task_name", "doc_id", "choice_idx"])


def test_moments_keep_the_non_finite_apart(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", NAN), ("a", INF), ("a", -INF), ("a", None), ("b", NAN)], "k string, v double")
    out = {r.k: r for r in moments.moments(df, ["k"], "v").collect()}
    a, b = out["a"], out["b"]
    assert (a["count"], a.finite_count, a.nan, a.posinf, a.neginf, a["mean"], a.m2, a["min"], a["max"]) == (5, 2, 1, 1, 1, 2.0, 2.0, 1.0, 3.0)
    assert (b.finite_count, b["mean"], b.m2, b["min"]) == (0, None, None, None)


def test_merging_parts_equals_one_pass(spark):
    df = spark.createDataFrame([("a", i % 3, 1e9 + i) for i in range(60)] + [("a", 7, NAN), ("b", 0, NAN)], "k string, part int, v double")
    whole = {r.k: r for r in moments.moments(df, ["k"], "v").collect()}
    for r in moments.merge(moments.moments(df, ["k", "part"], "v"), ["k"]).collect():
        w = whole[r.k]
        assert (r["count"], r.nan, r["min"], r["max"]) == (w["count"], w.nan, w["min"], w["max"])
        assert r.m2 == w.m2 or math.isclose(r.m2, w.m2, rel_tol=1e-6)


def test_two_stages(spark):
    df = spark.createDataFrame([("g", d, f, v) for d, f, v in ((1, 1, 1.0), (1, 1, 3.0), (2, 2, 10.0), (3, 9, 100.0))], "g string, doc_id int, forward int, v double")
    forwards = spark.createDataFrame([(1, "complete"), (2, "complete"), (9, "incomplete")], "forward int, status string")
    calls = moments.moments(df, ["g", "doc_id", "forward"], "v")
    samples = moments.pool_calls(calls, forwards, ["g"])
    out = one(moments.pool_documents(samples, ["g"]))
    assert (out.documents, out.finite_documents, out.sample_mean, out.sample_mean_std) == (2, 2, 6.0, 4.0)
    assert math.isclose(out.pooled_mean, 14 / 3)
    single = one(moments.pool_documents(samples.where("doc_id = 1"), ["g"]))
    assert (single.sample_mean_sample_std, single.sample_mean_sem) == (None, None)


def test_extremes_ties_and_infinities(spark):
    df = spark.createDataFrame([(1, [1.0, -3.0, 3.0, INF, NAN, 2.0])], "k int, a array<double>")
    assert [(r.abs_rank, r.flat_index, r.value) for r in moments.extremes(df, ["k"], "a", 3).orderBy("abs_rank").collect()] == [(0, 1, -3.0), (1, 2, 3.0), (2, 5, 2.0)]


def test_lower_median(spark):
    df = spark.createDataFrame([(1, x) for x in (4.0, 1.0, 3.0, 2.0, NAN)], "k int, v double")
    assert one(moments.numeric_summary(df, ["k"], "v")).median == 2.0


def test_choice_documents(spark):
    df = spark.createDataFrame([(7, [-3.1, -2.4], [" Yes", " No"], "1"), (8, [0.0, 0.0], ["Paris", "Rome"], "Rome "), (9, [1.0], ["x"], "Paris")], "doc_id long, p array<double>, c array<string>, target string")
    out = docs.choice_rows(df, ["doc_id"], "p", "c", "target").orderBy("doc_id", "choice_idx").collect()
    assert [(r.doc_id, r.choice_idx, r.is_target_choice, r.predicted) for r in out] == [(7, 0, False, " No"), (7, 1, True, " No"), (8, 0, False, "Paris"), (8, 1, True, "Paris"), (9, 0, False, "x")]


def test_generated_documents(spark):
    r = one(docs.generated_rows(spark.createDataFrame([(1, "abc")], "doc_id long, response string"), ["doc_id"], "response"))
    assert (r.choice_idx, r.is_target_choice, r.choice_logprob) == (0, True, None)


def test_declared_filter_wins(spark):
    df = spark.createDataFrame([("t", "strict", None, 1), ("t", "flexible", None, 2), ("u", "a", "b", 1), ("u", "b", None, 2)], "task string, f string, d string, i int")
    assert {r.task: r.filters for r in docs.available_filters(df, ["task"], "f", "i").collect()} == {"t": ["strict", "flexible"], "u": ["a", "b"]}
    assert {r.task: r.primary_filter for r in docs.primary_filters(df, ["task"], "f", "i", "d").collect()} == {"t": "strict", "u": "b"}


def test_screening_and_groups(spark):
    df = spark.createDataFrame([("a", True, "0.4", "r1", 10), ("b", True, "0.4", "r2", 20), ("c", True, "0.4", "r2", 20), ("d", False, "0.4", "r2", 20), ("e", True, "0.3", "r1", 20)], "path string, completed boolean, schema_version string, reducer_versions string, vocab_size int")
    out = runs.screen(df, "0.4")
    assert {r.path: r.reason for r in out.collect()} == {"a": "reducer versions of a minority", "b": None, "c": None, "d": "not completed", "e": "another schema version"}
    g = one(runs.labelled_groups(out.where("reason IS NULL"), ["schema_version"]))
    assert (g.label, g.n_runs, g.mixed_vocab) == ("A", 2, False)


def test_datasets():
    assert runs.parse_datasets("en=a,ko") == [("en", "a"), ("ko", "ko")]
    for bad in ("en=a", "en=a,en=b", ""):
        with pytest.raises(ValueError):
            runs.parse_datasets(bad)


def test_alignment_counts(spark):
    rows = [("r1", "d1", "choice:1"), ("r2", "d1", "choice:1"), ("r1", "d2", "choice:1"), ("r2", "d2", "choice:2"), ("r1", "d3", "target:x"), ("r2", "d3", "choice:1"), ("r1", "d4", "choice:1")]
    out = one(pairing.alignment(pairing.answer_status(spark.createDataFrame(rows, "run string, doc string, gold string"), "doc", "run", "gold")))
    assert (out.shared, out.agree, out.disagree, out.unverifiable, out.rate, out.aligned) == (3, 1, 1, 1, 0.5, False)


def test_calls(spark):
    kinds = ["exit", "enter", "enter", "exit", "enter", "exit", "other", "enter"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "s int, i long, event string")
    out = sorted((r.status, r.enter, r.exit, r.depth) for r in trace.calls(df, ["s"], "i", "event").collect() if r.enter is not None)
    assert out == [("closed", 2, 3, 2), ("closed", 4, 5, 2), ("unwound", 1, None, 1), ("unwound", 7, None, 2)]
    assert [r["exit"] for r in trace.calls(df, ["s"], "i", "event").where("status = 'orphan'").collect()] == [0]
    assert [r.depth for r in trace.depths(df, ["s"], "i", "event").orderBy("i").collect()] == [0, 1, 2, 1, 2, 1, 1, 2]


def test_fused_values(spark):
    df = spark.createDataFrame([(list(range(12)),)], "a array<int>")
    assert one(df.select(tensors.split_values(F.col("a"), "fused_per_head", 2, 2).alias("v"))).v == [4, 5, 10, 11]
    assert one(df.select(tensors.split_values(F.col("a"), "fused_contiguous", 2, 2).alias("v"))).v == [8, 9, 10, 11]


def test_similarity_triangle(spark):
    df = spark.createDataFrame([(1, i, [float(i == j) for j in range(33)]) for i in range(33)], "k int, l int, v array<double>")
    assert tensors.similarity(df, ["k"], "l", "v").count() == 561


def test_step_rows(spark):
    df = spark.createDataFrame([("t", [0, 1], [5, 6], [9, 10])], "t string, s array<int>, k array<int>, p array<int>")
    assert [tuple(r) for r in tensors.step_rows(df, ["t"], "s", "k", "p").collect()] == [("t", 0, 5, 9), ("t", 1, 6, 10)]


def test_benchmark_items(spark):
    rows = [("1", "q", ["a", "b"], 0), ("1", "q", ["a", "b"], 0), ("2", " ", ["a", "b"], 0), ("3", "q", ["a"], 0), ("4", "q", ["a", " "], 0), ("5", "q", ["a", "b"], 2), ("6", "q", ["a", "b"], 1), (None, "q", ["a", "b"], 1)]
    out = checks.benchmark_problems(spark.createDataFrame(rows, "id string, question string, choices array<string>, label int"))
    assert sorted((r.id or "", r.problem or "") for r in out.collect()) == [("", "missing id"), ("1", "repeated id"), ("1", "repeated id"), ("2", "blank question"), ("3", "fewer than two choices"), ("4", "blank choice"), ("5", "label out of range"), ("6", "")]
    prompts = spark.createDataFrame([("p", ["a"]), ("p", []), (" ", ["a"]), ("p", [" "])], "prompt string, answer array<string>")
    assert [r.problem for r in checks.prompt_problems(prompts, "prompt", "answer").collect()] == [None, "no answer", "blank prompt", "blank answer"]


def test_refusals():
    with pytest.raises(ValueError, match="lacks"):
        checks.refuse_missing({})
    for bad in ({"extremes": 3}, {"extremes": 3, "extremes_modules": "m"}, {"module_stats": True, "axes": "other", "axes_modules": "m"}, {"modules": "("}, {"routing": "m"}):
        with pytest.raises(ValueError):
            checks.StatisticsOptions(**bad)
    judge = {"endpoint": "https://judge/v1", "model": "m", "prompt": "p", "score": "s"}
    checks.refuse_judge({"output_type": "generate_until"}, {"scoring": "llm_judge", "judge": judge})
    for more in ({"endpoint": "ftp://x"}, {"endpoint": "https://a:b@judge"}, {"timeout": 0}, {"max_retries": 11}, {"other": 1}, {"generation_kwargs": {"model": 1}}, {"model": " "}):
        with pytest.raises(ValueError):
            checks.refuse_judge({"output_type": "generate_until"}, {"scoring": "llm_judge", "judge": judge | more})
    with pytest.raises(ValueError):
        checks.refuse_judge({}, {"judge": judge})
    assert checks.resume_problems({"a": 1}, {"a": 2}) == ["a: 1 was recorded, 2 is asked for"]
    with pytest.raises(ValueError):
        schema.hook_schema(["doc_id"])
    assert schema.hook_schema(["m"]).names[-1] == "m"


def test_layers_and_sizes():
    assert scalar.parse_layers("0-2,-1,1", 8) == [0, 1, 2, 7]
    assert scalar.parse_layers("3-1", 8) == []
    assert scalar.parse_layers("all", 3) == [0, 1, 2]
    with pytest.raises(ValueError):
        scalar.parse_layers("8", 8)
    assert (scalar.parse_batch_size("auto"), scalar.parse_batch_size("4")) == ("auto", 4)
    with pytest.raises(ValueError):
        scalar.parse_batch_size("0")


def test_text_helpers(spark):
    df = spark.createDataFrame([("org/na me", "a=1,b=x=y,c", "arc#easy#12", "12")], "m string, kv string, r string, bare string")
    r = one(df.select(scalar.model_slug(F.col("m")).alias("slug"), scalar.key_values(F.col("kv")).alias("kv"), scalar.task_doc(F.col("r")).alias("r"), scalar.task_doc(F.col("bare")).alias("bare")))
    assert (r.slug, r.kv, tuple(r.r), tuple(r.bare)) == ("org__na_me", {"a": "1", "b": "x=y"}, ("arc#easy", 12), (None, 12))


def test_hook_selectors(spark):
    assert hooks.resolve(["a.b", "a.c"], pattern="b$") == ["a.b"]
    with pytest.raises(ValueError):
        hooks.resolve(["a"], modules=["z"])
    with pytest.raises(ValueError):
        hooks.resolve(["a"])
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0, 5.0])], "k int, a array<float>")
    assert sorted(tuple(r) for r in hooks.hook_metrics(df, ["k"], "a", lambda x: {"s": x.sum(axis=1)}, ["s"]).collect()) == [(1, 3.0), (2, 12.0)]
    with pytest.raises(Exception, match="declared"):
        hooks.hook_metrics(df, ["k"], "a", lambda x: {"z": x.sum(axis=1)}, ["s"]).collect()


def test_hook_specs(spark):
    good = {"name": "h", "version": "1", "metrics": {"s": "sum"}, "observe": lambda x: {"s": x.sum(axis=1)}, "modules": ("a",)}
    hooks.HookSpec(**good)
    for bad in ({"name": "1h"}, {"version": ""}, {"modules": ()}, {"module_pattern": "x"}, {"modules": (), "module_pattern": "("}, {"modules": ("a", "a")}, {"positions": "all"}, {"position_range": (3, 1)}, {"doc_ids": (-1,)},
                {"max_rows": -1}, {"pass_name": "other"}, {"collection_resume": True}, {"metrics": {}}, {"metrics": {"step": "x"}}, {"observe": 1}):
        with pytest.raises(ValueError):
            hooks.HookSpec(**(good | bad))
    df = spark.createDataFrame([(1, 0, 0, [1.0]), (2, 0, 0, [2.0])], "doc_id int, position int, step int, a array<float>")
    with pytest.raises(ValueError, match="bound"):
        hooks.run_hook(df, hooks.HookSpec(**(good | {"max_rows": 1})), ["doc_id"], "a")
    assert hooks.run_hook(df, hooks.HookSpec(**(good | {"max_rows": 1, "doc_ids": (2,)})), ["doc_id"], "a").first().s == 2.0


def test_reducers(spark):
    df = spark.createDataFrame([("t", 1, 0, 0, layer, [1.0, 2.0], 0, [1.0, float(layer)]) for layer in range(3)], "task_name string, doc_id long, choice_idx int, step int, layer int, logits array<double>, target int, hidden array<double>")
    out = tensors.reduce_all(df, ["logit_lens", "layer_similarity"])
    assert {k: v.count() for k, v in out.items()} == {"signals": 3, "similarity": 6}
    assert [d["name"] for d in tensors.descriptors(["logit_lens", "layer_similarity"])] == ["layer_similarity", "logit_lens"]
    with pytest.raises(ValueError):
        tensors.register(tensors.REDUCERS["logit_lens"])


def test_named_reference(spark):
    df = spark.createDataFrame([("A", "big"), ("A", "small"), ("B", "big one")], "label string, series string")
    assert runs.named_reference(df, ["label"], "series", "big").count() == 2
    with pytest.raises(ValueError, match="names 0"):
        runs.named_reference(df, ["label"], "series", "small")


def test_numbers_and_hashes(spark):
    texts = ["1e0", " 0.6666666666666666 ", "1_0", "nan", "-Infinity", "1.0d", "", "1e-5", ".5"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.number(F.col("t"))).collect()]
    assert out[0] == 1.0 and out[1] == 0.6666666666666666 and out[2] is None and math.isnan(out[3]) and out[4] == -INF and out[5:7] == [None, None] and out[7:] == [1e-5, 0.5]
    assert scalar.config_hash({"a": "é", "b": Path("x")}) == hashlib.sha256(b'{"a": "\\u00e9", "b": "x"}').hexdigest()[:8]


def test_out_of_range_targets_are_no_label(spark):
    df = spark.createDataFrame([("7", [" 7", " 8"]), ("-1", ["a"]), ("8 ", ["x"] * 9), ("Paris", ["paris", "\tParis "])], "t string, c array<string>")
    assert [r[0] for r in df.select(docs.gold_choice(F.col("t"), F.col("c"))).collect()] == [None, None, 8, 1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double, layer int, token int")
    assert moments.merge(moments.moments(df, ["k"], "v"), ["k"]).count() == 0
    assert signals.prediction_depth(df, ["k"], "layer", "token").count() == 0
    assert schema.describe_schema(spark).where("table = 'signals' AND is_key").count() == 5


def test_partitioning_does_not_change_moments(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.sin("id").alias("v"))
    a, b = (sorted((r.k, round(r.m2, 9)) for r in moments.moments(df.repartition(n), ["k"], "v").collect()) for n in (1, 7))
    assert a == b
