"""Registered queries over samples, signals, tensors and their rules, next to the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions import hooks, scalar
from runlens.operators import checks, collect, docs, moments, pairing, runs, signals, tensors, trace
from runlens.plans import attach, reports
from runlens.plans.catalogue import _LAYERS, _LINE_ORDER, _LO, _PARTS, _TRACE, _layers, _parts, _rounded, _trace
from runlens.plans.registry import query
from runlens.sources import judges

# Samples


def _placed_sum(values):
    """A sum over the whole array in which every place counts differently, as text."""
    total = F.aggregate(F.transform(values, lambda x, k: (k + 1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.round(total, 4).cast("decimal(12,4)").cast("string")


def _records(read):
    """lineitem as harness records: an order is a document, its lines are choices or, for every fifth order, a generated answer."""
    each = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE_ORDER))).alias("s"))
    key = F.col("l_orderkey")
    args = F.transform("s", lambda x: F.array(F.lit("context"), F.concat(F.lit(" part "), x["l_partkey"].cast("string"))))
    resps = F.transform("s", lambda x: F.array(x["l_extendedprice"].cast("string"), F.lit("false")))
    target = F.when(key % 3 == 0, F.concat(F.lit('"'), (key % 4).cast("string"), F.lit('"'))).when(key % 3 == 1, F.concat(F.lit('"part '), F.element_at("s", -1)["l_partkey"].cast("string"), F.lit('"'))).otherwise('"Paris"')
    choices = F.concat(F.lit('"filtered_resps":['), F.array_join(F.transform(resps, lambda r: F.concat(F.lit("["), F.array_join(r, ","), F.lit("]"))), ","), F.lit('],"arguments":'), F.to_json(args))
    told = F.when(key % 5 == 0, F.concat(F.lit('"filtered_resps":["answer '), key.cast("string"), F.lit('"],"arguments":[["context"]]'))).otherwise(choices)
    metric = F.when(key % 7 == 0, F.lit("")).when(key % 7 == 1, ',"acc":null,"em":1').when(key % 7 == 2, ',"f1":0.6666666666666666').when(key % 7 == 3, ',"exact_match":1e0').otherwise(F.concat(F.lit(',"acc":'), (key % 2).cast("string"), F.lit(".0")))
    kept = F.when(key % 11 == 0, '"filter":"flexible"').otherwise('"filter":"strict"')
    text = F.concat(F.lit('{"task_name":"t'), (key % 2).cast("string"), F.lit('","doc_id":'), key.cast("string"), F.lit(","), kept, F.lit(',"target":'), target, F.lit(","), told, metric, F.lit("}"))
    return each.select(F.parse_json(text).alias("record"), key.alias("line"))


@query(f"""
WITH o AS (SELECT l_orderkey AS k, list(l_extendedprice ORDER BY {_LO}) AS p, list('part ' || l_partkey ORDER BY {_LO}) AS c FROM lineitem GROUP BY 1),
first AS (SELECT k % 2 AS t, arg_min(CASE WHEN k % 11 = 0 THEN 'flexible' ELSE 'strict' END, k) AS f FROM o GROUP BY 1),
s AS (SELECT o.*, k % 5 <> 0 AS scored, CASE WHEN k % 11 = 0 THEN 'flexible' ELSE 'strict' END AS filter, CASE k % 3 WHEN 0 THEN (k % 4)::varchar WHEN 1 THEN c[len(c)] ELSE 'Paris' END AS target,
      CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN false WHEN 3 THEN true ELSE k % 2 = 1 END AS is_correct FROM o),
g AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 < len(c) THEN k % 4 END WHEN list_position(c, target) > 0 THEN list_position(c, target) - 1 END AS gold, list_position(p, list_max(p)) AS best FROM s JOIN first ON first.t = k % 2 AND first.f = filter)
SELECT 't' || (k % 2) AS task_name, k AS doc_id, i AS choice_idx, is_correct, CASE WHEN scored THEN coalesce(i = gold, false) ELSE true END AS is_target_choice, CASE WHEN scored THEN ' ' || c[best] ELSE 'answer ' || k END AS predicted,
CASE WHEN scored AND gold IS NOT NULL THEN ' ' || c[gold + 1] ELSE target END AS target, CASE WHEN scored THEN round(p[i + 1], 2) END AS choice_logprob, filter FROM g, unnest(range(CASE WHEN scored THEN len(c) ELSE 1 END)) u(i)""")
def docs_from_samples(read):
    """The table of documents from records that tell choices, answers, verdicts and filters in several ways."""
    return _rounded(docs.docs_from_samples(_records(read)), 2, "choice_logprob")


@query("""
WITH d AS (SELECT event_id, 'kind' AS field, event_type AS value FROM events UNION ALL SELECT event_id, 'even', CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END FROM events UNION ALL SELECT event_id, 'number', (event_id % 100)::varchar FROM events
UNION ALL SELECT event_id, 'half', (event_id % 10)::varchar || '.5' FROM events) SELECT * FROM d""")
def document_fields(read):
    """The scalar fields of JSON documents as text; lists, objects and nulls are left out."""
    i = F.col("event_id")
    text = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","even":'), (i % 2 == 0).cast("string"), F.lit(',"number":'), (i % 100).cast("string"), F.lit(',"half":'), (i % 10).cast("string"), F.lit('.5,"none":null,"list":[1,2],"more":'), "props", F.lit("}"))
    return docs.scalar_fields(read("events").select("event_id", text.alias("document")), ["event_id"], "document")


@query(f"""
WITH l AS ({_LAYERS}), m AS (SELECT user_id, max(value) AS metric FROM events WHERE event_type = 'view' GROUP BY 1 HAVING user_id % 3 > 0)
SELECT event_type, count(*) AS n, count(metric) AS n_metric, round(sum(metric), 4) AS total FROM l LEFT JOIN m USING (user_id) GROUP BY 1""")
def metrics_with_signals(read):
    """Signals with a metric of their document, after a check that it has one row."""
    m = read("events").where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("metric")).where("user_id % 3 > 0")
    out = signals.join_metrics(_layers(read), m, ["user_id"])
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("metric").alias("n_metric"), F.round(F.sum("metric"), 4).alias("total"))


@query(f"""
WITH l AS (SELECT *, layer % 3 AS step FROM ({_LAYERS})), f AS (SELECT user_id, step, arg_max(event_type, layer) AS t, max(layer) AS top FROM l GROUP BY 1, 2),
o AS (SELECT l.user_id, l.step, max(CASE WHEN event_type <> t THEN layer END) AS other, any_value(top) AS top FROM l JOIN f ON f.user_id = l.user_id AND f.step = l.step GROUP BY 1, 2),
s AS (SELECT l.user_id, l.step, min(layer) AS settled, any_value(top) AS top FROM l JOIN o ON o.user_id = l.user_id AND o.step = l.step WHERE other IS NULL OR layer > other GROUP BY 1, 2)
SELECT user_id, round(arg_max(CASE WHEN top <= 0 THEN 0 ELSE settled / top END, step), 9) AS depth FROM s GROUP BY 1""")
def document_settle_depth(read):
    """Where each document settled in its last step."""
    rows = _layers(read).withColumn("step", F.col("layer") % 3)
    return _rounded(signals.document_depth(signals.prediction_depth(rows, ["user_id", "step"], "layer", "event_type"), ["user_id"], ["step"]), 9, "depth")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE 99 END AS value FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE 99 END NOT IN (0, 1)""")
def binary_metric_check(read):
    """Values that a yes-or-no metric cannot have."""
    i = F.col("o_orderkey")
    return checks.binary_problems(read("orders").select(i.alias("doc_id"), F.when(i % 3 == 0, i % 5).otherwise(99).alias("value")), "value")


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'csv' ELSE 'json' END AS dataset_path, CASE p_size % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'multiple_choice' ELSE 'generate_until' END AS output_type, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'id' END AS sample_id, CASE WHEN p_size % 5 = 0 THEN 'bleu' ELSE 'acc' END AS primary_metric, p_size % 3 > 0 AS up, CASE WHEN p_size % 11 = 0 THEN 'strict' ELSE 'none' END AS primary_filter FROM part)
SELECT p_partkey, CASE WHEN dataset_path <> 'json' THEN 'not a self-contained local task' WHEN output_type = 'other' THEN 'unsupported output type' WHEN sample_id IS NULL THEN 'a required field is missing' WHEN primary_metric <> 'acc' THEN 'a declared metric is absent' WHEN NOT up THEN 'another direction than the metric''s' WHEN primary_filter <> 'none' THEN 'unknown primary filter' END AS problem FROM t""")
def protocol_validation(read):
    """Task protocols with the first rule that each breaks."""
    n = F.col("p_size")
    t = read("part").select(
        "p_partkey", F.when(n % 9 == 0, "csv").otherwise("json").alias("dataset_path"), F.lit(None).cast("string").alias("include"), F.when(n % 4 == 0, "other").when(n % 4 == 1, "multiple_choice").otherwise("generate_until").alias("output_type"),
        F.when(n % 7 != 0, "id").alias("sample_id"), F.when(n % 5 == 0, "bleu").otherwise("acc").alias("primary_metric"), F.when(n % 11 == 0, "strict").otherwise("none").alias("primary_filter"), (n % 3 > 0).alias("higher_is_better"),
        F.lit(None).cast("string").alias("correctness_metric"), F.create_map(F.lit("acc"), F.lit(True)).alias("metrics"), F.lit(None).cast("array<string>").alias("filters"),
    )
    return checks.protocol_problems(t).select("p_partkey", "problem")


# Names, sizes and times


@query("""SELECT doc_id, regexp_replace(lang || '/' || source, '[^\\p{L}\\p{N}_.-]', '_', 'g') || '__' || lpad(doc_id::varchar, 6, '0') || '__' || (doc_id % 4) AS name FROM documents""")
def tensor_file_names(read):
    return read("documents").select("doc_id", scalar.tensor_name(F.concat_ws("/", "lang", "source"), F.col("doc_id"), F.col("doc_id") % 4).alias("name"))


@query("""SELECT o_orderkey, 'results/' || o_orderpriority || '+z/' || regexp_replace(replace(o_orderstatus || '/m o', '/', '__'), '[^A-Za-z0-9._-]', '_', 'g') || '/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || substr(sha256(o_orderkey::varchar), 1, 8) AS path FROM orders""")
def default_output_paths(read):
    tasks = F.array(F.lit("z"), F.col("o_orderpriority"))
    return read("orders").select("o_orderkey", scalar.output_path(tasks, F.concat("o_orderstatus", F.lit("/m o")), F.col("o_orderdate"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8)).alias("path"))


@query("""SELECT vec_id, len(embedding) * (label + 1) * 2 AS bytes, to_json(list_transform(embedding[1:8], lambda x: round(x::double * 1000)::int)) || ' +' || (len(embedding) - 8) AS brief FROM embeddings""")
def tensor_sizes(read):
    """Bytes of tensors by shape and type, and the beginning of their values."""
    shape = F.array(F.size("embedding").cast("long"), (F.col("label") + 1).cast("long"))
    values = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    return read("embeddings").select("vec_id", scalar.n_bytes(shape, F.lit("float16")).alias("bytes"), scalar.brief(values).alias("brief"))


@query("""SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%f') || '-' || substr(sha256(event_id::varchar), 1, 8) AS session, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events""")
def session_ids(read):
    return read("events").select("event_id", scalar.session_id(F.col("ts"), F.col("event_id").cast("string")).alias("session"), scalar.iso_time(F.col("ts")).alias("iso"))


@query("""SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS identity FROM conversations""")
def judge_identities(read):
    """The digest under which a judge's answer is kept."""
    return read("conversations").select("conv_id", "turn", judges.identity("conv_id", "turn").alias("identity"))


# Tensors


@query("""
WITH a AS (SELECT vec_id // 8 AS doc_id, vec_id % 2 AS step, vec_id % 8 // 2 AS head, list_sum(list_transform(range(1, 65), lambda k: k * embedding[k]::double)) AS w FROM embeddings)
SELECT doc_id, step, count(*) AS n_heads, string_agg(round(w, 4)::decimal(12, 4)::varchar, ' ' ORDER BY head) AS heads FROM a WHERE doc_id % 3 > 0 OR step = 0 GROUP BY 1, 2""")
def attention_dump(read):
    """Weights of the last query, heads in order, each head's told by a sum over their places; generated documents keep their first step only."""
    i = F.col("vec_id")
    rows = read("embeddings").select(F.floor(i / 8).alias("doc_id"), (i % 2).alias("step"), F.floor(i % 8 / 2).alias("head"), F.lit(0).alias("block"), F.col("embedding").alias("w"), F.when(F.floor(i / 8) % 3 > 0, "choice").otherwise("generate").alias("kind"))
    out = tensors.attention_rows(rows, ["doc_id"], "block", "head", "w", "kind", "step")
    return out.select("doc_id", "step", F.size("heads").alias("n_heads"), F.array_join(F.transform("heads", _placed_sum), " ").alias("heads"))


@query("""
WITH v AS (SELECT vec_id, embedding::double[] AS a FROM embeddings) SELECT vec_id, round(list_sum(a), 6) AS separate, round(list_sum(a[49:64]), 6) AS contiguous, round(list_sum(a[17:24]) + list_sum(a[41:48]), 6) AS per_head FROM v""")
def value_layouts(read):
    """The value part of a projection in its three layouts."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    a = F.col("embedding")
    out = read("embeddings").select("vec_id", total(tensors.split_values(a, "separate", 0, 0)).alias("separate"), total(tensors.split_values(a, "fused_contiguous", 2, 8)).alias("contiguous"), total(tensors.split_values(F.slice(a, 1, 48), "fused_per_head", 2, 8)).alias("per_head"))
    return _rounded(out, 6, "separate", "contiguous", "per_head")


@query(f"""
SELECT l_orderkey, step, l_partkey AS token_id, l_suppkey AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LO}) - 1 AS step FROM lineitem)""")
def generated_steps(read):
    """Parallel arrays of one forward as a row per step."""
    held = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE_ORDER))).alias("s"))
    held = held.select("l_orderkey", F.sequence(F.lit(0), F.size("s") - 1).alias("steps"), F.transform("s", lambda x: x["l_partkey"]).alias("tokens"), F.transform("s", lambda x: x["l_suppkey"]).alias("places"))
    return tensors.step_rows(held, ["l_orderkey"], "steps", "tokens", "places")


@query("""
WITH e AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS t FROM embeddings) SELECT vec_id, t::bigint AS lens_token_id, n_name AS lens_token, n_regionkey = 0 AS lens_is_special FROM e LEFT JOIN nation ON n_nationkey = t""")
def lens_tokens(read):
    """The text of the likeliest token and whether it is special; null for ids that the vocabulary lacks."""
    lens = tensors.logit_lens(read("embeddings"), ["vec_id"], "embedding", "label").select("vec_id", "lens_token_id")
    vocabulary = read("nation").select(F.col("n_nationkey").cast("long").alias("token_id"), F.col("n_name").alias("text"), (F.col("n_regionkey") == 0).alias("is_special"))
    return tensors.with_token_text(lens, vocabulary).select("vec_id", "lens_token_id", "lens_token", "lens_is_special")


@query("""
SELECT vec_id // 40 AS doc_id, label AS layer, count(*) AS n_steps, string_agg(round(list_sum(list_transform(range(1, 65), lambda k: k * embedding[k]::double)), 4)::decimal(12, 4)::varchar, ' ' ORDER BY vec_id) AS sums FROM embeddings WHERE label IN (1, 4, 7) GROUP BY 1, 2""")
def hidden_dump(read):
    """Hidden states of chosen layers, steps in order, each vector told by a sum over its places."""
    rows = read("embeddings").select(F.floor(F.col("vec_id") / 40).alias("doc_id"), F.col("label").alias("layer"), F.col("vec_id").alias("step"), "embedding")
    out = tensors.hidden_rows(rows, ["doc_id"], "layer", "step", "embedding", [1, 4, 7])
    return out.select("doc_id", "layer", F.size("steps").alias("n_steps"), F.array_join(F.transform("steps", _placed_sum), " ").alias("sums"))


@query("""
WITH e AS (SELECT vec_id, i AS place, embedding[i + 1]::double AS x FROM embeddings, unnest(range(len(embedding))) u(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, place) - 1 AS abs_rank FROM e)
SELECT vec_id, abs_rank, place AS flat_index, place // 16 AS position, place % 16 AS feature, round(x, 6) AS value FROM r WHERE abs_rank < 4""")
def extreme_positions(read):
    """Where the largest magnitudes of a slice of four positions by sixteen features stand."""
    return _rounded(moments.extremes(read("embeddings"), ["vec_id"], "embedding", 4, 16), 6, "value")


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double * CASE WHEN vec_id % 5 = 0 THEN 1e200 ELSE 1 END) AS a FROM embeddings),
m AS (SELECT vec_id, label, list_sum(a) / len(a) AS mean, a FROM e)
SELECT vec_id, label, 'kept' AS outcome, round(mean, 6) AS mean, round(list_sum(list_transform(a, lambda x: (x - mean) * (x - mean))), 5) AS m2, 1::bigint AS n FROM m WHERE vec_id % 5 > 0
UNION ALL SELECT NULL, label, 'moment_overflow', NULL, NULL, count(*) FROM m WHERE vec_id % 5 = 0 GROUP BY label""")
def observations_with_overflow(read):
    """Moments of each row; those whose squares overflow are counted as excluded, not kept as infinite."""
    rows = read("embeddings").withColumn("a", F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 5 == 0, 1e200).otherwise(1.0)))
    kept, out = moments.recorded(moments.observe_arrays(rows, ["vec_id", "label"], "a"), ["label"])
    kept = _rounded(_rounded(kept, 6, "mean"), 5, "m2").select("vec_id", "label", F.lit("kept").alias("outcome"), "mean", "m2", F.lit(1).cast("long").alias("n"))
    none = F.lit(None)
    return kept.unionByName(out.select(none.cast("long").alias("vec_id"), "label", F.col("reason").alias("outcome"), none.cast("double").alias("mean"), none.cast("double").alias("m2"), F.col("count").alias("n")))


@query("""
WITH e AS (SELECT label, i AS axis_index, embedding[i + 1]::double * CASE WHEN i % 8 = 0 THEN 1e200 ELSE 1 END AS x FROM embeddings, unnest(range(len(embedding))) u(i))
SELECT label, axis_index, 'kept' AS outcome, count(*) AS n, round(avg(x), 6) AS mean FROM e WHERE axis_index % 8 > 0 GROUP BY 1, 2 UNION ALL SELECT label, NULL, 'axis_moment_overflow', count(DISTINCT axis_index), NULL FROM e WHERE axis_index % 8 = 0 GROUP BY 1""")
def axis_overflow(read):
    """Moments per feature; features whose squares overflow are skipped and counted."""
    rows = read("embeddings").withColumn("a", F.transform("embedding", lambda x, i: x.cast("double") * F.when(i % 8 == 0, 1e200).otherwise(1.0)))
    kept, out = moments.recorded(moments.axis_moments(rows, ["label"], "a"), ["label"], "axis_moment_overflow")
    kept = _rounded(kept, 6, "mean").select("label", F.col("axis_index").cast("long").alias("axis_index"), F.lit("kept").alias("outcome"), F.col("count").alias("n"), "mean")
    return kept.unionByName(out.select("label", F.lit(None).cast("long").alias("axis_index"), F.col("reason").alias("outcome"), F.col("count").alias("n"), F.lit(None).cast("double").alias("mean")))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 0.5 * tanh(x::double / 0.5))), 6) AS total FROM embeddings""")
def soft_capped_logits(read):
    return _rounded(read("embeddings").select("vec_id", F.aggregate(F.transform("embedding", lambda x: scalar.soft_cap(x.cast("double"), 0.5)), F.lit(0.0), lambda s, x: s + x).alias("total")), 6, "total")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'expert' WHEN p_size % 5 IN (1, 2) THEN 'router_rank' ELSE 'channel' END AS role FROM part""")
def feature_roles(read):
    n = F.col("p_size") % 5
    return read("part").select("p_partkey", collect.feature_role(n == 0, n.isin(1, 2)).alias("role"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding[2:64]::double[], embedding[2:64]::double[])), 6) AS norm FROM embeddings WHERE vec_id % 50 >= 3 AND vec_id % 50 < 30 AND label > 2""")
def hook_in_range(read):
    """A hook's metric over the positions in its range that are scored, of what it extracts."""

    def observe(x):
        import numpy as np

        return {"norm": np.sqrt((x.astype("float64") ** 2).sum(axis=1))}

    spec = hooks.HookSpec("norms", "1", {"norm": "length of the vector"}, observe, module_pattern="mlp", position_range=(3, 30), extract=lambda c: F.slice(c, 2, 63))
    rows = read("embeddings").select("vec_id", (F.col("vec_id") % 50).alias("position"), F.when(F.col("label") > 2, F.col("label")).alias("step"), "embedding")
    return _rounded(hooks.run_hook(rows, spec, ["vec_id"], "embedding"), 6, "norm")


@query("""SELECT c_custkey AS module, 'extremes' AS what FROM customer WHERE regexp_matches(c_mktsegment, '^M') UNION ALL SELECT c_custkey, 'axes' FROM customer WHERE regexp_matches(c_mktsegment, 'ING$') UNION ALL SELECT c_custkey, 'modules' FROM customer""")
def statistics_selection(read):
    """Which modules get extremes and statistics by axis; routing is off."""
    options = checks.StatisticsOptions(module_stats=True, extremes=4, extremes_modules="^M", axes="feature", axes_modules="ING$")
    rows = read("customer").select(F.col("c_custkey").alias("module"), "c_mktsegment")
    parts = [options.chosen(rows, what, "c_mktsegment").select("module", F.lit(what).alias("what")) for what in ("extremes", "axes", "routing", "modules")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT o_custkey AS module, count(*) AS observation_count, count(DISTINCT o_orderpriority) AS call_count, 0::bigint AS exclusion_count FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0, 0, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def coverage_units(read):
    """Observations, the calls they come from and exclusions of every module."""
    o = read("orders").select(F.col("o_custkey").alias("module"), F.col("o_orderpriority").alias("call"))
    none = o.where("false").select("module", F.lit(0).alias("count"))
    return moments.coverage(read("customer").select(F.col("c_custkey").alias("module")), o, none)


# Traces and collection


@query(f"""
WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE event_type WHEN 'click' THEN 'enter' WHEN 'signup' THEN 'forward' ELSE event_type END AS e FROM events)
SELECT user_id, event_id, i, count(*) FILTER (e = 'enter') OVER w AS call, count(*) FILTER (e = 'forward') OVER w AS forward_id FROM t WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def call_numbers(read):
    """Events numbered in their session, with the call and the forward they fall in."""
    kind = F.col("event_type")
    rows = read("events").withColumn("e", F.when(kind == "click", "enter").when(kind == "signup", "forward").otherwise(kind)).withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return trace.numbered_calls(rows, ["user_id"], "o", "e").select("user_id", "event_id", "i", "call", "forward_id")


@query(f"""
WITH t AS ({_TRACE}), i AS (SELECT user_id, count(*) FILTER (event = 'enter') AS n_enters, arg_min(event_type, i) AS phase FROM t GROUP BY 1), h AS (SELECT user_id, count(*) AS batch_rows, string_agg(event_id::varchar, ' ' ORDER BY event_id) AS samples FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT user_id, n_enters, phase, batch_rows, samples FROM i LEFT JOIN h USING (user_id)""")
def forward_headers(read):
    """Forwards with their calls, first phase, samples and batch rows."""
    h = read("events").where("event_type = 'signup'").groupBy("user_id").agg(F.count(F.lit(1)).alias("batch_rows"), F.array_join(F.array_sort(F.collect_list("event_id")), " ").alias("samples"))
    return trace.forward_index(_trace(read), ["user_id"], "i", "event", "event_type", h)


@query(f"""
WITH RECURSIVE t AS ({_TRACE}), m AS (SELECT user_id, i, event, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM t WHERE event IN ('enter', 'exit')),
s AS (SELECT user_id, k, CASE WHEN event = 'enter' THEN [i] ELSE []::bigint[] END AS stack, (event = 'exit')::int AS orphans, 0 AS closed, (event = 'enter')::int AS deepest FROM m WHERE k = 1
UNION ALL SELECT m.user_id, m.k, CASE WHEN m.event = 'enter' THEN list_append(stack, m.i) ELSE stack[:len(stack) - 1] END, orphans + (m.event = 'exit' AND len(stack) = 0)::int, closed + (m.event = 'exit' AND len(stack) > 0)::int, greatest(deepest, CASE WHEN m.event = 'enter' THEN len(stack) + 1 ELSE 0 END) FROM s JOIN m ON m.user_id = s.user_id AND m.k = s.k + 1),
z AS (SELECT user_id, arg_max(stack, k) AS stack, max(orphans) AS n_orphans, max(closed) AS n_closed, max(deepest) AS deepest FROM s GROUP BY user_id)
SELECT user_id, n_closed, len(stack) AS n_unwound, n_orphans, deepest, stack[len(stack)] AS deepest_open, len(stack) = 0 AND n_orphans = 0 AS healthy FROM z""")
def session_health(read):
    """Which sessions failed, with their deepest open call."""
    return trace.session_summary(_trace(read), ["user_id"], "i", "event")


@query("""SELECT l_orderkey, l_linenumber, 3 - 1 + l_linenumber AS position FROM lineitem""")
def absolute_positions(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", collect.absolute_position(F.lit(3), F.col("l_linenumber")).alias("position"))


@query(f"""SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::varchar, ' ' ORDER BY {_LO}) AS parts FROM lineitem GROUP BY 1""")
def contexts_of_documents(read):
    """The contexts of each document in their order."""
    rows = docs.choice_ordinals(read("lineitem"), ["l_orderkey"], *_LINE_ORDER)
    out = collect.contexts_by_document(rows, ["l_orderkey"], "choice_idx", ["l_partkey"])
    return out.select("l_orderkey", F.size("contexts").alias("n"), F.array_join(F.transform("contexts", lambda c: c["l_partkey"].cast("string")), " ").alias("parts"))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1")
def next_shards(read):
    return collect.next_ordinal(read("orders"), ["o_custkey"], "o_orderkey")


@query("""SELECT o_orderkey, 'part-' || lpad(((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::varchar, 4, '0') AS shard FROM orders WHERE o_orderpriority = '1-URGENT'""")
def shard_rolls(read):
    """Every five hundred documents go to a new shard."""
    o = read("orders").where("o_orderpriority = '1-URGENT'")
    # Ordinals by counting the ids before in ranges of a thousand, then within them.
    ranges = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    ahead = ranges.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("ahead"))
    rows = o.withColumn("r", F.floor(F.col("o_orderkey") / 1000)).withColumn("nth", F.row_number().over(Window.partitionBy("r").orderBy("o_orderkey")) - 1).join(ahead, "r")
    return collect.rolled_shards(rows.withColumn("nth", F.col("nth") + F.col("ahead")), "nth").select("o_orderkey", "shard")


# Runs, pairing and reports


@query("""
WITH m AS (SELECT l_suppkey AS run, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS task, CASE WHEN l_returnflag = 'A' THEN 'acc,none' ELSE 'f1,strict' END AS metric, round(avg(l_discount), 9) AS value FROM lineitem GROUP BY 1, 2, 3)
SELECT s_suppkey AS run, CASE WHEN s_suppkey % 3 > 0 THEN value END AS score, s_suppkey % 3 = 0 OR s_suppkey % 5 > 0 AS higher FROM supplier LEFT JOIN m ON run = s_suppkey AND task = CASE WHEN s_suppkey % 3 = 1 THEN 'a' ELSE 'b' END AND metric = 'f1,strict' WHERE s_suppkey % 4 > 0""")
def protocol_scores(read):
    """Scores by the protocol that a run declares; a run of several tasks has none."""
    r = read("lineitem").groupBy(F.col("l_suppkey").alias("run"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("task"), F.when(F.col("l_returnflag") == "A", "acc,none").otherwise("f1,strict").alias("metric")).agg(F.round(F.avg("l_discount"), 9).alias("value"))
    key = F.col("s_suppkey")
    tasks = F.when(key % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(key % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    s = read("supplier").select(key.alias("run"), tasks.alias("tasks"))
    p = s.where("run % 4 > 0").select("run", F.explode("tasks").alias("task"), F.lit("f1").alias("primary_metric"), F.lit("strict").alias("primary_filter"), F.when(F.col("run") % 5 == 0, False).when(F.col("run") % 5 == 1, True).alias("higher_is_better"))
    return runs.protocol_scores(r, p, s)


@query("""
WITH d AS (SELECT n_nationkey AS run, 'l' || n_nationkey AS label, 't' || (n_nationkey % 5) AS task FROM nation), n AS (SELECT run, label AS language, run AS nth, 0 AS kind FROM d UNION ALL SELECT run, task, run, 1 FROM d),
f AS (SELECT language, arg_min(run, nth * 2 + kind) AS run FROM n GROUP BY 1), m AS (SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 2 = 0 THEN 'l' || s_nationkey ELSE 't' || (s_nationkey % 7) END AS language FROM supplier) SELECT doc, language, run FROM m JOIN f USING (language)""")
def mapping_by_language(read):
    """The run that a mapping's language names: a data set's label or its task."""
    n = F.col("n_nationkey")
    d = read("nation").select(n.alias("run"), F.concat(F.lit("l"), n.cast("string")).alias("label"), F.concat(F.lit("t"), (n % 5).cast("string")).alias("task"), n.alias("nth"))
    key = F.col("s_nationkey")
    m = read("supplier").select(F.col("s_suppkey").alias("doc"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("l"), key.cast("string"))).otherwise(F.concat(F.lit("t"), (key % 7).cast("string"))).alias("language"))
    return pairing.mapping_of_runs(m, d).select("doc", "language", "run")


@query(f"""
WITH c AS (SELECT l_returnflag AS run, l_orderkey AS doc, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY {_LO}) - 1 AS c, l_quantity > 25 AS gold, l_partkey FROM lineitem),
g AS (SELECT run, doc, count(*) AS n, max(CASE WHEN gold THEN c END) AS g, arg_min(' Part ' || l_partkey || chr(9), c) AS target, CASE WHEN doc % 3 = 0 THEN 1 + doc % 4 END AS k FROM c GROUP BY 1, 2)
SELECT run, doc, CASE WHEN g IS NOT NULL THEN CASE WHEN k IS NULL THEN 'choice:' || g WHEN k <> n OR doc % 5 = 0 AND k > 1 THEN 'invalid:canonical_choice_ids_do_not_match_choices' ELSE 'choice_id:x' || g END WHEN doc % 7 = 0 THEN 'answer_id:a' || doc ELSE 'target:' || trim(target, ' ' || chr(9)) END AS gold FROM g WHERE g IS NOT NULL OR n = 1""")
def gold_evidence(read):
    """Where each document's gold answer is, by its place, a canonical id, an answer id or its own text, case kept."""
    rows = docs.choice_ordinals(read("lineitem"), ["l_returnflag", "l_orderkey"], *_LINE_ORDER).select(F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("doc"), "choice_idx", (F.col("l_quantity") > 25).alias("is_target_choice"), F.concat(F.lit(" Part "), F.col("l_partkey").cast("string"), F.lit("\t")).alias("target"))
    doc = F.col("doc")
    n_ids = F.when(doc % 3 == 0, 1 + doc % 4).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n_ids - 1), lambda i: F.concat(F.lit("x"), F.when((doc % 5 == 0) & (n_ids > 1), F.lit(0)).otherwise(i).cast("string")))
    held = pairing.choices_of_documents(rows)
    return pairing.gold_positions(held, ["run", "doc"], F.when(n_ids.isNotNull(), ids), F.when(doc % 7 == 0, F.concat(F.lit("a"), doc.cast("string"))))


@query(f"""
WITH p AS ({_PARTS}), h AS (SELECT doc FROM p GROUP BY doc HAVING count(DISTINCT run) = 3) SELECT run, p.doc, 'k' || p.doc AS pair_key, CASE WHEN h.doc IS NULL THEN 'not_in_every_language' ELSE 'paired' END AS pairing_status FROM p LEFT JOIN h USING (doc) WHERE p.doc IN (SELECT doc FROM h)""")
def pairing_by_field(read):
    """Documents paired by the one field that qualifies: there in all, unique in each run, the same values in all."""
    rows = _parts(read)
    shared = rows.join(pairing.shared_by_all(rows, "run", "doc"), "doc", "left_semi").select("run", "doc")
    values = shared.select("run", "doc", F.create_map(F.lit("key"), F.concat(F.lit("k"), F.col("doc").cast("string")), F.lit("own"), F.concat("run", F.col("doc").cast("string")), F.lit("one"), F.lit("x")).alias("m"))
    paired, kind = attach.attach_pairing(shared, values.select("run", "doc", F.explode("m").alias("field", "value")))
    assert kind == "field"
    return paired


@query(f"""
WITH p AS ({_PARTS}), e AS (SELECT doc, bool_or(correct) FILTER (run = 'A') AS ref, bool_and(correct) FILTER (run <> 'A') AS every, bool_or(correct) FILTER (run <> 'A') AS anyone FROM p GROUP BY doc HAVING count(DISTINCT run) = 3),
b AS (SELECT doc, CASE WHEN ref AND every THEN 'all_correct' WHEN NOT ref AND NOT anyone THEN 'all_wrong' WHEN ref AND NOT anyone THEN 'only_reference' WHEN NOT ref AND every THEN 'only_others' ELSE 'mixed' END AS bucket FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('1234|' || doc), doc) AS n FROM b WHERE bucket <> 'mixed')
SELECT bucket, c.doc AS key, p.run, p.correct AS is_correct, p.run = 'A' AS is_reference, CASE WHEN p.doc % 2 = 0 THEN round(p.q / 100, 6) END AS settle_depth FROM c JOIN p USING (doc) WHERE n <= 3""")
def examples_report(read):
    """Three documents of each bucket with what every run answered and where it settled."""
    rows = _parts(read)
    held = rows.select("run", F.col("doc").alias("key"), F.lit("parts").alias("task_name"), F.col("doc").alias("doc_id"), F.lit(0).alias("choice_idx"), F.col("correct").alias("is_correct"), F.lit("p").alias("predicted"), F.lit("t").alias("target"))
    depths = rows.where("doc % 2 = 0").select("run", F.col("doc").alias("key"), (F.col("q") / 100).alias("settle_depth"))
    out = reports.examples_report(held, held.select("key"), "A", depths)
    return _rounded(out, 6, "settle_depth").select("bucket", "key", "run", "is_correct", "is_reference", "settle_depth")


@query(f"""
WITH l AS ({_LAYERS}), u AS (SELECT event_type AS run, layer AS layer_index, 'lens_prob' AS signal, 'residual' AS d, value AS v FROM l WHERE event_type <> 'error' UNION ALL SELECT event_type, layer, 'target_percentile', 'residual', value / 2 FROM l UNION ALL SELECT event_type, layer, 'target_rank', 'residual', floor(value) FROM l WHERE event_type <> 'error'
UNION ALL SELECT event_type, layer, 'cos', 'pair', value / 4 FROM l WHERE layer % 2 = 0 UNION ALL SELECT event_type, layer, 'value_norm', 'block', value / 8 FROM l)
SELECT run, signal, d AS layer_domain, layer_index, round(avg(v::float::double), 4) AS value, count(*) AS n_rows, round(CASE d WHEN 'residual' THEN layer_index / 64 ELSE (layer_index + 0.5) / 64 END, 9) AS relative_depth FROM u GROUP BY 1, 2, 3, 4""")
def comparison_of_runs(read):
    """The five signals of a comparison; a run of another vocabulary keeps only those that compare."""
    l, v = _layers(read).withColumnRenamed("event_type", "run"), F.col("value")
    tables = {
        "signals": l.select("run", "layer", v.cast("float").alias("lens_prob"), (v / 2).cast("float").alias("target_percentile"), F.floor(v).alias("target_rank")),
        "similarity": l.select("run", F.col("layer").alias("layer_i"), (F.col("layer") + F.when(F.col("layer") % 2 == 0, 1).otherwise(2)).alias("layer_j"), (v / 4).cast("float").alias("cos")),
        "attn_norm": l.select("run", F.col("layer").alias("block"), (v / 8).cast("float").alias("value_norm")),
    }
    about = l.select("run").distinct().select("run", F.lit("A").alias("label"), F.lit(64).alias("n_blocks"), (F.col("run") == "error").alias("mixed_vocab"))
    out = reports.comparison_report(tables, about)
    return _rounded(_rounded(out, 4, "value"), 9, "relative_depth").select("run", "signal", "layer_domain", "layer_index", "value", "n_rows", "relative_depth")


@query("""SELECT o_orderstatus AS status, o_orderkey AS key, o_totalprice AS price, NULL::varchar AS name FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT NULL, c_custkey, NULL, c_name FROM customer""")
def union_of_frames(read):
    """Frames with different columns in one, repeated rows once."""
    o = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    c = read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return o.unionByName(o, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).dropDuplicates()
