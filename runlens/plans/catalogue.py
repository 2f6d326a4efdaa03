"""Registered queries: each applies operators to the tables at hand, next to the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import scalar
from runlens.operators import checks, collect, docs, moments, pairing, runs, signals, tensors, trace
from runlens.plans import attach
from runlens.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401

def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: lineitem rows in a fixed order within an order: its key pair is not unique.
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
_LO = ", ".join(_LINE_ORDER)
_LAYERS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS layer FROM events"


def _layers(read) -> DataFrame:
    """events as signals: a user is a document, the ordinal of an event its layer, its type the token."""
    return read("events").withColumn("layer", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


def _value_sql(alias: str = "") -> str:
    return f"CASE WHEN {alias}l_quantity = 50 THEN 'NaN'::double WHEN {alias}l_quantity = 49 THEN 'Infinity'::double WHEN {alias}l_quantity = 48 THEN '-Infinity'::double ELSE {alias}l_extendedprice END"


def _with_values(read) -> DataFrame:
    """lineitem as observations, with NaN and both infinities among the values."""
    x = F.when(F.col("l_quantity") == 50, float("nan")).when(F.col("l_quantity") == 49, float("inf")).when(F.col("l_quantity") == 48, float("-inf")).otherwise(F.col("l_extendedprice"))
    return read("lineitem").withColumn("value", x)


# Signals and curves


@query(f"""
WITH l AS ({_LAYERS}), f AS (SELECT user_id, arg_max(event_type, layer) AS final_token, max(layer) AS last_layer FROM l GROUP BY user_id),
o AS (SELECT l.user_id, max(CASE WHEN event_type <> final_token THEN layer END) AS last_other FROM l JOIN f USING (user_id) GROUP BY l.user_id),
s AS (SELECT l.user_id, min(layer) AS settled_layer FROM l JOIN o USING (user_id) WHERE last_other IS NULL OR layer > last_other GROUP BY l.user_id)
SELECT user_id, settled_layer, last_layer, final_token, round(CASE WHEN last_layer <= 0 THEN 0 ELSE settled_layer / last_layer END, 9) AS depth FROM s JOIN f USING (user_id)""")
def settlement_depth(read):
    return _rounded(signals.prediction_depth(_layers(read), ["user_id"], "layer", "event_type"), 9, "depth")


@query(f"""
WITH l AS ({_LAYERS}), p AS (SELECT a.user_id, a.layer AS layer_i, b.layer AS layer_j, CASE WHEN a.event_type = 'error' THEN NULL ELSE a.value * b.value END AS v FROM l a JOIN l b ON a.user_id = b.user_id AND b.layer = a.layer + 1)
SELECT layer_i, round(avg(v), 7) AS mean, count(*) AS n, round((layer_i + 0.5) / 32, 9) AS depth FROM p WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY layer_i""")
def depth_curve_adjacent(read):
    """Means of the pairs of neighbouring layers, by relative depth."""
    rows = _layers(read)
    w = Window.partitionBy("user_id").orderBy("layer")
    pairs = rows.withColumn("layer_j", F.lead("layer").over(w)).withColumn("v", F.when(F.col("event_type") != "error", F.col("value") * F.lead("value").over(w))).withColumnRenamed("layer", "layer_i")
    return _rounded(_rounded(signals.curve(signals.adjacent(pairs), [], "layer_i", "v", F.lit(32), "block"), 7, "mean"), 9, "depth")


@query(f"""
WITH l AS ({_LAYERS}), u AS (SELECT layer, event_type, 'value' AS signal, value::double AS v FROM l UNION ALL SELECT layer, event_type, 'root', sqrt(abs(value)) FROM l)
SELECT event_type, signal, layer, round(avg(v), 7) AS mean, count(*) AS n, round(layer / 64, 9) AS depth FROM u WHERE signal <> 'rank' AND v IS NOT NULL GROUP BY event_type, signal, layer""")
def comparison_long_table(read):
    """Curves of several signals and runs in one table; a signal that does not compare is left out."""
    rows = _layers(read).withColumn("root", F.sqrt(F.abs("value"))).withColumn("rank", F.col("event_id").cast("double"))
    known = rows.sparkSession.createDataFrame([("value",), ("root",)], "signal string")
    out = signals.comparison(rows, ["event_type"], "layer", ["value", "root", "rank"], 64, "residual", F.broadcast(known))
    return _rounded(_rounded(out, 7, "mean"), 9, "depth")


@query("""SELECT l_returnflag, o_orderstatus, count(*) AS n, count(o_orderkey) AS n_joined, round(sum(l_quantity), 2) AS quantity
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' GROUP BY l_returnflag, o_orderstatus""")
def signals_left_join_docs(read):
    """Signals joined to documents, after a check that documents are unique."""
    held = read("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderkey")
    out = signals.join_docs(read("lineitem"), held, ["l_orderkey"])
    return out.groupBy("l_returnflag", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("n_joined"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"""
WITH c AS (SELECT l_orderkey, list(l_extendedprice ORDER BY {_LO}) AS p, list('part ' || l_partkey ORDER BY {_LO}) AS c FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, p, c, CASE WHEN l_orderkey % 3 = 0 THEN (l_orderkey % 5)::varchar WHEN l_orderkey % 3 = 1 THEN ' ' || c[len(c)] || ' ' ELSE 'Paris' END AS target FROM c),
g AS (SELECT *, CASE WHEN regexp_full_match(trim(target), '-?[0-9]{{1,9}}') AND trim(target)::int BETWEEN 0 AND len(c) - 1 THEN trim(target)::int WHEN list_position(c, trim(target)) > 0 THEN list_position(c, trim(target)) - 1 END AS gold FROM s)
SELECT l_orderkey, i AS choice_idx, coalesce(i = gold, false) AS is_target_choice, c[list_position(p, list_max(p))] AS predicted, round(p[i + 1]::float::double, 2) AS choice_logprob FROM g, unnest(range(len(c))) u(i)""")
def docs_from_choices(read):
    """A row per choice with the likeliest choice and the gold one, by place or by text."""
    held = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE_ORDER))).alias("s"))
    held = held.select("l_orderkey", F.transform("s", lambda x: x["l_extendedprice"]).alias("p"), F.transform("s", lambda x: F.concat(F.lit("part "), x["l_partkey"].cast("string"))).alias("c"))
    key = F.col("l_orderkey")
    target = F.when(key % 3 == 0, (key % 5).cast("string")).when(key % 3 == 1, F.concat(F.lit(" "), F.element_at("c", -1), F.lit(" "))).otherwise("Paris")
    out = docs.choice_rows(held.withColumn("target", target), ["l_orderkey"], "p", "c", "target")
    return out.withColumn("choice_logprob", F.round(F.col("choice_logprob").cast("double"), 2))


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, {_LO}) AS nth FROM lineitem), f AS (SELECT l_suppkey, l_returnflag, min(nth) AS first FROM s GROUP BY 1, 2)
SELECT l_suppkey, string_agg(l_returnflag, ',' ORDER BY first) AS filters, arg_min(l_returnflag, first) AS primary_filter FROM f GROUP BY l_suppkey""")
def primary_filter(read):
    """Filters in order of first appearance and the first of them."""
    rows = read("lineitem").withColumn("nth", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", *_LINE_ORDER)))
    found = docs.available_filters(rows, ["l_suppkey"], "l_returnflag", "nth").withColumn("filters", F.array_join("filters", ","))
    return found.join(docs.primary_filters(rows, ["l_suppkey"], "l_returnflag", "nth"), "l_suppkey")


@query("""
WITH s AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN (value / 100)::varchar WHEN event_type = 'purchase' THEN '1e' || (event_id % 2) ELSE (event_id % 2)::varchar END AS acc, CASE WHEN event_type IN ('click', 'view') THEN (value > 50)::int::varchar END AS em FROM events)
SELECT event_id, TRY_CAST(coalesce(acc, em) AS double) = 1 AS is_correct FROM s""")
def verdict_by_presence(read):
    """The verdict of the first metric that is present, null where that is no number."""
    kind = F.col("event_type")
    acc = F.when(kind == "click", None).when(kind == "error", "n/a").when(kind == "view", (F.col("value") / 100).cast("string")).when(kind == "purchase", F.concat(F.lit("1e"), (F.col("event_id") % 2).cast("string"))).otherwise((F.col("event_id") % 2).cast("string"))
    em = F.when(kind.isin("click", "view"), (F.col("value") > 50).cast("int").cast("string"))
    return read("events").select("event_id", docs.verdict({"acc": acc, "em": em}).alias("is_correct"))


@query("""SELECT user_id, event_id, json_extract_string(props, '$.k') AS value FROM events WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') IS NOT NULL""")
def sample_metric_reader(read):
    """One metric of one filter's records, read from JSON."""
    rows = read("events").withColumn("metrics", F.when(F.get_json_object("props", "$.k").isNotNull(), F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")))
    return docs.sample_metrics(rows, ["user_id", "event_id"], "k", "metrics", "props", "event_type", "purchase")


@query("""SELECT l_orderkey, l_returnflag, '[' || string_agg(DISTINCT l_linenumber::varchar, ',' ORDER BY l_linenumber::varchar) || ']' AS choices FROM lineitem GROUP BY 1, 2""")
def choice_alias_collapse(read):
    return docs.collapsed_choices(read("lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber")


@query("""SELECT o_orderpriority, substr(sha256(string_agg(o_orderstatus || ':' || o_orderkey, chr(10) ORDER BY o_orderstatus || ':' || o_orderkey)), 1, 16) AS doc_id_set_hash FROM orders GROUP BY o_orderpriority""")
def doc_id_set_hash(read):
    return docs.doc_set_hash(read("orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey")


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LO}) - 1 AS choice_idx FROM lineitem)
SELECT l_orderkey, arg_min(l_partkey, choice_idx) AS first_part, count(*) AS n_choices FROM r GROUP BY l_orderkey""")
def first_answers(read):
    """Choices numbered in request order and the first answer of each document."""
    rows = docs.choice_ordinals(read("lineitem"), ["l_orderkey"], *_LINE_ORDER)
    first = docs.first_answers(rows, ["l_orderkey"], ["l_partkey"], "choice_idx").withColumnRenamed("l_partkey", "first_part")
    return first.join(rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_choices")), "l_orderkey")


@query(f"""
WITH v AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LO}) AS nth, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount >= 0.05 END AS ok FROM lineitem)
SELECT l_orderkey, arg_max(ok, nth) AS ok FROM v WHERE ok IS NOT NULL GROUP BY l_orderkey""")
def last_verdicts(read):
    rows = read("lineitem").withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))).withColumn("ok", F.when(F.col("l_discount") != 0, F.col("l_discount") >= 0.05))
    return docs.last_verdicts(rows, ["l_orderkey"], "ok", "nth")


@query("""
WITH f AS (SELECT user_id, bool_or(event_type = 'purchase') AS has FROM events GROUP BY user_id)
SELECT e.user_id, count(*) AS n, round(sum(value), 4) AS total FROM events e JOIN f USING (user_id) WHERE NOT has OR event_type = 'purchase' GROUP BY e.user_id""")
def target_choice_filter(read):
    """Only target rows of runs that have one, all rows of the others."""
    rows = signals.target_rows(read("events").withColumn("is_target", F.col("event_type") == "purchase"), ["user_id"], "is_target")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS nth FROM conversations),
c AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_choices FROM conversations GROUP BY conv_id)
SELECT r.conv_id, right(r.text, 300) AS prompt_tail, left(a.text, 60) AS predicted, n_choices FROM r LEFT JOIN r a ON a.conv_id = r.conv_id AND a.role = 'assistant' AND a.nth = 1 JOIN c ON c.conv_id = r.conv_id WHERE r.role = 'user' AND r.nth = 1""")
def prompt_tail_and_choices(read):
    """The end of each first prompt, the beginning of the first answer and how many answers there are."""
    c = read("conversations")
    firsts = docs.first_answers(c, ["conv_id", "role"], ["text"], "turn", "text")
    asked = firsts.where("role = 'user'").select("conv_id", F.right("text", F.lit(300)).alias("prompt_tail"))
    answered = firsts.where("role = 'assistant'").select("conv_id", F.left("text", F.lit(60)).alias("predicted"))
    n = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_choices"))
    return asked.join(answered, "conv_id", "left").join(n, "conv_id")


# Moments

_MOMENTS_SQL = """count(value) AS count, count(value) FILTER (isfinite(value)) AS finite_count, count(*) FILTER (isnan(value)) AS nan, count(*) FILTER (value = 'Infinity') AS posinf, count(*) FILTER (value = '-Infinity') AS neginf,
round(avg(value) FILTER (isfinite(value)), 6) AS mean, round(stddev_pop(value) FILTER (isfinite(value)), 5) AS std, min(value) FILTER (isfinite(value)) AS min, max(value) FILTER (isfinite(value)) AS max"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("std", F.round(F.sqrt(F.col("m2") / F.nullif(F.col("finite_count"), F.lit(0))), 5)).withColumn("mean", F.round("mean", 6)).drop("m2", "observations")


@query(f"WITH v AS (SELECT *, {_value_sql()} AS value FROM lineitem) SELECT l_returnflag, l_orderkey, {_MOMENTS_SQL} FROM v GROUP BY 1, 2")
def moments_per_document(read):
    """Moments with non-finite values kept apart."""
    return _shown(moments.moments(_with_values(read), ["l_returnflag", "l_orderkey"], "value"))


@query(f"WITH v AS (SELECT *, {_value_sql()} AS value FROM lineitem) SELECT l_returnflag, l_linestatus, {_MOMENTS_SQL} FROM v GROUP BY 1, 2")
def moments_merged(read):
    """Partial moments of parts merged; they equal those taken in one pass."""
    parts = moments.moments(_with_values(read), ["l_returnflag", "l_linestatus", "l_suppkey"], "value")
    return _shown(moments.merge(parts, ["l_returnflag", "l_linestatus"]))


@query(f"""
WITH v AS (SELECT *, {_value_sql("l.")} AS value FROM lineitem l JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'),
s AS (SELECT l_returnflag, l_linestatus, l_orderkey, count(*) AS obs, count(value) FILTER (isfinite(value)) AS n, avg(value) FILTER (isfinite(value)) AS m FROM v GROUP BY 1, 2, 3),
p AS (SELECT l_returnflag, l_linestatus, round(avg(value) FILTER (isfinite(value)), 4) AS pooled_mean, round(stddev_pop(value) FILTER (isfinite(value)), 4) AS pooled_std FROM v GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, count(*) AS documents, count(m) AS finite_documents, sum(obs)::bigint AS observations, any_value(pooled_mean) AS pooled_mean, any_value(pooled_std) AS pooled_std, round(avg(m), 4) AS sample_mean, round(stddev_pop(m), 4) AS sample_mean_std,
round(stddev_samp(m) / sqrt(count(m)), 4) AS sample_mean_sem FROM s JOIN p USING (l_returnflag, l_linestatus) GROUP BY 1, 2""")
def moments_dataset_two_stage(read):
    """Calls pooled per document, documents pooled per group; only complete forwards count."""
    forwards = read("orders").select(F.col("o_orderkey").alias("forward"), F.when(F.col("o_orderstatus") != "P", "complete").otherwise("incomplete").alias("status"))
    calls = _with_values(read).withColumn("forward", F.col("l_orderkey"))
    calls = moments.moments(calls, ["forward", "l_returnflag", "l_linestatus", "l_orderkey", "l_partkey"], "value")
    samples = moments.pool_calls(calls, forwards, ["l_returnflag", "l_linestatus"], "l_orderkey")
    # Lines of one part are one call of several values here, so observations are the values.
    out = moments.pool_documents(samples.withColumn("observations", F.col("count")), ["l_returnflag", "l_linestatus"])
    out = _rounded(out, 4, "pooled_mean", "pooled_std", "sample_mean", "sample_mean_std", "sample_mean_sem")
    return out.select("l_returnflag", "l_linestatus", "documents", "finite_documents", "observations", "pooled_mean", "pooled_std", "sample_mean", "sample_mean_std", "sample_mean_sem")


@query("""
WITH e AS (SELECT label, i AS axis_index, embedding[i + 1]::double AS x FROM embeddings, unnest(range(len(embedding))) u(i))
SELECT label, axis_index, count(*) AS count, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(min(x), 6) AS min, round(max(x), 6) AS max FROM e GROUP BY 1, 2""")
def axis_stats_feature(read):
    """Moments per feature of array rows."""
    out = moments.axis_moments(read("embeddings"), ["label"], "embedding")
    out = out.withColumn("variance", F.round(F.col("m2") / F.col("finite_count"), 6))
    return _rounded(out, 6, "mean", "min", "max").select("label", "axis_index", "count", "mean", "variance", "min", "max")


@query("""
WITH e AS (SELECT vec_id, i AS flat_index, embedding[i + 1]::double AS x FROM embeddings, unnest(range(len(embedding))) u(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, flat_index) - 1 AS abs_rank FROM e)
SELECT vec_id, abs_rank, flat_index, round(x, 6) AS value FROM r WHERE abs_rank < 8""")
def extremes_topk(read):
    """The largest magnitudes of each row."""
    return _rounded(moments.extremes(read("embeddings"), ["vec_id"], "embedding", 8), 6, "value")


@query(f"""WITH v AS (SELECT *, {_value_sql()} AS value FROM lineitem), f AS (SELECT *, CASE WHEN isfinite(value) THEN value END AS x FROM v)
SELECT l_returnflag, round(min(x), 2) AS min, round(max(x), 2) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(quantile_disc(x, 0.5), 2) AS median, count(*) FILTER (isnan(value)) AS nan, count(*) FILTER (isinf(value)) AS inf FROM f GROUP BY 1""")
def lower_median_numeric_stats(read):
    """What a trace tells of a tensor, non-finite values among its own."""
    return _rounded(_rounded(moments.numeric_summary(_with_values(read), ["l_returnflag"], "value"), 2, "min", "max", "median"), 4, "mean", "std")


@query("""SELECT c_mktsegment, c_custkey AS module, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS observation_count, coalesce((SELECT sum(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT'), 0)::bigint AS exclusion_count FROM customer c""")
def coverage_view(read):
    """Modules with their observation and exclusion counts, each counted before it is joined."""
    o = read("orders").withColumnRenamed("o_custkey", "module")
    out = o.where("o_orderpriority = '1-URGENT'").select("module", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("count"))
    return moments.coverage(read("customer").select("c_mktsegment", F.col("c_custkey").alias("module")), o, out)


@query("""
WITH d AS (SELECT doc_id, lang, toxic, length(coalesce(text, '')) AS n FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT lang, CASE WHEN toxic IS NULL THEN 'not labelled' WHEN toxic = 1 THEN 'toxic' WHEN n < 200 THEN 'short' END AS reason FROM d)
SELECT lang, reason, count(*) AS count FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
def exclusions_by_reason(read):
    """How often each first reason leaves a document out."""
    rows = read("documents").join(read("labels"), "doc_id", "left")
    why = checks.reasons((F.col("toxic").isNull(), "not labelled"), (F.col("toxic") == 1, "toxic"), (F.length(F.coalesce("text", F.lit(""))) < 200, "short"))
    return moments.exclusion_counts(rows.withColumn("reason", why).where("reason IS NOT NULL"), ["lang", "reason"])


@query("""SELECT event_type, date_trunc('day', ts) AS day, count(value) AS n, round(avg(value), 6) AS mean, CASE WHEN count(value) > 1 THEN round(stddev_samp(value) / sqrt(count(value)), 6) END AS stderr FROM events GROUP BY 1, 2""")
def judge_score_aggregation(read):
    return _rounded(moments.metric_mean_and_error(read("events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")), ["event_type", "day"], "value"), 6, "mean", "stderr")


@query(f"""
WITH l AS ({_LAYERS}), f AS (SELECT user_id, arg_max(event_type, layer) AS t, max(layer) AS n, avg(value) AS v FROM l GROUP BY user_id)
SELECT t AS final_token, round(median(n), 4) AS median, count(*) AS n, round(corr(n, v), 6) AS r FROM f GROUP BY t""")
def median_depth_and_corr(read):
    rows = signals.prediction_depth(_layers(read), ["user_id"], "layer", "event_type").join(read("events").groupBy("user_id").agg(F.avg("value").alias("v")), "user_id").withColumn("last_layer", F.col("last_layer").cast("double"))
    out = signals.medians(rows, ["final_token"], "last_layer").join(signals.correlation(rows, ["final_token"], "last_layer", "v").drop("n"), "final_token")
    return _rounded(_rounded(out, 4, "median"), 6, "r")


# Array reductions


@query("""
WITH n AS (SELECT *, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS nn FROM embeddings)
SELECT a.vec_id // 32 AS doc_id, a.vec_id AS layer_i, b.vec_id AS layer_j, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (a.nn * b.nn), 6) AS cos FROM n a JOIN n b ON a.vec_id // 32 = b.vec_id // 32 AND a.vec_id <= b.vec_id""")
def layer_similarity_triangle(read):
    """Cosines of all layers i <= j of a document, which has 32 of them."""
    rows = read("embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 32))
    return _rounded(tensors.similarity(rows, ["doc_id"], "vec_id", "embedding"), 6, "cos")


@query("""
WITH h AS (SELECT vec_id, i AS head, embedding[(i // 2) * 8 + 1 : (i // 2) * 8 + 8]::double[] AS v FROM embeddings, unnest(range(16)) u(i)) SELECT vec_id, head, round(sqrt(list_dot_product(v, v)), 6) AS value_norm FROM h""")
def value_norm_gqa(read):
    """Norms per key-value head, repeated for the query heads that share it."""
    return _rounded(tensors.value_norms(read("embeddings"), ["vec_id"], "embedding", 8, 16), 6, "value_norm")


@query("""
WITH e AS (SELECT vec_id, embedding::double[] AS a, label FROM embeddings), s AS (SELECT *, list_max(a) AS top FROM e)
SELECT vec_id, (list_position(a, top) - 1)::bigint AS lens_token_id, round(1 / list_sum(list_transform(a, lambda x: exp(x - top))), 6) AS lens_prob, len(list_filter(a, lambda x: x > a[label + 1])) AS target_rank, round(len(list_filter(a, lambda x: x > a[label + 1])) / len(a), 6) AS target_percentile FROM s""")
def logit_lens_top1_rank(read):
    """Likeliest token, its probability and the target's rank."""
    return _rounded(tensors.logit_lens(read("embeddings"), ["vec_id"], "embedding", "label"), 6, "lens_prob", "target_percentile")


@query("""
WITH e AS (SELECT vec_id, i AS expert, embedding[i + 1]::double AS x, list_max(embedding)::double AS top, embedding::double[] AS a FROM embeddings, unnest(range(len(embedding))) u(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, expert) - 1 AS rank FROM e)
SELECT vec_id, rank, expert, round(exp(x - top) / list_sum(list_transform(a, lambda y: exp(y - top))), 6) AS weight, 'finite' AS weight_state FROM r WHERE rank < 4""")
def routing_topk_softmax(read):
    """The likeliest experts with their weights."""
    return _rounded(tensors.routing(read("embeddings"), ["vec_id"], "embedding", 4), 6, "weight")


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm, len(list_filter(embedding, lambda x: x > 0)) AS n_positive FROM embeddings""")
def hook_metric_udf(read):
    """Metrics of a user's function, checked against their declared names."""
    from runlens.functions.hooks import hook_metrics

    def observe(x):
        import numpy as np

        return {"norm": np.sqrt((x.astype("float64") ** 2).sum(axis=1)), "n_positive": (x > 0).sum(axis=1)}

    out = hook_metrics(read("embeddings"), ["vec_id"], "embedding", observe, ["norm", "n_positive"])
    return _rounded(out, 6, "norm").withColumn("n_positive", F.col("n_positive").cast("long"))


# Runs


@query("""
WITH r AS (SELECT s_suppkey AS path, s_acctbal > 0 AS completed, CASE WHEN s_nationkey % 7 = 0 THEN '0.3' ELSE '0.4' END AS schema_version, (s_suppkey % 5)::varchar AS reducer_versions FROM supplier),
m AS (SELECT reducer_versions AS v FROM r WHERE completed AND schema_version = '0.4' GROUP BY 1 ORDER BY count(*) DESC, min(path) LIMIT 1)
SELECT path, CASE WHEN NOT completed THEN 'not completed' WHEN schema_version <> '0.4' THEN 'another schema version' WHEN reducer_versions <> (SELECT v FROM m) THEN 'reducer versions of a minority' END AS reason FROM r""")
def run_screening_majority(read):
    """Runs with the reason why each may not be compared."""
    r = read("supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_acctbal") > 0).alias("completed"), F.when(F.col("s_nationkey") % 7 == 0, "0.3").otherwise("0.4").alias("schema_version"), (F.col("s_suppkey") % 5).cast("string").alias("reducer_versions"))
    return runs.screen(r, "0.4").select("path", "reason")


@query("""
WITH g AS (SELECT p_brand, p_type, count(*) AS n_runs, count(DISTINCT p_size) AS n_vocab FROM part GROUP BY 1, 2), s AS (SELECT * FROM (VALUES ('target_percentile', true), ('cos', true), ('lens_prob', false)) v(signal, comparable))
SELECT g.p_brand, g.p_type, n_runs, n_vocab > 1 AS mixed_vocab, count(signal) AS n_signals FROM g JOIN s ON comparable OR n_vocab <= 1 GROUP BY 1, 2, 3, 4""")
def group_by_model_vocab_gate(read):
    """Groups of runs, and how many signals may be compared in each."""
    from runlens.schema import OWN_VOCABULARY

    parts = read("part")
    groups = runs.groups_of_runs(parts, ["p_brand", "p_type"], "p_size")
    names = ["target_percentile", "cos", "lens_prob"]
    columns = parts.sparkSession.createDataFrame([(n, n not in OWN_VOCABULARY) for n in names], "signal string, comparable boolean")
    held = groups.select("p_brand", "p_type", F.explode(F.array(*map(F.lit, names))).alias("signal"))
    kept = runs.vocab_gate(held, groups, columns, ["p_brand", "p_type"]).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n_signals"))
    return groups.select("p_brand", "p_type", "n_runs", "mixed_vocab").join(kept, ["p_brand", "p_type"])


@query("""SELECT s_nationkey, count(DISTINCT lang) AS n_datasets, count(*) AS n_runs FROM (SELECT s_nationkey, s_suppkey % 3 AS lang FROM supplier WHERE s_acctbal > 2000) GROUP BY 1 HAVING count(DISTINCT lang) >= 2""")
def group_by_language(read):
    return runs.language_groups(read("supplier").where("s_acctbal > 2000").withColumn("lang", F.col("s_suppkey") % 3), ["s_nationkey"], "lang")


@query("""
WITH m AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'N' AND l_quantity > 45 THEN 'acc,none' WHEN l_returnflag = 'A' THEN 'exact_match,strict' WHEN l_returnflag = 'R' THEN 'acc_norm_stderr,none' ELSE 'other' END AS metric, l_discount AS v FROM lineitem),
e AS (SELECT l_suppkey, split_part(metric, ',', 1) AS metric, avg(v) AS score FROM m WHERE metric LIKE '%,%' AND metric NOT LIKE '%stderr%' GROUP BY 1, 2)
SELECT l_suppkey, arg_min(metric, CASE metric WHEN 'acc_norm' THEN 1 WHEN 'acc' THEN 2 ELSE 3 END) AS metric, round(arg_min(score, CASE metric WHEN 'acc_norm' THEN 1 WHEN 'acc' THEN 2 ELSE 3 END), 6) AS score FROM e GROUP BY 1""")
def score_headline_priority(read):
    """One headline score per run, by preference of metrics."""
    flag = F.col("l_returnflag")
    m = read("lineitem").withColumn("metric", F.when((flag == "N") & (F.col("l_quantity") > 45), "acc,none").when(flag == "A", "exact_match,strict").when(flag == "R", "acc_norm_stderr,none").otherwise("other"))
    return _rounded(runs.headline_scores(m, ["l_suppkey"], "metric", "l_discount"), 6, "score")


@query("""
WITH s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE round(s_acctbal / 100) END AS score FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC NULLS LAST, s_suppkey) AS n FROM s)
SELECT s_nationkey, s_suppkey, score FROM r WHERE n = 1""")
def reference_run(read):
    """The best run of each group, the first among equals."""
    s = read("supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 11 != 0, F.round(F.col("s_acctbal") / 100)).alias("score"))
    return runs.reference_runs(s, ["s_nationkey"], "score", "s_suppkey")


@query("""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) > 1 THEN p_type || ' (' || p_name || ')' ELSE p_type END AS series FROM part""")
def series_labels(read):
    return runs.series_names(read("part"), ["p_brand"], "p_type", "p_name").select("p_partkey", "series")


# Pairing

_PARTS = "SELECT l_returnflag AS run, l_partkey AS doc, avg(l_discount) >= 0.05 AS correct, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2"


def _parts(read) -> DataFrame:
    """lineitem as runs (return flags) over documents (parts) with verdicts.

    Discounts are added in the order of the rows in their files, as the SQL
    does in one thread: in another order the sum of one document in twenty,
    whose mean is 0.05 but for rounding, falls to the other side now and then.
    """
    rows = read("lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("doc"), "l_discount", "l_quantity", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    so_far = Window.partitionBy("run", "doc").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("total", F.sum("l_discount").over(so_far))
    return rows.groupBy("run", "doc").agg((F.max_by("total", "place") / F.count("l_discount") >= 0.05).alias("correct"), F.max("l_quantity").alias("q"))


@query("SELECT l_partkey AS doc FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def pairing_intersection(read):
    """Documents that every run has."""
    return pairing.shared_by_all(_parts(read), "run", "doc")


@query("""
WITH v AS (SELECT l_returnflag AS run, l_linenumber AS doc, f.field, CASE f.field WHEN 'number' THEN l_linenumber::varchar WHEN 'parity' THEN (l_linenumber % 2)::varchar ELSE CASE WHEN l_linenumber < 3 THEN NULL ELSE l_returnflag || l_linenumber END END AS value FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem), (VALUES ('number'), ('parity'), ('own')) f(field)),
d AS (SELECT run, count(DISTINCT doc) AS n_docs FROM v GROUP BY 1), e AS (SELECT run, field, count(*) AS n, count(DISTINCT value) AS nv, string_agg(DISTINCT value, ',' ORDER BY value) AS vs FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT field, bool_and(n = n_docs) AS everywhere, bool_and(n = nv) AS is_unique, count(DISTINCT vs) = 1 AS same_values, bool_and(n = n_docs) AND bool_and(n = nv) AND count(DISTINCT vs) = 1 AND count(*) = (SELECT count(*) FROM d) AS qualifies FROM e JOIN d USING (run) GROUP BY field""")
def pairing_field_discovery(read):
    """Which fields pair the documents of all runs."""
    rows = read("lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("doc")).distinct()
    held = rows.select("run", "doc", F.create_map(F.lit("number"), F.col("doc").cast("string"), F.lit("parity"), (F.col("doc") % 2).cast("string"), F.lit("own"), F.when(F.col("doc") >= 3, F.concat("run", F.col("doc").cast("string")))).alias("m"))
    return pairing.field_report(held.select("run", "doc", F.explode("m").alias("field", "value")), "run", "field", "value")


@query("""
WITH d AS (SELECT s_nationkey % 3 AS run, s_suppkey AS doc, s_acctbal FROM supplier), m AS (SELECT run, doc, doc // 4 AS canonical FROM d WHERE s_acctbal > 0 UNION ALL SELECT run, doc, doc // 4 FROM d WHERE s_acctbal > 9000),
r AS (SELECT run, doc, count(*) AS n_rows, min(canonical) AS canonical FROM m GROUP BY 1, 2), h AS (SELECT d.run, d.doc, n_rows, canonical FROM d LEFT JOIN r USING (run, doc)),
p AS (SELECT run, canonical, count(*) AS n FROM h WHERE n_rows = 1 GROUP BY 1, 2), q AS (SELECT canonical, count(*) AS in_runs, max(n) AS most FROM p GROUP BY 1)
SELECT h.run, h.doc, CASE WHEN n_rows = 1 THEN h.canonical END AS canonical, CASE WHEN n_rows IS NULL THEN 'unmapped' WHEN n_rows > 1 THEN 'duplicate_mapping_rows' WHEN n > 1 THEN 'many_to_one' WHEN most > 1 THEN 'counterpart_many_to_one' WHEN in_runs < (SELECT count(DISTINCT run) FROM d) THEN 'not_in_every_language' ELSE 'paired' END AS pairing_status
FROM h LEFT JOIN p ON p.run = h.run AND p.canonical = h.canonical LEFT JOIN q ON q.canonical = h.canonical""")
def mapping_many_to_one(read):
    """Documents paired by a mapping, or why not."""
    d = read("supplier").select((F.col("s_nationkey") % 3).alias("run"), F.col("s_suppkey").alias("doc"), "s_acctbal")
    m = d.where("s_acctbal > 0").withColumn("canonical", F.floor(F.col("doc") / 4))
    return pairing.mapped(d, m.unionByName(m.where("s_acctbal > 9000")), "run", "doc", "canonical")


_GOLD = "CASE WHEN doc % 13 = 0 AND run = 'A' THEN NULL WHEN doc % 11 = 0 AND run = 'R' THEN 'target:' || (q % 2)::int ELSE 'choice:' || (CASE WHEN q >= 50 THEN 1 ELSE 0 END) END"


def _gold(read) -> DataFrame:
    q, doc, run = F.col("q"), F.col("doc"), F.col("run")
    place = F.when((doc % 13 == 0) & (run == "A"), None).when((doc % 11 == 0) & (run == "R"), None).otherwise(F.when(q >= 50, 1).otherwise(0))
    target = F.when((doc % 11 == 0) & (run == "R") & ~((doc % 13 == 0) & (run == "A")), (q % 2).cast("int").cast("string"))
    return _parts(read).withColumn("gold", pairing.evidence(place, F.array().cast("array<string>"), F.lit(None).cast("string"), target))


@query(f"""
WITH p AS ({_PARTS}), g AS (SELECT run, doc, {_GOLD} AS gold FROM p), e AS (SELECT doc, count(DISTINCT gold) AS nv, count(DISTINCT split_part(gold, ':', 1)) AS nk, count(*) FILTER (gold LIKE 'invalid:%') AS bad, count(DISTINCT run) FILTER (gold IS NOT NULL) AS told FROM g GROUP BY doc HAVING count(DISTINCT run) = 3),
s AS (SELECT CASE WHEN bad > 0 OR nk > 1 THEN 'unverifiable' WHEN nv > 1 THEN 'disagree' ELSE 'agree' END AS s FROM e WHERE told = 3), c AS (SELECT count(*) AS shared, count(*) FILTER (s = 'agree') AS agree, count(*) FILTER (s = 'disagree') AS disagree, count(*) FILTER (s = 'unverifiable') AS unverifiable FROM s)
SELECT *, round(agree / (agree + disagree), 6) AS rate, agree / (agree + disagree) >= 0.9 AS aligned FROM c""")
def gold_alignment(read):
    """How far the gold answers of shared documents agree."""
    return _rounded(pairing.alignment(pairing.answer_status(_gold(read), "doc", "run", "gold")), 6, "rate")


@query(f"""
WITH p AS ({_PARTS}), e AS (SELECT doc, bool_or(correct) FILTER (run = 'A') AS ref, bool_and(correct) FILTER (run <> 'A') AS every, bool_or(correct) FILTER (run <> 'A') AS anyone FROM p GROUP BY doc HAVING count(DISTINCT run) = 3)
SELECT doc, CASE WHEN ref AND every THEN 'all_correct' WHEN NOT ref AND NOT anyone THEN 'all_wrong' WHEN ref AND NOT anyone THEN 'only_reference' WHEN NOT ref AND every THEN 'only_others' ELSE 'mixed' END AS bucket FROM e""")
def agreement_buckets(read):
    """What a reference run and the others make of each document."""
    return pairing.agreement(_parts(read), "doc", "run", "correct", "A")


@query(f"""
WITH p AS ({_PARTS}), g AS (SELECT run, doc, {_GOLD} AS gold FROM p), e AS (SELECT doc, count(DISTINCT gold) AS nv, count(DISTINCT split_part(gold, ':', 1)) AS nk, count(*) FILTER (gold LIKE 'invalid:%') AS bad, count(DISTINCT run) FILTER (gold IS NOT NULL) AS told FROM g GROUP BY doc HAVING count(DISTINCT run) = 3)
SELECT run, CASE WHEN e.doc IS NULL THEN 'not_in_every_language' WHEN told < 3 THEN 'no_gold_evidence' WHEN bad > 0 OR nk > 1 THEN 'unverifiable' WHEN nv > 1 THEN 'disagree' ELSE 'agree' END AS status, count(*) AS n FROM g LEFT JOIN e USING (doc) GROUP BY 1, 2""")
def pairing_table_coverage(read):
    """Per run, how many documents pair and what their answers tell."""
    rows = _gold(read)
    paired, kind = attach.attach_pairing(rows.select("run", "doc"), pair_on="position")
    series = rows.select("run").distinct().select("run", F.col("run").alias("series"), F.lit("model").alias("model"), F.lit(0).alias("num_fewshot"), F.lit(None).cast("string").alias("language"))
    table = attach.pairing_table(paired.withColumn("task_name", F.lit("parts")).withColumn("doc_id", F.col("doc")), rows.select("run", "doc", "gold"), series, kind)
    return attach.provenance(table).select(F.col("run_path").alias("run"), F.col("outcome").alias("status"), "n")


@query("""
WITH r AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('1234|' || o_orderkey), o_orderkey) AS n FROM orders) SELECT o_orderpriority, o_orderstatus, o_orderkey FROM r WHERE n <= 10""")
def stratified_sample(read):
    """Ten documents of each task and verdict."""
    return pairing.stratified(read("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 10).select("o_orderpriority", "o_orderstatus", "o_orderkey")


@query(f"""
WITH p AS ({_PARTS}), e AS (SELECT doc, bool_or(correct) FILTER (run = 'A') AS ref, bool_and(correct) FILTER (run <> 'A') AS every, bool_or(correct) FILTER (run <> 'A') AS anyone FROM p GROUP BY doc HAVING count(DISTINCT run) = 3),
b AS (SELECT doc, CASE WHEN ref AND every THEN 'all_correct' WHEN NOT ref AND NOT anyone THEN 'all_wrong' WHEN ref AND NOT anyone THEN 'only_reference' WHEN NOT ref AND every THEN 'only_others' ELSE 'mixed' END AS bucket FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('1234|' || doc), doc) AS n FROM b) SELECT bucket, c.doc, p.run, p.correct FROM c JOIN p USING (doc) WHERE n <= 3""")
def examples_per_bucket(read):
    """Three documents of each bucket with what every run answered."""
    rows = _parts(read)
    chosen = pairing.stratified(pairing.agreement(rows, "doc", "run", "correct", "A"), ["bucket"], "doc", 3)
    return rows.join(F.broadcast(chosen), "doc").select("bucket", "doc", "run", "correct")


@query("""
WITH d AS (SELECT o_custkey AS doc, o_orderstatus AS run, sha256(string_agg(o_orderpriority, '|' ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1, 2) SELECT doc FROM d GROUP BY doc HAVING count(DISTINCT run) = 3 AND count(DISTINCT h) = 1""")
def comparable_prompts(read):
    """Documents whose whole prompt is the same in every run: the priorities of a customer's orders, by status."""
    o = read("orders").groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("run")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("t"))
    return pairing.same_prompts(o.withColumn("h", F.sha2(F.array_join(F.transform("t", lambda t: t["o_orderpriority"]), "|"), 256)), "doc", "run", "h")


# Keys, resumption and validation


@query("""
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT k, 'a' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'b' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def table_agreement(read):
    """Keys that only one of two tables has."""
    return checks.key_differences(read("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k")), read("lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(read):
    """Work that no row records yet."""
    done = read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return pairing.new_work(read("orders"), done, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(read):
    return checks.repeated(read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH d AS (SELECT (doc_id - doc_id % 10 * (doc_id % 3 // 2))::varchar AS id, CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE text END AS question, string_split(coalesce(text, ''), ' ') AS choices, (doc_id % 6)::int - 1 AS label, doc_id FROM documents), t AS (SELECT id, count(*) AS n FROM d GROUP BY 1)
SELECT doc_id, CASE WHEN trim(id) = '' THEN 'missing id' WHEN n > 1 THEN 'repeated id' WHEN question IS NULL OR trim(question, ' ') = '' THEN 'blank question' WHEN len(choices) < 2 THEN 'fewer than two choices' WHEN len(list_filter(choices, lambda c: trim(c, ' ') = '')) > 0 THEN 'blank choice' WHEN label < 0 OR label >= len(choices) THEN 'label out of range' END AS problem FROM d JOIN t USING (id)""")
def benchmark_validation_report(read):
    """Benchmark items with the first rule that each breaks."""
    i = F.col("doc_id")
    d = read("documents").select("doc_id", (i - i % 10 * F.floor(i % 3 / 2)).cast("string").alias("id"), F.when(i % 17 == 0, "  ").otherwise(F.col("text")).alias("question"), F.split(F.coalesce("text", F.lit("")), " ").alias("choices"), ((i % 6).cast("int") - 1).alias("label"))
    return checks.benchmark_problems(d).select("doc_id", "problem")


@query("SELECT conv_id, turn, sha256(text) AS prompt_hash, sha256(text) = sha256(trim(text, ' ')) AS verified FROM conversations")
def prompt_hash_verify(read):
    """Prompts checked against the hash that a run recorded."""
    h = F.sha2("text", 256)
    return read("conversations").select("conv_id", "turn", h.alias("prompt_hash"), (h == F.sha2(F.trim("text"), 256)).alias("verified"))


@query("""
WITH w AS (SELECT conv_id, turn, sha256(role || '|' || text) AS identity FROM conversations), c AS (SELECT identity, CASE WHEN turn = 0 THEN 'success' ELSE 'failed' END AS status FROM w WHERE turn <= 1) SELECT conv_id, turn, identity FROM w WHERE identity NOT IN (SELECT identity FROM c WHERE status = 'success')""")
def judge_cache_work_list(read):
    """Requests that no successful record answers."""
    w = read("conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "role", "text"), 256).alias("identity"))
    done = w.where("turn = 0").select("identity")
    return pairing.new_work(w, done, ["identity"]).select("conv_id", "turn", "identity")


@query("""
SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN substr(source, 5) ELSE source END || '#' || doc_id AS doc_key, replace(source, '/', '__') AS slug, lang AS task_name FROM documents""")
def doc_key_normalisation(read):
    """Document keys less a declared prefix, a path-safe name, and TASK#ID taken apart again."""
    d = read("documents")
    ref = scalar.task_doc(F.concat_ws("#", "lang", F.col("doc_id").cast("string")))
    return d.select("doc_id", scalar.doc_key(F.col("source"), F.col("doc_id"), F.lit("src1")).alias("doc_key"), scalar.model_slug(F.col("source")).alias("slug"), ref["task_name"].alias("task_name"))


# Traces

_TRACE = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'click' THEN 'enter' WHEN 'purchase' THEN 'exit' ELSE event_type END AS event FROM events"


def _trace(read) -> DataFrame:
    """events as a trace per user: clicks enter, purchases exit."""
    kind = F.col("event_type")
    return read("events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("event", F.when(kind == "click", "enter").when(kind == "purchase", "exit").otherwise(kind))


@query(f"WITH t AS ({_TRACE}) SELECT user_id, count(*) FILTER (event = 'enter') AS n_enters, arg_min(event_type, i) AS phase FROM t GROUP BY user_id")
def trace_forward_index(read):
    return trace.forward_index(_trace(read), ["user_id"], "i", "event", "event_type")


@query(f"""
WITH RECURSIVE t AS ({_TRACE}), m AS (SELECT user_id, i, event, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM t WHERE event IN ('enter', 'exit')),
s AS (SELECT user_id, k, CASE WHEN event = 'enter' THEN [i] ELSE []::bigint[] END AS stack, NULL::bigint AS enter, CASE WHEN event = 'exit' THEN i END AS exit, CASE WHEN event = 'exit' THEN 'orphan' END AS status, 0 AS depth FROM m WHERE k = 1
UNION ALL SELECT m.user_id, m.k, CASE WHEN m.event = 'enter' THEN list_append(stack, m.i) ELSE stack[:len(stack) - 1] END, CASE WHEN m.event = 'exit' AND len(stack) > 0 THEN stack[len(stack)] END, CASE WHEN m.event = 'exit' THEN m.i END, CASE WHEN m.event = 'exit' THEN CASE WHEN len(stack) > 0 THEN 'closed' ELSE 'orphan' END END, CASE WHEN m.event = 'exit' THEN len(stack) ELSE 0 END FROM s JOIN m ON m.user_id = s.user_id AND m.k = s.k + 1),
z AS (SELECT user_id, arg_max(stack, k) AS stack FROM s GROUP BY user_id)
SELECT user_id, enter, exit, depth, status FROM s WHERE status IS NOT NULL UNION ALL SELECT user_id, stack[j], NULL, j, 'unwound' FROM z, unnest(range(1, len(stack) + 1)) u(j)""")
def trace_enter_exit_pairing(read):
    """Calls with their exits, frames that were unwound and exits that close nothing."""
    return trace.calls(_trace(read), ["user_id"], "i", "event")


@query(f"""
WITH t AS ({_TRACE}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS n FROM t), c AS (SELECT user_id, greatest(0, count(*) - 10) AS dropped FROM t GROUP BY user_id) SELECT user_id, event_id, i, dropped FROM r JOIN c USING (user_id) WHERE n <= 10""")
def trace_ring_tail(read):
    """The last ten events of each session and what a ring would have dropped."""
    return trace.tail(_trace(read), ["user_id"], "i", 10).select("user_id", "event_id", "i", "dropped")


@query(f"""WITH t AS ({_TRACE}) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS step, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY i) = 1 THEN 'prefill' ELSE 'decode' END AS stage, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS phase FROM t""")
def event_stage_generation(read):
    """Steps and stages of a generation, and the phase carried forward."""
    rows = trace.generation_steps(_trace(read), ["user_id"], "i").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return trace.carried(rows, ["user_id"], "i", "mark", "phase").select("user_id", "event_id", "step", "stage", "phase")


@query(f"""
WITH t AS ({_TRACE}), d AS (SELECT user_id, event_type, arg_max(value, i) AS last_value, max(i) AS last_i FROM t WHERE event <> 'enter' GROUP BY 1, 2) SELECT t.user_id, t.i, round(d.last_value, 6) AS last_value, d.last_i FROM t LEFT JOIN d ON d.user_id = t.user_id AND d.event_type = 'view' WHERE t.event = 'enter'""")
def trace_enriched_enters(read):
    """Enter events with the last detail recorded for them."""
    rows = _trace(read)
    details = rows.where("event = 'view'").withColumn("last_i", F.col("i")).withColumn("last_value", F.round("value", 6)).withColumn("call", F.col("user_id"))
    enters = rows.where("event = 'enter'").withColumn("call", F.col("user_id"))
    return trace.enriched(enters, details, ["call"], "i", ["last_value", "last_i"]).select("user_id", "i", "last_value", "last_i")


# Collection


@query("""
SELECT l_orderkey, l_linenumber AS position, CASE WHEN l_linenumber < 3 THEN 'prompt' WHEN l_returnflag = 'R' THEN 'generated' ELSE 'continuation' END AS token_role, count(*) AS n FROM lineitem
WHERE l_linenumber >= 2 AND l_linenumber < 6 AND l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2, 3""")
def selected_contexts(read):
    """Positions in a range, of chosen documents, that are scored, with the role of their tokens."""
    rows = read("lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), F.lit(3).alias("prompt_length"), F.when(F.col("l_returnflag") == "R", "generate").otherwise("choice").alias("kind"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("step"))
    wanted = read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = collect.selected_contexts(rows, wanted, ("l_orderkey",), 2, 6, scored_only=True)
    return out.groupBy("l_orderkey", "position", "token_role").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id, round(list_sum(embedding[label + 1 : label + 16]::double[]), 6) AS valid_sum, round(embedding[3]::double + embedding[1]::double, 6) AS gathered_sum FROM embeddings""")
def position_slices(read):
    """The unpadded part of a row, and elements gathered by place."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    e = read("embeddings")
    return _rounded(e.select("vec_id", total(collect.valid_part(F.col("embedding"), F.col("label"), F.lit(16))).alias("valid_sum"), total(collect.gathered(F.col("embedding"), F.array(F.lit(2), F.lit(0)))).alias("gathered_sum")), 6, "valid_sum", "gathered_sum")


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS forward FROM orders GROUP BY 1) SELECT o_orderkey, o_custkey, forward FROM orders JOIN f USING (o_custkey)""")
def request_documents(read):
    """Requests of one prefix share a forward, which serves all their documents."""
    o = read("orders")
    forwards = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("forward"))
    return collect.request_documents(o, forwards, "o_custkey", ["o_orderkey"])


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LO}) AS step FROM lineitem) SELECT l_orderkey, string_agg(l_partkey::varchar, ' ' ORDER BY step) AS token_ids FROM s WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def emitted_tokens(read):
    """What wanted documents emitted, in order."""
    steps = docs.choice_ordinals(read("lineitem"), ["l_orderkey"], *_LINE_ORDER).withColumn("step", F.col("choice_idx")).withColumn("choice_idx", F.lit(0))
    wanted = read("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = collect.emitted_tokens(steps, wanted, ["l_orderkey"], "step", "l_partkey")
    return out.withColumn("token_ids", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " "))


@query("""WITH m AS (SELECT DISTINCT l_returnflag FROM lineitem), e AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT l_returnflag, o_orderkey FROM m, e WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = m.l_returnflag AND l.l_orderkey = e.o_orderkey)""")
def custom_rows_missing(read):
    """Rows that each module should have and lacks."""
    rows = read("lineitem").select("l_returnflag", F.col("l_orderkey").alias("o_orderkey"))
    return collect.incomplete(rows, read("orders").where("o_orderstatus = 'P'"), "l_returnflag", ["o_orderkey"])


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS correct, count(*) FILTER (o_orderstatus = 'O') AS incorrect, count(*) FILTER (o_orderstatus = 'P') AS unknown FROM orders GROUP BY 1""")
def collection_counts(read):
    o = read("orders").withColumn("ok", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False))
    return collect.verdict_counts(o, ["o_orderpriority"], "ok")


@query("""SELECT conv_id, arg_max(sha256(text), turn * 10 + CASE role WHEN 'user' THEN 1 ELSE 0 END) AS h FROM conversations WHERE role <> 'system' GROUP BY 1""")
def prompt_hashes(read):
    """The last hash of each conversation that is not empty."""
    c = read("conversations").select("conv_id", F.when(F.col("role") != "system", F.sha2("text", 256)).otherwise("").alias("h"), (F.col("turn") * 10 + (F.col("role") == "user").cast("int")).alias("i"))
    return collect.prompt_hashes(c, ["conv_id"], "h", "i")


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n_choices FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY event_type) <= 3 AS shown FROM e""")
def sample_display_counts(read):
    """Choices per document and which a display of three would show."""
    return trace.sample_counts(read("events"), ["user_id", "event_type"], 3)


@query("""WITH h AS (SELECT l_orderkey, bool_or(l_linenumber = 7 AND l_returnflag = 'A') AS has FROM lineitem GROUP BY 1) SELECT l_orderkey FROM h WHERE has""")
def forwards_of_document(read):
    """Forwards whose samples cover one document of one task."""
    held = read("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("task_name"), F.col("l_linenumber").alias("doc_id"))).alias("samples"))
    return trace.forwards_of(held, "samples", 7, "A").select("l_orderkey")


@query(f"""WITH t AS ({_TRACE}), d AS (SELECT user_id, i, event, sum(CASE event WHEN 'enter' THEN 1 WHEN 'exit' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS h FROM t) SELECT user_id, i, (h - least(0, min(h) OVER (PARTITION BY user_id ORDER BY i)))::bigint AS depth FROM d""")
def trace_depth(read):
    """The height of the call stack after each event."""
    return trace.depths(_trace(read), ["user_id"], "i", "event").select("user_id", "i", "depth")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'decode' ELSE 'model_forward' END AS phase, 'layers.' || (doc_id % 5) || CASE WHEN doc_id % 4 = 0 THEN '.self_attn' ELSE '.mlp' END AS module, CASE doc_id % 6 WHEN 0 THEN 'RotaryEmbedding' WHEN 1 THEN 'SdpaAttention' ELSE 'Block' END AS module_type,
  CASE doc_id % 10 WHEN 0 THEN 'kwargs.attention_mask' WHEN 1 THEN 'past_key_values.0' WHEN 2 THEN 'output.cos' WHEN 3 THEN 'attentions.1' ELSE 'output.0' END AS path, CASE WHEN text IS NULL OR doc_id % 19 = 0 THEN 0 ELSE 2 + doc_id % 3 END AS rank, doc_id % 7 <> 0 AS floating, n_chars % 3 AS a, n_chars % 4 AS b, doc_id % 23 <> 0 AS has_lengths, doc_id % 2 = 0 AS flattened FROM documents),
r AS (SELECT *, CASE WHEN rank = 2 THEN a * 3 ELSE a END AS first, CASE WHEN rank = 3 AND a = 2 AND b = 3 THEN 'bsh' WHEN rank = 2 AND flattened AND a * 3 = 6 THEN 'flattened_bs' WHEN rank = 4 AND a = 2 AND b IN (1, 3) AND (path LIKE '%attentions%' OR module_type LIKE '%Attention%' OR module LIKE '%self_attn%') THEN 'bhqk' END AS fits FROM d)
SELECT doc_id, CASE WHEN reason IS NULL THEN fits END AS layout, reason FROM (SELECT *, CASE WHEN phase <> 'model_forward' THEN 'not_model_forward' WHEN path LIKE '%attention_mask%' THEN 'attention_mask' WHEN module_type = 'RotaryEmbedding' THEN 'shared_or_cached' WHEN NOT has_lengths THEN 'missing_sample_or_valid_length' WHEN rank = 0 THEN 'opaque_or_deep_container'
  WHEN NOT floating THEN 'nonfloating' WHEN path IN ('past_key_values.0', 'output.cos') THEN 'shared_or_cached' WHEN fits IS NULL AND rank = 2 AND flattened THEN 'flattened_size_mismatch' WHEN fits IS NULL THEN 'unsupported_layout' END AS reason FROM r)""")
def tensor_layouts(read):
    """Which layout a tensor has or the first rule that leaves it out."""
    i, a, b = F.col("doc_id"), (F.col("n_chars") % 3).cast("long"), (F.col("n_chars") % 4).cast("long")
    one = F.lit(1).cast("long")
    rank = F.when(F.col("text").isNotNull() & (i % 19 != 0), 2 + i % 3)
    shape = F.when(rank == 2, F.array(a * 3, one)).when(rank == 3, F.array(a, b, one)).when(rank == 4, F.array(a, one, b, one))
    d = read("documents").select(
        "doc_id", F.when(i % 17 == 0, "decode").otherwise("model_forward").alias("phase"), F.concat(F.lit("layers."), (i % 5).cast("string"), F.when(i % 4 == 0, ".self_attn").otherwise(".mlp")).alias("module"),
        F.when(i % 6 == 0, "RotaryEmbedding").when(i % 6 == 1, "SdpaAttention").otherwise("Block").alias("module_type"), F.when(i % 10 == 0, "kwargs.attention_mask").when(i % 10 == 1, "past_key_values.0").when(i % 10 == 2, "output.cos").when(i % 10 == 3, "attentions.1").otherwise("output.0").alias("path"),
        shape.alias("shape"), (i % 7 != 0).alias("floating"), F.lit(2).alias("batch"), F.lit(3).alias("width"), (i % 23 != 0).alias("has_lengths"), (i % 2 == 0).alias("flattened"),
    )
    return checks.tensor_layout(d).select("doc_id", "layout", "reason")


@query(f"""
WITH p AS ({_PARTS}), g AS (SELECT run, doc, {_GOLD} AS gold FROM p), e AS (SELECT doc, count(DISTINCT gold) AS nv, count(DISTINCT split_part(gold, ':', 1)) AS nk, count(*) FILTER (gold LIKE 'invalid:%') AS bad, count(DISTINCT run) FILTER (gold IS NOT NULL) AS told FROM g GROUP BY doc HAVING count(DISTINCT run) = 3)
SELECT 'A' AS "group", 'model' AS model, 0::bigint AS num_fewshot, 'series ' || run AS series, lower(run) AS language, run AS run_path, 'parts' AS task_name, g.doc AS doc_id, 'position' AS pairing_source, NULL::varchar AS pairing_field, NULL::varchar AS mapping_sha256, g.doc::varchar AS canonical_doc_id,
CASE WHEN e.doc IS NULL THEN 'excluded' ELSE 'paired' END AS pairing_status, CASE WHEN e.doc IS NULL THEN 'not_in_every_language' END AS exclusion_reason, split_part(gold, ':', 1) AS gold_evidence, split_part(gold, ':', 2) AS gold_value,
CASE WHEN e.doc IS NOT NULL THEN CASE WHEN told < 3 THEN 'no_gold_evidence' WHEN bad > 0 OR nk > 1 THEN 'unverifiable' WHEN nv > 1 THEN 'disagree' ELSE 'agree' END END AS answer_status FROM g LEFT JOIN e USING (doc)""")
def pairing_table(read):
    """A row per document and run: how it pairs, why not, and what its answer key tells."""
    rows = _gold(read)
    paired, kind = attach.attach_pairing(rows.select("run", "doc"), pair_on="position")
    paired = paired.withColumn("task_name", F.lit("parts")).withColumn("doc_id", F.col("doc"))
    series = rows.select("run").distinct().select("run", F.concat(F.lit("series "), "run").alias("series"), F.lit("model").alias("model"), F.lit(0).alias("num_fewshot"), F.lower("run").alias("language"))
    return attach.pairing_table(paired, rows.select("run", "doc", "gold"), series, kind)


@query(f"""
WITH p AS ({_PARTS}), e AS (SELECT doc FROM p GROUP BY doc HAVING count(DISTINCT run) = 3) SELECT 'A' AS "group", run AS series, run AS run_path, count(*) AS documents, count(e.doc) AS paired, coalesce('not_in_every_language=' || nullif(count(*) - count(e.doc), 0), '') AS excluded FROM p LEFT JOIN e USING (doc) GROUP BY run""")
def pairing_provenance(read):
    """Per run, how many documents pair and what excludes the others."""
    rows = _gold(read)
    paired, kind = attach.attach_pairing(rows.select("run", "doc"), pair_on="position")
    series = rows.select("run").distinct().select("run", F.col("run").alias("series"), F.lit("model").alias("model"), F.lit(0).alias("num_fewshot"), F.lit(None).cast("string").alias("language"))
    table = attach.pairing_table(paired.withColumn("task_name", F.lit("parts")).withColumn("doc_id", F.col("doc")), rows.select("run", "doc", "gold"), series, kind)
    out = attach.coverage(table)
    return out.withColumn("excluded", F.array_join(F.transform(F.map_entries("excluded"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("""SELECT event_type, CASE WHEN value > 95 THEN 'nan' WHEN value > 90 THEN 'posinf' WHEN value > 85 THEN 'neginf' ELSE 'finite' END AS state, count(*) AS n, count(*) AS n_read FROM events GROUP BY 1, 2""")
def nonfinite_round_trip(read):
    """Values by their state, written as JSON numbers and read back to the same."""
    v = F.col("value")
    x = F.when(v > 95, float("nan")).when(v > 90, float("inf")).when(v > 85, float("-inf")).when(v < 20, v * 1e-7).when(v < 40, v * 1e15).otherwise(v / 3)
    rows = read("events").select("event_type", x.alias("x")).withColumn("back", scalar.from_json_number(scalar.json_number(F.col("x"))))
    return rows.groupBy("event_type", scalar.weight_state(F.col("x")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("back"))).alias("n_read"))
