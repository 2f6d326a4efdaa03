"""Registered queries over streams with state, and over the brackets of a trace, next to the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import requests, trace
from runlens.plans.catalogue import _TRACE, _rounded, _trace
from runlens.plans.directories import _new_run
from runlens.plans.registry import query
from runlens.streaming import ingest, reducers, traces


#: Whether a batch without data follows once the watermark has moved.
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _streamed(spark: SparkSession, parts: list[DataFrame], transform, again: bool = False, empty_batches: bool = True) -> DataFrame:
    """What a stream leaves in its sink whose input arrives in ``parts``: it goes on from its checkpoint after each, and ``again`` once more in the end.

    Without ``empty_batches``, what the watermark of a part sets free waits for
    the next part; only the last one is always followed by a batch without data.
    """
    run, before = _new_run(spark), spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reducers.PROVIDER)
    try:
        for n, part in enumerate([*parts, *[None] * again]):
            if part is not None:
                part.write.mode("append").parquet(f"{run}/in")
            spark.conf.set(_EMPTY_BATCHES, before if empty_batches else str(n >= len(parts) - 1).lower())
            stream = spark.readStream.schema(parts[0].schema).parquet(f"{run}/in")
            transform(stream).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
    return spark.read.parquet(f"{run}/out")


@query("""
WITH a AS (SELECT vec_id // 8 AS doc_id, vec_id // 4 % 2 AS forward, vec_id % 4 AS i, embedding::double[] AS v FROM embeddings),
h AS (SELECT *, unnest(range(8)) AS h FROM a), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, forward ORDER BY i DESC) AS n FROM a),
d AS (SELECT a.doc_id, list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) ** 2)) ** 0.5 AS moved FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.forward = a.forward + 1 AND a.n = 1 AND b.n = 1)
SELECT doc_id, 'logit_lens' AS reducer, forward, i, len(list_filter(v, lambda x: x > v[(doc_id % 64) + 1])) AS j, list_position(v, list_max(v)) - 1 AS token_id, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS value, NULL::double AS total FROM a
UNION ALL SELECT a.doc_id, 'layer_similarity', a.forward, a.i, b.i, NULL, round(list_cosine_similarity(a.v, b.v), 6), NULL FROM a JOIN a b ON a.doc_id = b.doc_id AND a.forward = b.forward AND a.i <= b.i
UNION ALL SELECT doc_id, 'value_norm', forward, i, h, NULL, round(sqrt(list_dot_product(v[h // 2 * 16 + 1:h // 2 * 16 + 16], v[h // 2 * 16 + 1:h // 2 * 16 + 16])), 6), NULL FROM h
UNION ALL SELECT doc_id, 'attention_weights', forward, i, h, NULL, NULL, round(list_sum(v[h * 16 + 1:h * 16 + 16]), 6) FROM h WHERE forward = 0 AND h < 4
UNION ALL SELECT doc_id, 'hidden_states', forward, i, NULL, NULL, NULL, round(list_sum(v), 6) FROM a WHERE i IN (0, 3)
UNION ALL SELECT doc_id, 'last_layer_drift', NULL, NULL, NULL, NULL, round(avg(moved), 6), NULL FROM d GROUP BY doc_id""")
def streamed_reductions(read):
    """Six reductions of a stream of layers that come in any order over three batches, each row once though the stream is run twice."""
    e = read("embeddings")
    base = e.select((F.col("vec_id") / 8).cast("long").alias("doc_id"), ((F.col("vec_id") / 4).cast("long") % 2).cast("int").alias("forward"), (F.col("vec_id") % 4).cast("int").alias("index"), F.col("embedding").cast("array<double>").alias("array"))
    arrays = base.withColumn("source", F.explode(F.array(*map(F.lit, ("residual", "logits", "value", "attention")))))
    sizes = arrays.groupBy("doc_id", "forward", "source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    headers = sizes.groupBy("doc_id", "forward").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n_arrays")).withColumn("target", (F.col("doc_id") % 64).cast("int"))
    ends = base.groupBy("doc_id").agg(F.countDistinct("forward").cast("int").alias("n_forwards"))
    rows = reducers.layer_rows(arrays, headers, ends)
    nth = F.pmod(F.xxhash64("doc_id", "kind", "forward", "source", "index"), F.lit(3))
    chosen = [reducers.LogitLens(), reducers.Similarity(), reducers.ValueNorm(kv_heads=4, heads=8), reducers.AttentionWeights(heads=4), reducers.HiddenStates(layers=(0, 3)), reducers.LastLayerDrift()]
    out = _streamed(e.sparkSession, [rows.where(nth == k) for k in range(3)], lambda s: reducers.reduced(s, chosen), again=True)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return _rounded(out.withColumn("total", total).drop("vector"), 6, "value", "total")


@query(f"""
WITH RECURSIVE t AS ({_TRACE}), g AS (SELECT *, count(*) FILTER (event = 'signup') OVER (PARTITION BY user_id ORDER BY i) AS seg FROM t),
m AS (SELECT user_id, seg, i, event, row_number() OVER (PARTITION BY user_id, seg ORDER BY i) AS k FROM g WHERE event IN ('enter', 'exit')),
s AS (SELECT user_id, seg, 0::bigint AS k, []::bigint[] AS stack, NULL::bigint AS enter, NULL::bigint AS exit, NULL::varchar AS status, 0::bigint AS depth FROM (SELECT DISTINCT user_id, seg FROM m)
UNION ALL SELECT m.user_id, m.seg, m.k, CASE WHEN m.event = 'enter' THEN list_append(stack, m.i) ELSE stack[:len(stack) - 1] END, CASE WHEN m.event = 'exit' AND len(stack) > 0 THEN stack[len(stack)] END, CASE WHEN m.event = 'exit' THEN m.i END,
  CASE WHEN m.event = 'exit' THEN CASE WHEN len(stack) > 0 THEN 'closed' ELSE 'orphan' END END, len(stack) FROM s JOIN m ON m.user_id = s.user_id AND m.seg = s.seg AND m.k = s.k + 1),
z AS (SELECT user_id, seg, arg_max(stack, k) AS stack FROM s GROUP BY ALL), e AS (SELECT user_id, max(seg) AS last FROM g GROUP BY user_id)
SELECT user_id, enter, exit, depth, status, NULL::boolean AS deepest, NULL::varchar AS reason FROM s WHERE status IS NOT NULL
UNION ALL SELECT z.user_id, stack[j], NULL, j, 'unwound', j = len(stack), CASE WHEN seg < last THEN 'a new batch was declared' ELSE 'the session ended' END FROM z JOIN e ON e.user_id = z.user_id, unnest(range(1, len(stack) + 1)) u(j)""")
def streamed_calls(read):
    """Calls of a stream in three batches, each out of order: frames still open at a restart or at the session's end are unwound."""
    t = _trace(read).select("user_id", F.col("i").cast("long").alias("i"), "event", F.col("ts").cast("timestamp").alias("ts"))
    ends = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    third = F.least(F.lit(2), F.floor(3 * (F.unix_millis("ts") - F.unix_millis(F.lit(ends.a))) / F.greatest(F.lit(1), F.unix_millis(F.lit(ends.b)) - F.unix_millis(F.lit(ends.a)))))
    parts = [t.where(third == k).repartition(F.xxhash64("user_id", "i")) for k in range(3)]
    # The clock of a stream goes on with other traffic: here one event of another session.
    beat = t.select(F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("i"), F.lit("beat").alias("event"), (F.lit(ends.b) + F.expr("INTERVAL 1001 DAYS")).alias("ts")).limit(1)
    return _streamed(t.sparkSession, [*parts, beat], lambda s: traces.open_calls(s, "user_id", "i", "event", "ts", "1 minute", "1000 days", "signup"), empty_batches=False)


@query(f"""
WITH RECURSIVE t AS (SELECT *, event_id % 3 AS module FROM ({_TRACE})), m AS (SELECT user_id, module, i, event, value, row_number() OVER (PARTITION BY user_id, module ORDER BY i) AS k FROM t WHERE event IN ('enter', 'exit')),
s AS (SELECT user_id, module, 0::bigint AS k, []::STRUCT(call BIGINT, i BIGINT, v DOUBLE)[] AS stack, 0::bigint AS calls, NULL::STRUCT(call BIGINT, i BIGINT, v DOUBLE) AS popped, NULL::bigint AS exit, NULL::double AS output, NULL::bigint AS level FROM (SELECT DISTINCT user_id, module FROM m)
UNION ALL SELECT m.user_id, m.module, m.k, CASE WHEN m.event = 'enter' THEN list_append(stack, {{'call': calls, 'i': m.i, 'v': m.value}}) ELSE stack[:len(stack) - 1] END, calls + (m.event = 'enter')::int, CASE WHEN m.event = 'exit' AND len(stack) > 0 THEN stack[len(stack)] END,
  CASE WHEN m.event = 'exit' THEN m.i END, CASE WHEN m.event = 'exit' THEN m.value END, len(stack) FROM s JOIN m ON m.user_id = s.user_id AND m.module = s.module AND m.k = s.k + 1),
z AS (SELECT user_id, module, arg_max(stack, k) AS stack FROM s GROUP BY ALL)
SELECT user_id, module, popped.call AS call, CASE WHEN popped IS NOT NULL THEN level END AS level, popped.i AS enter, exit, round(popped.v, 6) AS input, round(output, 6) AS output, CASE WHEN popped IS NULL THEN 'orphan' ELSE 'paired' END AS status FROM s WHERE exit IS NOT NULL
UNION ALL SELECT user_id, module, stack[j].call, j, stack[j].i, NULL, round(stack[j].v, 6), NULL, 'pending' FROM z, unnest(range(1, len(stack) + 1)) u(j)""")
def hook_call_pairs(read):
    """Inputs and outputs of modules that call themselves, each result with the call that waits innermost."""
    rows = _trace(read).withColumn("module", F.col("event_id") % 3)
    return _rounded(trace.hook_pairs(rows, ["user_id", "module"], "i", "event", "value", "value"), 6, "input", "output")


@query(f"""
WITH RECURSIVE t AS ({_TRACE}), s AS (SELECT user_id, 0::bigint AS i, NULL::bigint AS event_id, []::varchar[] AS phases, NULL::bigint AS samples, []::bigint[] AS saved FROM (SELECT DISTINCT user_id FROM t)
UNION ALL SELECT t.user_id, t.i, t.event_id, CASE event WHEN 'enter' THEN list_append(phases, 'p' || (t.event_id % 5)) WHEN 'exit' THEN phases[:len(phases) - 1] ELSE phases END,
  CASE event WHEN 'signup' THEN t.event_id WHEN 'error' THEN NULL WHEN 'view' THEN CASE WHEN len(saved) > 0 THEN saved[len(saved)] ELSE samples END ELSE samples END,
  CASE event WHEN 'error' THEN list_append(saved, samples) WHEN 'view' THEN saved[:len(saved) - 1] ELSE saved END FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1)
SELECT user_id, i, CASE WHEN len(phases) > 0 THEN phases[len(phases)] END AS phase, samples FROM s WHERE i > 0""")
def phases_and_samples(read):
    """The innermost phase of every event, and the samples it belongs to outside and inside probes that are not attributed."""
    rows = _trace(read)
    kind = lambda name: F.col("event") == name
    rows = trace.innermost(rows, ["user_id"], "i", kind("enter"), kind("exit"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")), "phase")
    return trace.sticky_samples(rows, ["user_id"], "i", kind("signup"), F.col("event_id"), kind("error"), kind("view"), "samples").select("user_id", "i", "phase", "samples")


_REQUESTS = """o AS (SELECT l_orderkey AS doc_id, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate)::INT[] AS t FROM lineitem GROUP BY 1),
r AS (SELECT doc_id * 8 + c AS i, doc_id, c, t[1:greatest(1, len(t) - 1 - c % 3)] AS ctx, list_append(t[greatest(1, len(t) - 1 - c % 3) + 1:], c::INT) AS cont FROM o, unnest(range(4)) u(c)),
p AS (SELECT *, list_concat(ctx, cont) AS tokens, list_concat(ctx, cont[:len(cont) - 1]) AS prefix FROM r),
f AS (SELECT prefix, arg_min(tokens, i) AS tokens, min(i) AS i FROM p GROUP BY prefix), n AS (SELECT prefix, len(tokens) AS row_tokens, row_number() OVER (ORDER BY -len(tokens), tokens, i) - 1 AS row FROM f)"""


@query(f"""
WITH {_REQUESTS}, q AS (SELECT p.*, row, least(row_tokens - 1, 5) AS input_length, row_tokens - 1 AS whole FROM p JOIN n ON n.prefix = p.prefix)
SELECT i AS request, doc_id, c AS choice_idx, row, step, cont[step + 1]::BIGINT AS target, input_length, whole - input_length AS input_offset, input_length - len(cont) + step AS position FROM q, unnest(range(len(cont))) u(step)""")
def request_positions(read):
    """Requests whose continuations begin at several places of one text: longest first, one forward for those that share it, and what each reads there."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    texts = read("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: (s["l_partkey"] % 7).cast("int")).alias("t"))
    c = F.col("choice_idx")
    cut = F.greatest(F.lit(1), F.size("t") - 1 - c % 3)
    rows = texts.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("choice_idx")).select((F.col("doc_id") * 8 + c).alias("request"), "doc_id", "choice_idx", F.slice("t", 1, cut).alias("ctx"), F.array_append(F.slice("t", cut + 1, F.size("t")), c).alias("cont"))
    out = requests.scored_positions(requests.batched(rows, "request", "ctx", "cont"), "request", ["doc_id", "choice_idx"], "ctx", "cont", 5)
    return out.withColumn("target", F.col("target").cast("long"))


@query("""
WITH d AS (SELECT DISTINCT user_id, least(2, event_id * 3 // (SELECT max(event_id) + 1 FROM events)) AS batch FROM events), n AS (SELECT *, row_number() OVER (ORDER BY batch, user_id) - 1 AS nth FROM d),
e AS (SELECT *, least(2, event_id * 3 // (SELECT max(event_id) + 1 FROM events)) AS batch FROM events)
SELECT 'clicks' AS "table", event_id, nth // 20 AS shard FROM e JOIN n USING (user_id, batch) WHERE event_type = 'click' UNION ALL SELECT 'large', event_id, nth // 20 FROM e JOIN n USING (user_id, batch) WHERE value > 50""")
def rolled_tables(read):
    """Two tables of a stream in three batches, rolled every twenty documents at one boundary."""
    e = read("events")
    spark, out = e.sparkSession, _new_run(e.sparkSession)
    last = e.agg(F.max("event_id")).first()[0]
    nth = F.least(F.lit(2), F.floor(F.col("event_id") * 3 / (last + 1)))
    tables = {"clicks": lambda b: b.where("event_type = 'click'").select("user_id", "event_id"), "large": lambda b: b.where("value > 50").select("user_id", "event_id")}
    for k in range(3):
        e.where(nth == k).write.mode("append").parquet(f"{out}/in")
        ingest.roll(spark.readStream.schema(e.schema).parquet(f"{out}/in"), tables, f"{out}/rolled", f"{out}/checkpoint", ["user_id"], 20)
    parts = [ingest.read_rolled(spark, f"{out}/rolled", t).select(F.lit(t).alias("table"), "event_id", "shard") for t in tables]
    return parts[0].unionByName(parts[1])
