"""Registered queries that write a run directory and read it again, next to the SQL over the tables it was made of."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runlens.operators import checks, moments
from runlens.plans.catalogue import _LAYERS, _MOMENTS_SQL, _layers, _rounded, _shown, _value_sql, _with_values
from runlens.plans.registry import query
from runlens.sources import judges
from runlens.sources import runs as source
from runlens.sources.scratch import new_folder
from runlens.streaming import ingest


def _new_run(spark: SparkSession) -> str:
    """A new directory for a run."""
    return new_folder(spark, "run")


@query(f"""
WITH l AS (SELECT user_id, layer, value FROM ({_LAYERS})), d AS (SELECT user_id, bool_or(event_type = 'purchase') AS ok FROM events WHERE user_id % 4 > 0 GROUP BY 1)
SELECT layer, ok AS is_correct, count(*) AS n, round(sum(value::float::double), 3) AS total FROM l LEFT JOIN d USING (user_id) GROUP BY 1, 2""")
def written_tables(read):
    """Signals and documents written as declared tables and joined again, repeated keys refused."""
    rows = _layers(read).select(F.lit("t").alias("task_name"), F.col("user_id").alias("doc_id"), F.lit(0).alias("choice_idx"), F.lit(0).alias("step"), "layer", F.col("value").alias("lens_prob"))
    run = _new_run(rows.sparkSession)
    source.append(rows, run, "signals")
    held = read("events").where("user_id % 4 > 0").groupBy(F.col("user_id").alias("doc_id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("is_correct"))
    source.append(held.select(F.lit("t").alias("task_name"), "doc_id", F.lit(0).alias("choice_idx"), "is_correct"), run, "docs")
    out = source.load_signals(rows.sparkSession, run)
    return _rounded(out.groupBy("layer", "is_correct").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lens_prob").cast("double")).alias("total")), 3, "total")


@query(f"""
WITH l AS (SELECT DISTINCT user_id FROM ({_LAYERS})), d AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 > 0) SELECT user_id AS doc_id FROM l WHERE user_id NOT IN (SELECT user_id FROM d)""")
def recorded_keys(read):
    """Documents that one written table has and another lacks."""
    rows = _layers(read).select(F.lit("t").alias("task_name"), F.col("user_id").alias("doc_id"), F.lit(0).alias("choice_idx"), F.lit(0).alias("step"), "layer")
    spark, run = rows.sparkSession, _new_run(rows.sparkSession)
    source.append(rows, run, "signals")
    source.append(rows.where("doc_id % 4 > 0").select("task_name", "doc_id", "choice_idx").distinct(), run, "docs")
    a, b = (source.existing_keys(spark, run, t) for t in ("signals", "docs"))
    return checks.key_differences(a, b, ["task_name", "doc_id", "choice_idx"]).where("side = 'a'").select("doc_id")


@query("""SELECT 't' || (event_id % 3) AS task_name, event_id AS doc_id, (event_id % 2)::varchar AS value FROM events WHERE event_type IN ('view', 'click')""")
def sample_files(read):
    """One metric of one filter from samples written as JSON lines."""
    i = F.col("event_id")
    rows = read("events").select(F.concat(F.lit("t"), (i % 3).cast("string")).alias("task_name"), i.alias("doc_id"), F.when(F.col("event_type") == "click", "none").when(F.col("event_type") == "view", None).otherwise("strict").alias("filter"), F.array(F.lit("acc")).alias("metrics"), (i % 2).alias("acc"))
    run = _new_run(rows.sparkSession)
    source.write_samples(rows, run)
    return source.read_sample_metrics(rows.sparkSession, run, "acc")


@query("""SELECT o_orderstatus AS unit, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def committed_units(read):
    """Units of a user's table: one that is written again, and one that was never committed, change nothing."""
    o = read("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    spark, run = o.sparkSession, _new_run(o.sparkSession)
    for unit in ("F", "O", "P", "F"):
        source.append_custom(o.where(F.col("o_orderstatus") == unit).drop("o_orderstatus"), run, "prices", unit, {"version": 1, "columns": ["o_totalprice"]})
    o.drop("o_orderstatus").write.parquet(f"{run}/custom/prices/rows/attempt=u{uuid.uuid4().hex}")
    out = source.read_custom(spark, run, "prices")
    return _rounded(out.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2, "total")


@query("""SELECT vec_id AS doc_id, round(list_sum(list_transform(embedding, lambda x: x::double)) * CASE WHEN label = 0 THEN 2 ELSE 1 END, 4) AS total, 64::bigint AS n FROM embeddings""")
def saved_tensors(read):
    """Tensors saved, some of them again, and read after a check of their hashes and shapes."""
    e = read("embeddings").select(F.lit("t").alias("task_name"), F.col("vec_id").alias("doc_id"), F.lit(0).alias("choice_idx"), F.lit("hidden").alias("key"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").alias("values"), "label")
    spark, run = e.sparkSession, _new_run(e.sparkSession)
    source.save_tensors(e.drop("label"), run, "hidden")
    source.save_tensors(e.where("label = 0").withColumn("values", F.transform("values", lambda x: (x * 2).cast("float"))).drop("label"), run, "hidden")
    out = source.read_tensors(spark, run, "hidden")
    return _rounded(out.select("doc_id", F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"), F.size("values").alias("n")), 4, "total")


@query("""SELECT CASE WHEN vec_id % 3 = 0 THEN 'orphan' ELSE 'missing' END AS kind, count(*) AS n FROM embeddings WHERE vec_id % 3 < 2 GROUP BY 1""")
def tensor_audit(read):
    """Artefacts that no index names and indexed tensors that are gone."""
    i = F.col("vec_id")
    e = read("embeddings").select(F.lit("t").alias("task_name"), i.alias("doc_id"), F.lit(0).alias("choice_idx"), F.lit("h").alias("key"), F.array(F.lit(64)).alias("shape"), F.col("embedding").alias("values"))
    spark, run = e.sparkSession, _new_run(e.sparkSession)
    source.save_tensors(e, run, "h")
    root = f"{run}/tensors/h"
    held, index = spark.read.parquet(f"{root}/artefacts"), spark.read.parquet(f"{root}/index")
    held.where("doc_id % 3 <> 1").write.partitionBy("attempt").parquet(f"{run}/b/tensors/h/artefacts")
    index.where("doc_id % 3 <> 0").write.parquet(f"{run}/b/tensors/h/index")
    return source.audit_tensors(spark, f"{run}/b", "h").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH v AS (SELECT *, {_value_sql()} AS value FROM lineitem) SELECT l_returnflag, {_MOMENTS_SQL} FROM v GROUP BY 1")
def exported_statistics(read):
    """Moments exported as a session's table and read from the latest session of the pass."""
    out = moments.moments(_with_values(read), ["l_returnflag"], "value")
    spark, run = out.sparkSession, _new_run(out.sparkSession)
    source.export_tables({"samples": out.withColumn("mean", F.lit(0.0))}, f"{run}/debug/module_stats/trace/20200101T000000-old")
    source.export_tables({"samples": out}, f"{run}/debug/module_stats/trace/20200102T000000-new")
    return _shown(source.read_statistics(spark, run, "samples", "trace"))


@query("""
WITH t AS (SELECT event_id AS i, user_id AS call, CASE event_type WHEN 'view' THEN 'input_numeric' ELSE event_type END AS event, value FROM events), n AS (SELECT call, arg_max('v' || i, i) AS numeric_args FROM t WHERE event = 'input_numeric' GROUP BY 1)
SELECT i, t.call, event, numeric_args FROM t LEFT JOIN n ON n.call = t.call WHERE event <> 'input_numeric'""")
def trace_files(read):
    """Events written as JSON lines and read with the last numeric record of their call."""
    e = read("events").select(F.col("event_id").alias("i"), F.col("user_id").alias("call"), F.when(F.col("event_type") == "view", "input_numeric").otherwise(F.col("event_type")).alias("event"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("args"))
    run = _new_run(e.sparkSession)
    e.write.json(f"{run}/trace")
    return source.read_trace(e.sparkSession, f"{run}/trace", "i long, call long, event string, args string").select("i", "call", "event", "numeric_args")


@query("""SELECT 'l' || s_nationkey AS language, 't' AS task_name, s_suppkey AS doc_id, 'c' || (s_suppkey // 3) AS canonical_doc_id, 1 + s_suppkey % 3 AS n_choice_ids FROM supplier""")
def mapping_files(read):
    """A pairing mapping written as CSV and read with its rules, its choice ids split."""
    i = F.col("s_suppkey")
    ids = F.array_join(F.transform(F.sequence(F.lit(0), (i % 3).cast("int")), lambda k: F.concat(F.lit("x"), k.cast("string"))), "|")
    m = read("supplier").select(F.concat(F.lit("l"), F.col("s_nationkey").cast("string")).alias("language"), F.lit("t").alias("task_name"), i.alias("doc_id"), F.concat(F.lit("c"), F.floor(i / 3).cast("string")).alias("canonical_doc_id"), ids.alias("canonical_choice_ids"), F.lit("").alias("canonical_answer_id"))
    path = f"{_new_run(m.sparkSession)}/m.csv"
    m.write.option("header", True).csv(path)
    out = source.load_mapping(m.sparkSession, path)
    return out.select("language", "task_name", "doc_id", "canonical_doc_id", F.size("canonical_choice_ids").alias("n_choice_ids"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 20 = 19 THEN doc_id - 1 ELSE doc_id END AS id, doc_id % 10 AS k FROM documents), t AS (SELECT id, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT CASE WHEN k = 1 THEN 'not a JSON object' WHEN k = 2 THEN 'no id' WHEN n > 1 THEN 'repeated id' WHEN k = 3 THEN 'no question' WHEN k IN (4, 5) THEN 'choices are not two or more texts' WHEN k IN (6, 7) THEN 'the label is no choice' END AS problem FROM d JOIN t USING (id))
SELECT problem, count(*) AS n FROM r GROUP BY 1""")
def split_validation(read):
    """The documents of a split written as JSON lines, by the first rule that each breaks."""
    i = F.col("doc_id")
    k = i % 10
    key = F.when(i % 20 == 19, i - 1).otherwise(i).cast("string")
    text = F.to_json(F.struct(F.col("text").alias("q")))
    choices = F.when(k == 4, '["a"]').when(k == 5, '["a", 5]').otherwise('["a", "b"]')
    label = F.when(k == 6, "2").when(k == 7, "true").otherwise("1")
    body = F.concat(F.lit('{"id": '), F.when(k == 2, "null").when(i % 3 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(key), F.when(k == 3, ', "question": " "').otherwise(', "question": "what"'), F.lit(', "choices": '), choices, F.lit(', "label": '), label, F.lit(', "more": '), text, F.lit("}"))
    lines = read("documents").select(F.when(k == 1, F.concat(F.lit("["), key, F.lit("]"))).otherwise(body).alias("value"))
    run = _new_run(lines.sparkSession)
    lines.repartition(3).write.text(f"{run}/split")
    return source.split_problems(lines.sparkSession, [f"{run}/split"], "multiple_choice", "id").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id * 1000 + turn AS line FROM conversations WHERE turn > 0""")
def line_numbers(read):
    """Lines keep their real numbers where blank ones are left out and a file is read by many tasks."""
    c = read("conversations").select(F.when(F.col("turn") > 0, (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).otherwise("  ").alias("value"))
    spark, run = c.sparkSession, _new_run(c.sparkSession)
    c.coalesce(1).write.text(f"{run}/lines")
    numbered = source.numbered_lines(spark, f"{run}/lines")
    assert numbered.groupBy("file", "line").count().where("count > 1").count() == 0
    return numbered.select(F.col("value").cast("long").alias("line"))


@query("""
WITH w AS (SELECT conv_id * 1000 + turn AS i, turn FROM conversations) SELECT i::varchar AS identity, CASE WHEN turn % 3 = 0 THEN 'success' WHEN turn % 3 = 1 THEN 'failed' ELSE 'pending' END AS status FROM w""")
def judge_journal(read):
    """Answers by their last status; a success stays, whatever follows."""
    w = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("identity"), (F.col("turn") % 3).alias("k"))
    w = w.withColumn("scores", F.create_map(F.lit("s"), F.lit(1.0)))
    path = f"{_new_run(w.sparkSession)}/journal"
    judges.add_to_journal(w.withColumn("status", F.lit("pending")), path)
    judges.add_to_journal(w.where("k < 2").withColumn("status", F.when(F.col("k") == 0, "success").otherwise("failed")), path)
    judges.add_to_journal(w.where("k = 0").withColumn("status", F.lit("failed")), path)
    return judges.journal(w.sparkSession, path).select("identity", "status")


@query("""SELECT 'clicks' AS "table", event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'large', event_id FROM events WHERE value > 50""")
def streamed_tables(read):
    """A stream of events written to two tables batch by batch, each row once though the stream is run twice."""
    e = read("events")
    spark, run = e.sparkSession, _new_run(e.sparkSession)
    e.repartition(3).write.parquet(f"{run}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    tables = {"clicks": lambda b: b.where("event_type = 'click'").select("event_id"), "large": lambda b: b.where("value > 50").select("event_id")}
    for _ in range(2):
        ingest.ingest(stream, tables, f"{run}/out", f"{run}/checkpoint")
    parts = [ingest.read_ingested(spark, f"{run}/out", t).select(F.lit(t).alias("table"), "event_id") for t in tables]
    return parts[0].unionByName(parts[1])


@query("""SELECT user_id AS module, count(*) FILTER (event_type = 'click') AS calls, count(*) FILTER (event_type = 'view') AS observations, count(*) FILTER (event_type = 'error') AS exclusions FROM events GROUP BY 1""")
def streamed_counters(read):
    """Counters of every module as a stream keeps them in its state."""
    e = read("events").select(F.col("user_id").alias("module"), F.when(F.col("event_type") == "click", "enter").when(F.col("event_type") == "view", "observe").when(F.col("event_type") == "error", "exclude").otherwise("other").alias("event"))
    spark, run = e.sparkSession, _new_run(e.sparkSession)
    e.repartition(3).write.parquet(f"{run}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")

    def put(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{run}/out/b={batch_id}")

    ingest.module_counters(stream, "module", "event").writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{run}/c").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{run}/out").drop("b")
    return rows.groupBy("module").agg(F.max_by(F.struct("calls", "observations", "exclusions"), "batch_id").alias("s")).select("module", "s.*")


