"""Registered queries over runs that differ by language: pairing, gold answers, options, direction and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import runs
from runlens.plans import attach, reports
from runlens.plans.catalogue import _LAYERS, _layers, _rounded
from runlens.plans.registry import query

#: orders as documents of two languages: subtasks extend the declared task (mmlu_en, mmlu_ko) but for those of low
#: priority in Korean; Korean lacks every seventh document, the gold answer of every fifth, and has another of every eleventh.
_DOCUMENTS = """
SELECT 'en' AS run, CASE WHEN o_orderstatus = 'F' THEN 'mmlu_en_stem' ELSE 'mmlu_en_law' END AS task_name, o_orderkey AS doc_id, (o_orderkey % 3 = 0)::int AS gold FROM orders
UNION ALL SELECT 'ko', CASE WHEN o_orderpriority = '5-LOW' THEN 'other' WHEN o_orderstatus = 'F' THEN 'mmlu_ko_stem' ELSE 'mmlu_ko_law' END, o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE (o_orderkey % 3 = 0)::int END END FROM orders WHERE o_orderkey % 7 > 0"""
_PAIRED = f"""
d AS ({_DOCUMENTS}), k AS (SELECT *, CASE WHEN starts_with(task_name, 'mmlu_' || run) THEN substr(task_name, 8) ELSE task_name END || '#' || doc_id AS key FROM d),
e AS (SELECT key, count(DISTINCT gold) AS kinds, count(gold) AS told FROM k GROUP BY key HAVING count(DISTINCT run) = 2)"""


def _documents(read):
    """_DOCUMENTS as rows of three choices each."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    o = read("orders")
    suffix = F.when(status, "_stem").otherwise("_law")
    plain = (key % 3 == 0).cast("int")
    en = o.select(F.lit("en").alias("run"), F.concat(F.lit("mmlu_en"), suffix).alias("task_name"), key.alias("doc_id"), plain.alias("gold"))
    ko = o.where(key % 7 > 0).select(F.lit("ko").alias("run"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise(F.concat(F.lit("mmlu_ko"), suffix)).alias("task_name"), key.alias("doc_id"), F.when(key % 5 > 0, F.when(key % 11 == 0, 2).otherwise(plain)).alias("gold"))
    rows = en.unionByName(ko).select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("choice_idx"))
    return rows.select("run", "task_name", "doc_id", "choice_idx", F.coalesce(F.col("choice_idx") == F.col("gold"), F.lit(False)).alias("is_target_choice"), F.lit("t").alias("target"))


def _series(read):
    return read("region").sparkSession.createDataFrame([("en", "en", "m", 0, "en", "mmlu_en"), ("ko", "ko", "m", 0, "ko", "mmlu_ko")], "run string, series string, model string, num_fewshot int, language string, declared string")


@query(f"""
WITH {_PAIRED} SELECT run AS run_path, task_name, doc_id, key AS canonical_doc_id, CASE WHEN e.key IS NULL THEN 'not_in_every_language' END AS exclusion_reason, 'choice' AS gold_evidence, gold::varchar AS gold_value,
CASE WHEN e.key IS NOT NULL THEN CASE WHEN told < 2 THEN 'no_gold_evidence' WHEN kinds > 1 THEN 'disagree' ELSE 'agree' END END AS answer_status FROM k LEFT JOIN e USING (key)""".replace("'choice' AS", "CASE WHEN gold IS NOT NULL THEN 'choice' END AS"))
def pairing_by_position(read):
    """Documents of two languages by their place in what their tasks' names add to the declared ones, some without a gold answer."""
    table, _, _ = reports.pairing_report(_documents(read), _series(read))
    return table.select("run_path", "task_name", "doc_id", "canonical_doc_id", "exclusion_reason", "gold_evidence", "gold_value", "answer_status")


@query(f"""
WITH {_PAIRED}, c AS (SELECT count(*) FILTER (told = 2) AS shared, count(*) FILTER (told = 2 AND kinds = 1) AS agree, count(*) FILTER (told = 2 AND kinds > 1) AS disagree, count(*) AS paired FROM e)
SELECT shared, agree, disagree, 0::bigint AS unverifiable, round(agree / shared, 6) AS rate, agree / shared >= 0.9 AS aligned, CASE WHEN agree / shared >= 0.9 THEN paired - disagree ELSE 0 END AS comparable, CASE WHEN agree / shared >= 0.9 THEN paired - disagree ELSE paired END AS asserted FROM c""")
def alignment_by_position(read):
    """How far gold answers agree where both languages tell one, and how many documents compare by evidence and by assertion."""
    table, aligned, status = reports.pairing_report(_documents(read), _series(read))
    counts = [attach.comparable_keys(table, status, x).agg(F.count(F.lit(1)).alias(name)) for x, name in ((False, "comparable"), (True, "asserted"))]
    return _rounded(aligned.join(F.broadcast(counts[0]), F.lit(True)).join(F.broadcast(counts[1]), F.lit(True)), 6, "rate")


@query("""
WITH d AS (SELECT run, o_orderkey AS doc FROM orders, unnest(['en', 'ko']) u(run)) SELECT run, doc, 'q' || doc AS pair_key, 'paired' AS pairing_status FROM d""")
def pairing_equal_fields(read):
    """Two fields that identify every document with the same values: the first stands for both; a third differs by language."""
    run = F.explode(F.array(F.lit("en"), F.lit("ko")))
    docs = read("orders").select(F.col("o_orderkey").alias("doc"), run.alias("run"))
    key = F.concat(F.lit("q"), F.col("doc").cast("string"))
    fields = docs.select("run", "doc", F.explode(F.create_map(F.lit("id"), key, F.lit("uid"), key, F.lit("words"), F.concat("run", key))).alias("field", "value"))
    out, kind = attach.attach_pairing(docs, fields)
    assert kind == "field"
    return out


@query("""
WITH s AS (SELECT s_nationkey AS task, s_suppkey AS run, CASE WHEN s_suppkey % 9 > 0 THEN s_acctbal END AS score, s_nationkey % 2 = 0 AS higher FROM supplier)
SELECT task, run, score FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY CASE WHEN higher THEN score ELSE -score END DESC NULLS LAST, run) = 1""")
def reference_by_direction(read):
    """The reference run of each task whose protocol says whether more or less is better."""
    key, task = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    s = read("supplier").select(key.alias("run"), task.alias("task"), F.array(task).alias("tasks"), F.when(key % 9 > 0, F.col("s_acctbal")).alias("value"))
    protocols = s.select("run", "task", F.lit("loss").alias("primary_metric"), F.lit("none").alias("primary_filter"), (F.col("task").cast("int") % 2 == 0).alias("higher_is_better"))
    scores = runs.protocol_scores(s.where("value IS NOT NULL").select("run", "task", F.lit("loss,none").alias("metric"), "value"), protocols, s.select("run", "tasks")).join(s.select("run", F.col("task").cast("long").alias("task")), "run")
    return runs.reference_runs(scores, ["task"], "score", "run", F.col("higher")).select("task", "run", "score")


@query(f"""
WITH l AS (SELECT user_id % 7 AS run, user_id AS doc_id, event_id % 2 AS choice_idx, layer, event_type FROM ({_LAYERS})), t AS (SELECT * FROM l WHERE run % 2 = 1 OR choice_idx = 1),
f AS (SELECT run, doc_id, choice_idx, arg_max(event_type, layer) AS token FROM t GROUP BY ALL), o AS (SELECT t.run, t.doc_id, t.choice_idx, max(CASE WHEN event_type <> token THEN layer END) AS other FROM t JOIN f ON t.run = f.run AND t.doc_id = f.doc_id AND t.choice_idx = f.choice_idx GROUP BY ALL),
s AS (SELECT t.run, t.doc_id, t.choice_idx, min(layer) AS settled FROM t JOIN o ON t.run = o.run AND t.doc_id = o.doc_id AND t.choice_idx = o.choice_idx WHERE other IS NULL OR layer > other GROUP BY ALL)
SELECT run, 'a' AS task_name, doc_id, round(arg_max(CASE WHEN run = 0 THEN 0 ELSE settled / (32 + run) END, choice_idx), 9) AS settle_depth FROM s GROUP BY run, doc_id""")
def report_settle_depth(read):
    """Depths by each run's own blocks, over target rows in runs that mark a target."""
    run = F.col("user_id") % 7
    rows = _layers(read).select(run.alias("run"), F.lit("a").alias("task_name"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 2).alias("choice_idx"), F.lit(0).alias("step"), "layer", F.col("event_type").alias("lens_token_id"))
    docs = rows.select("run", "task_name", "doc_id", "choice_idx").distinct().withColumn("is_target_choice", (F.col("run") % 2 == 0) & (F.col("choice_idx") == 1))
    blocks = rows.select("run").distinct().withColumn("n_blocks", F.when(F.col("run") > 0, 32 + F.col("run")))
    return _rounded(reports.settled(rows, docs, blocks), 9, "settle_depth")
