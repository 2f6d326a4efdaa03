"""Registered queries with users' metrics and nested values, next to the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import metrics, nested
from runlens.plans.catalogue import _LINE_ORDER, _LO, _rounded
from runlens.plans.registry import query


@query(f"""
WITH r AS (SELECT l_orderkey, list('the answer is ' || (l_partkey % 5) || '.' ORDER BY {_LO}) AS s, min(l_returnflag) AS flag, max(l_suppkey % 5) AS target FROM lineitem GROUP BY 1),
f AS (SELECT *, list_transform(s, lambda x: regexp_extract(x, 'is ([0-9])', 1)) AS x FROM r), c AS (SELECT *, list_transform(list_distinct(x), lambda v: {{'n': len(list_filter(x, lambda w: w = v)), 'at': -list_position(x, v), 'v': v}}) AS c FROM f),
v AS (SELECT *, list_sort(c)[-1].v::INT AS vote FROM c), s AS (SELECT *, (vote = target)::INT::DOUBLE AS exact, abs(vote - target)::DOUBLE AS apart FROM v)
SELECT flag, count(*) AS n, round(avg(exact), 6) AS exact, round(sqrt(avg(apart * apart)), 6) AS apart FROM s GROUP BY flag""")
def user_metrics(read):
    """Answers drawn from responses by a pattern, put to the vote, scored by two users' functions and aggregated by a built-in and a user's own."""
    rows = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE_ORDER))).alias("s"), F.min("l_returnflag").alias("flag"), F.max(F.col("l_suppkey") % 5).alias("target"))
    responses = F.transform("s", lambda x: F.concat(F.lit("the answer is "), (x["l_partkey"] % 5).cast("string"), F.lit(".")))
    chain = [{"function": "regex", "pattern": "is ([0-9])"}, {"function": "majority_vote"}, {"function": "take_first"}]
    rows = rows.select("flag", F.col("target").cast("string").alias("target"), F.get(metrics.filtered(responses, chain), F.lit(0)).alias("response"))
    chosen = [metrics.Metric("exact", lambda r, t: (r == t).astype(float)), metrics.Metric("apart", lambda r, t: (r.astype(float) - t.astype(float)).abs(), lambda v: (v**2).mean() ** 0.5, False)]
    out = metrics.aggregated(metrics.scored(rows, chosen, "response", "target"), ["flag"], chosen)
    return _rounded(out.join(rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n")), "flag"), 6, "exact", "apart")


@query("""
WITH e AS (SELECT event_id, event_type, value FROM events)
SELECT event_id, '$' AS path, 0::BIGINT AS level, 'dict' AS kind, 3::BIGINT AS length, NULL::VARCHAR AS shown FROM e UNION ALL SELECT event_id, '$.inner', 1, 'dict', 3, NULL FROM e UNION ALL SELECT event_id, '$.list', 1, 'list', 10, NULL FROM e
UNION ALL SELECT event_id, '$.long', 1, 'str', NULL, substr(repeat(event_type, 20), 1, 60) FROM e UNION ALL SELECT event_id, '$.inner.deep', 2, 'dict', NULL, NULL FROM e UNION ALL SELECT event_id, '$.inner.name', 2, 'str', NULL, event_type FROM e
UNION ALL SELECT event_id, '$.inner.yes', 2, 'bool', NULL, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM e UNION ALL SELECT event_id, '$.list[' || i || ']', 2, 'int', NULL, (event_id + i)::VARCHAR FROM e, unnest(range(8)) u(i)""")
def nested_values(read):
    """Nested values walked two levels down, eight parts wide, with the paths of their parts."""
    i = F.col("event_id")
    whole = F.struct(
        F.struct(F.struct(F.struct(i.alias("deepest")).alias("deeper")).alias("deep"), F.col("event_type").alias("name"), (i % 2 == 0).alias("yes")).alias("inner"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: i + k).alias("list"), F.repeat("event_type", F.lit(20)).alias("long"),
    )
    return nested.described(read("events").select("event_id", F.parse_json(F.to_json(whole)).alias("v")), ["event_id"], "v")
