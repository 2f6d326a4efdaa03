"""Line dedup: a log-template tree over the lines of all documents.

Only DataFrame functions. A line goes down a tree of fixed depth: by its
number of tokens, then by its leading tokens, variable ones (with a digit) as
a wild card. In a leaf, a token is constant at its place where MIN_DOCS lines
of the leaf have it there, however many lines the leaf has; the others become
wild cards, and what is left is the line's template. A template with enough
constants that enough documents hold recurs, and its lines are dropped.

Tokens, lines and templates are told apart by two independent 64-bit hashes.
Equal lines of a leaf are looked at once, and constants meet their tokens in a
join by token, so neither a hot leaf nor a hot line is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, stored

#: Documents from which on a template recurs.
MIN_DOCS = 5
#: Share of a template's tokens that must be constant.
CONSTANT = 0.6
#: Levels of leading tokens.
LEADING = 4
#: Leaves are preselected by their hash modulo this, the bound of the broadcast table.
BUCKETS = 1 << 18

WILD = "<*>"


def _masked(tokens: Column, line: Column) -> Column:
    """Variable tokens as wild cards; a line without a digit has none."""
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), WILD).otherwise(t))).otherwise(tokens)


def _leaf() -> list[Column]:
    """Where the tree puts tokens: by their number and the leading ones, as two numbers."""
    leading = [F.coalesce(F.get("tokens", F.lit(i)), F.lit("")) for i in range(LEADING)]
    return [F.xxhash64(F.size("tokens"), *leading).alias("leaf"), F.xxhash64(F.lit(2), *leading, F.size("tokens")).alias("leaf2")]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, tokens, leaf) of every line that is not blank."""
    # An outer explosion: for an inner one the optimiser adds a filter that splits the text a second time.
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    lines = lines.select("doc_id", "text_hash", "line", F.trim("t").alias("t")).where("t <> ''").select("doc_id", "text_hash", "line", "t", F.split("t", " ").alias("raw"))
    lines = lines.select("doc_id", "text_hash", "line", _masked(F.col("raw"), F.col("t")).alias("tokens"))
    return lines.select("*", _leaf()[0])


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line) of every line whose template recurs."""
    lines = _lines(docs)
    busy = stored(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= MIN_DOCS).select("leaf"), "leaves")
    # At most BUCKETS rows of one number; a leaf that shares its bucket with a busy one is told from it below.
    buckets = busy.select(F.pmod("leaf", F.lit(BUCKETS)).alias("bucket")).distinct()
    near = lines.withColumn("bucket", F.pmod("leaf", F.lit(BUCKETS))).join(F.broadcast(buckets), "bucket", "left_semi")
    masked = F.array_join("tokens", " ")
    near = stored(near.select("doc_id", "text_hash", "line", "leaf", masked.alias("masked")).select("*", F.xxhash64("masked").alias("l1"), F.xxhash64(F.lit(2), "masked").alias("l2")), "lines")

    # Each distinct line of a busy leaf once, with how often it occurs. A token at its place in its leaf is two numbers.
    # Leaves are looked up by numbers alone: buckets in common grow with the square of the input, and so would their tokens.
    held_busy = near.select("l1", "l2", "leaf").distinct().join(busy, "leaf", "left_semi").select("l1", "l2")
    each = near.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("times"), F.any_value("masked").alias("masked")).join(held_busy, ["l1", "l2"], "left_semi")
    each = stored(each.withColumn("number", F.monotonically_increasing_id()), "distinct")
    each = each.select("number", "l1", "l2", "times", F.split("masked", " ").alias("tokens")).select("*", *_leaf(), F.size("tokens").alias("n"))
    held = F.transform("tokens", lambda t, i: F.when(t != WILD, F.struct(F.xxhash64("leaf", i, t).alias("h1"), F.xxhash64(t, "leaf2", i).alias("h2"))))
    words_of = F.size(F.filter("tokens", lambda t: t != WILD))
    each = each.select("number", "l1", "l2", "times", "leaf", "leaf2", "n", words_of.alias("n_words"), F.array_compact(held).alias("words"))
    word = each.select("number", "times", F.explode_outer("words").alias("word")).select("number", "times", "word.*").where("h1 IS NOT NULL")
    often = stored(word.groupBy("h1", "h2").agg(F.sum("times").alias("n_lines")).where(F.col("n_lines") >= MIN_DOCS).select("h1", "h2"), "constants")
    # All tokens of a line that occurs often enough itself are constant; those of the others are looked up.
    rare = word.where(F.col("times") < MIN_DOCS).select("number", "h1", "h2").join(often, ["h1", "h2"]).groupBy("number").agg(F.collect_list(F.struct("h1", "h2")).alias("kept"))
    # Their words are counted without their hashes: a condition on these would split the line anew for every token.
    whole = each.where((F.col("times") >= MIN_DOCS) & (F.col("n_words") >= CONSTANT * F.col("n"))).select("l1", "l2", "leaf", "leaf2", F.col("words").alias("kept"))
    rare = each.select("number", "l1", "l2", "leaf", "leaf2", "n").join(rare, "number").where(F.size("kept") >= CONSTANT * F.col("n"))
    # The hashes tell the places too, so what is constant, in any fixed order, is the template.
    kept = whole.unionByName(rare.select("l1", "l2", "leaf", "leaf2", "kept")).withColumn("kept", F.array_sort("kept")).select("l1", "l2", F.xxhash64("leaf", "kept").alias("t1"), F.xxhash64("kept", "leaf2").alias("t2"))
    line = stored(near.select("doc_id", "text_hash", "line", "l1", "l2").join(stored(kept, "kept"), ["l1", "l2"]).select("doc_id", "text_hash", "line", "t1", "t2"), "templates")
    many = line.select("t1", "t2", "doc_id", "text_hash").distinct().groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= MIN_DOCS)
    return line.join(stored(many.select("t1", "t2"), "recurring"), ["t1", "t2"]).select("doc_id", "text_hash", "line")


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text with the recurring lines taken out.

    A template recurs when MIN_DOCS documents hold it, repeated rows counting
    once. Blank lines always stay, and what stays keeps its order. Null text
    counts as empty, which is one blank line. An empty table gives an empty
    result; other columns are not read.
    """
    docs = corpus(docs)
    gone = recurring(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("line").alias("dropped"))
    out = docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (F.xxhash64(docs.text) == gone._hash), "left")
    out = out.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    kept = F.filter("lines", lambda t, i: ~F.array_contains(F.col("dropped"), i))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


SQL = rf"""
WITH l AS (SELECT doc_id, i AS line, string_split(trim(string_split(coalesce(text, ''), chr(10))[i + 1], ' '), ' ') AS raw FROM documents, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) u(i)),
m AS (SELECT doc_id, line, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{WILD}' ELSE t END) AS ts FROM l WHERE raw[1] <> ''),
k AS (SELECT doc_id, line, len(ts) || '/' || array_to_string(list_transform(range(1, {LEADING + 1}), lambda i: coalesce(ts[i], '')), chr(1)) AS leaf, ts FROM m),
b AS (SELECT leaf FROM k GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
e AS (SELECT k.doc_id, k.line, leaf, i AS place, ts[i] AS word FROM k JOIN b USING (leaf), unnest(range(1, len(ts) + 1)) u(i)),
o AS (SELECT leaf, place, word FROM e GROUP BY leaf, place, word HAVING count(*) >= {MIN_DOCS}),
x AS (SELECT e.doc_id, e.line, e.leaf, e.place, CASE WHEN o.word IS NULL OR e.word = '{WILD}' THEN NULL ELSE e.word END AS word FROM e LEFT JOIN o USING (leaf, place, word)),
t AS (SELECT doc_id, line, leaf || chr(2) || string_agg(coalesce(chr(3) || word, ''), chr(1) ORDER BY place) AS template FROM x GROUP BY doc_id, line, leaf HAVING count(word) >= {CONSTANT} * count(*)),
r AS (SELECT template FROM t GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
d AS (SELECT doc_id, line FROM t JOIN r USING (template))
SELECT l.doc_id, count(*) AS n_lines, count(d.line) AS n_dropped,
       coalesce(string_agg(CASE WHEN d.line IS NULL THEN string_split(coalesce(documents.text, ''), chr(10))[l.line + 1] END, chr(10) ORDER BY l.line), '') AS text
FROM l JOIN documents ON documents.doc_id = l.doc_id LEFT JOIN d ON d.doc_id = l.doc_id AND d.line = l.line GROUP BY l.doc_id
"""
