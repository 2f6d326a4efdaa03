"""Spelling variant grouping: dense prefix-suffix tiling.

Only DataFrame functions. Two words are one edit apart exactly when their
common prefix and common suffix together reach the longer length less one. A
word of m code points is cut into windows of WINDOW of them; a single edit
lies in one window, so both words have the same code points before it and
after it. Words are therefore tiled by (m, window, prefix, suffix): once as
the longer word, of their own length, and once as the shorter one, of one code
point less. What is left in a window are rows of a dense matrix of code points,
padded on the right for prefixes and on the left for suffixes. Each row is one
number a side, so that common lengths are read from the bits that differ.

A tile holds at most about TILE words; larger groups are cut into blocks and
every two blocks are compared. Only a word's count of near words and its best
form leave a tile, never a pair, and only distinct words come here: the counts
of occurrences are summed where the texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, crc32_sql, stored

#: Code points of a window. Words of one tile differ in no others.
WINDOW = 3
#: Words of a tile that are compared with as many others at once.
TILE = 256
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent.
FORM_RATIO = 10
#: Of so many occurrences (by a checksum) one loses a code point.
NOISE = 31

RUN = "[A-Za-zÀ-ÿ]+"
#: Bits of a code point in a row of the matrix.
_BITS = 21


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of all texts, long and frequent enough. A null doc_id counts as empty text."""
    runs = corpus(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    # lower() of a run of ASCII letters changes A-Z only; the others are mapped letter by letter.
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", upper, upper.lower()))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), low.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    found = runs.select(F.when(F.col("h") % NOISE == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _packed(points: Column, order) -> Column:
    """WINDOW code points, the first of ``order`` in the highest bits; none (0) where the window has fewer."""
    parts = [F.shiftleft(F.coalesce(F.get(points, i), F.lit(0)).cast("long"), _BITS * (WINDOW - 1 - k)) for k, i in enumerate(order)]
    return sum(parts[1:], parts[0])


def _entries(found: DataFrame) -> DataFrame:
    """(key, word, n, full, width, left, right, tail) of each window of a word, as the longer (full) and as the shorter word of a pair.

    ``tail`` says that the code point after the window repeats the last in it.
    """
    m = F.explode(F.array(F.struct(F.length("word").alias("m"), F.lit(True).alias("full")), F.struct((F.length("word") + 1).alias("m"), F.lit(False).alias("full")))).alias("as")
    cut = found.select("word", "n", m).select("word", "n", "as.*").select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(WINDOW))).alias("at"))
    width = F.least(F.lit(WINDOW), F.col("m") - F.col("at"))
    cut = cut.withColumn("width", width).withColumn("own", F.when(F.col("full"), F.col("width")).otherwise(F.col("width") - 1))
    before, after = F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + F.col("own") + 1)
    cut = cut.withColumn("key", F.concat_ws("/", "m", "at", before, after)).withColumn("middle", F.transform(F.filter(F.split(F.substr("word", F.col("at") + 1, F.col("own")), ""), lambda c: c != ""), F.ascii))
    last = F.substr("word", F.col("at") + F.col("width"), F.lit(1))
    tail = F.col("full") & (F.col("at") + F.col("width") < F.col("m")) & (last == F.substr("word", F.col("at") + F.col("width") + 1, F.lit(1)))
    return cut.select("key", "word", "n", "full", "width", _packed(F.col("middle"), range(WINDOW)).alias("left"), _packed(F.reverse("middle"), range(WINDOW)).alias("right"), tail.alias("tail"))


def _common(a: Column, b: Column) -> Column:
    """How many code points two packed rows have in common from their highest on, up to WINDOW - 1."""
    x, out = a.bitwiseXOR(b), F.lit(0)
    for k in range(1, WINDOW):
        out = F.when(x < (1 << (_BITS * (WINDOW - k))), k).otherwise(out)
    return out


def _near(x: Column, y: Column) -> Column:
    """Whether two words of a tile, not equal, are one edit apart and this window is the one where they first differ.

    Both shorter: they belong to another tile. A deletion from a run of equal
    letters fits several windows, of which the last counts.
    """
    lcp, lcs = _common(x["left"], y["left"]), _common(x["right"], y["right"])
    same = x["full"] & y["full"]
    ends = lcp + lcs >= x["width"] - 1
    inner = (x["full"] != y["full"]) & ((lcp < x["width"] - 1) | ~F.when(x["full"], x["tail"]).otherwise(y["tail"]))
    return (x["word"] != y["word"]) & (same | inner) & ends


def near_words(found: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words of ``found`` (word, n, distinct) that have near words."""
    entries = _entries(found)
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bool_or("full").alias("any")).where("size > 1 and any")
    sizes = stored(sizes.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")), "tiles")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    member = F.struct("word", "n", "full", "width", "left", "right", "tail")
    tiles = entries.join(sizes, "key").withColumn("own", own).groupBy("key", "blocks", "own").agg(F.collect_list(member).alias("rows"))
    tiles = stored(tiles, "tiles")
    alone = tiles.where("blocks = 1").select("rows", F.col("rows").alias("others"))
    left = tiles.where("blocks > 1").select("key", "rows", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    blocks = left.join(tiles.where("blocks > 1").select("key", "own", F.col("rows").alias("others")), ["key", "own"]).select("rows", "others")

    def against(x):
        near = F.filter("others", lambda y: _near(x, y))
        forms = F.filter(near, lambda y: y["n"] >= FORM_RATIO * x["n"])
        # The largest count first, then the smallest word.
        best = F.array_min(F.transform(forms, lambda y: F.struct((-y["n"]).alias("less"), y["word"].alias("form"))))
        return F.struct(x["word"].alias("word"), F.size(near).cast("long").alias("n_near"), best.alias("best"))

    met = alone.unionByName(blocks).select(F.explode(F.filter(F.transform("rows", against), lambda r: r["n_near"] > 0)).alias("r")).select("r.*")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: pointers are doubled until each is at a word without one.

    A form is FORM_RATIO times as frequent as its word, so a chain has no more
    steps than the largest count has digits, and the rounds are fewer still.
    """
    held = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # Both sides are stored, so that a root with very many variants may be split.
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = stored(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not held.where("moved").limit(1).count():
            return held.select("word", "root")
        held = held.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, if that is FORM_RATIO times
    its own n at least; ties go to the smallest word. Its root is where its
    forms end. Null and empty texts have no words; repeated rows count each; a
    null doc_id enters the checksum as empty text. An empty table gives an
    empty result; other columns are not read.
    """
    found = stored(words(docs), "words")
    near = stored(near_words(found), "near")
    ends = roots(near.where("form is not null"))
    out = found.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


SQL = rf"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
l AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM o WHERE length(r) >= {LEAST_LENGTH}),
c AS (SELECT r, {crc32_sql("concat(doc_id, ':', r)")} AS h FROM l),
d AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM c),
w AS (SELECT word, count(*) AS n FROM d WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM w, unnest(range(length(word))) u(i)),
p AS (SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.cut = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.cut = w.word),
k AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
f AS (SELECT p.word, other AS form, p.n AS form_n FROM p JOIN w ON w.word = p.word WHERE p.n >= {FORM_RATIO} * w.n QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY p.n DESC, other COLLATE "C") = 1),
r(word, root) AS (SELECT word, word FROM w UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root)
SELECT w.word, f.form, r.root, w.n, coalesce(k.n_near, 0) AS n_near, f.form_n
FROM w JOIN r ON r.word = w.word AND r.root NOT IN (SELECT word FROM f) LEFT JOIN k ON k.word = w.word LEFT JOIN f ON f.word = w.word
"""
