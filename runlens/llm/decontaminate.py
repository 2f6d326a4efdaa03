"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

Only DataFrame functions. A window is similar to an item only if most of its
shingles are the item's, in whatever order, so windows are laid at every start
from which enough rolling shingle hashes meet those of items of that size.
Their 128-bit fingerprints meet those of the items of that size in a
multi-index of BLOCKS blocks of 16 bits: two fingerprints within RADIUS are
within NEAR bits in one block at least, and every item is entered under all
values that near to its own, so none within RADIUS is missed while some 8 % of
unrelated pairs are looked at. What is within the radius is verified exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 16 bits in a fingerprint, and the bits that one of them may differ in.
BLOCKS, NEAR = 8, 3
#: Bits that fingerprints of a window and its item may differ in: beyond it, every block may be farther than NEAR. At
#: similarity 0.8 some 19 of 128 differ, the radius is three deviations more.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Documents to lay windows in are preselected by their hash modulo this, the bound of the broadcast table.
BUCKETS = 1 << 18
#: Distinct benchmark shingles up to which their table is broadcast; beyond, the join shuffles.
BROADCAST_SHINGLES = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; none where there are fewer words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _signs(hashes: Column) -> Column:
    """64 bits, each by the majority of the hashes, repeated ones as often as they occur; ties give 1."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + (F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)) * 2 - 1).cast("int"))
        return F.when(votes >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def fingerprint(hashes: Column) -> Column:
    """SimHash of 128 bits, as two longs; the second is of the shingles hashed once more."""
    return F.array(_signs(hashes), _signs(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(1)))))


def _block(fp: Column) -> Column:
    """(block, bits) for each of the blocks."""
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.get(fp, F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bits")) for i in range(BLOCKS)))


def _entered(blocks: DataFrame) -> DataFrame:
    """Rows with (block, bits), entered under every value of bits that is within NEAR."""
    near = F.filter(F.sequence(F.lit(0), F.lit(0xFFFF)), lambda m: F.bit_count(m) <= NEAR)
    return blocks.withColumn("bits", F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("bits")))))


def _apart(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(2)), F.lit(0)).cast("int")


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, k, hashes) of each item with words; an item of fewer than SHINGLE words is one shingle."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n_words", F.size("w")).withColumn("k", F.least(F.lit(SHINGLE), "n_words"))
    hashes = F.coalesce(*(F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)) for k in range(1, SHINGLE + 1)))
    return w.select("item_id", "n_words", "k", hashes.alias("hashes")).dropDuplicates(["item_id", "hashes"])


def _starts(places: Column, n: Column, size: Column) -> Column:
    """Every start of a window of ``size`` shingles, of ``n``, in which enough of the sorted ``places`` lie for SIMILARITY.

    A start is found at the first of its places only: it lies behind the place
    before that one and reaches the last place needed.
    """
    last = F.greatest(F.lit(0), n - size)
    # shared >= SIMILARITY * (both sizes - shared), less what rounding may add.
    need = F.ceil((F.least(n, size) + size) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int")

    def found(i: Column) -> Column:
        first = F.get(places, i)
        low = F.greatest(F.coalesce(F.get(places, i - 1), F.lit(-1)) + 1, F.get(places, i + need - 1) - size + 1, F.lit(0))
        high = F.least(first, last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(places) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - need), found))).otherwise(F.array().cast("array<int>"))


def windows(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, start, hashes): the item-sized windows with enough shingles of items of that size."""
    shingles = held.select("n_words", "k", F.explode("hashes").alias("hash")).distinct()
    if (held.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        shingles = F.broadcast(shingles)
    out = []
    for k in sorted(r.k for r in held.select("k").distinct().collect()):  # five sizes at most
        # The words are a column of their own, and the explosion is an outer one, as for an inner one the optimiser
        # adds a filter on the array below: either would split the text anew at every place.
        split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
        rolled = split.select("doc_id", "text_hash", shingle_hashes(F.col("w"), k).alias("rolled")).withColumn("n", F.size("rolled"))
        hits = rolled.select("doc_id", "text_hash", "n", F.posexplode_outer("rolled").alias("pos", "hash")).join(shingles.where(F.col("k") == k), "hash")
        places = hits.groupBy("doc_id", "text_hash", "n", "n_words").agg(F.array_sort(F.collect_set("pos")).alias("places"))
        starts = places.select("doc_id", "text_hash", "n_words", _starts(F.col("places"), F.col("n"), F.col("n_words") - (k - 1)).alias("starts")).where(F.size("starts") > 0)
        starts = stored(starts, "starts")
        # The texts that have windows are read again. At most BUCKETS rows of one number.
        bucket = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)).alias("bucket")
        again = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").select("*", bucket).join(F.broadcast(starts.select(bucket).distinct()), "bucket", "left_semi")
        again = again.dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        laid = starts.join(again, starts.doc_id.eqNullSafe(again._id) & (starts.text_hash == again._hash)).select("doc_id", "text_hash", "n_words", "starts", words(F.col("text")).alias("w"))
        laid = laid.select("doc_id", "text_hash", "n_words", "starts", shingle_hashes(F.col("w"), k).alias("rolled"))
        laid = laid.select("doc_id", "text_hash", "n_words", F.explode_outer(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("rolled", s + 1, F.col("n_words") - (k - 1)).alias("hashes")))).alias("laid"))
        out.append(laid.select("doc_id", "text_hash", "n_words", "laid.start", "laid.hashes"))
    return reduce(DataFrame.unionByName, out) if out else None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, start_word, distance, similarity) of the best window per document and item.

    Similarity is the weighted Jaccard similarity of five-word shingles, each
    weighted by how often it occurs in the window or the item; 0.8 or more
    counts. Of windows that are equally similar the first is named. Null or
    wordless texts and items match nothing; repeated rows give one result;
    items that share a text are all named. Empty tables give an empty result
    and further columns are not read.
    """
    held = stored(items(benchmark.select("item_id", "text")).withColumn("fp", fingerprint(F.col("hashes"))), "items")
    found = windows(corpus(docs), held)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, n_words int, start_word int, distance int, similarity double")
    found = stored(found.withColumn("fp", fingerprint(F.col("hashes"))).withColumn("window", F.monotonically_increasing_id()), "windows")
    blocks = found.select("window", "n_words", "fp", F.inline(_block(F.col("fp"))))
    theirs = _entered(held.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.col("hashes").alias("item_hashes"), F.inline(_block(F.col("fp")))).select("item_id", "n_words", "item_fp", "block", "bits"))
    # Some 5,600 entries an item: a merge join at every size.
    theirs = theirs.hint("merge")
    # Only numbers meet in the index; the hashes join what is within the radius.
    near = blocks.join(theirs, ["n_words", "block", "bits"]).withColumn("distance", _apart(F.col("fp"), F.col("item_fp"))).where(F.col("distance") <= RADIUS).select("window", "item_id", "n_words", "item_fp", "distance").distinct()
    same = held.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.col("hashes").alias("item_hashes"))
    near = near.withColumnRenamed("item_id", "_item").join(found.select("window", "doc_id", "text_hash", "start", "hashes"), "window").join(same, ["n_words", "item_fp"]).where(F.col("_item").eqNullSafe(F.col("item_id"))).drop("_item")

    def times(a: Column, h: Column) -> Column:
        return F.size(F.filter(a, lambda x: x == h))

    both = F.aggregate(F.array_intersect("hashes", "item_hashes"), F.lit(0), lambda n, h: n + F.least(times(F.col("hashes"), h), times(F.col("item_hashes"), h)))
    near = near.withColumn("both", both).withColumn("similarity", F.col("both") / (F.size("hashes") + F.size("item_hashes") - F.col("both")))
    best = near.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct("n_words", F.col("start").alias("start_word"), "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "best.*")


def keep_unmatched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay."""
    # The list grows with the corpus: a merge join at every size.
    gone = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), "text_hash").distinct(), "gone").hint("merge")
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (F.xxhash64(docs.text) == gone.text_hash), "left_anti").select(*[docs[c] for c in docs.columns])
