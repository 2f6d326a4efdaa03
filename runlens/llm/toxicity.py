"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are words and the starts of words. A bounded sample of labelled rows
gives the terms (all that go with the label by a chi-square test, however many)
and the examples; document frequencies are counted over all documents. The
index holds each distinct example vector once, in blocks, with the largest
weight of every term in every block: blocks whose bound cannot reach the k-th
best cosine are passed over, so the k found are exactly the nearest. Their
votes, weighted by nearness, are calibrated by a logistic fit to the votes that
the examples get from each other.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, slices, stored

#: Labelled rows of each class that may become examples (the bound of the fitted model).
EXAMPLES = 3000
#: The least chi-square and number of examples of a term: below them its going with the label is chance.
LEAST_CHI2, LEAST_EXAMPLES = 30.0, 5
#: Letters in the starts of words that are terms.
STARTS = (4, 5, 6, 7)
NEIGHBOURS = 24
#: Score from which on a text is predicted toxic.
THRESHOLD = 0.5
BLOCK = 32
#: Weight of the term that every text with words has: little evidence stays near to none.
EVERY_TEXT = 1.0
_WORD = re.compile(r"[^\W_]+")


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STARTS if len(word) > k)]


class _TermIds(dict):
    """The ids of a word's terms; words met before are kept, up to a bound."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = tuple(self.ids[t] for t in _terms_of(word) if t in self.ids)
        return found


def _counts(text: str | None, ids: _TermIds) -> tuple[int, Counter]:
    """Number of words, and how often each known term occurs."""
    words = _WORD.findall((text or "").lower())
    return len(words), Counter(i for found in map(ids.__getitem__, words) if found for i in found)


def training_labels(labels: DataFrame, label: str, held_out) -> DataFrame:
    """(doc_id, y) once per labelled id outside the held-out fold; the larger of several labels counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


@dataclass
class Model:
    ids: dict[str, int]
    idf: np.ndarray
    base_rate: float
    vectors: list[tuple[np.ndarray, np.ndarray]]  # terms and weights of each distinct example, of norm 1; the last term is that of every text
    votes: np.ndarray  # (example, class) weights, such that classes count as often as in all labelled rows
    example: np.ndarray  # smallest doc_id of the rows behind each vector
    single: np.ndarray = field(default_factory=lambda: np.zeros(2))  # the weight of one row of each class
    slope: float = 1.0  # of the votes' log odds, as fitted to the examples
    shift: float = 0.0

    def index(self) -> Index:
        return Index(self)


class Index:
    """Postings by term, cut into blocks of examples, with the largest weight in each."""

    def __init__(self, model: Model):
        self.n, v = len(model.vectors), len(model.idf) + 1
        # Vectors with one heaviest term stand in one block, so that the bounds are tight.
        order = np.argsort([int(t[np.argmax(np.where(t < v - 1, w, 0))]) for t, w in model.vectors], kind="stable").astype(np.int64)
        self.vectors = [model.vectors[i] for i in order]
        self.votes, self.example = model.votes[order], model.example[order]
        self.blocks = -(-self.n // BLOCK)
        term = np.concatenate([t for t, _ in self.vectors] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(self.n), [len(t) for t, _ in self.vectors])
        weight = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        by_term = np.lexsort((row, term))
        term, self.rows, self.weights = term[by_term], row[by_term], weight[by_term]
        self.largest = np.zeros((v, self.blocks))
        np.maximum.at(self.largest, (term, self.rows // BLOCK), self.weights)
        # Where the postings of a term within a block begin; the last column is where the term's end.
        place = term * (self.blocks + 1) + self.rows // BLOCK
        self.at = np.searchsorted(place, np.arange(v * (self.blocks + 1))).reshape(v, self.blocks + 1)

    def _cosines(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray, out: np.ndarray) -> None:
        """Add up the postings of the query's terms in these blocks."""
        start, stop = self.at[terms][:, blocks].ravel(), self.at[terms][:, blocks + 1].ravel()
        size = stop - start
        if not size.sum():
            return
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out += np.bincount(self.rows[at], weights=self.weights[at] * np.repeat(np.repeat(q, len(blocks)), size), minlength=len(out))

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples; the smaller row wins a tie."""
        n = self.n
        bound = q @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        cosine, done, wave = np.zeros(n), 0, max(2, -(-2 * k // BLOCK))
        seen = np.zeros(n, bool)
        least = -1.0
        while done < self.blocks and bound[order[done]] >= least - 1e-12:
            blocks = np.sort(order[done : done + wave])
            self._cosines(terms, q, blocks, cosine)
            seen |= np.isin(np.arange(n) // BLOCK, blocks)
            done += wave
            if seen.sum() >= k:
                least = np.partition(cosine[seen], -k)[-k]
        rows = np.flatnonzero(seen)
        rows = rows[np.lexsort((rows, -np.round(cosine[rows], 12)))][:k]
        return rows, cosine[rows]


def vote(votes: np.ndarray, cosine: np.ndarray) -> float | None:
    """The share of label 1 among the votes, each the heavier the nearer it is; None without a vote."""
    total = (votes / (0.02 + 1 - np.minimum(1, cosine))[:, None]).sum(axis=0)
    return float(total[1] / total.sum()) if total.sum() > 0 else None


def log_odds(share: float) -> float:
    return math.log((share + 1e-4) / (1 - share + 1e-4))


def _vector(model: Model, n_words: int, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    terms = np.array(sorted(counts), np.int64)
    q = np.array([(1 + math.log(counts[t])) * model.idf[t] for t in terms.tolist()])
    if n_words:
        terms, q = np.append(terms, len(model.idf)), np.append(q, EVERY_TEXT)
    return terms, q / max(1e-12, np.sqrt(q @ q))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out=is_held_out) -> Model:
    """Terms and examples from a sample of at most EXAMPLES labelled rows a class; frequencies from all of ``docs``."""
    spark, docs = docs.sparkSession, corpus(docs)
    known = stored(training_labels(labels, label, held_out), "labels")
    # Of rows that share an id only one is an example, so that the bound holds.
    share = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    # At most 2 * EXAMPLES rows of two numbers.
    sample = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = stored(sample.select("doc_id", "text", "y"), "examples")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)

    def terms(batches):
        for batch in slices(batches, 200):
            out = [(t, y) for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in {t for w in set(_WORD.findall((text or "").lower())) for t in _terms_of(w)}]
            yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in out], pa.string()), "y": pa.array([y for _, y in out], pa.int32())})

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / F.nullif(F.lit(float(max(1, n1))) * max(1, n0) * (a + b) * (n0 + n1 - a - b), F.lit(0.0))
    found = (
        sample.select("text", "y").mapInArrow(terms, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .where((F.col("a") + F.col("b") >= LEAST_EXAMPLES) & (F.col("a") + F.col("b") < n0 + n1)).withColumn("chi2", chi2)
        .where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").collect()
    )
    ids = {r.term: i for i, r in enumerate(found)}
    sent = spark.sparkContext.broadcast(ids)

    def frequencies(batches):
        known_ids, total = _TermIds(sent.value), Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total[-1] += 1
                total.update(set(_counts(text, known_ids)[1]))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int32()), "df": pa.array(list(total.values()), pa.int64())})

    df = {r.term: r.df for r in docs.select("text").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    rows = df.get(-1, 0)
    idf = np.array([math.log((1 + rows) / (1 + df.get(i, 0))) + 1 for i in range(len(ids))])
    model = Model(ids, idf, share.get(1, 0) / max(1, sum(share.values())), [], np.zeros((0, 2)), np.zeros(0, np.int64))

    def vectors(batches):
        known_ids = _TermIds(sent.value)
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                t, q = _vector(model, *_counts(text, known_ids))
                out.append(json.dumps([t.tolist(), q.round(12).tolist()]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(2), "vector": pa.array(out, pa.string())})

    # One row per distinct vector, of at most 2 * EXAMPLES rows in all.
    held = sample.select("doc_id", "text", "y").mapInArrow(vectors, "doc_id long, y int, vector string").groupBy("vector").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id")).orderBy("vector").collect()
    held = [(json.loads(r.vector), r) for r in held]
    held = [x for x in held if x[0][0]]
    model.vectors = [(np.array(t, np.int64), np.array(q)) for (t, q), _ in held]
    weight = [share.get(y, 0) / max(1, n.get(y, 0)) for y in (0, 1)]
    model.votes = np.array([[(r.rows - r.ones) * weight[0], r.ones * weight[1]] for _, r in held]).reshape(-1, 2)
    model.example = np.array([r.doc_id for _, r in held], np.int64)
    model.single = np.array(weight)
    return _calibrated(spark, model) if n0 and n1 else model


def _calibrated(spark, model: Model) -> Model:
    """Slope and shift of the votes' log odds by logistic regression over the examples, each judged by the others."""
    sent = spark.sparkContext.broadcast(model)

    def judged(batches):
        m = sent.value
        index = m.index()
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                at, cosine = index.nearest(*index.vectors[i])
                for y in (0, 1):
                    if index.votes[i, y] > 0:
                        votes = index.votes[at].copy()
                        votes[at == i, y] -= m.single[y]
                        share = vote(np.maximum(votes, 0), cosine)
                        if share is not None:
                            out.append((round(8 * log_odds(share)), y, float(index.votes[i, y])))
            yield pa.RecordBatch.from_pydict({"bin": pa.array([x[0] for x in out], pa.int32()), "y": pa.array([x[1] for x in out], pa.int32()), "weight": pa.array([x[2] for x in out], pa.float64())})

    rows = spark.range(0, len(model.vectors), 1, 8).mapInArrow(judged, "bin int, y int, weight double").groupBy("bin").agg(F.sum(F.col("weight") * F.col("y")).alias("ones"), F.sum("weight").alias("n")).orderBy("bin").collect()
    x, ones, n = (np.array([float(r[k]) for r in rows]) for k in ("bin", "ones", "n"))
    a, w = np.stack([x / 8, np.ones_like(x)]), np.array([1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(w @ a, -60, 60)))
        # A weak pull towards the votes as they are keeps the fit finite where the classes are told apart wholly.
        grad, hess = a @ (ones - n * z) - (w - [1, 0]), (a * (n * z * (1 - z))) @ a.T + np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
    model.slope, model.shift = max(0.05, float(w[0])), float(w[1])
    return model


class Scorer:
    """Scores texts in one task: (score, nearest examples, their cosines). Texts of equal term counts are scored once."""

    def __init__(self, model: Model):
        self.model, self.index, self.ids, self.known = model, model.index(), _TermIds(model.ids), {}

    def __call__(self, text: str | None) -> tuple[float, list[int], list[float]]:
        m, index = self.model, self.index
        n_words, counts = _counts(text, self.ids)
        if not n_words or not index.blocks:
            return m.base_rate, [], []
        key = tuple(sorted(counts.items()))
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            at, cosine = index.nearest(*_vector(m, n_words, counts))
            share = vote(index.votes[at], cosine)
            calibrated = m.base_rate if share is None else 1 / (1 + math.exp(-max(-60.0, min(60.0, m.shift + m.slope * log_odds(share)))))
            self.known[key] = (calibrated, index.example[at[:3]].tolist(), cosine[:3].round(6).tolist())
        return self.known[key]


def score(docs: DataFrame, model: Model, held_out=is_held_out) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest, cosines) per row: calibrated votes weighted by nearness, and the examples that cast them.

    Texts without words, null ones included, have no neighbours and get the
    share of label 1 among the labelled rows, as every text does when nothing
    is labelled. Equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            out = [scorer(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array([x[0] for x in out], pa.float64()), "nearest": pa.array([x[1] for x in out], pa.list_(pa.int64())), "cosines": pa.array([x[2] for x in out], pa.list_(pa.float64()))})

    scored = corpus(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(rows, "doc_id long, held_out boolean, score double, nearest array<long>, cosines array<double>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest", "cosines")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` by a model fitted to ``labels`` (doc_id, toxic); see score() for the cases."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns stay. Rows are judged where they are read, nothing is joined."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def kept(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer(t)[0] < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
