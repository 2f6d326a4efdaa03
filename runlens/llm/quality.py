"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the covariance of all
labelled rows and its diagonal; a document's score is the posterior that
follows from the difference of the two log densities. Means and covariances
come from sums over every labelled row of the training folds; the Cholesky
factors of the covariances are made once and sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import corpus, slices, stored
from runlens.llm.toxicity import training_labels

#: Weight of the pooled covariance in a class's own, and of its diagonal.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
#: Rows that temper the sums while a class has few.
PRIOR_ROWS = 10

FEATURES = (
    "log_words", "word_length", "letters", "capitals", "digits", "signs", "bars", "exclaims", "sign_ended", "long_words",
    "distinct", "commonest", "repeats", "lines", "line_copies", "sentence_ends",
)

#: What each byte counts as: 1 lower-case letter or beyond ASCII, 2 capital, 3 digit, 4 white space, 5 usual punctuation, 6 bar, 7 exclamation mark, 0 other signs.
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = 1
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\r\x0b\x0c", 4), (".,;:'\"?-()", 5), ("|", 6), ("!", 7)):
    _KIND[list(_chars.encode())] = _kind


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a text: counts as logarithms, shares as logarithms of small odds. An empty text has all counts 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]

    def share(x: float, of: float) -> float:
        return float(np.log((x + 0.002 * of) / (1.002 * of)))

    letters = kinds[1] + kinds[2]
    sign_ended = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:'\"?!)|") for w in counts)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(words))), float(np.log1p(letters / n)), share(letters, size), share(kinds[2], max(1, letters)), share(kinds[3], size), share(kinds[0], size), share(kinds[6], n), share(kinds[7], n),
        share(sign_ended, max(1, len(counts))), share(sum(len(w) > 24 for w in words), n),
        # Distinct words fall with length as a power: the share is set against it.
        float(np.log(max(1, len(counts))) - 0.9 * np.log(n)), share(max(counts.values(), default=0), n), share(repeats, n), float(np.log1p(len(lines)) - np.log1p(n / 30)), share(len(lines) - len(set(lines)), max(1, len(lines))), share(raw.count(b".") + raw.count(b"?"), n),
    ]


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text."""

    def rows(batches):
        for batch in slices(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.array(x, pa.list_(pa.float64()))})

    return corpus(docs).mapInArrow(rows, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    mean: np.ndarray  # (class, feature)
    factor: np.ndarray  # lower Cholesky factors by class
    prior: float  # share of label 1
    slope: float = 1.0  # of the log-density difference, as fitted to the training rows
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        out = []
        for y in (0, 1):
            z = np.linalg.solve(self.factor[y], (x - self.mean[y]).T)
            out.append(-0.5 * (z**2).sum(axis=0) - np.log(np.diag(self.factor[y])).sum())
        return out[1] - out[0]

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if not 0 < self.prior < 1:
            return np.full(len(x), self.prior)
        odds = np.log(self.prior / (1 - self.prior)) + self.shift + self.slope * self.margin(x)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(rows: DataFrame, known: DataFrame) -> Discriminant:
    """Sums of x and of its products by class, over all rows of ``rows`` (doc_id, x) that ``known`` (doc_id, y) labels."""
    d = len(FEATURES)
    train = stored(rows.join(known, "doc_id").select("y", "x"), "train")

    def sums(batches):
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(axis=0)
                p[c] += own.T @ own
        yield pa.RecordBatch.from_pydict({"n": [n.tolist()], "s": [s.ravel().tolist()], "p": [p.ravel().tolist()]})

    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    # One row a task, then one row in all.
    total = train.mapInArrow(sums, "n array<double>, s array<double>, p array<double>")
    at = total.select(F.posexplode(F.concat("n", "s", "p"))).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    flat = np.array([r.v for r in at])
    if len(flat):
        n, s, p = flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)
    if not n.sum():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), 0.5)
    # Shifted by the mean of all before the products are centred, so that nothing is lost to rounding.
    overall = s.sum(axis=0) / n.sum()
    pooled = p.sum(axis=0) / n.sum() - np.outer(overall, overall)
    scale = np.maximum(np.diag(pooled), 1e-6)
    mean, factor = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        mean[c] = (s[c] + PRIOR_ROWS * overall) / (n[c] + PRIOR_ROWS)
        own = (p[c] - np.outer(mean[c], s[c]) - np.outer(s[c], mean[c]) + n[c] * np.outer(mean[c], mean[c]) + PRIOR_ROWS * pooled) / (n[c] + PRIOR_ROWS)
        own = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
        own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(np.diag(own)) + np.diag(1e-3 * scale)
        factor[c] = np.linalg.cholesky(own)
    model = Discriminant(mean, factor, float(n[1] / n.sum()))
    return _calibrated(model, train) if 0 < model.prior < 1 else model


def _calibrated(model: Discriminant, train: DataFrame) -> Discriminant:
    """Slope and shift of the margin by logistic regression over counts of the margins, in 401 bins."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def bins(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES))
            m = np.clip(np.round(sent.value.margin(x) * 2), -200, 200).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "bin": pa.array(m)})

    held = train.mapInArrow(bins, "y int, bin int").groupBy("bin").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    m, ones, n = (np.array([float(r[k]) for r in held]) for k in ("bin", "ones", "n"))
    base = np.log(model.prior / (1 - model.prior))
    w = np.array([0.3, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(base + w[1] + w[0] * m / 2, -60, 60)))
        a = np.stack([m / 2, np.ones_like(m)])
        grad = a @ (ones - n * z) - np.array([1e-3, 1e-3]) * w
        hess = (a * (n * z * (1 - z))) @ a.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -0.5, 0.5)
    model.slope, model.shift = max(0.01, float(w[0])), float(w[1])
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``: the posterior of label 1, predicted from 0.7 on.

    Null and empty texts are scored by their statistics, which are those of no
    words. With one class among the labels every score is its prior, with no
    labels 0.5. Of several labels of an id the larger counts. Equal texts get
    equal scores; further columns are not read.
    """
    rows = stored(with_statistics(docs), "statistics")
    model = fit(rows, training_labels(labels, "quality", is_held_out))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(sent.value.posterior(x))})

    scored = rows.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
