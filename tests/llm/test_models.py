import math
import zlib

import numpy as np
import pytest

from runlens.llm import quality, toxicity

from .conftest import ODD

SF = "/root/testdata/sf0.1"


def area(y, s):
    r = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0
    for v in np.unique(s):
        r[s == v] = r[s == v].mean()
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("run", "label", "fold", "least"), [(toxicity.toxicity, "toxic", (5, 0), 0.95), (quality.quality, "quality", (4, 2), 0.97)])
def test_held_out_accuracy(spark, run, label, fold, least):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = run(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(out) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 for r in out)
    held = [(known[r.doc_id], r.score) for r in out if r.held_out and r.doc_id in known]
    y, s = (np.array(x) for x in zip(*held, strict=True))
    assert area(y, s) >= least
    # Scores are probabilities: in each half of them the mean is near the share of label 1.
    for part in (s < 0.5, s >= 0.5):
        if part.sum() >= 20:
            assert abs(s[part].mean() - y[part].mean()) < 0.12


@pytest.mark.parametrize(("run", "label", "fold"), [(toxicity.toxicity, "toxic", (5, 0)), (quality.quality, "quality", (4, 2))])
def test_held_out_labels_do_not_matter(spark, small, labels, run, label, fold):
    turned = labels.toPandas()
    held = turned.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % fold[0] == fold[1])
    turned.loc[held, label] = 1 - turned.loc[held, label]
    a, b = ({r.doc_id: r.score for r in run(small, x).collect()} for x in (labels, spark.createDataFrame(turned)))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-6, abs_tol=1e-9) for i in a)


@pytest.mark.parametrize(("run", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_odd_rows(spark, odd, nothing, run, label):
    known = spark.createDataFrame([(1, 1, "z"), (1, 0, "z"), (4, 0, "z"), (7, 0, "z"), (None, 1, "z"), (9, None, "z"), (99, 1, "z")], f"doc_id long, {label} int, y string")
    out = run(odd, known).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    same = {}
    for r in out:
        same.setdefault(r.doc_id, set()).add(r.score)
    assert len(same[2]) == 1
    assert run(nothing, known).count() == 0
    assert run(odd, known.where("false")).count() == len(ODD)


def test_pipeline_stage_keeps_columns(spark, odd, labels):
    kept = toxicity.keep_clean(odd, labels.where("false"))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_nearest_are_exact():
    rng = np.random.default_rng(3)
    v = np.where(rng.random((300, 41)) < 0.1, rng.random((300, 41)), 0)
    v[:, -1] = 0.3
    v /= np.linalg.norm(v, axis=1)[:, None]
    sparse = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in v]
    index = toxicity.Index(toxicity.Model({}, np.ones(40), 0.5, sparse, np.ones((300, 2)), np.arange(300)))
    dense = v[index.example]
    for _ in range(100):
        terms = np.append(np.sort(rng.choice(40, int(rng.integers(0, 8)), replace=False)), 40)
        q = rng.random(len(terms))
        q /= np.linalg.norm(q)
        rows, cosine = index.nearest(terms, q, 24)
        exact = dense[:, terms] @ q
        assert np.allclose(np.sort(cosine), np.sort(exact)[-24:])
        assert np.allclose(cosine, exact[rows])


def test_scores_against_brute_force(spark, small, labels):
    """The query's scores by all cosines of dense vectors, and the document frequencies by counting."""
    docs = small.collect()
    model = toxicity.fit(small, labels)
    ids = toxicity._TermIds(model.ids)
    rows = [toxicity._counts(r.text, ids) for r in docs]
    frequency = np.zeros(len(model.ids))
    for _, counts in rows:
        frequency[list(counts)] += 1
    assert np.allclose(model.idf, np.log((1 + len(docs)) / (1 + frequency)) + 1)
    dense = np.zeros((len(model.vectors), len(model.ids) + 1))
    for i, (t, q) in enumerate(model.vectors):
        dense[i, t] = q
    out = {r.doc_id: r.score for r in toxicity.score(small, model).collect()}
    for r, (n_words, counts) in zip(docs, rows, strict=True):
        if not n_words:
            assert out[r.doc_id] == model.base_rate
            continue
        q = np.zeros(dense.shape[1])
        for t, n in counts.items():
            q[t] = (1 + math.log(n)) * model.idf[t]
        q[-1] = toxicity.EVERY_TEXT
        cosine = dense @ (q / np.linalg.norm(q))
        best = np.sort(cosine)[::-1][: toxicity.NEIGHBOURS]
        # Examples that tie at the end of the list may be any of them.
        sure, tied = cosine > best[-1] + 1e-9, np.abs(cosine - best[-1]) <= 1e-9
        shares = []
        for keep in (sure, sure | tied):
            share = toxicity.vote(model.votes[keep], cosine[keep])
            shares.append(model.base_rate if share is None else 1 / (1 + math.exp(-(model.shift + model.slope * toxicity.log_odds(share)))))
        if tied.sum() + sure.sum() <= toxicity.NEIGHBOURS:
            assert math.isclose(out[r.doc_id], shares[1], abs_tol=1e-9)


def test_discriminant_against_brute_force(spark, small, labels):
    """Means, covariances and densities by their definitions over the training rows, without sums or factors."""
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    held = {r.doc_id: np.array(quality.statistics(r.text)) for r in small.collect()}
    x = {c: np.array([held[i] for i, y in known.items() if y == c and i in held]) for c in (0, 1)}
    every = np.concatenate([x[0], x[1]])
    centre, pooled = every.mean(axis=0), np.cov(every.T, bias=True)
    model = quality.fit(quality.with_statistics(small), quality.training_labels(labels, "quality", quality.is_held_out))
    p, margins = quality.PRIOR_ROWS, []
    points = np.array(list(held.values()))
    for c in (0, 1):
        n = len(x[c])
        mean = (x[c].sum(axis=0) + p * centre) / (n + p)
        cov = ((x[c] - mean).T @ (x[c] - mean) + p * pooled) / (n + p)
        cov = (1 - quality.SHRINK_POOLED) * cov + quality.SHRINK_POOLED * pooled
        cov = (1 - quality.SHRINK_DIAGONAL) * cov + quality.SHRINK_DIAGONAL * np.diag(np.diag(cov)) + 1e-3 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        away = points - mean
        margins.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.margin(points), margins[1] - margins[0], rtol=1e-4, atol=1e-4)
    assert math.isclose(model.prior, len(x[1]) / len(every))


def test_examples_are_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLES", 3)
    docs = spark.createDataFrame([(i % 5, f"text number {i} bad" if i % 2 else f"text {i}") for i in range(60)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int"))
    assert len(model.vectors) <= 6
