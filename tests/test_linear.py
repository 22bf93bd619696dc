"""The multi-model linear solver against plain numpy optima on a small corpus."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termsieve.operators import linear, population, split
from termsieve.plans.corpus import build_corpus
from termsieve.runtime import scratch_root

WORDS = {"x": "red apple pie sweet", "y": "blue metal car fast", "z": "green leaf tree tall"}
FOLDS = 3


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(48):
        label = "xyz"[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[label].split(), k=4) + rng.choices("red metal tree common every".split(), k=5)), label))
    rows += [(60, "", "y"), (61, None, "z"), (62, "unseen", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return build_corpus(docs.join(split.stratified_folds(docs, FOLDS).select("doc_id", "fold"), "doc_id"), min_df=2)


@pytest.fixture(scope="module")
def design(corpus):
    return linear.prepare_design(corpus.weights, corpus.docs, corpus.vocab, block_docs=7, term_range=5)


def dense(corpus):
    docs = sorted(corpus.docs.collect(), key=lambda r: r.doc_id)
    terms = sorted(r.term for r in corpus.vocab.terms.collect())
    x = np.zeros((len(docs), len(terms)))
    at = {d.doc_id: i for i, d in enumerate(docs)}
    for e in corpus.weights.collect():
        x[at[e.doc_id], terms.index(e.term)] = e.w
    return x, np.array(["xyz".index(d.label) for d in docs]), np.array([d.fold for d in docs]), [d.doc_id for d in docs], terms


def newton_lr(x, y):
    """Weights (terms + 1, classes) by damped Newton steps on the whole Hessian."""
    a, k = np.c_[x, np.ones(len(x))], 3
    d = a.shape[1]
    ridge = np.diag(np.r_[np.ones(d - 1), 0])
    w = np.zeros((d, k))
    for _ in range(50):
        z = a @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = a.T @ (p - np.eye(k)[y]) + ridge @ w
        h = np.zeros((d * k, d * k))
        for i in range(k):
            for j in range(k):
                h[i * d:(i + 1) * d, j * d:(j + 1) * d] = (a * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a + (i == j) * ridge
        w = w - np.linalg.lstsq(h, g.T.ravel(), rcond=1e-10)[0].reshape(k, d).T
    return w - np.r_[np.zeros(d - 1), 1][:, None] * w[-1].mean()


def weights_of(design, fitted, terms, which, per_set):
    rows = [r for r in linear.weight_rows(design, fitted).collect() if r.set == which]
    out = np.zeros((len(terms) + 1, per_set))
    for r in rows:
        out[len(terms) if r.term is None else terms.index(r.term), r.column] = r.x
    return out


def test_logistic_regression_reaches_the_optimum(corpus, design):
    x, y, fold, ids, terms = dense(corpus)
    fitted = linear.fit_linear(design, list(range(FOLDS)), "softmax", tolerance=1e-4, max_rounds=300)
    assert fitted.worst.max() <= 1e-4
    preds = {(r.fold, r.doc_id): r.p for r in linear.predict_linear(design, fitted).collect()}
    assert len(preds) == len(ids)
    for f in range(FOLDS):
        want = newton_lr(x[fold != f], y[fold != f])
        got = weights_of(design, fitted, terms, f, 3)
        got[-1] -= got[-1].mean()
        assert np.abs(got - want).max() < 2e-4
        z = np.c_[x, np.ones(len(x))] @ want
        assert [preds[f, i] for i, g in zip(ids, fold) if g == f] == ["xyz"[k] for k in z[fold == f].argmax(1)]


def test_svm_is_within_its_gap(corpus, design):
    """The slopes at the solution are feasible dual variables; the gap they prove is within the stated one."""
    x, y, fold, ids, terms = dense(corpus)
    fitted = linear.fit_linear(design, list(range(FOLDS)), "hinge", tolerance=1e-4, corner=0.1, max_rounds=300)
    for f in range(FOLDS):
        w = weights_of(design, fitted, terms, f, 3)
        for k, (a, b) in enumerate(fitted.loss.pairs):
            rows = (fold != f) & ((y == a) | (y == b))
            sign = np.where(y[rows] == b, 1.0, -1.0)
            margin = sign * (x[rows] @ w[:-1, k] + w[-1, k])
            alpha = np.clip((1 - margin) / 0.1, 0, 1)
            assert abs((alpha * sign).sum()) < 2e-4
            primal = (w[:-1, k] ** 2).sum() / 2 + np.maximum(0, 1 - margin).sum()
            dual = alpha.sum() - ((x[rows].T @ (alpha * sign)) ** 2).sum() / 2
            assert -1e-3 < primal - dual <= rows.sum() * 0.1 / 2 + 1e-3


def test_masks_equal_separate_fits(corpus, design):
    x, y, fold, ids, terms = dense(corpus)
    kept = [(t, s) for s in range(FOLDS) for i, t in enumerate(terms) if (i + s) % 3]
    masks = corpus.docs.sparkSession.createDataFrame(kept, "term string, set int")
    fitted = linear.fit_linear(design, list(range(FOLDS)), "softmax", masks=masks, tolerance=1e-4, max_rounds=300)
    for s in range(FOLDS):
        own = [i for i in range(len(terms)) if (i + s) % 3]
        got, want = weights_of(design, fitted, terms, s, 3), newton_lr(x[fold != s][:, own], y[fold != s])
        assert np.abs(got[own] - want[:-1]).max() < 2e-4
        assert not got[[i for i in range(len(terms)) if i not in own]].any()


def test_shuffled_sides_give_the_same(corpus, design, monkeypatch):
    first = linear.fit_linear(design, [0], "softmax", max_rounds=4)
    monkeypatch.setattr(linear, "BROADCAST_BYTES", -1)
    second = linear.fit_linear(design, [0], "softmax", max_rounds=4)
    assert np.allclose(first.value, second.value)


def test_absent_classes_are_never_named(spark):
    rows = [(i, "a b" if i % 2 else "c d", "pq"[i % 2], 1) for i in range(12)] + [(20, "a b", "r", 0), (21, "c d", "p", 0), (22, None, "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, fold int")
    c = build_corpus(docs, min_df=1)
    for name in ("LR", "SVM"):
        got = {r.doc_id: r.p for r in linear.classify_linear(name, c.weights, c.docs, c.vocab, 1).collect()}
        assert set(got) == {20, 21, 22} and set(got.values()) <= {"p", "q"}


def test_candidates_are_solved_together(corpus):
    """Fitness of every candidate equals that of a fit on its terms alone; an empty one is infinite."""
    spark = corpus.docs.sparkSession
    docs = corpus.docs.withColumn("fold", F.col("fold") % 2)
    weights = corpus.weights.withColumn("fold", F.col("fold") % 2)
    ev = population.prepare_evaluation(weights, docs, corpus.vocab, 2)
    terms = sorted(r.term for r in corpus.vocab.terms.collect())
    masks = spark.createDataFrame([(0, f, i, t, [i % 2 == 0, False, True]) for f in (0, 1) for i, t in enumerate(terms)],
                                  "run int, fold int, dim int, term string, keep array<boolean>")
    got = {(r.fold, r.cid): r.fitness for r in linear.evaluate_with_linear("LR")(ev, masks, 3).collect()}
    assert got[0, 1] == got[1, 1] == float("inf")
    kept = spark.createDataFrame([(t, f) for f in (0, 1) for t in terms[::2]], "term string, fold int")
    from termsieve.operators.metrics import f1_weighted
    want = {r.fold: 1 - r.f1_weighted for r in f1_weighted(linear.classify_linear("LR", weights, docs, corpus.vocab, 2, kept), ("fold",)).collect()}
    assert all(abs(got[f, 0] - want[f]) < 1e-9 for f in (0, 1))


def test_weights_sent_whole_give_the_same(corpus, design, monkeypatch):
    """State kept by the driver, state stored as rows, and weights joined to tiles: one solution and one prediction."""
    found = []
    for here, whole in ((1 << 20, 1 << 20), (-1, 1 << 20), (-1, -1)):
        monkeypatch.setattr(linear, "DRIVER_BYTES", here)
        monkeypatch.setattr(linear, "BROADCAST_BYTES", whole)
        fitted = linear.fit_linear(design, list(range(FOLDS)), "hinge", max_rounds=7)
        found.append((fitted.value, sorted(map(tuple, linear.predict_linear(design, fitted).collect()), key=repr)))
    for value, preds in found[1:]:
        assert np.allclose(value, found[0][0]) and preds == found[0][1]


def test_a_task_sums_the_gradients_of_its_blocks(corpus, design):
    loss = linear.Loss("softmax", [0], np.ones((1, 3), bool))
    sizes = {r["r"]: r["n"] for r in linear._start(design, loss, None).select("r", "n").collect()}
    x = linear._sent(design, {r: np.zeros((n, 3)).tobytes() for r, n in sizes.items()})
    blocks = design.blocks.coalesce(2)
    parts = blocks.mapInArrow(linear._task_gradients(loss, x), "r int, cols binary, g binary, loss array<double>")
    assert design.n_blocks > 2 and parts.count() <= 2 * len(sizes) < design.tiles.count()


def test_passes_leave_nothing_behind(corpus, design, monkeypatch):
    """A state kept by the driver stores no rows, nor is anything shuffled; stored ones take the place of the last."""
    def files():
        return len(glob.glob(f"{scratch_root(corpus.docs.sparkSession).removeprefix('file:')}/termsieve_*/*.parquet"))

    design.by_range()
    stored, steps = [], []
    monkeypatch.setattr(linear, "_range_gradients", lambda *a: steps.append(a))
    for rounds in (2, 6):
        before = files()
        linear.fit_linear(design, list(range(FOLDS)), "softmax", tolerance=0.0, max_rounds=rounds)
        stored.append(files() - before)
    assert stored[0] == stored[1] and not steps
    monkeypatch.undo()
    monkeypatch.setattr(linear, "DRIVER_BYTES", -1)
    stored = []
    for rounds in (2, 5):
        before = files()
        linear.fit_linear(design, list(range(FOLDS)), "softmax", tolerance=0.0, max_rounds=rounds)
        stored.append(files() - before)
    assert stored[0] == stored[1]
