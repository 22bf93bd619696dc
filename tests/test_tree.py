"""Trees grown from the term relation against a plain CART over dense rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termsieve.operators import metrics, split, tree
from termsieve.plans.corpus import build_corpus

FOLDS = 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = {"x": "red apple pie", "y": "blue metal car", "z": "green leaf tree"}
    rows = [(i, " ".join(rng.choices(words[label].split(), k=2) + rng.choices("red metal tree common every day".split(), k=6)), label)
            for i, label in ((i, "xyz"[i % 3]) for i in range(42))]
    rows += [(60, "", "y"), (61, None, "z"), (62, "unseen", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return build_corpus(docs.join(split.stratified_folds(docs, FOLDS).select("doc_id", "fold"), "doc_id"), min_df=2)


def dense(corpus):
    docs = sorted(corpus.docs.collect(), key=lambda r: r.doc_id)
    terms = sorted(r.term for r in corpus.vocab.terms.collect())
    x = np.zeros((len(docs), len(terms)))
    at = {d.doc_id: i for i, d in enumerate(docs)}
    for e in corpus.weights.collect():
        x[at[e.doc_id], terms.index(e.term)] = round(e.w, tree.DIGITS)
    return x, np.array(["xyz".index(d.label) for d in docs]), np.array([d.fold for d in docs]), [d.doc_id for d in docs], terms


def purity(y):
    n = np.bincount(y, minlength=3)
    return (n * n).sum() / n.sum()


def brute(x, y, terms, rows, path="", out=None):
    out = {} if out is None else out
    best = None
    for j in range(x.shape[1]) if len(set(y[rows])) > 1 else []:
        values = np.unique(x[rows, j])
        for low, high in zip(values, values[1:]):
            right = rows[x[rows, j] >= high]
            left = np.setdiff1d(rows, right)
            score = round(purity(y[right]) + purity(y[left]), 6)
            key = (-score, terms[j], -high)
            if score > purity(y[rows]) + 1e-6 and (best is None or key < best[0]):
                best = (key, (low + high) / 2, left, right)
    out[path] = (tuple(np.bincount(y[rows], minlength=3)), best and best[0][1], best and round(best[1], 9), best and -best[0][0])
    if best:
        brute(x, y, terms, best[2], path + "l", out)
        brute(x, y, terms, best[3], path + "r", out)
    return out


def test_trees_equal_plain_cart(corpus):
    x, y, fold, ids, terms = dense(corpus)
    grown = tree.grow(corpus.weights, corpus.docs, FOLDS)
    preds = {(r.fold, r.doc_id): r.p for r in tree.predict_trees(grown).collect()}
    assert len(preds) == len(ids)
    nodes = grown.nodes.collect()
    for f in range(FOLDS):
        want = brute(x, y, terms, np.flatnonzero(fold != f))
        got = {r.node: (tuple(r.n), r.term, r.threshold and round(r.threshold, 9), r.score) for r in nodes if r.set == f and sum(r.n)}
        assert got == want
        for i in np.flatnonzero(fold == f):
            path = ""
            while want[path][1]:
                path += "r" if x[i, terms.index(want[path][1])] > want[path][2] else "l"
            assert preds[f, ids[i]] == "xyz"[int(np.argmax(want[path][0]))]


@pytest.mark.parametrize("task_entries,max_depth", [(100, 3), (0, 2)])
def test_large_nodes_by_columns(corpus, monkeypatch, task_entries, max_depth):
    """Trees grown from entries by term, without a shuffle per level, are those of the joins."""
    def rows(grown):
        return [sorted(map(str, df.collect())) for df in (grown.nodes, grown.places.select("set", "doc_id", "y", "test", "node"))] + [grown.depth]

    calls, real = [], tree._best_splits
    monkeypatch.setattr(tree, "_best_splits", lambda *a: calls.append(a) or real(*a))
    got = rows(tree.grow(corpus.weights, corpus.docs, FOLDS, max_depth=max_depth, task_entries=task_entries))
    assert not calls
    monkeypatch.setattr(tree, "COLUMN_DOCS", 1)
    assert got == rows(tree.grow(corpus.weights, corpus.docs, FOLDS, max_depth=max_depth, task_entries=task_entries)) and calls


def test_depth_can_be_limited(corpus):
    grown = tree.grow(corpus.weights, corpus.docs, FOLDS, max_depth=1)
    assert grown.depth == 1 and grown.nodes.agg(F.max(F.length("node"))).first()[0] == 1


def test_forest_draws_documents_and_terms(corpus):
    grown = tree.grow(corpus.weights, corpus.docs, FOLDS, n_trees=6, subset=0.4, bootstrap=True, max_depth=2)
    roots = grown.nodes.where("node = ''").collect()
    assert len(roots) == 6 * FOLDS and len({tuple(r.n) for r in roots}) > 3 and len({r.term for r in roots}) > 2
    preds = tree.predict_trees(grown, 6)
    assert preds.count() == corpus.docs.count() and preds.where("p IS NULL").count() == 0
    again = tree.predict_trees(tree.grow(corpus.weights, corpus.docs, FOLDS, n_trees=6, subset=0.4, bootstrap=True, max_depth=2), 6)
    assert sorted(preds.collect()) == sorted(again.collect())
    assert metrics.accuracy(preds).first()[0] > 0.5


def test_one_class_and_unseen_classes(spark):
    rows = [(i, "a b", "p", 1) for i in range(4)] + [(20, "a b", "q", 0), (21, None, "p", 0)]
    c = build_corpus(spark.createDataFrame(rows, "doc_id long, text string, label string, fold int"), min_df=1)
    got = tree.classify_tree(c.weights, c.docs, 1).collect()
    assert {(r.doc_id, r.y, r.p) for r in got} == {(20, "q", "p"), (21, "p", "p")}
