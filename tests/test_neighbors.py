"""Nearest-neighbour mutual information against distances between all points."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termsieve.operators import neighbors
from termsieve.operators.neighbors import digamma, mutual_info_neighbors
from termsieve.runtime import running_sum


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def brute(docs, entries, k=3):
    """docs {id: label}, entries {(id, term): w}; scores per term from all pairs of documents."""
    sizes = Counter(docs.values())
    ids = [d for d in docs if sizes[docs[d]] > 1]
    scores = {}
    for term in {t for (d, t), w in entries.items() if d in ids and round(w * 1e9)}:
        v = {d: round(entries.get((d, term), 0) * 1e9) for d in ids}
        total = 0.0
        for d in ids:
            near = min(k, sizes[docs[d]] - 1)
            same = sorted(abs(v[d] - v[e]) for e in ids if e != d and docs[e] == docs[d])
            r = same[near - 1]
            if r == 0:
                near = sum(docs[e] == docs[d] and v[e] == v[d] for e in ids)
            m = sum(abs(v[d] - v[e]) < r if r else v[e] == v[d] for e in ids)
            total += psi(near) - psi(sizes[docs[d]]) - psi(m)
        scores[term] = max(0.0, psi(len(ids)) + total / len(ids))
    return scores


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(5)
    labels = ["a"] * 40 + ["b"] * 15 + ["c"] * 3 + ["d"] * 2 + ["alone"]
    docs = dict(enumerate(labels))
    entries = {}
    for d, label in docs.items():
        entries[d, "everywhere"] = float(rng.uniform(0.1, 1)) + (label == "b")
        entries[d, "always one"] = 1.0
        if label == "a":
            entries[d, "one class"] = float(rng.integers(1, 4)) / 4
        if rng.random() < 0.5:
            entries[d, "half"] = float(rng.normal())
        if rng.random() < 0.1:
            entries[d, "rare"] = float(rng.uniform())
    entries[60, "only alone"] = 0.5
    entries[59, "once"] = 0.5
    return docs, entries


def frames(spark, docs, entries):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, label string")
    w = spark.createDataFrame([(i, t, x) for (i, t), x in entries.items()], "doc_id long, term string, w double").join(d, "doc_id")
    return w, d


@pytest.mark.parametrize("options", [{}, {"run_length": 4, "window_rows": 5}])
def test_equals_all_pairs(spark, case, options):
    w, d = frames(spark, *case)
    got = {r.term: r.score for r in mutual_info_neighbors(w, d, **options).collect()}
    want = brute(*case)
    assert got.keys() == want.keys() and "only alone" not in got
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
    assert got["always one"] < 1e-9 and got["one class"] > 0.3


@pytest.mark.parametrize("options", [{"task_entries": 0}, {"task_entries": 0, "run_length": 4, "window_rows": 5}])
def test_terms_too_large_for_a_task_get_the_same_scores(spark, case, options):
    w, d = frames(spark, *case)
    got = {r.term: r.score for r in mutual_info_neighbors(w, d, **options).collect()}
    want = brute(*case)
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)


def test_entries_are_shuffled_once_and_not_stored(spark, case, monkeypatch, capsys):
    monkeypatch.setattr(neighbors, "materialize", None)
    monkeypatch.setattr(neighbors, "BLOCK_CELLS", 30)
    w, d = frames(spark, *case)
    w, d = w.localCheckpoint(), d.localCheckpoint()
    found = mutual_info_neighbors(w, d)
    found.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(term") == 1
    want = brute(*case)
    assert {r.term: round(r.score, 9) for r in found.collect()} == {t: round(x, 9) for t, x in want.items()}


def test_no_entries(spark, case):
    w, d = frames(spark, *case)
    assert mutual_info_neighbors(w.limit(0), d).count() == 0
    assert mutual_info_neighbors(w.limit(0), d.limit(0)).count() == 0


def test_digamma(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 9, 10, 11, 500, 10_000)], "n long").select("n", digamma(F.col("n")).alias("p")).collect()
    assert all(math.isclose(r.p, psi(r.n), abs_tol=1e-10) for r in rows)


@pytest.mark.parametrize("rows", [None, 10])
def test_running_sum(spark, rows):
    data = [("x" if i % 3 else "y", i // 4, i) for i in range(200)]
    got = running_sum(spark.createDataFrame(data, "g string, at long, n long"), ["g"], [F.col("at")], "n", "s", window_rows=rows).collect()
    assert len(got) == 200
    assert all(r.s == sum(n for g, at, n in data if g == r.g and at <= r.at) for r in got)
