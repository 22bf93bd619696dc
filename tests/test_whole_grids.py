"""Registered grids run whole: every classifier, population size and evaluation."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracles.scores import SCHEMES_MNB
from termsieve.operators.classify import CLASSIFIERS
from termsieve.plans import catalog, experiments, wrapper
from tests.compare import differences
from tests.conftest import SF


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("grids"))
    words = ["red apple pie", "green tea leaf", "blue sea wave"]
    rows = [(i, f"{words[i % 3]} {words[i % 3]} all w{i % 4}", "abc"[i % 3], f"src{i % 2}", 20) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_scheme_grid_has_every_classifier(spark, folder, monkeypatch):
    seen = []

    def run(corpus, classifiers, *rest):
        seen.append(tuple(classifiers))
        return corpus.part("test")[1].select(F.explode(F.array(*map(F.lit, classifiers))).alias("classifier"), "doc_id", F.col("label").alias("y"), F.col("label").alias("p"))

    monkeypatch.setattr(experiments, "holdout_run", run)
    got = entry.queries()["scheme_grid"](spark, folder).collect()
    assert seen == [CLASSIFIERS] * 6
    assert {(r["scheme"], r["classifier"]) for r in got} == {(s, c) for s in experiments.SCHEMES for c in CLASSIFIERS} and len(got) == 36


def test_multinomial_rows_of_the_scheme_grid_match_sql(spark, duck):
    got = experiments.scheme_grid(catalog.split_docs(spark, SF), ("MNB",)).withColumn("accuracy", F.round("accuracy", 6)).toPandas()
    assert differences(got, duck.execute(SCHEMES_MNB).df()) == ""


def test_population_sizes_run_to_their_budget(spark, folder, monkeypatch):
    asked = []

    def select(weights, docs, vocab, method, size, budget, n_runs, n_folds, *rest):
        # The searches themselves are tested elsewhere.
        asked.append((method, size, budget, n_runs, n_folds))
        return vocab.indexed().select(F.col("idx").alias("dim"), "term", F.lit(1).alias("score"))

    monkeypatch.setattr(wrapper, "select_features", select)
    got = entry.queries()["population_size_sweep"](spark, folder).collect()
    sizes = [10, 30, 50, 100, 150, 200, 300, 500, 750, 1000]
    assert asked == [("cuckoo", s, 1000, 4, 2) for s in sizes] and sorted(r["size"] for r in got) == sizes
