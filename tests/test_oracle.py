"""A cross-section of registered queries against their check SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences
from tests.conftest import SF

SAMPLE = ["clean_short_text", "linguistic_tokens", "scan_by_category", "class_distribution", "half_per_class",
          "pool_splits", "char_ngrams", "linguistic_terms", "tfidf_l2", "transform_with_vocabulary",
          "stratified_folds_shuffled", "kfold_shuffled", "chi2_scores_by_fold", "mutual_info_presence",
          "mutual_info_binned", "mutual_info_neighbors", "select_k_best", "k_sweep", "classify_multinomial_nb", "classify_gaussian_nb",
          "classification_report", "evaluate_population", "evaluate_population_gaussian", "vote_features", "step_de"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_sql_has_a_query():
    from oracles import ORACLES
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
