"""Naive Bayes classifiers as relational aggregates over the sparse term relation.

A model exists per training set `fold`; -1 stands for a single one. With `n_folds`, train
and test are the same relations and each document is scored by the model trained without
its fold. Scoring starts from the documents, so one without any known term is predicted
too. Class parts of a document are summed where its entries lie, then compared in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import bounded, broadcast_if, materialize
from .filters import class_table, explode_folds, outside, term_class_sums
from .vectorize import Vocabulary, join_on_term, join_stored

# Scores are compared at this many digits, then by label, so that float summation
# order cannot change a prediction.
SCORE_DIGITS = 6


def _fold(n_folds: int | None) -> Column:
    return (F.col("fold") if n_folds is not None else F.lit(-1)).alias("fold")


def predict(test_docs: DataFrame, n_folds: int | None, cells: DataFrame, model: DataFrame, score) -> DataFrame:
    """(fold, doc_id, y, p): label of the highest score, the smaller one on ties.

    `cells` holds (doc_id, label, a): summed parts per class, and under a null label the
    summed weight of the document. `model` holds class rows per fold, and
    `score(class, part, weight)` is a Column.
    """
    per_doc = cells.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("a"))), F.lit(0.0)).alias("_w"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "a")))).alias("_a"))
    fields = [c for c in model.columns if c not in ("fold", "label")]
    classes = model.groupBy("fold").agg(F.collect_list(F.struct("label", *fields)).alias("_m"))
    docs = test_docs.select("doc_id", F.col("label").alias("y"), _fold(n_folds))
    rows = docs.join(per_doc, "doc_id", "left").join(bounded(classes), "fold")
    weight = F.coalesce("_w", F.lit(0.0))
    best = F.array_min(F.transform("_m", lambda m: F.struct(
        (-F.round(score(m, F.coalesce(F.try_element_at("_a", m["label"]), F.lit(0.0)), weight), SCORE_DIGITS)).alias("s"),
        m["label"].alias("l"))))
    return rows.select("fold", "doc_id", "y", best["l"].alias("p"))


def classify_multinomial_nb(train: DataFrame, train_docs: DataFrame, test: DataFrame, test_docs: DataFrame,
                            vocab: Vocabulary, n_folds: int | None = None,
                            selected: DataFrame | None = None, n_selected: int | None = None) -> DataFrame:
    """(fold, doc_id, y, p) of a multinomial model with add-one smoothing.

    Per class, the score of a document is prior + sum(w * ln(s + 1)) - sum(w) * ln(S + V).
    Terms a class never saw give ln(1) = 0, so only observed cells are joined.
    `selected` restricts each fold to its own (fold, term) rows, `n_selected` per fold.
    """
    stats = term_class_sums(train, n_folds)
    entries = test.select("doc_id", _fold(n_folds), "term", "w")
    if selected is not None:
        kept = materialize(selected.select("fold", "term"))
        n_kept = kept.count()
        stats = stats.join(broadcast_if(kept, n_kept), ["fold", "term"], "left_semi")
        entries = join_stored(entries, kept, n_kept, ["fold", "term"], "left_semi")
    # Read twice below, and far smaller than the entries.
    stats = materialize(stats)
    totals = stats.groupBy("fold", "label").agg(F.sum("s").alias("_all"))
    model = class_table(train_docs, n_folds).join(totals, ["fold", "label"], "left").select(
        "fold", "label", F.log(F.col("n_label") / F.col("n_docs")).alias("prior"),
        F.log(F.coalesce("_all", F.lit(0.0)) + (n_selected or vocab.n_terms)).alias("norm"))
    logs = stats.groupBy("fold", "term").agg(
        F.collect_list(F.struct("label", F.log(F.col("s") + 1.0).alias("l"))).alias("_l"))
    weight = F.array(F.struct(F.lit(None).cast(stats.schema["label"].dataType).alias("label"), F.lit(1.0).alias("l")))
    parts = F.explode(F.concat(F.coalesce("_l", F.array().cast("array<struct<label:%s,l:double>>" % (
        stats.schema["label"].dataType.simpleString()))), weight))
    cells = join_on_term(entries, logs, vocab, ["fold", "term"], n_folds or 1, how="left", back="doc_id") \
        .select("doc_id", "w", parts.alias("_p")) \
        .groupBy("doc_id", F.col("_p.label").alias("label")).agg(F.sum(F.col("w") * F.col("_p.l")).alias("a"))
    return predict(test_docs, n_folds, cells, model, lambda m, a, w: m["prior"] + a - w * m["norm"])


def gaussian_model(train: DataFrame, train_docs: DataFrame, vocab: Vocabulary, n_folds: int | None = None,
                   smoothing: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Model rows (fold, label, prior, base, eps) and term rows (fold, term, _m: label -> mu, var).

    Weights absent from the relation are zeros and count in means and variances. `base` is
    the log density of a document without terms; `eps` is the smoothing times the largest
    variance of a term over all training documents.
    """
    classes = bounded(class_table(train_docs, n_folds))
    grouped = train.groupBy("term", "label")
    square = F.col("w") * F.col("w")
    if n_folds is None:
        sums = grouped.agg(F.sum("w").alias("s"), F.sum(square).alias("q")).withColumn("fold", F.lit(-1))
    else:
        sums = explode_folds(grouped.agg(*outside("s", F.col("w"), n_folds), *outside("q", square, n_folds)),
                             ["s", "q"], n_folds)
    sums = materialize(sums.join(classes, ["fold", "label"]))
    mean = F.sum("s") / F.first("n_docs")
    overall = sums.groupBy("fold", "term").agg((F.sum("q") / F.first("n_docs") - mean * mean).alias("_v"))
    eps = bounded(overall.groupBy("fold").agg((F.max("_v") * smoothing).alias("eps")))
    mu = F.col("s") / F.col("n_label")
    cells = sums.join(eps, "fold").select(
        "fold", "term", "label", mu.alias("mu"),
        (F.greatest(F.col("q") / F.col("n_label") - mu * mu, F.lit(0.0)) + F.col("eps")).alias("var"))
    at_zero = -0.5 * F.log(2.0 * F.pi() * F.col("var")) - F.col("mu") * F.col("mu") / (2.0 * F.col("var"))
    observed = cells.groupBy("fold", "label").agg(F.sum(at_zero).alias("_seen"), F.count("*").alias("_n"))
    model = classes.join(eps, "fold").join(observed, ["fold", "label"], "left").select(
        "fold", "label", "eps", F.log(F.col("n_label") / F.col("n_docs")).alias("prior"),
        (F.coalesce("_seen", F.lit(0.0)) - (vocab.n_terms - F.coalesce("_n", F.lit(0)))
         * 0.5 * F.log(2.0 * F.pi() * F.col("eps"))).alias("base"))
    # One entry per class in which the term occurs.
    terms = cells.groupBy("fold", "term").agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("mu", "var")))).alias("_t"))
    return bounded(model), terms


def classify_gaussian_nb(train: DataFrame, train_docs: DataFrame, test: DataFrame, test_docs: DataFrame,
                         vocab: Vocabulary, n_folds: int | None = None, smoothing: float = 1e-9) -> DataFrame:
    """(fold, doc_id, y, p) of a Gaussian model with per-class variances."""
    model, terms = gaussian_model(train, train_docs, vocab, n_folds, smoothing)
    entries = test.select("doc_id", _fold(n_folds), "term", "w")
    # A class that never saw a term has mean 0 and variance eps there. Only observed cells are joined: their
    # own parts are summed, and their squares are taken out of the document's, which count at mean 0.
    w, kind = F.col("w"), train_docs.schema["label"].dataType.simpleString()
    none = F.struct(F.lit(None).cast(kind).alias("key"), F.struct(F.lit(None).cast("double").alias("mu"), F.lit(None).cast("double").alias("var")).alias("value"))
    seen = F.coalesce(F.map_entries("_t"), F.array().cast(f"array<struct<key:{kind},value:struct<mu:double,var:double>>>"))
    cells = join_on_term(entries, terms, vocab, ["fold", "term"], n_folds or 1, how="left", back="doc_id") \
        .select("doc_id", "w", F.explode(F.concat(seen, F.array(none))).alias("_c")) \
        .groupBy("doc_id", F.col("_c.key").alias("label")).agg(
            F.sum((2.0 * w * F.col("_c.value.mu") - w * w) / (2.0 * F.col("_c.value.var"))).alias("a"),
            F.sum(w * w).alias("q"), F.count("*").alias("n"))
    per_doc = cells.groupBy("doc_id").agg(
        F.max(F.when(F.col("label").isNull(), F.struct("q", "n"))).alias("_all"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", F.struct("a", "q", "n"))))).alias("_a"))
    classes = model.groupBy("fold").agg(F.collect_list(F.struct("label", "eps", "prior", "base")).alias("_m"))
    docs = test_docs.select("doc_id", F.col("label").alias("y"), _fold(n_folds))
    rows = docs.join(per_doc, "doc_id", "left").join(bounded(classes), "fold")

    def score(m):
        own = F.try_element_at("_a", m["label"])
        n, q = F.coalesce(own["n"], F.lit(0)), F.coalesce(own["q"], F.lit(0.0))
        missing = F.when(F.coalesce("_all.n", F.lit(0)) > n, (F.col("_all.q") - q) / (2.0 * m["eps"])).otherwise(0.0)
        return F.round(m["prior"] + m["base"] + F.coalesce(own["a"], F.lit(0.0)) - missing, SCORE_DIGITS)

    best = F.array_min(F.transform("_m", lambda m: F.struct((-score(m)).alias("s"), m["label"].alias("l"))))
    return rows.select("fold", "doc_id", "y", best["l"].alias("p"))
