"""End-to-end runs: baselines, filter selection, k sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.bayes import classify_gaussian_nb, classify_multinomial_nb
from ..operators.classify import CLASSIFIERS, LINEAR_CLASSIFIERS, classify_all
from ..operators.filters import (apply_selection, chi2_scores, class_table, mutual_info_presence, rank_terms,
                                 select_k_best, term_class_sums)
from ..operators.linear import classify_linear, prepare_design
from ..operators.metrics import accuracy, all_scores, fold_average, method_comparison
from ..operators.sample import label_codes
from ..operators.split import stratified_folds
from ..operators.tree import classify_tree
from ..operators.vectorize import join_on_term
from ..runtime import bounded, materialize
from .corpus import Corpus, build_corpora

BAYES = {"MNB": classify_multinomial_nb, "NB": classify_gaussian_nb}


def with_folds(docs: DataFrame, k: int = 5, seed: int | None = None) -> DataFrame:
    """Documents with their stratified `fold`."""
    folds = materialize(stratified_folds(docs, k, seed).select("doc_id", "fold"))
    return docs.join(folds, "doc_id")


def classify_over_folds(corpus: Corpus, classifier: str, n_folds: int) -> DataFrame:
    """(classifier, fold, doc_id, y, p): every document scored by the model of the other folds."""
    if classifier in LINEAR_CLASSIFIERS:
        # Both linear classifiers read the same tiles.
        if not hasattr(corpus, "design"):
            corpus.design = prepare_design(corpus.weights, corpus.docs, corpus.vocab)
        return classify_linear(classifier, corpus.weights, corpus.docs, corpus.vocab, n_folds, design=corpus.design).withColumn("classifier", F.lit(classifier))
    if classifier == "DT":
        return classify_tree(corpus.weights, corpus.docs, n_folds).withColumn("classifier", F.lit(classifier))
    preds = BAYES[classifier](corpus.weights, corpus.docs, corpus.weights, corpus.docs, corpus.vocab, n_folds)
    return preds.withColumn("classifier", F.lit(classifier))


def baseline_all_features(corpus: Corpus, n_folds: int = 5, classifiers: tuple[str, ...] = ("MNB", "NB")) -> DataFrame:
    """(classifier, avg_accuracy) over folds with every feature."""
    runs = [classify_over_folds(corpus, c, n_folds) for c in classifiers]
    preds = runs[0]
    for run in runs[1:]:
        preds = preds.unionByName(run)
    return fold_average(accuracy(preds, ("classifier", "fold")), "accuracy", ("classifier",))


SCORES = {"chi2": chi2_scores, "mi": mutual_info_presence}


# Documents of one fold that are judged together, on average.
SHARD_DOCS = 4_096


def _shard_hits(step: int, n_classes: int):
    """(fold, k, hits, n): documents of a shard that the model on the k best terms gets right, for every k."""
    def judge(key: tuple, rows: pa.Table, sides: pa.Table) -> pa.Table:
        if not len(sides):
            return _HITS.empty_table()
        norms = {c: (p, np.array(v)) for c, p, v in zip(sides["c"].to_pylist(), sides["prior"].to_pylist(), sides["norm"].to_pylist(), strict=True)}
        last = len(next(iter(norms.values()))[1])
        ids, slot, w = rows["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["slot"].to_numpy(), rows["w"].to_numpy()
        cs, logs = rows["cs"].combine_chunks(), rows["ls"].combine_chunks()
        parts = np.zeros((len(rows), n_classes))
        at = np.repeat(np.arange(len(rows)), pc.list_value_length(cs).to_numpy())
        np.add.at(parts, (at, cs.flatten().to_numpy()), logs.flatten().to_numpy() * w[at])
        # A document's rows in the order of their terms' ranks; before them its labels, class c in slot -1 - c.
        order = np.lexsort((slot, ids))
        ends = np.flatnonzero(np.diff(ids[order], append=-1)) + 1
        hits, n, begin = np.zeros(last, np.int64), 0, 0
        for end in ends:
            own, begin = order[begin:end], end
            terms, labels = own[slot[own] > 0], -1 - slot[own]
            labels = labels[labels >= 0]
            if not len(labels):
                continue
            spans = np.diff(np.concatenate(([1], slot[terms], [last + 1])))
            weight = np.repeat(np.concatenate(([0.0], np.cumsum(w[terms]))), spans)
            sums = np.concatenate((np.zeros((1, n_classes)), np.cumsum(parts[terms], axis=0)))
            best, p = np.full(last, -np.inf), np.full(last, -1)
            for c in sorted(norms):
                prior, norm = norms[c]
                score = prior + np.repeat(sums[:, c], spans) - weight * norm
                score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5), score)
                better = score > best
                best[better], p[better] = score[better], c
            for label in labels:
                hits += p == label
            n += len(labels)
        return pa.table({"fold": pa.array(np.full(last, key[0].as_py()), pa.int32()), "k": pa.array(np.arange(1, last + 1) * step, pa.int32()),
                         "hits": pa.array(hits), "n": pa.array(np.full(last, n), pa.int64())})
    return judge


_HITS = pa.schema([("fold", pa.int32()), ("k", pa.int32()), ("hits", pa.int64()), ("n", pa.int64())])


def k_sweep_hits(corpus: Corpus, n_folds: int, step: int = 10, score: str = "chi2", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(fold, k, hits, n) of multinomial models on the k best terms, k = step, 2*step, ... < n: documents of the fold
    that are predicted right, and all.

    Terms are ranked once per fold. A term of rank r enters all models with k >= r, so a
    document's class parts are running sums over its own terms in rank order, and only the
    class totals depend on k alone. Documents of a fold are dealt to shards, and each shard gets the class totals of
    every k: its documents are judged for all k at once, and only its hits per k leave the task.
    """
    n = corpus.vocab.n_terms
    last = (n - 1) // step                      # number of grid points k < n
    ranks = rank_terms(SCORES[score](corpus.weights, corpus.docs, n_folds))
    slot = F.ceil(F.col("rank") / step).cast("int")
    slots = materialize(ranks.select("fold", "term", slot.alias("slot")).where(F.col("slot") <= last))
    codes = bounded(label_codes(corpus.docs.where("label IS NOT NULL")).select("label", F.col("label_idx").alias("c")))
    stats = materialize(term_class_sums(corpus.weights, n_folds).join(codes, "label").join(slots, ["fold", "term"]))
    classes = class_table(corpus.docs, n_folds).join(codes, "label")
    grid = classes.select("fold", "c", F.log(F.col("n_label") / F.col("n_docs")).alias("prior"),
                          F.explode(F.sequence(F.lit(1), F.lit(last))).alias("slot") if last else F.explode(F.array().cast("array<int>")).alias("slot"))
    running = Window.partitionBy("fold", "c").orderBy("slot")
    added = stats.groupBy("fold", "c", "slot").agg(F.sum("s").alias("_s"))
    norms = grid.join(added, ["fold", "c", "slot"], "left").select(
        "fold", "c", "slot", "prior",
        F.log(F.sum(F.coalesce("_s", F.lit(0.0))).over(running) + F.col("slot") * step).alias("norm"))
    # One row per fold and class, repeated for each shard.
    norms = materialize(norms.groupBy("fold", "c", "prior").agg(F.array_sort(F.collect_list(F.struct("slot", "norm")))["norm"].alias("norm")))
    logs = stats.groupBy("fold", "term", "slot").agg(F.collect_list(F.struct("c", F.log(F.col("s") + 1.0).alias("l"))).alias("_l")) \
        .select("fold", "term", "slot", F.col("_l.c").alias("cs"), F.col("_l.l").alias("ls"))
    hits = join_on_term(corpus.weights.select("doc_id", "fold", "term", "w"), logs, corpus.vocab,
                        ["fold", "term"], n_folds)
    labelled = corpus.docs.select("fold", "doc_id").distinct().join(corpus.docs.select("doc_id", "label"), "doc_id") \
        .join(codes, "label").select("fold", "doc_id", (-1 - F.col("c")).alias("slot"), F.lit(0.0).alias("w"),
                                     F.array().cast("array<int>").alias("cs"), F.array().cast("array<double>").alias("ls"))
    n_shards = max(1, -(-corpus.vocab.n_docs // (n_folds * shard_docs)))
    rows = labelled.unionByName(hits.select(*labelled.columns)).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    sides = norms.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    found = rows.groupBy("fold", "b").cogroup(sides.groupBy("fold", "b")).applyInArrow(
        _shard_hits(step, codes.count()), "fold int, k int, hits long, n long")
    return found.groupBy("fold", "k").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def k_sweep(corpus: Corpus, n_folds: int, step: int = 10, score: str = "chi2") -> DataFrame:
    """(k, classifier, avg_accuracy): mean over folds for every k of the grid."""
    hits = k_sweep_hits(corpus, n_folds, step, score)
    per_fold = hits.select("k", "fold", (F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("accuracy"))
    return fold_average(per_fold, "accuracy", ("k",)) \
        .select("k", F.lit("MNB").alias("classifier"), "avg_accuracy")


def holdout_bayes(corpus: Corpus, classifier: str = "MNB", k: int | None = None, score: str = "chi2") -> DataFrame:
    """(doc_id, y, p) on test documents, after keeping the k best terms of the train ones."""
    train, train_docs = corpus.part("train")
    test, test_docs = corpus.part("test")
    vocab = corpus.vocab
    if k is not None:
        selected = materialize(select_k_best(SCORES[score](train, train_docs), min(k, vocab.n_terms)))
        train, test = apply_selection(train, selected), apply_selection(test, selected)
        vocab = vocab.restrict(selected)
    return BAYES[classifier](train, train_docs, test, test_docs, vocab).drop("fold")


def filter_over_folds(corpus: Corpus, n_folds: int, k: int, score: str = "chi2", classifier: str = "MNB") -> DataFrame:
    """Accuracy and F1 averages per fold, each fold with the k best terms of its training set."""
    k = min(k, corpus.vocab.n_terms)
    selected = select_k_best(SCORES[score](corpus.weights, corpus.docs, n_folds), k)
    if classifier in LINEAR_CLASSIFIERS:
        preds = classify_linear(classifier, corpus.weights, corpus.docs, corpus.vocab, n_folds, materialize(selected))
    else:
        preds = classify_multinomial_nb(corpus.weights, corpus.docs, corpus.weights, corpus.docs, corpus.vocab,
                                        n_folds, selected, k)
    return all_scores(preds, ("fold",))


def fixed_k_run(corpus: Corpus, k: int, classifier: str = "MNB", score: str = "chi2") -> DataFrame:
    """Accuracy and F1 averages of one hold-out run with the k best terms."""
    return all_scores(holdout_bayes(corpus, classifier, k, score)).withColumn("k", F.lit(min(k, corpus.vocab.n_terms)))


# Term weighting schemes compared on a hold-out split: analyzer and weighting.
SCHEMES = {
    "bow_tf-idf": ("linguistic", "tfidf"), "bow_tf": ("linguistic", "tf"), "bow_binary": ("linguistic", "binary"),
    "3tf-idf": ("char3", "tfidf"), "3tf": ("char3", "tf"), "3binary": ("char3", "binary"),
}


def holdout_run(corpus: Corpus, classifiers: tuple[str, ...], k: int | None = None, score: str = "chi2") -> DataFrame:
    """(classifier, doc_id, y, p) on test documents, with all or the k best terms of the train ones."""
    train, train_docs = corpus.part("train")
    test, test_docs = corpus.part("test")
    vocab = corpus.vocab
    if k is not None:
        selected = materialize(select_k_best(SCORES[score](train, train_docs), min(k, vocab.n_terms)))
        train, test = apply_selection(train, selected), apply_selection(test, selected)
        vocab = vocab.restrict(selected)
    return classify_all(train, train_docs, test, test_docs, vocab, classifiers=classifiers)


def scheme_grid(docs: DataFrame, classifiers: tuple[str, ...] = CLASSIFIERS, min_df: int = 3,
                schemes: dict = SCHEMES) -> DataFrame:
    """(scheme, classifier, accuracy) of every weighting scheme on a predefined split."""
    out = None
    for name, corpus in build_corpora(docs, schemes, min_df, fit_on="train"):
        one = accuracy(holdout_run(corpus, classifiers), ("classifier",)).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("scheme", "classifier", "accuracy")


def compare_filters(corpus: Corpus, n_folds: int, k: int, scores: tuple[str, ...] = ("chi2", "mi")) -> DataFrame:
    """(method, avg_accuracy, avg_selected) of filter scores over folds."""
    preds = selected = None
    for name in scores:
        best = materialize(select_k_best(SCORES[name](corpus.weights, corpus.docs, n_folds), min(k, corpus.vocab.n_terms)))
        run = classify_multinomial_nb(corpus.weights, corpus.docs, corpus.weights, corpus.docs, corpus.vocab,
                                      n_folds, best, min(k, corpus.vocab.n_terms)).withColumn("method", F.lit(name))
        kept = best.select(F.lit(name).alias("method"), "fold", "term")
        preds = run if preds is None else preds.unionByName(run)
        selected = kept if selected is None else selected.unionByName(kept)
    return method_comparison(preds, selected)
