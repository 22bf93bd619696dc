"""Classifiers of the experiment grid over sparse document vectors.

MNB and NB are the relational models of `bayes`, LR and SVM those of `linear`, DT that of `tree`.
RF is a Spark ML estimator; the driver holds its trees, so its memory has to be sized for that.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, functions as F

from ..runtime import bounded
from . import bayes, linear, tree
from .sample import label_codes
from .vectorize import Vocabulary, to_vectors

CLASSIFIERS = ("LR", "SVM", "NB", "MNB", "DT", "RF")
LINEAR_CLASSIFIERS, ML_CLASSIFIERS = ("LR", "SVM"), ("RF",)
PARALLEL_FITS = 4
# Iterative fits run one job per iteration; tasks with fewer documents than this cost more than they do.
DOCS_PER_TASK = 2_000


def vectors(weights: DataFrame, docs: DataFrame, vocab: Vocabulary, codes: DataFrame) -> DataFrame:
    """(doc_id, label, label_idx, features); a label without a code gets -1."""
    coded = docs.join(codes, "label", "left").withColumn(
        "label_idx", F.coalesce("label_idx", F.lit(-1)).cast("double"))
    return to_vectors(weights, coded, vocab)


def _columns(name: str) -> dict:
    return {"labelCol": "label_idx", "featuresCol": "features", "predictionCol": name}


def packed(train: DataFrame, n: int) -> DataFrame:
    """`n` training documents in few partitions if they are few; large inputs stay as they are."""
    return train.coalesce(max(1, n // DOCS_PER_TASK))


def fit_forest(train: DataFrame, n: int, seed: int, n_classes: int):
    return RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed, **_columns("_p")).fit(packed(train, n))


_FITS = {"RF": fit_forest}


def predict_ml(name: str, train: DataFrame, test: DataFrame, codes: DataFrame, seed: int = 123) -> DataFrame:
    """(doc_id, y, p) of one ML classifier on vector relations."""
    raw = _FITS[name](train, train.count(), seed, codes.count()).transform(test).select("doc_id", "label", "_p")
    back = codes.select(F.col("label_idx").cast("double").alias("_p"), F.col("label").alias("p"))
    return raw.join(back, "_p").select("doc_id", F.col("label").alias("y"), "p")


def classify(name: str, train: DataFrame, train_docs: DataFrame, test: DataFrame, test_docs: DataFrame,
             vocab: Vocabulary, seed: int = 123) -> DataFrame:
    """(doc_id, y, p) of the named classifier on a hold-out split."""
    return classify_all(train, train_docs, test, test_docs, vocab, seed, (name,)).drop("classifier")


def classify_all(train: DataFrame, train_docs: DataFrame, test: DataFrame, test_docs: DataFrame, vocab: Vocabulary,
                 seed: int = 123, classifiers: tuple[str, ...] = CLASSIFIERS) -> DataFrame:
    """(classifier, doc_id, y, p) of each classifier; vectors are built once for all of them."""
    runs = {}
    if "MNB" in classifiers:
        runs["MNB"] = bayes.classify_multinomial_nb(train, train_docs, test, test_docs, vocab).drop("fold")
    if "NB" in classifiers:
        runs["NB"] = bayes.classify_gaussian_nb(train, train_docs, test, test_docs, vocab).drop("fold")
    for name in classifiers:
        if name in LINEAR_CLASSIFIERS or name == "DT":
            # The test documents are the fold that the only training set leaves out.
            both = [a.select(*names, F.lit(1).alias("fold")).unionByName(b.select(*names, F.lit(0).alias("fold")))
                    for a, b, names in ((train, test, ("doc_id", "term", "w")), (train_docs, test_docs, ("doc_id", "label")))]
            runs[name] = (tree.classify_tree(*both, 1) if name == "DT" else linear.classify_linear(name, *both, vocab, 1)).drop("fold")
    wanted = [c for c in classifiers if c in ML_CLASSIFIERS]
    if wanted:
        codes = bounded(label_codes(train_docs))
        train_v = vectors(train, train_docs, vocab, codes)
        test_v = vectors(test, test_docs, vocab, codes)
        for name in wanted:
            runs[name] = predict_ml(name, train_v, test_v, codes, seed)
    out = None
    for name in classifiers:
        one = runs[name].select(F.lit(name).alias("classifier"), "doc_id", "y", "p")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_with_classifier(name: str, seed: int = 123):
    """Fitness function for `search` with the named classifier.

    LR and SVM solve all candidates together. DT and RF are fitted per candidate, run and fold, a few at a time.
    """
    from .metrics import f1_weighted

    if name in LINEAR_CLASSIFIERS:
        return linear.evaluate_with_linear(name)

    def evaluate(ev, masks: DataFrame, size: int, n_runs: int = 1) -> DataFrame:
        labelled = ev.weights.join(ev.docs.select("doc_id", "label"), "doc_id")
        jobs = [(r, f, c) for r in range(n_runs) for f in range(ev.n_folds) for c in range(size)]

        def one(job):
            run, fold, cid = job
            kept = masks.where((F.col("run") == run) & (F.col("fold") == fold) & F.col("keep")[cid]).select("term")
            vocab = ev.vocab.restrict(kept)
            if vocab.n_terms == 0:
                return (run, fold, cid, float("inf"))
            entries = labelled.join(vocab.terms.select("term"), "term", "left_semi")
            inside, outside = F.col("fold") == fold, F.col("fold") != fold
            preds = classify(name, entries.where(outside).drop("fold"), ev.docs.where(outside).drop("fold"),
                             entries.where(inside).drop("fold"), ev.docs.where(inside).drop("fold"), vocab, seed)
            return (run, fold, cid, 1.0 - f1_weighted(preds).first()[0])

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            rows = list(pool.map(one, jobs))
        return masks.sparkSession.createDataFrame(rows, "run int, fold int, cid int, fitness double")

    return evaluate
