"""Wrapper selection: search feature subsets with a population, reduce the runs by vote.

The driver only steps through generations. Per generation, one job moves all populations
(every run and fold at once) and one evaluates them; what comes back is one fitness array
per run and fold. The genes are written to the shared folder between generations.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import steps as S
from ..operators.population import (POP_KEYS, Evaluation, best_per_fold, decode_mask, ensure_nonempty,
                                    evaluate_population, fitness_arrays, gene_dims, init_population,
                                    prepare_evaluation, support_mask, vote_features)
from ..operators.split import kfold_shuffled, stratified_folds
from ..operators.vectorize import Vocabulary
from ..runtime import bounded, materialize
from .corpus import build_corpora
from .experiments import BAYES, SCHEMES

METHODS = ("ga", "gwo", "sca", "abc", "bat", "cuckoo", "de", "harmony", "pso", "firefly")


@dataclass
class SearchResult:
    results: DataFrame    # (run, fold, fitness) of the best candidate of each search
    masks: DataFrame      # (run, fold, dim, term, selected)
    history: list[tuple]  # (generation, run, fold, best fitness so far)
    evaluations: int      # per run and fold


def _genes(pop: DataFrame, column: str) -> DataFrame:
    return pop.select(*POP_KEYS, F.col(column).alias("xs"))


class _Search:
    """State of all searches: populations on disk, fitness arrays as a small local table."""

    def __init__(self, ev: Evaluation, size: int, n_runs: int, seed: int, budget: int, evaluate):
        self.ev, self.size, self.n_runs, self.seed, self.budget = ev, size, n_runs, seed, budget
        self.n_gens = -(-budget // size)
        self.evaluate_masks = evaluate
        pop = init_population(gene_dims(ev.vocab), size, seed, n_runs, ev.n_folds)
        self.pop = materialize(pop.withColumn("top", F.col("xs")[0]))
        self.used = 0
        self.fits = self.evaluate("xs")
        self.best: dict = {}
        self.history: list[tuple] = []
        self.tired: dict = {}

    def evaluate(self, column: str) -> DataFrame:
        """Fitness of as many candidates as the budget has left, the first ones; the others count as the worst."""
        left = min(self.size, self.budget - self.used)
        unjudged = F.array_repeat(F.lit(float("inf")), self.size - left)
        if left == 0:
            return bounded(self.fits.withColumn("fits", unjudged))
        masks = decode_mask(_genes(self.pop, column)).withColumn("keep", F.slice("keep", 1, left))
        self.used += left
        fits = fitness_arrays(self.evaluate_masks(self.ev, masks, left, self.n_runs))
        return bounded(fits.withColumn("fits", F.concat("fits", unjudged)))

    def propose(self, trial: DataFrame) -> DataFrame:
        """Store the moved population and return the fitness of its trial genes."""
        self.pop = materialize(trial)
        return self.evaluate("ys")

    def settle(self, fits: DataFrame) -> None:
        self.fits = bounded(fits)

    def remember(self, gen: int, fits: DataFrame, column: str = "xs") -> None:
        """Keep the genes of the best candidate seen so far in column `top`."""
        spark = self.pop.sparkSession
        rows = []
        for row in fits.collect():
            key, at = (row["run"], row["fold"]), min(range(self.size), key=lambda c: (round(row["fits"][c], 9), c))
            better = key not in self.best or round(row["fits"][at], 9) < round(self.best[key], 9)
            if better:
                self.best[key] = row["fits"][at]
            rows.append((*key, at if better else -1))
            self.history.append((gen, *key, self.best[key]))
        news = F.broadcast(spark.createDataFrame(rows, "run int, fold int, _at int").coalesce(1))
        top = F.when(F.col("_at") >= 0, F.col(column)[F.greatest("_at", F.lit(0))]).otherwise(F.col("top"))
        self.pop = self.pop.join(news, ["run", "fold"]).withColumn("top", top).drop("_at")

    def advance(self, method: str, gen: int) -> None:
        size, seed, args = self.size, self.seed, (self.size, gen, self.seed)
        n_genes = self.ev.vocab.n_terms + 1
        if method in ("ga", "gwo", "sca", "firefly"):
            step = getattr(S, f"step_{method}")
            extra = {"n_gens": self.n_gens} if method in ("gwo", "sca") else {}
            found = self.propose(step(self.pop, self.fits, *args, **extra))
            self.pop = S.accept_all(self.pop)
            self.settle(found)
            self.remember(gen, self.fits)
        elif method == "pso":
            found = self.propose(S.step_pso(self.pop, self.fits, *args))
            self.remember(gen, found, "ys")
            # Personal bests take the place of `xs` in the comparison; positions always move.
            held = self.pop.withColumn("_x", F.col("ys")).withColumn("xs", F.col("ps"))
            kept, fits = S.accept_better(held, self.fits, found, ties=False)
            self.pop = kept.withColumn("ps", F.col("xs")).withColumn("xs", F.col("_x")).drop("_x")
            self.settle(fits)
        elif method == "harmony":
            found = self.propose(S.step_harmony(self.pop, self.fits, *args))
            self.pop, fits = S.replace_worst(self.pop, self.fits, found, size)
            self.settle(fits)
            self.remember(gen, self.fits)
        elif method == "abc":
            self._colony(gen, n_genes)
        else:
            options = {}
            if method == "de":
                trial = S.step_de(self.pop, self.fits, *args, n_genes)
            elif method == "bat":
                trial = S.step_bat(self.pop, self.fits, *args)
                options["allowed"] = S.loud_bats(seed, gen, size)
            elif method == "cuckoo":
                trial = S.step_cuckoo(self.pop, self.fits, *args)
                options["forced"] = S.abandoned_nests(size)
            else:
                raise ValueError(f"unknown method {method}")
            found = self.propose(trial)
            self.pop, fits = S.accept_better(self.pop, self.fits, found, **options)
            self.settle(fits)
            self.remember(gen, self.fits)

    def _colony(self, gen: int, n_genes: int, limit: int = 10) -> None:
        """Employed bees, onlookers, then scouts for sources without progress in `limit` rounds."""
        before = {(r["run"], r["fold"]): r["fits"] for r in self.fits.collect()}
        found = self.propose(S.step_abc(self.pop, self.fits, self.size, gen, self.seed, n_genes))
        self.pop, fits = S.accept_better(self.pop, self.fits, found)
        self.settle(fits)
        found = self.propose(S.step_abc(self.pop, self.fits, self.size, gen, self.seed, n_genes, "onlooker"))
        self.pop, fits = S.accept_onlookers(self.pop, self.fits, found, self.size)
        self.settle(fits)
        self.remember(gen, self.fits)
        lost = []
        for row in self.fits.collect():
            key = (row["run"], row["fold"])
            idle = [0 if round(n, 9) < round(o, 9) else t + 1 for n, o, t in
                    zip(row["fits"], before[key], self.tired.get(key, [0] * self.size))]
            lost.append((*key, [t > limit for t in idle]))
            self.tired[key] = [0 if t > limit else t for t in idle]
        if any(any(flags) for *_, flags in lost):
            table = self.pop.sparkSession.createDataFrame(lost, "run int, fold int, lost array<boolean>")
            self.pop = materialize(S.scouts(self.pop, table, gen, self.seed))
            self.fits = self.evaluate("xs")
            self.remember(gen, self.fits)


def search(ev: Evaluation, method: str = "ga", size: int = 25, budget: int = 1000, n_runs: int = 10,
           seed: int = 123, evaluate=evaluate_population) -> SearchResult:
    """Run every (run, fold) search until exactly `budget` candidates each have been evaluated; a last generation
    beyond it is judged in part.

    The random seed of run j is seed + j + 1 in every fold.
    """
    state = _Search(ev, size, n_runs, seed, budget, evaluate)
    state.remember(0, state.fits)
    gen = 0
    while state.used < budget:
        gen += 1
        state.advance(method, gen)
    final = materialize(state.pop.select(*POP_KEYS, F.array("top").alias("xs")))
    masks = decode_mask(final).select(*POP_KEYS, F.col("keep")[0].alias("selected"))
    spark = final.sparkSession
    results = spark.createDataFrame([(*k, v) for k, v in state.best.items()], "run int, fold int, fitness double")
    return SearchResult(results, masks, state.history, state.used)


def reduce_runs(found: SearchResult, n_folds: int) -> DataFrame:
    """(dim, term, score): vote over the best run of each fold, never empty."""
    best = best_per_fold(found.results)
    kept = found.masks.join(bounded(best.select("run", "fold")), ["run", "fold"], "left_semi")
    return ensure_nonempty(vote_features(kept, n_folds))


def select_features(weights: DataFrame, docs: DataFrame, vocab: Vocabulary, method: str = "ga", size: int = 25,
                    budget: int = 1000, n_runs: int = 10, n_folds: int = 2, seed: int = 123,
                    evaluator: str = "gnb", stratified: bool = False, evaluate=evaluate_population) -> DataFrame:
    """(dim, term, score): 0/1 per feature, by wrapper search over inner folds of `docs`."""
    folds = stratified_folds(docs, n_folds, seed).drop("label") if stratified else kfold_shuffled(docs, n_folds, seed)
    folds = materialize(folds)
    inner_docs = docs.select("doc_id", "label").join(folds, "doc_id")
    inner = weights.select("doc_id", "label", "term", "w").join(folds, "doc_id")
    inner_docs, inner = materialize(inner_docs, key="doc_id"), materialize(inner, key="doc_id")
    ev = prepare_evaluation(inner, inner_docs, vocab, n_folds, evaluator)
    return reduce_runs(search(ev, method, size, budget, n_runs, seed, evaluate), n_folds)


def transform_selected(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Entries of the selected terms."""
    from ..operators.filters import apply_selection
    return apply_selection(weights, support_mask(scores))


@dataclass
class WrapperRun:
    preds: DataFrame      # (scheme, method, doc_id, y, p) of the test documents
    selected: DataFrame   # (scheme, method, dim, term)
    seconds: DataFrame    # (scheme, method, stage, seconds) as measured


def wrapper_run(docs: DataFrame, methods: tuple[str, ...] = METHODS, schemes: dict = SCHEMES, min_df: int = 3,
                classifier: str = "MNB", **options) -> WrapperRun:
    """Per weighting scheme and method: select features on the train documents, keep them in both splits, fit anew
    on train and classify test. `options` go to `select_features`."""
    preds = selected = None
    took = []
    for scheme, corpus in build_corpora(docs, schemes, min_df, fit_on="train"):
        (train, train_docs), (test, test_docs) = corpus.part("train"), corpus.part("test")
        for method in methods:
            begun = time.monotonic()
            scores = materialize(select_features(train, train_docs, corpus.vocab, method, **options))
            kept = support_mask(scores)
            chosen = time.monotonic()
            found = materialize(BAYES[classifier](transform_selected(train, scores), train_docs, transform_selected(test, scores),
                                                  test_docs, corpus.vocab.restrict(kept)).select("doc_id", "y", "p"))
            took += [(scheme, method, "selection", chosen - begun), (scheme, method, "classification", time.monotonic() - chosen)]
            name = [F.lit(scheme).alias("scheme"), F.lit(method).alias("method")]
            found, kept = found.select(*name, "*"), kept.select(*name, "dim", "term")
            preds = found if preds is None else preds.unionByName(found)
            selected = kept if selected is None else selected.unionByName(kept)
    return WrapperRun(preds, selected, docs.sparkSession.createDataFrame(took, "scheme string, method string, stage string, seconds double"))
