"""Candidate feature sets as a population of real vectors.

A population holds one row per (run, fold, dim) with the genes of all candidates in the
array `xs`, indexed by candidate. Updates mix candidates within a dimension, so they are
narrow; no step shuffles genes. Dimensions 0..D-1 stand for terms, dimension D holds the
thresholds. Fitness is one row per (run, fold) with the array `fits`.

All candidates, runs and folds are evaluated in one job. Term statistics do not depend on
the candidate; a candidate only decides which terms enter its sums. Each entry is joined
once and feeds one conditional sum per candidate, CHUNK candidates at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import bounded, materialize, uniform
from .filters import class_table, explode_folds, outside
from .metrics import class_scores
from .vectorize import Vocabulary, join_on_term

# Candidates per aggregation row: enough to share the join, few enough for compact code.
CHUNK = 16
# Rows of masks and class statistics are wide: at most so many are broadcast to the entries.
SIDE_ROWS = 600_000
POP_KEYS = ["run", "fold", "dim", "term"]


def gene_dims(vocab: Vocabulary) -> DataFrame:
    """(term, dim) of every feature, and the threshold dimension under a null term."""
    genes = vocab.indexed().select("term", F.col("idx").alias("dim"))
    threshold = genes.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("term"), F.lit(vocab.n_terms).alias("dim"))
    return genes.unionByName(threshold)


def init_population(dims: DataFrame, size: int, seed: int, n_runs: int = 1, n_folds: int = 1) -> DataFrame:
    """Uniform genes keyed by (seed of the run, candidate, dimension); folds start alike."""
    # Genes are spread evenly once; every later step keeps this layout.
    parts = int(dims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = dims.repartition(parts, "dim").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    genes = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                        lambda c: uniform(run_seed(seed), c, F.col("dim")))
    return runs.withColumn("xs", genes) \
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).select(*POP_KEYS, "xs")


def run_seed(seed: int) -> Column:
    return F.lit(seed + 1) + F.col("run")


def to_long(pop: DataFrame, column: str = "xs", name: str = "x") -> DataFrame:
    """(run, fold, cid, dim, x)"""
    return pop.select("run", "fold", "dim", F.posexplode(column).alias("cid", name))


def decode_mask(pop: DataFrame, split: float | None = None, column: str = "xs") -> DataFrame:
    """(run, fold, dim, term, keep): gene >= threshold, per candidate.

    The threshold is each candidate's last gene, or the fixed `split`, in which case every
    gene stands for a feature.
    """
    if split is not None:
        return pop.select(*POP_KEYS, F.transform(column, lambda x: x >= split).alias("keep"))
    last = bounded(pop.where(F.col("term").isNull()).select("run", "fold", F.col(column).alias("_t")))
    return pop.where(F.col("term").isNotNull()).join(last, ["run", "fold"]) \
        .select(*POP_KEYS, F.zip_with(column, "_t", lambda x, t: x >= t).alias("keep"))


def digitize_genes(genes: DataFrame, column: str = "x") -> DataFrame:
    """0/1 per gene, split at 0.5."""
    return genes.withColumn("bit", (F.col(column) >= 0.5).cast("int"))


def mask_to_indices(bits: DataFrame) -> DataFrame:
    """Positions whose bit is set."""
    return bits.where(F.col("bit") == 1).drop("bit", "x")


# ---------------------------------------------------------------- evaluation

@dataclass
class Evaluation:
    """Everything about an evaluation that does not depend on the candidates."""
    weights: DataFrame    # (doc_id, fold, term, w)
    docs: DataFrame       # (doc_id, label, fold)
    vocab: Vocabulary
    n_folds: int
    evaluator: str        # mnb or gnb
    cells: DataFrame      # (fold, term, cells: array of per-class statistics)
    classes: DataFrame    # (fold, label, n_label, n_docs), one row per class and fold


def prepare_evaluation(weights: DataFrame, docs: DataFrame, vocab: Vocabulary, n_folds: int,
                       evaluator: str = "mnb") -> Evaluation:
    """Class statistics of each term on every training set (all folds but one)."""
    classes = bounded(class_table(docs, n_folds))
    square = F.col("w") * F.col("w")
    sums = explode_folds(weights.groupBy("term", "label").agg(
        *outside("s", F.col("w"), n_folds), *outside("q", square, n_folds)), ["s", "q"], n_folds)
    if evaluator == "mnb":
        cells = sums.groupBy("fold", "term").agg(F.collect_list(
            F.struct("label", F.col("s").alias("s"), F.log(F.col("s") + 1.0).alias("l"))).alias("cells"))
    else:
        # Variances need every class of the fold, also those without the term.
        names = bounded(classes.groupBy("fold").agg(
            F.collect_list(F.struct("label", "n_label")).alias("_cl"), F.first("n_docs").alias("_n")))
        mapped = sums.groupBy("fold", "term").agg(
            F.sum("s").alias("_s"), F.sum("q").alias("_q"),
            F.map_from_entries(F.collect_list(F.struct("label", F.struct("s", "q")))).alias("_m")).join(names, "fold")

        def stat(c: Column) -> Column:
            s = F.coalesce(F.try_element_at("_m", c["label"])["s"], F.lit(0.0)) / c["n_label"]
            sq = F.coalesce(F.try_element_at("_m", c["label"])["q"], F.lit(0.0)) / c["n_label"]
            return F.struct(c["label"].alias("label"), s.alias("mu"), F.greatest(sq - s * s, F.lit(0.0)).alias("var"))

        mean = F.col("_s") / F.col("_n")
        cells = mapped.select("fold", "term", F.transform("_cl", stat).alias("cells"),
                              (F.col("_q") / F.col("_n") - mean * mean).alias("spread"))
    return Evaluation(weights.select("doc_id", "fold", "term", "w"), docs.select("doc_id", "label", "fold"),
                      vocab, n_folds, evaluator, materialize(cells), classes)


def _chunked(masks: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Masks cut into rows of CHUNK candidates (the last one padded), and the chunk width."""
    width = min(CHUNK, size)
    n_chunks = -(-size // width)
    if n_chunks == 1:
        return masks.withColumn("chunk", F.lit(0)), width
    padded = F.concat("keep", F.array_repeat(F.lit(False), n_chunks * width - size))
    slices = F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)),
                         lambda k: F.slice(padded, k * width + 1, F.lit(width)))
    return masks.select(*POP_KEYS, F.posexplode(slices).alias("chunk", "keep")), width


def _each(width: int, value) -> Column:
    """Array of conditional aggregates, one per candidate of the chunk."""
    return F.array(*[value(F.col("keep")[c], c) for c in range(width)])


def predict_population(ev: Evaluation, masks: DataFrame, size: int, n_runs: int = 1) -> DataFrame:
    """(run, fold, chunk, doc_id, y, ps): predicted label of each candidate of a chunk, null for an empty one."""
    chunks, width = _chunked(masks, size)
    group = ["run", "fold", "chunk"]
    n_side = n_runs * ev.n_folds * -(-size // width)
    kept = chunks.join(ev.cells, ["fold", "term"], "left")
    counts = chunks.groupBy(*group).agg(
        _each(width, lambda k, c: F.coalesce(F.sum(k.cast("long")), F.lit(0))).alias("v"))
    inner = kept.where(F.col("cells").isNotNull())
    if ev.evaluator == "mnb":
        totals = inner.select(*group, "keep", F.explode("cells").alias("_c")) \
            .groupBy(*group, F.col("_c.label").alias("label")).agg(
                _each(width, lambda k, c: F.coalesce(F.sum(F.when(k, F.col("_c.s"))), F.lit(0.0))).alias("s"))
        model = counts.join(ev.classes, "fold").join(totals, [*group, "label"], "left").select(
            *group, "v", "label", F.log(F.col("n_label") / F.col("n_docs")).alias("prior"),
            F.transform("v", lambda v, i: F.log(F.coalesce(F.col("s")[i], F.lit(0.0)) + v)).alias("norm"))
        side = kept.select(*group, "term", "keep", F.concat(
            F.coalesce(F.transform("cells", lambda c: F.struct(c["label"].alias("label"), c["l"].alias("l"))),
                       F.array().cast(f"array<struct<label:{_type(ev)},l:double>>")),
            F.array(F.struct(F.lit(None).cast(_type(ev)).alias("label"), F.lit(1.0).alias("l")))).alias("cells"))
        part = lambda c: F.col("w") * F.col("_c.l")
        extra: list[str] = []
    else:
        eps = bounded(inner.groupBy(*group).agg(
            _each(width, lambda k, c: 1e-9 * F.max(F.when(k, F.col("spread")))).alias("eps")))
        at_zero = lambda c: -0.5 * F.log(2.0 * F.pi() * (F.col("_c.var") + F.col("eps")[c])) \
            - F.col("_c.mu") * F.col("_c.mu") / (2.0 * (F.col("_c.var") + F.col("eps")[c]))
        bases = inner.join(eps, group).select(*group, "keep", "eps", F.explode("cells").alias("_c")) \
            .groupBy(*group, F.col("_c.label").alias("label")).agg(
                _each(width, lambda k, c: F.coalesce(F.sum(F.when(k, at_zero(c))), F.lit(0.0))).alias("norm"))
        # Terms without training entries have mean 0 and variance eps in every class, so they shift all alike.
        model = counts.join(ev.classes, "fold").join(bases, [*group, "label"], "left").select(
            *group, "v", "label", F.log(F.col("n_label") / F.col("n_docs")).alias("prior"), "norm")
        side = inner.join(eps, group).select(*group, "term", "keep", "eps", "cells")
        part = lambda c: (2.0 * F.col("w") * F.col("_c.mu") - F.col("w") * F.col("w")) \
            / (2.0 * (F.col("_c.var") + F.col("eps")[c]))
        extra = ["eps"]
    hits = join_on_term(ev.weights, side, ev.vocab, ["fold", "term"], n_side, limit=SIDE_ROWS, back="doc_id")
    sums = hits.select("doc_id", "run", "chunk", "w", "keep", *extra, F.explode("cells").alias("_c")) \
        .groupBy("doc_id", "run", "chunk", F.col("_c.label").alias("label")).agg(
            _each(width, lambda k, c: F.coalesce(F.sum(F.when(k, part(c))), F.lit(0.0))).alias("a"))
    per_doc = sums.groupBy("doc_id", "run", "chunk").agg(
        F.first(F.when(F.col("label").isNull(), F.col("a")), ignorenulls=True).alias("_w"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "a")))).alias("_a"))
    per_fold = bounded(model.groupBy(*group).agg(
        F.first("v").alias("_v"), F.collect_list(F.struct("label", "prior", "norm")).alias("_m")))
    rows = ev.docs.withColumnRenamed("label", "y").join(per_fold, "fold") \
        .join(per_doc, ["doc_id", "run", "chunk"], "left")

    def score(m: Column, c: Column) -> Column:
        a = m["prior"] + F.coalesce(F.try_element_at("_a", m["label"])[c], F.lit(0.0))
        if ev.evaluator == "mnb":
            return a - F.coalesce(F.col("_w")[c], F.lit(0.0)) * m["norm"][c]
        return a + F.coalesce(m["norm"][c], F.lit(0.0))

    # A candidate without features predicts nothing.
    best = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.when(F.col("_v")[c] > 0, F.array_min(F.transform(
        "_m", lambda m: F.struct((-F.round(score(m, c), 6)).alias("s"), m["label"].alias("l"))))["l"]))
    return rows.select("run", "fold", "chunk", "doc_id", "y", best.alias("ps"))


def _type(ev: Evaluation) -> str:
    return ev.docs.schema["label"].dataType.simpleString()


def evaluate_population(ev: Evaluation, masks: DataFrame, size: int, n_runs: int = 1) -> DataFrame:
    """(run, fold, cid, fitness): 1 - weighted F1 on the held-out fold; infinite for an empty mask."""
    width = min(CHUNK, size)
    preds = predict_population(ev, masks, size, n_runs).select(
        "run", "fold", F.posexplode("ps").alias("at", "p"), "chunk", "y") \
        .select("run", "fold", (F.col("chunk") * width + F.col("at")).alias("cid"), "y", "p").where(F.col("cid") < size)
    keys = ("run", "fold", "cid")
    weighted = 1.0 - F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return class_scores(preds, keys).groupBy(*keys).agg(
        F.when(F.max(F.col("label").isNull()), F.lit(float("inf"))).otherwise(weighted).alias("fitness"))


def evaluate_regression(preds: DataFrame, keys: tuple[str, ...] = ("fold", "cid")) -> DataFrame:
    """Mean squared error of (keys..., y, yhat)."""
    return preds.groupBy(*keys).agg(F.avg(F.pow(F.col("y") - F.col("yhat"), F.lit(2.0))).alias("fitness"))


def fitness_arrays(fitness: DataFrame) -> DataFrame:
    """(run, fold, fits): fitness by candidate; one row per run and fold."""
    return fitness.groupBy("run", "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cid", "fitness"))), lambda s: s["fitness"]).alias("fits"))


# ---------------------------------------------------------------- reduction of results

def best_per_fold(results: DataFrame) -> DataFrame:
    """Result rows (fold, run, fitness, ...) with the lowest fitness per fold, the earliest run on ties."""
    best = results.groupBy("fold").agg(F.min(F.struct(F.round("fitness", 9).alias("f"), "run")).alias("_b"))
    return results.join(bounded(best.select("fold", F.col("_b.run").alias("run"))), ["fold", "run"], "left_semi")


def vote_features(selected: DataFrame, n_folds: int) -> DataFrame:
    """(dim, term, score): 1 if more than half of the folds keep the feature; a tie gives 0."""
    votes = F.sum(F.col("selected").cast("int"))
    return selected.groupBy("dim", "term").agg((votes * 2 > n_folds).cast("int").alias("score"))


def ensure_nonempty(scores: DataFrame) -> DataFrame:
    """Give feature 0 the score 1 if nothing was selected."""
    total = bounded(scores.agg(F.coalesce(F.sum("score"), F.lit(0)).alias("_n")))
    kept = F.when((F.col("_n") == 0) & (F.col("dim") == 0), 1).otherwise(F.col("score"))
    return scores.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one") \
        .withColumn("score", kept.cast("int")).drop("_one", "_n")


def support_mask(scores: DataFrame) -> DataFrame:
    """Terms with a positive score."""
    return scores.where(F.col("score") > 0)
