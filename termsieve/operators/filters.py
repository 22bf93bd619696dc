"""Filter scores of terms against classes, and selection by rank.

Entries (`weights`) carry the label and, for cross-validation, the fold of their
document. With `n_folds`, scores are computed for every training set at once: a single
pass keeps one conditional sum per fold, so the entries are not replicated. Classes in
which a term does not occur enter in closed form; no term-by-class grid is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import BROADCAST_ROWS, bounded, materialize, ranked
from .vectorize import join_on_term, join_stored, sized_vocabulary

# Spark cuts a window to its first rows in each task up to this many by default
# (spark.sql.optimizer.windowGroupLimitThreshold).
WINDOW_BEST = 1_000


def class_table(docs: DataFrame, n_folds: int | None = None) -> DataFrame:
    """(fold, label, n_label, n_docs) of each training set: one row per fold and class."""
    if n_folds is None:
        counts = docs.groupBy("label").agg(F.count("*").alias("n_label")).withColumn("fold", F.lit(-1))
    else:
        counts = explode_folds(
            docs.groupBy("label").agg(*outside("n_label", F.lit(1), n_folds)), ["n_label"], n_folds)
    counts = counts.where(F.col("n_label") > 0)
    total = F.sum("n_label").over(Window.partitionBy("fold"))
    return counts.select("fold", "label", "n_label", total.alias("n_docs"))


def outside(name: str, value: Column, n_folds: int) -> list[Column]:
    """Per fold, the sum of `value` over the rows of all other folds."""
    return [F.sum(F.when(F.col("fold") != f, value)).alias(f"{name}_{f}") for f in range(n_folds)]


def explode_folds(sums: DataFrame, names: list[str], n_folds: int) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(f).alias("fold"), *[F.col(f"{n}_{f}").alias(n) for n in names])
        for f in range(n_folds)])
    wide = [f"{n}_{f}" for n in names for f in range(n_folds)]
    out = sums.withColumn("_r", F.explode(rows)).drop(*wide)
    keep = [c for c in out.columns if c != "_r"]
    return out.select(*keep, "_r.*").where(F.col(names[0]).isNotNull())


def term_class_sums(weights: DataFrame, n_folds: int | None = None, w: str = "w") -> DataFrame:
    """(fold, term, label, s, n): summed weight and entry count per training set."""
    grouped = weights.groupBy("term", "label")
    if n_folds is None:
        return grouped.agg(F.sum(w).alias("s"), F.count("*").alias("n")).withColumn("fold", F.lit(-1))
    return explode_folds(
        grouped.agg(*outside("s", F.col(w), n_folds), *outside("n", F.lit(1), n_folds)), ["s", "n"], n_folds)


def _finish(scores: DataFrame, n_folds: int | None) -> DataFrame:
    return scores.drop("fold") if n_folds is None else scores


def chi2_scores(weights: DataFrame, docs: DataFrame, n_folds: int | None = None) -> DataFrame:
    """(term, score[, fold]): chi-squared statistic of summed weights per class.

    With o the class sums, T their total and p the class shares, the expected sums are
    p * T and sum((o - pT)^2 / pT) over all classes equals sum(o^2 / p) / T - T, in which
    classes without the term vanish.
    """
    classes = bounded(class_table(docs, n_folds))
    sums = term_class_sums(weights, n_folds).join(classes, ["fold", "label"])
    spread = F.sum(F.col("s") * F.col("s") * F.col("n_docs") / F.col("n_label"))
    per_term = sums.groupBy("fold", "term").agg(F.sum("s").alias("_t"), spread.alias("_o")).where(F.col("_t") > 0)
    score = F.greatest(F.col("_o") / F.col("_t") - F.col("_t"), F.lit(0.0))
    return _finish(per_term.select("fold", "term", score.alias("score")), n_folds)


def _part(count: Column, total: Column) -> Column:
    """count * ln(count / total), with its limit 0 at count = 0."""
    return F.when(count > 0, count * F.log(count / total)).otherwise(0.0)


def _information(n: Column, df: Column, cells: Column, bins: Column | None = None) -> Column:
    """Mutual information from sum(cell * ln(cell / class size)) and the side totals."""
    present = -_part(df, n) if bins is None else bins
    return F.greatest((cells + present - _part(n - df, n)) / n, F.lit(0.0))


def mutual_info_presence(weights: DataFrame, docs: DataFrame, n_folds: int | None = None) -> DataFrame:
    """(term, score[, fold]): mutual information (nats) of term presence and class.

    A class without the term has one cell as large as the class, which adds nothing.
    """
    classes = bounded(class_table(docs, n_folds))
    cells = term_class_sums(weights.withColumn("w", F.lit(1.0)), n_folds).join(classes, ["fold", "label"])
    parts = _part(F.col("n"), F.col("n_label")) + _part(F.col("n_label") - F.col("n"), F.col("n_label"))
    per_term = cells.groupBy("fold", "term").agg(
        F.sum("n").alias("_df"), F.first("n_docs").alias("_n"), F.sum(parts).alias("_cells"))
    score = _information(F.col("_n"), F.col("_df"), F.col("_cells"))
    return _finish(per_term.select("fold", "term", score.alias("score")), n_folds)


def mutual_info_binned(weights: DataFrame, docs: DataFrame, bins: int = 4) -> DataFrame:
    """(term, score): mutual information of class and weight, binned per term.

    Absent terms form one bin; the others fall into `bins` equally filled bins in
    weight order, the first ones taking the remainder.
    """
    classes = bounded(class_table(docs)).drop("fold")
    entries = materialize(weights.select("term", "doc_id", "label", F.round("w", 9).alias("_w")))
    place = ranked(entries, ["term"], [F.col("_w"), F.col("doc_id")], name="_rn")
    # All entries count, so document frequencies show which terms to join apart.
    vocab = sized_vocabulary(entries.groupBy("term").agg(F.count("*").alias("df")), 0)
    q, r, at = F.floor(F.col("_df") / bins), F.col("_df") % bins, F.col("_rn") - 1
    bin_no = F.when(at < r * (q + 1), F.floor(at / (q + 1))).otherwise(
        r + F.floor((at - r * (q + 1)) / F.greatest(q, F.lit(1))))
    cells = join_on_term(place, vocab.terms.select("term", F.col("df").alias("_df")), vocab).groupBy("term", "_df", "label", bin_no.alias("bin")).agg(F.count("*").alias("n")) \
        .join(classes, "label")
    per_label = cells.groupBy("term", "_df", "label", "n_label", "n_docs").agg(
        F.sum("n").alias("n"), F.sum(_part(F.col("n"), F.col("n_label"))).alias("_b"))
    absent = _part(F.col("n_label") - F.col("n"), F.col("n_label"))
    per_term = per_label.groupBy("term", "_df").agg(
        F.first("n_docs").alias("_n"), F.sum(F.col("_b") + absent).alias("_cells"))
    n = F.col("_n")
    filled = -(r * _part(q + 1, n) + (bins - r) * _part(q, n))
    return per_term.select("term", _information(n, F.col("_df"), F.col("_cells"), filled).alias("score"))


def _best_first(digits: int) -> list[Column]:
    # Float sums depend on their order; rounded scores do not.
    score = F.round(F.col("score"), digits)
    return [F.when(F.isnan("score"), None).otherwise(score).desc_nulls_last(), F.col("term").desc()]


def select_k_best(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best terms with their `rank`, per fold if there is a `fold` column.

    Ties go to the later term, undefined scores come last. Up to WINDOW_BEST terms each task keeps its own
    k best before the shuffle; more are cut from ranks over a range shuffle, so no fold is sorted in one task.
    """
    if k > WINDOW_BEST:
        return rank_terms(scores, digits).where(F.col("rank") <= k)
    if "fold" in scores.columns:
        w = Window.partitionBy("fold").orderBy(*_best_first(digits))
        return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = scores.orderBy(*_best_first(digits)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_best_first(digits))))


def rank_terms(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Every term with its `rank`, best first, per fold if there is a `fold` column."""
    by = ["fold"] if "fold" in scores.columns else []
    return ranked(materialize(scores), by, _best_first(digits), name="rank")


def apply_selection(weights: DataFrame, selected: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Entries of the selected terms. Weights are not scaled again."""
    kept = materialize(selected.select("term").distinct())
    return join_stored(weights, kept, kept.count(), how="left_semi", limit=limit)

