"""Scores of predictions (..., doc_id, y, p) per group of key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import bounded


def accuracy(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def confusion_counts(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Non-empty cells only: at most classes squared rows per group."""
    return preds.groupBy(*keys, "y", "p").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All cells of the labels seen as truth or prediction, empty ones with 0."""
    cells = confusion_counts(preds, keys)
    labels = cells.select(*keys, F.explode(F.array("y", "p")).alias("y")).distinct()
    columns = labels.groupBy(*keys).agg(F.array_sort(F.collect_set("y")).alias("_ps"))
    grid = labels.join(columns, list(keys)) if keys else \
        labels.withColumn("_one", F.lit(1)).join(columns.withColumn("_one", F.lit(1)), "_one").drop("_one")
    grid = grid.select(*keys, "y", F.explode("_ps").alias("p"))
    return grid.join(cells, [*keys, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, tp, support, predicted, precision, recall, f1) for each label seen."""
    cells = confusion_counts(preds, keys)
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"))))
    per_label = cells.select(*keys, sides.alias("_s")).select(*keys, "_s.*").groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    tp = F.col("tp").cast("double")
    ratio = lambda d: F.when(d > 0, tp / d).otherwise(0.0)
    both = F.col("support") + F.col("predicted")
    return per_label.withColumn("precision", ratio(F.col("predicted"))) \
        .withColumn("recall", ratio(F.col("support"))) \
        .withColumn("f1", F.when(both > 0, 2.0 * tp / both).otherwise(0.0))


def _from_classes(preds: DataFrame, keys: tuple[str, ...], value: Column, name: str) -> DataFrame:
    return class_scores(preds, keys).groupBy(*keys).agg(value.alias(name))


def f1_macro(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return _from_classes(preds, keys, F.avg("f1"), "f1_macro")


def f1_micro(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return _from_classes(
        preds, keys, 2.0 * F.sum("tp") / (F.sum("support") + F.sum("predicted")), "f1_micro")


def f1_weighted(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return _from_classes(preds, keys, F.sum(F.col("f1") * F.col("support")) / F.sum("support"), "f1_weighted")


def all_scores(preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and the three F1 averages from one confusion table."""
    n = F.sum("support")
    return class_scores(preds, keys).groupBy(*keys).agg(
        (F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        (2.0 * F.sum("tp") / (n + F.sum("predicted"))).alias("f1_micro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"))


def classification_report(preds: DataFrame, keys: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Rows per class, then `accuracy`, `macro avg` and `weighted avg`, in row order `row_no`."""
    scores = class_scores(preds, keys)
    place = F.row_number().over(Window.partitionBy(*(keys or (F.lit(1),))).orderBy("label"))
    classes = scores.select(*keys, place.alias("row_no"), F.col("label").cast("string").alias("name"),
                            "precision", "recall", "f1", "support")
    n = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / n
    acc = F.sum("tp") / n
    lines = [("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc),
             ("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
             ("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"))]
    summary = scores.groupBy(*keys).agg(n.alias("support"), F.count("*").alias("_k"), F.array(*[
        F.struct(F.lit(i + 1).alias("at"), F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
        for i, (name, p, r, f) in enumerate(lines)]).alias("_s"))
    tail = summary.withColumn("_s", F.explode("_s")).select(
        *keys, (F.col("_k") + F.col("_s.at")).cast("int").alias("row_no"), "_s.name", "_s.precision", "_s.recall",
        "_s.f1", "support")
    rounded = [F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")]
    return classes.unionByName(tail).select(*keys, "row_no", "name", *rounded, "support")


def fold_average(scores: DataFrame, metric: str, keys: tuple[str, ...] = ("method",),
                 percent: bool = False) -> DataFrame:
    value = F.avg(metric) * (100.0 if percent else 1.0)
    return scores.groupBy(*keys).agg(value.alias(f"avg_{metric}"))


def selected_counts(selected: DataFrame) -> DataFrame:
    """Features kept per fold, with their mean over folds."""
    # One row per fold.
    per_fold = selected.groupBy("fold").agg(F.count("*").alias("n_selected"))
    return per_fold.withColumn("avg_selected", F.avg("n_selected").over(Window.partitionBy(F.lit(1))))


def result_grid(results: DataFrame, classifiers: list[str], value: str = "avg_accuracy") -> DataFrame:
    """k x classifier table."""
    return results.groupBy("k").pivot("classifier", classifiers).agg(F.first(value))


def timing_summary(seconds: DataFrame, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Mean seconds per method and stage, and of their per-fold total as stage `total`."""
    total = seconds.groupBy(*keys, "fold").agg(F.sum("seconds").alias("seconds")).withColumn("stage", F.lit("total"))
    return seconds.select(*keys, "fold", "stage", "seconds") \
        .unionByName(total.select(*keys, "fold", "stage", "seconds")) \
        .groupBy(*keys, "stage").agg(F.avg("seconds").alias("avg_seconds"))


def method_comparison(preds: DataFrame, selected: DataFrame, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """One line per method: mean accuracy and mean number of selected features over folds."""
    acc = fold_average(accuracy(preds, (*keys, "fold")), "accuracy", keys)
    counts = selected.groupBy(*keys, "fold").agg(F.count("*").alias("_n")) \
        .groupBy(*keys).agg(F.avg("_n").alias("avg_selected"))
    return acc.join(bounded(counts), list(keys))
