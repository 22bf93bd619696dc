"""Fold assignment and hold-out splits; only keys are shuffled, never texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import bounded, ranked


def _shuffled(doc_id: str, seed) -> list:
    return [F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(doc_id).cast("string"))), F.col(doc_id)]


def stratified_folds(docs: DataFrame, k: int = 5, seed: int | None = None, label: str = "label",
                     doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label, fold) with the class shares of the whole in every fold.

    Classes are numbered by first appearance and laid end to end; fold i gets as many
    rows of a class as that class has positions p with p % k = i. Rows of a class take
    folds in document order, or in a hashed order when `seed` is given.
    """
    keys = docs.select(doc_id, label)
    order = [F.col(doc_id)] if seed is None else _shuffled(doc_id, seed)
    w = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    # One row per class: its start and the number of its rows that folds 0..i receive.
    classes = keys.groupBy(label).agg(F.count("*").alias("_n"), F.min(doc_id).alias("_first")) \
        .withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    share = [F.floor((F.col("_start") + F.col("_n") - 1 - i) / k) - F.floor((F.col("_start") - 1 - i) / k)
             for i in range(k)]
    ends = F.array(*[sum(share[1:i + 1], share[0]) for i in range(k)])
    classes = classes.select(label, ends.alias("_ends"))
    placed = ranked(keys, [label], order, name="_rn").join(bounded(classes), label)
    fold = F.size(F.filter("_ends", lambda e: e < F.col("_rn")))
    return placed.select(doc_id, label, fold.alias("fold"))


def kfold_shuffled(docs: DataFrame, k: int = 2, seed: int = 123, doc_id: str = "doc_id",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fold): plain shuffled k-fold; the first n % k folds hold one row more."""
    keys = docs.select(doc_id, *keep)
    n = keys.count()
    placed = ranked(keys, [], _shuffled(doc_id, seed), name="_rn", n_rows=n)
    q, r = divmod(n, k)
    at = F.col("_rn") - 1
    wide = r * (q + 1)
    late = F.lit(r) + F.floor((at - wide) / max(q, 1))
    fold = F.when(at < wide, F.floor(at / (q + 1))).otherwise(late).cast("int")
    return placed.select(doc_id, *keep, fold.alias("fold"))


def holdout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predefined (train, test) by column `split`."""
    return docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
