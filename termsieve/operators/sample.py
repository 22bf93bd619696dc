"""Class shaping: counts, per-class caps, class-size filters, label codes, split pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import bounded, ranked


def class_distribution(docs: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """Documents per target, zero counts included. `targets` holds `label` and `target_no`."""
    counts = docs.groupBy(label).count()
    return targets.join(bounded(counts), label, "left") \
        .select("target_no", label, F.coalesce("count", F.lit(0)).alias("n"))


def cap_per_class(docs: DataFrame, n: int, by: tuple[str, ...] = ("label",),
                  order: str = "doc_id") -> DataFrame:
    """First `n` documents of each class in `order`.

    Spark keeps at most `n` rows per class and map task before the shuffle, so a
    large class costs no more than a small one.
    """
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return docs.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def half_per_class(docs: DataFrame, by: tuple[str, ...] = ("label", "split"),
                   order: str = "doc_id") -> DataFrame:
    """First half (rounded down) of the documents of each class and split."""
    keys = docs.select(order, *by)
    place = ranked(keys, list(by), [F.col(order)], name="_rn")
    sizes = bounded(keys.groupBy(*by).agg(F.count("*").alias("_n")))
    kept = place.join(sizes, list(by)).where(F.col("_rn") <= F.floor(F.col("_n") / 2)).select(order, *by)
    return docs.join(kept, [order, *by], "left_semi")


def filter_class_size(docs: DataFrame, lo: int, hi: int | None = None, label: str = "label") -> DataFrame:
    """Documents of classes with at least `lo` (and at most `hi`) documents."""
    sizes = docs.groupBy(label).count()
    kept = sizes.where(F.col("count") >= lo)
    if hi is not None:
        kept = kept.where(F.col("count") <= hi)
    return docs.join(bounded(kept.select(label)), label, "left_semi")


def split_by_prefix(docs: DataFrame, name: str = "name") -> DataFrame:
    """`split` from the prefix of a document name; other names belong to neither split."""
    split = F.when(F.col(name).startswith("train"), "train").when(F.col(name).startswith("test"), "test")
    return docs.withColumn("split", split)


def label_codes(docs: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels with codes 0..K-1. One row per class."""
    # The distinct labels are as many as the classes, so one task ranks them.
    code = F.row_number().over(Window.orderBy(label)) - 1
    return docs.select(label).distinct().withColumn("label_idx", code.cast("int"))


def encode_labels(train: DataFrame, test: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Attach `label_idx` learnt on `train` to `test` (or to `train`); unseen labels raise."""
    codes = bounded(label_codes(train, label))
    if test is None:
        return train.join(codes, label)
    seen = F.coalesce("label_idx", F.raise_error(F.concat(F.lit("unseen label: "), F.col(label))).cast("int"))
    return test.join(codes, label, "left").withColumn("label_idx", seen)


def map_label(docs: DataFrame, codes: dict[str, int], category: str = "category") -> DataFrame:
    """Attach the code of the lowered, stripped category; an unknown category raises."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    name = F.lower(F.trim(F.col(category)))
    code = F.coalesce(F.try_element_at(table, name),
                      F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(name, F.lit("null")))).cast("int"))
    return docs.withColumn("label_idx", code)


def pool_splits(train: DataFrame, test: DataFrame, label: str = "label", order: str = "doc_id") -> DataFrame:
    """Both splits as one table with `class_no`, the rank of a class by first appearance.

    Sorting by (class_no, split_no, order) gives the class-by-class reading order.
    """
    both = train.withColumn("split_no", F.lit(0)).unionByName(test.withColumn("split_no", F.lit(1)))
    first = both.groupBy(label).agg(F.min(F.struct("split_no", order)).alias("_at"))
    numbered = first.select(label, (F.row_number().over(Window.orderBy("_at")) - 1).alias("class_no"))
    return both.join(bounded(numbered), label)


def corpus_shape(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Number of documents and of features, as one row."""
    samples = docs.agg(F.count("*").alias("n_samples"))
    features = vocabulary.agg(F.count("*").alias("n_features"))
    # Two one-row sides.
    return samples.withColumn("_one", F.lit(1)).join(features.withColumn("_one", F.lit(1)), "_one").drop("_one")
