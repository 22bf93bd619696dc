"""Mutual information of class and weight by nearest neighbours, straight from the sparse term relation.

Per point, the distance to its k-th neighbour of the same class is compared with the number of points of all classes
within it. Weights are whole multiples of 1e-9, so distances are exact and nothing is jittered: where the k-th
neighbour lies at distance zero, all points of the same weight are taken as neighbours instead. Documents without a
term have weight zero and enter as one cell per class.

Terms are dealt to tasks once and scored there; a term of too many entries for one task is worked off over ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import bounded, materialize, ranked, running_sum
from .filters import class_table

SCALE = 1e9
# Neighbours are sought in runs of so many points of one term and class.
RUN_LENGTH = 65_536
# A term of at most so many entries is scored in one task.
TASK_ENTRIES = 1 << 22
# Entries dealt to a task on average, and cells that it looks at together.
TASK_ROWS, BLOCK_CELLS = 1 << 20, 1 << 19


def digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1: summed to 10 places of the series, which begins at 10."""
    far = n.cast("double") + F.when(n < 10, 10 - n).otherwise(0)
    near = F.aggregate(F.when(n < 10, F.sequence(n.cast("int"), F.lit(9))).otherwise(F.array().cast("array<int>")),
                       F.lit(0.0), lambda total, i: total + 1.0 / i)
    inverse = 1.0 / (far * far)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    return F.log(far) - 0.5 / far - series - near


def _reach(cells: DataFrame, k: int, run_length: int, window_rows: int | None) -> DataFrame:
    """Cells with `near`, the neighbours asked for, and `r`, the distance to that neighbour in the same class.

    A cell shows at most k + 1 of its points: more would all be at distance zero. Points are numbered per term and
    class; runs of `run_length` numbers, with the k points before and after them, are searched apart.
    """
    points = materialize(cells.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int")))))
    placed = ranked(points, ["term", "label"], [F.col("v"), F.col("_copy")], name="_place", window_rows=window_rows)
    home = F.floor((F.col("_place") - 1) / run_length)
    runs = F.array_distinct(F.array(home, F.floor((F.col("_place") - 1 - k) / run_length), F.floor((F.col("_place") - 1 + k) / run_length)))
    dealt = placed.withColumn("_home", home).withColumn("_run", F.explode(runs))
    w = Window.partitionBy("term", "label", "_run").orderBy("_place")
    away = F.array_sort(F.array(*[F.col("v") - F.lag("v", i).over(w) for i in range(1, k + 1)],
                                *[F.lead("v", i).over(w) - F.col("v") for i in range(1, k + 1)]))
    found = dealt.withColumn("_away", away).where((F.col("_run") == F.col("_home")) & (F.col("_copy") == 1))
    near = F.least(F.lit(k), F.col("n_label") - 1).cast("int")
    return found.select(*cells.columns, near.alias("near"), F.element_at("_away", near).alias("r"))


def _digamma(n: np.ndarray) -> np.ndarray:
    """`digamma` of an array."""
    below_ten = np.append(np.cumsum(1.0 / np.arange(9, 0, -1))[::-1], 0.0)
    far = np.maximum(n, 10).astype(float)
    inverse = 1.0 / (far * far)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    return np.log(far) - 0.5 / far - series - below_ten[np.minimum(n, 10) - 1]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _term_scores(t: np.ndarray, c: np.ndarray, v: np.ndarray, size: np.ndarray, k: int, n_docs: int) -> np.ndarray:
    """Scores of terms 0.. from all their entries, sorted by term, class and value."""
    cells = _starts(t, c, v)
    n = np.diff(np.append(cells, len(t)))
    t, c, v, size = t[cells], c[cells], v[cells], size[cells]
    group = _starts(t, c)
    df = np.add.reduceat(n, group)
    terms = int(t[-1]) + 1
    zero = n_docs - np.bincount(t[group], df, terms).astype(np.int64)
    absent = n_docs - np.bincount(t[group], size[group], terms).astype(np.int64)
    points = [np.concatenate([t, np.flatnonzero(zero)]), np.concatenate([v, np.zeros((zero > 0).sum(), np.int64)]), np.concatenate([n, zero[zero > 0]])]

    # The distance to the k-th neighbour of the class; a cell shows at most k + 1 of its points.
    rest = group[size[group] > df]
    cell = [np.concatenate([x, x[rest]]) for x in (t, c, size)] + \
        [np.concatenate([v, np.zeros(len(rest), np.int64)]), np.concatenate([n, (size[group] - df)[size[group] > df]])]
    order = np.lexsort((cell[3], cell[1], cell[0]))
    t, c, size, v, n = (x[order] for x in cell)
    copies = np.minimum(n, k + 1)
    place = np.cumsum(copies) - copies
    shown = np.repeat(v, copies)
    group = _starts(t, c)
    ends = np.append(place[group], len(shown))
    of = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(t))))
    away = np.full((2 * k, len(v)), np.iinfo(np.int64).max)
    for i in range(1, k + 1):
        ok = place - i >= ends[of]
        away[i - 1, ok] = v[ok] - shown[place[ok] - i]
        ok = place + i < ends[of + 1]
        away[k + i - 1, ok] = shown[place[ok] + i] - v[ok]
    away.sort(axis=0)
    near = np.minimum(k, size - 1)
    r = away[near - 1, np.arange(len(v))]
    near = np.where(r == 0, n, near)

    # Points of all classes nearer than that: the sums up to two bounds, which stand behind the points of their value.
    step = np.maximum(r, 1)
    at = np.concatenate([points[1], v + step - 1, v - step])
    kind = np.repeat([0, 1], [len(points[0]), 2 * len(v)])
    order = np.lexsort((kind, at, np.concatenate([points[0], t, t])))
    below = np.empty(len(at), np.int64)
    below[order] = np.cumsum(np.concatenate([points[2], np.zeros(2 * len(v), np.int64)])[order])
    low, high = below[-len(v):], below[len(points[0]):-len(v)]
    total = np.bincount(t, n * (_digamma(near) - _digamma(size) - _digamma(high - low)), terms)
    total += n_docs * _digamma(np.array([n_docs])) - np.where(absent > 0, absent * _digamma(np.maximum(zero, 1)), 0.0)
    return np.maximum(total / n_docs, 0.0)


def _in_task(k: int, n_docs: int, block_cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, label, v, n_label) of whole terms to (term, score), so many entries at a time."""
    def scored(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        names = table["term"].combine_chunks().dictionary_encode("encode")
        t = names.indices.to_numpy().astype(np.int64)
        c = table["label"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        v, size = table["v"].to_numpy(), table["n_label"].to_numpy()
        del table, rows
        order = np.lexsort((v, c, t))
        t, c, v, size = t[order], c[order], v[order], size[order]
        starts = np.append(_starts(t), len(t))
        first = 0
        while first < len(starts) - 1:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + block_cells, "right")) - 1)
            part = slice(starts[first], starts[last])
            scores = _term_scores(t[part] - first, c[part], v[part], size[part], k, n_docs)
            yield pa.RecordBatch.from_arrays([names.dictionary.slice(first, last - first), pa.array(scores)], ["term", "score"])
            first = last
    return scored


def mutual_info_neighbors(weights: DataFrame, docs: DataFrame, k: int = 3, run_length: int = RUN_LENGTH,
                          window_rows: int | None = None, task_entries: int = TASK_ENTRIES) -> DataFrame:
    """(term, score): nearest-neighbour estimate in nats, never below zero.

    Classes of one document are left out, and a class of up to k documents uses all its others as neighbours. Classes
    that never use a term enter in closed form, so no term-by-class grid is built. `weights` has a row per document and
    term. Terms are dealt to tasks; those of more than `task_entries` documents are numbered and counted over range
    partitions instead, so that a term in every document is never one task's work.
    """
    sizes = class_table(docs).where(F.col("n_label") > 1)
    classes = bounded(sizes.select("label", "n_label", F.sum("n_label").over(Window.partitionBy("fold")).alias("n_docs")))
    n_docs = sizes.agg(F.coalesce(F.sum("n_label"), F.lit(0))).first()[0]
    value = F.round(F.col("w") * SCALE).cast("long")
    entries = weights.select("term", "label", value.alias("v")).where(F.col("v") != 0).join(classes, "label")
    large = None
    if n_docs > task_entries:
        frequent = bounded(entries.groupBy("term").agg(F.count("*").alias("_n")).where(F.col("_n") > task_entries).select("term"))
        large = _over_ranges(entries.join(frequent, "term", "left_semi"), k, run_length, window_rows)
        entries = entries.join(frequent, "term", "left_anti")
    parts = max(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weights.count() // TASK_ROWS))
    small = entries.select("term", "label", "v", F.col("n_label").cast("long").alias("n_label")).repartition(parts, "term") \
        .mapInArrow(_in_task(k, n_docs, BLOCK_CELLS), "term string, score double")
    return small if large is None else small.unionByName(large)


def _over_ranges(entries: DataFrame, k: int, run_length: int, window_rows: int | None) -> DataFrame:
    """(term, score), with every term's points spread over range partitions."""
    used = materialize(entries.groupBy("term", "label", "v", "n_label", "n_docs").agg(F.count("*").alias("n")))
    by_class = materialize(used.groupBy("term", "label", "n_label", "n_docs").agg(F.sum("n").alias("_df")))
    names = ["term", "label", "v", "n", "n_label"]
    zeros = by_class.where(F.col("n_label") > F.col("_df")).select(
        "term", "label", F.lit(0).cast("long").alias("v"), (F.col("n_label") - F.col("_df")).alias("n"), "n_label")
    reached = materialize(_reach(used.select(*names).unionByName(zeros), k, run_length, window_rows))
    by_term = by_class.groupBy("term", "n_docs").agg(F.sum("_df").alias("_df"), F.sum("n_label").alias("_seen"))
    by_term = materialize(by_term.withColumn("_zero", F.col("n_docs") - F.col("_df")))

    # Points below a bound: the points and, after those of the same weight, the two bounds of each cell.
    no_cell = [F.lit(None).cast(t).alias(c) for c, t in (("label", used.schema["label"].dataType), ("v", "long"), ("n", "long"), ("n_label", "long"), ("near", "long"), ("sign", "int"))]
    points = used.select("term", F.col("v").alias("at"), F.lit(0).alias("kind"), F.col("n").alias("add"), *no_cell) \
        .unionByName(by_term.where("_zero > 0").select("term", F.lit(0).cast("long").alias("at"), F.lit(0).alias("kind"), F.col("_zero").alias("add"), *no_cell))
    step = F.greatest("r", F.lit(1))
    ends = F.explode(F.array(F.struct((F.col("v") + step - 1).alias("at"), F.lit(1).alias("sign")),
                             F.struct((F.col("v") - step).alias("at"), F.lit(-1).alias("sign"))))
    near = F.when(F.col("r") == 0, F.col("n")).otherwise(F.col("near"))
    bounds = reached.select("term", "label", "v", "n", "n_label", near.alias("near"), ends.alias("_e")).select(
        "term", "_e.at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("add"), "label", "v", "n", "n_label", "near", "_e.sign")
    events = materialize(points.unionByName(bounds))
    below = running_sum(events, ["term"], [F.col("at"), F.col("kind")], "add", "below", window_rows=window_rows)
    within = below.where(F.col("kind") == 1).groupBy("term", "label", "v", "n", "n_label", "near") \
        .agg(F.sum(F.col("sign") * F.col("below")).alias("m"))
    parts = within.select("term", (F.col("n") * (digamma(F.col("near")) - digamma(F.col("n_label")) - digamma(F.col("m")))).alias("part"))
    absent = F.col("n_docs") - F.col("_seen")
    rest = by_term.select("term", "n_docs", (F.col("n_docs") * digamma(F.col("n_docs")) - F.when(
        absent > 0, absent * digamma(F.col("_zero"))).otherwise(0.0)).alias("part"))
    total = parts.withColumn("n_docs", F.lit(None).cast("long")).unionByName(rest).groupBy("term") \
        .agg(F.sum("part").alias("_s"), F.max("n_docs").alias("_n"))
    return total.select("term", F.greatest(F.col("_s") / F.col("_n"), F.lit(0.0)).alias("score"))
