"""Linear classifiers of many training sets at once: multinomial logistic regression and pairwise linear SVM.

The sparse relation is stored as tiles: documents of a block by terms of a range. A model is a column of weights; the
columns of all folds and classes (or pairs of classes) are solved together, so a block is read once for all of them.
Weights that fit in every task are sent there whole: a task takes its blocks from scores over slopes of the loss to
gradients, sums these over its blocks, and only the sums are shuffled. Of larger weights a tile gets those of its range:
scores are summed per block, turned into slopes, and gradients are summed per range. Where the driver keeps the state and the
slopes of all documents fit as well, these go through it from the blocks to tiles stored by range, and nothing is shuffled.
Weights, gradients and the solver's history are rows per term range; unless the driver keeps them they stay on the cluster, and the recursion of the
limited-memory quasi-Newton method runs on the table of their inner products (Chen et al. 2014), which sends back one
coefficient per stored vector.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import bounded, discard, materialize
from .sample import label_codes
from .vectorize import Vocabulary, join_on_term

# Documents of a block, on average, and terms of a range, at least and at most.
BLOCK_DOCS, LEAST_RANGE, RANGE = 1024, 256, 4096
# Weights or slopes of at most so many bytes are broadcast to the tiles; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
# The solver's state of at most so many bytes is kept by the driver, in a file that it maps; a larger one is stored as rows
# after each pass, which take the place of the last ones.
DRIVER_BYTES = 2 << 30
# The intercept is the only term of a range of its own; it is not penalised.
INTERCEPT = -1
# Pairs of steps and gradient changes that the solver remembers.
HISTORY = 6
# Width of the quadratic corner of the hinge: the solution is within C * n * CORNER / 2 of the exact optimum.
CORNER = 0.1


# ---------------------------------------------------------------- tiles

@dataclass
class Design:
    """Tiles and documents of a corpus."""
    blocks: DataFrame     # (b, y, fold, tiles): class codes and folds of the block's documents, by place, and its tiles by range
    placed: DataFrame     # (doc_id, b, at)
    codes: DataFrame      # (label, label_idx)
    terms: DataFrame      # (term, r, col)
    labels: list
    counts: dict          # (fold, class code) -> documents
    n_docs: int
    n_terms: int
    n_blocks: int
    _ranged: list = field(default_factory=list, repr=False, compare=False)

    @property
    def n_classes(self) -> int:
        return len(self.labels)

    @property
    def tiles(self) -> DataFrame:
        """(b, r, rows, row_ptr, row_cols, row_vals, cols, col_ptr, col_rows, col_vals)"""
        return self.blocks.select("b", F.inline("tiles"))

    def rows_of_blocks(self) -> DataFrame:
        """(b, y, fold, and per tile of the block r, rows, row_ptr, row_cols, row_vals)"""
        return self.blocks.select("b", "y", "fold", *(F.col(f"tiles.{c}").alias(c) for c in ("r", *_TILE[:4])))

    def by_range(self) -> DataFrame:
        """(b, r, cols, col_ptr, col_rows, col_vals): the tiles of a range together, stored once."""
        if not self._ranged:
            n = 2 * self.blocks.sparkSession.sparkContext.defaultParallelism
            self._ranged.append(materialize(self.tiles.select("b", "r", *_TILE[4:]).repartition(n, "r")))
        return self._ranged[0]


def _packed(a: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _tile(at: np.ndarray, col: np.ndarray, w: np.ndarray) -> list[bytes]:
    by_row, by_col = np.lexsort((col, at)), np.lexsort((at, col))
    rows, row_ptr = np.unique(at[by_row], return_index=True)
    cols, col_ptr = np.unique(col[by_col], return_index=True)
    cells = [(rows, "i4"), (row_ptr, "i4"), (col[by_row], "i4"), (w[by_row], "f8"),
             (cols, "i4"), (col_ptr, "i4"), (at[by_col], "i4"), (w[by_col], "f8")]
    return [_packed(a, k) for a, k in cells]


_TILE = ["rows", "row_ptr", "row_cols", "row_vals", "cols", "col_ptr", "col_rows", "col_vals"]
_TILES = f"array<struct<r:int,{','.join(f'{n}:binary' for n in _TILE)}>>"


def _tiles_of(key: tuple, t: pa.Table) -> pa.Table:
    """The tiles of a block in one row."""
    r, at, col, w = (t[c].to_numpy() for c in ("r", "at", "col", "w"))
    order = np.argsort(r, kind="stable")
    starts = np.unique(r[order], return_index=True)[1]
    tiles = []
    for own in np.split(order, starts[1:]):
        tiles.append({"r": int(r[own[0]]), **dict(zip(_TILE, _tile(at[own], col[own], w[own]), strict=True))})
    kind = pa.list_(pa.struct([("r", pa.int32()), *((n, pa.binary()) for n in _TILE)]))
    return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "tiles": pa.array([tiles], kind)})


def prepare_design(weights: DataFrame, docs: DataFrame, vocab: Vocabulary, block_docs: int = BLOCK_DOCS,
                   term_range: int | None = None) -> Design:
    """Tiles of (doc_id, fold, term, w) and (doc_id, label, fold); a document without terms has the intercept alone.

    A document may stand in two folds, as when a model is tried on what it was trained on.
    """
    spark = docs.sparkSession
    codes = bounded(label_codes(docs))
    labels = [r["label"] for r in codes.orderBy("label_idx").collect()]
    n_docs = docs.count()
    # As many blocks and ranges as there are tasks to run at once, or as their size asks for.
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(1, min(n_docs, max(cores, -(-n_docs // block_docs))))
    term_range = term_range or min(RANGE, max(LEAST_RANGE, -(-vocab.n_terms // (2 * cores))))
    dealt = docs.join(codes, "label").select(
        "doc_id", "label", F.col("label_idx").alias("y"), "fold", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("b"))
    placed = materialize(dealt.withColumn("at", (F.row_number().over(Window.partitionBy("b").orderBy("doc_id", "fold")) - 1).cast("int")), key="doc_id")
    listed = placed.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("at", "y", "fold"))).alias("_d")) \
        .select("b", F.col("_d.y").alias("y"), F.col("_d.fold").alias("fold"))
    terms = materialize(vocab.indexed().select("term", F.floor(F.col("idx") / term_range).cast("int").alias("r"),
                                               (F.col("idx") % term_range).cast("int").alias("col")))
    entries = join_on_term(weights.select("doc_id", "fold", "term", "w"), terms, vocab).select("doc_id", "fold", "r", "col", "w")
    cells = entries.join(placed.select("doc_id", "fold", "b", "at"), ["doc_id", "fold"]).select("b", "r", "at", "col", "w").unionByName(
        placed.select("b", F.lit(INTERCEPT).alias("r"), "at", F.lit(0).alias("col"), F.lit(1.0).alias("w")))
    # Every document has an intercept, so every block has tiles. Blocks lie evenly in as many files as tasks run at once.
    tiles = cells.groupBy("b").applyInArrow(_tiles_of, f"b int, tiles {_TILES}")
    blocks = materialize(listed.join(tiles, "b").repartitionByRange(min(n_blocks, cores), "b"))
    # A number per fold and class.
    counts = {(r["fold"], r["y"]): r["count"] for r in placed.groupBy("fold", "y").count().collect()}
    return Design(blocks, placed, codes, terms, labels, counts, n_docs, vocab.n_terms, n_blocks)


def _array(value, kind, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(value, kind)
    return out if width is None else out.reshape(-1, width)


def _sums(ptr: np.ndarray, at: np.ndarray, vals: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Per run of entries, the sum of value times the dense row that the entry points to; so many entries at once."""
    out, ends = np.zeros((len(ptr), dense.shape[1])), np.append(ptr[1:], len(at))
    step = max(1, (1 << 22) // max(1, dense.shape[1]))
    k = 0
    while k < len(ptr):
        to = max(k + 1, int(np.searchsorted(ends, ptr[k] + step, side="right")))
        s, e = ptr[k], ends[to - 1]
        out[k:to] = np.add.reduceat(vals[s:e, None] * dense[at[s:e]], ptr[k:to] - s)
        k = to
    return out


# ---------------------------------------------------------------- losses

@dataclass
class Loss:
    """Columns of weights, the models they belong to, and the slope of the loss for scores of a block.

    `held` names the fold that each training set leaves out. A set has a column per class, or per pair of classes.
    """
    kind: str
    held: list[int]
    present: np.ndarray     # (sets, classes): the set has documents of the class
    c: float = 1.0
    corner: float = CORNER

    def __post_init__(self):
        self.n_classes = self.present.shape[1]
        self.pairs = list(combinations(range(self.n_classes), 2))
        self.per_set = self.n_classes if self.kind == "softmax" else max(1, len(self.pairs))
        self.width = self.per_set * len(self.held)
        #: Columns of one model share their step: the classes of a set, or a single pair.
        self.model = np.repeat(np.arange(len(self.held)), self.per_set) if self.kind == "softmax" else np.arange(self.width)
        self.n_models = int(self.model.max()) + 1

    def slopes(self, z: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives of the loss by the scores, and the loss per model; documents of the fold left out do not count."""
        out, total = np.zeros_like(z), np.zeros(self.n_models)
        for i, f in enumerate(self.held):
            train = np.flatnonzero(fold != f)
            own = slice(i * self.per_set, (i + 1) * self.per_set)
            if self.kind == "softmax":
                s = np.where(self.present[i], z[train, own], -np.inf)
                s = np.exp(s - s.max(axis=1, keepdims=True, initial=-1e300))
                p = s / s.sum(axis=1, keepdims=True)
                at = np.arange(len(train)), y[train]
                total[i] = -self.c * np.log(np.maximum(p[at], 1e-300)).sum()
                p[at] -= 1
                out[train, own] = self.c * p
                continue
            for k, (a, b) in enumerate(self.pairs):
                rows = train[(y[train] == a) | (y[train] == b)]
                sign, j = np.where(y[rows] == b, 1.0, -1.0), i * self.per_set + k
                short = 1 - sign * z[rows, j]
                out[rows, j] = -self.c * sign * np.clip(short / self.corner, 0, 1)
                total[j] = self.c * np.where(short <= 0, 0, np.where(
                    short < self.corner, short ** 2 / (2 * self.corner), short - self.corner / 2)).sum()
        return out, total

    def predicted(self, z: np.ndarray, i: int) -> np.ndarray:
        """Class by training set `i`: the highest score or the most pairs won, the smaller class on ties."""
        own, there = z[:, i * self.per_set:(i + 1) * self.per_set], self.present[i]
        if self.kind == "softmax":
            return np.argmax(np.where(there, np.round(own, 9), -np.inf), axis=1)
        votes = np.where(there, 0, -1) + np.zeros((len(z), self.n_classes), np.int64)
        for k, (a, b) in enumerate(self.pairs):
            if there[a] and there[b]:
                wins = own[:, k] > 0
                votes[:, b] += wins
                votes[:, a] += ~wins
        return np.argmax(votes, axis=1)


# ---------------------------------------------------------------- passes

def _forward(width: int):
    """(b, rows, z): scores that the terms of a range give to the documents of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                z = _sums(_array(t["row_ptr"], "i4"), _array(t["row_cols"], "i4"), _array(t["row_vals"], "f8"), _array(t["x"], "f8", width))
                yield pa.RecordBatch.from_arrays([pa.array([t["b"]], pa.int32()), pa.array([t["rows"]], pa.binary()), pa.array([z.tobytes()], pa.binary())],
                                                 ["b", "rows", "z"])
    return run


def _total_scores(key: tuple, parts: pa.Table, own: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, fold = (np.array(own[c][0].as_py(), np.int64) for c in ("y", "fold"))
    z = np.zeros((len(y), width))
    for rows, part in zip(parts["rows"], parts["z"], strict=True):
        z[_array(rows.as_py(), "i4")] += _array(part.as_py(), "f8", width)
    return z, y, fold


def _backward(width: int):
    """(r, cols, g): what a tile adds to the gradient of its terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                g = _sums(_array(t["col_ptr"], "i4"), _array(t["col_rows"], "i4"), _array(t["col_vals"], "f8"), _array(t["slopes"], "f8", width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t["r"]], pa.int32()), pa.array([t["cols"]], pa.binary()), pa.array([g.tobytes()], pa.binary()), pa.array([t["loss"] if t["r"] == INTERCEPT else None], pa.list_(pa.float64()))],
                    ["r", "cols", "g", "loss"])
    return run


def _joined(tiles: DataFrame, side: DataFrame, key: str, n_bytes: int) -> DataFrame:
    return tiles.join(F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side, key)


def _score_parts(design: Design, pieces: DataFrame, width: int) -> DataFrame:
    rows = design.tiles.select("b", "r", "rows", "row_ptr", "row_cols", "row_vals")
    return _joined(rows, pieces.select("r", "x"), "r", 8 * width * (design.n_terms + 1)) \
        .mapInArrow(_forward(width), "b int, rows binary, z binary")


def _gradient_parts(design: Design, pieces: DataFrame, loss: Loss) -> DataFrame:
    def link(key: tuple, parts: pa.Table, own: pa.Table) -> pa.Table:
        slopes, total = loss.slopes(*_total_scores(key, parts, own, loss.width))
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "slopes": pa.array([slopes.tobytes()], pa.binary()), "loss": pa.array([total.tolist()], pa.list_(pa.float64()))})

    linked = _score_parts(design, pieces, loss.width).groupBy("b").cogroup(design.blocks.select("b", "y", "fold").groupBy("b")) \
        .applyInArrow(link, "b int, slopes binary, loss array<double>")
    cols = design.tiles.select("b", "r", "cols", "col_ptr", "col_rows", "col_vals")
    return _joined(cols, linked, "b", 8 * loss.width * design.n_docs).mapInArrow(_backward(loss.width), "r int, cols binary, g binary, loss array<double>")


# ---------------------------------------------------------------- passes with whole weights

def _sent_whole(design: Design, width: int) -> bool:
    return 8 * width * (design.n_terms + 1) <= 2 * BROADCAST_BYTES


def _scores_of(block: dict, x: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, fold = np.array(block["y"], np.int64), np.array(block["fold"], np.int64)
    z = np.zeros((len(y), width))
    for t in block["tiles"]:
        z[_array(t["rows"], "i4")] += _sums(_array(t["row_ptr"], "i4"), _array(t["row_cols"], "i4"), _array(t["row_vals"], "f8"), x[t["r"]])
    return z, y, fold


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _task_gradients(loss: Loss, x):
    """(r, cols, g, loss): what all blocks of a task add to the gradient and to the loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {r: _array(v, "f8", loss.width) for r, v in x.value.items()}
        total, value = {}, np.zeros(loss.n_models)
        for block in _blocks_in(batches):
            slopes, one = loss.slopes(*_scores_of(block, weights, loss.width))
            value += one
            for t in block["tiles"]:
                if t["r"] not in total:
                    total[t["r"]] = np.zeros_like(weights[t["r"]])
                total[t["r"]][_array(t["cols"], "i4")] += _sums(_array(t["col_ptr"], "i4"), _array(t["col_rows"], "i4"), _array(t["col_vals"], "f8"), slopes)
        for r, g in total.items():
            cols = np.flatnonzero(g.any(axis=1)).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([cols.tobytes()], pa.binary()), pa.array([g[cols].tobytes()], pa.binary()),
                 pa.array([value.tolist() if r == INTERCEPT else None], pa.list_(pa.float64()))], ["r", "cols", "g", "loss"])
    return run


def _range_gradients(design: Design, loss: Loss, x, sizes: dict) -> DataFrame:
    """(r, slope, loss): gradient of the loss over all blocks per term range, without the penalty."""
    def add(key: tuple, parts: pa.Table) -> pa.Table:
        r = key[0].as_py()
        slope, value = _added(parts, sizes[r], loss)
        return pa.table({"r": pa.array([r], pa.int32()), "slope": pa.array([slope.tobytes()], pa.binary()), "loss": pa.array([value.tolist()], pa.list_(pa.float64()))})

    parts = design.blocks.mapInArrow(_task_gradients(loss, x), "r int, cols binary, g binary, loss array<double>")
    return parts.groupBy("r").applyInArrow(add, "r int, slope binary, loss array<double>")


def _added(parts: pa.Table, n: int, loss: Loss) -> tuple[np.ndarray, np.ndarray]:
    slope, value = np.zeros((n, loss.width)), np.zeros(loss.n_models)
    for cols, part in zip(parts["cols"], parts["g"], strict=True):
        slope[_array(cols.as_py(), "i4")] += _array(part.as_py(), "f8", loss.width)
    for one in parts["loss"]:
        if one.is_valid:
            value += one.as_py()
    return slope, value


def _task_slopes(loss: Loss, x):
    """(b, slopes, loss): slopes of the loss by the scores of a block's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {r: _array(v, "f8", loss.width) for r, v in x.value.items()}
        for block in _blocks_in(batches):
            y, fold = np.array(block["y"], np.int64), np.array(block["fold"], np.int64)
            z = np.zeros((len(y), loss.width))
            for r, rows, ptr, cols, vals in zip(*(block[c] for c in ("r", *_TILE[:4])), strict=True):
                z[_array(rows, "i4")] += _sums(_array(ptr, "i4"), _array(cols, "i4"), _array(vals, "f8"), weights[r])
            slopes, value = loss.slopes(z, y, fold)
            yield pa.RecordBatch.from_arrays([pa.array([block["b"]], pa.int32()), pa.array([slopes.tobytes()], pa.binary()), pa.array([value.tolist()], pa.list_(pa.float64()))],
                                             ["b", "slopes", "loss"])
    return run


def _task_sums(width: int, slopes, sizes: dict):
    """(r, cols, g): what the tiles of a task add to the gradient of each of its ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = {b: _array(v, "f8", width) for b, v in slopes.value.items()}, {}
        for t in _blocks_in(batches):
            g = total.setdefault(t["r"], np.zeros((0, width)))
            if not len(g):
                g = total[t["r"]] = np.zeros((sizes[t["r"]], width))
            g[_array(t["cols"], "i4")] += _sums(_array(t["col_ptr"], "i4"), _array(t["col_rows"], "i4"), _array(t["col_vals"], "f8"), of[t["b"]])
        for r, g in total.items():
            cols = np.flatnonzero(g.any(axis=1)).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([cols.tobytes()], pa.binary()), pa.array([g[cols].tobytes()], pa.binary())], ["r", "cols", "g"])
    return run


# ---------------------------------------------------------------- solver

_STATE = "r int, n int, mask binary, x binary, g binary, history array<binary>, tried binary, tried_g binary, dots array<double>, worst array<double>, loss array<double>"


@dataclass
class _Move:
    """What the driver decided: whether each column takes its last trial, and the next direction and step."""
    accept: np.ndarray     # per column
    mix: np.ndarray        # (vectors, columns): history and gradient to direction
    step: np.ndarray       # per column


def _settled(t: dict, move: _Move, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Weights, gradient and history after the last trial was taken or left, column by column."""
    x, g, tried, tried_g = (_array(t[c], "f8", width) for c in ("x", "g", "tried", "tried_g"))
    history = [_array(h, "f8", width) for h in t["history"]]
    pushed = [*history[2:], tried - x, tried_g - g]
    left = np.flatnonzero(~move.accept)
    if len(left) == width:
        return x, g, history

    def taken(new: np.ndarray, old: np.ndarray) -> np.ndarray:
        if len(left):
            new = new.copy()
            new[:, left] = old[:, left]
        return new

    return taken(tried, x), taken(tried_g, g), [taken(new, old) for new, old in zip(pushed, history, strict=True)]


def _trial(x: np.ndarray, g: np.ndarray, history: list[np.ndarray], move: _Move) -> np.ndarray:
    d = move.mix[-1] * g
    one = np.empty_like(d)
    for k, h in enumerate(history):
        if move.mix[k].any():
            np.multiply(move.mix[k], h, out=one)
            d += one
    d *= move.step
    d += x
    return d


@dataclass
class Fitted:
    """Solved weights: (r, n, x, g) with `width` columns each, and how the solver ended."""
    pieces: DataFrame
    loss: Loss
    rounds: int
    worst: np.ndarray       # largest gradient entry per model
    value: np.ndarray       # penalised loss per model


def _direction(gram: np.ndarray, m: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction over (s1, y1, .., sm, ym, g) from their inner products."""
    d = np.zeros(2 * m + 1)
    d[-1] = -1.0
    used = [i for i in range(m) if gram[2 * i, 2 * i + 1] > 1e-12 * max(gram[2 * i, 2 * i], 1e-300)]
    alpha = {}
    for i in reversed(used):
        alpha[i] = gram[2 * i] @ d / gram[2 * i, 2 * i + 1]
        d[2 * i + 1] -= alpha[i]
    if used:
        k = used[-1]
        d *= gram[2 * k, 2 * k + 1] / gram[2 * k + 1, 2 * k + 1]
    for i in used:
        d[2 * i] += alpha[i] - gram[2 * i + 1] @ d / gram[2 * i, 2 * i + 1]
    return d


class _Recursion:
    """The driver's side: inner products per model, directions, steps and what is accepted."""

    def __init__(self, loss: Loss):
        self.n = loss.n_models
        self.size = 2 * HISTORY + 1
        self.model = loss.model
        self.gram = np.zeros((self.n, self.size, self.size))
        self.mix = np.zeros((self.n, self.size))
        self.step = np.zeros(self.n)
        self.slope = np.zeros(self.n)
        self.done = np.zeros(self.n, bool)

    def move(self, accept: np.ndarray) -> _Move:
        return _Move(accept[self.model], self.mix[:, :][self.model].T, self.step[self.model])

    def first(self, gg: np.ndarray) -> None:
        self.gram[:, -1, -1] = gg
        self.mix[:, -1] = -1.0
        self.slope = -gg
        self.step = 1 / np.maximum(1.0, np.sqrt(gg))

    def seen(self, dots: np.ndarray) -> np.ndarray:
        """Judge the trial by products of its gradient with (history, old gradient, itself); True where it is taken."""
        along = (dots[:, :-1] * self.mix).sum(axis=1)
        # On a convex loss the slope along a direction only grows; far beyond zero the step was too long.
        accept = (along <= 0.9 * np.abs(self.slope)) & ~self.done
        for i in range(self.n):
            if self.done[i]:
                self.step[i] = 0.0
            elif accept[i]:
                self._push(i, dots[i])
                self.mix[i] = _direction(self.gram[i], HISTORY)
                self.slope[i] = self.gram[i, -1] @ self.mix[i]
                self.step[i] = 1.0
                if self.slope[i] >= 0:  # rounding spoilt the direction
                    self.mix[i] = 0
                    self.mix[i, -1] = -1.0
                    self.slope[i] = -self.gram[i, -1, -1]
                    self.step[i] = 1 / max(1.0, np.sqrt(self.gram[i, -1, -1]))
            else:
                self.step[i] *= np.clip(self.slope[i] / (self.slope[i] - along[i]), 0.1, 0.7)
        return accept

    def _push(self, i: int, dots: np.ndarray) -> None:
        """Products among (history, g) after the trial becomes the point: s and y are sums of known vectors."""
        k = self.size
        known = np.zeros((k + 1, k + 1))
        known[:k, :k] = self.gram[i]
        known[k, :], known[:, k] = dots, dots
        new = np.zeros((k, k + 1))
        for j in range(2, k - 1):
            new[j - 2, j] = 1.0
        new[k - 3, :k] = self.step[i] * self.mix[i]       # s
        new[k - 2, k], new[k - 2, k - 1] = 1.0, -1.0      # y
        new[k - 1, k] = 1.0                               # g
        self.gram[i] = new @ known @ new.T


def fit_linear(design: Design, held: list[int], kind: str = "softmax", c: float = 1.0, masks: DataFrame | None = None,
               tolerance: float | None = None, max_rounds: int = 100, corner: float = CORNER) -> Fitted:
    """Minimise |w|^2 / 2 + c * loss for every training set (all folds but the one of `held`) and class or pair.

    `masks` has (term, set) rows of the terms that a training set may use; without it all are used. Solving ends when
    no gradient entry of any model exceeds `tolerance` (1e-4 for each document, unless given), or after `max_rounds` passes.
    """
    tolerance = 1e-4 * max(1, design.n_docs) if tolerance is None else tolerance
    present = np.array([[any(n for (f, y), n in design.counts.items() if y == k and f != h) for k in range(design.n_classes)] for h in held])
    loss = Loss(kind, list(held), present, c, corner)
    model = loss.model
    whole = _sent_whole(design, loss.width)
    state = _held(design, loss, masks) if whole and 8 * loss.width * (design.n_terms + 1) * (2 * HISTORY + 4) <= DRIVER_BYTES \
        else materialize(_start(design, loss, masks))
    solver, accept = _Recursion(loss), None
    move, rounds = None, 0
    while True:
        if isinstance(state, list):
            state = found = _updated_here(design, state, loss, move)
        else:
            last, state = state, materialize((_updated_whole if whole else _updated)(design, state, loss, move))
            found = state.select("dots", "worst", "loss").collect()   # a row of products per term range
            discard(last)
        dots = sum(np.array(r["dots"]) for r in found).reshape(solver.n, solver.size + 1)
        worst = np.max([r["worst"] for r in found], axis=0)
        value = sum(np.array(r["loss"]) for r in found)
        rounds += 1
        if move is None:
            solver.first(dots[:, -1])
            accept = np.ones(solver.n, bool)
            best, bound = value, worst
        else:
            accept = solver.seen(dots)
            best, bound = np.where(accept, value, best), np.where(accept, worst, bound)
        solver.done |= bound <= tolerance
        if solver.done.all() or rounds >= max_rounds:
            break
        move = solver.move(accept)
    return Fitted(_final(design, state, accept, loss), loss, rounds, bound, best)


def _start(design: Design, loss: Loss, masks: DataFrame | None, vectors: bool = True) -> DataFrame:
    """State rows per term range, with zero weights; without `vectors` (r, n, mask) alone."""
    width, per_set, masked = loss.width, loss.per_set, masks is not None
    sizes = design.terms.groupBy("r").agg((F.max("col") + 1).alias("n"))
    sizes = sizes.unionByName(sizes.sparkSession.range(1).select(F.lit(INTERCEPT).alias("r"), F.lit(1).alias("n")))
    if masked:
        kept = masks.select("term", F.col("set").cast("int").alias("set")).join(design.terms, "term").groupBy("r").agg(
            F.collect_list(F.struct("col", "set")).alias("kept"))
        sizes = sizes.join(kept, "r", "left")
    else:
        sizes = sizes.withColumn("kept", F.lit(None).cast("array<struct<col:int,set:int>>"))

    def zero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, n, kept in zip(*(batch.column(c) for c in ("r", "n", "kept")), strict=True):
                r, n = r.as_py(), n.as_py()
                mask = np.full((n, width), not masked or r == INTERCEPT, np.uint8)
                for cell in (kept.as_py() or []) if masked else []:
                    mask[cell["col"], cell["set"] * per_set:(cell["set"] + 1) * per_set] = 1
                if not vectors:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([n], pa.int32()), pa.array([mask.tobytes()], pa.binary())], ["r", "n", "mask"])
                    continue
                none = np.zeros((n, width)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([n], pa.int32()), *(pa.array([v], pa.binary()) for v in (mask.tobytes(), none, none)),
                     pa.array([[none] * (2 * HISTORY)], pa.list_(pa.binary())), *(pa.array([none], pa.binary()) for _ in range(2)),
                     *(pa.array([[]], pa.list_(pa.float64())) for _ in range(3))],
                    ["r", "n", "mask", "x", "g", "history", "tried", "tried_g", "dots", "worst", "loss"])

    # Rows of the state stay in the files that they are dealt to here.
    n_ranges = design.terms.select("r").distinct().count() + 1
    return sizes.repartition(min(n_ranges, 2 * design.terms.sparkSession.sparkContext.defaultParallelism)).mapInArrow(zero, _STATE if vectors else "r int, n int, mask binary")


def _next_trial(t: dict, move: _Move | None, width: int) -> np.ndarray:
    return _array(t["x"], "f8", width) if move is None else _trial(*_settled(t, move, width), move)


def _measured(r: int, mask: np.ndarray, tried: np.ndarray, slope: np.ndarray, value: np.ndarray, history: list, g: np.ndarray, loss: Loss) -> tuple:
    """The trial's gradient, its products with (history, old gradient, itself), its largest entries and the penalised loss."""
    model, n_models = loss.model, loss.n_models
    tried_g = slope
    if r != INTERCEPT:
        tried_g = tried_g + tried
        value = value + np.bincount(model, (tried ** 2).sum(axis=0) / 2, n_models)
    tried_g = tried_g * mask
    per_column = np.array([np.einsum("ij,ij->j", tried_g, v) for v in (*history, g, tried_g)])
    dots = np.array([np.bincount(model, d, n_models) for d in per_column]).T
    worst = np.zeros(n_models)
    np.maximum.at(worst, model, np.abs(tried_g).max(axis=0))
    return tried_g, dots.ravel().tolist(), worst.tolist(), value.tolist()


def _next(t: dict, move: _Move | None, tried: np.ndarray, slope: np.ndarray, value: np.ndarray, loss: Loss) -> dict:
    """A range's next state: the trial, its gradient from the loss's `slope`, and products of it with the history."""
    width = loss.width
    if move is None:
        x, g, history = _array(t["x"], "f8", width), _array(t["g"], "f8", width), [_array(h, "f8", width) for h in t["history"]]
    else:
        x, g, history = _settled(t, move, width)
    tried_g, dots, worst, value = _measured(t["r"], _array(t["mask"], np.uint8, width), tried, slope, value, history, g, loss)
    return {"r": t["r"], "n": t["n"], "mask": t["mask"], "x": x.tobytes(), "g": g.tobytes(), "history": [h.tobytes() for h in history],
            "tried": tried.tobytes(), "tried_g": tried_g.tobytes(), "dots": dots, "worst": worst, "loss": value}


_STATE_KINDS = {"r": pa.int32(), "n": pa.int32(), "mask": pa.binary(), "x": pa.binary(), "g": pa.binary(), "history": pa.list_(pa.binary()),
                "tried": pa.binary(), "tried_g": pa.binary(), **{c: pa.list_(pa.float64()) for c in ("dots", "worst", "loss")}}


def _pieces(move: _Move | None, width: int):
    """(r, x): the next trial of a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks_in(batches):
            yield pa.RecordBatch.from_arrays([pa.array([t["r"]], pa.int32()), pa.array([_next_trial(t, move, width).tobytes()], pa.binary())], ["r", "x"])
    return run


def _updated(design: Design, state: DataFrame, loss: Loss, move: _Move | None) -> DataFrame:
    """One pass: the next trial of each model and its gradient."""
    def update(key: tuple, own: pa.Table, parts: pa.Table) -> pa.Table:
        t = own.to_pylist()[0]
        found = _next(t, move, _next_trial(t, move, loss.width), *_added(parts, t["n"], loss), loss)
        return pa.table({c: pa.array([found[c]], k) for c, k in _STATE_KINDS.items()})

    weights = state.mapInArrow(_pieces(move, loss.width), "r int, x binary")
    parts = _gradient_parts(design, weights, loss)
    return state.groupBy("r").cogroup(parts.groupBy("r")).applyInArrow(update, _STATE)


def _sent(design: Design, pieces: dict):
    return design.blocks.sparkSession.sparkContext.broadcast(pieces)


def _updated_whole(design: Design, state: DataFrame, loss: Loss, move: _Move | None) -> DataFrame:
    """The same with the weights sent whole; the state is not shuffled."""
    rows = state.mapInArrow(_pieces(move, loss.width), "r int, x binary").toArrow()
    x = {r: v for r, v in zip(rows["r"].to_pylist(), rows["x"].to_pylist(), strict=True)}
    sizes = {r: len(v) // (8 * loss.width) for r, v in x.items()}
    sent = _sent(design, x)
    slopes = _range_gradients(design, loss, sent, sizes).withColumnRenamed("loss", "_loss")

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks_in(batches):
            slope = np.zeros((t["n"], loss.width)) if t["slope"] is None else _array(t["slope"], "f8", loss.width)
            found = _next(t, move, _array(sent.value[t["r"]], "f8", loss.width), slope, np.array(t["_loss"] or [0.0] * loss.n_models), loss)
            yield pa.RecordBatch.from_arrays([pa.array([found[c]], k) for c, k in _STATE_KINDS.items()], list(_STATE_KINDS))

    return state.join(F.broadcast(slopes), "r", "left").mapInArrow(update, _STATE)


def _held(design: Design, loss: Loss, masks: DataFrame | None) -> list:
    """The state per term range in a file that the driver maps, with zero weights."""
    rows = _start(design, loss, masks, vectors=False).toArrow().to_pylist()
    k, out, at = 2 * HISTORY + 4, [], 0
    store = np.memmap(tempfile.TemporaryFile(), "f8", "w+", shape=(k * sum(t["n"] for t in rows), loss.width))
    for t in rows:
        own = np.asarray(store[at:at + k * t["n"]]).reshape(k, t["n"], loss.width)
        at += k * t["n"]
        out.append({"r": t["r"], "n": t["n"], "mask": _array(t["mask"], np.uint8, loss.width), "history": list(own[4:]), **dict(zip(("x", "g", "tried", "tried_g"), own))})
    return out


def _settle_here(t: dict, move: _Move) -> None:
    """`_settled` in place: vectors that are left over become the new ones."""
    left, history = np.flatnonzero(~move.accept), t["history"]
    if not len(left):
        s, y, *history = history
        np.subtract(t["tried"], t["x"], out=s)
        np.subtract(t["tried_g"], t["g"], out=y)
        t.update(history=[*history, s, y], x=t["tried"], tried=t["x"], g=t["tried_g"], tried_g=t["g"])
    elif len(left) < len(move.accept):
        own = np.flatnonzero(move.accept)
        for old, new in zip(history, history[2:]):
            old[:, own] = new[:, own]
        history[-2][:, own] = t["tried"][:, own] - t["x"][:, own]
        history[-1][:, own] = t["tried_g"][:, own] - t["g"][:, own]
        t["x"][:, own], t["g"][:, own] = t["tried"][:, own], t["tried_g"][:, own]


def _gradients_here(design: Design, loss: Loss, x, sizes: dict) -> tuple[dict, np.ndarray]:
    """Gradient of the loss per term range, and the loss."""
    if 8 * loss.width * design.n_docs > 2 * BROADCAST_BYTES:
        found = _range_gradients(design, loss, x, sizes).toArrow().to_pylist()
        return {t["r"]: _array(t["slope"], "f8", loss.width) for t in found}, sum(np.array(t["loss"]) for t in found)
    rows = design.rows_of_blocks().mapInArrow(_task_slopes(loss, x), "b int, slopes binary, loss array<double>").toArrow().to_pylist()
    slopes = _sent(design, {t["b"]: t["slopes"] for t in rows})
    parts = design.by_range().mapInArrow(_task_sums(loss.width, slopes, sizes), "r int, cols binary, g binary").toArrow().to_pylist()
    slopes.destroy()
    out = {}
    for t in parts:
        # A file of tiles may be read by several tasks.
        g = out.setdefault(t["r"], np.zeros((sizes[t["r"]], loss.width)))
        g[_array(t["cols"], "i4")] += _array(t["g"], "f8", loss.width)
    return out, sum(np.array(t["loss"]) for t in rows)


def _updated_here(design: Design, state: list, loss: Loss, move: _Move | None) -> list:
    """The same with the state kept by the driver."""
    def try_next(t: dict) -> None:
        if move is not None:
            _settle_here(t, move)
        t["tried"][:] = t["x"] if move is None else _trial(t["x"], t["g"], t["history"], move)

    def close(t: dict) -> dict:
        slope = found.get(t["r"])
        slope = np.zeros((t["n"], loss.width)) if slope is None else slope
        t["tried_g"][:], t["dots"], t["worst"], t["loss"] = _measured(
            t["r"], t["mask"], t["tried"], slope, value if t["r"] == INTERCEPT else np.zeros(loss.n_models), t["history"], t["g"], loss)
        return t

    with ThreadPoolExecutor(os.cpu_count()) as pool:
        list(pool.map(try_next, state))
        x = _sent(design, {t["r"]: t["tried"].tobytes() for t in state})
        found, value = _gradients_here(design, loss, x, {t["r"]: t["n"] for t in state})
        x.destroy()
        return list(pool.map(close, state))


def _final(design: Design, state: DataFrame | list, accept: np.ndarray, loss: Loss) -> DataFrame:
    """(r, n, x, g): each model's last accepted point."""
    width, take = loss.width, accept[loss.model][None, :]

    def last(t: dict) -> list:
        x, g = (np.where(take, _array(t[new], "f8", width), _array(t[old], "f8", width)) for new, old in (("tried", "x"), ("tried_g", "g")))
        return [t["r"], t["n"], x.tobytes(), g.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks_in(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], _STATE_KINDS[c]) for c, v in zip(("r", "n", "x", "g"), last(t), strict=True)], ["r", "n", "x", "g"])

    schema = "r int, n int, x binary, g binary"
    found = design.blocks.sparkSession.createDataFrame([last(t) for t in state], schema) if isinstance(state, list) else state.mapInArrow(run, schema)
    return materialize(found)


# ---------------------------------------------------------------- results

def predict_linear(design: Design, fitted: Fitted) -> DataFrame:
    """(set, fold, doc_id, y, p): class of each document of a fold by every training set that left the fold out."""
    loss = fitted.loss

    def named(b: int, z: np.ndarray, fold: np.ndarray) -> list[pa.Array]:
        found = [(i, np.flatnonzero(fold == f)) for i, f in enumerate(loss.held)]
        at = np.concatenate([rows for _, rows in found])
        p = np.concatenate([loss.predicted(z[rows], i) for i, rows in found])
        return [pa.array(np.repeat([i for i, _ in found], [len(rows) for _, rows in found]), pa.int32()),
                pa.array(np.full(len(at), b), pa.int32()), pa.array(at, pa.int32()), pa.array(p, pa.int32())]

    def judge(key: tuple, parts: pa.Table, own: pa.Table) -> pa.Table:
        z, _, fold = _total_scores(key, parts, own, loss.width)
        return pa.table(named(key[0].as_py(), z, fold), ["set", "b", "at", "p_idx"])

    def judge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {r: _array(v, "f8", loss.width) for r, v in x.value.items()}
        for block in _blocks_in(batches):
            z, _, fold = _scores_of(block, weights, loss.width)
            yield pa.RecordBatch.from_arrays(named(block["b"], z, fold), ["set", "b", "at", "p_idx"])

    schema = "set int, b int, at int, p_idx int"
    if _sent_whole(design, loss.width):
        rows = fitted.pieces.select("r", "x").toArrow()
        x = _sent(design, dict(zip(rows["r"].to_pylist(), rows["x"].to_pylist(), strict=True)))
        found = design.blocks.mapInArrow(judge_blocks, schema)
    else:
        found = _score_parts(design, fitted.pieces, loss.width).groupBy("b").cogroup(design.blocks.select("b", "y", "fold").groupBy("b")).applyInArrow(judge, schema)
    names = design.codes.select(F.col("label").alias("p"), F.col("label_idx").alias("p_idx"))
    return found.join(design.placed, ["b", "at"]).join(names, "p_idx").select("set", "fold", "doc_id", F.col("label").alias("y"), "p")


def weight_rows(design: Design, fitted: Fitted) -> DataFrame:
    """(term, set, column, x, g): the model as a table; the intercept has a null term.

    `column` counts classes, or pairs of classes in the order (0, 1), (0, 2), .. (1, 2), ...
    """
    width, per_set = fitted.loss.width, fitted.loss.per_set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                x, g = _array(t["x"], "f8", width), _array(t["g"], "f8", width)
                col, j = np.divmod(np.arange(x.size), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(x.size, t["r"]), pa.int32()), pa.array(col, pa.int32()), pa.array(j // per_set, pa.int32()), pa.array(j % per_set, pa.int32()), pa.array(x.ravel()), pa.array(g.ravel())],
                    ["r", "col", "set", "column", "x", "g"])

    rows = fitted.pieces.mapInArrow(run, "r int, col int, set int, column int, x double, g double")
    return rows.join(design.terms, ["r", "col"], "left").select("term", "set", "column", "x", "g")


def intercept_slopes(design: Design, fitted: Fitted) -> DataFrame:
    """(set, label, slope) for logistic regression: summed probabilities less the documents of the class."""
    rows = weight_rows(design, fitted).where("term IS NULL")
    return rows.join(design.codes, F.col("column") == F.col("label_idx")).select("set", "label", (F.col("g") / fitted.loss.c).alias("slope"))


KINDS = {"LR": "softmax", "SVM": "hinge"}


def classify_linear(name: str, weights: DataFrame, docs: DataFrame, vocab: Vocabulary, n_folds: int,
                    selected: DataFrame | None = None, design: Design | None = None, **options) -> DataFrame:
    """(fold, doc_id, y, p): LR or SVM over folds; a document of a fold from `n_folds` on trains only.

    `selected` has (fold, term) rows: each fold's training set uses its own terms. `design` is that of the same corpus, if
    it was prepared before.
    """
    masks = None
    if selected is not None:
        vocab = vocab.restrict(selected)
        masks = selected.select("term", F.col("fold").alias("set"))
    design = design or prepare_design(weights, docs, vocab)
    fitted = fit_linear(design, list(range(n_folds)), KINDS[name], masks=masks, **options)
    return predict_linear(design, fitted).drop("set")


def evaluate_with_linear(name: str, **options):
    """Fitness function for `search`: LR or SVM fitted for all candidates, runs and folds in one solve."""
    from .metrics import f1_weighted

    def evaluate(ev, masks: DataFrame, size: int, n_runs: int = 1) -> DataFrame:
        if not hasattr(ev, "design"):
            ev.design = prepare_design(ev.weights, ev.docs, ev.vocab)
        keys = [(r, f, c) for r in range(n_runs) for f in range(ev.n_folds) for c in range(size)]
        number = (F.col("run") * ev.n_folds + F.col("fold")) * size + F.col("_c")
        kept = materialize(masks.select("term", "run", "fold", F.posexplode("keep").alias("_c", "_k")).where("_k")
                           .select("term", number.cast("int").alias("set")))
        fitted = fit_linear(ev.design, [f for _, f, _ in keys], KINDS[name], masks=kept, **options)
        preds = predict_linear(ev.design, fitted)
        some = kept.select("set").distinct().withColumn("_some", F.lit(True))
        rows = masks.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(keys)], "set int, run int, fold int, cid int")
        scored = f1_weighted(preds, ("set",))
        # A candidate without features predicts nothing.
        fitness = F.when(F.col("_some"), 1.0 - F.col("f1_weighted")).otherwise(F.lit(float("inf")))
        return rows.join(scored, "set", "left").join(some, "set", "left").select("run", "fold", "cid", fitness.alias("fitness"))

    return evaluate
