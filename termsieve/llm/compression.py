"""Quality classifier by compression: a text is like the labelled texts whose dictionary makes it smaller.

One zstandard dictionary is trained on pieces of texts labelled good, one on pieces of texts labelled bad. Every
document is cut into short pieces, which say little about one another, and each piece is compressed with either
dictionary. The difference of the sizes, over the larger, is mapped to a probability by a logistic curve, fitted on
labelled texts with dictionaries that have not seen them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize

# Bytes of a piece and of a dictionary; the compressor's level.
PIECE, DICTIONARY, LEVEL = 512, 1 << 16, 3
# What is learnt from, per class: at most so many labelled documents and so many of their pieces, first by hash.
SAMPLE_ROWS, SAMPLE_PIECES = 4_000, 16_384
# Segment and match lengths of the dictionary's trainer, and the least pieces that it is given.
SEGMENT, MATCH, FEWEST = 200, 8, 16
RIDGE = 1e-3


@dataclass
class Model:
    """Dictionaries of the two classes (empty if nothing was labelled so) and the curve from difference to score."""
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0


def pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Trained on `samples`; if they are too few for that, the samples themselves."""
    if len(samples) >= FEWEST:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


class Measure:
    """Compressed-size difference of a text, from -1 (like bad texts) to 1; 0 if either dictionary is missing."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = (_compressor(good), _compressor(bad)) if good and bad else None

    def __call__(self, text: bytes | None) -> float:
        if not text or self.both is None:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in pieces(text)) for c in self.both)
        return (bad - good) / max(good, bad)


def curve(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted points; smoothed targets keep both finite."""
    n_good, n_bad = weight[good].sum(), weight[~good].sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    at, rows = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)

    def loss(b):
        z = rows @ b
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + RIDGE * b[0] ** 2 / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -500, 500)))
        slope = rows.T @ (weight * (p - target)) + [RIDGE * at[0], 0]
        bend = (rows * (weight * p * (1 - p) + 1e-12)[:, None]).T @ rows + np.diag([RIDGE, 1e-9])
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


# ---------------------------------------------------------------- learning

def held_out(doc_id: Column) -> Column:
    """One of three documents by checksum of its id: never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[bool, int]]:
    """(good, half, text) of at most `limit` labelled documents per class, and the class sizes among all labels.

    Held-out documents, null labels and ids are left out; an id labelled both ways counts as bad.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = materialize(usable.groupBy("doc_id").agg((F.min("quality") == 1).alias("good")))
    totals = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("good").orderBy(*order).limit(limit).unionByName(known.where("NOT good").orderBy(*order).limit(limit))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    chosen = chosen.select(F.col("doc_id").alias("_id"), "good", half.alias("half"))
    # At most two classes of `limit` ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return materialize(rows.select("good", "half", F.col("text").cast("string").cast("binary").alias("text"))), totals


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for good, half, text in zip(*(batch.column(c).to_pylist() for c in ("good", "half", "text")), strict=True):
            found = pieces(text or b"")
            for at in range(0, len(found), 1 << 14):
                part = found[at:at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([good] * len(part)), pa.array([half] * len(part), pa.int32()), pa.array(part, pa.binary())],
                                                 ["good", "half", "piece"])


def _trained(key: tuple, table: pa.Table) -> pa.Table:
    data = dictionary(sorted(p.as_py() for p in table["piece"]))
    return pa.table({"good": [key[0].as_py()], "without": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})


def dictionaries(sample: DataFrame, limit: int = SAMPLE_PIECES) -> dict[tuple[bool, int], bytes]:
    """By class and the half that was left out (2: none): six dictionaries at most."""
    cut = materialize(sample.mapInArrow(_cut, "good boolean, half int, piece binary"))
    order = [F.xxhash64("piece"), F.col("piece")]
    kept = cut.where("good").orderBy(*order).limit(limit).unionByName(cut.where("NOT good").orderBy(*order).limit(limit))
    parts = kept.select("good", "piece", F.explode(F.array(1 - F.col("half"), F.lit(2))).alias("without"))
    trained = parts.groupBy("good", "without").applyInArrow(_trained, "good boolean, without int, data binary")
    return {(r["good"], r["without"]): bytes(r["data"]) for r in trained.collect()}


def _differences(found: dict[tuple[bool, int], bytes]):
    """(good, x) of labelled texts, each measured by dictionaries of the other half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = [Measure(found.get((True, h), b""), found.get((False, h), b"")) for h in (0, 1)]
        for batch in batches:
            x = [measures[h.as_py()](t.as_py()) for h, t in zip(batch.column("half"), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(x, pa.float64())], ["good", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, n_pieces: int = SAMPLE_PIECES) -> Model:
    """Learn from labelled documents that are not held out: at most `rows` documents and `n_pieces` pieces a class."""
    sample, totals = labelled_sample(docs, labels, rows)
    found = dictionaries(sample, n_pieces)
    good, bad = found.get((True, 2), b""), found.get((False, 2), b"")
    measured = sample.select("good", "half", "text").mapInArrow(_differences(found), "good boolean, x double").toPandas()
    y, x = measured["good"].to_numpy(bool), measured["x"].to_numpy(float)
    if not len(x):
        return Model(good, bad)
    # Classes weigh as among all labels, however many of each were drawn.
    share = {c: totals[c] / max(1, (y == c).sum()) for c in totals}
    return Model(good, bad, *curve(x, y, np.array([share[c] for c in y])))


# ---------------------------------------------------------------- scoring

def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and difference for each row of `docs`, from whole texts and nothing else.

    Null and empty texts have the difference 0 and the score that belongs to it; so has every text when a class was
    not labelled, and the score is 0.5 when nothing was. Rows that repeat an id are scored alike if their texts are;
    other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.good, model.bad)
        for batch in batches:
            x = np.array([measure(t.as_py()) for t in batch.column("text")], float)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(x)], ["doc_id", "score", "difference"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, score double, difference double")


def op13_compression(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = scores(docs, fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op13_compression": op13_compression}
