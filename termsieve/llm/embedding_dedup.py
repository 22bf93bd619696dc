"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms; the coordinate of largest size, with its sign,
is its hash. Several hashes make a bucket, several tables of buckets are kept, and in each table a vector also
enters the next likely buckets. More vectors need more hashes per bucket, and more hashes more tables, whose number
follows from how often pairs at the threshold meet in one. Vectors that meet in a bucket are compared by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .components import connected_components

SEED, TABLES, PROBES = 7, 6, 4
THRESHOLD = 0.95
# Share of the pairs at exactly the threshold that the tables have to bring together, and pairs drawn to plan it.
RECALL, PLAN_PAIRS, PLAN_TABLES = 0.99, 512, 8
# Vectors of one side of a comparison; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
TABLE_BITS = 56


# ---------------------------------------------------------------- hashing

def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        step *= 2
    return x.reshape(rows, width) / math.sqrt(width)


def rotated(x: np.ndarray, seed: list[int]) -> np.ndarray:
    for signs in np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, x.shape[1])):
        x = hadamard(x * signs)
    return x


def padded_width(size: int) -> int:
    """Power of two that vectors are padded to; signs of fewer than 32 places give too few rotations."""
    return 1 << max(5, (size - 1).bit_length())


def hashes_needed(n: int, width: int) -> int:
    """Hashes per bucket, so that there are more buckets than vectors."""
    enough = math.ceil(math.log(4 * max(n, 2)) / math.log(2 * width))
    return max(1, min(enough, int(TABLE_BITS / math.log2(2 * width))))


def buckets(x: np.ndarray, n: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket numbers, the likeliest first; tables share no number."""
    width = padded_width(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = []
    for table in range(tables):
        codes, losses = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for hash_no in range(hashes_needed(n, width)):
            y = rotated(x, [seed, table, hash_no])
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(size, near, 1)
            code = 2 * near + (np.take_along_axis(y, near, 1) > 0)
            loss = (losses[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * (2 * width) + code[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            codes, losses = np.take_along_axis(codes, best, 1), np.take_along_axis(loss, best, 1)
        fill = np.full((len(x), probes - codes.shape[1]), -1)  # fewer buckets than probes
        out.append(np.concatenate((codes, np.where(fill < 0, codes[:, :1], fill)), axis=1) + (table << TABLE_BITS))
    return np.stack(out, axis=1)


def threshold_pairs(rows: int, width: int, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and partners at a cosine of `threshold`."""
    x, y = np.random.default_rng(seed).standard_normal((2, rows, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y


def meetings(x: np.ndarray, y: np.ndarray, n: int, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables): whether a pair shares a bucket of a table."""
    left, right = buckets(x, n, tables, probes, seed), buckets(y, n, tables, probes, seed)
    return (left[:, :, :, None] == right[:, :, None, :]).any(axis=(2, 3))


def tables_needed(n: int, size: int, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL) -> int:
    """Tables that bring `recall` of the pairs at the threshold together, at least TABLES.

    How often such a pair meets in one table is measured on random pairs under other rotations than those in use.
    Table numbers have 7 bits, so there are at most 127; 56 bits of hashes need fewer at the thresholds in use.
    """
    if size < 2:  # the cosine is 1 or -1
        return TABLES
    x, y = threshold_pairs(max(32, min(PLAN_PAIRS, (1 << 17) // size)), size, threshold, SEED + 1)
    share = meetings(x, y, n, PLAN_TABLES, probes, SEED + 1).mean()
    if share >= 1:
        return TABLES
    return max(TABLES, min(127, math.ceil(math.log(1 - recall) / math.log(1 - max(share, 0.001)))))


def _hash(n: int, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            sizes = vectors.value_lengths().to_numpy()
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(sizes)
            found = np.zeros((len(sizes), tables * probes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.stack([flat[ends[r] - size:ends[r]] for r in rows])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                found[rows] = buckets(x, n, tables, probes).reshape(len(rows), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables * probes, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), lists], ["rep", "buckets"])
    return run


# ---------------------------------------------------------------- comparing

def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of `n` positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(x: np.ndarray, side: np.ndarray, crossing: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs, a < b; with `crossing`, only those of different sides."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norms = np.sqrt((x * x).sum(axis=1))
    if crossing:
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
        i, j = np.nonzero(x[left] @ x[right].T >= threshold * norms[left][:, None] * norms[right][None, :])
        a, b = left[i], right[j]
        return np.minimum(a, b), np.maximum(a, b)
    return np.nonzero(np.triu(x @ x.T >= threshold * norms[:, None] * norms[None, :], 1))


def _first_meeting(own: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int, tables: int) -> np.ndarray:
    """Whether `bucket` is the first that the pairs a, b share."""
    own = own.reshape(len(own), tables, -1)
    none = np.iinfo(np.int64).max
    first = np.full(len(a), none)
    for at in range(0, len(a), 1 << 14):
        left, right = own[a[at:at + (1 << 14)]], own[b[at:at + (1 << 14)]]
        same = (left[:, :, :, None] == right[:, :, None, :]).any(axis=3)
        first[at:at + (1 << 14)] = np.where(same, left, none).min(axis=(1, 2))
    return first == bucket


def _compare(threshold: float, tables: int):
    names = ["rep", "n", "root"]

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([table[c].to_numpy() for c in ("dim", "bucket", "x", "y")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        vec, own = table["vec"].combine_chunks().flatten().to_numpy(), table["buckets"].combine_chunks().flatten().to_numpy()
        places = np.concatenate(([0], np.cumsum(key[:, 0])))
        own = own.reshape(len(key), -1)
        rep, mult, side = (table[c].to_numpy() for c in ("rep", "mult", "sub"))
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            crossing = key[s, 2] != key[s, 3]
            if crossing and (side[s:e] == side[s]).all():
                continue
            a, b = _linked(vec[places[s]:places[e]].reshape(e - s, -1), side[s:e], crossing, threshold)
            if not len(a):
                continue
            root = _components(e - s, a, b)
            new = _first_meeting(own[s:e], a, b, key[s, 1], tables)
            a, b, n = a[new], b[new], np.zeros(e - s, np.int64)
            np.add.at(n, a, mult[s:e][b])
            np.add.at(n, b, mult[s:e][a])
            told = (n > 0) | (root != np.arange(e - s))
            out.append((rep[s:e][told], n[told], rep[s:e][root[told]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = np.stack([table[c].to_numpy() for c in ("dim", "bucket", "x", "y")], axis=1)
            inside = np.flatnonzero((key != key[-1]).any(axis=1))  # rows come sorted by key
            whole = int(inside[-1]) + 1 if len(inside) else 0
            if whole:
                yield from groups(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield from groups(held)
    return run


def near_links(reps: DataFrame, n: int, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES,
               block: int = BLOCK) -> DataFrame:
    """(rep, n, root): per bucket, how many vectors `rep` is linked with for the first time, and the smallest
    position of its group there. `reps` has rep, vec (doubles), mult (how many copies). Without `tables` their
    number follows the count and the widths of the vectors."""
    spark = reps.sparkSession
    sizes = reps.select("rep", F.size("vec").alias("dim"))
    if tables is None:
        widths = sizes.groupBy(F.ceil(F.log2("dim")).alias("bits")).agg(F.max("dim").alias("size")).collect()  # at most 32
        tables = max((tables_needed(n, r["size"], threshold, probes) for r in widths), default=TABLES)
    hashed = materialize(reps.select("rep", "vec").mapInArrow(_hash(n, tables, probes), "rep long, buckets array<long>")
                         .join(sizes, "rep"))
    entered = hashed.select("rep", "dim", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = materialize(entered.groupBy("dim", "bucket").agg(F.count("*").alias("m")).where("m > 1")
                         .select(F.col("dim").alias("_dim"), F.col("bucket").alias("_bucket"), F.ceil(F.col("m") / block).cast("int").alias("parts")))
    met = entered.join(shared, (F.col("dim") == F.col("_dim")) & (F.col("bucket") == F.col("_bucket"))) \
        .select(F.col("rep").alias("_rep"), "bucket", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("sub"))
    whole = materialize(reps.join(hashed.select(F.col("rep").alias("_r"), "buckets", "dim"), F.col("rep") == F.col("_r")).drop("_r"))
    rows = met.join(whole, F.col("_rep") == F.col("rep")).select(
        "rep", "vec", "mult", "buckets", F.col("dim").cast("long").alias("dim"), "bucket", F.col("sub").cast("long").alias("sub"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    paired = rows.withColumn("x", F.least("sub", "other").cast("long")).withColumn("y", F.greatest("sub", "other").cast("long")).drop("other")
    key = ["dim", "bucket", "x", "y"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(
        _compare(threshold, tables), "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding); other columns are ignored.

    Equal vectors are compared once and counted as often as they occur. Vectors of different lengths are not
    linked. A row without a vector, with a zero vector, or with null or non-finite components is linked with
    nothing and is its own component, and so is a row without id. Rows that repeat an id are vectors of their own.
    An empty table gives an empty result.
    """
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, vec).alias("vec"))
    reps = materialize(rows.where("vec IS NOT NULL").groupBy("vec").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("mult")).withColumn("rep", F.monotonically_increasing_id()))
    links = materialize(near_links(reps.select("rep", "vec", "mult"), reps.count(), threshold, **options))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "_c")
    roots = connected_components(links.where("rep <> root"), "rep", "root").withColumnRenamed("root", "_root")
    rooted = materialize(reps.select("rep", "vec", "first", "mult").join(counts, F.col("rep") == F.col("_c"), "left")
                         .join(roots, F.col("rep") == F.col("node"), "left")
                         .select("vec", "first", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                                 F.coalesce("_root", "rep").alias("group")))
    smallest = materialize(rooted.groupBy("group").agg(F.min("first").alias("component_id")).withColumnRenamed("group", "_g"))
    named = materialize(rooted.join(smallest, F.col("group") == F.col("_g")).select(F.col("vec").alias("_vec"), "n_links", "component_id"))
    found = rows.join(named, F.col("vec") == F.col("_vec"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {"op7_embeddings": op7_embeddings}
