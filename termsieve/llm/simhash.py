"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within 4 bits share a variant that is within 2 bits of both. So every distinct fingerprint emits
all its variants within 2 bits, variants are shuffled, and fingerprints that meet in one are linked.

A fingerprint has 2,081 variants. They are not moved as rows: a block of fingerprints sends, for each range of
hashed variants, one sorted and compressed run of shortened hashes. A range finds the hashes that occur more
than once and tells the blocks, which then emit only these variants, whole, as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .components import connected_components

SEED, SHINGLE, RADIUS = 42, 4, 4
# Fingerprints of a block: its variants take 8 bytes each while a task works on them.
BLOCK = 2048
# Hashed variants of a range, about; and bits by which hashes are longer than the logarithm of their number.
RANGE_KEYS, SPARE_BITS = 1 << 20, 8


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the shingles' hashes; 0 for a text without a word."""
    data = b" ".join((text or b"").lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    if len(starts) > shingle:
        starts, ends = starts[:len(starts) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(data[s:e], SEED) for s, e in zip(
            starts[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist(), strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long. Null and empty texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- variants

def ball(radius: int) -> np.ndarray:
    """Masks of all changes of at most `radius` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << bit for m in masks for bit in range(64)}
    return np.array(sorted(masks), dtype=np.uint64)


def hashed_variants(fps: np.ndarray, masks: np.ndarray, bits: int) -> np.ndarray:
    """The upper `bits` of a mixed hash of every variant, one row per fingerprint."""
    v = fps[:, None] ^ masks[None, :]
    v ^= v >> np.uint64(32)
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v >>= np.uint64(64 - bits)
    return v


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed gaps, byte plane by byte plane."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def meeting_variants(fps: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK,
                     range_keys: int = RANGE_KEYS) -> DataFrame:
    """(variant, fp) of the variants, within half of `radius`, that two fingerprints may share.

    `fps` has `n` distinct fp. Every variant that is shared is returned with all its fingerprints; a few
    that only share a shortened hash come along.
    """
    masks = ball(radius // 2)
    total = max(2, n * len(masks))
    bits = min(64, math.ceil(math.log2(total)) + SPARE_BITS)
    range_bits = max(0, math.ceil(math.log2(total / range_keys)))
    shift, blocks = np.uint64(bits - range_bits), max(1, math.ceil(n / block))
    placed = fps.select("fp", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("block"))

    def emit(table: pa.Table) -> pa.Table:
        keys = np.sort(hashed_variants(_unsigned(table["fp"]), masks, bits), axis=None)
        at = np.searchsorted(keys, np.arange(1, 1 << range_bits, dtype=np.uint64) << shift)
        runs = np.split(keys, at)
        low = np.uint64((1 << int(shift)) - 1)
        rows = [(i, len(k), packed(k & low)) for i, k in enumerate(runs) if len(k)]
        ranges, sizes, data = zip(*rows, strict=True)
        return pa.table({"range": pa.array(ranges, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int32()),
                         "size": pa.array(sizes, pa.int32()), "keys": pa.array(data, pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        runs = [unpacked(d.as_py(), s.as_py()) for d, s in zip(table["keys"], table["size"], strict=True)]
        every = np.sort(np.concatenate(runs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        top = np.uint64(table["range"][0].as_py()) << shift
        hits = [np.unique(run[_found(run, twice)]) | top for run in runs]
        rows = [(b.as_py(), h.tobytes()) for b, h in zip(table["block"], hits, strict=True) if len(h)]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "hits": pa.array([r[1] for r in rows], pa.binary())})

    def tell(own: pa.Table, told: pa.Table) -> pa.Table:
        fps_here = _unsigned(own["fp"]) if own.num_rows else np.zeros(0, np.uint64)
        hits = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h.as_py(), np.uint64) for h in told["hits"])]))
        variants, owners = [], []
        for part in np.array_split(fps_here, max(1, len(fps_here) // 256)):
            row, col = np.nonzero(_found(hashed_variants(part, masks, bits), hits))
            variants.append(part[row] ^ masks[col])
            owners.append(part[row])
        return pa.table({"variant": np.concatenate(variants).view(np.int64), "fp": np.concatenate(owners).view(np.int64)})

    # By number, or Spark would put these few bytes, and with them all the work, into a few tasks.
    placed = placed.repartition(blocks, "block")
    runs = placed.groupBy("block").applyInArrow(emit, "range int, block int, size int, keys binary")
    hits = runs.groupBy("range").applyInArrow(meet, "block int, hits binary")
    return placed.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(tell, "variant long, fp long")


def _found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of `keys` are in the sorted array `among`."""
    if not len(among):
        return np.zeros(keys.shape, bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


# ---------------------------------------------------------------- components

def near_edges(fps: DataFrame, n: int, radius: int = RADIUS, **options) -> DataFrame:
    """(a, b): links whose components are those of all pairs within `radius` bits.

    All fingerprints around one variant are within `radius` of one another, so linking each to the smallest
    loses nothing; a variant has at most as many neighbours as its ball has points.
    """
    groups = meeting_variants(fps, n, radius, **options).groupBy("variant").agg(F.collect_set("fp").alias("fps")) \
        .where(F.size("fps") > 1)
    edges = groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    return edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`; component_id is the smallest doc_id reachable.

    Copies have one fingerprint and are linked once. Null, empty and wordless texts share fingerprint 0, which
    is linked like any other. A null doc_id gets its component but never names one, unless all are null.
    Rows that repeat an id are each fingerprinted. An empty table gives an empty result.
    """
    found = materialize(fingerprints(docs, shingle))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_edges(distinct.select("fp"), distinct.count(), radius))
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root"))
    named = materialize(rooted.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"))
    return found.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs` for each component: that of the smallest doc_id, with all its columns.

    If rows repeat that id, the first of them in the order of their values stays. Rows without an id stay.
    """
    kept = near_duplicates(docs.where("doc_id IS NOT NULL"), **options).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    order = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row"))
    chosen = first.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return chosen.unionByName(docs.where("doc_id IS NULL"))


def op3_simhash(spark, sf: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
