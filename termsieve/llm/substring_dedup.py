"""Removal of repeated passages by matching statistics on sharded FM-indexes.

A window of words repeats if an earlier document (one with a smaller id) holds the same words in a row.
Equal windows have the same anchor, the smallest hash of their word n-grams. So anchors that occur in one
document only are put aside; stretches of windows under the others are sent to shards by anchor. A shard indexes
its distinct stretches once and streams them through backward search; every window found leads to the smallest
document that holds it. Copies are one stretch. An anchor with very many different stretches, such as a common
passage in ever new surroundings, is first narrowed to windows that repeat; runs of these go to shards by anchor and a
second, independent anchor, so no key gathers much in one shard and rows stay far fewer than windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .fm_index import FMIndex, matches

WINDOW = 50
# The stretches of an anchor of more documents than this are counted; if more than this differ, only its repeated
# windows are dealt out, by a second anchor.
HOT = 500
# Words of the flagged documents for each shard; windows of a stretch.
SHARD_WORDS, STRETCH = 500_000, 64


# ---------------------------------------------------------------- hashing words

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
# Bytes hashed at once.
_CHUNK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(_CHUNK, 1 << (n - 1).bit_length())
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


class Text:
    """Words of a text: `data` has them joined by one space."""

    def __init__(self, text: bytes):
        self.data = b" ".join(text.split())
        self.bytes = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        some = len(self.data) > 0
        self.starts = np.concatenate(([0], gaps + 1)) if some else np.zeros(0, np.int64)
        self.ends = np.concatenate((gaps, [len(self.data)])) if some else np.zeros(0, np.int64)
        self.n = len(self.starts)

    def hashes(self) -> np.ndarray:
        out, at = np.zeros(self.n, np.uint64), 0
        while at < self.n:
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _CHUNK, side="right")))
            part = self.bytes[base:self.ends[to - 1]]
            forward, back = _power_tables(len(part) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * forward[:len(part)], dtype=np.uint64)))
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = _mixed((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
            at = to
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every `n` hashes in a row."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for i in range(n if count > 0 else 0):
        out = out * _MULTIPLIER + hashes[i:i + count]
    return _mixed(out)


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window the smallest hash of its n-grams, a third of the window long, as a signed number."""
    n = max(1, window // 3)
    low, width, reach = grams(hashes, n), window - n + 1, 1
    if len(low) < width:
        return np.zeros(0, np.int64)
    while 2 * reach <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if width > reach:
        low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
    return low.view(np.int64)


def second_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window an anchor that is chosen independently of the first."""
    return anchors(_mixed(hashes ^ _INVERSE), window)


def _cut(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    at = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], at)), np.concatenate((at, [len(values)]))


# ---------------------------------------------------------------- passes over texts

def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchors(Text(t.as_py()).hashes(), window)) for t in batch.column("text")]
            sizes = [len(f) for f in found]
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(ids, pa.int64())], ["key", "doc_id"])
    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as words, compressed, with their number."""
    for batch in batches:
        sizes, data = [], []
        for text in batch.column("text"):
            words = (text.as_py() or b"").split()
            plain = b" ".join(words)
            sizes.append((len(words), len(plain)))
            data.append(pa.compress(plain, codec="zstd", asbytes=True))
        n, size = zip(*sizes, strict=True) if sizes else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())],
            ["doc_id", "n_words", "size", "zip"])


def _unzipped(row_zip, row_size) -> bytes:
    return pa.decompress(row_zip.as_py(), row_size.as_py(), codec="zstd", asbytes=True)


def _texts(batch: pa.RecordBatch) -> list[Text]:
    return [Text(_unzipped(z, s)) for z, s in zip(batch.column("zip"), batch.column("size"), strict=True)]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without a shared anchor are whole and need only a digest; of the others the words are kept."""
    for batch in batches:
        flagged = batch.column("keys").is_valid().to_pylist()
        digests = [None if f else hashlib.sha256(_unzipped(z, s)).hexdigest()
                   for z, s, f in zip(batch.column("zip"), batch.column("size"), flagged, strict=True)]
        kept = [z.as_py() if f else None for z, f in zip(batch.column("zip"), flagged, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "n_words", "size", "keys", "hot")] + [pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "size", "keys", "hot", "zip", "whole_sha256"])


def _pieces(route: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of windows with one anchor."""
    return [(s, min(e, s + STRETCH)) for first, e in zip(*_cut(route), strict=True) for s in range(first, e, STRETCH)]


def _hot_rows(window: int):
    """Stretches under anchors of very many documents, with the hashes of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "row", "hot")]
            for text, doc, row, hot in zip(_texts(batch), *columns, strict=True):
                hashes, hot = text.hashes(), set(hot)
                route, whole = anchors(hashes, window), grams(hashes, window).view(np.int64)
                for s, e in _pieces(route):
                    if route[s] in hot:
                        words = text.data[text.starts[s]:text.ends[e + window - 2]]
                        rows.append((int(route[s]), xxhash.xxh3_64_intdigest(words) - (1 << 63), doc, row, whole[s:e]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["key", "name", "doc_id", "row", "windows"])
    return run


def _stretches(window: int):
    """Stretches of windows under shared anchors, and runs of repeated windows under hot ones.

    The words of a stretch are sent once per task, and again only from a smaller document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "row", "keys", "hot", "tame", "windows")]
            for text, doc, row, keys, hot, tame, windows in zip(_texts(batch), *columns, strict=True):
                hashes = text.hashes()
                route = anchors(hashes, window)
                shared = {*keys, *(tame or ())}
                pieces = [(s, e, route[s]) for s, e in _pieces(route) if route[s] in shared]
                if windows:
                    whole, wild = grams(hashes, window).view(np.int64), np.array([*({*hot} - shared)], np.int64)
                    twice = np.isin(whole, np.array(windows, np.int64)) & np.isin(route, wild)
                    pair = _mixed(route.view(np.uint64) * _MULTIPLIER + second_anchors(hashes, window).view(np.uint64)).view(np.int64)
                    # Windows with the same words have the same two anchors, so they meet under one key.
                    runs = np.where(twice, pair, 0)
                    pieces += [(s, e, pair[s]) for s, e in _pieces(runs) if twice[s]]
                for s, e, key in pieces:
                    words = text.data[text.starts[s]:text.ends[e + window - 2]]
                    name = xxhash.xxh3_128_digest(words)
                    new = sent.get(name, doc + 1) > doc
                    if new:
                        sent[name] = doc
                    rows.append((name, int(key), doc, row, int(s), words if new else None))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["name", "key", "doc_id", "row", "at", "words"])
    return run


def _searched(window: int):
    """One shard: per stretch, `found` with (offset, windows, source) of its runs of windows that first occur in `source`."""
    def run(table: pa.Table) -> pa.Table:
        least, words = {}, {}
        for name, doc, text in zip(*(table[c].to_pylist() for c in ("name", "doc_id", "words")), strict=True):
            if name not in least or doc < least[name]:
                least[name] = doc
            words[name] = text
        numbers: dict[bytes, int] = {}
        texts = [[numbers.setdefault(w, len(numbers) + 1) for w in text.split(b" ")] for text in words.values()]
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        text = np.zeros(int((sizes + 1).sum()), np.int64)
        for s, t in zip(starts.tolist(), texts, strict=True):
            text[s:s + len(t)] = t
        index = FMIndex(text, window)
        docs = np.repeat(np.array([least[n] for n in words], np.int64), sizes + 1)
        source = np.minimum.reduceat(docs[index.order], index.first)
        windows = np.cumsum(np.concatenate(([0], sizes - window + 1)))
        found = np.zeros(windows[-1], np.int64)
        for which, at, group in matches(index, text, starts, sizes, window):
            found[windows[which] + at] = source[group]
        names, out = list(words), []
        for i in range(len(names)):
            own = found[windows[i]:windows[i + 1]]
            out.append([{"offset": int(s), "windows": int(e - s), "source": int(own[s])} for s, e in zip(*_cut(own), strict=True)])
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("windows", pa.int64()), ("source", pa.int64())]))
        return pa.table([pa.array(names, pa.binary()), pa.array(out, kind)], ["_name", "found"])
    return run


def _finished(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(_texts(batch), batch.column("spans"), strict=True):
                edges = np.zeros(text.n + 1, np.int64)
                for span in spans.as_py() or []:
                    edges[span["at"]] += 1
                    edges[span["at"] + span["windows"] + window - 1] -= 1
                gone = np.cumsum(edges)[:-1] > 0
                words = text.data.split(b" ") if text.n else []
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                s, e = _cut(gone) if text.n else ((), ())
                removed = [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True) if gone[a]]
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), removed))
            n, digest, removed = zip(*out, strict=True) if out else ((), (), ())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(removed, kind)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])
    return run


# ---------------------------------------------------------------- the operator

def _shared(rows: DataFrame, by: str) -> DataFrame:
    """(by, key, n) of the keys that two documents have."""
    keys = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
                       .where("lo < hi").select(F.col("key").alias("_key"), "n"))
    return rows.join(keys, F.col("key") == F.col("_key")).select(by, "key", "n")


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (spans of words) for each row of `docs`.

    Removed are the words of all windows that also start in a document with a smaller doc_id; what is looked
    for are the documents as they came. doc_id is a whole number. A null text has no word; a text of fewer words
    than a window loses none. A row without id loses nothing and takes nothing from others. Rows that repeat
    an id do not take from one another. Other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = materialize(texts.mapInArrow(_anchor_rows(window), "key long, doc_id long"))
    shared = _shared(found, "doc_id").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("n") <= hot, F.col("key"))).alias("keys"),
        F.collect_set(F.when(F.col("n") > hot, F.col("key"))).alias("hot")).withColumnRenamed("doc_id", "_id")
    zipped = rows.mapInArrow(_zipped, "doc_id long, n_words long, size long, zip binary")
    joined = zipped.join(materialize(shared), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    sifted = materialize(joined.mapInArrow(
        _digested, "doc_id long, n_words long, size long, keys array<long>, hot array<long>, zip binary, whole_sha256 string")
        .withColumn("row", F.monotonically_increasing_id()))
    flagged = sifted.where("whole_sha256 IS NULL").drop("whole_sha256")
    hot_rows = materialize(flagged.where("size(hot) > 0").select("doc_id", "row", "size", "zip", "hot").mapInArrow(
        _hot_rows(window), "key long, name long, doc_id long, row long, windows array<long>"))
    wild = materialize(hot_rows.select("key", "name").distinct().groupBy("key").agg(F.count("*").alias("n"))
                       .where(F.col("n") > hot).select(F.col("key").alias("_wild")))
    tame = hot_rows.join(wild, F.col("key") == F.col("_wild"), "left_anti").select("row", F.col("key").alias("tame"), F.lit(None).cast("long").alias("window"))
    single = hot_rows.join(wild, F.col("key") == F.col("_wild")).select("doc_id", "row", F.explode("windows").alias("key"))
    repeated = _shared(materialize(single), "row").select("row", F.lit(None).cast("long").alias("tame"), F.col("key").alias("window"))
    decided = materialize(tame.union(repeated).groupBy(F.col("row").alias("_row")).agg(
        F.collect_set("tame").alias("tame"), F.collect_set("window").alias("windows")))
    ready = flagged.join(decided, F.col("row") == F.col("_row"), "left").select("doc_id", "row", "size", "zip", "keys", "hot", "tame", "windows")
    stretches = materialize(ready.mapInArrow(_stretches(window), "name binary, key long, doc_id long, row long, at long, words binary"))
    total = flagged.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    # By number, or Spark would put several shards into one task.
    searched = materialize(stretches.where("words IS NOT NULL").select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "name", "doc_id", "words").repartition(shards, "shard").groupBy("shard")
        .applyInArrow(_searched(window), "_name binary, found array<struct<offset:bigint,windows:bigint,source:bigint>>"))
    places = stretches.select("name", "doc_id", "row", "at")
    earlier = F.transform(F.filter("found", lambda f: f["source"] < F.col("doc_id")),
                          lambda f: F.struct((F.col("at") + f["offset"]).alias("at"), f["windows"].alias("windows")))
    spans = places.join(searched, F.col("name") == F.col("_name")).select("row", earlier.alias("spans")).where("size(spans) > 0") \
        .groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("row", "_row")
    finished = flagged.select("row", "doc_id", "n_words", "size", "zip").join(materialize(spans), F.col("row") == F.col("_row"), "left") \
        .select("doc_id", "n_words", "size", "zip", "spans")
    kind = "array<struct<start:bigint,end:bigint>>"
    changed = finished.mapInArrow(_finished(window), f"doc_id long, n_words long, n_removed long, kept_sha256 string, removed {kind}")
    whole = sifted.where("whole_sha256 IS NOT NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"),
        F.array().cast(kind).alias("removed"))
    return whole.union(changed)


def op1_substrings(spark, sf: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).drop("removed")


QUERIES = {"op1_substrings": op1_substrings}
