"""Packing tokenized documents into training windows by online sum-of-squares placement.

Each task tokenizes the documents of its partition and places them as they come. A document is cut into whole
windows and one rest. The rest goes into the fill level that makes the sum of squared counts of partially
filled windows smallest; only the number of open windows per level is looked at. When a task has read all its
documents, what lies in the emptiest open windows is cut to fill the fullest.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

WINDOW, END = 1024, 0
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
SEQUENCES_PER_TASK = 1 << 40


@functools.cache
def tokens(path: str):
    """The vocabulary's encoder; its ids equal those of the `tokenizers` file of the same vocabulary."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


class Levels:
    """Open windows by fill level; `place` chooses the level by the sum of squares."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)  # the full level stays at zero
        self.open: dict[int, list[int]] = {}
        self.opened = 0

    def new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a rest of `size` ids, 0 < size < window. Ties go to the fullest level."""
        n = self.counts
        below, above = n[1:self.window - size + 1], n[1 + size:]
        change = 2 * (above - below) + 2
        change[-1] -= 1  # a filled window is no longer counted
        change[below == 0] = np.iinfo(np.int64).max
        at = len(change) - int(np.argmin(change[::-1]))  # the level itself: index + 1
        if change[at - 1] >= 2 * n[size] + 1:
            at, sequence = 0, self.new()
        else:
            sequence = self.open[at].pop()
            n[at] -= 1
        if at + size < self.window:
            n[at + size] += 1
            self.open.setdefault(at + size, []).append(sequence)
        return sequence, at


Piece = tuple  # doc_id, start, ids as bytes, ids of the document


def evened(open_windows: list[list[Piece]], window: int) -> None:
    """Fill the fullest windows with ids cut from the end of the emptiest, until one at most has room."""
    sizes = [sum(len(p[2]) // 4 for p in pieces) for pieces in open_windows]
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    giver, taker = 0, len(order) - 1
    while giver < taker:
        give, take = order[giver], order[taker]
        doc, start, ids, total = open_windows[give].pop()
        moved = min(len(ids) // 4, window - sizes[take])
        kept = len(ids) // 4 - moved
        if kept:
            open_windows[give].append((doc, start, ids[:4 * kept], total))
        if moved:
            open_windows[take].append((doc, start + kept, ids[4 * kept:], total))
        sizes[give], sizes[take] = sizes[give] - moved, sizes[take] + moved
        taker -= sizes[take] == window
        giver += sizes[give] == 0


def _rows(sequences: list[tuple[int, list[Piece]]], kind: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    rows, ids_of = [], []
    for sequence, pieces in sequences:
        offset = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
            offset += len(ids) // 4
            if with_ids:
                ids_of.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
    kinds = [kind, *[pa.int64()] * 6]
    columns = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        columns, names = [*columns, pa.array(ids_of, type=pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def _packed(batches: Iterator[pa.RecordBatch], path: str, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, levels = tokens(path), Levels(window)
    base, kind = TaskContext.get().partitionId() * SEQUENCES_PER_TASK, pa.int64()
    waiting: dict[int, list[Piece]] = {}  # pieces of open windows
    for batch in batches:
        filled, kind = [], batch.schema.field("doc_id").type
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            found = encoder.encode(text.as_py() or "", allowed_special="all")
            ids, total, doc = np.array([*found, END], dtype="<u4").tobytes(), len(found) + 1, doc.as_py()
            for start in range(0, total, window):
                size = min(window, total - start)
                sequence, offset = (levels.new(), 0) if size == window else levels.place(size)
                pieces = waiting.pop(sequence, [])
                pieces.append((doc, start, ids[4 * start:4 * (start + size)], total))
                if offset + size == window:
                    filled.append((base + sequence, pieces))
                else:
                    waiting[sequence] = pieces
        if filled:
            yield _rows(filled, kind, with_ids)
    evened(list(waiting.values()), window)
    rest = [(base + sequence, pieces) for sequence, pieces in waiting.items() if pieces]
    if rest:
        yield _rows(rest, kind, with_ids)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids.

    A document is its ids and one end id; a null text is empty, so it is one piece of one id. Each id lies in
    exactly one piece; pieces of a sequence follow one another from offset 0 without gaps. Rows that repeat an
    id are packed as documents of their own, a null id stays null, other columns are ignored, and an empty
    table gives no piece. Each task leaves one window with room at most. The same input partitions give the same
    sequences, also when a task is run again.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _packed(batches, path, window, with_ids),
                           schema + (", ids array<int>" if with_ids else ""))


def op8_packing(spark, sf: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf}/documents.parquet"), with_ids=False)


QUERIES = {"op8_packing": op8_packing}
