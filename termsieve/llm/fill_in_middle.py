"""Fill-in-the-middle rewriting of whole texts, cut by a sparse index of multibyte characters.

Texts are cut between code points, but held as UTF-8 bytes. Only characters of more than one byte are recorded,
with their place and the bytes they take beyond the first. A cut after so many code points is moved by the excess
of the recorded characters before it, which one binary search finds; where none is recorded, places are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
# Of 100 texts so many are rewritten, and of 100 rewritten ones so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
# Bytes looked at at once while an index is made.
CHUNK = 1 << 20


class CharIndex:
    """Code points of UTF-8 bytes and the byte at which each starts, kept for multibyte characters alone."""

    def __init__(self, data: bytes):
        places, excess, last = [], [], -2
        for at in range(0, 0 if data.isascii() else len(data), CHUNK):
            part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
            inner = np.flatnonzero((part & 0xC0) == 0x80) + at
            # A character is known by its first inner byte; the others only lengthen it.
            new = np.diff(inner, prepend=last) != 1
            starts = np.flatnonzero(new)
            if len(inner) and not new[0]:  # the character began in an earlier chunk
                next(e for e in reversed(excess) if len(e))[-1] += starts[0] if len(starts) else len(inner)
            places.append(inner[starts] - 1)
            excess.append(np.diff(np.append(starts, len(inner))))
            last = int(inner[-1]) if len(inner) else last
        at = np.concatenate([np.zeros(0, np.int64), *places])
        #: Excess bytes before each recorded character, and after the last.
        self.before = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *excess]))))
        #: Code points before each recorded character.
        self.points = at - self.before[:-1]
        self.n = len(data) - int(self.before[-1])

    def byte(self, point: int) -> int:
        """Bytes taken by the first `point` code points."""
        return point + int(self.before[np.searchsorted(self.points, point)])

    def point(self, byte: int) -> int:
        """Code points in the first `byte` bytes, which end between two characters."""
        return byte - int(self.before[np.searchsorted(self.points + self.before[:-1], byte)])


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rewritten(data: bytes, doc_id: int | None, seed: str = SEED, rate: int = RATE,
              suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and of middle, and the text as it is to be learnt."""
    index, (h1, h2, h3, h4) = CharIndex(data), draws(doc_id, seed)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not data or p in data or s in data or m in data or h3 % 100 >= rate:
        return index.n, "plain", None, None, data
    first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.byte(first), index.byte(last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < suffix_first:
        return index.n, "spm", first, last - first, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", first, last - first, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for each row of `docs`.

    A null text is empty; an empty text, one with a marker inside, and those that chance leaves out stay plain, with
    null cuts. A cut may lie at either end, so parts can be empty. Rows that repeat an id are cut by the same draws; a
    null id draws like an empty one. Texts of any length are cut whole. Other columns are ignored; an empty table gives
    an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rewritten(t.as_py() or b"", i.as_py(), seed, rate, suffix_first)
                    for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    cut = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that `output` was made of. A rewritten text holds each marker once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    # <P>prefix<S>suffix<M>middle, or <S>suffix<P>prefix<M>middle.
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))) \
        .when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output)


def op12_fill_in_middle(spark, sf: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
  ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM drawn),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts"""}
