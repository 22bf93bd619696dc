"""The pipeline against a plain Python version of all its stages."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from termsieve.llm import ORACLES, QUERIES, mixing, packing, pii, quality
from tests.conftest import SF
from tests.llm.test_graphs import brute_fingerprint, smallest_reachable
from tests.llm.test_rows import base_counts, words_of


def good_documents(docs, labels):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def number(x):
        return (x % (1 << 64)).to_bytes(8, "little")

    def buckets(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words_of(text)]
        pairs = [signed(xxhash.xxh64_intdigest(number(b), xxhash.xxh64_intdigest(number(a), 42))) for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h + pairs]

    trusted = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    raw, good = Counter(), Counter()
    for d in docs:
        raw.update(buckets(d.text))
        good.update(buckets(d.text) if d.doc_id in trusted else [])
    a, b = good.total() + quality.BUCKETS, raw.total() + quality.BUCKETS
    return [d for d in docs if not base_counts(d.text)[-1]
            and np.mean([np.log((good[x] + 1) / a) - np.log((raw[x] + 1) / b) for x in buckets(d.text)]) >= quality.THRESHOLD]


def first_of_groups(docs):
    prints = np.array([brute_fingerprint(d.text) for d in docs], np.uint64)
    groups = smallest_reachable([d.doc_id for d in docs], np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    return [d for d, g in zip(docs, groups) if d.doc_id == g]


def copies(docs):
    """Repetitions of each document."""
    sizes = Counter(d.source for d in docs)
    weight = {s: mixing.TARGET_WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in sizes}
    out = {}
    for d in docs:
        rate = len(docs) * weight[d.source] / sum(weight.values()) / sizes[d.source]
        u = int(hashlib.md5(f"draw-{mixing.SEED}-{d.doc_id}".encode()).hexdigest()[:15], 16) / 2 ** 60
        k, term, low = 0, np.exp(-rate), 0.0
        while low + term < u:
            low, k = low + term, k + 1
            term *= rate / k
        out[d.doc_id] = k
    return out


def test_pipeline_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = first_of_groups(good_documents(docs, labels))
    times = copies(kept)
    encoder = packing.tokens(packing.default_vocabulary())
    want = {d.doc_id: [*encoder.encode(pii.pseudonymized(d.text, pii.KEY)[0], allowed_special="all"), 0] for d in kept if times[d.doc_id]}
    got, sequences = defaultdict(Counter), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id][r.start, r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
        ids = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert int(np.uint32(r.ids_crc32)) == __import__("zlib").crc32(ids.tobytes())
    assert set(got) == set(want)
    for i, pieces in got.items():
        assert sum(length * n for (_, length), n in pieces.items()) == times[i] * len(want[i])
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= packing.WINDOW


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    from tests.compare import differences
    assert differences(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()) == ""
