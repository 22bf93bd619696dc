"""Repeated passages, near-duplicates, url groups and embeddings against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termsieve.llm import components, embedding_dedup, simhash, substring_dedup, url_filter, workers_import
from termsieve.llm.fm_index import FMIndex, WaveletMatrix, matches


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    workers_import(spark)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def smallest_reachable(ids, linked):
    """Smallest id reachable; `linked` is a matrix."""
    label = list(ids)
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(ids))]
        if new == label:
            return label
        label = new


# ---------------------------------------------------------------- components

def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 400)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)]
    pairs += [(7, 7), (None, 3), (3, None), (2, 1), (1, 2), (1, 2)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    ids = sorted({x for p in real for x in p})
    linked = np.zeros((len(ids), len(ids)), bool)
    for a, b in real:
        i, j = ids.index(a), ids.index(b)
        linked[i, j] = linked[j, i] = True
    assert got == dict(zip(ids, smallest_reachable(ids, linked)))
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---------------------------------------------------------------- repeated passages

def test_wavelet_rank():
    rng = np.random.default_rng(2)
    for n_symbols, n in ((2, 10), (5, 64), (300, 1000), (1000, 129)):
        symbols = rng.integers(0, n_symbols, n)
        tree = WaveletMatrix(symbols, n_symbols)
        ask, at = rng.integers(0, n_symbols, 200), rng.integers(0, n + 1, 200)
        assert list(tree.rank(ask, at)) == [int((symbols[:k] == c).sum()) for c, k in zip(ask, at)]


def test_backward_search_finds_all_windows():
    rng = np.random.default_rng(3)
    window, texts = 6, [rng.integers(1, 4, rng.integers(6, 60)) for _ in range(30)]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for s, t in zip(starts, texts):
        text[s:s + len(t)] = t
    index, seen = FMIndex(text, window), {}
    for which, at, group in matches(index, text, starts, sizes, window):
        for w, a, g in zip(which, at, group):
            seen[w, a] = {int(p) for p in index.order[index.first[g]:index.last[g]]}
    assert len(seen) == (sizes - window + 1).sum()
    where = {}
    for s, t in zip(starts, texts):
        for a in range(len(t) - window + 1):
            where.setdefault(tuple(t[a:a + window]), set()).add(int(s + a))
    assert all(seen[w, a] == where[tuple(texts[w][a:a + window])] for w, a in seen)


def kept_of(rows, window):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k:k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [500, 2])
def test_remove_repeats(spark, hot):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(n))
    passage, page = prose(70), prose(400)
    rows = [(i, prose(rng.randrange(40)) + " " + passage + "\n" + prose(rng.randrange(40))) for i in range(40)]
    rows += [(i, page) for i in (50, 51, 49)] + [(60, page.replace("a", "zz", 3)), (61, page[:900] + " é " + page[700:])]
    rows += [(70, "same " * 300), (71, "same " * 60), (72, "same " * 49), (73, None), (74, ""), (75, " \t\n"), (None, page), (None, page)]
    rows += [(80, prose(200) + " " + page), (80, page), (-3, prose(5) + " " + passage[:-1]), (90, "w " * 20 + prose(20000))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = substring_dedup.remove_repeats(docs, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == kept_of(rows, 50)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_remove_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(empty).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in substring_dedup.remove_repeats(one).collect()] == [(1, 0, 0)]


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text):
    w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        w = [rng.choice(["Ab", "cd", "é", "THE", "of", "x1"]) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 300))]
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join(w)))
            w[rng.randrange(len(w))] = "changed"
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1004, "other row"), (None, rows[5][1]), (1005, "long " * 30000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    prints = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    groups = smallest_reachable([10 ** 6 if i is None else i for i, _ in rows], np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = sorted(((i, f, g) for (i, _), f, g in zip(rows, prints.tolist(), groups)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({i for i, _, g in want if i == g} | {None}, key=str)
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_links_up_to_four_bits(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    found = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for c in centres for k in (1, 2, 3, 4, 5, 7)]
    fps = np.unique(np.concatenate((centres, np.array(found, np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.near_edges(df, len(fps), block=64, range_keys=1 << 12)).collect()}
    signed = fps.view(np.int64).tolist()
    want = smallest_reachable(signed, np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert [roots.get(x, x) for x in signed] == want


# ---------------------------------------------------------------- urls

def test_url_groups(spark):
    def page(*tags):
        return "<html><head>" + "".join(tags) + "</head></html>"
    canonical = '<LINK href="{}" rel="canonical">'.format
    refresh = '<meta http-equiv=Refresh content="0; URL={}">'.format
    rows = [(1, "http://A.net/x", None), (2, "http://m.example.net/en/1?q#f", page()), (3, "https://example.net/en", page()), (4, None, page(canonical("http://a.net/x"))),
            (5, "no scheme", page(canonical("/x"))), (6, "http://plain.com/a", page(canonical("https://b.net/?u=1&amp;v=2"))), (7, "http://plain.com/b#top", page(refresh("a"))),
            (8, "http://x.org/fr/p", page(canonical("http://plain.com/a"))), (9, "http://other.com/1", page(canonical("//x.org/fr/p"))), (10, "http://free.com/", page(canonical("/"))),
            (11, "http://free.com/q", page(canonical("/z"))), (12, "https://free.com/z#a", ""), (12, "https://free.com/z#a", ""), (13, "http://www.example.com/de/", None),
            (14, "http://notexample.com/de/", None), (15, "http://a.net", None), (16, "ftp://example.com/de/x://y", None), (17, "http://listed.com/", None), (None, "http://u.net/", "x")]
    links = spark.createDataFrame([("http://listed.com/", "http://gone.com/"), ("http://gone.com/", "http://www.example.com/de/")], "source string, target string")
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge_urls(pages, links=links).collect()}
    assert got == {
        (1, "a.net", "/x"): ("net/", "block"), (2, "m.example.net", "/en/1"): ("example.net/en/", "allow"), (3, "example.net", "/en"): ("net/", "block"),
        (4, "", ""): (None, "allow"), (5, "", ""): (None, "allow"), (6, "plain.com", "/a"): (None, "block"), (7, "plain.com", "/b"): (None, "block"),
        (8, "x.org", "/fr/p"): ("org/fr/", "allow"), (9, "other.com", "/1"): (None, "block"), (10, "free.com", "/"): (None, "allow"),
        (11, "free.com", "/q"): (None, "allow"), (12, "free.com", "/z"): (None, "allow"), (13, "www.example.com", "/de/"): ("example.com/de/", "block"),
        (14, "notexample.com", "/de/"): (None, "allow"), (15, "a.net", ""): (None, "allow"), (16, "example.com", "/de/x://y"): ("example.com/de/", "block"),
        (17, "listed.com", "/"): (None, "block"), (None, "u.net", "/"): ("net/", "block")}
    import duckdb
    frame = pages.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT AS page_id, url, html FROM frame")
    want = con.execute(url_filter.ORACLES["op4_url_filter"]).fetchall()
    ours = [tuple(r) for r in url_filter.judge_urls(pages).collect()]
    assert sorted(ours, key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- embeddings

def test_hadamard():
    h = embedding_dedup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8 ** -0.5)


@pytest.mark.parametrize("block", [1024, 5])
def test_embeddings(spark, block):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(80):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=24) * 0.2]))
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(1100, [2 * x for x in rows[4][1]])]
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [None] + [1.0] * 23), (2003, [float("nan")] * 24), (2004, [float("inf")] + [1.0] * 23), (2005, []), (None, rows[3][1])]
    short = [(2100, [1.0, 2.0, 3.0]), (2101, [1.0, 2.0, 3.01]), (5, [9.0])]
    data = [(i, v, "x") for i, v in rows + odd + short]
    rng.shuffle(data)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, rep string"), block=block).collect()
    assert len(got) == len(data)
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    groups = smallest_reachable([i for i, _ in rows], linked)
    want = [(i, int(n), g) for (i, _), n, g in zip(rows, linked.sum(1), groups)]
    want += [(i, 0, i) for i, _ in odd] + [(2100, 1, 2100), (2101, 1, 2100), (5, 0, 5)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("size", [2, 16, 64, 300])
def test_tables_follow_the_count(size):
    """Pairs at exactly the threshold meet, however many vectors there are."""
    counts = [10**4, 10**6, 10**8, 10**10]
    tables = [embedding_dedup.tables_needed(n, size) for n in counts]
    assert tables == sorted(tables) and tables[0] >= embedding_dedup.TABLES
    x, y = embedding_dedup.threshold_pairs(400, size, embedding_dedup.THRESHOLD, 99)
    assert np.allclose((x * y).sum(axis=1), embedding_dedup.THRESHOLD)
    for n, t in zip(counts, tables, strict=True):
        assert embedding_dedup.meetings(x, y, n, t, embedding_dedup.PROBES).any(axis=1).mean() >= (0.9 if size == 2 else 0.965), (n, t)


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
