"""The manifest against plain hashing of every tree, also where trees span several rounds of blocks."""

import hashlib
import zlib

import pytest

from termsieve.llm import QUERIES, merkle, workers_import
from tests.conftest import SF
from tests.llm.test_rows import DOCS, table


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root, and per node its siblings (left, right) from below."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for path, i in zip(paths, at):
            path.append(("".join(runs[i // 3][:i % 3]), "".join(runs[i // 3][i % 3 + 1:])))
        nodes, at = [h("".join(r)) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, t, lang, source, n in rows:
        cut = t if t is None or i is None or zlib.crc32(str(i).encode()) % 2 else t.replace("\n", "")
        groups.setdefault(source, []).append((i, brute_leaf(i, source, lang, n, t), brute_leaf(i, source, lang, n, cut)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = climb([r[1] for r in groups[s]])
    if not names:
        return []
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, above):
        for (i, leaf, claimed), own in zip(groups[s], trees[s][1]):
            path, fold = own + upper, claimed
            for left, right in path:
                fold = h(left + fold + right)
            out.append((i, leaf, trees[s][0], root, h("".join(a + b for a, b in path)), fold, fold == root))
    return out


def found(spark, docs):
    held = merkle.proofs(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", merkle.tampered_leaf())
    return [(r.doc_id, r.leaf, r.subroot, r.root, h("".join(s.left + s.right for s in r.path)), r.folded_root, r.verified) for r in held.collect()]


ODD = [(i, f"text {i}\nof {'é' * (i % 5)}\n", "en", "hot", i) for i in range(65)] + [
    (70, None, None, None, None), (71, "", "de", None, 0), (72, "a\nb", None, "", 3), (None, "null id\n", "en", "hot", 1),
    (5, "text 5\nof \n", "en", "hot", 5), (5, "another\n", "en", "hot", 5), (73, "x\n" * 9000, "fr", "Zürich", 7), (74, "one", "fr", "z", 1),
    (75, "-", "-", "-", 1), (76, "3:a", "=", "=", 1)] + [(100 + i, f"g{i}\n", "en", f"group{i}", i) for i in range(9)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_hashing(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** levels)
    docs = table(spark, ODD, DOCS).selectExpr("*", "'x' AS tree", "1 AS hash", "2 AS m", "3 AS nodes")
    assert sorted(map(str, found(spark, docs))) == sorted(map(str, brute_manifest(ODD)))


def test_small_tables(spark):
    assert found(spark, table(spark, [], DOCS)) == []
    for rows in ([ODD[0]], ODD[65:67], [(1, "a", "b", "c", 1)] * 4):
        assert sorted(map(str, found(spark, table(spark, rows, DOCS)))) == sorted(map(str, brute_manifest(rows)))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PATH_ROWS", 0)
    monkeypatch.setattr(merkle, "OFFSET_ROWS", 0)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    assert sorted(map(str, found(spark, table(spark, ODD, DOCS)))) == sorted(map(str, brute_manifest(ODD)))


def test_query_over_the_table(spark):
    workers_import(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = [tuple(r) for r in QUERIES["op11_merkle"](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))
    assert {r[6] for r in got} == {True, False}
