"""Cuts of whole texts against Python's own code points, and exact rebuilding."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from termsieve.llm import fill_in_middle as fim, workers_import
from tests.conftest import SF
from tests.llm.test_rows import DOCS, table


def brute(i, text):
    text = text or ""
    digest, n = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), len(text)
    h1, h2, h3, h4 = (int(x, 16) for x in re.findall("." * 8, digest)[:4])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé€😀\n<P>SM"), max_size=40), st.integers(1, 9))
def test_index_finds_code_points(text, chunk):
    before, fim.CHUNK = fim.CHUNK, chunk
    try:
        index = fim.CharIndex(text.encode())
    finally:
        fim.CHUNK = before
    assert index.n == len(text)
    for k in range(len(text) + 1):
        assert index.byte(k) == len(text[:k].encode()) and index.point(index.byte(k)) == k


def test_index_records_multibyte_characters_alone():
    assert len(fim.CharIndex(b"plain " * 1000).points) == 0
    assert fim.CharIndex("aéb€😀".encode()).points.tolist() == [1, 3, 4]
    for broken in (b"\x80\x80a", b"\xf0", b"a\xe2\x82", b"\xff\xfe\xc3"):
        index = fim.CharIndex(broken)
        assert 0 <= index.n <= len(broken) and all(0 <= index.byte(k) <= len(broken) for k in range(index.n + 1))


TEXTS = [None, "", "x", "é", "<P>", "a<S>b", "ends with <M>", "<<P", "almost <P and S> and M>", "😀" * 50, "line\nline\r\n\t", "aé€😀 " * 9000, "w " * 200_000]


@pytest.mark.parametrize("start", [0, 1000])
def test_rows(spark, start):
    workers_import(spark)
    rows = [(start + 13 * k + j, t, "psm", "<S>", k) for k in range(8) for j, t in enumerate(TEXTS)] + [(None, "no id", "a", "b", 1), (start, "again", "a", "b", 1)]
    docs = table(spark, rows, DOCS.replace("lang", "form").replace("source", "output"))
    cut = fim.fill_in_middle(docs)
    got = cut.withColumn("back", fim.restored("output", "form")).collect()
    assert sorted(map(str, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == \
        sorted(map(str, [(i, *brute(i, t)) for i, t, *_ in rows]))
    texts = sorted((str(i), t or "") for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.back) for r in got) == texts
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_rates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(fim.fill_in_middle(docs, rate=0).select("form").distinct().toPandas().form) == {"plain"}
    every = fim.fill_in_middle(docs, seed="other", rate=100, suffix_first=100).where(F.col("n") > 0)
    assert set(every.select("form").distinct().toPandas().form) == {"spm"}
