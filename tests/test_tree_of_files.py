"""A tree of files is written and read by tasks as Spark's own writer and reader do."""

import gzip

from termsieve.sources import tables as T


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "folder", "label", "text").collect()))


def both_ways(spark, monkeypatch, path, labels=None):
    with monkeypatch.context() as m:
        m.setattr(type(spark.read), "text", None)      # the tasks read
        got = rows(T.scan_text_tree(spark, path, labels))
    with monkeypatch.context() as m:
        m.setattr(T, "_scan_in_tasks", lambda *a: None)
        want = rows(T.scan_text_tree(spark, path, labels))
    return got, want


def test_written_as_by_spark(spark, tmp_path, monkeypatch):
    data = [("en", "one\ntwo"), ("en", "one\ntwo"), ("en", ""), ("en", None), (None, "x"), ("", "y"), ("a b/c%=\u00e9", "\u00fc\U0001f600\r\n")]
    df = spark.createDataFrame(data, "label string, text string").repartition(3)
    T.sink_text_tree(df, f"file://{tmp_path}/mine")
    df.select("label", "text").write.partitionBy("label").option("maxRecordsPerFile", 1).text(f"{tmp_path}/spark")
    strip = lambda found: sorted(r[1:] for r in found)
    got, same = both_ways(spark, monkeypatch, f"file://{tmp_path}/mine")
    assert got == same
    assert strip(got) == strip(both_ways(spark, monkeypatch, f"{tmp_path}/spark")[1])
    assert len({r[0] for r in got}) == len(data)


def test_read_as_by_spark(spark, tmp_path, monkeypatch):
    for name, content in {"a/1.txt": b"x\r\ny", "a/2": b"", "a/_hidden": b"n", "a/.n": b"n", "a/bad": b"\xff\xfeok", "b c/1%20.txt": b"z",
                          "b c/\u00e9#?.txt": b"u", "a/z.txt.gz": gzip.compress(b"packed"), "_no/1": b"n", "d/deep/1": b"n", "d/1": b"d"}.items():
        file = tmp_path / "t" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    got, want = both_ways(spark, monkeypatch, f"{tmp_path}/t")
    assert got == want and len(got) >= 6
    got, want = both_ways(spark, monkeypatch, f"{tmp_path}/t", {"a": 1, "d": 2, "none": 3})
    assert got == want and {r[2] for r in got} == {1, 2}
