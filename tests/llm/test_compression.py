"""The compression classifier on held-out labels and on odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from termsieve.llm import QUERIES, compression, workers_import
from tests.llm.test_rows import DOCS, table

SF = "/root/testdata/sf0.01"


def ranks_right(score, good):
    """Share of pairs (good, bad) in which the good one has the higher score."""
    above = score[good][:, None] - score[~good][None, :]
    return ((above > 0) + 0.5 * (above == 0)).mean()


def test_held_out_accuracy(spark):
    workers_import(spark)
    got = QUERIES["op13_compression"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    test = got.merge(labels, on="doc_id").query("held_out")
    good = (test.quality == 1).to_numpy()
    assert ranks_right(test.score.to_numpy(), good) >= 0.97
    assert (test.predicted == test.quality).mean() >= max(0.95, good.mean())
    assert abs(test.score.mean() - good.mean()) < 0.1


def test_learns_from_the_other_labels_alone(spark):
    """Turned labels of held-out documents change nothing, nor do other columns."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = compression.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", 1 - F.col("toxic"))
    bare = docs.select("doc_id", "text", F.lit("x").alias("lang"), F.lit(7).alias("good"), F.lit(1).alias("half"))
    first, second = compression.fit(docs, labels), compression.fit(bare, turned)
    assert (first.good, first.bad, first.slope, first.offset) == (second.good, second.bad, second.slope, second.offset)


def test_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample, totals = compression.labelled_sample(docs, labels, 20)
    assert {r["good"]: r["count"] for r in sample.groupBy("good").count().collect()} == {True: 20, False: 20}
    assert totals[True] > 20 and totals[False] > 20


def test_odd_rows(spark):
    words = "clean words of a plain text that tells something about a day in the hills ".split()
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, 120)) if i % 2 else " ".join(f"{x}#%&|" for x in rng.integers(0, 99, 150)), "en", "s", 1) for i in range(120)]
    rows += [(200, None, "x", None, None), (201, "", "x", None, None), (None, "clean words", "x", "y", 1), (1, rows[1][1], "x", "y", 1),
             (202, "plain text of words " * 50_000, None, None, 2)]
    docs = table(spark, rows, DOCS.replace("lang", "score").replace("source", "good"))
    labels = table(spark, [(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (5, None, 0), (999, 0, 0), (7, 0, 1), (9, 3, 0)], "doc_id long, quality int, toxic int")
    model = compression.fit(docs, labels)
    got = {(r.doc_id, r.score) for r in compression.scores(docs, model).collect()}
    by_id = dict(got)
    assert len(by_id) == len({r[0] for r in rows}) == len(got)
    assert by_id[200] == by_id[201] and by_id[202] > 0.5
    assert np.mean([(by_id[i] > 0.5) == bool(i % 2) for i in range(120)]) > 0.95
    assert compression.scores(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = table(spark, [(1, "some text", "a", "b", 1), (2, None, "a", "b", 1)], DOCS)
    none = table(spark, [], "doc_id long, quality int, toxic int")
    assert [r.score for r in compression.scores(docs, compression.fit(docs, none)).collect()] == [0.5, 0.5]
    one = compression.fit(docs, table(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r.score > 0.5 for r in compression.scores(docs, one).collect()} == {True}
    empty = table(spark, [], DOCS)
    assert compression.scores(empty, compression.fit(empty, none)).count() == 0
