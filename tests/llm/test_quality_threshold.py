"""The fixed threshold on labelled documents of both classes."""

from termsieve.llm import quality

SF = "/root/testdata/sf0.01"


def test_most_bad_documents_go_and_good_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    loose = {r.doc_id for r in quality.keep_good(docs, labels, threshold=-100.0).collect()}
    of = {q: {r.doc_id for r in labels.where(f"quality = {q}").collect()} & loose for q in (0, 1)}
    assert len(of[0] & kept) <= 0.15 * len(of[0]) and of[1] <= kept
