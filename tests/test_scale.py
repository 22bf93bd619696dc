"""Steps in smaller forms give the same rows."""

import random

from termsieve.operators import tree, vectorize
from termsieve.operators.vectorize import char_tokens, pack_terms, term_rows, unpack_terms
from termsieve.plans.corpus import build_corpus, count_corpus
from termsieve.runtime import WRITERS, materialize


def grown(corpus, **options):
    trees = tree.grow(corpus.weights, corpus.docs, 2, **options)
    return sorted(map(repr, trees.nodes.collect())), sorted(map(repr, trees.places.collect())), trees.depth


def test_small_nodes_finished_in_tasks_give_the_same_trees(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij kl \u00e9\u00e9 mn".split(), k=7)), rng.choice("xyz"), i % 2) for i in range(60)]
    rows += [(70, None, "x", 0), (71, "", "y", 1), (72, "none", "z", 0), (None, "ab cd", "z", 1), (73, "ab ab cd", "x", None)]
    rows += rows[:2] + [(5, "ab cd ef", "y", 1)]   # repeated rows, and one id with two texts
    c = build_corpus(spark.createDataFrame(rows, "doc_id long, text string, label string, fold int"), min_df=2)
    assert grown(c) == grown(c, task_entries=-1) == grown(c, task_entries=90)
    assert grown(c, max_depth=1) == grown(c, max_depth=1, task_entries=-1)


def test_rounding_as_sql_does(spark):
    values = [0.0078125, 0.0015625, 5.0078125, 1234.0000005, 2.5e-6, 1 / 3, 7.0000015, 100.1234565]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 6)").collect()]
    assert tree._rounded(tree.np.array(values)).tolist() == want


def test_packed_terms_come_back(spark):
    texts = ["one two two", None, "", "a\x01b\x01\x01c", "ab", "x yé\U0001f600z  w", "\x02\x03\x04"]
    rows = term_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), char_tokens(3))
    packed = pack_terms(rows)
    assert unpack_terms(packed).sort("doc_id").collect() == rows.sort("doc_id").collect()
    # Only a row whose terms hold the separator, or that has no terms, travels as an array.
    assert [r.doc_id for r in packed.where("terms IS NOT NULL").sort("doc_id").collect()] == [1, 2, 3, 4]


def test_entries_of_a_large_vocabulary_go_to_their_document_once(spark, monkeypatch, capsys):
    rows = [(i, "ab cd ef " + "gh ij " * (i % 3) + "kl" * (i % 2), "xy"[i % 2]) for i in range(20)] + [(30, None, "x"), (3, "ab zz zz", "x")]
    counted = count_corpus(spark.createDataFrame(rows, "doc_id long, text string, label string"), min_df=2)
    want = vectorize.transform_with_vocabulary(counted.counts, counted.vocab)
    monkeypatch.setattr(vectorize, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(vectorize, "HOT_SHARE", 1)
    monkeypatch.setattr(vectorize.join_on_term, "__defaults__", ("term", 1, "inner", 2, None))
    got = vectorize.transform_with_vocabulary(counted.counts, counted.vocab)
    assert [(*r[:-1], round(r.w, 9)) for r in got.sort("doc_id", "label", "term").collect()] == \
        [(*r[:-1], round(r.w, 9)) for r in want.select(got.columns).sort("doc_id", "label", "term").collect()]
    got.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").explain()
    assert capsys.readouterr().out.count("hashpartitioning(doc_id") == 1


def test_entries_in_buckets_stay_there(spark, monkeypatch, capsys):
    rows = [(i, " ".join(f"t{j:02d}" for j in range(40) if i % (j + 1) == 0), "xy"[i % 2]) for i in range(200)]
    counted = count_corpus(spark.createDataFrame(rows, "doc_id long, text string, label string"), min_df=2)
    want = vectorize.transform_with_vocabulary(counted.counts, counted.vocab)
    monkeypatch.setattr(vectorize.Vocabulary, "hot_share", lambda self: 1)
    monkeypatch.setattr(vectorize.join_on_term, "__defaults__", ("term", 1, "inner", 5, None))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = vectorize.transform_with_vocabulary(counted.counts, counted.vocab)
    assert sorted((*r[:-1], round(r.w, 9)) for r in got.select(want.columns).collect()) == sorted((*r[:-1], round(r.w, 9)) for r in want.collect())
    got.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").explain()
    plan = capsys.readouterr().out
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Only the rare entries move back, below the union with the others.
    assert plan.index("Union") < plan.index("Exchange hashpartitioning(doc_id")
    assert plan.count("hashpartitioning(doc_id") == 1


def test_buckets_are_written_without_a_sort(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, v, f=type(spark.conf).set: (seen.append((k, v)), f(self, k, v))[1])
    before = spark.conf.get(WRITERS)
    table = materialize(spark.range(100).withColumnRenamed("id", "doc_id"), key="doc_id")
    assert seen == [(WRITERS, "2"), (WRITERS, before)] and spark.conf.get(WRITERS) == before
    assert sorted(r.doc_id for r in table.collect()) == list(range(100))
    assert len(table.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
