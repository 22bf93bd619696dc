import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termsieve.operators import classify, filters, linear, metrics, population, sample, split, steps, vectorize
from termsieve.plans import reports, wrapper
from termsieve.plans.corpus import build_corpus
from termsieve.runtime import ranked

TEXTS = {"x": "red apple pie sweet apple", "y": "blue metal car fast road", "z": "green leaf tree tall root"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        label = "xyz"[i % 3] if i < 57 else "x"
        words = rng.choices(TEXTS[label].split(), k=6) + rng.choices("common words every where".split(), k=3)
        rows.append((i, " ".join(words), label))
    rows += [(60, "", "y"), (61, None, "z"), (62, "unseen", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


@pytest.fixture(scope="module")
def corpus(docs):
    folds = split.stratified_folds(docs, 3).select("doc_id", "fold")
    return build_corpus(docs.join(folds, "doc_id"), min_df=2)


def test_ranks_agree_on_both_paths(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("v"))
    for by in (["g"], []):
        a = ranked(rows, by, [F.col("v")]).collect()
        b = ranked(rows, by, [F.col("v")], window_rows=10).collect()
        assert sorted(a) == sorted(b)


def test_hot_terms_join_like_others(corpus):
    side = corpus.vocab.terms.select("term", F.col("df").alias("x"))
    entries = corpus.weights.select("doc_id", "term")
    for how in ("inner", "left"):
        a = vectorize.join_on_term(entries, side, corpus.vocab, how=how).select("doc_id", "term", "x").collect()
        b = vectorize.join_on_term(entries, side, corpus.vocab, how=how, limit=0).select("doc_id", "term", "x").collect()
        assert sorted(a) == sorted(b)


@pytest.mark.parametrize("limit", [0, 10])
def test_large_selections_join_alike(corpus, monkeypatch, limit):
    """Salted and broadcast frequent terms, a selection that lacks the most frequent term, and a dictionary of stems."""
    monkeypatch.setattr(vectorize, "HOT_SHARE", 2)
    entries = corpus.weights.select("doc_id", "fold", "term")
    side = corpus.vocab.terms.select("term", F.col("df").alias("x"))
    for how in ("inner", "left"):
        joined = vectorize.join_on_term(entries, side, corpus.vocab, how=how, limit=limit).select("doc_id", "term", "x")
        assert sorted(joined.collect()) == sorted(entries.join(side, "term", how).select("doc_id", "term", "x").collect())
    most = corpus.vocab.terms.orderBy(F.desc("df"), "term").first()["term"]
    some = corpus.vocab.terms.where(F.col("term") != most).select("term", F.lit("s").alias("stem"))
    want = sorted(entries.join(some, "term", "left_semi").select("doc_id", "term").collect())
    assert sorted(filters.apply_selection(entries, some, limit).select("doc_id", "term").collect()) == want
    got = vectorize.conflate_tokens(entries, some, limit).groupBy("term").count().collect()
    n_most = entries.where(F.col("term") == most).count()
    assert {(r["term"], r["count"]) for r in got} == {(most, n_most), ("s", len(want))}


def test_salts_split_a_term_of_every_document(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.explode(F.array(
        F.lit("all"), F.concat(F.lit("t"), F.col("id") % 3000))).alias("term"))
    vocab = vectorize.fit_vocabulary(rows, 20_000, 1)
    assert [(r["term"], r["salts"]) for r in vocab.hot().collect()] == [("all", 500)]
    sizes = vectorize.salted_entries(rows, vocab, ["term"]).groupBy("term", "_salt").count().agg(F.sum("count"), F.max("count")).first()
    assert sizes[0] == 20_000 and sizes[1] <= 2 * 40_000 / vocab.hot_share()


def test_only_entries_of_rare_terms_are_shuffled(spark, monkeypatch):
    """Beyond the limit the most frequent terms, as many as it holds, stay where they are; ties are all in or all out."""
    monkeypatch.setattr(vectorize, "HOT_SHARE", 4)
    rows = spark.range(1_000).select(F.col("id").alias("doc_id"), F.explode(F.array(
        F.lit("all"), F.concat(F.lit("s"), F.col("id") % 10), F.concat(F.lit("r"), F.col("id") % 500))).alias("term"))
    vocab = vectorize.fit_vocabulary(rows, 1_000, 1)
    assert {r["term"] for r in vocab.frequent(11).collect()} == {"all", *(f"s{i}" for i in range(10))}
    assert [r["term"] for r in vocab.frequent(10).collect()] == ["all"] and vocab.frequent(0).count() == 0
    side = vocab.terms.select("term", F.col("df").alias("x"))
    limit = max(11, vocab.hot_share())
    for how in ("inner", "left", "left_semi"):
        joined = vectorize.join_on_term(rows, side, vocab, how=how, limit=limit, back="doc_id")
        assert sorted(joined.collect()) == sorted(rows.join(side, "term", how).select(*joined.columns).collect())


def test_search_ends_at_its_budget(corpus):
    ev = population.prepare_evaluation(corpus.weights, corpus.docs, corpus.vocab, 3)
    for method, budget in (("abc", 9), ("de", 6), ("ga", 3)):
        found = wrapper.search(ev, method, 4, budget, 1)
        assert found.evaluations == budget and found.results.count() == 3
        assert all(r["fitness"] <= 1 for r in found.results.collect())


def test_wrapper_run(docs):
    """What is kept is the search's own selection, and predictions are those of a model fitted on it."""
    halves = docs.withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train"))
    options = {"size": 3, "budget": 3, "n_runs": 1, "n_folds": 2, "evaluator": "mnb"}
    run = wrapper.wrapper_run(halves, ("ga",), {"words": ("word", "tfidf")}, 2, **options)
    held = build_corpus(halves, min_df=2, fit_on="train")
    scores = wrapper.select_features(*held.part("train"), held.vocab, "ga", **options)
    kept = population.support_mask(scores)
    assert sorted(r["term"] for r in run.selected.collect()) == sorted(r["term"] for r in kept.collect())
    inside = held.weights.join(kept.select("term"), "term", "left_semi")
    want = wrapper.BAYES["MNB"](inside.where("split = 'train'"), held.part("train")[1], inside.where("split = 'test'"), held.part("test")[1], held.vocab.restrict(kept))
    assert sorted(run.preds.select("doc_id", "y", "p").collect()) == sorted(want.select("doc_id", "y", "p").collect())
    lines = [r["line"] for r in reports.wrapper_lines(run.preds, run.selected, run.seconds).orderBy("line_no").collect()]
    assert lines[0] == "Feature model-scheme: words" and lines[1].startswith("ga | Average acc:") and len(lines) == 2


def test_short_text_has_no_grams(spark):
    rows = spark.createDataFrame([(1, "ab", "x"), (2, "ab\U0001F600d", "x")], "doc_id long, text string, label string")
    assert sorted(r["term"] for r in vectorize.char_ngrams(rows).collect()) == ["ab\U0001F600", "b\U0001F600d"]


def test_rows_have_unit_length(corpus):
    norms = corpus.weights.groupBy("doc_id").agg(F.sum(F.col("w") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_folds_partition_and_balance(docs):
    rows = split.stratified_folds(docs, 3).collect()
    assert len(rows) == 63 and len({r["doc_id"] for r in rows}) == 63
    for label in "xyz":
        sizes = [sum(r["label"] == label and r["fold"] == f for r in rows) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_ties_go_to_later_terms(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", float("nan")), ("d", 2.0)], "term string, score double")
    assert [r["term"] for r in filters.select_k_best(scores, 4).orderBy("rank").collect()] == ["d", "b", "a", "c"]


def test_selection_keeps_weights(corpus):
    best = filters.select_k_best(filters.chi2_scores(corpus.weights, corpus.docs), 3)
    kept = filters.apply_selection(corpus.weights, best)
    assert kept.join(corpus.weights.select("doc_id", "term", F.col("w").alias("v")), ["doc_id", "term"]).where("w <> v").count() == 0


def test_every_document_is_predicted(corpus, docs):
    for name in ("MNB", "NB"):
        from termsieve.plans.experiments import classify_over_folds
        preds = classify_over_folds(corpus, name, 3)
        assert preds.count() == docs.count() and preds.where("p is null").count() == 0
        micro = {r["fold"]: r["f1_micro"] for r in metrics.f1_micro(preds, ("fold",)).collect()}
        acc = {r["fold"]: r["accuracy"] for r in metrics.accuracy(preds, ("fold",)).collect()}
        assert micro == pytest.approx(acc)
        assert metrics.confusion_matrix(preds).agg(F.sum("n")).first()[0] == docs.count()


def test_unknown_labels_raise(spark):
    train = spark.createDataFrame([(1, "a")], "doc_id long, label string")
    test = spark.createDataFrame([(2, "b")], "doc_id long, label string")
    with pytest.raises(Exception, match="unseen label"):
        sample.encode_labels(train, test).collect()
    with pytest.raises(Exception, match="unknown category"):
        sample.map_label(train.withColumnRenamed("label", "category"), {"b": 1}).collect()


def test_report_by_hand(spark):
    preds = spark.createDataFrame([(0, "a", "a"), (1, "a", "b"), (2, "b", "b"), (3, "c", "b")], "doc_id long, y string, p string")
    rows = {r["name"]: r for r in metrics.classification_report(preds).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["f1"]) == (1.0, 0.5, 0.667)
    assert (rows["b"]["precision"], rows["b"]["recall"], rows["b"]["f1"]) == (0.333, 1.0, 0.5)
    assert rows["c"]["f1"] == 0.0 and rows["accuracy"]["f1"] == 0.5
    assert rows["macro avg"]["f1"] == 0.389 and rows["weighted avg"]["f1"] == 0.458


# ---------------------------------------------------------------- populations

def genes(spark, *candidates):
    """One row per dimension; the last one holds the thresholds."""
    rows = [(0, 0, d, None if d == len(candidates[0]) - 1 else f"t{d}", [float(c[d]) for c in candidates])
            for d in range(len(candidates[0]))]
    return spark.createDataFrame(rows, "run int, fold int, dim int, term string, xs array<double>")


def test_last_gene_is_the_threshold(spark):
    kept = population.decode_mask(genes(spark, [0.123, 0.57, 0, 0.78, 1]))
    assert [r["keep"] for r in kept.orderBy("dim").collect()] == [[False]] * 4
    fixed = population.decode_mask(genes(spark, [0.123, 0.57, 0, 0.78, 1]), split=0.5)
    assert [r["keep"][0] for r in fixed.orderBy("dim").collect()] == [False, True, False, True, True]


def test_vote_and_fallback(spark):
    votes = [(0, d, f"t{d}", bool(v)) for d, v in enumerate([1, 1, 0])] + [(1, d, f"t{d}", bool(v)) for d, v in enumerate([1, 0, 0])]
    rows = spark.createDataFrame(votes, "fold int, dim int, term string, selected boolean")
    assert [r["score"] for r in population.vote_features(rows, 2).orderBy("dim").collect()] == [1, 0, 0]
    none = rows.withColumn("selected", F.lit(False))
    scores = population.ensure_nonempty(population.vote_features(none, 2))
    assert [r["score"] for r in scores.orderBy("dim").collect()] == [1, 0, 0]


def test_equal_runs_keep_the_first(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.5), (1, 0, 0.4), (1, 1, 0.3)], "fold int, run int, fitness double")
    assert sorted((r["fold"], r["run"]) for r in population.best_per_fold(rows).collect()) == [(0, 0), (1, 1)]


def test_empty_mask_is_worst_and_chunks_agree(corpus, monkeypatch):
    ev = population.prepare_evaluation(corpus.weights, corpus.docs, corpus.vocab, 3)
    pop = population.init_population(population.gene_dims(corpus.vocab), 5, 1, 2, 3)
    # Candidate 0 has an unreachable threshold.
    pop = pop.withColumn("xs", F.when(F.col("term").isNull(), F.transform("xs", lambda x, c: F.when(c == 0, 2.0).otherwise(x))).otherwise(F.col("xs")))
    masks = population.decode_mask(pop)
    whole = sorted(population.evaluate_population(ev, masks, 5, 2).collect())
    assert len(whole) == 30
    assert all((r["fitness"] == float("inf")) == (r["cid"] == 0) for r in whole)
    monkeypatch.setattr(population, "CHUNK", 2)
    assert sorted(population.evaluate_population(ev, masks, 5, 2).collect()) == whole


def test_distances(spark):
    pop = genes(spark, [0.0, 0.5, 1.0], [0.5, 0.5, 0.0], [1.0, 0.0, 0.0])
    got = np.array(steps.distances(pop).first()["r2"])
    x = np.array([[0.0, 0.5, 1.0], [0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    assert np.allclose(got, ((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("method", ["ga", "abc", "harmony", "pso", "cuckoo"])
def test_search_never_gets_worse(corpus, method):
    ev = population.prepare_evaluation(corpus.weights, corpus.docs, corpus.vocab, 3)
    found = wrapper.search(ev, method, size=4, budget=12, n_runs=1, seed=5)
    assert found.evaluations >= 12
    for fold in range(3):
        best = [h[3] for h in found.history if h[2] == fold]
        assert best == sorted(best, reverse=True)
    scores = wrapper.reduce_runs(found, 3)
    assert scores.count() == corpus.vocab.n_terms and scores.agg(F.sum("score")).first()[0] >= 1


# ---------------------------------------------------------------- ML classifiers

def test_logistic_regression_meets_its_optimum(corpus):
    docs, weights = (df.withColumn("fold", F.lit(1)) for df in (corpus.docs.drop("fold"), corpus.weights.drop("fold")))
    design = linear.prepare_design(weights, docs, corpus.vocab)
    model = linear.weight_rows(design, linear.fit_linear(design, [0])).toPandas()
    w = model.pivot(index="term", columns="column", values="x")
    x = weights.select("doc_id", "term", "w").toPandas().pivot(index="doc_id", columns="term", values="w").fillna(0.0)
    y = docs.join(design.codes, "label").toPandas().set_index("doc_id")["label_idx"]
    x = x.reindex(index=y.index, columns=w.index.dropna()).fillna(0.0).to_numpy()
    p = np.exp(x @ w[w.index.notna()].to_numpy() + w[w.index.isna()].to_numpy())
    p /= p.sum(1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ x + w[w.index.notna()].to_numpy().T
    assert np.abs(gradient).max() < 1e-2


def test_all_classifiers_learn(corpus):
    out = classify.classify_all(corpus.weights.drop("fold"), corpus.docs.drop("fold"), corpus.weights.drop("fold"),
                                corpus.docs.drop("fold"), corpus.vocab)
    acc = {r["classifier"]: r["accuracy"] for r in metrics.accuracy(out, ("classifier",)).collect()}
    assert set(acc) == set(classify.CLASSIFIERS) and min(acc.values()) > 0.8
    assert metrics.accuracy(out, ("classifier",)).count() == len(acc)


def test_classifier_as_evaluator(corpus):
    ev = population.prepare_evaluation(corpus.weights, corpus.docs, corpus.vocab, 3)
    pop = population.init_population(population.gene_dims(corpus.vocab), 1, 1, 1, 3)
    everything = population.decode_mask(pop, split=0.0).where("term is not null")
    rows = {r["fold"]: r["fitness"] for r in classify.evaluate_with_classifier("LR")(ev, everything, 1).collect()}
    bayes = {r["fold"]: r["fitness"] for r in population.evaluate_population(ev, everything, 1).collect()}
    assert len(rows) == 3 and all(abs(rows[f] - bayes[f]) < 0.2 for f in rows), (rows, bayes)


def test_schemes_share_counts(docs, monkeypatch):
    """Texts are tokenized once per analyzer; weights equal those of a corpus of its own."""
    from termsieve.plans import corpus as K
    seen = []
    monkeypatch.setattr(K, "term_rows", lambda d, tokens, made=K.term_rows: seen.append(1) or made(d, tokens))
    halves = docs.withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train"))
    schemes = {f"{a}-{w}": (a, w) for a in ("linguistic", "char3") for w in ("tfidf", "tf", "binary")}
    built = list(K.build_corpora(halves, schemes, 2, "train"))
    assert [name for name, _ in built] == list(schemes) and len(seen) == 2
    for name, corpus in built:
        own = build_corpus(halves, *schemes[name], 2, "train")
        rows = [{(r["doc_id"], r["term"]): round(r["w"], 9) for r in c.weights.collect()} for c in (corpus, own)]
        assert rows[0] == rows[1] and rows[0] and corpus.vocab.n_terms == own.vocab.n_terms


def test_k_sweep_judges_in_shards(corpus):
    """Hits of every k equal those of a model fitted on the k best terms alone, however documents are dealt; no row per document and k."""
    from termsieve.operators import bayes
    from termsieve.plans import experiments as X
    n_folds = corpus.docs.select("fold").distinct().count()
    got = {n: {(r["fold"], r["k"]): (r["hits"], r["n"]) for r in X.k_sweep_hits(corpus, n_folds, 7, shard_docs=n).collect()} for n in (3, 4_096)}
    assert got[3] == got[4_096] and len(got[3]) == n_folds * ((corpus.vocab.n_terms - 1) // 7)
    ranks = filters.rank_terms(filters.chi2_scores(corpus.weights, corpus.docs, n_folds))
    for k in (7, 14, (corpus.vocab.n_terms - 1) // 7 * 7):
        preds = bayes.classify_multinomial_nb(corpus.weights, corpus.docs, corpus.weights, corpus.docs, corpus.vocab, n_folds, ranks.where(F.col("rank") <= k), k)
        for r in preds.groupBy("fold").agg(F.sum((F.col("y") == F.col("p")).cast("int")).alias("h"), F.count("*").alias("n")).collect():
            assert got[3][r["fold"], k] == (r["h"], r["n"])
