"""A labelled corpus turned into stored term weights, ready for selection and classification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.vectorize import (Vocabulary, char_tokens, conflate_counts, explode_terms, fit_vocabulary,
                                   linguistic_words, pack_terms, term_rows, transform_with_vocabulary, unpack_terms,
                                   word_tokens)
from ..runtime import materialize

ANALYZERS = {
    "word": word_tokens,
    "linguistic": linguistic_words,
    "char2": lambda: char_tokens(2),
    "char3": lambda: char_tokens(3),
}


@dataclass
class Corpus:
    docs: DataFrame       # (doc_id, label[, split][, fold]), one row per document
    weights: DataFrame    # docs columns + (term, tf, w)
    vocab: Vocabulary

    def part(self, split: str) -> tuple[DataFrame, DataFrame]:
        """(weights, docs) of one split."""
        return self.weights.where(F.col("split") == split), self.docs.where(F.col("split") == split)


@dataclass
class Counted:
    """Stored term counts and the vocabulary fitted on them: the same for every weighting."""
    docs: DataFrame
    counts: DataFrame     # docs columns + (term, tf)
    vocab: Vocabulary


def count_corpus(docs: DataFrame, analyzer: str = "word", min_df: int = 3, fit_on: str = "all") -> Counted:
    """Count terms once and fit the vocabulary on all or on `train` documents.

    Every document is tokenized once. Its counts are stored in buckets by document, so that whatever is grouped
    by document later needs no shuffle.
    """
    keys = materialize(docs.drop("text"), key="doc_id")
    counts = explode_terms(materialize(pack_terms(term_rows(docs, ANALYZERS[analyzer]())), key="doc_id", then=unpack_terms))
    if analyzer == "linguistic":
        # Stems are counted once, for fitting and for every weighting.
        counts = materialize(conflate_counts(counts), key="doc_id")
    fit_docs, fit_counts = keys, counts
    if fit_on == "train":
        fit_docs, fit_counts = keys.where(F.col("split") == "train"), counts.where(F.col("split") == "train")
    return Counted(keys, counts, fit_vocabulary(fit_counts, fit_docs.count(), min_df))


def weigh_corpus(counted: Counted, weighting: str = "tfidf") -> Corpus:
    counts = counted.counts
    if weighting == "binary":
        counts = counts.withColumn("tf", F.lit(1).cast("long"))
    # Buckets by document: later joins and scores per document need no shuffle.
    weights = materialize(transform_with_vocabulary(counts, counted.vocab, weighting), key="doc_id")
    return Corpus(counted.docs, weights, counted.vocab)


def build_corpus(docs: DataFrame, analyzer: str = "word", weighting: str = "tfidf", min_df: int = 3,
                 fit_on: str = "all") -> Corpus:
    """Count terms once, fit the vocabulary on all or on `train` documents, weight every document."""
    return weigh_corpus(count_corpus(docs, analyzer, min_df, fit_on), weighting)


def build_corpora(docs: DataFrame, schemes: dict, min_df: int = 3, fit_on: str = "all") -> Iterator[tuple[str, Corpus]]:
    """Each scheme's corpus; texts are tokenized and counted once per analyzer."""
    counted: dict[str, Counted] = {}
    for name, (analyzer, weighting) in schemes.items():
        if analyzer not in counted:
            counted[analyzer] = count_corpus(docs, analyzer, min_df, fit_on)
        yield name, weigh_corpus(counted[analyzer], weighting)
