"""Texts to a sparse term relation: (doc_id, term, ...), counts, vocabulary, TF-IDF.

One row is one document, so its terms are cut and counted inside the row; texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions import porter_stem, regex_clean, remove_stopwords, tokenize_words
from ..functions.fixed import SPACE, STOPWORDS, WORD
from ..runtime import BROADCAST_ROWS, materialize, ranked

# Terms holding more than 1 / HOT_SHARE of all entries (with more shuffle partitions, more than one of those holds on
# average) are frequent: at most that many whatever the corpus size.
HOT_SHARE = 1_000
# Stands between the terms of a row on its way to a bucket.
SEPARATOR = "\x01"


def char_tokens(n: int = 3) -> Column:
    """Character n-grams of the lower-cased text with merged whitespace runs."""
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[{SPACE}]{{2,}}", " ")
    # Zero-width matches at every code point; the second half of a surrogate pair is none.
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1))


def word_tokens() -> Column:
    """Words of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def linguistic_words(stopwords: list[str] = STOPWORDS) -> Column:
    """Cleaned and stopped words, still to be stemmed."""
    return remove_stopwords(tokenize_words(regex_clean(F.col("text"))), stopwords)


def exploded(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row per token; other columns of a document are carried along."""
    return docs.withColumn("term", F.explode(tokens)).drop("text")


def char_ngrams(docs: DataFrame, n: int = 3) -> DataFrame:
    return exploded(docs, char_tokens(n))


def word_terms(docs: DataFrame) -> DataFrame:
    return exploded(docs, word_tokens())


def linguistic_terms(docs: DataFrame, stopwords: list[str] = STOPWORDS, stems: DataFrame | None = None) -> DataFrame:
    """One row per cleaned, stopped and stemmed word."""
    return keep_words(conflate_tokens(exploded(docs, linguistic_words(stopwords)), stems))


def keep_words(terms: DataFrame, min_length: int = 2) -> DataFrame:
    return terms.where(F.col("term").rlike("^[a-zA-Z]") & (F.length("term") >= min_length))


def conflate_tokens(terms: DataFrame, stems: DataFrame | None = None,
                    limit: int = BROADCAST_ROWS) -> DataFrame:
    """Replace each term by its stem; terms without an entry in `stems` stay as they are.

    Without a dictionary the stemmer runs once per distinct term when those are few
    enough to broadcast, and otherwise on every row, which shuffles nothing.
    """
    if stems is None:
        # Few distinct terms would be merged into one task; stemming is the costly part.
        parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        words = materialize(terms.select("term").distinct().repartition(parts)
                            .withColumn("stem", porter_stem(F.col("term"))))
        if words.count() > limit:
            return terms.withColumn("term", porter_stem(F.col("term")))
        joined = terms.join(F.broadcast(words), "term", "left")
    else:
        words = materialize(stems.select("term", "stem"))
        joined = join_stored(terms, words, words.count(), how="left", limit=limit)
    return joined.withColumn("term", F.coalesce("stem", "term")).drop("stem")


def term_rows(docs: DataFrame, tokens: Column) -> DataFrame:
    """`docs` with `terms`, an array of (term, tf), in place of the text."""
    rows = docs.withColumn("_s", F.sort_array(tokens)).drop("text")
    rows = rows.withColumn("_at", F.filter(F.transform("_s", lambda t, i: F.when(
        (i == 0) | (t != F.get("_s", i - 1)), i)), lambda i: i.isNotNull()))
    runs = F.transform("_at", lambda p, k: F.struct(
        F.get("_s", p).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - p).cast("long").alias("tf")))
    return rows.withColumn("terms", runs).drop("_s", "_at")


def pack_terms(rows: DataFrame) -> DataFrame:
    """`terms` as one string of terms and one of counts, a third of the array's size; a row whose terms hold the
    separator keeps the array."""
    words = F.transform("terms", lambda t: t["term"])
    plain = F.coalesce((F.size("terms") > 0) & ~F.contains(F.array_join(words, ""), F.lit(SEPARATOR)), F.lit(False))
    counts = F.array_join(F.transform("terms", lambda t: t["tf"].cast("string")), " ")
    return rows.withColumn("_plain", plain).withColumns({
        "_words": F.when(F.col("_plain"), F.array_join(words, SEPARATOR)), "_tfs": F.when(F.col("_plain"), counts),
        "terms": F.when(~F.col("_plain"), F.col("terms"))}).drop("_plain")


def unpack_terms(rows: DataFrame) -> DataFrame:
    """Inverse of `pack_terms`."""
    pairs = F.zip_with(F.split("_words", SEPARATOR), F.split("_tfs", " "), lambda t, n: F.struct(t.alias("term"), n.cast("long").alias("tf")))
    return rows.withColumn("terms", F.coalesce("terms", pairs)).drop("_words", "_tfs")


def explode_terms(rows: DataFrame) -> DataFrame:
    """One row per document and term. (A plain explode infers a filter that would count every array twice.)"""
    keys = [c for c in rows.columns if c != "terms"]
    return rows.select(*keys, F.explode_outer("terms").alias("_t")).where("_t IS NOT NULL").select(*keys, "_t.term", "_t.tf")


def term_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """`tf` per document and term, counted inside the document's row."""
    return explode_terms(term_rows(docs, tokens))


def conflate_counts(counts: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Counts of stems from counts of words."""
    keys = [c for c in counts.columns if c not in ("term", "tf")]
    return keep_words(conflate_tokens(counts, stems)).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def binary_terms(docs: DataFrame, tokens: Column) -> DataFrame:
    """Presence (tf = 1) per document and term."""
    return exploded(docs, F.array_distinct(tokens)).withColumn("tf", F.lit(1).cast("long"))


def document_frequency(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, df); `counts` has one row per document and term."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def min_df_vocabulary(counts: DataFrame, min_df: int) -> DataFrame:
    """(term, df, idx): terms in at least `min_df` documents, indexed in sorted order."""
    return fit_vocabulary(counts, 0, min_df).indexed()


@dataclass
class Vocabulary:
    """A stored vocabulary with the sizes that later joins decide on."""
    terms: DataFrame      # (term, df)
    n_docs: int
    n_terms: int
    n_entries: int        # document-term pairs covered
    _least: dict = field(default_factory=dict, repr=False, compare=False)

    def indexed(self) -> DataFrame:
        """(term, df, idx) with idx = 0.. in sorted term order."""
        placed = ranked(self.terms, [], [F.col("term")], name="_rank", n_rows=self.n_terms)
        return placed.select("term", "df", (F.col("_rank") - 1).alias("idx"))

    def restrict(self, selected: DataFrame) -> "Vocabulary":
        """The vocabulary of selected terms."""
        return sized_vocabulary(self.terms.join(selected.select("term").distinct(), "term", "left_semi"), self.n_docs)

    def hot_share(self) -> int:
        return max(HOT_SHARE, int(self.terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def hot(self) -> DataFrame:
        """(term, salts) of terms that hold a large share of all entries: at most `hot_share` rows, and at most
        twice as many salts, each of which stands for no more entries than that share."""
        parts = F.col("df") * self.hot_share()
        return self.terms.where(parts > self.n_entries).select("term", F.ceil(parts / self.n_entries).cast("int").alias("salts"))

    def frequent(self, most: int) -> DataFrame:
        """The most frequent terms, at most so many; terms of one frequency are all among them or none."""
        if most not in self._least:
            # As many rows as there are different frequencies, at most the root of twice the entries.
            sizes = self.terms.groupBy("df").agg(F.count("*").alias("_n"))
            down = sizes.select("df", F.sum("_n").over(Window.orderBy(F.desc("df"))).alias("_n"))
            self._least[most] = down.where(F.col("_n") <= most).agg(F.min("df")).first()[0]
        return self.terms.where(F.col("df") >= F.lit(self._least[most])).select("term")


def sized_vocabulary(terms: DataFrame, n_docs: int) -> Vocabulary:
    """Store (term, df) rows and take their sizes."""
    stored = materialize(terms)
    n_terms, n_entries = stored.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    return Vocabulary(stored, n_docs, n_terms, n_entries)


def fit_vocabulary(counts: DataFrame, n_docs: int, min_df: int) -> Vocabulary:
    return sized_vocabulary(document_frequency(counts, min_df), n_docs)


def salted_entries(entries: DataFrame, vocab: Vocabulary, on: list[str]) -> DataFrame:
    """Entries of frequent terms with a `_salt` that depends on what else the row holds, so a retried task repeats it."""
    rest = [c for c in entries.columns if c not in on] or on
    return entries.join(F.broadcast(vocab.hot()), "term").withColumn("_salt", F.pmod(F.xxhash64(*rest), F.col("salts"))).drop("salts")


def join_on_term(entries: DataFrame, side: DataFrame, vocab: Vocabulary, on: list[str] | str = "term",
                 rows_per_term: int | None = 1, how: str = "inner", limit: int = BROADCAST_ROWS,
                 back: str | None = None) -> DataFrame:
    """Join document entries with a relation that has few rows per term (None: unknown).

    A side of at most `limit` rows is broadcast. Otherwise the rows of the most frequent terms, as many as the limit
    allows, are broadcast, and only entries of the other, rare terms are joined by shuffle. If the limit does not hold
    the rows of all terms of a large share, those are repeated per salt and joined by shuffle, so a term found in every
    document never forms one large join partition. `back` names the column by which entries joined by shuffle are
    brought together again, to be summed there.
    """
    if rows_per_term is not None and vocab.n_terms * rows_per_term <= limit:
        return entries.join(F.broadcast(side), on, how)
    keys = [on] if isinstance(on, str) else on
    broadcasts = rows_per_term is not None and vocab.hot_share() * rows_per_term <= limit
    if broadcasts:
        hot = F.broadcast(vocab.frequent(limit // rows_per_term))
        kept = entries.join(hot, "term", "left_semi") if how == "left" else entries
        frequent = kept.join(F.broadcast(side.join(hot, "term", "left_semi")), on, how)
    else:
        hot = F.broadcast(vocab.hot())
        repeated = side.join(hot, "term").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")
        frequent = salted_entries(entries, vocab, keys).join(repeated, [*keys, "_salt"], how).drop("_salt")
    rare = entries.join(hot, "term", "left_anti").join(side.join(hot, "term", "left_anti"), on, how)
    if back is None:
        return frequent.unionByName(rare)
    n = _buckets(entries)
    if not broadcasts:
        return frequent.unionByName(rare).repartition(n, back)
    # Under a name of its own the column is known to deal both parts alike, so that entries read from buckets stay there.
    home = f"{back}_home"
    frequent, rare = (df.withColumnRenamed(back, home) for df in (frequent, rare))
    return frequent.unionByName(rare.repartition(n, home)).repartition(n, home).withColumnRenamed(home, back)


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_stored(entries: DataFrame, side: DataFrame, n_rows: int, on: list[str] | str = "term", how: str = "inner",
                limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join entries with a stored relation of `n_rows` rows. One too large to broadcast is joined by the frequencies
    of the entries' own terms, known to it or not."""
    if n_rows <= limit:
        return entries.join(F.broadcast(side), on, how)
    return join_on_term(entries, side, sized_vocabulary(document_frequency(entries), 0), on, None, how, limit)


def transform_with_vocabulary(counts: DataFrame, vocab: Vocabulary, weighting: str = "tfidf") -> DataFrame:
    """Weights `w` of the known terms of each document; unknown terms are dropped.

    tfidf: tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to length one.
    """
    if weighting == "tf":
        return join_on_term(counts, vocab.terms.select("term"), vocab).withColumn("w", F.col("tf").cast("double"))
    if weighting == "binary":
        return join_on_term(counts, vocab.terms.select("term"), vocab).withColumn("w", F.lit(1.0))
    idf = F.log((1.0 + F.lit(vocab.n_docs)) / (1.0 + F.col("df"))) + 1.0
    side = vocab.terms.select("term", idf.alias("_idf"))
    back = "doc_id" if "doc_id" in counts.columns else None
    raw = join_on_term(counts, side, vocab, back=back).withColumn("_raw", F.col("tf") * F.col("_idf"))
    row = [c for c in ("doc_id", "label", "split", "fold") if c in counts.columns]
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*row)))
    return raw.withColumn("w", F.col("_raw") / norm).drop("_raw", "_idf")


def tfidf_l2(counts: DataFrame, n_docs: int, min_df: int) -> DataFrame:
    """Fit vocabulary and weights on all documents."""
    return transform_with_vocabulary(counts, fit_vocabulary(counts, n_docs, min_df))


def to_vectors(weights: DataFrame, docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One sparse vector `features` per document, a zero vector where no term is known.

    The vector column is assembled by built-in functions in its storage layout and read
    back under the vector type.
    """
    indexed = join_on_term(weights.select("doc_id", "term", "w"), vocab.indexed().select("term", "idx"), vocab)
    pairs = indexed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("_p"))
    rows = docs.join(pairs, "doc_id", "left")
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(vocab.n_terms).alias("size"),
        F.coalesce(F.col("_p.idx"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("_p.w"), F.array().cast("array<double>")).alias("values"))
    stored = rows.withColumn("features", vector).drop("_p")
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType)
                           for f in stored.schema])
    return materialize(stored, schema)
