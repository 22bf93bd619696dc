"""Quality rules: counts of the text and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into a fixed number of buckets. One multinomial is counted over trusted
documents, one over all documents; a document's score is the mean logarithm of their ratio over its n-grams.
Everything is decided row by row with one fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
SMOOTHING = 1.0
# Documents below this mean log ratio are unlike the trusted ones; set from labelled rows of both classes.
THRESHOLD = -0.1
# The trusted multinomial is fitted on at most so many labelled documents, the first by hash of their id.
TRUSTED_ROWS = 50_000
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"


def with_counts(docs: DataFrame) -> DataFrame:
    """`doc` (the row as it is), `hashes` (of its words) and the counts of the rules.

    A word is a run of other characters than space and U+0009 to U+000D; a null text has none.
    """
    text = F.coalesce(F.col("doc")["text"], F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    rows = docs.select(F.struct("*").alias("doc"))
    split = rows.select("doc", words.alias("words"),
                        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    counted = split.select(
        "doc", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
        lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)])))
    return _repeated_words(counted.withColumn("windows", windows))


def _repeated_words(rows: DataFrame) -> DataFrame:
    """`n_repeat_words`: words inside windows that occur twice or more, each word once. Drops `windows`."""
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("pairs", F.when(some, F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # Equal windows are neighbours now; each repeated one tells where it starts.
    twice = F.filter(F.transform("pairs", lambda s, k: F.when(
        F.coalesce(s["h"] == F.get("pairs", k - 1)["h"], F.lit(False))
        | F.coalesce(s["h"] == F.get("pairs", k + 1)["h"], F.lit(False)), s["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", F.array_sort(twice)).drop("windows", "pairs")
    fresh = F.transform("starts", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))).cast("long"))
    total = F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("starts")


def features(n_buckets: int = BUCKETS) -> Column:
    """Buckets of all words and of all pairs of neighbouring words of `hashes`."""
    pairs = F.when(F.size("hashes") > 1, F.transform(
        F.sequence(F.lit(0), F.size("hashes") - 2), lambda i: F.xxhash64(F.col("hashes")[i], F.col("hashes")[i + 1])))
    bucket = lambda h: F.pmod(h, F.lit(n_buckets)).cast("int")
    return F.concat(F.transform("hashes", bucket), F.transform(F.coalesce(pairs, F.array().cast("array<bigint>")), bucket))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """At most `limit` ids of documents labelled good and not toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, limit: int = TRUSTED_ROWS) -> Column:
    """Array over buckets of log p(bucket | trusted) / p(bucket | all), as a scalar; null without any n-gram
    of a trusted document. Counts cover all documents and whole texts."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    good = trusted_ids(labels, limit).select(F.col("doc_id").alias("good_id"))
    hashed = docs.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    flagged = hashed.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    grams = flagged.select(F.col("good_id").isNotNull().alias("good"), F.explode(features(n_buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n_all"), F.count(F.when(F.col("good"), 1)).alias("n_good"))
    every = docs.sparkSession.range(0, n_buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").fillna(0)
    table = filled.agg(F.sum("n_all").alias("all"), F.sum("n_good").alias("good"),
                       F.array_sort(F.collect_list(F.struct("bucket", "n_all", "n_good"))).alias("cells"))
    ratio = lambda c: (F.log((c["n_good"] + SMOOTHING) / (F.col("good") + SMOOTHING * n_buckets))
                       - F.log((c["n_all"] + SMOOTHING) / (F.col("all") + SMOOTHING * n_buckets)))
    return table.select(F.when(F.col("good") > 0, F.transform("cells", ratio)).alias("ratios")).scalar()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int = BUCKETS,
          limit: int = TRUSTED_ROWS) -> DataFrame:
    """`doc` (each row of `docs` as a struct), the counts, `score`, `base_failed` and `kept`.

    Fewer than 10 words, or more than 20 % of the words in repeated windows, fail the base rules. Where nothing
    is trusted, or a text has no word, the score is null and the base rules decide alone. Repeated rows are
    judged alike. Labels of unknown documents, null labels and null ids are ignored.
    """
    ratios = log_ratios(docs, labels, n_buckets, limit)
    rows = with_counts(docs).withColumn("features", features(n_buckets)).drop("hashes")
    scored = rows.withColumn("ratios", ratios).withColumn(
        "score", F.aggregate("features", F.lit(0.0), lambda s, b: s + F.col("ratios")[b]) / F.nullif(F.size("features"), F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.drop("features", "ratios").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns.

    A filter is not moved below a column that depends on the row's place; without one, each step of the verdict
    would be written into the filter again and again.
    """
    kept = judge(docs, labels, **options).withColumn("_place", F.monotonically_increasing_id()).where("kept AND _place >= 0")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op2_quality(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = judge(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return found.select(F.col("doc")["doc_id"].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


QUERIES = {"op2_quality": op2_quality}
