"""Mixing sources to target weights by Poisson replication.

Every document gets a repetition count by inverting a Poisson distribution at a uniform number hashed
from its id. The mean is the rate at which its source has to be repeated to reach its target share of a
corpus of the same expected size. Counts are exploded and the copies are put into one global random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize

SEED = 20
# Production targets: the hot source counts twice, every other source once.
TARGET_WEIGHTS = {"src0": 2.0}
DEFAULT_WEIGHT = 1.0
# 15 hexadecimal digits of a digest: all numbers below 2^60.
DIGITS, KEY_SPACE = 15, 1 << 60


def hashed(*parts: Column | str) -> Column:
    """Integer in [0, 2^60) from the parts' text."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float], default: float, source: str = "source") -> DataFrame:
    """(source, rate): mean repetitions of a document, so that expected counts follow `weights`.

    A source that `weights` does not name, and the null source, count with `default`.
    """
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    weight = F.lit(float(default)) if named is None else F.coalesce(named[F.col("source")], F.lit(float(default)))
    sizes = materialize(docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
                        .withColumn("weight", weight.cast("double")))
    totals = sizes.agg(F.struct(F.sum("n").alias("n"), F.sum("weight").alias("weight"))).scalar()
    return sizes.select("source", (totals["n"] * F.col("weight") / totals["weight"] / F.col("n")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to far beyond double precision, summed from logarithms."""
    top = (rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(at, k):
        log_p = at["log_p"] + F.log(rate / k)
        total = at["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"),
                        F.concat(at["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def replicate(docs: DataFrame, weights: dict[str, float], default: float = DEFAULT_WEIGHT, seed: int = SEED,
              doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """`docs`' columns, `copy_no` (from 1) and `shuffle_key`: every document as often as its Poisson count says.

    The partitions of the result, each sorted by key, follow one another in the order of `shuffle_key`, which is
    a hash of the id and the copy: one global random order. Rows with the same id get the same count; a null id
    or source is a value like any other; texts are never looked at. An empty table gives an empty result.
    Columns of `docs` called copy_no or shuffle_key are replaced.
    """
    spark = docs.sparkSession
    rates = materialize(source_rates(docs, weights, default, source).select(
        "source", poisson_cdf(F.col("rate")).alias("cdf")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), F.col(source).cast("string").alias("src"))
    # The rates are a stored table with a row for each source: Spark broadcasts it if its files are small.
    joined = rows.join(rates, rows["src"].eqNullSafe(rates["source"]))
    u = hashed("draw", F.lit(seed), F.col("id")) / F.lit(float(KEY_SPACE))
    copies = F.size(F.filter("cdf", lambda c: c < u))
    exploded = joined.withColumn("copies", copies).where("copies > 0").select(
        "doc", "id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    keyed = exploded.select("doc", "copy_no", hashed("order", F.lit(seed), F.col("id"), F.col("copy_no")).alias("shuffle_key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Keys are uniform, so equal ranges are equally filled and need no sampling pass over the texts.
    place = F.least(F.lit(parts - 1), F.floor(F.col("shuffle_key") / F.lit(KEY_SPACE / parts))).cast("int")
    placed = keyed.withColumn("place", place).repartitionById(parts, "place").sortWithinPartitions("shuffle_key")
    kept = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    return placed.select(*[F.col("doc")[c].alias(c) for c in kept], "copy_no", "shuffle_key")


def op10_mixing(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return replicate(docs, TARGET_WEIGHTS)


QUERIES = {"op10_mixing": op10_mixing}

ORACLES = {"op10_mixing": f"""WITH sizes AS (SELECT source, count(*) AS n,
  CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) * weight / (SELECT sum(weight) FROM sizes) / n AS rate FROM sizes),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, range(0, 400) t(k) WHERE k <= rate + 12 * sqrt(rate) + 40),
counts AS (SELECT d.doc_id, count(*) AS copies FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
  WHERE c < ('0x' || substr(md5('draw-{SEED}-' || d.doc_id), 1, {DIGITS}))::BIGINT / {KEY_SPACE}.0::DOUBLE GROUP BY d.doc_id)
SELECT d.*, copy_no::INTEGER AS copy_no,
  ('0x' || substr(md5('order-{SEED}-' || d.doc_id || '-' || copy_no), 1, {DIGITS}))::BIGINT AS shuffle_key
FROM documents d JOIN counts USING (doc_id), range(1, copies + 1) t(copy_no)"""}
