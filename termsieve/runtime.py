"""Session-level helpers: scratch tables, size-checked broadcasts, hash random numbers, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

# A side is broadcast only after its rows were counted and found at or below this bound.
BROADCAST_ROWS = 1_000_000
# One row per class, fold, run or candidate: at most this many go through the driver.
SMALL_ROWS = 20_000
# Ranks over at most this many rows use one plain window; larger inputs use a range shuffle.
WINDOW_ROWS = 2_000_000
# Stored steps are mostly terms and weights, which this makes smaller than the default does.
COMPRESSION = "zstd"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termsieve-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, schema: T.StructType | None = None, key: str | None = None,
                then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back.

    The result has no lineage to recompute, survives lost executors, keeps column
    pruning and filter pushdown, and gives the optimizer real sizes.
    `schema` reads the files under another schema with the same physical layout.
    `key` buckets the table, so that later joins and groupings on it need no shuffle.
    `then` rewrites rows after they were dealt to their buckets: they travel in a smaller form.
    """
    spark = df.sparkSession
    name = f"termsieve_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    if key is None:
        df.write.option("compression", COMPRESSION).parquet(path)
        return spark.read.schema(schema or df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key)
    # A task has the rows of one bucket, which need no sorting then.
    writers = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, "2")
    try:
        (then(dealt) if then else dealt).write.bucketBy(buckets, key).option("compression", COMPRESSION).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(WRITERS, writers)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored step that a later one took the place of."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a class-, fold- or candidate-sized relation if it has at most `limit` rows.

    The rows are computed once for the check and reused. A larger relation is returned
    as it is and joined by shuffle.
    """
    spark = df.sparkSession
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(spark.createDataFrame(rows, df.schema).coalesce(1))


def broadcast_if(df: DataFrame, n_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a relation whose row count is already known."""
    return F.broadcast(df) if n_rows <= limit else df


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Store a term-sized relation, count it, and broadcast it only within `limit` rows."""
    stored = materialize(df)
    return broadcast_if(stored, stored.count(), limit)


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def uniform(*parts) -> Column:
    """Deterministic uniform number in [0, 1) keyed by `parts`."""
    digest = F.md5(F.concat_ws("-", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """Deterministic standard normal number keyed by `parts` (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, "n1")))
    return radius * F.cos(2.0 * F.pi() * uniform(*parts, "n2"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank",
           n_rows: int | None = None, window_rows: int | None = None) -> DataFrame:
    """1-based position of each row inside its `by` group under `order`.

    `order` must be total; `df` should be cheap to read, as it is counted first unless
    `n_rows` is given. Small inputs use a window. Beyond `window_rows` rows the input is
    range-partitioned on (by, order), numbered inside each sorted partition and shifted by
    the rows of the same group in earlier partitions, so that neither one huge group nor
    an ungrouped ranking ever lands in a single task.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    if (df.count() if n_rows is None else n_rows) <= limit:
        w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        return df.withColumn(name, F.row_number().over(w))
    keys = [F.col(c) for c in by] + list(order)
    parts = max(df.sparkSession.sparkContext.defaultParallelism * 4,
                int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Inside a sorted partition the generated id grows by one per row.
    placed = materialize(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)))
    blocks = placed.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_part", *by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One block per partition and group found in it.
    joined = placed.join(broadcast_checked(offsets), ["_part", *by])
    return joined.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")) \
        .drop("_at", "_part", "_first", "_before")


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: str, name: str,
                n_rows: int | None = None, window_rows: int | None = None) -> DataFrame:
    """Sum of `value` up to each row of its `by` group under `order`; rows equal under `order` get the same sum.

    Small inputs use a window. Beyond `window_rows` rows the input is range-partitioned on (by, order), which keeps
    equal rows together, summed inside each partition and shifted by the group's sums of earlier partitions.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    if (df.count() if n_rows is None else n_rows) <= limit:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.sum(value).over(w))
    keys = [F.col(c) for c in by] + list(order)
    parts = max(df.sparkSession.sparkContext.defaultParallelism * 4,
                int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part", *by).agg(F.sum(value).alias("_s")).select(
        "_part", *by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part", *by).orderBy(*order)
    summed = placed.withColumn(name, F.sum(value).over(w)).join(broadcast_checked(offsets), ["_part", *by])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
