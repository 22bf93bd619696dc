"""Reading labelled text and writing result tables and text reports."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names of files listed, and files and bytes read, per batch of rows.
NAMES, FILES, BYTES = 10_000, 1_000, 16 << 20


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the file system of the machines, if it lies there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of each folder."""
    for batch in batches:
        for folder in batch["path"].to_pylist():
            names = []
            with os.scandir(folder) as found:
                for entry in found:
                    if _seen(entry.name) and entry.is_file():
                        names.append(entry.path)
                    if len(names) == NAMES:
                        yield pa.RecordBatch.from_pydict({"path": names})
                        names = []
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, folder, value) of each file."""
    rows, held = [], 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            if path.endswith((".deflate", ".snappy", ".lz4")):
                raise ValueError(f"this compression is not read: {path}")
            with pa.input_stream(path, compression="detect") as file:
                value = file.read()
            if not value and not os.path.getsize(path):
                continue                                    # Spark's reader has no row for it either
            rows.append({"doc_id": "file:" + _quoted(path), "folder": _quoted(path).split("/")[-2], "value": value})
            held += len(value)
            if len(rows) == FILES or held >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, _FILE)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _FILE)


_FILE = pa.schema([("doc_id", pa.string()), ("folder", pa.string()), ("value", pa.binary())])


def _quoted(path: str) -> str:
    """As it stands in a URI."""
    return re.sub(r'[\x00-\x20"%<>?#\[\]\\^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", path)


def scan_text_tree(spark: SparkSession, path: str, labels: dict[str, int | str] | None = None) -> DataFrame:
    """One row per file below `path`; the folder of a file is its class.

    `labels` maps folder names to labels and drops other folders from the scan.
    The file path is the document id. Files of a path that the machines share are listed and read by tasks; Spark's
    reader would list all of them on the driver and deal out few per task. Elsewhere it is used.
    """
    files = _scan_in_tasks(spark, path.rstrip("/"), labels)
    if files is None:
        source = f"{path.rstrip('/')}/*" if labels is None else \
            f"{path.rstrip('/')}/{{{','.join(sorted(labels))}}}"
        raw = spark.read.text(source, wholetext=True)
        files = raw.select(
            F.col("_metadata.file_path").alias("doc_id"),
            F.col("value").alias("text"),
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"))
    if labels is None:
        return files.withColumn("label", F.col("folder"))
    codes = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return files.withColumn("label", codes[F.col("folder")])


def _scan_in_tasks(spark: SparkSession, path: str, labels: dict | None) -> DataFrame | None:
    """(doc_id, text, folder) of folders on a shared path; nothing where Spark's reader has to do it."""
    local = None if re.search(r"[*?\[{\\]", path) else _local(spark, path)
    if local is None or not os.path.isdir(local):
        return None
    with os.scandir(local) as found:
        inside = [e for e in found if labels is None or e.name in labels]
    classes = [e.path for e in inside if e.is_dir()]
    if not classes or any(not e.is_dir() and e.stat().st_size and not e.name.endswith(".crc") for e in inside):
        return None
    parts = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folders = spark.createDataFrame([(p,) for p in classes], "path string").repartition(len(classes))
    paths = folders.mapInArrow(_list_files, "path string").repartition(parts, "path")
    return paths.mapInArrow(_read_files, "doc_id string, folder string, value binary") \
        .select("doc_id", F.col("value").cast("string").alias("text"), "folder")


def sink_text_tree(rows: DataFrame, path: str) -> None:
    """Write `text` and a line break to one file per row, in a folder `label=...` per label, as Spark's text writer does.

    On a path that the machines share the tasks put files in place themselves, under names that a repeated task uses
    again. Elsewhere Spark's writer is used, which takes some 8 ms and a rename by the driver per file.
    """
    spark = rows.sparkSession
    local = _local(spark, path)
    if local is None:
        rows.select("label", "text").write.partitionBy("label").option("maxRecordsPerFile", 1).text(path)
        return
    os.makedirs(local)

    def write(batches):
        made, done, part = {}, 0, TaskContext.get().partitionId()
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
                if label not in made:
                    made[label] = f"{local}/label={_escaped(label)}"
                    os.makedirs(made[label], exist_ok=True)
                name = f"part-{part:05d}-{done:08d}.txt"
                with open(f"{made[label]}/.{name}", "wb") as file:
                    file.write((text or b"") + b"\n")
                os.replace(f"{made[label]}/.{name}", f"{made[label]}/{name}")
                done += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    ready = rows.select(F.col("label").cast("string"), F.col("text").cast("binary")).sortWithinPartitions("label", "text")
    ready.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _escaped(label: str | None) -> str:
    """A label as a folder name, as Spark writes it."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{}\[\]^]""", lambda m: f"%{ord(m[0]):02X}", label) if label else "__HIVE_DEFAULT_PARTITION__"


def scan_csv(spark: SparkSession, path: str, text: str = "text", category: str = "category") -> DataFrame:
    """`text` and `category` of a CSV with a header; quoted texts may span lines."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("enforceSchema", False).csv(path)
            .select(F.col(text).alias("text"), F.col(category).alias("category")))


def scan_labelled_table(spark: SparkSession, path: str, text: str = "text", label: str = "label",
                        doc_id: str | None = "doc_id", fmt: str = "parquet") -> DataFrame:
    """(doc_id, text, label) of a stored table; only these columns are read."""
    table = spark.read.load(path, format=fmt) if fmt != "csv" else \
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    key = F.col(doc_id) if doc_id else F.monotonically_increasing_id()
    return table.select(key.alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal out a table of fewer files than cores, which could be one task; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if len(df.inputFiles()) < cores else df


def scan_by_category(docs: DataFrame, categories: list[str] | None = None,
                     column: str = "categories") -> DataFrame:
    """One row per (document, category): a document recurs under each of its categories."""
    wanted = F.col(column) if categories is None else \
        F.array_intersect(F.col(column), F.array(*[F.lit(c) for c in categories]))
    return docs.withColumn("label", F.explode(wanted)).drop(column)


def scan_subset(docs: DataFrame, subset: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """Documents of one split (`train`, `test` or all), restricted to listed labels."""
    if subset not in (None, "all"):
        docs = docs.where(F.col("split") == subset)
    return docs if categories is None else docs.where(F.col("label").isin(categories))


def with_categories(docs: DataFrame, **conditions: Column) -> DataFrame:
    """Attach `categories`: the label plus the name of each condition that holds."""
    names = [F.col("label")] + [F.when(c, F.lit(n)) for n, c in conditions.items()]
    return docs.withColumn("categories", F.array_compact(F.array(*names)))


def sink_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a result table and return what was written."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
        return df.sparkSession.read.option("header", True).option("multiLine", True) \
            .option("escape", '"').schema(df.schema).csv(path)
    writer.format(fmt).save(path)
    return df.sparkSession.read.load(path, format=fmt)


def sink_report(lines: DataFrame, path: str) -> DataFrame:
    """Write report lines (`line_no`, `line`) in order as text and return them.

    A report has a few lines per fold, class and classifier, so it goes to one file.
    """
    lines.coalesce(1).sortWithinPartitions("line_no").select(F.col("line").alias("value")) \
        .write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path)
