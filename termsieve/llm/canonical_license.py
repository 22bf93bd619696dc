"""Licence scan by canonical digest lookup.

A text is normalised (case, punctuation, white space, copyright lines, equivalent spellings) and the digest
of the whole of it is hash-joined to the digests of known licence texts, normalised in the same way.
A document is looked up as a whole, and each of its lines as a whole, which finds licence notices.

A copyright line opens with "copyright" and a sign, a year, a placeholder, "by" or a capitalised name, or with the sign and
a year; "All rights reserved" on the next line goes with it. Other lines that happen to begin with "copyright" stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import broadcast_checked
from .license_texts import KNOWN_TEXTS, SPELLINGS

# Known texts come as a parameter; up to so many distinct digests (64 characters each) are broadcast.
BROADCAST_DIGESTS = 100_000
COPYRIGHT_LINE = (r"(^|\n)[^\p{L}\n]*((?i:copyright)[ \t]*(\([cC]\)|©|:|[0-9]|<|\[|(?i:by) )"
                  r"|(\([cC]\)|©)[ \t]*((?i:copyright)|[0-9]|(?i:by) )|Copyright[ \t]+([tT]he[ \t]+)?\p{Lu}\p{Ll})[^\n]*"
                  r"(\n[^\p{L}\n]*(?i:all rights reserved)[^\p{L}\n]*)?")


def _spelled(text: Column) -> Column:
    out = F.lower(text)
    for variant, standard in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(standard))
    return out


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words of letters and digits with one space between."""
    out = _spelled(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " "))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def canonical_lines(text: Column) -> Column:
    """Every line in the same form, copyright lines too; the text is normalised as one and cut then (no spelling holds a line's end)."""
    return F.transform(F.split(F.regexp_replace(_spelled(text), r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda line: F.trim(line))


def _sha(words: Column) -> Column:
    return F.sha2(F.nullif(words, F.lit("")), 256)


def digest(text: Column) -> Column:
    """Null for a text without any letter or digit, which is never looked up."""
    return _sha(canonical(text))


Known = list[tuple[str, str]] | DataFrame


def license_folder(spark: SparkSession, path: str) -> DataFrame:
    """Known texts from files named `<license>.txt`, whole files as texts; such as a copy of a public licence list."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.txt$", "")
    return files.select(name.alias("license"), F.col("value").alias("body"))


def known_digests(spark: SparkSession, texts: Known = KNOWN_TEXTS) -> DataFrame:
    """(known_digest, license): equal digests under several names keep the first name in order.

    The table is stored and counted, and broadcast only within BROADCAST_DIGESTS rows.
    """
    table = texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "license string, body string")
    table = table.select(digest(F.col("body")).alias("known_digest"), "license").where("known_digest IS NOT NULL") \
        .groupBy("known_digest").agg(F.min("license").alias("license"))
    return broadcast_checked(table, BROADCAST_DIGESTS)


def scan_licenses(docs: DataFrame, known: Known = KNOWN_TEXTS) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), n_notices, notices (sorted names of matching lines).

    `known` holds (license, body), as a list or a table. One row for each row of `docs`; rows that repeat an id get the
    notices of all of them. A null or empty text has no digest and no licence, also as a known text. Other columns of
    `docs` are ignored.
    """
    table = known_digests(docs.sparkSession, known)
    rows = docs.select("doc_id", "text")
    whole = rows.select("doc_id", digest(F.col("text")).alias("digest"))
    whole = whole.join(table, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license")
    lines = rows.select("doc_id", F.explode(canonical_lines(F.col("text"))).alias("line")).where("line <> ''") \
        .select("doc_id", _sha(F.col("line")).alias("known_digest"))
    found = lines.join(table, "known_digest").groupBy("doc_id").agg(
        F.count("*").alias("n_notices"), F.array_sort(F.collect_set("license")).alias("notices"))
    keyed = whole.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return keyed.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
                        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op5_licenses(spark, sf: str) -> DataFrame:
    """The scan of all documents; names of notices joined by commas."""
    found = scan_licenses(spark.read.parquet(f"{sf}/documents.parquet"))
    return found.withColumn("notices", F.array_join("notices", ","))


QUERIES = {"op5_licenses": op5_licenses}


def _sql_digest(text: str, line: bool = False) -> str:
    out = f"lower({text})" if line else f"lower(regexp_replace(coalesce({text}, ''), '{COPYRIGHT_LINE}', ' ', 'g'))"
    for variant, standard in SPELLINGS:
        out = f"replace({out}, '{variant}', '{standard}')"
    return f"sha256(nullif(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ''))"


_KNOWN = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN_TEXTS)
ORACLES = {"op5_licenses": f"""WITH known AS (SELECT {_sql_digest('body')} AS digest, min(name) AS license
  FROM (VALUES {_KNOWN}) t(name, body) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, {_sql_digest('line', True)} AS digest FROM lines) l JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {_sql_digest('text')} AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id"""}
