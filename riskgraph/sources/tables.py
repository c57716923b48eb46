"""JSONL, CSV and Parquet in and out, with explicit schemas and reject tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from riskgraph.functions.keys import clean
from riskgraph.operators.audit import AuditError, require_empty
from riskgraph.sources.splits import csv_records


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def classify_json_lines(lines: DataFrame, schema: StructType | str, value: str = "value") -> DataFrame:
    """Add ``code`` (NULL when usable) and ``record`` to every text line."""
    parsed = F.try_parse_json(F.col(value))
    code = (
        F.when(clean(value) == "", "jsonl_blank_line")
        .when(parsed.isNull(), "jsonl_parse")
        .when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "jsonl_record")
    )
    coded = lines.withColumn("code", code)
    return coded.withColumn("record", F.when(F.col("code").isNull(), F.from_json(F.col(value), schema)))


def read_jsonl_audited(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Accepted records and rejected lines (blank, unparseable, not an object) with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    coded = classify_json_lines(lines, schema)
    accepted = coded.filter(F.col("code").isNull()).select("record.*")
    return accepted, coded.filter(F.col("code").isNotNull()).select("file", "value", "code")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_report_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """A small report as one CSV file with a fixed column list; other columns are ignored."""
    df.select(*fields).coalesce(1).write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)


def write_rows_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Row-level CSV export in parallel part files."""
    df.select(*fields).write.mode("errorifexists").option("header", True).csv(path)


def publish(df: DataFrame, path: str, checks: dict[str, DataFrame] | None = None) -> None:
    """Write a table only after every check is empty; an existing output is refused."""
    for message, violations in (checks or {}).items():
        require_empty(violations, message)
    df.write.mode("errorifexists").parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet read of just the named columns."""
    return spark.read.parquet(path).select(*columns)


def read_strict_csv(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Annotation CSV as trimmed strings with ``csv_file`` and ``csv_line``: required columns, none twice, no ragged rows.

    Every file has a head, quoted or not, with a byte order mark or not, and all heads are equal. ``csv_line`` numbers the records of
    a file from 1, the head; empty lines don't count. Rows of blank values are dropped. Any breach fails the job.
    """
    records, heads = csv_records(spark, path)
    first = heads.groupBy().agg(F.min("fields").alias("lo"), F.max("fields").alias("hi")).first()
    names = first["lo"]
    if not names or names == [""]:
        raise AuditError(f"{path}: no header")
    if names != first["hi"]:
        raise AuditError(f"{path}: files with different headers")
    if len(set(names)) != len(names):
        raise AuditError(f"{path}: duplicate column names")
    missing = sorted(set(required) - set(names))
    if missing:
        raise AuditError(f"{path}: missing CSV fields {missing}")
    rows = records.filter("record > 0")
    require_empty(rows.filter(F.size("fields") != len(names)).select("file", "record"), f"{path}: malformed CSV row")
    kept = rows.filter(F.array_join("fields", "") != "")
    extra = [F.lit("").alias(n) for n in optional if n not in names]
    return kept.select(*[F.col("fields")[i].alias(n) for i, n in enumerate(names)], *extra, F.col("file").alias("csv_file"), (F.col("record") + 1).alias("csv_line"))


def paged_results(pages: DataFrame, file: str = "file") -> DataFrame:
    """Rows of paged API answers ``(file, Count, Results ARRAY)`` in page order.

    A page whose ``Count`` differs from its number of results fails the job.
    """
    size = F.size("Results")
    checked = F.when(F.col("Count") == size, F.col("Results")).otherwise(
        F.raise_error(F.concat(F.lit("result count mismatch in "), F.col(file)))
    )
    return pages.select(file, F.posexplode(checked).alias("position", "item"))


def first_per_id(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """First row of each id in ``order``, with the number of rows seen for the id."""
    keyed = rows.withColumn("_id", key)
    columns = [c for c in rows.columns]
    return keyed.groupBy("_id").agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_r"), F.count("*").alias("n_seen")
    ).select(F.col("_id").alias("id"), "_r.*", "n_seen")
