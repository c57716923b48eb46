"""Multi-dataset experiment reports and delivery passports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskgraph.functions.numeric import display_mean_sd
from riskgraph.operators.audit import duplicates, require_empty
from riskgraph.operators.stats import aggregate_runs, paired_differences
from riskgraph.sources.files import compare_manifest, file_hashes, read_run_records
from riskgraph.sources.tables import write_report_csv

RUN_SCHEMA = (
    "status string, dataset string, mode string, seed bigint, config struct<dataset_sha256:string>, runtime_seconds double, "
    "test struct<node:struct<auc:double,auprc:double,macro_f1:double,positive_f1:double>,"
    "scope:struct<ndcg_at_k:double,jaccard:double>,path:struct<path_precision:double,path_recall:double,path_f1:double>>"
)
METRICS = (
    "node.auc", "node.auprc", "node.macro_f1", "node.positive_f1", "scope.ndcg_at_k", "scope.jaccard",
    "path.path_precision", "path.path_recall", "path.path_f1", "runtime_seconds",
)


def collect_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Completed runs flattened for statistics, and failed ones; a repeated (dataset, mode, seed) is an error."""
    done, failed = read_run_records(spark, root, RUN_SCHEMA)
    runs = done.select(
        "run", "dataset", "mode", "seed", F.col("config.dataset_sha256").alias("dataset_sha256"), "runtime_seconds", "test.*"
    )
    require_empty(duplicates(runs, ["dataset", "mode", "seed"]), "repeated dataset / mode / seed")
    return runs, failed


def report(runs: DataFrame, metrics: Sequence[str] = METRICS, reference: str = "full") -> dict[str, DataFrame]:
    """Tables ``per_seed``, ``summary`` (with display text) and ``paired``."""
    per_seed = runs.select(
        "dataset", "mode", "seed", "dataset_sha256", *[F.col(m).alias(m.replace(".", "_")) for m in metrics]
    )
    summary = aggregate_runs(runs, metrics).withColumn("shown", display_mean_sd("mean", "std"))
    return {"per_seed": per_seed, "summary": summary, "paired": paired_differences(runs, metrics, reference)}


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        write_report_csv(table, f"{folder}/{name}", table.columns)


def passport(
    spark: SparkSession, root: str, manifest: DataFrame, counts: DataFrame, expected: DataFrame,
) -> dict[str, DataFrame]:
    """Delivered files below ``root`` and audited row counts checked against what was recorded; see :func:`passport_of`."""
    return passport_of(file_hashes(spark, root), manifest, counts, expected)


def passport_of(files: DataFrame, manifest: DataFrame, counts: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """Tables ``files``, ``file_problems`` and ``count_problems``.

    ``files(path, bytes, sha256)`` measured, ``manifest`` of the same form recorded, ``counts(kind, n)`` measured,
    ``expected(kind, n)`` recorded.
    """
    e = expected.select("kind", F.col("n").alias("recorded"))
    different = counts.select("kind", F.col("n").alias("measured")).join(e, "kind", "full_outer").filter(
        ~F.col("measured").eqNullSafe(F.col("recorded"))
    )
    return {"files": files, "file_problems": compare_manifest(manifest, files), "count_problems": different}
