"""File manifests: sizes and hashes of delivered files against a recorded list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskgraph.sources.splits import PACKED, streamed_hashes


def file_hashes(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Relative path, bytes and sha256 of every file below ``root``, of any size.

    Files are read line by line with a running digest. Compressed files, which the line reader would unpack, are read whole
    and may have 2 GiB at most; a larger one is an error.
    """
    options = {"recursiveFileLookup": True} | ({"pathGlobFilter": glob} if glob else {})
    base = root.rstrip("/").removeprefix("file:") + "/"
    relative = F.element_at(F.split("file", base, 2), -1).alias("path")
    every = spark.read.format("binaryFile").options(**options).load(root)
    packed = every.withColumn("file", F.col("_metadata.file_path")).filter(F.col("file").rlike(PACKED)).select("file", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    read = streamed_hashes(spark, root, **options).unionByName(packed).select(relative, "bytes", "sha256")
    # No reader gives rows of empty files, so they are those of the listing that nothing was read from.
    listed = spark.createDataFrame([(f,) for f in every.inputFiles()], "file string").select(relative)
    empty = listed.join(read, "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return read.unionByName(empty)


def compare_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Problems of a delivery: ``missing``, ``unlisted``, ``changed``, ``listed_twice``, ``path_escape``."""
    escape = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    twice = manifest.groupBy("path").agg(F.count("*").alias("_n"), F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    listed = twice.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"), F.col("_n"))
    joined = listed.join(actual, "path", "full_outer")
    status = (
        F.when(F.col("_n").isNull(), "unlisted")
        .when(escape, "path_escape")
        .when(F.col("_n") > 1, "listed_twice")
        .when(F.col("bytes").isNull(), "missing")
        .when((F.col("_b") != F.col("bytes")) | (F.col("_s") != F.col("sha256")), "changed")
    )
    return joined.select("path", status.alias("problem")).filter(F.col("problem").isNotNull())


def read_run_records(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Completed and failed runs of a result tree (``result.json`` below ``root``)."""
    runs = (
        spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "result.json").json(root)
        .withColumn("run", F.col("_metadata.file_path"))
    )
    done = (F.col("status") == "completed") & F.col("test").isNotNull()
    return (
        runs.filter(F.coalesce(done, F.lit(False))),
        runs.filter(~F.coalesce(done, F.lit(False))).select("run", "status"),
    )
