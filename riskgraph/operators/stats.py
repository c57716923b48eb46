"""Seed statistics, paired comparisons, training-history folds and small selections over run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.functions.numeric import is_finite
from riskgraph.operators.audit import require_empty
from riskgraph.operators.joins import lookup_join, null_safe_join
from riskgraph.operators.ordering import ordered_position, top_k_per_key


def seed_stats(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sample deviation (NULL for one value), min and max; missing and non-finite values skipped."""
    v = F.when(is_finite(value), F.col(value).cast("double"))
    return values.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )


def mixed_provenance(runs: DataFrame, keys: Sequence[str], digest: str = "dataset_sha256") -> DataFrame:
    """Groups of runs that were not all made on one dataset hash."""
    lo, hi = F.min(F.coalesce(digest, F.lit(""))), F.max(F.coalesce(digest, F.lit("")))
    return runs.groupBy(*keys).agg(lo.alias("lowest_hash"), hi.alias("highest_hash")).filter(
        F.col("lowest_hash") != F.col("highest_hash")
    )


def unpivot_metrics(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form ``metric, value``; nested metrics are named by their dotted path."""
    flat = runs.select(*keys, *[F.col(m).cast("double").alias(m.replace(".", "__")) for m in metrics])
    long = flat.unpivot(list(keys), [m.replace(".", "__") for m in metrics], "metric", "value")
    return long.withColumn("metric", F.replace("metric", F.lit("__"), F.lit(".")))


def aggregate_runs(runs: DataFrame, metrics: Sequence[str], strict: bool = True) -> DataFrame:
    """Seed statistics of each metric per (dataset, mode); refuses groups with mixed dataset hashes."""
    if strict:
        require_empty(mixed_provenance(runs, ["dataset", "mode"]), "mixed dataset hashes")
    return seed_stats(unpivot_metrics(runs, ["dataset", "mode", "seed"], metrics), ["dataset", "mode", "metric"])


def paired_differences(runs: DataFrame, metrics: Sequence[str], reference: str = "full", strict: bool = True) -> DataFrame:
    """Statistics of reference minus comparator per (dataset, comparator, metric), paired by seed."""
    keys = ["dataset", "seed", "metric"]
    long = unpivot_metrics(
        runs.withColumn("_h", F.coalesce("dataset_sha256", F.lit(""))), ["dataset", "mode", "seed", "_h"], metrics
    ).filter(is_finite("value"))
    base = long.filter(F.col("mode") == reference).select(
        *keys, F.col("value").alias("_full"), F.col("_h").alias("_full_hash")
    )
    others = long.filter(F.col("mode") != reference)
    pairs = others.join(base, keys)
    if strict:
        require_empty(pairs.filter(F.col("_h") != F.col("_full_hash")), "paired runs differ in dataset hash")
    return seed_stats(
        pairs.select("dataset", F.col("mode").alias("comparator"), "metric", (F.col("_full") - F.col("value")).alias("value")),
        ["dataset", "comparator", "metric"],
    )


def paired_rows(first: DataFrame, second: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """Rows scored by both methods, with both probabilities."""
    return first.withColumnRenamed(prob, "first_prob").join(
        second.select(*keys, F.col(prob).alias("second_prob")), list(keys)
    )


def _history(epochs: DataFrame, run: Sequence[str], epoch: str, score: str) -> DataFrame:
    # A run has at most a few hundred epochs: its history is one small array.
    return epochs.groupBy(*run).agg(
        F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("int").alias("e"), F.col(score).cast("double").alias("s")))).alias("_h")
    )


def _selection_fold(patience: Column, min_delta: Column) -> Column:
    start = F.struct(
        F.lit(float("-inf")).alias("best"), F.lit(None).cast("int").alias("at"),
        F.lit(0).alias("stale"), F.lit(None).cast("int").alias("stop"),
    )

    def step(acc, row):
        better = acc["stop"].isNull() & (row["s"] > acc["best"] + min_delta)
        stale = F.when(acc["stop"].isNotNull(), acc["stale"]).when(better, 0).otherwise(acc["stale"] + 1)
        return F.struct(
            F.when(better, row["s"]).otherwise(acc["best"]).alias("best"),
            F.when(better, row["e"]).otherwise(acc["at"]).alias("at"),
            stale.alias("stale"),
            F.when(acc["stop"].isNull() & (stale >= patience), row["e"]).otherwise(acc["stop"]).alias("stop"),
        )

    return F.aggregate("_h", start, step)


def select_epoch(
    epochs: DataFrame, run: Sequence[str], epoch: str = "epoch", score: str = "score",
    min_delta: float = 0.0, patience: int = 2**31 - 1,
) -> DataFrame:
    """Best epoch under a minimum improvement, and the first epoch at which training would stop."""
    folded = _history(epochs, run, epoch, score).withColumn(
        "_f", _selection_fold(F.lit(patience), F.lit(float(min_delta)))
    )
    return folded.select(
        *run, F.col("_f.at").alias("best_epoch"), F.col("_f.best").alias("best_score"),
        F.col("_f.stop").alias("stop_epoch"), F.size("_h").alias("epochs_run"),
    )


def flatten_history(epochs: DataFrame, run: Sequence[str], epoch: str = "epoch", score: str = "score", **options) -> DataFrame:
    """One row per run and epoch with a flag on the selected epoch."""
    chosen = select_epoch(epochs, run, epoch, score, **options).select(*run, "best_epoch")
    return epochs.join(chosen, list(run)).withColumn("selected", F.col(epoch) == F.col("best_epoch")).drop("best_epoch")


def choose_candidate(rows: DataFrame, keys: Sequence[str], expected: int, strict: bool = True) -> DataFrame:
    """Best validation score per key, ties to the smaller hidden size, then the smaller learning rate."""
    if strict:
        require_empty(
            rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") != expected),
            f"expected {expected} candidates",
        )
    return top_k_per_key(
        rows, keys, [F.col("score").desc(), F.col("hidden").asc(), F.col("lr").asc()], 1
    ).drop("rank")


def order_breaks(rows: DataFrame, keys: Sequence[str], order: str, contiguous: bool = False) -> DataFrame:
    """Rows whose ``order`` value does not strictly increase (or is not the previous plus one) in sequence ``seq``.

    Each row meets its predecessor through its position, so a key of any size spreads over all tasks.
    """
    placed = ordered_position(rows, ["seq"], keys, "_pos")
    before = placed.select(*keys, (F.col("_pos") + 1).alias("_pos"), F.col(order).alias("_before"))
    wrong = (F.col(order) != F.col("_before") + 1) if contiguous else (F.col(order) <= F.col("_before"))
    return null_safe_join(placed, before, [*keys, "_pos"]).filter(wrong).select(*rows.columns)


def boundary_rows(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """First and last row of each table with the value found there."""
    return rows.groupBy(*keys).agg(
        F.min(order).alias("first_row"), F.min_by(value, order).alias("first_value"),
        F.max(order).alias("last_row"), F.max_by(value, order).alias("last_value"),
    )


def sequence_gaps(rows: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Whether ids are exactly 0..n-1: extremes, count and number of repeated ids."""
    per_id = rows.groupBy(*group, key).agg(F.count("*").alias("_c"))
    return per_id.groupBy(*group).agg(
        F.sum("_c").alias("n_rows"), F.count(key).alias("n_ids"), F.min(key).alias("lowest"), F.max(key).alias("highest"),
    ).withColumn(
        "continuous",
        (F.col("lowest") == 0) & (F.col("highest") == F.col("n_rows") - 1) & (F.col("n_ids") == F.col("n_rows")),
    )


def first_eligible_snapshot(snapshots: DataFrame, sources: DataFrame, positives: DataFrame) -> DataFrame:
    """Earliest snapshot having both a source and a positive edge, with its smallest source."""
    usable = lookup_join(snapshots, positives.select("snapshot").distinct(), ["snapshot"], "left_semi")
    return lookup_join(sources, usable.select("snapshot").distinct(), ["snapshot"], "left_semi").agg(
        F.min(F.struct("snapshot", "node_id")).alias("_m")
    ).filter(F.col("_m").isNotNull()).select("_m.*")
