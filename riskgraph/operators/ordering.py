"""Positions and running totals over a total order, computed without a single-task window.

Rows are range-partitioned on the full order (ties included, so equal leading keys still spread),
written once, and each partition is offset by the totals of the partitions before it. Only the
per-partition totals, a table of one row per partition, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgraph import runtime
from riskgraph.operators.joins import join_stats, null_safe_join

_INDEX_BITS = 33
_INDEX_MASK = (1 << _INDEX_BITS) - 1


def _as_columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def ordered_position(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    name: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within ``group`` under ``order`` (a total order)."""
    keys = _as_columns(group) + _as_columns(order)
    count = partitions or runtime.shuffle_partitions(df.sparkSession)
    ranged = runtime.durable(
        df.repartitionByRange(count, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_mid", _INDEX_BITS).cast("int")
    offsets = (
        ranged.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
        )
    )
    placed = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit(_INDEX_MASK)))
        .drop("_part", "_before", "_mid")
    )
    if not group:
        return placed
    starts = placed.groupBy(*group).agg(F.min(name).alias("_start"), F.count("*").alias("_size"))
    return (
        join_stats(placed, starts, list(group), "_size")
        .withColumn(name, F.col(name) - F.col("_start"))
        .drop("_start")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str],
    group: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add, for each ``{new: column}`` of ``sums``, the total of ``column`` over the rows before this one."""
    keys = _as_columns(group) + _as_columns(order)
    count = partitions or runtime.shuffle_partitions(df.sparkSession)
    ranged = runtime.durable(
        df.repartitionByRange(count, *keys).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    cell = [*group, "_part"]
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*cell).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(
        *cell, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    within = (
        W.partitionBy(*cell).orderBy(*_as_columns(order)).rowsBetween(W.unboundedPreceding, -1)
    )
    inner = ranged.select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()]
    )
    # A cell is one group inside one range partition: bounded, so a plain join is enough.
    joined = null_safe_join(inner, offsets, cell)
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_o_{n}")).drop(f"_o_{n}")
    return joined.drop("_part")


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """Keep the ``k`` first rows of each key with their 1-based rank.

    Up to Spark's ``windowGroupLimitThreshold`` (1,000) each group is limited map-side before the shuffle, so a hot key moves
    at most ``k`` rows per task; a larger ``k`` moves all its rows.
    """
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= k
    )


def chunked_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    name: str,
    chunk_size: int = 10_000,
) -> DataFrame:
    """Nest ``value`` into arrays ordered by ``order``, at most ``chunk_size`` items per row.

    A group of ordinary size yields one row (``chunk`` 0) holding its whole list; a huge group yields
    as many rows as it needs, so no task ever holds an unbounded list and nothing is dropped.
    """
    placed = ordered_position(df, order, keys, "_pos").withColumn(
        "chunk", F.floor(F.col("_pos") / chunk_size).cast("int")
    )
    return placed.groupBy(*keys, "chunk").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("_v")))), lambda s: s["_v"]
        ).alias(name)
    )


def dense_index(df: DataFrame, key: str, name: str = "node_idx") -> DataFrame:
    """Distinct values of ``key`` numbered 0.. in sorted order."""
    return ordered_position(df.select(key).distinct(), [key], name=name).withColumn(
        name, F.col(name).cast("long")
    )
