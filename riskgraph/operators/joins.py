"""Joins that hold up when one key carries a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskgraph import runtime


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many ``rows`` to a ``lookup`` with a bounded number of rows per key.

    No side is forced: runtime statistics decide on a broadcast, and adaptive execution splits the partitions of hot
    keys. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``; null keys meet nothing.
    """
    return rows.join(lookup, list(on), how)


def null_safe_join(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a null key equals a null key; the keys of ``other`` are dropped."""
    named = other.withColumnsRenamed({k: f"_k_{k}" for k in on})
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_k_{k}"]) for k in on])
    return rows.join(named, match, how).drop(*[f"_k_{k}" for k in on])


def join_stats(
    rows: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    size: str,
    *,
    broadcast_bytes: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join rows back to aggregates of their own groups; ``size`` is the group's row count in ``stats``.

    A null key is a group like any other. Adaptive execution cannot split this join, because the aggregate is already
    partitioned by the key. Unless ``stats`` is small, the statistics of groups with more than ``hot_rows`` rows, at most
    ``count(rows) / hot_rows`` of them, are broadcast; the rows of those groups are joined map-side and never move, whatever
    their columns are. All other rows are shuffled by the key.
    """
    on = list(on)
    broadcast_bytes = runtime.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    limit = runtime.HOT_ROWS if hot_rows is None else hot_rows
    if runtime.planned_bytes(stats) <= broadcast_bytes:
        return null_safe_join(rows, F.broadcast(stats.drop(size)), on)
    hot = stats.filter(F.col(size) > limit).drop(size)
    cold = stats.filter(F.col(size) <= limit).drop(size)
    near = null_safe_join(rows, F.broadcast(hot), on)
    far = null_safe_join(null_safe_join(rows, F.broadcast(hot.select(*on)), on, "left_anti"), cold, on)
    return near.unionByName(far)


def attach_group_stats(
    rows: DataFrame,
    on: Sequence[str],
    stats: dict,
    **join_options,
) -> DataFrame:
    """Add per-group aggregates to every row of the group.

    Equivalent to an unordered window, but the group is never collected in one task: the aggregate is
    combined map-side and joined back with :func:`join_stats`.
    """
    grouped = rows.groupBy(*on).agg(*[c.alias(name) for name, c in stats.items()], F.count("*").alias("_size"))
    return join_stats(rows, grouped, on, "_size", **join_options)
