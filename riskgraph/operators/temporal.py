"""Query calendars, chronological splits and leakage-safe joins of dated signals to query snapshots.

Calendars hold one row per query day and are small by construction (days in the covered period);
signals and nodes are not. A calendar therefore travels as one array in a scalar subquery, and every
signal row finds its snapshots by itself: no interval join, no fan-out in front of a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskgraph.operators.joins import lookup_join
from riskgraph.operators.ordering import dense_index, top_k_per_key


def _positive(**values) -> None:
    bad = [k for k, v in values.items() if v <= 0]
    if bad:
        raise ValueError(f"must be positive: {', '.join(bad)}")


def step_calendar(spark: SparkSession, first_day: int, end_day: int, horizon: int, step: int) -> DataFrame:
    """Snapshots every ``step`` days from ``first_day`` while ``query_day + horizon <= end_day``."""
    _positive(horizon=horizon, step=step)
    return (
        spark.range(0, max(0, (end_day - horizon - first_day) // step + 1))
        .select(
            F.col("id").cast("int").alias("snapshot"),
            (F.lit(first_day) + F.col("id") * step).cast("int").alias("query_day"),
        )
        .withColumn("target_day", F.col("query_day") + F.lit(horizon))
    )


def step_calendar_over(df: DataFrame, day: str, horizon: int, step: int) -> DataFrame:
    """The same calendar over the day range present in ``df`` (one map-side-combined min / max)."""
    _positive(horizon=horizon, step=step)
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    last = F.col("hi") - F.lit(horizon)
    return (
        bounds.filter(last >= F.col("lo"))
        .select(F.posexplode(F.sequence(F.col("lo"), last, F.lit(step))).alias("snapshot", "query_day"))
        .withColumn("target_day", F.col("query_day") + F.lit(horizon))
    )


def monthly_calendar_over(df: DataFrame, date: str, horizon: int) -> DataFrame:
    """Snapshots on the first of every month from the first to the last month of ``date``."""
    _positive(horizon=horizon)
    months = F.sequence(
        F.trunc(F.min(F.to_date(date)), "month"),
        F.trunc(F.max(F.to_date(date)), "month"),
        F.expr("interval 1 month"),
    )
    return (
        df.agg(months.alias("m"))
        .select(F.posexplode("m").alias("snapshot", "d"))
        .select("snapshot", F.unix_date("d").alias("query_day"))
        .withColumn("target_day", F.col("query_day") + F.lit(horizon))
    )


def _purged(calendar: DataFrame, split: Column, train_end: Column, validation_end: Column) -> DataFrame:
    touches = ((F.col("split") == 0) & (F.col("target_day") >= train_end)) | (
        (F.col("split") == 1) & (F.col("target_day") >= validation_end)
    )
    return calendar.withColumn("split", split).withColumn(
        "split", F.when(touches, F.lit(-1)).otherwise(F.col("split"))
    )


def split_by_boundaries(calendar: DataFrame, train_end: int | Column, validation_end: int | Column) -> DataFrame:
    """Add ``split`` 0 / 1 / 2 by two boundary days; -1 where the target reaches the next boundary."""
    first = train_end if isinstance(train_end, Column) else F.lit(train_end)
    second = validation_end if isinstance(validation_end, Column) else F.lit(validation_end)
    split = F.when(F.col("query_day") < first, 0).when(F.col("query_day") < second, 1).otherwise(2)
    return _purged(calendar, split, first, second)


def split_by_fraction(calendar: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """The same with boundaries at the given fractions of the ordered snapshots."""
    days = F.array_sort(F.collect_list("query_day"))
    edge = lambda share: F.get("d", F.floor(F.size("d") * F.lit(share)).cast("int"))
    bounds = calendar.agg(days.alias("d")).select(
        F.struct(edge(train).alias("a"), edge(round(train + validation, 12)).alias("b")).alias("s")
    )
    return split_by_boundaries(
        calendar.withColumn("_s", bounds.scalar()), F.col("_s.a"), F.col("_s.b")
    ).drop("_s")


def _snapshots(calendar: DataFrame) -> Column:
    """All snapshots as one sorted array of ``(query_day, snapshot)``, evaluated once per query."""
    return calendar.agg(F.array_sort(F.collect_list(F.struct("query_day", "snapshot")))).scalar()


def lookback_memory(
    signals: DataFrame,
    calendar: DataFrame,
    k: int = 5,
    lookback: int = 30,
    closed_left: bool = False,
    node: str = "node_id",
    day: str = "event_day",
    signal: str = "signal_id",
) -> DataFrame:
    """The latest ``k`` signals of each node before each query day.

    The window is ``(q - lookback, q)``, or ``[q - lookback, q)`` with ``closed_left``; order is
    (day, signal id) descending and ``slot`` counts from 0. Whatever a window is, its ``k`` latest
    signals are among the ``k`` latest of each day, so signals shrink to ``k`` per node and day
    (map-side first) before rows are placed by node and then fan out to snapshots in place.
    """
    _positive(k=k, lookback=lookback)
    daily = top_k_per_key(
        signals.filter(F.col(day).isNotNull() & F.col(node).isNotNull()),
        [node, day], [F.col(signal).desc()], k, "_r",
    ).drop("_r")
    oldest = F.col("_q.query_day") - F.lit(lookback)
    in_window = (F.col(day) >= oldest) if closed_left else (F.col(day) > oldest)
    reach = F.filter(
        F.col("_calendar"),
        lambda s: (s["query_day"] > F.col(day))
        & ((s["query_day"] <= F.col(day) + lookback) if closed_left else (s["query_day"] < F.col(day) + lookback)),
    )
    placed = (
        daily.repartition(F.col(node))
        .withColumn("_calendar", _snapshots(calendar))
        .withColumn("_q", F.explode(reach))
        .drop("_calendar")
        .filter(in_window)
        .withColumn("snapshot", F.col("_q.snapshot"))
        .withColumn("age_days", F.col("_q.query_day") - F.col(day))
        .drop("_q")
    )
    latest = W.partitionBy(node, "snapshot").orderBy(F.col(day).desc(), F.col(signal).desc())
    return (
        placed.withColumn("slot", F.row_number().over(latest) - 1)
        .filter(F.col("slot") < k)
    )


def _windows(calendar: DataFrame) -> Column:
    """All outcome windows as one array of ``(query_day, snapshot, target_day)`` by query day, which must be distinct."""
    grid = F.array_sort(F.collect_list(F.struct("query_day", "snapshot", "target_day")))
    distinct = F.count("*") == F.count_distinct("query_day")
    return calendar.agg(F.when(distinct, grid).otherwise(F.raise_error(F.lit("query days must be known and distinct")))).scalar()


def horizon_intervals(
    flagged: DataFrame, calendar: DataFrame, node: str = "node_id", day: str = "event_day",
) -> DataFrame:
    """Maximal runs of snapshots at which a node is positive: ``(node, first_query_day, last_query_day, n_snapshots)``.

    A snapshot is positive where a flagged signal lies in ``[query_day, target_day)``; a run has no snapshot of the calendar
    between its ends at which the node is negative. Everything outside the runs is negative and takes no row, so the table
    grows with the outcomes and not with nodes times snapshots. Days shrink to a set per node map-side (at most the days of
    the period); runs are cut in the row. Signals without node or day are ignored.
    """
    days = (
        flagged.filter(F.col(node).isNotNull() & F.col(day).isNotNull())
        .groupBy(node).agg(F.collect_set(day).alias("_days")).withColumn("_grid", _windows(calendar))
    )
    positive = F.transform(
        "_grid", lambda s: F.exists("_days", lambda d: (d >= s["query_day"]) & (d < s["target_day"]))
    )
    marked = days.withColumn("_on", positive)
    at = lambda i: F.coalesce(F.get("_on", i), F.lit(False))
    edges = F.transform("_grid", lambda s, i: F.struct(
        s["query_day"].alias("q"), i.alias("i"), (at(i) & ~at(i - 1)).alias("first"), (at(i) & ~at(i + 1)).alias("last")
    ))
    return (
        marked.withColumn("_ends", edges)
        .select(node, F.inline(F.arrays_zip(
            F.filter("_ends", lambda e: e["first"]).alias("a"), F.filter("_ends", lambda e: e["last"]).alias("b")
        )))
        .select(
            node, F.col("a.q").alias("first_query_day"), F.col("b.q").alias("last_query_day"),
            (F.col("b.i") - F.col("a.i") + 1).alias("n_snapshots"),
        )
    )


def interval_positives(intervals: DataFrame, calendar: DataFrame, node: str = "node_id") -> DataFrame:
    """The positive cells ``(snapshot, node)`` of :func:`horizon_intervals`, one row each; nothing is shuffled."""
    inside = F.filter(
        "_grid", lambda s: (s["query_day"] >= F.col("first_query_day")) & (s["query_day"] <= F.col("last_query_day"))
    )
    return (
        intervals.withColumn("_grid", _windows(calendar))
        .select(node, F.explode(inside).alias("_q"))
        .select(F.col("_q.snapshot").alias("snapshot"), node)
    )


def interval_labels(
    nodes: DataFrame, intervals: DataFrame, calendar: DataFrame, node: str = "node_id",
) -> DataFrame:
    """The dense grid ``(snapshot, node, label)`` of all nodes and snapshots, for those who ask for every cell.

    A node's runs, at most half as many as there are snapshots, meet the node once; cells are produced in place.
    """
    runs = intervals.groupBy(node).agg(F.collect_list(F.struct("first_query_day", "last_query_day")).alias("_runs"))
    return (
        nodes.select(node).distinct()
        .join(runs, node, "left")
        .withColumn("_grid", _windows(calendar))
        .withColumn("_q", F.explode("_grid"))
        .select(
            F.col("_q.snapshot").alias("snapshot"),
            node,
            F.coalesce(
                F.exists("_runs", lambda r: F.col("_q.query_day").between(r["first_query_day"], r["last_query_day"])), F.lit(False)
            ).cast("int").alias("label"),
        )
    )


def interval_label_counts(intervals: DataFrame, calendar: DataFrame, n_nodes: Column | int) -> DataFrame:
    """``(snapshot, positive, negative)`` of the whole grid: starts and ends of runs summed over the calendar's days.

    Only the sums per day, at most two rows for each snapshot, meet in one place.
    """
    total = n_nodes if isinstance(n_nodes, Column) else F.lit(n_nodes)
    starts = intervals.groupBy(F.col("first_query_day").alias("query_day")).agg(F.count("*").alias("n"))
    ends = intervals.groupBy(F.col("last_query_day").alias("query_day")).agg(F.count("*").alias("m"))
    by_day = W.orderBy("query_day")
    opened = F.sum(F.coalesce("n", F.lit(0))).over(by_day)
    closed = F.coalesce(F.sum(F.coalesce("m", F.lit(0))).over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        calendar.select("snapshot", "query_day").join(starts, "query_day", "left").join(ends, "query_day", "left")
        .select("snapshot", (opened - closed).alias("positive"))
        .withColumn("negative", total - F.col("positive"))
    )


def horizon_labels(
    nodes: DataFrame,
    flagged: DataFrame,
    calendar: DataFrame,
    node: str = "node_id",
    day: str = "event_day",
) -> DataFrame:
    """``label`` 1 where a flagged signal lies in ``[query_day, target_day)``, else 0, per node and snapshot."""
    return interval_labels(nodes, horizon_intervals(flagged, calendar, node, day), calendar, node)


def label_evidence(
    spans: DataFrame,
    calendar: DataFrame,
    node: str = "node_id",
    day: str = "event_day",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Phrase occurrences supporting each positive label, one row per snapshot, node and document span.

    ``spans`` carries ``doc_id, context_id, phrase, span_start, span_end, char_start``. Several
    contexts may quote the same document span; the one with the smallest context id is kept.
    """
    located = spans.withColumn("document_start", F.col("char_start") + F.col("span_start")).withColumn(
        "document_end", F.col("char_start") + F.col("span_end")
    )
    per_span = located.groupBy(node, day, "doc_id", "document_start", "phrase").agg(
        F.min_by(
            F.struct("context_id", "document_end", *keep), F.col("context_id")
        ).alias("_c")
    )
    grid = calendar.agg(
        F.array_sort(F.collect_list(F.struct("snapshot", "query_day", "target_day")))
    ).scalar()
    hits = (
        per_span.withColumn("_grid", grid)
        .withColumn(
            "_q",
            F.explode(
                F.filter(
                    "_grid",
                    lambda s: (s["query_day"] <= F.col(day)) & (F.col(day) < s["target_day"]),
                )
            ),
        )
        .drop("_grid")
    )
    key = ["snapshot", node, "doc_id", "document_start", "phrase"]
    return (
        hits.withColumn("snapshot", F.col("_q.snapshot"))
        .groupBy(*key)
        .agg(F.min_by(F.struct(F.col("_c.*"), F.col(day).alias("evidence_day")), F.struct(day, "_c.context_id")).alias("_b"))
        .select(*key, "_b.*")
    )


def agreeing_links(
    links: DataFrame, contexts: DataFrame, entity: str = "entity_id", context: str = "context_id",
    date: str = "context_date",
) -> DataFrame:
    """Entity-context links whose two recorded dates agree, once per (entity, context)."""
    left = links.select(entity, context, F.col(date).alias("_link_date"))
    joined = lookup_join(left, contexts, [context])
    return (
        joined.filter(F.col("_link_date") == F.col(date)).drop("_link_date").dropDuplicates([entity, context])
    )


def link_agreement_counts(
    links: DataFrame, contexts: DataFrame, entity: str = "entity_id", context: str = "context_id",
    date: str = "context_date",
) -> DataFrame:
    """How many links name a known context, and how many of those disagree on (or lack) a date."""
    left = links.select(entity, context, F.col(date).alias("_link_date"))
    joined = lookup_join(left, contexts.select(context, F.col(date).alias("_date")), [context])
    same = F.coalesce(F.col("_link_date") == F.col("_date"), F.lit(False))
    return joined.agg(
        F.count("*").alias("known_links"),
        F.count_if(~same).alias("rejected_date_links"),
    )


def frozen_edges(edges: DataFrame, cutoff_day: int | Column, first_seen: str = "first_day") -> DataFrame:
    """Edges first observed strictly before the cutoff; an unknown first day is excluded."""
    return edges.filter(F.col(first_seen) < (cutoff_day if isinstance(cutoff_day, Column) else F.lit(cutoff_day)))


def eligible_nodes(edges: DataFrame, linked: DataFrame, node: str = "node_id") -> DataFrame:
    """Nodes that are an endpoint of the graph and have a link before the first query."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return ends.join(linked.select(node).distinct(), node, "left_semi")


def induced_edges(edges: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Edges with both endpoints in ``nodes``."""
    keep = nodes.select(node)
    kept = lookup_join(edges, keep.withColumnRenamed(node, "src"), ["src"], "left_semi")
    return lookup_join(kept, keep.withColumnRenamed(node, "dst"), ["dst"], "left_semi")


def encode_edges(edges: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Add dense ``src_idx`` and ``dst_idx`` (ids numbered in sorted order)."""
    index = dense_index(nodes, node)
    for end in ("src", "dst"):
        codes = index.select(F.col(node).alias(end), F.col("node_idx").alias(f"{end}_idx"))
        edges = lookup_join(edges, codes, [end])
    return edges


def signal_dictionary(memory: DataFrame, keys: Sequence[str] = ("node_id", "signal_id")) -> DataFrame:
    """Distinct retrieved (node, signal) pairs with a dense id in key order."""
    from riskgraph.operators.ordering import ordered_position

    return ordered_position(memory.select(*keys).distinct(), list(keys), name="signal_idx")


def select_sources(
    signals: DataFrame, limit: int = 6, score: str = "strength", node: str = "node_id",
) -> DataFrame:
    """At most ``limit`` distinct nodes per snapshot by their strongest signal, ties to the larger id."""
    best = signals.groupBy("snapshot", node).agg(F.max(score).alias(score))
    return top_k_per_key(best, ["snapshot"], [F.col(score).desc(), F.col(node).desc()], limit)


def spread_sample(df: DataFrame, order: Sequence[str], size: int, group: Sequence[str] = ()) -> DataFrame:
    """``size`` rows evenly spaced over the order: positions ``floor(i * (n - 1) / (size - 1))``."""
    from riskgraph.operators.joins import attach_group_stats
    from riskgraph.operators.ordering import ordered_position

    _positive(size=size)
    placed = ordered_position(df, order, group, "_pos")
    if group:
        placed = attach_group_stats(placed, group, {"_n": F.count("*")})
    else:
        placed = placed.withColumn("_n", df.agg(F.count("*")).scalar())
    # Wanted places are floor(i * step), the last one n - 1. As step is 1 at least, only numbers beside p / step can give place p.
    m, p = F.least(F.lit(size), F.col("_n")), F.col("_pos")
    step = (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))
    near = F.floor(F.try_divide(p.cast("double"), step)).cast("bigint")
    hit = F.lit(False)
    for k in (-1, 0, 1, 2):
        i = near + k
        hit = hit | ((i >= 0) & (i < m - 1) & (F.floor(i * step) == p))
    wanted = F.when(m == 1, p == 0).otherwise((p == F.col("_n") - 1) | hit)
    return placed.filter(F.coalesce(wanted, F.lit(False))).drop("_pos", "_n")


def first_and_spread(df: DataFrame, marked: Column, order: Sequence[str], size: int, group: Sequence[str] = ()) -> DataFrame:
    """The first ``size`` marked rows in the order and ``size`` rows evenly spread over the others, with ``marked``.

    A null mark is no mark. Per ``group`` if one is given; fewer rows than ``size`` are all taken.
    """
    from riskgraph.operators.ordering import top_k_per_key

    told = df.withColumn("marked", F.coalesce(marked, F.lit(False)))
    keys = list(group) or [F.lit(0).alias("_all")]
    hits = told.filter("marked").select("*", *([] if group else keys))
    first = top_k_per_key(hits, list(group) or ["_all"], [F.col(c) for c in order], size, "_rank").drop("_rank", "_all")
    return first.unionByName(spread_sample(told.filter("not marked"), order, size, group))


def numbered_ids(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` smallest ids of the form letter + digits, ordered by their number."""
    return df.select(key).distinct().orderBy(F.expr(f"substring(`{key}`, 2)").cast("decimal(38,0)")).limit(limit)
