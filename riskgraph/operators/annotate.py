"""Reviewer annotations: strict validation, exact window and edge matching, then publication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskgraph.functions.keys import clean
from riskgraph.functions.dates import parse_day
from riskgraph.operators.audit import AuditError, conflicts, duplicates, require_empty
from riskgraph.operators.joins import lookup_join

COMMON = ["query_day", "target_day", "label", "evidence_url", "evidence_span", "reviewer", "verified"]
NODE_FIELDS = [*COMMON, "entity_id"]
EDGE_FIELDS = [*COMMON, "source_id", "target_id", "relation_type"]


def cell_violations(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows breaking a single-row rule, with the first broken rule as ``problem``."""
    problem = F.when(F.lit(False), "")
    for field in required:
        problem = problem.when(F.coalesce(clean(field), F.lit("")) == "", f"blank_{field}")
    problem = (
        problem.when(~F.col("label").isin("0", "1"), "label_not_0_or_1")
        .when(F.col("verified") != "1", "not_verified")
        .when(parse_day("query_day").isNull(), "bad_query_day")
        .when(parse_day("target_day").isNull(), "bad_target_day")
        .when(parse_day("query_day") >= parse_day("target_day"), "target_not_after_query")
    )
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def typed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.col("label").cast("int")).withColumn("query_day", parse_day("query_day")).withColumn(
        "target_day", parse_day("target_day")
    )


def node_violations(rows: DataFrame, snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed node annotations that name no known node or window, or whose event date contradicts the label."""
    windows = snapshots.select("query_day", "target_day", F.lit(True).alias("_w")).distinct()
    marked = lookup_join(rows, windows, ["query_day", "target_day"], "left")
    marked = lookup_join(marked, nodes.select(F.col("node_id").alias("entity_id"), F.lit(True).alias("_n")).distinct(),
                         ["entity_id"], "left")
    given = F.coalesce(clean("event_date"), F.lit("")) != ""
    day = parse_day("event_date")
    problem = (
        F.when(F.col("_n").isNull(), "unknown_entity")
        .when(F.col("_w").isNull(), "window_mismatch")
        .when((F.col("label") == 1) & ~given, "positive_without_date")
        .when((F.col("label") == 1) & day.isNull(), "bad_event_date")
        .when((F.col("label") == 1) & ~((F.col("query_day") <= day) & (day < F.col("target_day"))), "event_outside_window")
        .when((F.col("label") == 0) & given, "negative_with_date")
    )
    return marked.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_w", "_n")


def match_edges(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge annotations with the one edge they name, and those naming none or several."""
    keys = ["source_id", "target_id", "relation_type"]
    named = edges.groupBy(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("rel").alias("relation_type")).agg(
        F.min("edge_id").alias("edge_id"), F.count("*").alias("_n")
    )
    joined = lookup_join(rows, named, keys, "left")
    ok = F.coalesce(F.col("_n") == 1, F.lit(False))
    return (
        joined.filter(ok).drop("_n"),
        joined.filter(~ok).withColumn("problem", F.when(F.col("_n").isNull(), "no_edge").otherwise("several_edges")),
    )


def window_duplicates(snapshots: DataFrame) -> DataFrame:
    return duplicates(snapshots, ["query_day", "target_day"])


def import_annotations(
    snapshots: DataFrame, nodes: DataFrame, edges: DataFrame | None, node_rows: DataFrame,
    edge_rows: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Validated ``node_labels`` and ``edge_labels``; any violation fails before a table is returned.

    Cells without an annotation have no row: they are unknown, never negative.
    """
    require_empty(window_duplicates(snapshots), "duplicate query windows")
    require_empty(cell_violations(node_rows, NODE_FIELDS).select("entity_id", "query_day", "problem"), "node annotation")
    checked = typed(node_rows)
    require_empty(node_violations(checked, snapshots, nodes).select("entity_id", "query_day", "problem"), "node annotation")
    windows = snapshots.select("snapshot", "query_day", "target_day")
    placed = lookup_join(checked, windows, ["query_day", "target_day"]).withColumn("node_id", F.col("entity_id"))
    require_empty(conflicts(placed, ["snapshot", "node_id"], "label"), "repeated node annotation")
    evidence = ["label", "evidence_url", "evidence_span", "reviewer"]
    out = {"node_labels": placed.select("snapshot", "node_id", parse_day("event_date").alias("event_day"), *evidence)}
    empty = placed.isEmpty()
    if edge_rows is not None:
        if edges is None:
            raise AuditError("edge annotations need the edge table")
        require_empty(cell_violations(edge_rows, EDGE_FIELDS).select("source_id", "target_id", "problem"), "edge annotation")
        matched, wrong = match_edges(typed(edge_rows), edges)
        require_empty(wrong.select("source_id", "target_id", "relation_type", "problem"), "edge annotation")
        require_empty(matched.join(windows, ["query_day", "target_day"], "left_anti").select("edge_id", "query_day"),
                      "edge annotation window mismatch")
        at = lookup_join(matched, windows, ["query_day", "target_day"])
        require_empty(conflicts(at, ["snapshot", "edge_id"], "label"), "repeated edge annotation")
        out["edge_labels"] = at.select("snapshot", "edge_id", *evidence)
        empty = empty and at.isEmpty()
    if empty:
        raise AuditError("no reviewed annotations supplied")
    return out
