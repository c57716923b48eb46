"""Baseline risk classifier by distributed Newton steps and per-snapshot prediction reports."""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.operators.graph import beam_search
from riskgraph.operators.joins import lookup_join
from riskgraph.operators.memory import mean_pool_all
from riskgraph.operators.metrics import class_weight, tune_threshold
from riskgraph.operators.ordering import top_k_per_key
from riskgraph.runtime import durable

MODES = ("text_mlp", "graph_only", "concat")


@dataclass
class Baseline:
    coefficients: list[float]  # the intercept first
    threshold: float
    pos_weight: float
    scores: DataFrame


def features(grid: DataFrame, slots: DataFrame, static: DataFrame, mode: str, dim: int) -> DataFrame:
    """Add ``x`` to ``grid(snapshot, node_id, ...)``: mean slot vector, static node vector, or both.

    ``slots(snapshot, node_id, vector)``, ``static(node_id, features)``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {MODES}")
    out = grid
    parts = []
    if mode != "graph_only":
        pooled = mean_pool_all(grid, slots, ["snapshot", "node_id"], "vector", dim)
        out = out.join(pooled, ["snapshot", "node_id"])
        parts.append(F.col("pooled"))
    if mode != "text_mlp":
        out = lookup_join(out, static.select("node_id", "features"), ["node_id"])
        parts.append(F.col("features"))
    return out.withColumn("x", F.concat(*parts)).drop("pooled", "features")


def _newton_sums(beta: np.ndarray):
    """One row (entry, value) for each entry of the weighted Gram matrix and of the gradient, summed over the task."""
    d = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), np.stack(batch.column("x").to_numpy(zero_copy_only=False))])
                y, w = (np.asarray(batch.column(c), dtype=float) for c in ("y", "w"))
                p = 1.0 / (1.0 + np.exp(-(x @ beta)))
                total[:, :d] += x.T @ (x * (w * p * (1.0 - p))[:, None])
                total[:, d] += x.T @ (w * (y - p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["entry", "value"])

    return run


def newton_logistic(rows: DataFrame, n_features: int, iterations: int = 5, ridge: float = 1.0) -> list[float]:
    """Coefficients (intercept first) of a ridge logistic regression on ``rows(x array<double>, y, w)``.

    Newton steps from zero: each is one pass that sums a Gram matrix and a gradient per task, ``(n_features + 1) ** 2`` numbers
    whatever the number of rows, and one small linear system on the driver. The intercept isn't penalised.
    """
    beta = np.zeros(n_features + 1)
    penalty = np.diag([1e-9] + [ridge] * n_features)
    for _ in range(iterations):
        sums = rows.select("x", "y", "w").mapInArrow(_newton_sums(beta), "entry int, value double").groupBy("entry").agg(F.sum("value").alias("v"))
        total = np.zeros(len(beta) * (len(beta) + 1))
        for r in sums.collect():
            total[r["entry"]] = r["v"]
        total = total.reshape(len(beta), len(beta) + 1)
        beta = beta + np.linalg.solve(total[:, :-1] + penalty, total[:, -1] - penalty @ beta)
    return beta.tolist()


def logistic(x: str | Column, beta: list[float]) -> Column:
    """Probability of label 1 for an array of features, inside the row."""
    pairs = F.zip_with(x, F.array(*map(F.lit, beta[1:])), lambda a, b: a * b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(pairs, F.lit(float(beta[0])), lambda a, b: a + b)))


def train_baseline(rows: DataFrame, iterations: int = 5, ridge: float = 1.0) -> Baseline:
    """Class-weighted logistic regression on ``rows(snapshot, node_id, split, label, x)``.

    Fitted on the known training labels (split 0); the threshold comes from validation labels (split
    1) only. Every row is scored, also purged and unlabelled ones. Without a training label all scores are 0.5.
    """
    stored = durable(rows.withColumn("x", F.col("x").cast("array<double>")), "features")
    fit = stored.filter((F.col("split") == 0) & F.col("label").isNotNull())
    weight = float(class_weight(fit).first()["pos_weight"])
    weighted = fit.select("x", F.col("label").cast("double").alias("y"), F.when(F.col("label") == 1, F.lit(weight)).otherwise(1.0).alias("w"))
    first = stored.select(F.size("x")).first()
    beta = newton_logistic(weighted, first[0] if first else 0, iterations, ridge)
    scored = durable(stored.select("snapshot", "node_id", "split", "label", logistic("x", beta).alias("prob")), "scored")
    threshold = tune_threshold(scored.filter(F.col("split") == 1)).first()["threshold"]
    return Baseline(beta, float(threshold), weight, scored)


def top_nodes(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` nodes of each snapshot with the highest probability, ties by node id."""
    return top_k_per_key(scores, ["snapshot"], [F.col("prob").desc(), F.col("node_id")], k)


def risk_scope(scores: DataFrame, threshold: float) -> DataFrame:
    """Nodes of each snapshot at or above the retained threshold."""
    return scores.filter(F.col("prob") >= F.lit(float(threshold))).select("snapshot", "node_id", "prob")


def prediction_report(
    scores: DataFrame, edges: DataFrame, sources: DataFrame, threshold: float, top_k: int = 10, beam_width: int = 10,
    max_hops: int = 4, path_top_k: int = 5, written: bool = False,
) -> dict[str, DataFrame]:
    """Long tables ``top_nodes``, ``risk_scope`` and ``paths``, and one ``summary`` row per snapshot.

    The summary nests the bounded lists (top nodes, paths of the bounded sources) and counts the
    risk scope, whose members stay in their own table. Labels are not read. ``written`` is that of the beam search.
    """
    top = top_nodes(scores, top_k)
    scope = risk_scope(scores, threshold)
    paths = durable(beam_search(edges, sources, beam_width, max_hops, path_top_k, written=written), "report_paths")
    nested_top = top.groupBy("snapshot").agg(
        F.array_sort(F.collect_list(F.struct("rank", "node_id", "prob"))).alias("top_nodes")
    )
    nested_paths = paths.groupBy("snapshot").agg(
        F.array_sort(F.collect_list(F.struct("source", "rank", "nodes", "edge_ids", "log_score"))).alias("paths")
    )
    sizes = scope.groupBy("snapshot").agg(F.count("*").alias("n_risk_scope"))
    summary = (
        scores.select("snapshot").distinct()
        .join(nested_top, "snapshot", "left").join(nested_paths, "snapshot", "left").join(sizes, "snapshot", "left")
        .withColumn("n_risk_scope", F.coalesce("n_risk_scope", F.lit(0))).withColumn("threshold", F.lit(float(threshold)))
    )
    return {"top_nodes": top, "risk_scope": scope, "paths": paths, "summary": summary}
