"""One propagation step of risk over typed edges: shares, overload transport, intensities, neighbour means.

Heads and gates are not trained here: loads, thresholds, buffers and logits arrive as columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskgraph.functions.numeric import clamp, relu, sigmoid
from riskgraph.operators.joins import join_stats, lookup_join

MODES = ("full", "no_overload", "no_resgate")
_BIN = 32.0


def endpoint_columns(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
                     ends: Sequence[str] = ("src", "dst"), node: str = "node_id") -> DataFrame:
    """Gather node columns onto both (or the given) ends of every edge as ``src_<c>`` / ``dst_<c>``."""
    for end in ends:
        side = nodes.select(*keys, F.col(node).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        edges = lookup_join(edges, side, [*keys, end])
    return edges


def group_softmax(edges: DataFrame, group: Sequence[str] = ("src", "rel"), logit: str = "logit",
                  name: str = "share", **join_options) -> DataFrame:
    """Softmax of ``logit`` inside each group.

    The normalizer is a map-side-combined sum: logits are summed relative to the floor of their band
    of width 32, the few bands of a group are then shifted to the highest one. No group is gathered
    and no separate pass for the maximum is needed.
    """
    x = F.col(logit).cast("double")
    band = F.floor(x / _BIN)
    bands = edges.groupBy(*group, band.alias("_b")).agg(
        F.sum(F.exp(x - F.floor(x / _BIN) * _BIN)).alias("_s"), F.count("*").alias("_c")
    )
    tops = bands.groupBy(*group).agg(
        F.max(F.struct("_b", "_s")).alias("_m"), F.collect_list(F.struct("_b", "_s")).alias("_all"),
        F.sum("_c").alias("_size"),
    )
    top = F.col("_m._b")
    norms = tops.select(
        *group,
        (
            top * _BIN
            + F.ln(
                F.aggregate("_all", F.lit(0.0), lambda acc, r: acc + r["_s"] * F.exp((r["_b"] - top) * _BIN))
            )
        ).alias("_lse"),
        "_size",
    )
    return join_stats(edges, norms, list(group), "_size", **join_options).withColumn(
        name, F.exp(x - F.col("_lse"))
    ).drop("_lse")


def transport(
    edges: DataFrame, nodes: DataFrame, mode: str = "full", beta_penalty: float = 1.0, keys: Sequence[str] = (),
) -> DataFrame:
    """Load carried by each edge: source overload x softmax share x (1 - buffer).

    ``edges(keys, edge_id, src, dst, rel, beta, logit)``, ``nodes(keys, node_id, load, theta)``.
    ``no_overload`` diffuses ``sigmoid(load)`` without buffers; ``no_resgate`` drops thresholds and
    buffers.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {MODES}")
    if beta_penalty < 0:
        raise ValueError("beta_penalty must not be negative")
    beta = F.col("beta") if mode == "full" else F.lit(0.0)
    theta = F.lit(0.0) if mode == "no_resgate" else F.col("theta")
    carried = sigmoid("load") if mode == "no_overload" else relu(F.col("load") - theta)
    source = nodes.select(*keys, F.col("node_id").alias("src"), carried.cast("double").alias("_load"))
    prepared = edges.withColumn("_beta", beta.cast("double")).withColumn(
        "_logit", F.col("logit") - F.lit(float(beta_penalty)) * F.col("_beta")
    )
    shared = group_softmax(prepared, [*keys, "src", "rel"], "_logit")
    return (
        lookup_join(shared, source, [*keys, "src"])
        .withColumn("transmitted", F.col("_load") * F.col("share") * (1.0 - F.col("_beta")))
        .drop("_load", "_beta", "_logit")
    )


def incoming_load(nodes: DataFrame, transported: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of transmitted load per target node, 0 where nothing arrives."""
    sums = transported.groupBy(*keys, F.col("dst").alias("node_id")).agg(F.sum("transmitted").alias("incoming"))
    return nodes.select(*keys, "node_id").join(sums, [*keys, "node_id"], "left").withColumn(
        "incoming", F.coalesce("incoming", F.lit(0.0))
    )


def edge_intensity(transported: DataFrame, node_prob: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Intensity ``transmitted x p(target)`` and probability ``1 - exp(-intensity)``."""
    target = node_prob.select(*keys, F.col("node_id").alias("dst"), F.col("prob").alias("_p"))
    return (
        lookup_join(transported, target, [*keys, "dst"])
        .withColumn("intensity", F.col("transmitted") * F.col("_p"))
        .withColumn("edge_prob", -F.expm1(-F.col("intensity")))
        .drop("_p")
    )


def heuristic_intensity(edges: DataFrame, node_prob: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``p(source) x p(target) x dependency`` with the dependency clamped to [0, 1]."""
    # Targets first: edges that lie by target are not moved for them.
    both = endpoint_columns(edges, node_prob, ["prob"], keys, ("dst", "src"))
    return both.withColumn(
        "intensity", F.col("src_prob") * F.col("dst_prob") * clamp("dependency", 0.0, 1.0)
    ).drop("src_prob", "dst_prob")


def neighbour_mean(edges: DataFrame, features: DataFrame, dim: int, vector: str = "features") -> DataFrame:
    """Dependency-weighted mean of in-neighbours per relation, then the mean over active relations.

    Sums are per dimension and combined map-side, so a target with very many in-edges is one row per
    task after the partial aggregate.
    """
    source = features.select(F.col("node_id").alias("src"), F.col(vector).alias("_x"))
    weight = F.greatest("dependency", F.lit(0.0)).cast("double")
    rows = lookup_join(edges.select("src", "dst", "rel", weight.alias("_w")), source, ["src"])
    per_relation = rows.groupBy("dst", "rel").agg(
        F.sum("_w").alias("_d"),
        *[F.sum(F.col("_w") * F.get("_x", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dim)],
    )
    active = F.greatest(F.count_if(F.col("_d") > 0), F.lit(1))
    sums = per_relation.groupBy(F.col("dst").alias("node_id")).agg(
        F.array(*[(F.sum(F.col(f"_s{i}") / F.greatest("_d", F.lit(1e-12))) / active) for i in range(dim)]).alias("message"),
        F.count_if(F.col("_d") > 0).alias("active_relations"),
    )
    return sums
