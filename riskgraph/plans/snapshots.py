"""From linked, dated contexts and a relation table to the tables of a leakage-safe snapshot dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, functions as F

from riskgraph.functions.keys import clean
from riskgraph.functions.dates import epoch_day, parse_iso_prefix
from riskgraph.functions.numeric import one_hot
from riskgraph.functions.text import RISK_PHRASES, phrase_spans, signed_hash_dense
from riskgraph.operators import temporal as T
from riskgraph.operators.audit import interval_audit, memory_audit, require_empty, snapshot_audit
from riskgraph.operators.joins import lookup_join
from riskgraph.operators.ordering import dense_index
from riskgraph.runtime import durable

# Order of the relation and entity type codes.
RELATION_TYPES = ["Supplies", "Cooperates", "InvestsIn", "Holding", "Acquires", "Competes", "JointVenture"]
ENTITY_TYPES = ["Company", "Product", "Material", "Industry", "Region"]


@dataclass
class SnapshotTables:
    """Long tables of one dataset; padding and unknown cells have no row.

    ``label_intervals`` holds the positive runs of each node; ``node_labels`` is their expansion to every node and snapshot,
    computed only where it is read.
    """

    nodes: DataFrame
    edges: DataFrame
    snapshots: DataFrame
    signals: DataFrame
    memory: DataFrame
    label_intervals: DataFrame
    node_labels: DataFrame
    label_evidence: DataFrame
    signal_vectors: DataFrame

    def write(self, folder: str, dense_labels: bool = False) -> None:
        """Publish the tables below ``folder``, ``node_labels`` only on request; an existing table is refused."""
        for field in fields(self):
            if field.name == "node_labels" and not dense_labels:
                continue
            getattr(self, field.name).write.mode("errorifexists").parquet(f"{folder}/{field.name}")


def build(
    entities: DataFrame,
    relations: DataFrame,
    contexts: DataFrame,
    links: DataFrame,
    first_query: int,
    train_end: int,
    validation_end: int,
    source_end: int,
    retrieval_size: int = 5,
    lookback: int = 30,
    horizon: int = 30,
    step: int = 10,
    phrases: Sequence[str] = RISK_PHRASES,
    confidence: float = 0.8,
) -> SnapshotTables:
    """Build the dataset.

    ``entities(entity_id, name, entity_type)``, ``relations(edge_id, src, dst, rel, first_event_date)``,
    ``contexts(context_id, doc_id, context_date, text, char_start)``,
    ``links(entity_id, context_id, context_date)``; dates are ISO text, days are epoch days. Only
    facts known before the first query select nodes and edges; text dates select memory and labels.
    """
    spark = entities.sparkSession
    dated = relations.withColumn("first_day", F.unix_date(parse_iso_prefix("first_event_date")))
    frozen = durable(T.frozen_edges(dated, first_query), "frozen")
    ends = frozen.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    known = lookup_join(links, ends, ["entity_id"], "left_semi").withColumn("context_date", parse_iso_prefix("context_date"))
    texts = contexts.withColumn("context_date", parse_iso_prefix("context_date"))
    linked = durable(
        T.agreeing_links(known, texts).withColumn("event_day", epoch_day("context_date")).withColumnRenamed("entity_id", "node_id"),
        "linked",
    )
    eligible = T.eligible_nodes(frozen, linked.filter(F.col("event_day") < first_query))
    index = durable(dense_index(eligible, "node_id"), "nodes")
    type_code = F.array_position(F.array(*[F.lit(t) for t in ENTITY_TYPES]), F.col("entity_type")) - 1
    nodes = lookup_join(
        index, entities.select(F.col("entity_id").alias("node_id"), "name", "entity_type"), ["node_id"]
    ).withColumn("features", one_hot(type_code.cast("int"), 8))
    edges = T.induced_edges(frozen, index).withColumn("dependency", F.lit(1.0))
    usable = lookup_join(
        linked.filter((F.col("event_day") <= source_end) & (clean("text") != "")), index.select("node_id"), ["node_id"], "left_semi"
    )
    signals = durable(
        usable.withColumn("signal_id", F.col("context_id")).withColumn("confidence", F.lit(confidence)), "signals"
    )
    calendar = durable(
        T.split_by_boundaries(T.step_calendar(spark, first_query, source_end, horizon, step), train_end, validation_end), "calendar"
    )
    memory = durable(
        T.lookback_memory(
            signals.select("node_id", "event_day", "signal_id", "confidence"), calendar, retrieval_size, lookback
        ), "memory",
    )
    spans = durable(
        phrase_spans(signals.select("node_id", "event_day", "doc_id", "context_id", "char_start", "text"), "text", phrases).drop("text"),
        "spans",
    )
    kept = calendar.filter("split >= 0")  # a purged snapshot has no label and no evidence
    intervals = durable(T.horizon_intervals(spans, kept), "label_intervals")
    labels = T.interval_labels(index, intervals, kept)
    retrieved = lookup_join(
        signals.select("signal_id", "text").dropDuplicates(["signal_id"]), memory.select("signal_id").distinct(), ["signal_id"], "left_semi"
    )
    return SnapshotTables(
        nodes, edges, calendar, signals, memory, intervals, labels, T.label_evidence(spans, kept),
        signed_hash_dense(retrieved, "signal_id", "text"),
    )


def self_audit(tables: SnapshotTables, lookback: int = 30, all_splits: bool = True) -> None:
    """Fail when a table breaks a leakage or linking rule, or a positive label has no evidence.

    ``all_splits`` asks for a snapshot in each of the three splits.
    """
    rules = snapshot_audit(tables.snapshots, tables.node_labels, tables.memory)
    if not all_splits:
        rules = rules.filter("code != 'split_coverage'")
    require_empty(rules.filter("n > 0"), "dataset rule")
    source = tables.signals.select("signal_id", "node_id", "event_day", "confidence")
    joined = tables.memory.join(source, ["signal_id", "node_id"], "left_anti")
    require_empty(joined, "memory refers to another node's signal")
    kept = tables.snapshots.filter("split >= 0")
    require_empty(interval_audit(tables.label_intervals, kept), "label intervals")
    proven = tables.label_evidence.select("snapshot", "node_id").distinct()
    positive = T.interval_positives(tables.label_intervals, kept)
    require_empty(positive.join(proven, ["snapshot", "node_id"], "left_anti"), "positive label without evidence")
    require_empty(tables.memory.filter((F.col("age_days") <= 0) | (F.col("age_days") >= lookback)), "memory age")


def label_summary(tables: SnapshotTables) -> DataFrame:
    """Snapshots, positives, negatives and unknown cells per split, from the intervals."""
    n = tables.nodes.agg(F.count("*")).scalar()
    counts = T.interval_label_counts(tables.label_intervals, tables.snapshots.filter("split >= 0"), n)
    return (
        tables.snapshots.join(counts, "snapshot", "left").groupBy("split").agg(
            F.count("*").alias("snapshots"), F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"),
            F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        )
        .withColumn("unknown", F.col("snapshots") * n - F.col("positive") - F.col("negative"))
    )


__all__ = ["SnapshotTables", "build", "self_audit", "label_summary", "memory_audit"]
