"""Recall rows to canonical events, products, manufacturers and a fact graph with evidence.

Supporting record ids are kept as long tables, one row per support; ``chunked_lists`` nests them for
export without ever holding an unbounded group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgraph.functions.keys import clean, json_list_text, surrogate
from riskgraph.operators.joins import lookup_join

# Fields whose differing values inside one campaign are reported.
VARIANT_FIELDS = [
    "RCDATE", "RCLTYPECD", "MFGNAME", "MFGTXT", "COMPNAME", "DESC_DEFECT", "CONEQUENCE_DEFECT", "CORRECTIVE_ACTION",
]

# Prefixes of the recall identifiers, and below the node types and relations of the fact graph.
EVENT_PREFIX = "nhtsa_recall"
PRODUCT_PREFIX = "nhtsa_product"
REPORTER_PREFIX = "nhtsa_recall_mfr"
LISTED_PREFIX = "nhtsa_listed_manufacturer"
COMPONENT_PREFIX = "nhtsa_component_descriptor"


def canonical_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields of the first row of each key in ``order``, with the number of rows of the key."""
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*fields), F.struct(*order)).alias("_f"), F.count("*").alias("n_rows")
    ).select(*keys, "_f.*", "n_rows")


def field_variants(rows: DataFrame, keys: Sequence[str], fields: Sequence[str] = VARIANT_FIELDS) -> DataFrame:
    """Distinct values of each field inside a key, only where there is more than one.

    A row is moved once, whole, to the place of its key; its fields fan out there, where their distinct values, the counts of
    these and the join of both need no further move.
    """
    texts = [F.col(f).cast("string").alias(f) for f in fields]
    placed = rows.select(*keys, *texts).repartition(*keys)
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
    long = placed.select(*keys, F.inline(F.array(*map(pair, fields)))).filter(F.col("value").isNotNull()).distinct()
    counted = long.withColumn("n_values", F.count("*").over(W.partitionBy(*keys, "field")))
    return counted.filter(F.col("n_values") > 1).filter(" and ".join(f"`{k}` is not null" for k in keys))


def distinct_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values of each key with the order of their first row."""
    return rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first_seen"))


def first_evidence(rows: DataFrame, keys: Sequence[str], order: Sequence[str], evidence: Sequence[str]) -> DataFrame:
    """Evidence columns of the first row per key."""
    return canonical_rows(rows, keys, order, evidence).drop("n_rows")


def rollup_support(rows: DataFrame, keys: Sequence[str], order: Sequence[str], evidence: Sequence[str],
                   member: str) -> DataFrame:
    """Per key: number of rows, number of distinct members and the first evidence.

    Distinct members are counted through a two-step aggregate, never as a set.
    """
    carried = [e for e in evidence if e not in order]
    counted = rows.groupBy(*keys, member).agg(
        F.count("*").alias("_c"), F.min(F.struct(*order, *carried)).alias("_e")
    )
    return counted.groupBy(*keys).agg(
        F.sum("_c").alias("n_records"), F.count(member).alias("n_members"), F.min("_e").alias("_e")
    ).select(*keys, "n_records", "n_members", *[F.col(f"_e.{e}").alias(e) for e in evidence])


def product_id(code: str | Column = "RCLTYPECD") -> Column:
    """Surrogate key of (recall type, make, model, model year) as literally recorded."""
    code = F.col(code) if isinstance(code, str) else code
    return surrogate(PRODUCT_PREFIX, json_list_text([clean(code), "MAKETXT", "MODELTXT", "YEARTXT"]))


def fact_parts(rows: DataFrame, order: Sequence[str] = ("line_number",), evidence: Sequence[str] = ()) -> DataFrame:
    """Recall rows with the ids of their five nodes."""
    return rows.select(
        "record_id", "campaign_id", "report_received_date", *order, *[e for e in evidence if e not in order],
        F.concat(F.lit(EVENT_PREFIX + ":"), "campaign_id").alias("event"),
        surrogate(REPORTER_PREFIX, "MFGNAME").alias("reporter"),
        surrogate(LISTED_PREFIX, "MFGTXT").alias("listed"),
        product_id().alias("product"),
        surrogate(COMPONENT_PREFIX, "COMPNAME").alias("component_id"),
        "MFGNAME", "MFGTXT", "COMPNAME",
        F.concat_ws("/", "MAKETXT", "MODELTXT", "YEARTXT").alias("product_name"),
    )


def fact_nodes(parts: DataFrame, order: Sequence[str] = ("line_number",), evidence: Sequence[str] = ()) -> DataFrame:
    """Distinct nodes of five kinds with the name and evidence of their first row."""
    node = lambda i, kind, name: F.struct(
        F.col(i).alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("name")
    )
    exploded = parts.select(
        *order, *[e for e in evidence if e not in order],
        F.inline(F.array(
            node("reporter", "recall_reporting_manufacturer", "MFGNAME"),
            node("listed", "listed_recalled_product_manufacturer", "MFGTXT"),
            node("event", "official_recall_campaign", "campaign_id"),
            node("product", "recalled_make_model_year_product", "product_name"),
            node("component_id", "official_component_descriptor", "COMPNAME"),
        )),
    )
    return canonical_rows(exploded, ["node_id"], order, ["node_type", "name", *evidence])


def fact_edge_support(parts: DataFrame, order: Sequence[str] = ("line_number",)) -> DataFrame:
    """One row per edge and supporting record: ``source, relation, target, campaign_id, record_id``."""
    edge = lambda s, r, t: F.struct(
        F.col(s).alias("source"), F.lit(r).alias("relation"), F.col(t).alias("target")
    )
    return parts.select(
        "campaign_id", "record_id", *order,
        F.inline(F.array(
            edge("reporter", "filed_official_recall", "event"),
            edge("event", "recalls_listed_product", "product"),
            edge("event", "identifies_component_descriptor", "component_id"),
            edge("listed", "listed_manufacturer_for_recalled_product", "product"),
        )),
    )


def fact_edges(support: DataFrame, order: Sequence[str] = ("line_number",)) -> DataFrame:
    """Distinct edges with counts of supporting records and campaigns and the locator of the first record.

    ``order`` must tell the records apart; its columns come back as that locator. A supporting record is moved once, to the
    place of its edge, where campaigns and records are counted.
    """
    keys = ["source", "relation", "target"]
    placed = support.select(*keys, "campaign_id", *order).repartition(*keys)
    return rollup_support(placed, keys, order, list(order), "campaign_id")


def reverify_edges(support: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose recorded support no longer yields them, and derivable edges that are not recorded."""
    from riskgraph.operators.audit import reconcile

    keys = ["source", "relation", "target"]
    again = support.groupBy(*keys).agg(F.count("*").alias("n_records"))
    return reconcile(again, edges, keys, ["n_records"])


def category_counts(rows: DataFrame, keys: Sequence[str], totals: bool = False) -> DataFrame:
    """Rows per category combination; with ``totals`` also the roll-up levels."""
    grouped = rows.rollup(*keys) if totals else rows.groupBy(*keys)
    return grouped.agg(F.count("*").alias("n"))


def distinct_per_year(rows: DataFrame, date: str, member: str) -> DataFrame:
    """Exact number of distinct members per year."""
    return (
        rows.select(F.year(date).alias("year"), member).distinct().groupBy("year").agg(F.count(member).alias("n"))
    )


def missing_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Number of blank or NULL values per field in one pass."""
    aggs = [F.count_if(F.coalesce(clean(F.col(f).cast("string")), F.lit("")) == "").alias(f) for f in fields]
    return rows.agg(*aggs).unpivot([], list(fields), "field", "n_missing")
