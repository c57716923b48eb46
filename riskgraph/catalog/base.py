"""Registry of queries and the shared mapping of the driver tables onto the library's concepts.

``CTE`` holds the SQL form of each concept; the functions of the same name build it with Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskgraph.functions.dates import epoch_day
from riskgraph.operators.temporal import horizon_labels, lookback_memory, select_sources, step_calendar_over
from riskgraph.runtime import durable, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTE: dict[str, tuple[tuple[str, ...], str]] = {}

LOOKBACK, HORIZON, SLOTS = 7, 3, 5


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its name, with its SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def using(*names: str, select: str) -> str:
    """SQL text of ``select`` with the named concepts and all they need in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTE[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + select


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def wide_table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The same for work that is heavy per row: spread over the cores when the file has too few splits."""
    return spread(table(spark, d, name, *columns))


def r6(value: str | Column, name: str | None = None) -> Column:
    """Six decimals; adding zero turns a negative zero into zero."""
    label = name or (value if isinstance(value, str) else None)
    c = F.round(F.col(value) if isinstance(value, str) else value, 6) + 0.0
    return c.alias(label) if label else c


# --- dated signals: one event is one signal of its user -----------------------------------------

cte("signals", """
  SELECT event_id AS signal_id, user_id AS node_id,
         CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS event_day,
         event_type, value, value / (value + 50.0) AS confidence
  FROM events""")


def signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("node_id"), epoch_day("ts").alias("event_day"),
        "event_type", "value", (F.col("value") / (F.col("value") + 50.0)).alias("confidence"),
    )


cte("calendar", f"""
  SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS INTEGER) AS snapshot, CAST(q AS INTEGER) AS query_day,
         CAST(q + {HORIZON} AS INTEGER) AS target_day
  FROM (SELECT unnest(range(lo, hi - {HORIZON} + 1)) AS q
        FROM (SELECT min(event_day) AS lo, max(event_day) AS hi FROM signals))""", "signals")


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return step_calendar_over(signals(spark, d), "event_day", HORIZON, 1)


cte("memory", f"""
  SELECT snapshot, node_id, signal_id, event_day, confidence, event_type, query_day - event_day AS age_days,
         CAST(row_number() OVER (PARTITION BY snapshot, node_id ORDER BY event_day DESC, signal_id DESC) - 1 AS INTEGER) AS slot
  FROM signals JOIN calendar ON event_day > query_day - {LOOKBACK} AND event_day < query_day
  QUALIFY slot < {SLOTS}""", "signals", "calendar")


def memory(spark: SparkSession, d: str) -> DataFrame:
    return lookback_memory(signals(spark, d), calendar(spark, d), SLOTS, LOOKBACK)


cte("users", "SELECT DISTINCT node_id FROM signals", "signals")

cte("labels_at", """
  SELECT c.snapshot, u.node_id, CAST(count(s.signal_id) > 0 AS INTEGER) AS label
  FROM calendar c CROSS JOIN users u
  LEFT JOIN signals s ON s.node_id = u.node_id AND s.event_type = 'error'
       AND s.event_day >= c.query_day AND s.event_day < c.target_day
  GROUP BY c.snapshot, u.node_id""", "signals", "calendar", "users")


def node_labels(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return horizon_labels(s, s.filter(F.col("event_type") == "error"), calendar(spark, d))


# Recency score of the remembered signals. A node without memory has no label to rank it by: unknown.
cte("scores", f"""
  SELECT l.snapshot, l.node_id, CASE WHEN m.s IS NOT NULL THEN l.label END AS label,
         coalesce(m.s / (m.s + 10.0), 0.0) AS prob
  FROM labels_at l LEFT JOIN (
    SELECT snapshot, node_id, sum({LOOKBACK} - age_days) AS s FROM memory GROUP BY snapshot, node_id) m
  ON m.snapshot = l.snapshot AND m.node_id = l.node_id""", "labels_at", "memory")


def scores(spark: SparkSession, d: str) -> DataFrame:
    strength = memory(spark, d).groupBy("snapshot", "node_id").agg(F.sum(F.lit(LOOKBACK) - F.col("age_days")).alias("s"))
    return node_labels(spark, d).join(strength, ["snapshot", "node_id"], "left").select(
        "snapshot", "node_id", F.when(F.col("s").isNotNull(), F.col("label")).alias("label"),
        F.coalesce(F.col("s") / (F.col("s") + 10.0), F.lit(0.0)).alias("prob"),
    )


# --- documents as scored items -------------------------------------------------------------------

cte("doc_scores", """
  SELECT d.doc_id AS node_id, d.lang, d.source, l.quality AS label, l.toxic,
         d.n_chars / (d.n_chars + 2000.0) AS prob, 400.0 / (d.n_chars + 400.0) AS other_prob
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")


def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    n = F.col("n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("node_id"), "lang", "source", F.col("quality").alias("label"), "toxic",
        (n / (n + 2000.0)).alias("prob"), (F.lit(400.0) / (n + 400.0)).alias("other_prob"),
    )


# --- typed supply graph, one snapshot per order year --------------------------------------------

cte("flows", """
  SELECT CAST(year(o_orderdate) AS INTEGER) AS snapshot, l_suppkey, l_partkey, o_custkey, l_quantity, l_discount,
         l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def flows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.year("o_orderdate").alias("snapshot"), "l_suppkey", "l_partkey", "o_custkey", "l_quantity", "l_discount",
        "l_extendedprice",
    )


cte("flow_edges", """
  SELECT snapshot, 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, 'supplies' AS rel, sum(l_quantity) AS qty
  FROM flows GROUP BY ALL
  UNION ALL
  SELECT snapshot, 'p:' || l_partkey, 'c:' || o_custkey, 'shipped_to', sum(l_quantity) FROM flows GROUP BY ALL""", "flows")

# Dependency of an edge: its share of the quantity its target receives through the relation.
cte("edges", """
  SELECT snapshot, src || '|' || dst || '|' || rel AS edge_id, src, dst, rel, qty,
         qty / sum(qty) OVER (PARTITION BY snapshot, dst, rel) AS dependency
  FROM flow_edges""", "flow_edges")


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with year, customer and the outcomes ``returned`` of a supply and ``discounted`` of a shipment.

    An outcome is known for every supply and for the shipments of orders that are not open. A line's part of both is found
    before it moves to its order, so that flags move and not what they are taken from.
    """
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag").select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice",
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).cast("byte").alias("returned"),
        (F.col("l_discount") > 0.07).cast("byte").alias("_low"),
    )
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("snapshot"), (F.col("o_orderstatus") != "O").alias("_closed")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "snapshot", "l_suppkey", "l_partkey", "o_custkey", "l_quantity", "l_extendedprice", "returned",
        F.when(F.col("_closed"), F.col("_low")).alias("discounted"),
    )


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by pair of nodes with quantity, largest price, known outcome ``label`` and dependency.

    A line is moved once for each of its two edges, to the place of the edge's target. Edges, the sums of their targets and
    later joins by target all find their rows there; rows of one target are aggregated and summed sorted, spilling if need be.
    """
    supplier, part, customer = (F.concat(F.lit(p), c) for p, c in (("s:", "l_suppkey"), ("p:", "l_partkey"), ("c:", "o_custkey")))

    def edge(src, dst, rel, label):
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.col(label).cast("int").alias("label"))

    both = _order_lines(spark, d).select(
        "snapshot", "l_quantity", "l_extendedprice",
        F.inline(F.array(edge(supplier, part, "supplies", "returned"), edge(part, customer, "shipped_to", "discounted"))),
    )
    pairs = both.repartition("dst").groupBy("snapshot", "src", "dst", "rel").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("price"), F.max("label").alias("label")
    )
    return pairs.withColumn("dependency", F.col("qty") / F.sum("qty").over(W.partitionBy("snapshot", "dst", "rel")))


def edge_flow(spark: SparkSession, d: str) -> DataFrame:
    """The rows of :func:`edge_rows`, written once where edges, sources and outcomes are all taken from them.

    Numbers move and are written, ids of nodes are spelled out by the reader; the price is that of supplies only, as it ranks suppliers.
    """

    def edge(src, dst, shipped, price, label):
        return F.struct(
            F.col(src).alias("tail"), F.col(dst).alias("head"), F.lit(shipped).alias("shipped"), price.alias("price"), F.col(label).alias("label")
        )

    both = _order_lines(spark, d).select("snapshot", "l_quantity", F.inline(F.array(
        edge("l_suppkey", "l_partkey", False, F.col("l_extendedprice"), "returned"),
        edge("l_partkey", "o_custkey", True, F.lit(None).cast("double"), "discounted"),
    )))
    pairs = both.repartition("head", "shipped").groupBy("snapshot", "tail", "head", "shipped").agg(
        F.sum("l_quantity").alias("qty"), F.max("price").alias("price"), F.max("label").alias("label")
    )
    flow = durable(pairs.withColumn("dependency", F.col("qty") / F.sum("qty").over(W.partitionBy("snapshot", "head", "shipped"))), "flow")
    shipped = F.col("shipped")
    return flow.select(
        "snapshot",
        F.concat(F.when(shipped, "p:").otherwise("s:"), "tail").alias("src"), F.concat(F.when(shipped, "c:").otherwise("p:"), "head").alias("dst"),
        F.when(shipped, "shipped_to").otherwise("supplies").alias("rel"), "qty", "price", F.col("label").cast("int").alias("label"), "dependency",
    )


def edges_of(flow: DataFrame) -> DataFrame:
    """Edges with their dependency and, where it is known, their outcome ``label``."""
    return flow.select("snapshot", F.concat_ws("|", "src", "dst", "rel").alias("edge_id"), "src", "dst", "rel", "qty", "dependency", "label")


def sources_of(flow: DataFrame) -> DataFrame:
    """At most six sources a year, written so that the planner knows how few they are and sends them to the edges."""
    best = flow.filter(F.col("rel") == "supplies").groupBy("snapshot", F.col("src").alias("node_id")).agg(F.max("price").alias("strength"))
    return durable(select_sources(best), "sources")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(edge_rows(spark, d)).drop("label")


cte("static_edges", """
  SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst, 'located_in' AS rel FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'located_in' FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'located_in' FROM nation
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'supplies' FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 'c:' || o_custkey, 'shipped_to' FROM flows""", "flows")


def static_edges(spark: SparkSession, d: str) -> DataFrame:
    def arcs(df, a, x, b, y, rel):
        return df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst")).withColumn("rel", F.lit(rel))

    f = flows(spark, d)
    return (
        arcs(table(spark, d, "supplier"), "s:", "s_suppkey", "n:", "s_nationkey", "located_in")
        .unionByName(arcs(table(spark, d, "customer"), "c:", "c_custkey", "n:", "c_nationkey", "located_in"))
        .unionByName(arcs(table(spark, d, "nation"), "n:", "n_nationkey", "r:", "n_regionkey", "located_in"))
        .unionByName(arcs(table(spark, d, "lineitem", "l_suppkey", "l_partkey"), "s:", "l_suppkey", "p:", "l_partkey", "supplies").distinct())
        .unionByName(arcs(f, "p:", "l_partkey", "c:", "o_custkey", "shipped_to").distinct())
    )


cte("nodes", """
  SELECT 's:' || s_suppkey AS node_id, 'supplier' AS node_type, s_acctbal AS amount FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'part', p_retailprice FROM part
  UNION ALL SELECT 'c:' || c_custkey, 'customer', c_acctbal FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', CAST(n_nationkey AS DOUBLE) FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'region', CAST(r_regionkey AS DOUBLE) FROM region""")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def kind(name, prefix, key, amount):
        return table(spark, d, name).select(
            F.concat(F.lit(prefix), key).alias("node_id"), F.lit(name).alias("node_type"),
            F.col(amount).cast("double").alias("amount"),
        )

    return (
        kind("supplier", "s:", "s_suppkey", "s_acctbal")
        .unionByName(kind("part", "p:", "p_partkey", "p_retailprice"))
        .unionByName(kind("customer", "c:", "c_custkey", "c_acctbal"))
        .unionByName(kind("nation", "n:", "n_nationkey", "n_nationkey"))
        .unionByName(kind("region", "r:", "r_regionkey", "r_regionkey"))
    )


# Observed sources: up to six suppliers per year by their largest single delivery.
cte("sources", """
  SELECT snapshot, node_id, strength,
         CAST(row_number() OVER (PARTITION BY snapshot ORDER BY strength DESC, node_id DESC) AS INTEGER) AS rank
  FROM (SELECT snapshot, 's:' || l_suppkey AS node_id, max(l_extendedprice) AS strength FROM flows GROUP BY ALL)
  QUALIFY rank <= 6""", "flows")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return select_sources(
        flows(spark, d).select(
            "snapshot", F.concat(F.lit("s:"), "l_suppkey").alias("node_id"), F.col("l_extendedprice").alias("strength")
        )
    )
