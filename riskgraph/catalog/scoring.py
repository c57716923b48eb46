"""Baseline training and prediction reports on the event signals."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import edge_flow, query, r6, scores, sources_of, using
from riskgraph.catalog.graphs import path_edges
from riskgraph.catalog.memories import DIM, gathered
from riskgraph.catalog.metrics import event_split
from riskgraph.plans import scoring as P
from riskgraph.runtime import durable


@query(using("scores", select="""
  SELECT snapshot, node_id, prob, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY prob DESC, node_id) AS INTEGER) AS rank
  FROM scores QUALIFY rank <= 10"""))
def top_risk_nodes(spark, d):
    return P.top_nodes(scores(spark, d), 10).select("snapshot", "node_id", "prob", "rank")


@query(using("scores", select="SELECT snapshot, node_id, prob FROM scores WHERE prob >= 0.5"))
def risk_scope_nodes(spark, d):
    return P.risk_scope(scores(spark, d), 0.5)


@query(using("scores", "beams", select="""
  SELECT snapshot + 1994 AS snapshot, 'top' AS part, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY prob DESC, node_id) AS INTEGER) AS rank,
    CAST(node_id AS VARCHAR) AS item, round(prob, 6) AS value FROM scores QUALIFY rank <= 10
  UNION ALL SELECT snapshot + 1994, 'scope', NULL, CAST(node_id AS VARCHAR), round(prob, 6) FROM scores WHERE prob >= 0.5
  UNION ALL SELECT snapshot, 'path', CAST(rank AS INTEGER), array_to_string(nodes, '>') || '|' || array_to_string(edge_ids, ';'), round(log_score, 6) FROM beams
    WHERE snapshot IN (SELECT snapshot + 1994 FROM scores)"""))
def snapshot_prediction_report(spark, d):
    """All listed nodes and paths and the whole risk scope. Event snapshots are aligned with delivery years so that both halves of the report meet."""
    s = durable(scores(spark, d).withColumn("snapshot", F.col("snapshot") + 1994), "scores")
    flow = edge_flow(spark, d)
    out = P.prediction_report(s, path_edges(spark, d, flow), sources_of(flow), 0.5, 10, 10, 3, 5, written=True)
    nested = out["summary"].select("snapshot", "top_nodes", "paths")
    node = lambda c: F.col(f"{c}.node_id").cast("string")
    path = F.concat(F.array_join("p.nodes", ">"), F.lit("|"), F.array_join("p.edge_ids", ";"))
    return (
        nested.select("snapshot", F.explode("top_nodes").alias("t")).select("snapshot", F.lit("top").alias("part"), F.col("t.rank").alias("rank"), node("t").alias("item"), r6(F.col("t.prob"), "value"))
        .unionByName(out["risk_scope"].select("snapshot", F.lit("scope").alias("part"), F.lit(None).cast("int").alias("rank"), F.col("node_id").cast("string").alias("item"), r6("prob", "value")))
        .unionByName(nested.select("snapshot", F.explode("paths").alias("p")).select("snapshot", F.lit("path").alias("part"), F.col("p.rank").alias("rank"), path.alias("item"), r6(F.col("p.log_score"), "value")))
    )


# --- the baseline in SQL: features, then Newton steps with Gauss-Jordan elimination as a recursion over columns ----------------------

ITERATIONS, RIDGE = 5, 1.0
MODE_PARTS = {"text_mlp": ("coalesce(p.pooled, list_transform(range(64), lambda i: 0.0::DOUBLE))", DIM), "graph_only": ("[(s.node_id % 10) / 10.0::DOUBLE, (s.node_id % 7) / 7.0::DOUBLE]", 2)}
MODE_PARTS["concat"] = (f"list_concat({MODE_PARTS['text_mlp'][0]}, {MODE_PARTS['graph_only'][0]})", DIM + 2)


def _baseline_sql(mode):
    parts, n = MODE_PARTS[mode]
    d = n + 1
    steps = [f"b0 AS (SELECT list_transform(range({d}), lambda i: 0.0::DOUBLE) AS b)"]
    for t in range(1, ITERATIONS + 1):
        steps.append(f"""
  p{t} AS MATERIALIZED (SELECT x, w, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM fit, b{t - 1}),
  e{t} AS MATERIALIZED (
    SELECT i, j, sum(w * CASE WHEN j > {d} THEN y - p ELSE p * (1 - p) END * x[i] * CASE WHEN j > {d} THEN 1 ELSE x[j] END) AS v
    FROM p{t}, range(1, {d + 1}) a(i), range(1, {d + 2}) c(j) GROUP BY i, j),
  m{t} AS MATERIALIZED (
    SELECT list(r ORDER BY i) AS m FROM (
      SELECT i, list(v + CASE WHEN i = j THEN pen WHEN j > {d} THEN -pen * b[i] ELSE 0 END ORDER BY j) AS r
      FROM (SELECT *, CASE WHEN i = 1 THEN 1e-9 ELSE {RIDGE} END AS pen FROM e{t}), b{t - 1} GROUP BY i)),
  s{t}(k, m) AS (
    SELECT CAST(0 AS BIGINT), m FROM m{t} UNION ALL
    SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1])
      ELSE list_transform(r, lambda v, j: v - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM s{t} WHERE k < {d}),
  b{t} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v + m[i][{d + 1}]) AS b FROM s{t}, b{t - 1} WHERE k = {d})""")
    head = using("gathered", "event_months", "scores", select="").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return f"""{head},
  pooled AS (SELECT snapshot, node_id, list(a ORDER BY i) AS pooled FROM (
    SELECT snapshot, node_id, i, avg(embedding[i]::DOUBLE) AS a FROM gathered, range(1, {DIM + 1}) r(i) GROUP BY snapshot, node_id, i) GROUP BY snapshot, node_id),
  feat AS MATERIALIZED (
    SELECT s.snapshot, s.node_id, e.split, s.label, list_concat([1.0::DOUBLE], {parts}) AS x
    FROM scores s JOIN event_months e USING (snapshot) LEFT JOIN pooled p ON p.snapshot = s.snapshot AND p.node_id = s.node_id),
  pos AS (SELECT least(greatest(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 0.02), 50.0) AS pw FROM feat WHERE split = 0 AND label IS NOT NULL),
  fit AS MATERIALIZED (SELECT x, label::DOUBLE AS y, CASE WHEN label = 1 THEN pw ELSE 1.0 END AS w FROM feat, pos WHERE split = 0 AND label IS NOT NULL),
  {",".join(steps)}
SELECT snapshot, node_id, split, label, round(1 / (1 + exp(-list_dot_product(x, b))), 6) AS prob FROM feat, b{ITERATIONS}"""


def _baseline(spark, d, mode):
    grid = scores(spark, d).select("snapshot", "node_id", "label").join(event_split(spark, d).select("snapshot", "split"), "snapshot")
    slots = gathered(spark, d).withColumnRenamed("embedding", "vector")
    static = grid.select("node_id").distinct().withColumn("features", F.array((F.col("node_id") % 10) / 10.0, (F.col("node_id") % 7) / 7.0))
    trained = P.train_baseline(P.features(grid, slots, static, mode, DIM), ITERATIONS, RIDGE)
    return trained.scores.select("snapshot", "node_id", "split", "label", r6("prob"))


@query(_baseline_sql("concat"))
def baseline_classifier_scores(spark, d):
    """Scores of all nodes by text and static features together, fitted on early snapshots."""
    return _baseline(spark, d, "concat")


@query(_baseline_sql("text_mlp"))
def baseline_text_scores(spark, d):
    return _baseline(spark, d, "text_mlp")


@query(_baseline_sql("graph_only"))
def baseline_graph_scores(spark, d):
    return _baseline(spark, d, "graph_only")
