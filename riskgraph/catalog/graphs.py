"""Graph traversal, beam-searched and enumerated paths, propagation, taxonomies and cascades."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import cte, edge_flow, edges, edges_of, nodes, query, r6, sources, sources_of, static_edges, table, using
from riskgraph.operators import graph as G
from riskgraph.operators import propagate as P
from riskgraph.operators.joins import lookup_join
from riskgraph.operators.metrics import path_log_score
from riskgraph.runtime import durable

WIDTH, HOPS, TOP = 10, 3, 5

# Path graph of a year: deliveries weighted by their dependency, customers attached to their nation.
cte("path_edges", """
  SELECT snapshot, edge_id, src, dst, dependency AS intensity FROM edges
  UNION ALL
  SELECT snapshot, dst || '|n:' || c_nationkey, dst, 'n:' || c_nationkey, 1.0
  FROM (SELECT DISTINCT snapshot, dst FROM edges WHERE rel = 'shipped_to') JOIN customer ON dst = 'c:' || c_custkey""", "edges")


def path_edges(spark, d, flow):
    """Edges of the written flow and the customers' homes, which are written too: both can be read at every hop."""
    homes = table(spark, d, "customer", "c_custkey", "c_nationkey").select(F.concat(F.lit("c:"), "c_custkey").alias("src"), "c_nationkey")
    customers = flow.filter(F.col("rel") == "shipped_to").select("snapshot", F.col("dst").alias("src")).distinct()
    attached = durable(lookup_join(customers, homes, ["src"]), "homes").select(
        "snapshot", "src", F.concat(F.lit("n:"), "c_nationkey").alias("dst"), F.lit(1.0).alias("intensity")
    ).select("snapshot", F.concat_ws("|", "src", "dst").alias("edge_id"), "src", "dst", "intensity")
    return edges_of(flow).select("snapshot", "edge_id", "src", "dst", F.col("dependency").alias("intensity")).unionByName(attached)


def _hop(i, table_name="path_edges"):
    return f"""
  SELECT snapshot, source, dst AS tail, list_append(nodes, dst) AS nodes, list_append(edge_ids, edge_id) AS edge_ids,
         log_score + ln(intensity) AS log_score
  FROM (SELECT b.snapshot, b.source, e.dst, b.nodes, b.edge_ids, e.edge_id, b.log_score, e.intensity
        FROM beam{i - 1} b JOIN {table_name} e ON e.snapshot = b.snapshot AND e.src = b.tail
        WHERE e.intensity > 0 AND NOT list_contains(b.nodes, e.dst))
  QUALIFY row_number() OVER (PARTITION BY snapshot, source
          ORDER BY log_score + ln(intensity) DESC, list_append(nodes, dst), list_append(edge_ids, edge_id)) <= {WIDTH}"""


cte("beam0", """
  SELECT snapshot, node_id AS source, node_id AS tail, [node_id] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids,
         CAST(0.0 AS DOUBLE) AS log_score FROM sources""", "sources", "path_edges")
for _i in range(1, HOPS + 1):
    cte(f"beam{_i}", _hop(_i), f"beam{_i - 1}")
cte("beams", f"""
  SELECT *, row_number() OVER (PARTITION BY snapshot, source ORDER BY log_score DESC, nodes, edge_ids) AS rank
  FROM ({" UNION ALL ".join(f"SELECT * FROM beam{i}" for i in range(1, HOPS + 1))}) QUALIFY rank <= {TOP}""", f"beam{HOPS}")


@query(using("beams", select="""
  SELECT snapshot, source, CAST(rank AS INTEGER) AS rank, array_to_string(nodes, '>') AS path,
         array_to_string(edge_ids, ';') AS edge_path, round(log_score, 6) AS log_score FROM beams"""))
def beam_paths(spark, d):
    flow = edge_flow(spark, d)
    found = G.beam_search(path_edges(spark, d, flow), sources_of(flow), WIDTH, HOPS, TOP, written=True)
    return found.select(
        "snapshot", "source", "rank", F.array_join("nodes", ">").alias("path"),
        F.array_join("edge_ids", ";").alias("edge_path"), r6("log_score"),
    )


# Known outcomes of delivery edges: returned lines are positive, others negative, open ones unknown.
cte("edge_labels", """
  SELECT CAST(year(o_orderdate) AS INTEGER) AS snapshot, 's:' || l_suppkey || '|p:' || l_partkey || '|supplies' AS edge_id,
         max(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 1 ELSE 0 END) AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
  UNION ALL
  SELECT CAST(year(o_orderdate) AS INTEGER), 'p:' || l_partkey || '|c:' || o_custkey || '|shipped_to',
         max(CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' GROUP BY ALL""")


cte("positive_edges", """
  SELECT DISTINCT e.snapshot, e.src, e.dst FROM edges e JOIN edge_labels l
  ON l.snapshot = e.snapshot AND l.edge_id = e.edge_id WHERE l.label = 1""", "edges", "edge_labels")
cte("truth", """
  WITH RECURSIVE walk AS (
    SELECT DISTINCT snapshot, node_id AS source, node_id AS tail, [node_id] AS nodes FROM sources
    UNION ALL
    SELECT w.snapshot, w.source, e.dst, list_append(w.nodes, e.dst) FROM walk w
    JOIN positive_edges e ON e.snapshot = w.snapshot AND e.src = w.tail
    WHERE len(w.nodes) <= 3 AND NOT list_contains(w.nodes, e.dst))
  SELECT DISTINCT snapshot, source, nodes FROM walk WHERE len(nodes) > 1""", "positive_edges", "sources")


cte("true_steps", """
  SELECT DISTINCT snapshot, nodes[i] AS a, nodes[i + 1] AS b
  FROM (SELECT snapshot, nodes, unnest(range(1, len(nodes))) AS i FROM truth)""", "truth")


@query(using("truth", select="SELECT snapshot, source, array_to_string(nodes, '>') AS path FROM truth"))
def true_simple_paths(spark, d):
    flow = edge_flow(spark, d)
    paths = G.simple_paths(flow.filter(F.col("label") == 1), sources_of(flow), HOPS)
    return paths.select("snapshot", "source", F.array_join("nodes", ">").alias("path"))


@query(using("truth", select="SELECT snapshot, count(*) AS n_paths, count(*) > 500 AS over_cap FROM truth GROUP BY snapshot"))
def true_path_counts(spark, d):
    flow = edge_flow(spark, d)
    return G.path_counts(flow.filter(F.col("label") == 1), sources_of(flow), HOPS, 500)


@query(using("true_steps", select="SELECT snapshot, a AS src, b AS dst FROM true_steps"))
def edges_on_true_paths(spark, d):
    flow = edge_flow(spark, d)
    return G.edges_on_paths(flow.filter(F.col("label") == 1), sources_of(flow), HOPS)


# The same beam on the labelled subgraph.
cte("known_edges", """
  SELECT e.snapshot, e.edge_id, e.src, e.dst, e.dependency AS intensity, l.label FROM edges e
  JOIN edge_labels l ON l.snapshot = e.snapshot AND l.edge_id = e.edge_id""", "edges", "edge_labels")
cte("kbeam0", """
  SELECT snapshot, node_id AS source, node_id AS tail, [node_id] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids,
         CAST(0.0 AS DOUBLE) AS log_score FROM sources""", "sources", "known_edges")
for _i in range(1, HOPS + 1):
    cte(f"kbeam{_i}", _hop(_i, "known_edges").replace(f"FROM beam{_i - 1}", f"FROM kbeam{_i - 1}"), f"kbeam{_i - 1}")
cte("predicted", f"""
  SELECT DISTINCT snapshot, source, nodes FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot, source ORDER BY log_score DESC, nodes, edge_ids) AS rank
    FROM ({" UNION ALL ".join(f"SELECT * FROM kbeam{i}" for i in range(1, HOPS + 1))}) QUALIFY rank <= {TOP})""", f"kbeam{HOPS}")
cte("pred_steps", """
  SELECT DISTINCT snapshot, nodes[i] AS a, nodes[i + 1] AS b
  FROM (SELECT snapshot, nodes, unnest(range(1, len(nodes))) AS i FROM predicted)""", "predicted")
cte("path_days", """
  SELECT s.snapshot, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true, coalesce(m.n, 0) AS n_match,
         coalesce(pe.n, 0) AS e_pred, coalesce(te.n, 0) AS e_true, coalesce(me.n, 0) AS e_match
  FROM (SELECT DISTINCT snapshot FROM sources WHERE snapshot IN (SELECT snapshot FROM known_edges)) s
  LEFT JOIN (SELECT snapshot, count(DISTINCT nodes) AS n FROM predicted GROUP BY 1) p USING (snapshot)
  LEFT JOIN (SELECT snapshot, count(DISTINCT nodes) AS n FROM truth GROUP BY 1) t USING (snapshot)
  LEFT JOIN (SELECT snapshot, count(DISTINCT nodes) AS n FROM predicted JOIN truth USING (snapshot, nodes) GROUP BY 1) m USING (snapshot)
  LEFT JOIN (SELECT snapshot, count(*) AS n FROM pred_steps GROUP BY 1) pe USING (snapshot)
  LEFT JOIN (SELECT snapshot, count(*) AS n FROM true_steps GROUP BY 1) te USING (snapshot)
  LEFT JOIN (SELECT snapshot, count(*) AS n FROM pred_steps JOIN true_steps USING (snapshot, a, b) GROUP BY 1) me USING (snapshot)""",
    "predicted", "truth", "pred_steps", "true_steps")
@query(using("path_days", select="""
  SELECT count(*) AS n_days, round(avg(p), 6) AS path_precision, round(avg(r), 6) AS path_recall,
         round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS path_f1,
         round(avg(coalesce(e_match / nullif(e_pred, 0), 0)), 6) AS path_edge_precision,
         round(avg(coalesce(e_match / nullif(e_true, 0), 0)), 6) AS path_edge_recall,
         CAST((SELECT count(*) FROM (SELECT DISTINCT snapshot, source FROM predicted JOIN truth USING (snapshot, source, nodes))) AS BIGINT) AS path_at_k_hits,
         CAST((SELECT count(*) FROM (SELECT DISTINCT snapshot, source FROM truth)) AS BIGINT) AS path_at_k_evaluable_sources,
         round((SELECT count(*) FROM (SELECT DISTINCT snapshot, source FROM predicted JOIN truth USING (snapshot, source, nodes)))
             / (SELECT count(*) FROM (SELECT DISTINCT snapshot, source FROM truth)), 6) AS path_at_k
  FROM (SELECT *, coalesce(n_match / nullif(n_pred, 0), 0) AS p, coalesce(n_match / nullif(n_true, 0), 0) AS r FROM path_days)"""))
def path_quality(spark, d):
    flow = edge_flow(spark, d)
    e = edges_of(flow).select("snapshot", "edge_id", "src", "dst", F.col("dependency").alias("intensity"), "label")
    out = G.path_metrics(e, None, sources_of(flow), WIDTH, HOPS, TOP, written=True)
    floats = [c for c in out.columns if c.startswith("path_") and c not in ("path_at_k_hits", "path_at_k_evaluable_sources")]
    return out.select(*[r6(c) if c in floats else F.col(c) for c in out.columns])


@query(using("edges", "sources", select="""
  SELECT snapshot, src, count(*) AS n_edges, round(sum(ln(greatest(dependency, 1e-12))), 6) AS log_score
  FROM edges WHERE rel = 'supplies' GROUP BY snapshot, src"""))
def path_log_scores(spark, d):
    e = edges(spark, d).filter(F.col("rel") == "supplies")
    return path_log_score(e.withColumnRenamed("dependency", "intensity"), ["snapshot", "src"]).select(
        "snapshot", "src", "n_edges", r6("log_score"))


@query(using("edges", "nodes", select="""
  SELECT snapshot, src AS tail, dst, edge_id, round(ln(dependency), 6) AS w FROM edges JOIN nodes ON node_id = dst
  WHERE dependency > 0 AND amount >= 1000"""))
def usable_adjacency(spark, d):
    e = edges(spark, d).withColumn("intensity", F.col("dependency"))
    p = nodes(spark, d).select("node_id", F.col("amount").alias("prob"))
    return G.scored_adjacency(e, p, 1000).select("snapshot", "tail", "dst", "edge_id", r6("w"))


cte("reach", """
  WITH RECURSIVE walk AS (
    SELECT DISTINCT node_id AS source, node_id, 0 AS hop FROM sources
    UNION
    SELECT w.source, e.dst, w.hop + 1 FROM walk w JOIN static_edges e ON e.src = w.node_id WHERE w.hop < 3)
  SELECT source, node_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY source, node_id""", "static_edges", "sources")


def reach(spark, d):
    return G.reachability(static_edges(spark, d), sources(spark, d).select(F.col("node_id").alias("source")), HOPS)


@query(using("reach", select="SELECT source, node_id, hop FROM reach"))
def hop_reachability(spark, d):
    return reach(spark, d)


@query(using("reach", select="""
  SELECT source, node_id, hop, (count(*) OVER (PARTITION BY source, hop) - 1) / 2
         - (row_number() OVER (PARTITION BY source, hop ORDER BY node_id) - 1) AS position FROM reach"""))
def level_layout(spark, d):
    return G.level_positions(reach(spark, d))


# Propagation inputs: load and threshold from account balances, buffer and logit from the deliveries.
cte("loads", "SELECT node_id, abs(amount) / 1000.0 AS load, 2.0 + (length(node_id) % 3) AS theta FROM nodes", "nodes")
cte("links", """
  SELECT 's:' || l_suppkey || '|p:' || l_partkey AS edge_id, 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst,
         l_returnflag AS rel, sum(l_quantity) / 1000.0 AS logit, max(l_discount) + 0.0 AS beta
  FROM lineitem GROUP BY ALL""")


def loads(spark, d):
    return nodes(spark, d).select(
        "node_id", (F.abs("amount") / 1000.0).alias("load"), (F.lit(2.0) + F.length("node_id") % 3).alias("theta")
    )


def links(spark, d):
    s, p = F.concat(F.lit("s:"), "l_suppkey"), F.concat(F.lit("p:"), "l_partkey")
    return table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_discount").groupBy(
        F.concat_ws("|", s, p).alias("edge_id"), s.alias("src"), p.alias("dst"), F.col("l_returnflag").alias("rel")
    ).agg((F.sum("l_quantity") / 1000.0).alias("logit"), (F.max("l_discount") + 0.0).alias("beta"))


@query(using("links", select="""
  SELECT edge_id, rel, round(exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY src, rel), 6) AS share
  FROM (SELECT *, max(logit) OVER (PARTITION BY src, rel) AS m FROM links)"""))
def outgoing_shares(spark, d):
    return P.group_softmax(links(spark, d)).select("edge_id", "rel", r6("share"))


def _carried(load, beta):
    return f"""
  SELECT edge_id, rel, src, dst, load_out * share * (1 - beta_used) AS transmitted FROM (
    SELECT *, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY src, rel) AS share FROM (
      SELECT *, max(x) OVER (PARTITION BY src, rel) AS m FROM (
        SELECT k.*, {load} AS load_out, {beta} AS beta_used, logit - {beta} AS x
        FROM links k JOIN loads n ON n.node_id = k.src)))"""


cte("carried", _carried("greatest(load - theta, 0)", "beta"), "links", "loads")
cte("diffused", _carried("1 / (1 + exp(-load))", "0.0"), "links", "loads")
cte("ungated", _carried("greatest(load, 0)", "0.0"), "links", "loads")


@query(using("carried", select="SELECT edge_id, rel, round(transmitted, 6) AS transmitted FROM carried"))
def overload_transport(spark, d):
    return P.transport(links(spark, d), loads(spark, d)).select("edge_id", "rel", r6("transmitted"))


@query(using("diffused", select="SELECT edge_id, rel, round(transmitted, 6) AS transmitted FROM diffused"))
def diffusion_transport(spark, d):
    return P.transport(links(spark, d), loads(spark, d), "no_overload").select("edge_id", "rel", r6("transmitted"))


@query(using("ungated", select="SELECT edge_id, rel, round(transmitted, 6) AS transmitted FROM ungated"))
def ungated_transport(spark, d):
    return P.transport(links(spark, d), loads(spark, d), "no_resgate").select("edge_id", "rel", r6("transmitted"))


@query(using("carried", "nodes", select="""
  SELECT n.node_id, round(coalesce(sum(transmitted), 0), 6) AS incoming FROM nodes n LEFT JOIN carried ON dst = n.node_id GROUP BY n.node_id"""))
def incoming_overload(spark, d):
    moved = P.transport(links(spark, d), loads(spark, d))
    return P.incoming_load(nodes(spark, d), moved).select("node_id", r6("incoming"))


@query(using("carried", "loads", select="""
  SELECT edge_id, rel, round(transmitted * p, 6) AS intensity, round(1 - exp(-transmitted * p), 6) AS edge_prob
  FROM carried JOIN (SELECT node_id, load / (load + 1.0) AS p FROM loads) ON node_id = dst"""))
def edge_probabilities(spark, d):
    n = loads(spark, d)
    prob = n.select("node_id", (F.col("load") / (F.col("load") + 1.0)).alias("prob"))
    scored = P.edge_intensity(P.transport(links(spark, d), n), prob)
    return scored.select("edge_id", "rel", r6("intensity"), r6("edge_prob"))


@query(using("edges", "loads", select="""
  SELECT snapshot, edge_id, round(a.load / (a.load + 1.0) * (b.load / (b.load + 1.0)) * least(greatest(dependency, 0), 1), 6) AS intensity
  FROM edges JOIN loads a ON a.node_id = src JOIN loads b ON b.node_id = dst"""))
def heuristic_edge_scores(spark, d):
    prob = loads(spark, d).select("node_id", (F.col("load") / (F.col("load") + 1.0)).alias("prob"))
    return P.heuristic_intensity(edges(spark, d), prob).select("snapshot", "edge_id", r6("intensity"))


@query(using("edges", "loads", select="""
  SELECT dst AS node_id, round(sum(s0 / greatest(w, 1e-12)) / greatest(count(*) FILTER (w > 0), 1), 6) AS m0,
         round(sum(s1 / greatest(w, 1e-12)) / greatest(count(*) FILTER (w > 0), 1), 6) AS m1,
         count(*) FILTER (w > 0) AS active_relations
  FROM (SELECT dst, snapshot AS rel, sum(dependency) AS w, sum(dependency * load) AS s0, sum(dependency * theta) AS s1
        FROM edges JOIN loads ON node_id = src GROUP BY ALL) GROUP BY dst"""))
def neighbour_messages(spark, d):
    e = edges(spark, d).withColumn("rel", F.col("snapshot"))
    features = loads(spark, d).select("node_id", F.array("load", "theta").alias("features"))
    out = P.neighbour_mean(e, features, 2)
    return out.select("node_id", r6(F.col("message")[0], "m0"), r6(F.col("message")[1], "m1"), "active_relations")


# --- taxonomies: part k is a subclass of part k/3 and of part k/5, types hang on the first parts -----

cte("arcs", """
  SELECT 'Q' || p_partkey AS child, 'Q' || (p_partkey // 3) AS parent, 'st' || p_partkey || 'a' AS statement_id, 0 AS seq FROM part WHERE p_partkey > 4
  UNION ALL SELECT 'Q' || p_partkey, 'Q' || (p_partkey // 5), 'st' || p_partkey || 'b', 1 FROM part WHERE p_partkey > 4 AND p_size % 2 = 0""")
cte("roots", """
  SELECT unnest(['product', 'material', 'industry', 'fictional', 'firm']) AS kind, unnest(['Q0', 'Q1', 'Q2', 'Q3', 'Q4']) AS qid""")


def arcs(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size").filter(F.col("p_partkey") > 4)
    q = lambda c: F.concat(F.lit("Q"), c)
    a = p.select(q("p_partkey").alias("child"), q(F.expr("p_partkey div 3")).alias("parent"),
                 F.concat(F.lit("st"), "p_partkey", F.lit("a")).alias("statement_id"), F.lit(0).alias("seq"))
    b = p.filter(F.col("p_size") % 2 == 0).select(
        q("p_partkey").alias("child"), q(F.expr("p_partkey div 5")).alias("parent"),
        F.concat(F.lit("st"), "p_partkey", F.lit("b")).alias("statement_id"), F.lit(1).alias("seq"))
    return a.unionByName(b)


def roots(spark):
    kinds = ["product", "material", "industry", "fictional", "firm"]
    return spark.range(5).select(
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") + 1).cast("int")).alias("kind"),
        F.concat(F.lit("Q"), "id").alias("qid"),
    )


@query(using("arcs", "roots", select="""
  SELECT qid, depth, CASE WHEN depth > 4 THEN 'beyond_limit' WHEN qid NOT IN (SELECT 'Q' || p_partkey FROM part WHERE p_size <> 7) THEN 'missing'
         WHEN qid IN (SELECT qid FROM roots) THEN 'root' ELSE 'expanded' END AS status
  FROM (SELECT qid, CAST(min(depth) AS INTEGER) AS depth FROM (
    WITH RECURSIVE walk AS (
      SELECT 'Q' || p_partkey AS qid, 0 AS depth FROM part WHERE p_type <> 'STANDARD'
      UNION SELECT qid, 0 FROM roots
      UNION SELECT a.parent, w.depth + 1 FROM walk w JOIN arcs a ON a.child = w.qid WHERE w.depth < 5)
    SELECT * FROM walk) GROUP BY qid)"""))
def taxonomy_expansion(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size", "p_type")
    seeds = p.filter(F.col("p_type") != "STANDARD").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"))
    known = p.filter(F.col("p_size") != 7).select(F.concat(F.lit("Q"), "p_partkey").alias("qid"))
    return G.expand_taxonomy(seeds, arcs(spark, d), roots(spark), known, 4)


cte("proofs", """
  SELECT start, kind, arg_min(steps, (len(ord), ord)) AS steps, min(len(ord)) AS n FROM (
    WITH RECURSIVE walk AS (
      SELECT 'Q' || p_partkey AS start, 'Q' || p_partkey AS qid, CAST([] AS VARCHAR[]) AS steps, CAST([] AS INTEGER[]) AS ord FROM part
      UNION ALL
      SELECT start, parent, list_append(steps, statement_id), list_append(ord, CAST(seq AS INTEGER))
      FROM walk JOIN arcs ON child = qid WHERE len(ord) < 12)
    SELECT * FROM walk) JOIN roots USING (qid) GROUP BY start, kind""", "arcs", "roots")


@query(using("proofs", select="SELECT start, kind, CAST(n AS INTEGER) AS n_steps, array_to_string(steps, '>') AS proof FROM proofs"))
def subclass_proofs(spark, d):
    starts = table(spark, d, "part", "p_partkey").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"))
    found = G.proof_paths(starts, arcs(spark, d), roots(spark))
    return found.select(
        "start", "kind", F.size("proof").alias("n_steps"),
        F.array_join(F.transform("proof", lambda s: s["statement_id"]), ">").alias("proof"),
    )


# Entities are suppliers, each an instance of the part with its number, and parts; parts of size 50 are firms.
cte("instances", """
  SELECT 'S' || s_suppkey AS qid, 'Q' || s_suppkey AS class_qid, 'is' || s_suppkey AS statement_id FROM supplier
  UNION SELECT DISTINCT 'Q' || p_partkey, 'Q4', 'ip' || p_partkey FROM part WHERE p_size = 50""")


def instances(spark, d):
    by_supplier = table(spark, d, "supplier", "s_suppkey").select(
        F.concat(F.lit("S"), "s_suppkey").alias("qid"), F.concat(F.lit("Q"), "s_suppkey").alias("class_qid"),
        F.concat(F.lit("is"), "s_suppkey").alias("statement_id"))
    by_part = table(spark, d, "part", "p_partkey", "p_size").filter(F.col("p_size") == 50).select(
        F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.lit("Q4").alias("class_qid"), F.concat(F.lit("ip"), "p_partkey").alias("statement_id"))
    return by_supplier.unionByName(by_part).distinct()


cte("evidence", """
  SELECT i.qid, p.kind, list_prepend(i.statement_id, p.steps) AS steps FROM instances i JOIN proofs p ON p.start = i.class_qid
  UNION ALL SELECT start, kind, steps FROM proofs WHERE kind IN ('product', 'material', 'industry', 'fictional') AND start IN (SELECT child FROM arcs)""",
    "instances", "proofs", "arcs")


def evidence(spark, d):
    return G.type_evidence(instances(spark, d), arcs(spark, d), roots(spark))


@query(using("evidence", select="SELECT qid, kind, CAST(len(steps) AS INTEGER) AS n_steps, array_to_string(steps, '>') AS proof FROM evidence"))
def type_evidence(spark, d):
    return evidence(spark, d).select(
        "qid", "kind", F.size("proof").alias("n_steps"), F.array_join(F.transform("proof", lambda s: s["statement_id"]), ">").alias("proof")
    )


# The same evidence against a statement table in which the statements of parts of size 8 are gone.
cte("lost", "SELECT statement_id FROM arcs JOIN part ON child = 'Q' || p_partkey WHERE p_size = 8", "arcs")


@query(using("evidence", "lost", select="""
  SELECT qid AS classified_qid, kind AS supported_type, steps[1] AS first_statement_id, CAST(i AS INTEGER) AS step, steps[i + 1] AS statement_id
  FROM (SELECT *, unnest(range(len(steps))) AS i FROM evidence) WHERE steps[i + 1] IN (SELECT statement_id FROM lost)"""))
def unproven_steps(spark, d):
    from riskgraph.operators.knowledge import unproven_steps as unproven

    parts = table(spark, d, "part", "p_partkey", "p_size").filter(F.col("p_size") == 8).select(F.concat(F.lit("Q"), "p_partkey").alias("child"))
    left = arcs(spark, d).join(parts, "child", "left_anti").select(
        F.col("child").alias("subject_qid"), F.lit("P279").alias("property_id"), F.col("parent").alias("object_qid"), "statement_id")
    direct = instances(spark, d).select(
        F.col("qid").alias("subject_qid"), F.lit("P31").alias("property_id"), F.col("class_qid").alias("object_qid"), "statement_id")
    return unproven(G.proof_steps(evidence(spark, d)), left.unionByName(direct)).select(
        "classified_qid", "supported_type", "first_statement_id", "step", "statement_id")


cte("kinds", """
  SELECT qid, list_sort(list_distinct(list(kind))) AS k FROM (
    SELECT i.qid, p.kind FROM instances i JOIN proofs p ON p.start = i.class_qid
    UNION SELECT start, kind FROM proofs WHERE kind IN ('product', 'material', 'industry', 'fictional') AND start IN (SELECT child FROM arcs))
  GROUP BY qid""", "instances", "proofs", "arcs")
cte("classified", """
  SELECT e.qid, CASE WHEN f OR len(u) <> 1 THEN 'unclassified' ELSE u[1] END AS entity_type, u AS candidates,
         CASE WHEN f THEN 'fictional_or_hypothetical_class_evidence' WHEN len(u) = 1 THEN 'official_instance_or_subclass_evidence'
              WHEN len(u) > 1 THEN 'ambiguous_overlapping_type_evidence' ELSE 'no_supported_five_type_path_within_taxonomy_budget' END AS type_reason,
         CASE WHEN e.qid IN (SELECT child FROM arcs) THEN 'class_or_category' ELSE 'instance_or_unspecified' END AS entity_form, f AS fictional
  FROM (SELECT 'S' || s_suppkey AS qid FROM supplier UNION ALL SELECT 'Q' || p_partkey FROM part) e
  LEFT JOIN (SELECT qid, list_filter(k, lambda x: x <> 'fictional') AS u0, list_contains(k, 'fictional') AS f0 FROM kinds) k ON k.qid = e.qid,
  LATERAL (SELECT coalesce(u0, []) AS u, coalesce(f0, false) AS f)""", "kinds")


def classified(spark, d):
    entities = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("qid")).unionByName(
        table(spark, d, "part").select(F.concat(F.lit("Q"), "p_partkey").alias("qid")))
    return G.classify_entities(entities, instances(spark, d), arcs(spark, d), roots(spark))


@query(using("classified", select="""
  SELECT qid, entity_type, array_to_string(candidates, ',') AS type_candidates, type_reason, entity_form, fictional FROM classified"""))
def entity_classification(spark, d):
    return classified(spark, d).select(
        "qid", "entity_type", F.array_join("type_candidates", ",").alias("type_candidates"), "type_reason", "entity_form",
        F.col("fictional_or_hypothetical").alias("fictional"),
    )


# --- cascades: shocks are large deliveries, events are the deliveries of the following lines ------------

cte("shocks", """
  SELECT CAST(year(o_orderdate) AS INTEGER) AS snapshot, 's:' || l_suppkey AS node_id, max(l_quantity) / 50.0 AS severity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_discount > 0.09 GROUP BY ALL""")
cte("capacity", "SELECT snapshot, node_id, 0.2 + (length(node_id) * 7 % 10) / 20.0 AS capacity FROM shocks", "shocks")
cte("cascade", """
  SELECT e.snapshot, e.edge_id, e.src, e.dst, qty, CASE WHEN rel = 'supplies' THEN 1 WHEN qty > 40 THEN 3 ELSE 2 END AS stage
  FROM edges e WHERE (rel = 'supplies' AND dependency > 0.4) OR (rel = 'shipped_to' AND qty >= 30 AND dependency > 0.2)""", "edges")


def cascade_parts(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_quantity").join(
        table(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    shocks = lines.filter((F.col("l_linenumber") == 1) & (F.col("l_discount") > 0.09)).groupBy(
        F.year("o_orderdate").alias("snapshot"), F.concat(F.lit("s:"), "l_suppkey").alias("node_id")
    ).agg((F.max("l_quantity") / 50.0).alias("severity"))
    capacity = shocks.select("snapshot", "node_id", (F.lit(0.2) + (F.length("node_id") * 7 % 10) / 20.0).alias("capacity"))
    e = durable(edges(spark, d), "edges")
    events = e.filter(
        ((F.col("rel") == "supplies") & (F.col("dependency") > 0.4))
        | ((F.col("rel") == "shipped_to") & (F.col("qty") >= 30) & (F.col("dependency") > 0.2))
    ).withColumn("stage", F.when(F.col("rel") == "supplies", 1).when(F.col("qty") > 40, 3).otherwise(2))
    numbered = e.select("snapshot", "edge_id", "src", "dst")
    unique = numbered.select(F.concat_ws("@", "edge_id", "snapshot").alias("edge_id"), "src", "dst")
    events = events.select("snapshot", F.concat_ws("@", "edge_id", "snapshot").alias("edge_id"), "stage", "qty")
    return unique, shocks, events, capacity


cte("initial", """
  SELECT snapshot, node_id FROM shocks JOIN capacity USING (snapshot, node_id) WHERE severity > capacity + 0.25""", "shocks", "capacity")
cte("f1", "SELECT DISTINCT snapshot, dst AS node_id FROM cascade WHERE stage = 1", "cascade")
cte("f2", "SELECT DISTINCT snapshot, dst AS node_id FROM cascade WHERE stage = 2", "cascade")


@query(using("initial", "f1", "f2", select="""
  SELECT snapshot, edge_id || '@' || snapshot AS edge_id, stage FROM cascade c WHERE
    (stage = 1 AND ((snapshot, src) NOT IN (SELECT (snapshot, node_id) FROM initial) OR (snapshot, dst) IN (SELECT (snapshot, node_id) FROM initial)))
    OR (stage = 2 AND ((snapshot, src) NOT IN (SELECT (snapshot, node_id) FROM f1) OR (snapshot, dst) IN (SELECT (snapshot, node_id) FROM initial UNION SELECT (snapshot, node_id) FROM f1)))
    OR (stage = 3 AND ((snapshot, src) NOT IN (SELECT (snapshot, node_id) FROM f2) OR (snapshot, dst) IN (SELECT (snapshot, node_id) FROM initial UNION SELECT (snapshot, node_id) FROM f1 UNION SELECT (snapshot, node_id) FROM f2)))"""))
def cascade_violations(spark, d):
    return G.replay_cascade(*cascade_parts(spark, d))["violations"]


@query(using("initial", "cascade", select="""
  SELECT snapshot, node_id FROM initial UNION SELECT snapshot, dst FROM cascade"""))
def cascade_node_truth(spark, d):
    return G.replay_cascade(*cascade_parts(spark, d))["node_truth"]


@query(using("cascade", select="SELECT DISTINCT snapshot, edge_id || '@' || snapshot AS edge_id FROM cascade"))
def cascade_edge_truth(spark, d):
    return G.replay_cascade(*cascade_parts(spark, d))["edge_truth"]


# Logs of the cascade with faults by the quantity: unknown edges, stages and days that don't exist, repeated records.
cte("event_log", """
  SELECT snapshot, edge_id || CASE WHEN q % 13 = 0 THEN '?' ELSE '@' END || snapshot AS edge_id, CASE WHEN q % 11 = 0 THEN 9 ELSE stage END AS stage,
         snapshot * 365 + stage * 10 + CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END AS event_day, q * 2 + c AS seq,
         q % 13 <> 0 AND q % 11 <> 0 AS placed
  FROM (SELECT *, CAST(qty AS BIGINT) AS q FROM cascade) CROSS JOIN (VALUES (0), (1)) v(c) WHERE c = 0 OR q > 45""", "cascade")
cte("shock_log", """
  SELECT snapshot, node_id, CASE WHEN q % 4 = 0 THEN -1.0 ELSE severity END AS severity,
         snapshot * 365 + 1 + CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END AS event_day, q * 2 + c AS seq
  FROM (SELECT *, CAST(round(severity * 50) AS BIGINT) AS q FROM shocks) CROSS JOIN (VALUES (0), (1)) v(c) WHERE c = 0 OR q > 40""", "shocks")


@query(using("event_log", "shock_log", select="""
  SELECT 'event' AS record, snapshot, edge_id AS item, seq, 'position' AS reason FROM event_log WHERE NOT placed
  UNION ALL
  SELECT 'event', snapshot, edge_id, seq, 'time' FROM event_log WHERE placed AND event_day <> snapshot * 365 + stage * 10
  UNION ALL
  SELECT 'event', snapshot, edge_id, seq, 'duplicate' FROM (
    SELECT * FROM event_log WHERE placed QUALIFY seq > min(seq) OVER (PARTITION BY snapshot, edge_id))
  UNION ALL
  SELECT 'shock', snapshot, node_id, seq, 'time' FROM shock_log WHERE event_day <> snapshot * 365 + 1
  UNION ALL
  SELECT 'shock', snapshot, node_id, seq, 'severity' FROM shock_log WHERE severity < 0
  UNION ALL
  SELECT 'shock', snapshot, node_id, seq, 'duplicate' FROM (
    SELECT * FROM shock_log QUALIFY seq > min(seq) OVER (PARTITION BY snapshot, node_id))"""))
def cascade_record_violations(spark, d):
    known, shocks, events, capacity = cascade_parts(spark, d)
    q = F.col("_q")

    def logged(rows, often, *columns):
        again = F.explode(F.when(q > often, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c")
        return rows.select("*", again).withColumn("seq", q * 2 + F.col("_c")).select("snapshot", *columns, "seq")

    day = F.col("snapshot") * 365
    event_log = logged(
        events.withColumn("_q", F.col("qty").cast("long")).withColumn("event_day", day + F.col("stage") * 10 + F.when(q % 7 == 0, 1).otherwise(0))
        .withColumn("stage", F.when(q % 11 == 0, 9).otherwise(F.col("stage")))
        .withColumn("edge_id", F.when(q % 13 == 0, F.translate("edge_id", "@", "?")).otherwise(F.col("edge_id"))),
        45, "edge_id", "stage", "event_day",
    )
    shock_log = logged(
        shocks.withColumn("_q", F.round(F.col("severity") * 50).cast("long")).withColumn("event_day", day + 1 + F.when(q % 3 == 0, 1).otherwise(0))
        .withColumn("severity", F.when(q % 4 == 0, -1.0).otherwise(F.col("severity"))),
        40, "node_id", "severity", "event_day",
    )
    days = events.select("snapshot").unionByName(shocks.select("snapshot")).distinct().withColumn("query_day", day)
    return G.cascade_record_violations(known, shock_log, event_log, capacity, days)
