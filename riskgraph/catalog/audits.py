"""Audits over the snapshot tables, the supply graph, annotations and run records."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import (
    calendar, cte, doc_scores, memory, node_labels, nodes, query, scores, signals, static_edges, table, wide_table, using,
)
from riskgraph.catalog.metrics import event_split
from riskgraph.operators import annotate as N
from riskgraph.catalog.temporal import label_runs
from riskgraph.operators import audit as A
from riskgraph.operators.extraction import accepted_signals, validate_signals
from riskgraph.sources.tables import classify_json_lines, first_per_id

# Lines of several qualities: event properties, blank lines, cut JSON, JSON that is no object.
cte("json_lines", """
  SELECT event_id, CASE event_type WHEN 'error' THEN substr(props, 1, 4) WHEN 'view' THEN ' ' WHEN 'click' THEN '[1]' ELSE props END AS value, props FROM events""")


@query(using("json_lines", select="""
  SELECT event_id, CASE WHEN trim(value) = '' THEN 'jsonl_blank_line' WHEN value LIKE '[%' THEN 'jsonl_record' WHEN value <> props THEN 'jsonl_parse' END AS code,
         CASE WHEN value = props THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM json_lines"""))
def classified_json_lines(spark, d):
    e, kind = table(spark, d, "events"), F.col("event_type")
    value = F.when(kind == "error", F.substring("props", 1, 4)).when(kind == "view", " ").when(kind == "click", "[1]").otherwise(F.col("props"))
    out = classify_json_lines(e.select("event_id", value.alias("value")), "k bigint")
    return out.select("event_id", "code", "record.k")


@query(using("json_lines", select="""
  SELECT user_id AS id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) AS n_seen FROM events GROUP BY user_id"""))
def first_row_per_id(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    return first_per_id(e, F.col("user_id"), ["event_id"]).drop("user_id")


cte("sa", """
  SELECT split, min(query_day) AS q0, max(query_day) AS q1, max(target_day) AS t1 FROM event_months WHERE split >= 0 GROUP BY split""", "event_months")


@query(using("sa", "labels_at", "memory", select="""
  SELECT 'split_domain' AS code, CAST(count(*) FILTER (split NOT IN (-1, 0, 1, 2)) AS BIGINT) AS n FROM event_months
  UNION ALL SELECT 'split_coverage', 3 - count(*) FROM sa
  UNION ALL SELECT 'split_chronology', count(*) FROM sa a JOIN sa b ON b.split = a.split + 1 WHERE a.q1 >= b.q0
  UNION ALL SELECT 'split_target_leak', count(*) FROM sa a JOIN sa b ON b.split = a.split + 1 WHERE a.t1 >= b.q0
  UNION ALL SELECT 'forecast_horizon', count(*) FILTER (target_day <= query_day) FROM event_months
  UNION ALL SELECT 'label_domain', count(*) FILTER (label NOT IN (0, 1)) FROM labels_at
  UNION ALL SELECT 'purged_label', count(*) FROM labels_at WHERE snapshot IN (SELECT snapshot FROM event_months WHERE split = -1)
  UNION ALL SELECT 'memory_future_leak', count(*) FILTER (age_days <= 0) FROM memory
  UNION ALL SELECT 'memory_duplicate', count(*) FROM (SELECT 1 FROM memory GROUP BY snapshot, node_id, signal_id HAVING count(*) > 1)"""))
def snapshot_dataset_audit(spark, d):
    return A.snapshot_audit(event_split(spark, d), node_labels(spark, d), memory(spark, d))


# Label intervals with planted faults: wrong ends, wrong sizes, reversed and repeated runs.
cte("bad_runs", """
  SELECT node_id, first_query_day, CASE WHEN node_id % 7 = 0 THEN last_query_day + 1 WHEN node_id % 11 = 0 THEN first_query_day - 3 ELSE last_query_day END AS last_query_day,
         CASE WHEN node_id % 13 = 0 THEN n_snapshots + 1 ELSE n_snapshots END AS n_snapshots
  FROM label_runs, range(CASE WHEN node_id % 17 = 0 THEN 2 ELSE 1 END)""", "label_runs")
cte("run_places", """
  SELECT b.*, coalesce(x.place, 0) AS a, coalesce(y.place, 0) AS z FROM bad_runs b
  LEFT JOIN days x ON x.query_day = b.first_query_day LEFT JOIN days y ON y.query_day = b.last_query_day""", "bad_runs", "days")
cte("days", "SELECT query_day, row_number() OVER (ORDER BY query_day) AS place FROM calendar", "calendar")
cte("run_orders", """
  SELECT *, max(z) OVER (PARTITION BY node_id ORDER BY first_query_day, last_query_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM run_places""", "run_places")


@query(using("run_orders", select="""
  SELECT node_id, first_query_day, 'interval_start' AS code FROM run_orders WHERE a = 0
  UNION ALL SELECT node_id, first_query_day, 'interval_end' FROM run_orders WHERE z = 0
  UNION ALL SELECT node_id, first_query_day, 'interval_size' FROM run_orders WHERE a > 0 AND z > 0 AND (n_snapshots <> z - a + 1 OR z < a)
  UNION ALL SELECT node_id, first_query_day, 'interval_overlap' FROM run_orders WHERE a > 0 AND before >= a - 1"""))
def label_interval_faults(spark, d):
    node, last = F.col("node_id"), F.col("last_query_day")
    bad = label_runs(spark, d).select(
        "node_id", "first_query_day",
        F.when(node % 7 == 0, last + 1).when(node % 11 == 0, F.col("first_query_day") - 3).otherwise(last).alias("last_query_day"),
        (F.col("n_snapshots") + (node % 13 == 0).cast("int")).alias("n_snapshots"),
        F.explode(F.sequence(F.lit(1), F.when(node % 17 == 0, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
    return A.interval_audit(bad, calendar(spark, d))


# Memory rows with planted faults: a wrong age, a wrong owner, a wrong confidence, an unknown signal.
cte("bad_memory", """
  SELECT snapshot, CASE WHEN signal_id % 97 = 0 THEN node_id + 1 ELSE node_id END AS node_id,
         CASE WHEN signal_id % 89 = 0 THEN signal_id + 100000000 ELSE signal_id END AS signal_id,
         CASE WHEN signal_id % 101 = 0 THEN age_days + 1 ELSE age_days END AS age_days,
         CASE WHEN signal_id % 103 = 0 THEN confidence + 0.5 ELSE confidence END AS confidence FROM memory""", "memory")
cte("memory_faults", """
  SELECT 'memory_index_bounds' AS code, snapshot || '/' || m.node_id || '/' || m.signal_id AS detail FROM bad_memory m WHERE signal_id NOT IN (SELECT signal_id FROM signals)
  UNION ALL SELECT 'memory_lookback', snapshot || '/' || m.node_id || '/' || m.signal_id FROM bad_memory m JOIN signals s USING (signal_id) JOIN calendar c USING (snapshot) WHERE c.query_day - s.event_day > 5
  UNION ALL SELECT 'memory_entity_link', snapshot || '/' || m.node_id || '/' || m.signal_id FROM bad_memory m JOIN signals s USING (signal_id) WHERE s.node_id <> m.node_id
  UNION ALL SELECT 'memory_delta', snapshot || '/' || m.node_id || '/' || m.signal_id FROM bad_memory m JOIN signals s USING (signal_id) JOIN calendar c USING (snapshot) WHERE c.query_day - s.event_day <> m.age_days
  UNION ALL SELECT 'memory_confidence', snapshot || '/' || m.node_id || '/' || m.signal_id FROM bad_memory m JOIN signals s USING (signal_id) WHERE abs(s.confidence - m.confidence) > 1e-6""", "bad_memory")


def bad_memory(spark, d):
    s = F.col("signal_id")
    return memory(spark, d).select(
        "snapshot", F.when(s % 97 == 0, F.col("node_id") + 1).otherwise(F.col("node_id")).alias("node_id"),
        F.when(s % 89 == 0, s + 100000000).otherwise(s).alias("signal_id"),
        F.when(s % 101 == 0, F.col("age_days") + 1).otherwise(F.col("age_days")).alias("age_days"),
        F.when(s % 103 == 0, F.col("confidence") + 0.5).otherwise(F.col("confidence")).alias("confidence"),
    )


@query(using("memory_faults", select="SELECT code, detail FROM memory_faults"))
def memory_audit(spark, d):
    return A.memory_audit(bad_memory(spark, d), signals(spark, d), calendar(spark, d), lookback=5)


@query(using("memory_faults", select="""
  SELECT code, count(*) AS n, array_to_string(list_sort(list(detail))[1:5], '; ') AS examples FROM memory_faults GROUP BY code"""))
def memory_audit_summary(spark, d):
    return A.summarize_violations(A.memory_audit(bad_memory(spark, d), signals(spark, d), calendar(spark, d), lookback=5))


@query("""
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return A.duplicates(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("""
  SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 'conflict' ELSE 'duplicate' END AS kind
  FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def annotation_conflicts(spark, d):
    return A.conflicts(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("""
  WITH e AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
       a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' ELSE 'different' END AS status
  FROM e FULL JOIN a ON a.k = e.k WHERE a.k IS NULL OR e.k IS NULL OR a.v IS DISTINCT FROM e.v""")
def reconciled_keys(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus")
    count = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return A.reconcile(count(o.filter(F.col("o_orderstatus") != "P")), count(o.filter(F.col("o_orderstatus") == "F")), ["k"], ["v"])


@query(using("nodes", select="""
  SELECT coalesce(s.kind, a.kind) AS kind, coalesce(s.n, 0) AS expected, coalesce(a.n, 0) AS actual
  FROM (SELECT unnest(['supplier', 'nation', 'factory']) AS kind, unnest([5::BIGINT, 25, 1]) AS n) s
  FULL JOIN (SELECT node_type AS kind, count(*) AS n FROM nodes GROUP BY 1) a ON a.kind = s.kind WHERE coalesce(s.n, 0) <> coalesce(a.n, 0)"""))
def specification_counts(spark, d):
    expected = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(n).cast("bigint").alias("n")) for k, n in (("supplier", 5), ("nation", 25), ("factory", 1))])))
    return A.expect_counts(nodes(spark, d).select(F.col("node_type").alias("kind")), expected)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def uncovered_entities(spark, d):
    urgent = table(spark, d, "orders", "o_custkey", "o_orderpriority").filter(F.col("o_orderpriority") == "1-URGENT")
    return A.uncovered(table(spark, d, "customer"), urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(using("static_edges", "nodes", select="""
  SELECT n AS node_id, count(*) AS n_edges FROM (SELECT unnest([src, dst]) AS n FROM static_edges)
  WHERE n NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'nation' OR amount < 20) GROUP BY n"""))
def dangling_endpoints(spark, d):
    kept = nodes(spark, d).filter((F.col("node_type") != "nation") | (F.col("amount") < 20))
    return A.dangling_endpoints(static_edges(spark, d), kept)


@query(using("static_edges", "nodes", select="""
  SELECT src, dst, rel FROM static_edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst
  WHERE NOT ((rel = 'supplies' AND a.node_type = 'supplier' AND b.node_type = 'part') OR (rel = 'located_in' AND b.node_type = 'nation' AND a.node_type = 'supplier'))
    AND rel <> 'shipped_to'"""))
def ontology_violations(spark, d):
    ontology = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rel"), F.lit(s).alias("src_type"), F.lit(t).alias("dst_type"))
        for r, s, t in (("supplies", "supplier", "part"), ("located_in", "supplier", "nation"), ("shipped_to", "part", "customer"))])))
    return A.ontology_violations(static_edges(spark, d), nodes(spark, d), ontology).select("src", "dst", "rel")


@query(using("signals", "doc_scores", select="""
  SELECT code, detail FROM (
    SELECT unnest(list_filter([CASE WHEN NOT coalesce(label IN (0, 1), false) THEN 'label_known' END, CASE WHEN NOT prob < 0.7 THEN 'prob_small' END,
      CASE WHEN NOT lang <> 'de' THEN 'language' END], lambda x: x IS NOT NULL)) AS code, CAST(node_id AS VARCHAR) AS detail FROM doc_scores)"""))
def row_rule_violations(spark, d):
    rules = {"label_known": F.col("label").isin(0, 1), "prob_small": F.col("prob") < 0.7, "language": F.col("lang") != "de"}
    return A.row_violations(doc_scores(spark, d), rules, F.col("node_id"))


@query(using("scores", select="""
  SELECT 'row_' || CASE WHEN snapshot % 5 = 0 THEN 'missing' ELSE 'different' END AS code, snapshot || '/' || node_id AS detail FROM scores
  WHERE snapshot % 5 = 0 OR (label IS NOT NULL AND node_id % 10 = 3)
  UNION ALL SELECT 'bounds', snapshot || '/' || node_id FROM scores WHERE snapshot % 5 <> 0 AND prob > 0.6"""))
def prediction_audit(spark, d):
    s = scores(spark, d)
    altered = s.filter(F.col("snapshot") % 5 != 0).withColumn(
        "label", F.when(F.col("node_id") % 10 == 3, 1 - F.col("label")).otherwise(F.col("label"))
    ).withColumn("prob", F.when(F.col("prob") > 0.6, F.col("prob") + 1).otherwise(F.col("prob")))
    return A.prediction_violations(altered, s)


@query("""
  SELECT o_custkey AS run, 'status' AS key, 'F' AS expected, max(o_orderstatus) AS actual FROM orders GROUP BY 1 HAVING max(o_orderstatus) <> 'F'
  UNION ALL SELECT o_custkey, 'extra', NULL, min(o_orderpriority) FROM orders GROUP BY 1""")
def parameter_conformity(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    runs = o.groupBy(F.col("o_custkey").alias("run")).agg(
        F.create_map(F.lit("status"), F.max("o_orderstatus"), F.lit("extra"), F.min("o_orderpriority")).alias("config"))
    protocol = runs.select("run", F.create_map(F.lit("status"), F.lit("F")).alias("config"))
    return A.parameter_differences(runs, protocol)


@query(using("doc_scores", select="""
  SELECT lang, source, value, support, CASE WHEN value IS NULL AND support > 0 THEN 'missing' WHEN value > 0.5 THEN 'out_of_bounds' ELSE 'value_without_support' END AS problem
  FROM (SELECT lang, source, CASE WHEN count(label) <> 1 THEN round(avg(prob), 6) END AS value, count(label) AS support FROM doc_scores GROUP BY ALL)
  WHERE (value IS NULL AND support > 0) OR value > 0.5 OR (value IS NOT NULL AND support = 0)"""))
def metric_bounds(spark, d):
    m = doc_scores(spark, d).groupBy("lang", "source").agg(
        F.when(F.count("label") != 1, F.round(F.avg("prob"), 6)).alias("value"), F.count("label").alias("support"))
    return A.bound_violations(m, ["lang", "source"], 0.0, 0.5)


cte("grid", """
  SELECT * FROM (SELECT unnest(['en', 'de', 'xx']) AS dataset) CROSS JOIN (SELECT unnest(['full', 'text']) AS mode) CROSS JOIN (SELECT 'src' || i AS seed FROM range(22) r(i))""")


@query(using("runs", "grid", select="""
  SELECT coalesce(g.dataset, r.dataset) AS dataset, coalesce(g.mode, r.mode) AS mode, coalesce(CAST(substr(g.seed, 4) AS INTEGER), CAST(substr(r.seed, 4) AS INTEGER)) AS seed,
         CASE WHEN r.seed IS NULL THEN 'missing' ELSE 'extra' END AS status
  FROM grid g FULL JOIN runs r ON r.dataset = g.dataset AND r.mode = g.mode AND r.seed = g.seed WHERE r.seed IS NULL OR g.seed IS NULL"""))
def protocol_coverage(spark, d):
    from riskgraph.catalog.metrics import runs

    actual = runs(spark, d).withColumn("seed", F.substring("seed", 4, 9).cast("int"))
    return A.protocol_coverage(actual, ["en", "de", "xx"], ["full", "text"], range(22))


# Annotations from orders: the window is the order's month, the label its status, the event date its first delivery.
cte("ann", """
  SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE '-1' END AS label,
         CASE WHEN o_orderpriority = '5-LOW' THEN '0' ELSE '1' END AS verified, o_orderpriority AS reviewer,
         CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'span' END AS evidence_span, strftime(o_orderdate, '%Y-%m-%d') AS query_day,
         CASE WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS target_day FROM orders""")


def annotations(spark, d):
    o = table(spark, d, "orders")
    k, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    return o.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"),
        F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").otherwise("-1").alias("label"),
        F.when(F.col("o_orderpriority") == "5-LOW", "0").otherwise("1").alias("verified"), F.col("o_orderpriority").alias("reviewer"),
        F.when(k % 17 == 0, " ").otherwise("span").alias("evidence_span"), F.lit("http://example.org").alias("evidence_url"),
        date.cast("string").alias("query_day"),
        F.when(k % 13 == 0, date.cast("string")).otherwise(F.date_add(date, 30).cast("string")).alias("target_day"),
    )


@query(using("ann", select="""
  SELECT o_orderkey, CASE WHEN trim(evidence_span) = '' THEN 'blank_evidence_span' WHEN label = '-1' THEN 'label_not_0_or_1'
         WHEN verified <> '1' THEN 'not_verified' ELSE 'target_not_after_query' END AS problem
  FROM ann WHERE trim(evidence_span) = '' OR label = '-1' OR verified <> '1' OR query_day >= target_day"""))
def annotation_cell_violations(spark, d):
    return N.cell_violations(annotations(spark, d), N.NODE_FIELDS).select("o_orderkey", "problem")


cte("ann_windows", "SELECT DISTINCT query_day, target_day FROM ann WHERE label = '1' AND target_day > query_day AND CAST(substr(query_day, 9) AS INTEGER) <= 20", "ann")


@query(using("ann_windows", select="""
  SELECT o_orderkey, problem FROM (SELECT o_orderkey, CASE
      WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) THEN 'unknown_entity'
      WHEN (query_day, target_day) NOT IN (SELECT (query_day, target_day) FROM ann_windows) THEN 'window_mismatch'
      WHEN label = '1' AND o_orderkey % 3 = 0 THEN 'positive_without_date'
      WHEN label = '1' AND o_orderkey % 3 = 1 THEN 'event_outside_window'
      WHEN label = '0' AND o_orderkey % 3 <> 0 THEN 'negative_with_date' END AS problem FROM ann WHERE label <> '-1') WHERE problem IS NOT NULL"""))
def annotation_window_violations(spark, d):
    rows = annotations(spark, d).filter(F.col("label") != "-1")
    k = F.col("o_orderkey") % 3
    rows = rows.withColumn("event_date", F.when(k == 0, "").when(k == 1, F.date_add(F.col("query_day").cast("date"), 30).cast("string")).otherwise(F.col("query_day")))
    typed = N.typed(rows)
    day = F.dayofmonth(F.date_from_unix_date("query_day"))
    windows = typed.filter((F.col("label") == 1) & (F.col("target_day") > F.col("query_day")) & (day <= 20)).select("query_day", "target_day").distinct()
    known = table(spark, d, "customer").filter(F.col("c_nationkey") < 20).select(F.col("c_custkey").cast("string").alias("node_id"))
    return N.node_violations(typed, windows, known).select("o_orderkey", "problem")


@query("""
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 THEN 'matched' ELSE 'several_edges' END AS problem
  FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag) AS n FROM lineitem)""")
def annotation_edge_matches(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    known = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"),
                         F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("edge_id"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("source_id"),
                        F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"))
    matched, wrong = N.match_edges(rows, known)
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "problem"]
    return matched.withColumn("problem", F.lit("matched")).select(*columns).unionByName(wrong.select(*columns))


# Extraction answers per document: evidence is the text's beginning, broken in a different way per source.
def answers(spark, d):
    docs = wide_table(spark, d, "documents", "doc_id", "text", "source")
    kind = F.col("doc_id") % 10
    quoted = F.regexp_extract(F.to_json(F.array(F.substring("text", 1, 12))), r"(?s)^\[(.*)\]$", 1)
    number = F.when(kind == 4, "1.5").when(kind == 5, '"0.5"').otherwise("0.5")
    signal = F.concat(
        F.lit('{"entity_id":"'), F.when(kind == 1, "nobody").otherwise(F.col("source")), F.lit('","evidence":'),
        F.when(kind == 2, F.lit('"~absent~"')).otherwise(quoted), F.lit(',"event":'), F.when(kind == 8, "7").otherwise('"e"'),
        F.lit(',"category":'), F.when(kind == 3, '" "').when(kind == 9, '["c"]').otherwise('"c"'), F.lit(',"uncertainty":'), number, F.lit(',"sentiment":-0.5,"confidence":1}'))
    raw = F.when(kind == 6, "no object").when(kind == 7, '{"signals":3}').otherwise(F.concat(F.lit('Answer: {"signals":['), signal, F.lit("]} end")))
    return docs.select(F.col("doc_id").alias("document_id"), "text", F.array("source").alias("entity_ids"), raw.alias("raw"))


@query("""
  SELECT doc_id AS document_id, CASE doc_id % 10 WHEN 6 THEN 'no_json_object' WHEN 7 THEN 'signals_not_a_list' WHEN 1 THEN 'entity_not_listed' WHEN 2 THEN 'evidence_not_literal'
         WHEN 4 THEN 'invalid_uncertainty' WHEN 5 THEN 'invalid_uncertainty' WHEN 3 THEN 'missing_category' WHEN 8 THEN 'missing_event' WHEN 9 THEN 'missing_category' END AS reason FROM documents""")
def extracted_signal_validation(spark, d):
    return validate_signals(answers(spark, d)).select("document_id", "reason")


@query("""
  SELECT doc_id AS document_id, source AS entity_id, 'e' AS event, 'c' AS category, sha256(substr(text, 1, 12)) AS evidence_hash, 0.5::DOUBLE AS uncertainty, -0.5::DOUBLE AS sentiment, 1.0::DOUBLE AS confidence
  FROM documents WHERE doc_id % 10 = 0""")
def accepted_extracted_signals(spark, d):
    out = accepted_signals(validate_signals(answers(spark, d)))
    return out.select("document_id", "entity_id", "event", "category", F.sha2("evidence", 256).alias("evidence_hash"), "uncertainty", "sentiment", "confidence")


# Order lines as signals that cite the text of their order; orders in part are texts nobody delivered.
@query("""
  SELECT l_orderkey * 1000 + l_linenumber AS signal_id, CASE WHEN l_quantity > 1 THEN l_orderkey END AS text_id,
         CASE WHEN o_orderkey IS NULL THEN 'signal_text_link' ELSE 'signal_text_consistency' END AS code
  FROM lineitem LEFT JOIN orders ON o_orderkey = CASE WHEN l_quantity > 1 THEN l_orderkey END AND o_orderstatus <> 'P'
  WHERE o_orderkey IS NULL OR o_orderkey % 3 + 1 <> l_linenumber OR year(o_orderdate) <> year(l_shipdate)""")
def signal_text_violations(spark, d):
    cited = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("signal_id"),
        F.when(F.col("l_quantity") > 1, F.col("l_orderkey")).alias("text_id"), F.col("l_linenumber").cast("long").alias("node_id"),
        F.year("l_shipdate").alias("event_day"),
    )
    texts = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("text_id"), (F.col("o_orderkey") % 3 + 1).cast("long").alias("node_id"), F.year("o_orderdate").alias("event_day"))
    return A.signal_text_violations(cited, texts)
