"""Snapshot building: calendars, splits, memory, labels, evidence, graph freezing and encoding."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import (
    HORIZON, LOOKBACK, SLOTS, calendar, cte, edges, flows, memory, node_labels, query, signals, sources, static_edges,
    table, wide_table, using,
)
from riskgraph.functions.dates import epoch_day
from riskgraph.functions.text import phrase_spans
from riskgraph.operators import temporal as T
from riskgraph.operators.extraction import document_rollup
from riskgraph.operators.ordering import dense_index
from riskgraph.operators.stats import first_eligible_snapshot

_MEMORY = "SELECT snapshot, node_id, slot, signal_id, age_days, confidence FROM memory"


@query(using("memory", select=_MEMORY))
def memory_open_window(spark, d):
    return memory(spark, d).select("snapshot", "node_id", "slot", "signal_id", "age_days", "confidence")


@query(using("signals", "calendar", select=f"""
  SELECT snapshot, node_id, signal_id, query_day - event_day AS age_days,
         CAST(row_number() OVER (PARTITION BY snapshot, node_id ORDER BY event_day DESC, signal_id DESC) - 1 AS INTEGER) AS slot
  FROM signals JOIN calendar ON event_day >= query_day - {LOOKBACK} AND event_day < query_day
  QUALIFY slot < {SLOTS}"""))
def memory_closed_window(spark, d):
    return T.lookback_memory(signals(spark, d), calendar(spark, d), SLOTS, LOOKBACK, closed_left=True).select(
        "snapshot", "node_id", "signal_id", "age_days", "slot"
    )


@query(using("signals", "calendar", select="""
  SELECT snapshot, node_id, max(event_day * CAST(1000000000 AS BIGINT) + signal_id) % 1000000000 AS signal_id
  FROM signals JOIN calendar ON event_day > query_day - 30 AND event_day < query_day
  GROUP BY snapshot, node_id"""))
def latest_signal_asof(spark, d):
    return T.lookback_memory(signals(spark, d), calendar(spark, d), 1, 30).select("snapshot", "node_id", "signal_id")


@query(using("labels_at", select="SELECT snapshot, node_id, label FROM labels_at"))
def horizon_outcome_labels(spark, d):
    return node_labels(spark, d)


cte("label_runs", """
  SELECT node_id, CAST(min(query_day) AS INTEGER) AS first_query_day, CAST(max(query_day) AS INTEGER) AS last_query_day,
         CAST(count(*) AS INTEGER) AS n_snapshots
  FROM (SELECT l.node_id, c.query_day, c.place - row_number() OVER (PARTITION BY l.node_id ORDER BY c.query_day) AS island
        FROM labels_at l JOIN (SELECT snapshot, query_day, row_number() OVER (ORDER BY query_day) AS place FROM calendar) c
        ON c.snapshot = l.snapshot WHERE l.label = 1)
  GROUP BY node_id, island""", "labels_at", "calendar")


def label_runs(spark, d):
    return T.horizon_intervals(signals(spark, d).filter(F.col("event_type") == "error"), calendar(spark, d))


@query(using("label_runs", select="SELECT * FROM label_runs"))
def horizon_label_intervals(spark, d):
    return label_runs(spark, d)


@query(using("labels_at", select="SELECT snapshot, node_id FROM labels_at WHERE label = 1"))
def horizon_positive_cells(spark, d):
    return T.interval_positives(label_runs(spark, d), calendar(spark, d))


@query(using("labels_at", select="""
  SELECT snapshot, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM labels_at GROUP BY snapshot"""))
def horizon_label_totals(spark, d):
    n_nodes = signals(spark, d).agg(F.count_distinct("node_id")).scalar()
    return T.interval_label_counts(label_runs(spark, d), calendar(spark, d), n_nodes)


@query(using("signals", select="""
  SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS INTEGER) AS snapshot, CAST(q AS INTEGER) AS query_day,
         CAST(q + 4 AS INTEGER) AS target_day
  FROM (SELECT unnest(range(lo, hi - 4 + 1, 5)) AS q FROM (SELECT min(event_day) lo, max(event_day) hi FROM signals))"""))
def calendar_every_five_days(spark, d):
    return T.step_calendar_over(signals(spark, d), "event_day", 4, 5)


cte("months", """
  SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS snapshot,
         CAST(datediff('day', DATE '1970-01-01', m) AS INTEGER) AS query_day,
         CAST(datediff('day', DATE '1970-01-01', m) + 30 AS INTEGER) AS target_day
  FROM (SELECT CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS m
        FROM (SELECT CAST(min(o_orderdate) AS DATE) lo, CAST(max(o_orderdate) AS DATE) hi FROM orders))""")

cte("month_split", """
  SELECT snapshot, query_day, target_day,
         CASE WHEN query_day < a THEN CASE WHEN target_day >= a THEN -1 ELSE 0 END
              WHEN query_day < b THEN CASE WHEN target_day >= b THEN -1 ELSE 1 END ELSE 2 END AS split
  FROM months, (SELECT max(query_day) FILTER (snapshot = CAST(floor(n * 0.6) AS INT)) AS a,
                       max(query_day) FILTER (snapshot = CAST(floor(n * 0.8) AS INT)) AS b
                FROM months, (SELECT count(*) AS n FROM months))""", "months")


def month_split(spark, d):
    return T.split_by_fraction(T.monthly_calendar_over(table(spark, d, "orders", "o_orderdate"), "o_orderdate", 30))


@query(using("month_split", select="SELECT * FROM month_split"))
def monthly_split_by_fraction(spark, d):
    return month_split(spark, d)


@query(using("calendar", select="""
  SELECT snapshot, query_day, target_day,
         CASE WHEN query_day < 19738 THEN CASE WHEN target_day >= 19738 THEN -1 ELSE 0 END
              WHEN query_day < 19745 THEN CASE WHEN target_day >= 19745 THEN -1 ELSE 1 END ELSE 2 END AS split
  FROM calendar"""))
def daily_split_by_boundary(spark, d):
    return T.split_by_boundaries(calendar(spark, d), 19738, 19745)


# Documents as dated contexts of their source: the day follows from the document number.
cte("contexts", """
  SELECT doc_id AS context_id, doc_id // 3 AS doc_id, source AS node_id, text, CAST(doc_id % 7 AS INTEGER) AS char_start,
         CAST(19723 + doc_id % 30 AS INTEGER) AS event_day FROM documents""")
PHRASES = ["worthless", "license", "password", "the and"]


def contexts(spark, d):
    i = F.col("doc_id")
    return wide_table(spark, d, "documents", "doc_id", "source", "text").select(
        i.alias("context_id"), F.expr("doc_id div 3").alias("doc_id"), F.col("source").alias("node_id"), "text",
        (i % 7).cast("int").alias("char_start"), (i % 30 + 19723).cast("int").alias("event_day"),
    )


# Spans are rebuilt from the pieces between matches, as positions of matches are not an SQL function.
cte("spans", """
  SELECT context_id, doc_id, node_id, event_day, char_start, phrase,
         CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) AS INTEGER) AS span_start
  FROM (SELECT *, unnest(found) AS phrase, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT *, regexp_extract_all(text, '(?i)worthless|license|password|the and') AS found,
                     regexp_split_to_array(text, '(?i)worthless|license|password|the and') AS gaps FROM contexts)
        WHERE len(found) > 0)""", "contexts")


def spans(spark, d):
    return phrase_spans(contexts(spark, d), "text", PHRASES).drop("text")


@query(using("spans", select="""
  SELECT context_id, phrase, span_start, CAST(span_start + length(phrase) AS INTEGER) AS span_end FROM spans"""))
def phrase_occurrences(spark, d):
    return spans(spark, d).select("context_id", "phrase", "span_start", "span_end")


@query(using("spans", "calendar", select="""
  SELECT snapshot, node_id, doc_id, CAST(char_start + span_start AS INTEGER) AS document_start, phrase,
         min(event_day * CAST(100000000 AS BIGINT) + context_id) % 100000000 AS context_id
  FROM spans JOIN calendar ON event_day >= query_day AND event_day < target_day
  GROUP BY ALL"""))
def phrase_label_evidence(spark, d):
    return T.label_evidence(spans(spark, d), calendar(spark, d)).select(
        "snapshot", "node_id", "doc_id", "document_start", "phrase", "context_id"
    )


# Orders as contexts dated by month, order lines as links of suppliers with their own recorded month.
cte("order_contexts", "SELECT o_orderkey AS context_id, date_trunc('month', o_orderdate) AS context_date FROM orders")
cte("order_links", """
  SELECT l_orderkey AS context_id, l_suppkey AS entity_id, date_trunc('month', l_shipdate) AS context_date FROM lineitem""")


def order_contexts(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select(
        F.col("o_orderkey").alias("context_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("context_date")
    )


def order_links(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate").select(
        F.col("l_orderkey").alias("context_id"), F.col("l_suppkey").alias("entity_id"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("context_date"),
    )


@query(using("order_contexts", "order_links", select="""
  SELECT DISTINCT l.entity_id, l.context_id,
         CAST(datediff('day', DATE '1970-01-01', CAST(c.context_date AS DATE)) AS INTEGER) AS context_day
  FROM order_links l JOIN order_contexts c USING (context_id) WHERE l.context_date = c.context_date"""))
def link_context_agreement(spark, d):
    linked = T.agreeing_links(order_links(spark, d), order_contexts(spark, d))
    return linked.select("entity_id", "context_id", epoch_day("context_date").alias("context_day"))


@query(using("order_contexts", "order_links", select="""
  SELECT count(*) AS known_links, count(*) FILTER (l.context_date IS DISTINCT FROM c.context_date) AS rejected_date_links
  FROM order_links l JOIN order_contexts c USING (context_id)"""))
def link_date_rejections(spark, d):
    return T.link_agreement_counts(order_links(spark, d), order_contexts(spark, d))


cte("first_seen", """
  SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst,
         CAST(datediff('day', DATE '1970-01-01', CAST(min(l_shipdate) AS DATE)) AS INTEGER) AS first_day
  FROM lineitem GROUP BY ALL""")


def first_seen(spark, d):
    return table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_shipdate").groupBy(
        F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst")
    ).agg(epoch_day(F.min("l_shipdate")).alias("first_day"))


CUTOFF = 9497  # 1996-01-02

cte("eligible", f"""
  SELECT DISTINCT n AS node_id FROM (
    SELECT unnest([src, dst]) AS n FROM first_seen WHERE first_day < {CUTOFF})
  WHERE n IN (SELECT 's:' || l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-02 00:00:00')
     OR n IN (SELECT 'p:' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1996-01-02 00:00:00')""",
    "first_seen")


def eligible(spark, d):
    before = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_shipdate").filter(
        F.to_date("l_shipdate") < F.lit("1996-01-02").cast("date")
    )
    linked = before.select(F.concat(F.lit("s:"), "l_suppkey").alias("node_id")).unionByName(
        before.filter(F.col("l_returnflag") == "R").select(F.concat(F.lit("p:"), "l_partkey").alias("node_id"))
    )
    return T.eligible_nodes(T.frozen_edges(first_seen(spark, d), CUTOFF), linked)


@query(using("eligible", select="SELECT node_id FROM eligible"))
def frozen_graph_nodes(spark, d):
    return eligible(spark, d)


@query(using("eligible", select=f"""
  SELECT src, dst FROM first_seen WHERE first_day < {CUTOFF}
    AND src IN (SELECT node_id FROM eligible) AND dst IN (SELECT node_id FROM eligible)"""))
def induced_graph_edges(spark, d):
    frozen = T.frozen_edges(first_seen(spark, d), CUTOFF)
    return T.induced_edges(frozen, eligible(spark, d)).select("src", "dst")


@query(using("nodes", select="SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM nodes"))
def dense_node_index(spark, d):
    from riskgraph.catalog.base import nodes

    return dense_index(nodes(spark, d), "node_id")


@query(using("eligible", select=f"""
  SELECT a.i AS src_idx, b.i AS dst_idx FROM first_seen
  JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM eligible) a ON a.node_id = src
  JOIN (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM eligible) b ON b.node_id = dst
  WHERE first_day < {CUTOFF}"""))
def encoded_graph_edges(spark, d):
    frozen = T.frozen_edges(first_seen(spark, d), CUTOFF)
    return T.encode_edges(frozen, eligible(spark, d)).select("src_idx", "dst_idx")


@query(using("memory", select="""
  SELECT node_id, signal_id, row_number() OVER (ORDER BY node_id, signal_id) - 1 AS signal_idx
  FROM (SELECT DISTINCT node_id, signal_id FROM memory)"""))
def retrieved_signal_dictionary(spark, d):
    return T.signal_dictionary(memory(spark, d))


@query(using("sources", select="SELECT snapshot, node_id, strength, rank FROM sources"))
def source_selection(spark, d):
    return sources(spark, d).select("snapshot", "node_id", "strength", "rank")


@query(using("edges", "sources", select="""
  SELECT s.snapshot, min(s.node_id) AS node_id FROM sources s
  WHERE s.snapshot = (SELECT min(e.snapshot) FROM edges e JOIN sources x ON x.snapshot = e.snapshot
                      WHERE e.dependency > 0.9)
  GROUP BY s.snapshot"""))
def first_usable_snapshot(spark, d):
    strong = edges(spark, d).filter(F.col("dependency") > 0.9)
    src = sources(spark, d)
    return first_eligible_snapshot(src.select("snapshot").distinct(), src, strong)


@query("""
  SELECT lang, doc_id FROM (
    SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n FROM documents)
  WHERE list_contains(list_transform(range(0, least(16, n)), lambda i: CASE WHEN i = least(16, n) - 1 THEN n - 1
        ELSE CAST(floor(i * ((n - 1) / (least(16, n) - 1))) AS BIGINT) END), pos)""")
def spread_document_sample(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    return T.spread_sample(docs, ["n_chars", "doc_id"], 16, ["lang"]).select("lang", "doc_id")


# A sample for extraction: the first texts with a word of risk and as many others, spread over their order.
@query("""
  WITH told AS (SELECT doc_id, n_chars, lang, coalesce(regexp_matches(lower(text), 'the|que|und'), false) AS marked FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang, marked ORDER BY n_chars, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang, marked) AS n FROM told)
  SELECT lang, doc_id, marked FROM placed WHERE CASE WHEN marked THEN pos < 16
    ELSE list_contains(list_transform(range(0, least(16, n)), lambda i: CASE WHEN i = least(16, n) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / (least(16, n) - 1))) AS BIGINT) END), pos) END""")
def risk_and_neutral_sample(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars", "text")
    marked = F.lower("text").rlike("the|que|und")
    return T.first_and_spread(docs, marked, ["n_chars", "doc_id"], 16, ["lang"]).select("lang", "doc_id", "marked")


@query("SELECT 'Q' || user_id AS qid FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id LIMIT 25")
def numbered_id_order(spark, d):
    ids = table(spark, d, "events", "user_id").select(F.concat(F.lit("Q"), "user_id").alias("qid"))
    return T.numbered_ids(ids, "qid", 25)


@query("""
  SELECT o_orderkey AS doc_id, count(DISTINCT l_suppkey) AS n_entities,
         array_to_string(list_sort(list_distinct(list(l_suppkey || '=' || s_name))), ';') AS entities
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE year(o_orderdate) = 1997 GROUP BY o_orderkey""")
def document_entities(spark, d):
    links = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").join(
        table(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("o_orderkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("entity_id"),
             F.col("o_orderdate").alias("context_date"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("name"))
    rolled = document_rollup(links, suppliers, 1997)
    text = F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat_ws("=", e["id"], e["name"]))), ";")
    return rolled.select("doc_id", "n_entities", text.alias("entities"))
