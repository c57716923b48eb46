"""Knowledge-base statements built from customers, orders and events."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import cte, query, table, using
from riskgraph.operators import knowledge as K
from riskgraph.operators.graph import spread_one_hop
from riskgraph.operators.ordering import chunked_lists, ordered_position

# A customer has a country, its open orders as deprecated parts and its finished orders as products; one
# value of each kind is a plain string.
cte("statements", """
  SELECT 'Q' || c_custkey AS subject_qid, 'P17' AS property_id, 0 AS seq, 'Q9' || c_nationkey AS object_qid, 'g' || c_custkey AS statement_id, 'normal' AS rank FROM customer
  UNION ALL
  SELECT 'Q' || o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'P999' ELSE 'P1056' END, 0,
         CASE WHEN o_orderpriority <> '5-LOW' THEN 'Q8' || (o_orderkey % 700) END, 'o' || o_orderkey,
         CASE WHEN o_orderstatus = 'O' THEN 'deprecated' ELSE 'normal' END FROM orders""")


def statement_json(snaktype, target, statement_id, rank):
    item = F.concat(F.lit('{"entity-type":"item","id":"'), target, F.lit('"}'))
    value = F.when(target.isNotNull(), item).otherwise(F.lit('"text"'))
    return F.concat(
        F.lit('{"id":"'), statement_id, F.lit('","rank":"'), rank, F.lit('","mainsnak":{"snaktype":"'), snaktype,
        F.lit('","datavalue":{"value":'), value, F.lit("}}}"),
    )


def kb_entities(spark, d):
    """Entity records ``(qid, claims MAP<property, ARRAY<statement JSON>>)`` with one property each."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    country = c.select(
        F.concat(F.lit("Q"), "c_custkey").alias("qid"),
        F.create_map(F.lit("P17"), F.array(statement_json(
            F.lit("value"), F.concat(F.lit("Q9"), "c_nationkey"), F.concat(F.lit("g"), "c_custkey"), F.lit("normal")))).alias("claims"),
    )
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    target = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("Q8"), (F.col("o_orderkey") % 700).cast("string")))
    products = o.select(
        F.concat(F.lit("Q"), "o_custkey").alias("qid"),
        F.create_map(
            F.when(F.col("o_orderstatus") == "P", "P999").otherwise("P1056"),
            F.array(statement_json(F.lit("value"), target, F.concat(F.lit("o"), "o_orderkey"),
                                   F.when(F.col("o_orderstatus") == "O", "deprecated").otherwise("normal"))),
        ).alias("claims"),
    )
    return country.unionByName(products)


def statements(spark, d):
    return K.flatten_statements(kb_entities(spark, d))


def kept(spark, d):
    return K.relation_statements(statements(spark, d), K.property_names(spark))


@query(using("statements", select="SELECT subject_qid, property_id, seq, object_qid, statement_id, rank FROM statements"))
def flattened_statements(spark, d):
    return statements(spark, d).drop("statement")


cte("kept", """
  SELECT *, CASE property_id WHEN 'P17' THEN 'country' ELSE 'product_or_material_produced' END AS predicate FROM statements
  WHERE rank <> 'deprecated' AND object_qid IS NOT NULL AND property_id IN ('P17', 'P1056')""", "statements")


@query(using("kept", select="SELECT subject_qid, property_id, predicate, object_qid, statement_id FROM kept"))
def kept_relation_statements(spark, d):
    return kept(spark, d).select("subject_qid", "property_id", "predicate", "object_qid", "statement_id")


cte("facts", """
  SELECT subject_qid, property_id, object_qid, count(*) AS n_statements, min(statement_id) AS first_statement_id FROM kept GROUP BY ALL""", "kept")


@query(using("facts", select="SELECT * FROM facts"))
def unique_facts(spark, d):
    return K.unique_facts(kept(spark, d))


@query(using("kept", select="""
  SELECT subject_qid, property_id, object_qid, CAST(floor((pos - 1) / 1000) AS INTEGER) AS chunk, array_to_string(list(statement_id ORDER BY pos), ',') AS statement_ids
  FROM (SELECT *, row_number() OVER (PARTITION BY subject_qid, property_id, object_qid ORDER BY statement_id) AS pos FROM kept)
  GROUP BY subject_qid, property_id, object_qid, chunk"""))
def statements_of_facts(spark, d):
    """All statements that support each fact, nested in order."""
    keys = ["subject_qid", "property_id", "object_qid"]
    nested = chunked_lists(kept(spark, d).select(*keys, "statement_id"), keys, ["statement_id"], "statement_id", "statement_ids", 1000)
    return nested.select(*keys, "chunk", F.array_join("statement_ids", ",").alias("statement_ids"))


cte("collected", """
  SELECT 'Q' || c_custkey AS qid, c_mktsegment AS kind FROM customer
  UNION ALL SELECT 'Q9' || n_nationkey, 'region' FROM nation WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT DISTINCT 'Q8' || (o_orderkey % 700), 'product' FROM orders WHERE o_orderkey % 700 < 500""")


def collected(spark, d):
    q = lambda p, c: F.concat(F.lit(p), c).alias("qid")
    customers = table(spark, d, "customer").select(q("Q", "c_custkey"), F.col("c_mktsegment").alias("kind"))
    nations = table(spark, d, "nation").filter(F.col("n_nationkey") % 4 != 0).select(q("Q9", "n_nationkey"), F.lit("region").alias("kind"))
    products = table(spark, d, "orders", "o_orderkey").select((F.col("o_orderkey") % 700).alias("k")).filter("k < 500").distinct().select(
        q("Q8", "k"), F.lit("product").alias("kind"))
    return customers.unionByName(nations).unionByName(products)


@query(using("kept", "collected", select="""
  SELECT subject_qid, property_id, object_qid, statement_id, object_qid IN (SELECT qid FROM collected) AS target_record_collected FROM kept"""))
def resolved_targets(spark, d):
    out = K.resolved_flag(kept(spark, d), collected(spark, d).select("qid").distinct())
    return out.select("subject_qid", "property_id", "object_qid", "statement_id", "target_record_collected")


@query(using("facts", "collected", select="""
  SELECT object_qid, count(*) AS n_facts FROM facts WHERE object_qid NOT IN (SELECT qid FROM collected) GROUP BY object_qid"""))
def uncollected_targets(spark, d):
    return K.uncollected_targets(K.resolved_flag(K.unique_facts(kept(spark, d)), collected(spark, d).select("qid").distinct()))


cte("banned", "SELECT qid FROM collected WHERE kind = 'MACHINERY'", "collected")


@query(using("facts", "banned", select="""
  SELECT subject_qid, property_id, object_qid, CASE
    WHEN subject_qid IN (SELECT qid FROM banned) OR object_qid IN (SELECT qid FROM banned) THEN 'excluded'
    WHEN object_qid IN (SELECT qid FROM collected) THEN 'closed' ELSE 'unresolved' END AS part FROM facts"""))
def closed_fact_partition(spark, d):
    nodes = collected(spark, d)
    banned = nodes.filter(F.col("kind") == "MACHINERY")
    tagged = K.tagged_facts(K.unique_facts(kept(spark, d)), nodes, banned)
    return tagged.select("subject_qid", "property_id", "object_qid", "part")


@query("""
  SELECT d.domain, t.entity_type, count(c.c_custkey) AS n
  FROM (SELECT unnest(['Auto', 'Semi', 'Energy']) AS domain) d
  CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY', 'absent']) AS entity_type) t
  LEFT JOIN customer c ON c.c_mktsegment = t.entity_type
    AND ((d.domain = 'Auto' AND c.c_nationkey % 2 = 0) OR (d.domain = 'Semi' AND c.c_nationkey % 3 = 0) OR (d.domain = 'Energy' AND c.c_nationkey > 20))
  GROUP BY ALL""")
def domain_type_counts(spark, d):
    n = F.col("c_nationkey")
    domains = F.array_compact(F.array(F.when(n % 2 == 0, "Auto"), F.when(n % 3 == 0, "Semi"), F.when(n > 20, "Energy")))
    nodes = table(spark, d, "customer").select(domains.alias("domain_candidates"), F.col("c_mktsegment").alias("entity_type"))
    return K.domain_type_counts(nodes, ["Auto", "Semi", "Energy"], ["AUTOMOBILE", "BUILDING", "MACHINERY", "absent"])


@query(using("kept", "collected", select="""
  SELECT qid, 'domain' AS attribute, kind AS value FROM collected
  UNION SELECT k.object_qid, 'domain', c.kind FROM kept k JOIN collected c ON c.qid = k.subject_qid
  UNION SELECT object_qid, 'role', CASE property_id WHEN 'P17' THEN 'geographic_object' ELSE 'product_or_material' END FROM kept"""))
def one_hop_domains_and_roles(spark, d):
    domains = collected(spark, d).select("qid", F.col("kind").alias("domain"))
    return spread_one_hop(kept(spark, d), domains, K.object_roles(spark))


@query(using("collected", select="SELECT qid, CAST(NULL AS INTEGER) AS label, -1 AS label_code, 'unknown_no_observed_risk_outcome' AS status FROM collected"))
def unknown_outcome_rows(spark, d):
    return K.unknown_outcomes(collected(spark, d))


@query("""
  SELECT DISTINCT 'Q' || user_id AS qid, event_type AS domain FROM events WHERE value > 5""")
def selector_candidates(spark, d):
    uri = F.struct(F.concat(F.lit("http://example.org/entity/Q"), "user_id").alias("value"))
    name = F.when(F.col("value") > 5, "item").otherwise("other")
    results = table(spark, d, "events").select(F.col("event_type").alias("domain"), F.array(F.create_map(name, uri)).alias("bindings"))
    return K.selector_candidates(results)


cte("registry", """
  SELECT l_suppkey AS id, l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS position,
         l_returnflag AS name, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE 'C' || l_partkey END AS country, l_quantity AS q FROM lineitem""")


def registry(spark, d):
    from pyspark.sql import Window as W

    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    position = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    kinds = F.array(F.struct(F.lit("car").alias("name"), (F.col("l_quantity") > 25).alias("is_primary")),
                    F.struct(F.lit("truck").alias("name"), F.lit(False).alias("is_primary")))
    items = lines.select(
        F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("page"), position.alias("position"), F.col("l_returnflag").alias("name"),
        F.when(F.col("l_linestatus") == "O", " ").otherwise(F.concat(F.lit("C"), "l_partkey")).alias("country"), kinds.alias("vehicle_types"))
    return K.registry_relations(items)


cte("registry_first", "SELECT * FROM registry QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, position) = 1", "registry")


@query(using("registry_first", select="""
  SELECT id, 'registered_country' AS relation, country AS target, CAST(NULL AS INTEGER) AS is_primary FROM registry_first WHERE trim(country) <> ''
  UNION ALL SELECT id, 'makes_vehicle_type', 'car', CAST(q > 25 AS INTEGER) FROM registry_first
  UNION ALL SELECT id, 'makes_vehicle_type', 'truck', 0 FROM registry_first"""))
def registry_relations(spark, d):
    return registry(spark, d)[2].withColumn("is_primary", F.col("is_primary").cast("int"))


@query(using("registry", select="SELECT id, count(*) AS n_seen FROM registry GROUP BY id HAVING count(*) > 1"))
def registry_repeated_ids(spark, d):
    return registry(spark, d)[1]


cte("steps", """
  SELECT 'S' || l_suppkey AS classified_qid, l_returnflag AS supported_type, CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag
         ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS step, 'Q' || (l_partkey % 5) AS subject_qid, 'Q' || (l_orderkey % 5) AS object_qid FROM lineitem""")


@query(using("steps", select="""
  SELECT classified_qid, supported_type, step, subject_qid, object_qid FROM (
    SELECT *, lag(object_qid) OVER (PARTITION BY classified_qid, supported_type ORDER BY step) AS p FROM steps)
  WHERE step > 0 AND p <> subject_qid"""))
def proof_gaps(spark, d):
    lines = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    placed = ordered_position(lines, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_suppkey", "l_returnflag"], "step")
    steps = placed.select(
        F.concat(F.lit("S"), "l_suppkey").alias("classified_qid"), F.col("l_returnflag").alias("supported_type"),
        F.col("step").cast("int").alias("step"), F.concat(F.lit("Q"), F.col("l_partkey") % 5).alias("subject_qid"),
        F.concat(F.lit("Q"), F.col("l_orderkey") % 5).alias("object_qid"))
    return K.proof_gaps(steps)
