"""Survey pipelines: yearly upserts, asset graph, sheets and disturbance reports on order data."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import cte, query, table, wide_table, using
from riskgraph.functions.dates import epoch_day
from riskgraph.operators import survey as S
from riskgraph.operators.audit import table_differences
from riskgraph.runtime import durable

# A customer is an entity of its orders, observed once per order in (year, order) order.
cte("observed", """
  SELECT 'cust:' || o_custkey AS entity_id, o_orderstatus AS entity_type, o_orderpriority AS name,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS row FROM orders""")


def observed(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").select(
        F.concat(F.lit("cust:"), "o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("entity_type"),
        F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("row"),
    )


@query(using("observed", select="""
  SELECT entity_id, arg_min(entity_type, (year, row)) AS entity_type, arg_min(name, (year, row)) AS name,
         min(year) AS first_year, max(year) AS last_year FROM observed GROUP BY entity_id"""))
def entity_upsert(spark, d):
    return S.upsert_entities(observed(spark, d), ["year", "row"])


cte("observed_relations", """
  SELECT 's:' || l_suppkey AS head, CASE WHEN l_discount < 0.09 THEN 'c:' || o_custkey END AS tail, 'delivers' AS relation_type,
         CAST(year(o_orderdate) AS INTEGER) AS year, l_orderkey * 100000 + l_partkey AS row, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS attribute
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def observed_relations(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_discount", "l_quantity").join(
        table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.concat(F.lit("s:"), "l_suppkey").alias("head"),
        F.when(F.col("l_discount") < 0.09, F.concat(F.lit("c:"), "o_custkey")).alias("tail"), F.lit("delivers").alias("relation_type"),
        F.year("o_orderdate").alias("year"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("row"),
        F.col("l_quantity").cast("int").cast("string").alias("attribute"),
    )


@query(using("observed_relations", select="""
  SELECT head, tail, relation_type, arg_min(year, (year, row)) AS first_year, max(year) AS last_year, CAST(sum(n) AS BIGINT) AS n_observed,
         array_to_string(list(year || '=' || a ORDER BY year), ';') AS attributes
  FROM (SELECT head, tail, relation_type, year, count(*) AS n, min(row) AS row, arg_max(attribute, (row, attribute)) AS a
        FROM observed_relations WHERE tail IS NOT NULL GROUP BY ALL) GROUP BY head, tail, relation_type"""))
def relation_upsert(spark, d):
    out = S.upsert_relations(
        observed_relations(spark, d).withColumn("last", F.struct("row", "attribute")), ["year", "row", "attribute"], "year", "attribute"
    )
    shown = F.transform(F.array_sort(F.map_entries("observed_attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("head", "tail", "relation_type", "first_year", "last_year", "n_observed", F.array_join(shown, ";").alias("attributes"))


# Survey tables: suppliers report as utilities, parts are plants, order lines generators, orders the ownership.
# Each table has a survey year; ids are exported as decimals and blank for some rows.
cte("survey_lines", """
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey * 1000 + l_linenumber AS row, CAST(l_suppkey AS VARCHAR) AS u,
         CAST(l_partkey AS VARCHAR) AS p, CAST(l_linenumber AS VARCHAR) AS g, l_returnflag AS e1, CASE WHEN l_discount > 0.05 THEN l_linestatus END AS e2,
         CASE WHEN l_tax < 0.04 THEN CAST(l_orderkey % 40 AS VARCHAR) END AS o, l_quantity AS pct FROM lineitem""")
cte("entity_obs", """
  SELECT DISTINCT 'eia:utility:' || u AS entity_id, 'utility_reporting_entity' AS entity_type, year FROM survey_lines
  UNION SELECT 'eia:plant:' || p, 'plant', year FROM survey_lines
  UNION SELECT 'eia:generator:' || p || ':' || g, 'generator', year FROM survey_lines
  UNION SELECT 'eia:fuel:' || e1, 'fuel_code', year FROM survey_lines
  UNION SELECT 'eia:fuel:' || e2, 'fuel_code', year FROM survey_lines WHERE e2 IS NOT NULL
  UNION SELECT 'eia:utility:' || o, 'utility_reporting_entity', year FROM survey_lines WHERE o IS NOT NULL""", "survey_lines")
cte("relation_obs", """
  SELECT 'eia:generator:' || p || ':' || g AS head, 'eia:plant:' || p AS tail, 'LocatedAtPlant' AS relation_type, year, 2 AS n FROM survey_lines WHERE o IS NOT NULL
  UNION ALL SELECT 'eia:generator:' || p || ':' || g, 'eia:plant:' || p, 'LocatedAtPlant', year, 1 FROM survey_lines WHERE o IS NULL
  UNION ALL SELECT 'eia:generator:' || p || ':' || g, 'eia:utility:' || u, 'ReportedBy', year, 1 FROM survey_lines
  UNION ALL SELECT 'eia:generator:' || p || ':' || g, 'eia:fuel:' || e1, 'UsesEnergySource', year, 1 FROM survey_lines
  UNION ALL SELECT 'eia:generator:' || p || ':' || g, 'eia:fuel:' || e2, 'UsesEnergySource', year, 1 FROM survey_lines WHERE e2 IS NOT NULL
  UNION ALL SELECT 'eia:utility:' || o, 'eia:generator:' || p || ':' || g, 'OwnsReportedGenerator', year, 1 FROM survey_lines WHERE o IS NOT NULL""",
    "survey_lines")


def survey_tables(spark, d):
    lines = wide_table(spark, d, "lineitem", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag",
                  "l_linestatus", "l_discount", "l_tax", "l_quantity")
    base = [
        F.year("l_shipdate").alias("year"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("row"),
        F.concat("l_suppkey", F.lit(".0")).alias("Utility ID"), F.concat(F.lit("Utility "), "l_suppkey").alias("Utility Name"),
        F.concat(F.lit(" "), "l_partkey").alias("Plant Code"), F.col("l_linenumber").cast("string").alias("Generator ID"),
    ]
    generator = lines.select(
        *base, F.col("l_returnflag").alias("Energy Source 1"), F.when(F.col("l_discount") > 0.05, F.col("l_linestatus")).alias("Energy Source 2")
    )
    ownership = lines.filter(F.col("l_tax") < 0.04).select(
        *base, F.concat((F.col("l_orderkey") % 40).cast("string"), F.lit(".0")).alias("Ownership ID"), F.lit("owner").alias("Owner Name"),
        F.col("l_quantity").cast("string").alias("Percent Owned"),
    )
    return {"generator": generator, "ownership": ownership}


@query(using("entity_obs", select="""
  SELECT entity_id, entity_type, min(year) AS first_year, max(year) AS last_year FROM entity_obs GROUP BY entity_id, entity_type"""))
def asset_entities(spark, d):
    entities, _ = S.asset_graph(survey_tables(spark, d))
    return entities.select("entity_id", "entity_type", "first_year", "last_year")


@query(using("relation_obs", select="""
  SELECT head, tail, relation_type, min(year) AS first_year, max(year) AS last_year, CAST(sum(n) AS BIGINT) AS n_observed
  FROM relation_obs GROUP BY head, tail, relation_type"""))
def asset_relations(spark, d):
    _, relations = S.asset_graph(survey_tables(spark, d))
    return relations.select("head", "tail", "relation_type", "first_year", "last_year", "n_observed")


# All four survey tables: suppliers are utilities of their first year, first lines describe plants, every line a generator,
# lightly taxed lines an ownership. Rows may name one utility twice, as reporter and as owner.
cte("all_lines", """
  SELECT *, CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey * 1000 + l_linenumber AS row,
         'eia:utility:' || l_suppkey AS utility, 'eia:plant:' || l_partkey AS plant, 'eia:generator:' || l_partkey || ':' || l_linenumber AS generator,
         'Utility ' || l_suppkey || ' in ' || l_returnflag AS utility_name, 'Plant ' || (l_orderkey % 9) AS plant_name,
         CASE WHEN l_discount > 0.05 THEN 'S' || l_linestatus END AS state, CASE WHEN l_tax > 0.01 THEN CAST(l_orderkey % 30 AS VARCHAR) END AS naics,
         CAST(l_orderkey % 40 AS VARCHAR) AS o FROM lineitem""")
cte("all_entities", """
  SELECT 1992 AS year, 0 AS t, CAST(s_suppkey AS BIGINT) AS row, 0 AS i, 'eia:utility:' || s_suppkey AS entity_id, 'utility_reporting_entity' AS entity_type, s_name AS name FROM supplier
  UNION ALL SELECT 1992, 0, s_suppkey, 3, 'eia:state:N' || s_nationkey, 'region_state_code', 'N' || s_nationkey FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT year, t, row, 0, utility, 'utility_reporting_entity', utility_name FROM all_rows
  UNION ALL SELECT year, t, row, 1, plant, 'plant', plant_name FROM all_rows
  UNION ALL SELECT year, t, row, 2, generator, 'generator', CAST(l_linenumber AS VARCHAR) FROM all_rows WHERE t > 1
  UNION ALL SELECT year, t, row, 3, 'eia:state:' || state, 'region_state_code', state FROM all_rows WHERE t < 3 AND state IS NOT NULL
  UNION ALL SELECT year, t, row, 4, 'eia:naics:' || naics, 'industry_naics_code', naics FROM all_rows WHERE t = 1 AND naics IS NOT NULL
  UNION ALL SELECT year, t, row, 4, 'eia:fuel:' || l_returnflag, 'fuel_code', l_returnflag FROM all_rows WHERE t = 2
  UNION ALL SELECT year, t, row, 4, 'eia:utility:' || o, 'utility_reporting_entity', 'Owner ' || l_linenumber FROM all_rows WHERE t = 3""", "all_rows")
cte("all_rows", """
  SELECT 1 AS t, * FROM all_lines WHERE l_linenumber = 1 UNION ALL SELECT 2, * FROM all_lines
  UNION ALL SELECT 3, * FROM all_lines WHERE l_tax < 0.04""", "all_lines")
cte("all_relations", """
  SELECT 1992 AS year, 0 AS t, CAST(s_suppkey AS BIGINT) AS row, 1 AS i, 'eia:utility:' || s_suppkey AS head, 'eia:state:N' || s_nationkey AS tail,
         'LocatedInState' AS relation_type, CAST(NULL AS VARCHAR) AS attribute FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT year, t, row, 0, generator, plant, 'LocatedAtPlant', NULL FROM all_rows WHERE t > 1
  UNION ALL SELECT year, t, row, 1, plant, 'eia:state:' || state, 'LocatedInState', NULL FROM all_rows WHERE t < 3 AND state IS NOT NULL
  UNION ALL SELECT year, t, row, 2, plant, utility, 'ReportedBy', NULL FROM all_rows WHERE t = 1
  UNION ALL SELECT year, t, row, 3, plant, 'eia:naics:' || naics, 'PrimaryPurposeNAICS', NULL FROM all_rows WHERE t = 1 AND naics IS NOT NULL
  UNION ALL SELECT year, t, row, 2, generator, utility, 'ReportedBy', NULL FROM all_rows WHERE t = 2
  UNION ALL SELECT year, t, row, 3, generator, 'eia:fuel:' || l_returnflag, 'UsesEnergySource', NULL FROM all_rows WHERE t = 2
  UNION ALL SELECT year, t, row, 2, 'eia:utility:' || o, generator, 'OwnsReportedGenerator', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM all_rows WHERE t = 3""",
    "all_rows")


def all_survey_tables(spark, d):
    """The four tables cut to their kept columns; footnotes go, columns a table does not have are skipped."""
    suppliers = table(spark, d, "supplier").select(
        F.lit(1992).alias("year"), F.col("s_suppkey").cast("long").alias("row"), F.col("s_suppkey").cast("string").alias("Utility ID"),
        F.col("s_name").alias("Utility Name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("N"), "s_nationkey")).alias("State"),
        F.lit("note").alias("Footnote"),
    )
    lines = wide_table(spark, d, "lineitem")
    state = F.when(F.col("l_discount") > 0.05, F.concat(F.lit("S"), "l_linestatus")).alias("State")
    base = [
        F.year("l_shipdate").alias("year"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("row"),
        F.concat("l_suppkey", F.lit(".0")).alias("Utility ID"), F.concat(F.lit("Utility "), "l_suppkey", F.lit(" in "), "l_returnflag").alias("Utility Name"),
        F.concat(F.lit(" "), "l_partkey").alias("Plant Code"), F.concat(F.lit("Plant "), (F.col("l_orderkey") % 9).cast("string")).alias("Plant Name"),
        F.lit("note").alias("Footnote"),
    ]
    generator = F.col("l_linenumber").cast("string").alias("Generator ID")
    naics = F.when(F.col("l_tax") > 0.01, F.concat((F.col("l_orderkey") % 30).cast("string"), F.lit(".0"))).alias("Primary Purpose (NAICS Code)")
    raw = {
        "utility": suppliers,
        "plant": lines.filter(F.col("l_linenumber") == 1).select(*base, state, naics),
        "generator": lines.select(*base, state, generator, F.col("l_returnflag").alias("Energy Source 1")),
        "ownership": lines.filter(F.col("l_tax") < 0.04).select(
            *base, generator, F.concat(F.lit("Owner "), "l_linenumber").alias("Owner Name"),
            (F.col("l_orderkey") % 40).cast("string").alias("Ownership ID"), F.col("l_quantity").cast("int").cast("string").alias("Percent Owned"),
        ),
    }
    return {kind: S.project_fields(rows, kind, at=["year", "row"]) for kind, rows in raw.items()}


@query(using("all_entities", select="""
  SELECT entity_id, arg_min(entity_type, (year, t, row, i)) AS entity_type, arg_min(name, (year, t, row, i)) AS name,
         min(year) AS first_year, max(year) AS last_year FROM all_entities GROUP BY entity_id"""))
def whole_asset_entities(spark, d):
    entities, _ = S.asset_graph(all_survey_tables(spark, d))
    return entities.select("entity_id", "entity_type", "name", "first_year", "last_year")


@query(using("all_relations", select="""
  SELECT head, tail, relation_type, min(year) AS first_year, max(year) AS last_year, CAST(sum(n) AS BIGINT) AS n_observed,
         coalesce(string_agg(year || '=' || a, ';' ORDER BY year), '') AS attributes
  FROM (SELECT head, tail, relation_type, year, count(*) AS n, arg_max(attribute, (t, row, i)) AS a FROM all_relations GROUP BY ALL)
  GROUP BY head, tail, relation_type"""))
def whole_asset_relations(spark, d):
    _, relations = S.asset_graph(all_survey_tables(spark, d))
    shown = F.transform(F.array_sort(F.map_entries("observed_attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return relations.select("head", "tail", "relation_type", "first_year", "last_year", "n_observed", F.array_join(shown, ";").alias("attributes"))


# The published ownership relations come from a plain aggregate with planted faults; the graph is built again and compared.
cte("ownership_relations", """
  SELECT 'eia:utility:' || (l_orderkey % 40) AS head, 'eia:generator:' || l_partkey || ':' || l_linenumber AS tail, min(year(l_shipdate)) AS first_year,
         count(*) AS n_observed, min(l_partkey) AS part FROM lineitem WHERE l_tax < 0.04 GROUP BY ALL""")


@query(using("ownership_relations", select="""
  SELECT head, tail, CAST(1 AS BIGINT) AS n_derived, CAST(CASE WHEN part % 23 = 0 THEN 0 WHEN part % 29 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_stored,
         CASE WHEN part % 23 = 0 THEN 'missing' WHEN part % 29 = 0 THEN 'repeated' ELSE 'different' END AS status
  FROM ownership_relations WHERE part % 23 = 0 OR part % 29 = 0 OR part % 31 = 0
  UNION ALL
  SELECT head || '?', tail, 0, 1, 'extra' FROM ownership_relations WHERE part % 37 = 0 AND part % 23 <> 0 AND part % 29 <> 0"""))
def rederived_ownership_relations(spark, d):
    _, relations = S.asset_graph(all_survey_tables(spark, d))
    owned = relations.filter(F.col("relation_type") == "OwnsReportedGenerator")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_shipdate").filter(F.col("l_tax") < 0.04)
    part = F.col("part")
    plain = lines.groupBy(
        F.concat(F.lit("eia:utility:"), (F.col("l_orderkey") % 40).cast("string")).alias("head"),
        F.concat(F.lit("eia:generator:"), F.concat_ws(":", "l_partkey", "l_linenumber")).alias("tail"), F.col("l_partkey").alias("part"),
    ).agg(F.min(F.year("l_shipdate")).alias("first_year"), F.count("*").alias("n_observed")).filter(part % 23 != 0)
    copies = F.explode(F.array_compact(F.array(
        F.col("head"), F.when(part % 29 == 0, F.col("head")), F.when((part % 37 == 0) & (part % 29 != 0), F.concat("head", F.lit("?")))))).alias("head")
    published = plain.select(
        "tail", "n_observed", (F.col("first_year") + F.when(part % 31 == 0, 1).otherwise(0)).alias("first_year"), copies)
    kept = ["head", "tail", "first_year", "n_observed"]
    return table_differences(durable(owned.select(*kept), "owned"), durable(published.select(*kept), "published"), kept[:2], kept[2:])


@query("""
  SELECT l_orderkey, l_linenumber, l_partkey, pos AS position, v AS value FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, unnest([trim(l_returnflag), CASE WHEN l_discount > 0.05 THEN l_linestatus END, CASE WHEN l_tax > 0.05 THEN '' ELSE 'T' END]) AS v,
           unnest(range(3)) AS pos FROM lineitem) WHERE v IS NOT NULL AND v <> ''""")
def unpivoted_columns(spark, d):
    rows = table(spark, d, "lineitem").withColumn("a", F.col("l_returnflag")).withColumn(
        "b", F.when(F.col("l_discount") > 0.05, F.col("l_linestatus"))
    ).withColumn("c", F.when(F.col("l_tax") > 0.05, "").otherwise("T"))
    out = S.unpivot_repeated(rows, ["l_orderkey", "l_linenumber", "l_partkey"], ["a", "b", "absent", "c"])
    return out.withColumn("position", F.col("position").cast("bigint"))


# Pages as sheets: row 0 is a title, the header follows in row 1 or 2, each conversation is a sheet.
cte("cells", """
  SELECT conv_id, turn + 3 AS row, role, text FROM conversations""")


def cells(spark, d):
    turns = table(spark, d, "conversations")
    body = turns.select("conv_id", (F.col("turn") + 3).cast("int").alias("row"), F.array("role", F.concat(F.lit(" "), "text"), F.lit("x")).alias("cells"))
    heads = turns.select("conv_id").distinct()
    title = heads.select("conv_id", F.lit(0).alias("row"), F.array(F.lit("Annual report")).alias("cells"))
    header = heads.select(
        "conv_id", (F.col("conv_id") % 2 + 1).cast("int").alias("row"),
        F.array(F.lit("Event Type"), F.lit(" Date Event Began"), F.lit("")).alias("cells"),
    ).withColumn("cells", F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("Event Type"), F.lit("Date"))).otherwise(
        F.array(F.lit("Event Type"), F.lit("Date Event Began"), F.lit(""))))
    return body.unionByName(title).unionByName(header)


@query(using("cells", select="""
  SELECT conv_id, CAST(row AS INTEGER) AS row, role AS event_type, sha256(trim(text, E' \\t\\n\\r')) AS began FROM cells WHERE conv_id % 3 <> 0"""))
def sheet_records(spark, d):
    out = S.sheet_records(cells(spark, d), "Date Event Began", ["conv_id"])
    return out.select("conv_id", "row", F.col("fields")["Event Type"].alias("event_type"), F.sha2(F.col("fields")["Date Event Began"], 256).alias("began"))


# Disturbance reports from events: the date text is missing, foreign or in another year for some types.
cte("reports", """
  SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'unknown' WHEN 'view' THEN '' WHEN 'click' THEN strftime(ts - INTERVAL 400 DAY, '%m/%d/%y') ELSE strftime(ts, '%m/%d/%Y') END AS began,
         CASE WHEN value > 20 THEN 'area' ELSE '' END AS area, ts FROM events""")


def reports(spark, d):
    e = table(spark, d, "events")
    began = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "view", "").when(
        F.col("event_type") == "click", F.date_format(F.date_sub(F.to_date("ts"), 400), "MM/dd/yy")
    ).otherwise(F.date_format(F.to_date("ts"), "MM/dd/yyyy"))
    fields = F.create_map(
        F.lit("Date Event Began"), began, F.lit("Event Type"), F.col("event_type"),
        F.lit("Area Affected"), F.when(F.col("value") > 20, "area").otherwise(""),
    )
    return e.select("event_id", fields.alias("fields"), F.lit(2024).alias("year"))


@query(using("reports", select="""
  SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) - 400 AS INTEGER)
         WHEN event_type NOT IN ('error', 'view') THEN CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) END AS event_day,
         CASE WHEN event_type IN ('error', 'view') THEN 'unknown_reported_start_date' ELSE 'reported_start_date' END AS date_quality
  FROM reports WHERE event_type NOT IN ('error', 'view') OR area <> ''"""))
def disturbance_events(spark, d):
    kept, _ = S.disturbance_events(reports(spark, d))
    return kept.select("event_id", epoch_day("event_date").alias("event_day"), "date_quality")


@query(using("reports", select="""
  SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'unknown_start_date' ELSE 'date_outside_file_year' END AS reason
  FROM reports WHERE (event_type IN ('error', 'view') AND area <> '') OR event_type = 'click'"""))
def disturbance_warnings(spark, d):
    _, warnings = S.disturbance_events(reports(spark, d))
    return warnings.select("event_id", "reason")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND value > 20")
def survey_rows_without_key(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", " ").otherwise("7").alias("Utility ID"),
        F.when(F.col("value") > 20, "x").otherwise("").alias("State"),
    )
    return S.rows_without_key(rows.select("Utility ID", "State", F.when(F.col("State") != "", F.col("event_id")).alias("event_id")), "Utility ID").select("event_id")


@query("""
  SELECT o_orderkey, 'status' AS field, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS projected, o_orderstatus AS raw
  FROM orders WHERE o_orderkey % 5 = 0""")
def source_cell_differences(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    projected = o.select("o_orderkey", F.create_map(
        F.lit("status"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")),
        F.lit("priority"), F.col("o_orderpriority")).alias("fields"))
    raw = o.select("o_orderkey", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"),
                                              F.lit("other"), F.lit("y")).alias("fields"))
    return S.cell_differences(projected, raw, ["o_orderkey"])
