"""Recall pipeline on order lines: a line is a recall row, an order a campaign, its parts the products."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import cte, query, table, wide_table, using
from riskgraph.functions import dates as D
from riskgraph.functions import keys as K
from riskgraph.operators import facts as X
from riskgraph.operators.audit import table_differences
from riskgraph.operators.ordering import chunked_lists
from riskgraph.runtime import durable
from riskgraph.sources import recalls as R

# Raw tab-separated lines built from the order lines. Open lines lose a field, some dates are unusable,
# and part names of one kind carry a windows-1252 quotation mark.
_SQL_FIELDS = {
    "RECORD_ID": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "CAMPNO": "' ' || l_orderkey",
    "MAKETXT": "p_brand", "MODELTXT": "p_name", "YEARTXT": "CASE WHEN p_size = 50 THEN '9999' ELSE CAST(1970 + p_size AS VARCHAR) END",
    "COMPNAME": "p_type", "MFGNAME": "s_name", "MFGTXT": "'N' || s_nationkey", "RCLTYPECD": "substr('VETCX', p_size % 5 + 1, 1)",
    "RCDATE": "CASE WHEN l_partkey % 11 = 0 THEN '20180230' WHEN l_partkey % 13 = 0 THEN '' ELSE strftime(l_shipdate, '%Y%m%d') END",
    "DESC_DEFECT": "l_returnflag", "CONEQUENCE_DEFECT": "CASE WHEN l_linestatus = 'O' THEN '' ELSE 'c' END",
    "CORRECTIVE_ACTION": "l_linestatus", "POTAFF": "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)",
}
cte("raw_rows", f"""
  SELECT {", ".join(f"{_SQL_FIELDS.get(f, chr(39) * 2)} AS {f}" for f in R.FIELDS)},
         l_linestatus = 'O' AND l_quantity > 45 AS short
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
cte("recalls", """
  SELECT *, strptime(RCDATE, '%Y%m%d')::DATE AS received, trim(CAMPNO) AS campaign_id FROM raw_rows
  WHERE NOT short AND RCDATE NOT IN ('', '20180230')
    AND strptime(CASE WHEN RCDATE IN ('', '20180230') THEN '19000101' ELSE RCDATE END, '%Y%m%d') BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "raw_rows")


def raw_lines(spark, d):
    lines = wide_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    lines = lines.withColumn("l_shipdate", F.to_date("l_shipdate"))  # the day moves to the part, not the time
    part, supp = table(spark, d, "part"), table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    from riskgraph.operators.joins import lookup_join

    rows = lookup_join(lookup_join(lines, part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"]),
                       supp.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"])
    code = F.substring(F.lit("VETCX"), F.col("p_size") % 5 + 1, F.lit(1))
    values = {
        "RECORD_ID": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "CAMPNO": F.concat(F.lit(" "), "l_orderkey"), "MAKETXT": F.col("p_brand"), "MODELTXT": F.col("p_name"),
        "YEARTXT": F.when(F.col("p_size") == 50, "9999").otherwise((F.col("p_size") + 1970).cast("string")),
        "COMPNAME": F.col("p_type"), "MFGNAME": F.col("s_name"), "MFGTXT": F.concat(F.lit("N"), "s_nationkey"), "RCLTYPECD": code,
        "RCDATE": F.when(F.col("l_partkey") % 11 == 0, "20180230").when(F.col("l_partkey") % 13 == 0, "")
                   .otherwise(F.date_format("l_shipdate", "yyyyMMdd")),
        "DESC_DEFECT": F.col("l_returnflag"), "CONEQUENCE_DEFECT": F.when(F.col("l_linestatus") == "O", "").otherwise("c"),
        "CORRECTIVE_ACTION": F.col("l_linestatus"), "POTAFF": F.col("l_quantity").cast("int").cast("string"),
    }
    full = [values.get(f, F.lit("")) for f in R.FIELDS]
    short = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)
    return rows.select(F.concat_ws("\t", *full[:-1], F.when(~short, full[-1])).alias("value"))


def recalls(spark, d):
    accepted = R.accepted_rows(R.split_fields(raw_lines(spark, d)), "1996-01-01", "2000-12-31")
    return R.recall_rows(accepted)


ORDER = ["raw_record_id", "POTAFF", "RCDATE", "DESC_DEFECT", "CORRECTIVE_ACTION"]


@query(using("recalls", select="""
  SELECT RECORD_ID AS record_id, campaign_id, CAST(datediff('day', DATE '1970-01-01', received) AS INTEGER) AS received_day, RCLTYPECD AS recall_type_code,
         CASE RCLTYPECD WHEN 'V' THEN 'vehicle' WHEN 'E' THEN 'equipment' WHEN 'T' THEN 'tire' WHEN 'C' THEN 'child_restraint' ELSE 'unknown_code' END AS recall_type,
         CASE WHEN YEARTXT <> '9999' THEN CAST(YEARTXT AS BIGINT) END AS model_year, MODELTXT AS model FROM recalls"""))
def recall_rows(spark, d):
    return recalls(spark, d).select(
        "record_id", "campaign_id", D.epoch_day("report_received_date").alias("received_day"), "recall_type_code", "recall_type",
        "model_year", "model",
    )


@query("""
  SELECT doc_id, length(text) AS n_chars, md5(text) AS decoded_md5, CASE WHEN length(text) <> strlen(text)
    AND length(regexp_replace(text, '[\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]', '', 'g')) = 0 THEN 'cp1252' ELSE 'utf-8' END AS encoding
  FROM documents WHERE text IS NOT NULL""".replace("\\\\x", "\\x"))
def decoded_line_encodings(spark, d):
    """Every text, stored as latin-1 bytes where these hold it and as UTF-8 elsewhere, is recognised and decoded back."""
    latin = r"^[\x00-\x7F -ÿ]*$"
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    stored = F.when(F.col("text").rlike("(?s)" + latin), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    text, encoding = R.decode_bytes("raw")
    return docs.select("doc_id", stored.alias("raw")).select("doc_id", text.alias("t"), encoding.alias("encoding")).select(
        "doc_id", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("decoded_md5"), "encoding"
    )


@query(using("recalls", select=f"""
  SELECT campaign_id, arg_min(MFGNAME, k) AS manufacturer, arg_min(COMPNAME, k) AS component, arg_min(RCLTYPECD, k) AS recall_type_code, count(*) AS n_rows
  FROM (SELECT *, (RECORD_ID, {", ".join(ORDER[1:])}) AS k FROM recalls) GROUP BY campaign_id"""))
def canonical_recall_events(spark, d):
    return X.canonical_rows(recalls(spark, d), ["campaign_id"], ORDER, ["manufacturer", "component", "recall_type_code"])


_VARIANTS = " UNION ALL ".join(f"SELECT campaign_id, '{f}' AS field, {f} AS value FROM recalls" for f in X.VARIANT_FIELDS)


@query(using("recalls", select=f"""
  SELECT campaign_id, field, value, count(*) OVER (PARTITION BY campaign_id, field) AS n_values
  FROM (SELECT DISTINCT * FROM ({_VARIANTS})) QUALIFY n_values > 1"""))
def recall_field_variants(spark, d):
    return X.field_variants(recalls(spark, d), ["campaign_id"]).select("campaign_id", "field", "value", "n_values")


cte("parts", """
  SELECT RECORD_ID AS record_id, campaign_id, 'nhtsa_recall:' || campaign_id AS event,
         'nhtsa_recall_mfr:' || sha256(MFGNAME)[1:24] AS reporter, 'nhtsa_listed_manufacturer:' || sha256(MFGTXT)[1:24] AS listed,
         'nhtsa_product:' || sha256('["' || concat_ws('", "', RCLTYPECD, MAKETXT, MODELTXT, YEARTXT) || '"]')[1:24] AS product,
         'nhtsa_component_descriptor:' || sha256(COMPNAME)[1:24] AS component_id, MFGNAME, MFGTXT, COMPNAME,
         concat_ws('/', MAKETXT, MODELTXT, YEARTXT) AS product_name, RECORD_ID || ' ' || POTAFF AS first_record FROM recalls""", "recalls")


def parts(spark, d):
    """Recall rows with node ids; ``first_record`` locates the row and orders the rows of a node or an edge."""
    located = recalls(spark, d).withColumn("first_record", F.concat_ws(" ", "record_id", "POTAFF"))
    return X.fact_parts(located, order=["first_record"])


@query(using("parts", select="""
  SELECT product, count(*) AS n_records, count(DISTINCT campaign_id) AS n_members, min(first_record) AS first_record FROM parts GROUP BY product"""))
def recall_products(spark, d):
    return X.rollup_support(parts(spark, d), ["product"], ["first_record"], ["first_record"], "campaign_id")


@query(using("parts", select="""
  SELECT reporter, count(*) AS n_records, count(DISTINCT campaign_id) AS n_members, min(first_record) AS first_record FROM parts GROUP BY reporter"""))
def recall_manufacturers(spark, d):
    return X.rollup_support(parts(spark, d), ["reporter"], ["first_record"], ["first_record"], "campaign_id")


@query(using("parts", select="""
  SELECT event, CAST(floor((pos - 1) / 1000) AS INTEGER) AS chunk, array_to_string(list(product ORDER BY pos), ',') AS products
  FROM (SELECT event, product, row_number() OVER (PARTITION BY event ORDER BY first_seen, product) AS pos
        FROM (SELECT event, product, min(first_record) AS first_seen FROM parts GROUP BY event, product))
  GROUP BY event, chunk"""))
def products_of_events(spark, d):
    """Products of each recall in the order of their first record."""
    pairs = X.distinct_in_order(parts(spark, d), ["event"], "product", ["first_record"])
    nested = chunked_lists(pairs, ["event"], ["first_seen", "product"], "product", "products", 1000)
    return nested.select("event", "chunk", F.array_join("products", ",").alias("products"))


def _support(key):
    return using("parts", select=f"""
  SELECT {key}, CAST(floor((pos - 1) / 1000) AS INTEGER) AS chunk, array_to_string(list(first_record ORDER BY pos), ',') AS records
  FROM (SELECT {key}, first_record, row_number() OVER (PARTITION BY {key} ORDER BY first_record) AS pos FROM parts)
  GROUP BY {key}, chunk""")


def support_of(spark, d, key):
    nested = chunked_lists(parts(spark, d).select(key, "first_record"), [key], ["first_record"], "first_record", "records", 1000)
    return nested.select(key, "chunk", F.array_join("records", ",").alias("records"))


@query(_support("event"))
def records_of_events(spark, d):
    """All supporting records of each recall, nested in order."""
    return support_of(spark, d, "event")


@query(_support("product"))
def records_of_products(spark, d):
    return support_of(spark, d, "product")


@query(_support("reporter"))
def records_of_manufacturers(spark, d):
    return support_of(spark, d, "reporter")


@query(using("parts", select="""
  SELECT campaign_id, product, min(first_record) AS first_record, arg_min(reporter, first_record) AS reporter, arg_min(listed, first_record) AS listed,
         arg_min(component_id, first_record) AS component_id FROM parts GROUP BY campaign_id, product"""))
def first_product_evidence(spark, d):
    return X.first_evidence(parts(spark, d), ["campaign_id", "product"], ["first_record"], ["first_record", "reporter", "listed", "component_id"])


cte("fact_nodes", """
  SELECT node_id, node_type, min(name) AS name, count(*) AS n_rows, min(first_record) AS first_record FROM (
    SELECT reporter AS node_id, 'recall_reporting_manufacturer' AS node_type, MFGNAME AS name, first_record FROM parts
    UNION ALL SELECT listed, 'listed_recalled_product_manufacturer', MFGTXT, first_record FROM parts
    UNION ALL SELECT event, 'official_recall_campaign', campaign_id, first_record FROM parts
    UNION ALL SELECT product, 'recalled_make_model_year_product', product_name, first_record FROM parts
    UNION ALL SELECT component_id, 'official_component_descriptor', COMPNAME, first_record FROM parts) GROUP BY node_id, node_type""", "parts")


@query(using("fact_nodes", select="SELECT * FROM fact_nodes"))
def fact_graph_nodes(spark, d):
    return X.fact_nodes(parts(spark, d), ["first_record"], ["first_record"])


cte("fact_edges", """
  SELECT source, relation, target, count(*) AS n_records, count(DISTINCT campaign_id) AS n_members, min(first_record) AS first_record FROM (
    SELECT reporter AS source, 'filed_official_recall' AS relation, event AS target, campaign_id, first_record FROM parts
    UNION ALL SELECT event, 'recalls_listed_product', product, campaign_id, first_record FROM parts
    UNION ALL SELECT event, 'identifies_component_descriptor', component_id, campaign_id, first_record FROM parts
    UNION ALL SELECT listed, 'listed_manufacturer_for_recalled_product', product, campaign_id, first_record FROM parts)
  GROUP BY ALL""", "parts")


def edge_support(spark, d):
    """Supporting records of all edges; the rows they fan out from are written once, as they are read more than once.

    Written are values that no other gives: the reader spells out the event of a campaign and the locator of a record.
    """
    ends = ["reporter", "listed", "product", "component_id"]
    rows = X.fact_parts(recalls(spark, d), order=["POTAFF"])
    written = durable(rows.select("record_id", "campaign_id", "POTAFF", *ends), "parts")
    kept = written.select(
        "record_id", "campaign_id", F.concat_ws(" ", "record_id", "POTAFF").alias("first_record"),
        F.concat(F.lit(X.EVENT_PREFIX + ":"), "campaign_id").alias("event"), *ends,
    )
    return X.fact_edge_support(kept, ["first_record"])


def fact_edges(spark, d):
    return X.fact_edges(X.fact_edge_support(parts(spark, d), ["first_record"]), ["first_record"])


@query(using("fact_edges", select="SELECT * FROM fact_edges"))
def fact_graph_edges(spark, d):
    return fact_edges(spark, d)


@query(using("fact_edges", select="""
  SELECT source, relation, target, CASE WHEN n_members > 3 THEN 'missing' ELSE 'different' END AS status
  FROM fact_edges WHERE n_members > 3 OR n_records > n_members"""))
def reverified_fact_edges(spark, d):
    """Edges published with campaign counts instead of record counts, widely supported ones left out."""
    support = edge_support(spark, d)
    published = X.fact_edges(support, ["first_record"]).filter(F.col("n_members") <= 3).withColumn("n_records", F.col("n_members"))
    return X.reverify_edges(support, published)


# The endpoints each record gives, with the products of some records exchanged in the published support.
@query(using("parts", select="""
  SELECT first_record, relation, count(*) AS n_derived, count(*) AS n_stored, 'different' AS status FROM (
    SELECT first_record, 'recalls_listed_product' AS relation, product AS moved FROM parts WHERE event IS NOT NULL AND product IS NOT NULL
    UNION ALL SELECT first_record, 'listed_manufacturer_for_recalled_product', product FROM parts WHERE listed IS NOT NULL AND product IS NOT NULL)
  GROUP BY first_record, relation HAVING bool_or(ends_with(moved, '7'))"""))
def rederived_record_endpoints(spark, d):
    support = edge_support(spark, d)
    moved = F.col("relation").isin("recalls_listed_product", "listed_manufacturer_for_recalled_product") & F.col("target").endswith("7")
    published = support.withColumn("target", F.when(moved, F.concat("target", F.lit("?"))).otherwise(F.col("target")))
    return table_differences(support, published, ["first_record", "relation"], ["source", "target"], together=["first_record"])


@query("""
  SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def category_distribution(spark, d):
    return X.category_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], totals=True)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def distinct_members_per_year(spark, d):
    return X.distinct_per_year(table(spark, d, "orders"), "o_orderdate", "o_custkey")


@query(using("recalls", select=" UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (trim({f}) = '') AS n_missing FROM recalls" for f in ("CAMPNO", "CONEQUENCE_DEFECT", "NOTES", "MODELTXT"))))
def missing_field_counts(spark, d):
    return X.missing_counts(recalls(spark, d), ["CAMPNO", "CONEQUENCE_DEFECT", "NOTES", "MODELTXT"])


@query("""
  SELECT o_orderkey, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS long_day,
         CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS short_day,
         CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS iso_day,
         CASE WHEN o_orderkey % 2 = 0 THEN CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) END AS parsed_day,
         strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def date_formats(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, iso).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return o.select(
        "o_orderkey",
        D.epoch_day(D.parse_mixed(F.date_format("o_orderdate", "MM/dd/yyyy"))).alias("long_day"),
        D.epoch_day(D.parse_mixed(F.date_format("o_orderdate", "M/d/yy"))).alias("short_day"),
        D.epoch_day(D.parse_iso_prefix(F.concat(iso, F.lit("T10:00")))).alias("iso_day"),
        D.parse_day(mixed).alias("parsed_day"), D.day_to_iso(D.epoch_day("o_orderdate")).alias("iso"),
    )


@query("""
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS canonical, 'c:' || c_custkey || ':' || c_nationkey AS composite,
         'x:' || sha256(c_name)[1:24] AS surrogate,
         sha256('{"key":' || c_custkey || ',"name":"' || c_name || '"}') AS object_hash,
         CASE WHEN c_nationkey <> 9 THEN c_nationkey::BIGINT END AS nation FROM customer""")
def derived_identifiers(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    return c.select(
        "c_custkey", K.canonical_key(F.concat(F.lit(" "), "c_custkey", F.lit(".0 ")), numeric=True).alias("canonical"),
        K.prefixed("c", "c_custkey", "c_nationkey").alias("composite"), K.surrogate("x", "c_name").alias("surrogate"),
        K.canonical_hash({"name": "c_name", "key": "c_custkey"}).alias("object_hash"),
        K.sentinel_to_null(F.col("c_nationkey").cast("string"), "9").alias("nation"),
    )
