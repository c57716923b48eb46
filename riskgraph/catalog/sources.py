"""Readers on files that Spark writes from the driver tables: strict CSV, line lineage, rows against bytes, file hashes, passports."""

import uuid

from pyspark.sql import functions as F

from riskgraph.catalog.base import cte, query, table, using
from riskgraph.catalog.facts import raw_lines
from riskgraph.plans import reporting
from riskgraph.runtime import shared_dir
from riskgraph.sources import files, recalls as R, tables

FILES = 16


def _folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _in_files(rows, key, order):
    """Rows with ``part`` 0 to FILES - 1, one file each, in order inside. Each file has a task of its own, as hashed parts would meet in some tasks."""
    return rows.withColumn("part", F.pmod(key, F.lit(FILES)).cast("int")).repartitionById(FILES, "part").sortWithinPartitions("part", *order)


@query(f"""
  SELECT CAST(doc_id % {FILES} AS INTEGER) AS part, row_number() OVER (PARTITION BY doc_id % {FILES} ORDER BY doc_id) + 1 AS csv_line, CAST(doc_id AS VARCHAR) AS "doc id",
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, sha256(trim(replace(coalesce(text, ''), chr(13), ' ') || ', "' || doc_id || '"' || chr(10) || 'end', ' ' || chr(9) || chr(10) || chr(11) || chr(12))) AS text_sha256
  FROM documents""")
def strict_csv_rows(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    text = F.concat(F.translate(F.coalesce("text", F.lit("")), "\r", " "), F.lit(', "'), "doc_id", F.lit('"\nend'))
    out = _folder(spark, "annotations")
    rows = docs.select(F.col("doc_id").alias("doc id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    # Every text holds a comma, quotes and a line break, so its field is quoted and its record spans lines.
    _in_files(rows, F.col("doc id"), ["doc id"]).write.partitionBy("part").option("header", True).option("escape", '"').option("emptyValue", "").csv(out)
    got = tables.read_strict_csv(spark, f"{out}/part=*", ["doc id", "text"])
    return got.select(F.regexp_extract("csv_file", r"part=(\d+)", 1).cast("int").alias("part"), "csv_line", "doc id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


cte("flat_lines", """
  SELECT RECORD_ID, l_orderkey, line, l_orderkey % 16 AS part, short, RCDATE, MODELTXT FROM (
    SELECT *, CAST(split_part(RECORD_ID, '-', 1) AS BIGINT) AS l_orderkey, concat_ws(chr(9), """ + ", ".join(R.FIELDS[:-1]) + f""") || CASE WHEN short THEN '' ELSE chr(9) || {R.FIELDS[-1]} END AS line
    FROM raw_rows)""", "raw_rows")
cte("flat_lineage", """
  SELECT *, row_number() OVER w AS line_number, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
    CAST(octet_length(encode(line)) + 1 AS BIGINT) AS line_bytes, sha256(line || chr(10)) AS line_sha256
  FROM flat_lines WINDOW w AS (PARTITION BY part ORDER BY line)""", "flat_lines")


def flat_file_lines(spark, d):
    """The recall lines as flat files, one for each part, read back with lineage."""
    out = _folder(spark, "flat")
    key = F.split_part("value", F.lit("-"), F.lit(1)).cast("long")
    _in_files(raw_lines(spark, d).select("value"), key, ["value"]).write.partitionBy("part").text(out)
    lines = R.read_raw_lines(spark, f"{out}/part=*")
    return lines.withColumn("file", F.regexp_extract("file", r"part=(\d+)", 1))


@query(using("flat_lineage", select="""
  SELECT CAST(part AS VARCHAR) AS file, line_number, byte_offset, line_bytes, line_sha256, line AS value FROM flat_lineage"""))
def raw_line_lineage(spark, d):
    return flat_file_lines(spark, d)


@query(using("flat_lineage", select="""
  SELECT CAST(part AS VARCHAR) AS file, CASE WHEN line_number % 13 = 2 THEN byte_offset + 1 ELSE byte_offset END AS byte_offset,
    CASE WHEN line_number % 13 = 2 THEN 'no_line_at_offset' WHEN line_number % 17 = 3 THEN 'hash_differs' ELSE 'fields_differ' END AS problem,
    CASE WHEN line_number % 13 <> 2 AND line_number % 17 <> 3 THEN CASE WHEN line_number % 11 = 4 THEN 'MODELTXT ' ELSE '' END || 'NOTES' END AS fields
  FROM flat_lineage WHERE NOT short AND RCDATE NOT IN ('', '20180230') AND RCDATE >= '19960101' AND RCDATE < '19970101'
    AND (line_number % 13 = 2 OR line_number % 17 = 3 OR line_number % 19 = 5 OR (line_number % 11 = 4 AND line_number % 19 = 5))"""))
def recall_rows_against_bytes(spark, d):
    lines = flat_file_lines(spark, d)
    stored = R.accepted_rows(R.split_fields(lines), "1996-01-01", "1996-12-31")
    n = F.col("line_number")
    bent = stored.withColumns({
        "NOTES": F.when(n % 19 == 5, "changed").otherwise(F.col("NOTES")),
        "MODELTXT": F.when((n % 19 == 5) & (n % 11 == 4), F.lit(None)).otherwise(F.col("MODELTXT")),
        "line_sha256": F.when(n % 17 == 3, F.lit("")).otherwise(F.col("line_sha256")),
        "byte_offset": F.when(n % 13 == 2, F.col("byte_offset") + 1).otherwise(F.col("byte_offset")),
    })
    return R.recheck_rows(lines, bent)


@query(using("flat_lineage", select="""
  SELECT CAST(part AS VARCHAR) AS file, line_number, byte_offset, line_sha256, CASE WHEN short THEN 28 ELSE 29 END AS field_count, CASE WHEN NOT short THEN RCDATE END AS RCDATE,
    CASE WHEN short THEN 'field_count_not_29' ELSE 'invalid_or_missing_report_received_date' END AS reason
  FROM flat_lineage WHERE short OR RCDATE IN ('', '20180230')"""))
def rejected_recall_lines(spark, d):
    rejected = R.rejected_rows(R.split_fields(flat_file_lines(spark, d)))
    return rejected.select("file", "line_number", "byte_offset", "line_sha256", "field_count", "RCDATE", "reason")


# --- delivered files -----------------------------------------------------------------------------

cte("delivered", """
  SELECT CAST(c_nationkey AS VARCHAR) AS path, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS bytes, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256
  FROM customer GROUP BY c_nationkey""")
# A record of the delivery in which some files are missing, added, changed, or listed twice.
cte("recorded", """
  SELECT path, bytes + CASE WHEN path = '3' THEN 1 ELSE 0 END AS bytes, CASE WHEN path = '4' THEN sha256('') ELSE sha256 END AS sha256 FROM delivered WHERE path <> '5'
  UNION ALL SELECT path, bytes, sha256 FROM delivered WHERE path = '7'
  UNION ALL SELECT 'n' || path, bytes, sha256 FROM delivered WHERE path IN ('1', '2')
  UNION ALL SELECT '../' || path, bytes, sha256 FROM delivered WHERE path = '6'""", "delivered")


def delivery(spark, d):
    """Names of customers as one file for each nation, written by Spark; the folder of the delivery."""
    out = _folder(spark, "delivery")
    customers = table(spark, d, "customer", "c_nationkey", "c_name")
    customers.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name").withColumnRenamed("c_nationkey", "nation").write.partitionBy("nation").text(out)
    return out


def _by_nation(hashes):
    return hashes.withColumn("path", F.regexp_extract("path", r"nation=(\d+)", 1))


@query(using("delivered", select="SELECT * FROM delivered"))
def delivered_file_hashes(spark, d):
    return _by_nation(files.file_hashes(spark, delivery(spark, d), "*.txt"))


@query(using("recorded", select="""
  SELECT 'file' AS kind, path AS name, CASE WHEN path LIKE '../%' THEN 'path_escape' WHEN path LIKE 'n%' THEN 'missing' WHEN path = '7' THEN 'listed_twice' ELSE 'changed' END AS problem
  FROM (SELECT DISTINCT path FROM recorded) WHERE path LIKE '../%' OR path LIKE 'n%' OR path IN ('3', '4', '7')
  UNION ALL SELECT 'file', path, 'unlisted' FROM delivered WHERE path = '5'
  UNION ALL SELECT 'count', c_mktsegment, 'measured ' || count(*) || ', recorded ' || (count(*) + 1) FROM customer GROUP BY c_mktsegment HAVING c_mktsegment < 'C'
  UNION ALL SELECT 'count', 'NONE', 'measured none, recorded 9'"""))
def passport_problems(spark, d):
    out = delivery(spark, d)
    f = _by_nation(files.file_hashes(spark, out, "*.txt"))
    p = F.col("path")
    manifest = (
        f.filter(p != "5").select(p, F.when(p == "3", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(p == "4", F.sha2(F.lit(b""), 256)).otherwise(F.col("sha256")).alias("sha256"))
        .unionByName(f.filter(p == "7")).unionByName(f.filter(p.isin("1", "2")).withColumn("path", F.concat(F.lit("n"), p)))
        .unionByName(f.filter(p == "6").withColumn("path", F.concat(F.lit("../"), p)))
    )
    counts = table(spark, d, "customer", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"))
    expected = counts.select("kind", F.when(F.col("kind") < "C", F.col("n") + 1).otherwise(F.col("n")).alias("n")).unionByName(spark.range(1).select(F.lit("NONE").alias("kind"), F.lit(9).cast("long").alias("n")))
    found = reporting.passport_of(f, manifest, counts, expected)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return found["file_problems"].select(F.lit("file").alias("kind"), F.col("path").alias("name"), "problem").unionByName(
        found["count_problems"].select(F.lit("count").alias("kind"), F.col("kind").alias("name"), F.concat(F.lit("measured "), shown("measured"), F.lit(", recorded "), shown("recorded")).alias("problem"))
    )
