"""Tab-separated recall flat files: raw bytes to evidence-carrying rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgraph.functions.dates import parse_compact
from riskgraph.functions.keys import clean, decode_label, sentinel_to_null
from riskgraph.sources.splits import lines_with_lineage

# Field names of the flat file in file order, and the recall type codes.
FIELDS = [
    "RECORD_ID", "CAMPNO", "MAKETXT", "MODELTXT", "YEARTXT", "MFGCAMPNO", "COMPNAME", "MFGNAME", "BGMAN", "ENDMAN",
    "RCLTYPECD", "POTAFF", "ODATE", "INFLUENCED_BY", "MFGTXT", "RCDATE", "DATEA", "RPNO", "FMVSS", "DESC_DEFECT",
    "CONEQUENCE_DEFECT", "CORRECTIVE_ACTION", "NOTES", "RCL_CMPT_ID", "MFR_COMP_NAME", "MFR_COMP_DESC",
    "MFR_COMP_PTNO", "DO_NOT_DRIVE", "PARK_OUTSIDE",
]
TYPE_LABELS = {"V": "vehicle", "E": "equipment", "T": "tire", "C": "child_restraint"}

# Windows-1252 characters at the latin-1 control positions, and its five unassigned bytes.
CP1252_CODES = "\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e" \
    "\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f"
CP1252_TEXT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNASSIGNED = "[\u0081\u008d\u008f\u0090\u009d]"


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with ``line_number`` (from 1), ``byte_offset``, ``line_bytes`` and the hash of the raw bytes.

    Bytes are kept as they are, including a carriage return and invalid UTF-8; a file of any size is read in parallel.
    """
    return lines_with_lineage(spark, path)


def decode_bytes(raw: str | Column) -> tuple[Column, Column]:
    """Text and encoding name of raw bytes: UTF-8, else windows-1252, else latin-1."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    utf8 = F.is_valid_utf8(raw.cast("string"))
    assigned = ~latin.rlike(CP1252_UNASSIGNED)
    text = (
        F.when(utf8, raw.cast("string"))
        .when(assigned, F.translate(latin, CP1252_CODES, CP1252_TEXT))
        .otherwise(latin)
    )
    return text, F.when(utf8, "utf-8").when(assigned, "cp1252").otherwise("iso8859-1")


def split_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """Decode each line, split it on tabs and parse its received date.

    ``fields`` may have any length; ``received`` is NULL unless the line has 29 fields and a valid
    date. Both are produced through a one-row generator: a filter on them is then applied to the
    produced values instead of being pushed down as another copy of the decoding and splitting.
    """
    carried = [c for c in lines.columns if c != value]
    text, encoding = decode_bytes(value)
    split = lines.select(
        *carried,
        F.inline(F.array(F.struct(
            encoding.alias("encoding"), F.split(F.rtrim(text, F.lit("\r\n")), "\t", -1).alias("fields")
        ))),
    )
    date_text = F.get("fields", F.lit(FIELDS.index("RCDATE")))
    return split.select("*", F.inline(F.array(F.struct(
        F.when(F.size("fields") == len(FIELDS), parse_compact(date_text)).alias("received")
    ))))


def accepted_rows(split: DataFrame, first: str = "2018-01-01", last: str = "2025-12-31") -> DataFrame:
    """Well-formed rows received in ``[first, last]``, one column per field plus the received date."""
    carried = [c for c in split.columns if c != "fields"]
    return split.filter(
        F.col("received").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ).select(*carried, *[F.col("fields")[i].alias(n) for i, n in enumerate(FIELDS)])


def rejected_rows(split: DataFrame) -> DataFrame:
    """Rows with a wrong field count or an unusable received date, with the reason."""
    carried = [c for c in split.columns if c not in ("fields", "received")]
    n = F.size("fields")
    date_text = F.get("fields", F.lit(FIELDS.index("RCDATE")))
    return split.filter(F.col("received").isNull()).select(
        *carried, n.alias("field_count"), F.when(n == len(FIELDS), date_text).alias("RCDATE"),
        F.when(n != len(FIELDS), "field_count_not_29").otherwise("invalid_or_missing_report_received_date").alias("reason"),
    )


def recall_rows(accepted: DataFrame, lineage: tuple[str, ...] = ()) -> DataFrame:
    """Typed recall rows; the 29 raw fields stay available as columns and lineage as ``evidence``."""
    code = clean("RCLTYPECD")
    typed = accepted.select(
        clean("RECORD_ID").alias("record_id"),
        clean("CAMPNO").alias("campaign_id"),
        F.col("received").alias("report_received_date"),
        code.alias("recall_type_code"),
        decode_label(code, TYPE_LABELS, "unknown_code").alias("recall_type"),
        clean("MFGNAME").alias("manufacturer"),
        clean("MAKETXT").alias("make"),
        clean("MODELTXT").alias("model"),
        sentinel_to_null("YEARTXT", "9999").alias("model_year"),
        clean("COMPNAME").alias("component"),
        F.col("RECORD_ID").alias("raw_record_id"),
        *FIELDS[1:],
        *lineage,
    )
    return typed


def reread_lines(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored evidence whose line at the recorded offset is absent or has another length or hash."""
    found = evidence.select(
        "file", "byte_offset", F.col("line_bytes").alias("_bytes"), F.col("line_sha256").alias("_hash")
    ).join(lines.select("file", "byte_offset", "line_bytes", "line_sha256"), ["file", "byte_offset"], "left")
    return found.select("file", "byte_offset", _line_problem().alias("problem")).filter(F.col("problem").isNotNull())


def _line_problem() -> Column:
    return (
        F.when(F.col("line_sha256").isNull(), "no_line_at_offset")
        .when(F.col("line_bytes") != F.col("_bytes"), "length_differs")
        .when(F.col("line_sha256") != F.col("_hash"), "hash_differs")
    )


def recheck_rows(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, byte_offset, problem, fields): stored rows that differ from the bytes they were taken from.

    ``stored`` has the 29 raw fields, the encoding and the evidence (file, byte_offset, line_bytes, line_sha256) of each row.
    A row's problem is that of its line, or else ``fields_differ`` with the names of all fields whose value isn't the one
    that the line at the recorded offset holds under the recorded encoding.

    ``lines`` move to the offsets as the bytes they are. Only the lines met are hashed, decoded and split again, after they moved.
    """
    old = stored.select("file", "byte_offset", F.col("line_bytes").alias("_bytes"), F.col("line_sha256").alias("_hash"), F.col("encoding").alias("_encoding"),
                        F.array(*FIELDS).alias("_fields"))
    met = old.join(lines.select("file", "byte_offset", "line_bytes", "value"), ["file", "byte_offset"], "left")
    raw = F.col("value").cast("binary")
    ended = F.col("line_bytes") > F.octet_length("value")
    both = split_fields(met.withColumn("line_sha256", F.sha2(F.when(ended, F.concat(raw, F.unhex(F.lit("0A")))).otherwise(raw), 256)))
    differing = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(FIELDS) - 1)),
            lambda i: F.when(~F.get("fields", i).eqNullSafe(F.get("_fields", i)), F.get(F.array(*map(F.lit, FIELDS)), i)),
        ),
        lambda n: n.isNotNull(),
    )
    wrong = (F.size("fields") != len(FIELDS)) | (F.col("encoding") != F.col("_encoding")) | (F.size("_differ") > 0)
    problem = F.coalesce(_line_problem(), F.when(wrong, "fields_differ"))
    return both.withColumn("_differ", differing).select(
        "file", "byte_offset", problem.alias("problem"), F.when(problem == "fields_differ", F.array_join("_differ", " ")).alias("fields")
    ).filter(F.col("problem").isNotNull())
