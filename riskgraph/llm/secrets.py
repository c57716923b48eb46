"""Secret scans over a ledger of blobs: every content is addressed by its hash and scanned once per rule version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.llm.scratch import Scratch

# The base rules (kind, pattern, measured group, least characters), in their order.
BASE_RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a run of 16 or more is a whole maximal run
)
# A private key runs to its END line. Without one it runs over its header lines, all lines that are base64 as a whole and all long
# base64 runs; line breaks may be escaped, and lines may be quoted or indented. Repeats are possessive, so scans stay linear.
_BREAK = r"(?:\r?\n|\\r|\\n)"
_EDGE = r"[\x20\t>#*|\"',;]*+"
_KEY_BODY = rf"""(?:(?:(?!-----)(?s:.))*+-----END\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY-----
    |(?:{_EDGE}(?:{_BREAK}{_EDGE})*+(?:[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*+(?={_BREAK})|[A-Za-z0-9+/]{{16,}}+={{0,2}}|[A-Za-z0-9+/]++={{1,2}})
      |{_EDGE}(?:{_BREAK}{_EDGE})++[A-Za-z0-9+/]++={{0,2}}(?={_EDGE}(?:{_BREAK}|\Z)))*+)"""
# Published shapes of well-known credentials.
MORE_RULES = (
    ("private_key", re.compile(r"-----BEGIN\x20(?:[A-Z0-9]+\x20)*PRIVATE\x20KEY-----" + _KEY_BODY, re.X), 0, 0),
    ("code_host", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 0),
    ("chat", re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}"), 0, 0),
    ("cloud_key", re.compile(r"AIza[A-Za-z0-9_-]{35}"), 0, 0),
    ("payment", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"), 0, 0),
    ("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0),
)
KINDS = [rule[0] for rule in BASE_RULES + MORE_RULES]
#: Changes with any rule, so that blobs seen under older rules count as unseen.
RULE_VERSION = hashlib.sha256("\n".join(f"{k} {p.pattern} {p.flags} {g} {n}" for k, p, g, n in BASE_RULES + MORE_RULES).encode()).hexdigest()[:16]

_NONE = hashlib.sha256(b"").hexdigest()
_LEDGER = "blob string, rule_version string, kinds array<string>, starts array<long>, ends array<long>"


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of a text in code points, by start and then kind.

    Per kind matches are leftmost and don't overlap; a match that is too short is dropped after it was taken.
    """
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE_RULES + MORE_RULES):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [find_secrets(text.as_py() or "") for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([RULE_VERSION] * len(rows), pa.string()),
                pa.array([[KINDS[k] for _, k, _ in r] for r in rows], pa.list_(pa.string())),
                pa.array([[s for s, _, _ in r] for r in rows], pa.list_(pa.int64())),
                pa.array([[e for _, _, e in r] for r in rows], pa.list_(pa.int64())),
            ],
            names=["blob", "rule_version", "kinds", "starts", "ends"],
        )


def blob_id(content: str) -> Column:
    """The address of a content; a null content is an empty one."""
    return F.sha2(F.coalesce(F.col(content), F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, kinds, starts, ends) of the blobs that ``ledger`` lacks under these rules.

    ``versions`` has a column ``text``, one row for each version of each path. Copies meet as hashes: one text
    of each blob is kept map-side before it moves, so a blob that is a third of all rows is no hot key.
    Append the rows to the ledger; a later call then scans new blobs only, and all blobs after a change of rules.
    """
    blobs = versions.select(blob_id("text").alias("blob"), "text").dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.mapInArrow(_scan, _LEDGER)


def join_findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """``versions(doc_id, text)`` as (doc_id, blob, kinds, starts, ends), one row for each, findings of the present rules.

    Only blobs with findings are joined; the lists of the other rows are empty.
    """
    lists = ["kinds", "starts", "ends"]
    found = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("kinds") > 0)).dropDuplicates(["blob"]).select("blob", *lists)
    joined = versions.select("doc_id", blob_id("text").alias("blob")).join(found, "blob", "left")
    empty = {c: F.coalesce(c, F.array().cast("array<string>" if c == "kinds" else "array<long>")) for c in lists}
    return joined.select("doc_id", "blob", *[e.alias(c) for c, e in empty.items()])


def secret_findings(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of every row of ``versions(doc_id, text)``: scans what the ledger lacks and joins back to all rows.

    Repeated rows each get their findings; null and empty texts have none. Other columns are ignored.
    """
    scratch = Scratch(versions.sparkSession)
    fresh = scratch.keep(scan_unseen(versions, ledger), "ledger")
    return join_findings(versions, fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns)))


def redact(text: str, starts: str, ends: str, mark: str = "[SECRET]") -> Column:
    """The text with every found span replaced by ``mark``; overlapping and touching spans become one mark."""
    spans = F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    put = F.aggregate(
        spans, start,
        lambda acc, span: F.struct(
            F.greatest(acc["at"], span["e"]).alias("at"),
            F.when(
                (span["s"] > acc["at"]) | ((acc["at"] == 0) & (span["s"] == 0)),
                F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, span["s"] - acc["at"]), F.lit(mark)),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    rest = F.concat(put["out"], F.substring(F.col(text), put["at"] + 1, F.length(text)))
    return F.when(F.size(starts) > 0, rest).otherwise(F.col(text))


def digest(findings: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each row, as ``kind:start:end`` joined by commas."""
    zipped = F.arrays_zip("kinds", "starts", "ends")
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")
    base = [rule[0] for rule in BASE_RULES]
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return findings.select(
        "doc_id", *[count(k) for k in base],
        F.when(F.size("kinds") > 0, F.sha2(spelled(F.filter(zipped, lambda s: s["kinds"].isin(base))), 256)).otherwise(_NONE).alias("base_sha256"),
        spelled(zipped).alias("spans"),
    )
