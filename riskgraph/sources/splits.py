"""Files read split by split: what a split needs to know of the splits before it is one row, so no text is moved.

The text reader cuts a file of any size into splits and gives each line to the split it starts in, byte by byte as it is. Lines of a
split are worked on in order inside its task; a first pass sums up every split in one row, a prefix scan over these rows tells
each split where it begins, and a second pass over the same splits uses that. The table of starts has one row a split.
"""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskgraph import runtime

_SPLIT = ["file", "block"]
#: Files with these endings are unpacked by the text reader, so their bytes have to be read whole.
PACKED = r"(?i)\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate)$"

# Fields of one line of a CSV record, outside and inside a quoted field. Repeats are possessive, so scans are linear.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+)'
_CLOSED = re.compile(rf"{_FIELD}(?:,{_FIELD})*+\Z", re.S)
_STAYS_OPEN = re.compile(r'[^"]*+(?:""[^"]*+)*+\Z', re.S)
_CLOSES = re.compile(rf'[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+\Z', re.S)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, value): raw lines as bytes, in file order within each split, which is named by its first byte."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def with_starts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with the start of their split. The stream of lines keeps its order: the starts, one row a split, are broadcast."""
    return lines.join(F.broadcast(starts), _SPLIT)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, first row, end row) of stretches of one split in a batch."""
    files, blocks = batch.column("file"), np.asarray(batch.column("block"))
    if not batch.num_rows:
        return
    codes = np.asarray(files.dictionary_encode().indices)
    cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield files[a].as_py(), int(blocks[a]), a, b


# --- lineage -------------------------------------------------------------------------------------


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number and the byte offset of each line, counted on from the split's start."""
    seen: dict[tuple[str, int], tuple[int, int]] = {}
    for batch in batches:
        offsets, numbers = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
        for file, block, a, b in _runs(batch):
            sizes = np.asarray(pc.binary_length(batch.column("value").slice(a, b - a))).astype(np.int64) + 1
            at, n = seen.get((file, block)) or (batch.column("first_byte")[a].as_py(), batch.column("first_line")[a].as_py())
            offsets[a:b] = at + np.cumsum(sizes) - sizes
            numbers[a:b] = n + np.arange(b - a)
            seen = {(file, block): (at + int(sizes.sum()), n + b - a)}
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("file", "size", "value")], pa.array(numbers), pa.array(offsets)], names=["file", "size", "value", "line_number", "byte_offset"])


def lines_with_lineage(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, byte_offset, line_bytes, line_sha256, value): every raw line with its place in the file.

    Line numbers count from 1; bytes and hash include the line break where there is one. Only sums of lengths, one row a
    split, are exchanged.
    """
    lines = split_lines(spark, path)
    totals = lines.groupBy(*_SPLIT).agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = runtime.durable(
        totals.select(*_SPLIT, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("first_byte"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1).alias("first_line")),
        "split-starts",
    )
    placed = with_starts(lines, starts).mapInArrow(_place, "file string, size long, value binary, line_number long, byte_offset long")
    length = F.octet_length("value").cast("long")
    open_end = F.col("byte_offset") + length + 1 > F.col("size")
    raw = F.when(open_end, F.col("value")).otherwise(F.concat("value", F.unhex(F.lit("0A"))))
    return placed.select(
        "file", "line_number", "byte_offset", (length + 1 - open_end.cast("int")).alias("line_bytes"), F.sha2(raw, 256).alias("line_sha256"),
        F.col("value").cast("string").alias("value"),
    )


# --- hashes of whole files -----------------------------------------------------------------------


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, bytes, sha256) of files whose lines come whole and in order; the digest goes on from batch to batch."""
    now, state, size, done = None, None, 0, -1

    def result() -> pa.RecordBatch:
        if done < size:  # the last line ends with a line break
            state.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([size], pa.int64()), pa.array([state.hexdigest()])], names=["file", "bytes", "sha256"])

    for batch in batches:
        for file, _, a, b in _runs(batch):
            if file != now:
                if now is not None:
                    yield result()
                now, state, size, done = file, hashlib.sha256(), batch.column("size")[a].as_py(), -1
            for value in batch.column("value").slice(a, b - a).to_pylist():
                state.update(b"\n" + value if done >= 0 else value)  # a line break stands before every line but the first
                done += len(value) + 1
    if now is not None:
        yield result()


def streamed_hashes(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, bytes, sha256) of files of any size: each is one split, read line by line in one task with a running digest.

    A hash is sequential, so a file is the unit of work; nothing is held but a batch of lines. A session of its own keeps files
    whole. Files that the text reader would unpack, and empty ones, have no row here.
    """
    whole = spark.newSession()
    whole.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 62))
    reader = whole.read.option("lineSep", "\n")
    for name, value in options.items():
        reader = reader.option(name, value)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    ).filter(~F.col("file").rlike(PACKED))
    made = lines.mapInArrow(_digest, "file string, bytes long, sha256 string")
    target = f"{runtime.shared_dir(spark)}/hashes-{hashlib.sha256(path.encode()).hexdigest()[:8]}-{np.random.default_rng().integers(1 << 60):x}"
    made.write.parquet(target)
    return spark.read.schema(made.schema).parquet(target)


# --- strict CSV ----------------------------------------------------------------------------------


def closed_after(line: str, inside: bool) -> bool:
    """Whether a record is complete at the end of a line that begins outside or inside a quoted field."""
    if not inside:
        return _CLOSED.match(line) is not None
    return _STAYS_OPEN.match(line) is None and _CLOSES.match(line) is not None


#: What is left of an empty line; outside quotes it is no record.
_EMPTY = ("", "\r")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, inside_0, n_0, inside_1, n_1, head): for both states at the start of a split, the state at its end and the
    records that begin in it; of a file's first split also the lines of its first record."""
    now, ends, counts, head, open_ = None, [0, 1], [0, 0], [], True

    def result() -> pa.RecordBatch:
        text = None if open_ or now[1] else "\n".join(head)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip((*now, ends[0], counts[0], ends[1], counts[1], text), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()))],
            names=["file", "block", "inside_0", "n_0", "inside_1", "n_1", "head"],
        )

    for batch in batches:
        for file, block, a, b in _runs(batch):
            if (file, block) != now:
                if now is not None:
                    yield result()
                now, ends, counts, head, open_ = (file, block), [0, 1], [0, 0], [], True
            for raw in batch.column("value").slice(a, b - a).to_pylist():
                line = raw.decode("utf-8")
                if block == 0 and not head and counts[0] == 0:
                    line = line.removeprefix("﻿")
                known = {}
                for k in (0, 1):
                    if ends[k] == 0 and line in _EMPTY:
                        continue
                    counts[k] += ends[k] == 0
                    if ends[k] not in known:
                        known[ends[k]] = int(not closed_after(line, ends[k] == 1))
                    if k == 0 and open_:
                        head.append(line)
                        open_ = known[ends[0]] == 1
                    ends[k] = known[ends[k]]
    if now is not None:
        yield result()


def _starts(parts: pd.DataFrame) -> pd.DataFrame:
    """Prefix scan of a file's splits: the state at the start of each, and how many records begin before it."""
    inside, before, out = 0, 0, []
    for row in parts.sort_values("block").itertuples():
        out.append((row.file, row.block, inside, before))
        before += row.n_1 if inside else row.n_0
        inside = row.inside_1 if inside else row.inside_0
    if inside:
        raise ValueError(f"{parts.file.iloc[0]}: the last record is open")
    return pd.DataFrame(out, columns=["file", "block", "inside", "before"])


def _fields(text: str) -> list[str]:
    """The trimmed values of one record. A bare carriage return outside quotes is an error of the csv module."""
    csv.field_size_limit(1 << 31)
    found = list(csv.reader(re.split(r"(?<=\n)", text)))
    return [v.strip() for v in found[0]]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, record, fields, block, piece): complete records with fields; of a record that crosses splits, the piece in each split."""
    now, number, open_, crossing = None, 0, [], False
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string()]
    names = ["file", "record", "fields", "block", "piece"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        out = []
        for file, block, a, b in _runs(batch):
            if (file, block) != now:
                if open_:
                    out.append((now[0], number, None, now[1], "\n".join(open_)))
                now, open_ = (file, block), []
                crossing = batch.column("inside")[a].as_py() == 1
                number = batch.column("before")[a].as_py() - 1
                inside = crossing
            for raw in batch.column("value").slice(a, b - a).to_pylist():
                line = raw.decode("utf-8")
                if block == 0 and number < 0 and not open_:
                    line = line.removeprefix("﻿")
                if not inside and line in _EMPTY:
                    continue
                number += not inside
                open_.append(line)
                inside = not closed_after(line, inside)
                if not inside:
                    text = "\n".join(open_)
                    out.append((file, number, None, block, text) if crossing else (file, number, _fields(text), block, None))
                    open_, crossing = [], False
        if out:
            yield batch_of(out)
    if open_:
        yield batch_of([(now[0], number, None, now[1], "\n".join(open_))])


def _parse_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = pa.array([_fields(t) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fields], names=["file", "record", "fields"])


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records ``(file, record, fields)`` of CSV files of any size and heads ``(file, fields)``, one row a file.

    ``record`` counts from 0, the head, in file order; empty lines are none. Quoted fields may hold commas, doubled quotes and
    line breaks, over any number of splits: every split reports the state it ends in for both states it may begin in, a prefix
    scan over splits picks the right one, and only records that cross splits are put together elsewhere. Values are trimmed.
    A file that ends inside quotes, a head longer than the first split and bytes that aren't UTF-8 are errors.
    """
    lines = split_lines(spark, path)
    parts = runtime.durable(
        lines.select("file", "block", "value").mapInArrow(_summaries, "file string, block long, inside_0 int, n_0 long, inside_1 int, n_1 long, head string"), "csv-splits"
    )
    starts = runtime.durable(parts.groupBy("file").applyInPandas(_starts, "file string, block long, inside int, before long"), "csv-starts")
    made = runtime.durable(
        with_starts(lines.select("file", "block", "value"), starts).mapInArrow(_records, "file string, record long, fields array<string>, block long, piece string"), "csv-records"
    )
    pieces = made.filter("fields is null").groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda s: s["piece"]), "\n").alias("text")
    )
    crossed = pieces.select("file", "record", "text").mapInArrow(_parse_whole, "file string, record long, fields array<string>")
    heads = parts.filter("block = 0").select("file", F.lit(0).cast("long").alias("record"), F.coalesce("head", F.lit("")).alias("text"))
    return made.filter("fields is not null").select("file", "record", "fields").unionByName(crossed), heads.mapInArrow(_parse_whole, "file string, record long, fields array<string>").drop("record")
