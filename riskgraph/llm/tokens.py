"""Token counts: documents in flat unindexed token files, found by scanning for separators.

A token file is a plain row of ids in which every document ends with a separator; no index tells where. It is stored
in blocks of a fixed number of ids that cut documents anywhere. Each block is searched by itself, and a prefix scan
over one small row for each block gives its first document's number and start.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskgraph.llm.scratch import Scratch

#: Byte-pair ranks of a public vocabulary, and an id that it leaves free.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
BLOCK_IDS = 1 << 16
# Fixed value: the split pattern that belongs to the vocabulary.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Tokenise ``docs(doc_id, text)`` into one flat file for each input split; (blocks, ids).

    ``blocks(file, block, ids)`` is the token file: ``BLOCK_IDS`` little-endian 16-bit ids a row, the last row shorter.
    ``ids(file, first, doc_ids)`` lists the documents in the order of the file, ``first`` counting from 0. A null text is
    an empty one: its separator only. The vocabulary is read by the driver and sent along; its size is fixed.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = _encoder(ranks).encode_ordinary, TaskContext.get().partitionId()
        rest, block, seen = np.zeros(0, dtype="<u2"), 0, 0

        def row(kind, number, data, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind]), pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                names=["kind", "file", "number", "data", "doc_ids"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield row("ids", seen, None, part.column(0).to_pylist())
                seen += part.num_rows
                for text in part.column(1):
                    rest = np.concatenate([rest, np.array([*encode(text.as_py() or ""), SEPARATOR], dtype="<u2")])
                    while len(rest) >= BLOCK_IDS:
                        yield row("block", block, rest[:BLOCK_IDS].tobytes(), None)
                        rest, block = rest[BLOCK_IDS:], block + 1
        if len(rest):
            yield row("block", block, rest.tobytes(), None)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    written = Scratch(docs.sparkSession).keep(rows.mapInArrow(run, "kind string, file long, number long, data binary, doc_ids array<long>"), "tokens")
    blocks = written.filter("kind = 'block'").select("file", F.col("number").alias("block"), F.col("data").alias("ids"))
    return blocks, written.filter("kind = 'ids'").select("file", F.col("number").alias("first"), "doc_ids")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files of 16-bit ids as ``blocks(file, block, ids)``; ``file`` is the path. One file is at most 2 GB, the reader's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * BLOCK_IDS
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data = content.as_buffer()
                for k in range(-(-len(data) // size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([k], pa.int64()), pa.array([data.slice(k * size, min(size, len(data) - k * size)).to_pybytes()], pa.binary())],
                        names=["file", "block", "ids"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, ids binary")


def _find_separators(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype="<u2") if data.is_valid else np.zeros(0, "<u2")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"]
            )

    return run


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, number, start, n_tokens, complete) of every document of ``blocks(file, block, ids)``.

    ``number`` counts the documents of a file from 0, ``start`` is the place of its first id, ``n_tokens`` leaves the
    separator out. Ids behind the last separator of a file are a last document that isn't complete. Two
    separators side by side enclose an empty document. Blocks of a file are numbered in order, of any size.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = Scratch(blocks.sparkSession).keep(blocks.select("file", "block", "ids").mapInArrow(_find_separators(separator), f"file {kind}, block long, n long, ends array<long>"), "separators")
    order = W.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    summary = found.select("file", "block", "n", F.size("ends").cast("long").alias("found"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    based = summary.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carried = based.select(
        "file", "block", "base", "n", "found", F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("number"),
        F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(earlier), F.lit(0)).alias("open"), F.lead("block").over(order).isNull().alias("final"),
        (F.col("base") + F.col("last") + 1).alias("_after"),
    )
    inside = found.select("file", "block", "ends").join(carried.select("file", "block", "base", "number", "open"), ["file", "block"])
    begins = F.concat(F.array("open"), F.transform("ends", lambda e: F.col("base") + e + 1))
    spans = F.transform("ends", lambda e, k: F.struct(F.get(begins, k).alias("start"), (F.col("base") + e - F.get(begins, k)).alias("n_tokens")))
    whole = inside.select("file", F.col("number").alias("_first"), F.posexplode(spans).alias("_k", "s")).select(
        "file", (F.col("_first") + F.col("_k")).alias("number"), "s.start", "s.n_tokens", F.lit(True).alias("complete")
    )
    start = F.coalesce("_after", "open")
    tail = carried.filter("final").select(
        "file", (F.col("number") + F.col("found")).alias("number"), start.alias("start"), (F.col("base") + F.col("n") - start).alias("n_tokens"), F.lit(False).alias("complete")
    ).filter("n_tokens > 0")
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, file, number, start, n_tokens), one row for each row of ``docs(doc_id, text)``, counted from its token file.

    Null and empty texts have no tokens. Repeated rows are documents of their own. Other columns are ignored.
    """
    blocks, ids = write_token_files(docs, vocabulary)
    listed = ids.select("file", "first", F.posexplode("doc_ids").alias("_k", "doc_id")).select("file", (F.col("first") + F.col("_k")).alias("number"), "doc_id")
    return separator_scan(blocks).filter("complete").join(listed, ["file", "number"]).select("doc_id", "file", "number", "start", "n_tokens")
