"""Embedding near-duplicates: p-stable hashing of normalised vectors, exact cosines, components.

Each of ``TABLES`` tables quantises ``PROJECTIONS`` Gaussian projections in cells of width ``WIDTH``. Two unit vectors
with a cosine of 0.98 are 0.2 apart and fall into one cell of one projection with probability 0.92, into one bucket
of no table with (1 - 0.92^18)^46 = 9e-6; two at a right angle share a bucket with probability 1e-4, so few pairs meet by chance.
Buckets are cut into blocks, and every pair of blocks takes the cosines of
its vectors as one matrix product, so a bucket that holds a third of all vectors spreads over many tasks and
gives one row for a vector and block, never one for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskgraph.llm.components import connected_components
from riskgraph.llm.scratch import Scratch
from riskgraph.llm.words import keys, mix

TABLES, PROJECTIONS, WIDTH = 46, 18, 2.0
BLOCK = 512
_CELL = keys(201, PROJECTIONS)
_TABLE = keys(202, TABLES)


@lru_cache(maxsize=8)
def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def bucket_ids(units: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(n, TABLES) bucket ids of unit vectors; vectors of different labels or dimensions share none."""
    a, b = _projections(units.shape[1])
    cells = np.floor((units @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(units), TABLES, PROJECTIONS)
    acc = mix(_TABLE + np.uint64(units.shape[1]))[None, :] ^ mix(labels.astype(np.int64).view(np.uint64))[:, None]
    for k in range(PROJECTIONS):
        acc = mix(acc ^ (cells[:, :, k] * _CELL[k]))
    return acc.view(np.int64)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, label, key, vector, buckets); the last three are null for a vector that links with nothing."""
    for batch in batches:
        n = batch.num_rows
        labels = batch.column(1).to_pylist()
        vectors = [v.as_py() for v in batch.column(2)]
        by_dim: dict[int, list[int]] = {}
        arrays = [None] * n
        for i, v in enumerate(vectors):
            if labels[i] is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                arrays[i] = x
                by_dim.setdefault(len(x), []).append(i)
        key, raw, buckets = [None] * n, [None] * n, [None] * n
        for rows in by_dim.values():
            x = np.stack([arrays[i] for i in rows])
            scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
            units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            ids = bucket_ids(units, np.array([labels[i] for i in rows], dtype=np.int64))
            for k, i in enumerate(rows):
                raw[i] = scaled[k].tobytes()
                key[i] = hashlib.blake2b(x[k].tobytes(), digest_size=16).digest()
                buckets[i] = ids[k].tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(labels, pa.int64()), pa.array(key, pa.binary()), pa.array(raw, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
            names=["vec_id", "label", "key", "vector", "buckets"],
        )


def _local_roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric link matrix reaches."""
    roots = ids.copy()
    while True:
        best = np.minimum(roots, np.where(links, roots[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (best == roots).all():
            return roots
        roots = best


def _block_links(cosine: float):
    """Rows (vec_id, n, root) of a pair of blocks: copies linked to the vector here, and the least id it reaches here.

    A pair counts in the first table where it shares a bucket, so over all tables it counts once.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, left, right = key[0].as_py(), key[1].as_py(), key[2].as_py()
        ids, part, copies = (table.column(c).to_numpy() for c in ("vec_id", "part", "copies"))
        order = np.argsort(ids)
        ids, part, copies = ids[order], part[order], copies[order]
        x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in table.column("vector")])[order]
        bands = np.stack([np.asarray(v.values) for v in table.column("buckets")])[order]
        norms = np.sqrt((x * x).sum(axis=1))
        links = (x @ x.T) / (norms[:, None] * norms[None, :]) >= cosine
        np.fill_diagonal(links, False)
        if left != right:
            links &= part[:, None] != part[None, :]
        own = int(np.argmax(bands[0] == bucket))
        i, j = np.nonzero(links)
        if own and len(i):
            links[i, j] = ~(bands[i, :own] == bands[j, :own]).any(axis=1)
        n = links @ copies
        some = np.flatnonzero(n)
        roots = _local_roots(links[np.ix_(some, some)], ids[some]) if len(some) else ids[:0]
        return pa.table({"vec_id": pa.array(ids[some]), "n": pa.array(n[some].astype(np.int64)), "root": pa.array(roots)})

    return run


def vector_duplicates(vectors: DataFrame, *, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors(vec_id, embedding, label)``.

    Vectors of one non-null label are linked at a cosine of at least ``cosine``. Null, zero and empty vectors and those
    with null or non-finite components link with nothing. Equal vectors are one class and linked with each other; a
    repeated ``vec_id`` counts as another vector. A row with a null ``vec_id`` counts as a link of its copies and
    has no component itself; it is kept. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sketch = scratch.keep(rows.mapInArrow(_hash, "vec_id long, label long, key binary, vector binary, buckets array<long>"), "vectors")
    valid = sketch.filter("key is not null")
    classes = scratch.keep(
        valid.groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("buckets").alias("buckets"))
        .filter("vec_id is not null"),
        "classes",
    )
    members = classes.select("vec_id", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = (
        members.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", "vec_id", "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))
    )
    found = scratch.keep(
        blocks.join(classes.select("vec_id", "copies", "vector", "buckets"), "vec_id")
        .groupBy("bucket", "left", "right").applyInArrow(_block_links(cosine), "vec_id long, n long, root long"),
        "links",
    )
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    groups = connected_components(found.filter("vec_id != root"), "vec_id", "root").toDF("vec_id", "component")
    per_class = scratch.keep(
        classes.join(counts, "vec_id", "left").join(groups, "vec_id", "left").select(
            "label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")
        ),
        "groups",
    )
    scratch.drop(classes, found)
    joined = sketch.select("vec_id", "label", "key").join(per_class, ["label", "key"], "left")
    component = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )
