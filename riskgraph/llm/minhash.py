"""Near-duplicate texts: universal hash minima, banding, signature and exact checks, components.

1. One pass over the texts gives each document its set of word shingles, reduced to a set key, its size
   and ``BANDS`` bucket ids of ``ROWS`` minima each. Documents with equal sets are one class from here on.
2. In each bucket the smallest document is the hub. Hub links are checked on full sets and merged.
   That ties a group of copies together with as many pairs as it has members.
3. Links can remain only between documents of different components in a bucket. Buckets that still hold
   several components are cut into blocks, and every pair of blocks compares long signatures inside a
   task; only pairs near the threshold leave it and are checked on full sets.

A pair at the similarity 0.8 shares no bucket with probability (1 - 0.8^5)^28 = 1.5e-5 and falls below the
signature threshold (four standard deviations) with 3e-5. Pairs above are safer still; none below is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskgraph.llm.components import connected_components
from riskgraph.llm.scratch import Scratch
from riskgraph.llm.words import chunks, keys, mix, shingle_sets
from riskgraph.operators.joins import attach_group_stats

#: A text without such a character has no words and no shingles.
WORD = r"[^\x20\x09-\x0D]"
BANDS, ROWS = 28, 5
LONG = 1024
BLOCK = 512

_A, _B = keys(101, BANDS * ROWS), keys(102, BANDS * ROWS)
_LA, _LB = keys(103, LONG), keys(104, LONG)
_BAND = keys(105, BANDS)


def minima(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each set (none empty) and each universal hash x -> (a x + b) >> 32, the least value."""
    out = np.empty((len(offsets) - 1, len(a)), dtype=np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), offsets[:-1])
    return out


def _stacked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _set_key(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set (none empty)."""
    hi, lo = (np.add.reduceat(mix(values ^ key), offsets[:-1]).view(np.int64) for key in _A[:2])
    return hi, lo


def _nodes(ids: pa.Array, hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """Names of texts: an id with the hash of its set, so that texts which share an id stay apart. Texts without an id come last."""
    missing = np.asarray(pc.is_null(ids))
    named = np.where(missing, lo, np.asarray(pc.fill_null(ids, 0)))
    return pa.StructArray.from_arrays([pa.array(missing.astype(np.int32)), pa.array(named), pa.array(hi)], names=["no_id", "id", "hi"])


def _sketcher(words: int):
    """Rows (doc_id, text_hash, n_shingles, set_hi, set_lo, buckets) of batches of (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column(1), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                n = len(sets)
                hi, lo, bands = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((len(full), BANDS), np.int64)
                if full:
                    values, offsets = _stacked([sets[i] for i in full])
                    low = minima(values, offsets, _A, _B).astype(np.uint64).reshape(len(full), BANDS, ROWS)
                    acc = np.broadcast_to(_BAND, (len(full), BANDS)).copy()
                    for r in range(ROWS):
                        acc = mix(acc ^ low[:, :, r]) + _BAND
                    bands = acc.view(np.int64)
                    hi[full], lo[full] = _set_key(values, offsets)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                    names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "buckets"],
                )

    return run


def _set_maker(words: int):
    """Rows (node, full, long) of rows (doc_id, text): all shingle hashes, and the low halves of ``LONG`` minima. Empty sets have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                every = shingle_sets(part.column(1), words)
                full = [i for i, s in enumerate(every) if len(s)]
                if not full:
                    continue
                sets = [every[i] for i in full]
                values, offsets = _stacked(sets)
                signatures = minima(values, offsets, _LA, _LB).astype(np.uint16)
                hi, lo = _set_key(values, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        _nodes(part.column(0).take(pa.array(full)), hi, lo), pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in signatures], pa.binary()),
                    ],
                    names=["node", "full", "long"],
                )

    return run


def _overlaps(percent: int):
    """Of rows (a, b, full_a, full_b) those whose sets overlap in ``percent`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    kept.append(i)
            picked = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1)], names=["a", "b"])

    return run


def _block_pairs(percent: int):
    """Near pairs of one pair of blocks, one row for each left text with its partners.

    A pair is taken in the first bucket it shares only, and only if its components differ.
    """
    least = percent / 100 - 4 * np.sqrt(percent / 100 * (1 - percent / 100) / LONG)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, left, right = key[0].as_py(), key[1].as_py(), key[2].as_py()
        nodes, part = table.column("node").combine_chunks(), table.column("part").to_numpy()
        fields = table.column("component").combine_chunks().flatten()
        _, comp = np.unique(np.stack([f.to_numpy().astype(np.int64) for f in fields], axis=1), axis=0, return_inverse=True)
        comp = comp.ravel()
        signs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("long")])
        bands = np.stack([np.asarray(x.values) for x in table.column("buckets")])
        lefts, rights = np.flatnonzero(part == left), np.flatnonzero(part == right)
        at, partners = [], []
        own = bands[0] == bucket
        band = int(np.argmax(own)) if own.any() else 0
        for i in lefts:
            j = rights[(comp[rights] != comp[i]) & (rights > i if left == right else True)]
            if band and len(j):
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            if len(j):
                j = j[(signs[j] == signs[i]).sum(axis=1) >= least * LONG]
            if len(j):
                at.append(i)
                partners.append(j)
        sizes = np.concatenate([[0], np.cumsum([len(j) for j in partners])]).astype(np.int32)
        found = nodes.take(pa.array(np.concatenate(partners) if partners else np.zeros(0, np.int64)))
        return pa.table({"a": nodes.take(pa.array(at, pa.int64())), "partners": pa.ListArray.from_arrays(pa.array(sizes), found)})

    return run


_NODE = "struct<no_id:int,id:long,hi:long>"


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, group): near-duplicate groups of ``docs(doc_id, text)``.

    Texts are lower-cased (A-Z) and cut at blanks; a set holds the distinct runs of ``words`` words, or the
    whole sequence of a shorter text. Texts with an overlap of ``percent`` of the union are linked. A null,
    empty or blank text has no shingles and links with nothing. One row comes back for every input row, and
    links are those of the row's own text, also where rows repeat an id with another text. ``component_id`` is the
    smallest id of the row's group, and a row is kept if that is its own. A row without an id belongs to the
    group of its text; it is kept where no text of the group has an id, and its ``component_id`` is null then. ``group`` names the
    group (null without shingles) also where ids repeat, and ``text_hash`` (xxhash64) tells rows of one id apart. Other columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = scratch.keep(
        texts.mapInArrow(_sketcher(words), "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, buckets array<long>"), "sketch"
    )
    same = ["n_shingles", "set_hi", "set_lo"]
    node = F.struct(F.col("doc_id").isNull().cast("int").alias("no_id"), F.coalesce("doc_id", "set_lo").alias("id"), F.col("set_hi").alias("hi"))
    classes = scratch.keep(
        sketch.filter("n_shingles > 0").groupBy(*same).agg(F.min(F.struct(node.alias("node"), "buckets")).alias("f")).select(*same, "f.*"), "classes"
    )
    members = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    hubs = scratch.keep(members.join(shared, "bucket"), "hubs")
    stars = hubs.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    involved = hubs.select(F.when(F.col("node.no_id") == 0, F.col("node.id")).alias("_id")).distinct()
    once = texts.join(involved, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = scratch.keep(
        once.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text").mapInArrow(_set_maker(words), f"node {_NODE}, full binary, long binary"), "sets"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = sets.select("node", "full")
        return (
            pairs.join(full.toDF("a", "full_a"), "a").join(full.toDF("b", "full_b"), "b")
            .select("a", "b", "full_a", "full_b").mapInArrow(_overlaps(percent), f"a {_NODE}, b {_NODE}")
        )

    first = scratch.keep(confirmed(stars), "links")
    merged = connected_components(first, "a", "b").toDF("node", "component")
    placed = scratch.keep(
        hubs.join(merged, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed"
    )
    open_ = attach_group_stats(placed, ["bucket"], {"n": F.count("*"), "lo": F.min("component"), "hi": F.max("component")}).filter("lo != hi")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = (
        open_.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", "node", "component", "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))
    )
    payload = sets.select("node", "long").join(classes.select("node", "buckets"), "node")
    near = (
        blocks.join(payload, "node").groupBy("bucket", "left", "right").applyInArrow(_block_pairs(percent), f"a {_NODE}, partners array<{_NODE}>")
        .select("a", F.explode("partners").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    near = scratch.keep(near, "near")
    second = scratch.keep(confirmed(near), "links")
    groups = connected_components(first.unionByName(second), "a", "b").toDF("node", "component")
    mapped = scratch.keep(
        classes.select(*same, "node").join(groups, "node", "left").select(*same, F.coalesce("component", "node").alias("group")), "groups"
    )
    scratch.drop(classes, hubs, sets, first, placed, near, second)
    found = sketch.select("doc_id", "text_hash", *same).join(mapped, same, "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).when(F.col("group.no_id") == 0, F.col("group.id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "group")
