"""Benchmark decontamination: n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

The benchmark is a query set. It is read in blocks of at most ``ITEMS_PER_BLOCK`` items, whose words and seeds travel to
all tasks; the corpus is never shuffled. The first pass counts in how many documents each n-gram of the
items occurs, over the whole corpus. All of an item's n-grams that occur at all are its seeds, common ones as well: in an
edited copy only those that survive can be found, and the edits don't choose rare or common ones. The second pass looks
the seeds up at every word of every text, and aligns the item with the words around them. What frequent seeds cost is
bounded without a loss: a passage that lacks too many words of the item to reach the least score isn't aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskgraph.llm.scratch import Scratch
from riskgraph.llm.words import ALPHANUMERIC, chunks, flat_bytes, hash_spans, mix, shingles, word_bounds

GRAM = 3
#: Longer items are aligned in pieces of about equal length, at most so many words; a document that holds a piece holds the item.
#: A piece of a longer item has at least half as many words, so a match aligns a quarter as many or more.
PIECE = 256
ITEMS_PER_BLOCK = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a perfect alignment's score from which on a passage is a copy.
LEAST_SCORE = 0.5
_FILTER_BITS = 20


@dataclass
class Items:
    ids: np.ndarray  # item id of each piece
    words: list[np.ndarray]  # hashed words of each piece
    seeds: np.ndarray  # sorted n-gram hashes
    begin: np.ndarray  # where the entries of each seed begin (n + 1 offsets)
    piece: np.ndarray  # entries: piece and place of the n-gram in it
    place: np.ndarray


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed alphanumeric words of the lower-cased texts and their offsets by text."""
    flat, starts = flat_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    first, last, bounds = word_bounds(flat, starts, ALPHANUMERIC)
    return hash_spans(flat, first, last), bounds


def index_items(ids: list[int], texts: list[str]) -> Items:
    """All n-grams of the items' pieces; equal n-grams share one seed."""
    words, bounds = hashed_words(pa.array(texts, pa.string()))
    of, pieces = [], []
    for i in range(len(ids)):
        own = words[bounds[i] : bounds[i + 1]]
        if len(own):
            cut = np.array_split(own, math.ceil(len(own) / PIECE))
            of += [ids[i]] * len(cut)
            pieces += cut
    if not pieces:
        return Items(np.zeros(0, np.int64), [], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams, offsets = shingles(np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), GRAM)
    piece = np.repeat(np.arange(len(pieces)), np.diff(offsets))
    return _by_seed(np.array(of, np.int64), pieces, grams, piece, np.arange(len(grams)) - offsets[piece])


def _by_seed(ids, words, grams, piece, place) -> Items:
    order = np.argsort(grams, kind="stable")
    seeds, begin = np.unique(grams[order], return_index=True)
    return Items(ids, words, seeds, np.append(begin, len(grams)), piece[order], place[order])


def found_seeds(items: Items, frequency: np.ndarray) -> Items:
    """Only the seeds that some document holds, by ``frequency`` (documents holding each seed)."""
    entry_seed = np.repeat(np.arange(len(items.seeds)), np.diff(items.begin))
    keep = np.flatnonzero(frequency[entry_seed] > 0)
    return _by_seed(items.ids, items.words, items.seeds[entry_seed[keep]], items.piece[keep], items.place[keep])


class _Lookup:
    """Places of seeds in an array of n-gram hashes; a bit table rules most n-grams out first."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = seeds
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.maybe[grams >> np.uint64(64 - _FILTER_BITS)])
        near = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        hit = self.seeds[near] == grams[at]
        return at[hit], near[hit]


def _seed_counter(seeds: np.ndarray):
    """Rows (seed number, n): documents that hold the seed, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = _Lookup(seeds), np.zeros(len(seeds), dtype=np.int64)
        for batch in batches:
            for part in chunks(batch):
                words, bounds = hashed_words(part.column(0))
                grams, offsets = shingles(words, bounds, GRAM)
                at, seed = find(grams)
                doc = np.searchsorted(offsets, at, side="right") - 1
                total += np.bincount(np.unique(doc * len(seeds) + seed) % len(seeds), minlength=len(seeds))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["seed", "n"])

    return run


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words for many pairs at once: the best local score of each, and where in the window it ends."""
    rows, width = max(map(len, items)), max(map(len, windows))
    q = np.zeros((len(items), rows), dtype=np.uint64)
    w = np.ones((len(items), width), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(items, windows)):
        q[k, : len(a)], w[k, : len(b)] = a, b
    h = np.zeros((len(items), width + 1), dtype=np.int32)
    best, end = np.zeros(len(items), dtype=np.int32), np.zeros(len(items), dtype=np.int64)
    slope = np.arange(width, dtype=np.int32) * -GAP
    for i in range(rows):
        t = np.maximum(h[:, :-1] + np.where(w == q[:, i : i + 1], MATCH, MISMATCH), h[:, 1:] + GAP)
        np.maximum(t, 0, out=t)
        h[:, 1:] = np.maximum.accumulate(t + slope, axis=1) - slope  # gaps along the window
        at = h[:, 1:].argmax(axis=1)
        top = h[np.arange(len(items)), at + 1]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def reachable(items: list[np.ndarray], windows: list[np.ndarray], least: float) -> np.ndarray:
    """Pairs that may score ``least`` of a perfect alignment: so many of the item's words occur in its window at all."""
    n = len(items)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    sizes = np.array([len(q) for q in items])
    q = np.concatenate(items) ^ np.repeat(salt, sizes)
    w = np.concatenate(windows) ^ np.repeat(salt, [len(x) for x in windows])
    there = np.isin(q, w)
    return np.add.reduceat(there.astype(np.int64), np.cumsum(sizes) - sizes) >= least * sizes


def _windows(doc, start, piece, sizes, counts):
    """Merge hits of one (text, piece) that lie close together; (doc, piece, first, last) in words of the text."""
    order = np.lexsort((start, piece, doc))
    doc, start, piece = doc[order], start[order], piece[order]
    slack = sizes[piece] // 2 + 8
    step = np.ones(len(doc), dtype=bool)
    step[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1]) | (start[1:] - start[:-1] > slack[1:])
    group = np.flatnonzero(step)
    low, high = start[group], np.maximum.reduceat(start, group) if len(group) else start
    d, p = doc[group], piece[group]
    out = []
    for k in range(len(group)):
        size, room = int(sizes[p[k]]), int(slack[group[k]])
        for at in range(int(low[k]), int(high[k]) + 1, size + room):  # long runs of hits in overlapping stretches
            to = min(at + size + room, int(high[k]) + 1) + size + room
            out.append((int(d[k]), int(p[k]), max(0, at - room), min(int(counts[d[k]]), to)))
    return out


def _aligner(items: Items, least: float):
    """Rows (doc_id, item_id, score, first_word, last_word) of the passages that score at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sizes = _Lookup(items.seeds), np.array([len(w) for w in items.words])
        entries = np.diff(items.begin)
        for batch in batches:
            for part in chunks(batch):
                words, bounds = hashed_words(part.column(1))
                grams, offsets = shingles(words, bounds, GRAM)
                at, seed = find(grams)
                doc = np.searchsorted(offsets, at, side="right") - 1
                many = entries[seed]
                entry = np.repeat(items.begin[seed] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                doc, start = np.repeat(doc, many), np.repeat(at - offsets[doc], many) - items.place[entry]
                spans = _windows(doc, start, items.piece[entry], sizes, np.diff(bounds))
                spans.sort(key=lambda s: (sizes[s[1]], s[3] - s[2]))
                found = []
                for k in range(0, len(spans), 256):
                    some = spans[k : k + 256]
                    q = [items.words[p] for _, p, _, _ in some]
                    w = [words[bounds[d] + lo : bounds[d] + hi] for d, _, lo, hi in some]
                    may = np.flatnonzero(reachable(q, w, least))
                    if not len(may):
                        continue
                    some, q, w = [some[j] for j in may], [q[j] for j in may], [w[j] for j in may]
                    score, end = align(q, w)
                    good = [j for j in range(len(some)) if score[j] >= least * MATCH * len(q[j])]
                    if good:
                        _, back = align([q[j][::-1] for j in good], [w[j][: end[j]][::-1] for j in good])
                        for j, b in zip(good, back):
                            d, p, lo, _ = some[j]
                            found.append((d, int(items.ids[p]), float(score[j]) / (MATCH * len(q[j])), lo + int(end[j] - b), lo + int(end[j]) - 1))
                ids = part.column(0).to_pylist()
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                     pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"],
                )

    return run


_HITS = "doc_id long, item_id long, score double, first_word long, last_word long"


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_passages): every document and item it holds a copy of.

    ``score`` is the alignment's share of a perfect one, 1 for an exact copy; the words are those of the best passage.
    Words are lower-cased runs of letters and digits, so case and punctuation don't matter. Items without words,
    null items and null or empty texts match nothing; an item of fewer words than a seed is searched as a whole.
    Repeated items and ids are one each; a null ``doc_id`` keeps its rows, as one group. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    n = max(1, math.ceil(asked.count() / ITEMS_PER_BLOCK))
    hits = spark.createDataFrame([], _HITS)
    for k in range(n):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()
        items = index_items([r.item_id for r in block], [r.text for r in block])
        if not len(items.seeds):
            continue
        frequency = np.zeros(len(items.seeds), dtype=np.int64)
        counted = rows.select("text").mapInArrow(_seed_counter(items.seeds), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        for seed, count in counted.collect():  # one number for each n-gram of the block
            frequency[seed] = count
        found = found_seeds(items, frequency)
        if len(found.seeds):
            hits = hits.unionByName(rows.mapInArrow(_aligner(found, least), _HITS))
    best = F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_passages")).select(
        "doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("first_word"), F.col("b.last_word").alias("last_word"), "n_passages"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a benchmark item, all columns as they were. Rows with a null id stay."""
    bad = Scratch(docs.sparkSession).keep(contaminated_passages(docs, benchmark, least=least).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
