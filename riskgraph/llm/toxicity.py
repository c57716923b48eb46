"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskgraph import runtime
from riskgraph.llm.scratch import Scratch
from riskgraph.llm.words import ALPHANUMERIC, chunks, flat_bytes, hash_spans, word_bounds

TOKEN_BITS = 20
TOKENS = 1 << TOKEN_BITS
#: Dirichlet prior: pseudo-documents of each token in each class.
PRIOR = 0.5
#: Tokens whose log-odds are fewer standard errors than this from zero carry no evidence.
LEAST_Z = 3.0
#: Passages are significant up to the last rank r at which r passages this good have a chance below this level in a clean text.
LEVEL = 0.05
#: Loss of a segment for each token without evidence: toxic tokens further apart are separate passages.
DRIFT = 0.3


@dataclass
class ToxicModel:
    tokens: np.ndarray  # sorted ids of the tokens with evidence
    weights: np.ndarray  # their log-odds
    decay: float  # lambda of the extreme-value law
    slope: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0  # K of the extreme-value law
    learned: bool = False


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never read; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def token_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of the lower-cased texts, text by text, and their offsets."""
    flat, starts = flat_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    first, last, bounds = word_bounds(flat, starts, ALPHANUMERIC)
    return (hash_spans(flat, first, last) >> np.uint64(64 - TOKEN_BITS)).astype(np.int64), bounds


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, clean, toxic): labelled documents holding the token, summed over the task."""
    counts = np.zeros((2, TOKENS), dtype=np.int32)
    for batch in batches:
        for part in chunks(batch, "text"):
            ids, bounds = token_ids(part.column(1))
            for i, toxic in enumerate(part.column(0).to_pylist()):
                counts[toxic][np.unique(ids[bounds[i] : bounds[i + 1]])] += 1
    some = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(some), 50_000):
        s = some[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(counts[0][s].astype(np.int64)), pa.array(counts[1][s].astype(np.int64))], names=["token", "clean", "toxic"])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, found in one linear scan.

    Every segment has a positive score, no extension and no part of it scores more.
    """
    held: list[list] = []  # start, end, total before it, total with it, number of the last one to the left with a lower total before it
    total = 0.0
    for at in range(len(scores)):
        value = float(scores[at])
        before, total = total, total + value
        if value <= 0:
            continue
        new = [at, at + 1, before, total]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]  # those in between have higher totals still
            if j < 0 or held[j][3] >= new[3]:
                held.append([*new, j])
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            j, to = held[j][4], j
            del held[to:]
    return [(s, e, b - a) for s, e, a, b, _ in held]


def _compressed(values: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence tokens with one loss entry for each gap between them, and the place of each entry."""
    gaps = np.diff(where) - 1
    out, place = np.empty(2 * len(where) - 1), np.empty(2 * len(where) - 1, dtype=np.int64)
    out[0::2], out[1::2] = values, -DRIFT * gaps
    place[0::2], place[1::2] = where, where[:-1] + 1
    return out, place


def _scanner(model: ToxicModel):
    """Rows (doc_id, n_tokens, best, starts, ends, gains): every passage as a span of tokens, best passage first in ``best``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.zeros(TOKENS, dtype=np.float64)
        value[model.tokens] = model.weights
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, bounds = token_ids(part.column(1))
                all_values = value[ids]
                evident = np.flatnonzero(all_values)
                own = np.searchsorted(evident, bounds)
                found = []
                for i in range(part.num_rows):
                    where = evident[own[i] : own[i + 1]]
                    if not len(where):
                        found.append([])
                        continue
                    scores, place = _compressed(all_values[where], where - bounds[i])
                    found.append([(int(place[s]), int(place[e - 1]) + 1, g) for s, e, g in segments(scores)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(bounds)), pa.array([max((g for *_, g in f), default=0.0) for f in found], pa.float64()),
                        pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[e for _, e, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[g for *_, g in f] for f in found], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "n_tokens", "best", "starts", "ends", "gains"],
                )

    return run


def learn_tokens(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Log-odds of tokens between toxic and clean labelled documents, with their Dirichlet prior, over all of them."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter(~held_out())
    if runtime.planned_bytes(labels) * 8 <= runtime.BROADCAST_BYTES:
        marks = F.broadcast(marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, "doc_id").select("toxic", "text")
    counts = rows.mapInArrow(_token_counts, "token long, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("y0"), F.sum("toxic").alias("y1"))
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(counts, "tokens")
    n0, n1, v = table.agg(F.sum("y0"), F.sum("y1"), F.count("*")).first()
    if not n0 or not n1:
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 1.0)
    odds = lambda y, n: F.log((F.col(y) + PRIOR) / (n + v * PRIOR - F.col(y) - PRIOR))
    scored = table.select(
        "token", "y0", (odds("y1", n1) - odds("y0", n0)).alias("delta"), F.sqrt(1 / (F.col("y1") + PRIOR) + 1 / (F.col("y0") + PRIOR)).alias("error")
    ).filter(F.abs("delta") >= LEAST_Z * F.col("error"))
    kept = sorted(scored.collect())  # at most TOKENS rows of a few numbers
    scratch.drop(table)
    weights = np.array([r.delta for r in kept])
    chance = np.array([(r.y0 + PRIOR) / (n0 + v * PRIOR) for r in kept])
    return ToxicModel(np.array([r.token for r in kept], np.int64), weights, _decay(weights, chance), learned=True)


def _decay(weights: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of E[exp(x score)] = 1 over the tokens of clean text."""
    if not (weights > 0).any():
        return 1.0
    rest = max(0.0, 1.0 - chance.sum())
    excess = lambda x: float((chance * np.exp(np.minimum(x * weights, 500))).sum() + rest * np.exp(-DRIFT * x) - 1)
    low, high = 1e-3, 1e-3
    while excess(high) < 0 and high < 100:
        low, high = high, high * 1.5
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def chances(gains: np.ndarray, n_tokens: int, model: ToxicModel) -> np.ndarray:
    """For every r, -log of the chance that a clean text of this length has r passages as good as the r best of ``gains`` (in falling order).

    By chance the number of passages that gain x or more is Poisson with the mean K n exp(-lambda x). Its tail from r on is
    at most the first term over 1 - mean / (r + 1). As the best r is looked for, r has the share 1 / (r (r + 1)) of
    all chance. Many moderate passages count this way, though each one alone may be expected by chance.
    """
    r = np.arange(1, len(gains) + 1, dtype=float)
    log_mean = np.log(max(model.scale * n_tokens, 1e-300)) - model.decay * gains
    mean = np.exp(np.minimum(log_mean, 700.0))
    some = mean < r
    tail = r * log_mean - mean - np.cumsum(np.log(r)) - np.log1p(-np.where(some, mean, 0.0) / (r + 1))
    return np.where(some, np.maximum(0.0, -tail - np.log(r * (r + 1))), 0.0)


def _judge(model: ToxicModel):
    """Rows (doc_id, n_tokens, evidence, starts, ends, gains): the best chance over all r, and the significant passages in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, kept = np.zeros(batch.num_rows), []
            lists = [batch.column(k) for k in (2, 3, 4)]
            for i, n in enumerate(batch.column(1).to_pylist()):
                starts, ends, gains = (np.asarray(c[i].values) for c in lists)
                order = np.argsort(-gains, kind="stable")
                log = chances(gains[order], n, model)
                evidence[i] = log.max(initial=0.0)
                sure = np.flatnonzero(log >= -np.log(LEVEL))
                own = np.sort(order[: sure[-1] + 1]) if len(sure) else order[:0]
                kept.append((starts[own], ends[own], gains[own]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(evidence), pa.array([s for s, _, _ in kept], pa.list_(pa.int64())),
                    pa.array([e for _, e, _ in kept], pa.list_(pa.int64())), pa.array([g for *_, g in kept], pa.list_(pa.float64())),
                ],
                names=["doc_id", "n_tokens", "evidence", "starts", "ends", "gains"],
            )

    return run


def significant_passages(passages: DataFrame, model: ToxicModel) -> DataFrame:
    """``toxic_passages`` rows as (doc_id, n_tokens, evidence, starts, ends, gains) with the significant passages only.

    ``evidence`` is made of all passages, the -log of the chance to find the r best ones in a clean text for the best r.
    """
    columns = ["doc_id", "n_tokens", "starts", "ends", "gains"]
    return passages.select(*columns).mapInArrow(_judge(model), "doc_id long, n_tokens long, evidence double, starts array<long>, ends array<long>, gains array<double>")


def calibrate(scanned: DataFrame, labels: DataFrame, model: ToxicModel) -> ToxicModel:
    """Fit K on clean labelled texts and the slope from evidence to probability on all labelled texts, from a histogram."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = scanned.select("doc_id", "best", "n_tokens").join(marks.filter(~held_out()), "doc_id")
    law = known.filter("toxic = 0 and best > 0").agg(F.avg(F.col("best") * model.decay - F.log("n_tokens")).alias("m")).first().m
    model.scale = float(np.exp(min(max((law if law is not None else 0.0) - 0.5772, -20.0), 20.0))) if law is not None else 1.0
    judged = significant_passages(scanned, model).select("doc_id", "evidence").join(marks.filter(~held_out()), "doc_id")
    cells = judged.groupBy("toxic", F.least(F.round(F.col("evidence") * 4), F.lit(400)).alias("cell")).count().collect()
    x, y, n = (np.array(c, dtype=float) for c in zip(*[(r.cell / 4, r.toxic, r["count"]) for r in cells]))
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(n * (y - p)).sum() - 1e-3 * a, (n * (y - p) * x).sum() - 1e-3 * b])
        q = n * p * (1 - p)
        h = np.array([[q.sum() + 1e-3, (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    model.slope = (float(a), float(b))
    return model


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, n_tokens, best, starts, ends, gains) of every whole text of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanner(model), "doc_id long, n_tokens long, best double, starts array<long>, ends array<long>, gains array<double>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages), one row for each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` of rows that are not held out; a document with several labels is toxic if
    one says so, null labels and ids say nothing. ``n_passages`` counts the significant passages. Null and empty texts hold no passage and score as such. Without
    labels of both classes every score is 0. Other columns are ignored.
    """
    model = learn_tokens(docs, labels)
    scanned = Scratch(docs.sparkSession).keep(toxic_passages(docs, model), "passages")
    if model.learned:
        model = calibrate(scanned, labels, model)
    a, b = model.slope
    score = 1 / (1 + F.exp(-(a + b * F.col("evidence")))) if model.learned else F.lit(0.0)
    judged = significant_passages(scanned, model)
    return judged.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("gains").alias("n_passages"))
