"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL and elastic net."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from riskgraph.llm.words import chunks, flat_bytes, keys
from riskgraph.operators.ordering import top_k_per_key

DIM_BITS = 16
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
#: Documents of each language that the weights are fitted on (the n-gram statistics cover all learning rows).
SAMPLE_PER_LANGUAGE = 1000
_SALTS = 32
_CHUNK = 1 << 18  # bytes of text at a time; their n-grams take some hundred times that
_SCALE = 32.0
_GRAM = keys(31, 8)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (DIM, languages): what one occurrence of an n-gram adds, before division by their number
    temperature: float


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of the lower-cased texts, text by text, and their offsets."""
    flat, _ = flat_bytes(low := pc.utf8_lower(pc.fill_null(texts, "")))
    chars = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.asarray(pc.utf8_length(low)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    made = np.stack([np.maximum(sizes - n + 1, 0) for n in ORDERS])
    offsets = np.concatenate([[0], np.cumsum(made.sum(axis=0))])
    out = np.empty(offsets[-1], dtype=np.int64)
    write = offsets[:-1].copy()
    for k, n in enumerate(ORDERS):
        if len(chars) < n or not made[k].any():
            continue
        run = np.full(len(chars) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            run += chars[j : len(chars) - n + 1 + j] * _GRAM[j]
        run *= _GRAM[7]
        run >>= np.uint64(64 - DIM_BITS)
        steps = np.arange(made[k].sum()) - np.repeat(np.concatenate([[0], np.cumsum(made[k])[:-1]]), made[k])
        out[np.repeat(write, made[k]) + steps] = run[np.repeat(starts[:-1], made[k]) + steps].astype(np.int64)
        write += made[k]
    return out, offsets


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): texts that hold an n-gram of the bucket, summed over the task; bucket -1 counts the texts."""
    total, texts = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        for part in chunks(batch, limit=_CHUNK):
            buckets, offsets = gram_buckets(part.column(0))
            texts += part.num_rows
            for i in range(part.num_rows):
                has = np.zeros(DIM, dtype=bool)
                has[buckets[offsets[i] : offsets[i + 1]]] = True
                total += has
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], texts), pa.int64())], names=["bucket", "n"]
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=_CHUNK):
            buckets, offsets = gram_buckets(part.column(2))
            rows = [np.unique(buckets[offsets[i] : offsets[i + 1]], return_counts=True) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([b.astype(np.int32).tobytes() for b, _ in rows], pa.binary()),
                 pa.array([c.astype(np.int32).tobytes() for _, c in rows], pa.binary())],
                names=["doc_id", "lang", "buckets", "counts"],
            )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, rounds: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02
) -> np.ndarray:
    """Weights (DIM, classes) by follow-the-regularised-leader with per-coordinate rates; ``l1`` keeps them sparse."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def leader(zi, ni):
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for turn in range(rounds):
        for k in np.random.default_rng(turn).permutation(len(rows)):
            idx, x, label = rows[k]
            zi, ni = z[idx], n[idx]
            w = leader(zi, ni)
            error = _softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            more = ni + g * g
            z[idx] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[idx] = more
    return leader(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that the weights were not fitted on (1 without such rows)."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(20.0), 60))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train_language_model(docs: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the text and lang of the rows that are not held out.

    Document frequencies cover all of them and are added up per task; the weights are fitted on the ``per_language``
    rows of each language with the smallest id hashes, a bounded sample. A fifth of it sets the temperature.
    """
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    )
    counted = learn.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, texts = np.zeros(DIM), 0
    for bucket, n in counted.collect():  # at most DIM + 1 rows
        if bucket < 0:
            texts = n
        else:
            df[bucket] = n
    idf = np.log((1 + texts) / (1 + df)) + 1.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    spread_out = learn.select("doc_id", "lang").distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(_SALTS)))
    few = top_k_per_key(spread_out, ["lang", "salt"], order, per_language).select("doc_id", "lang")  # at most _SALTS * per_language rows of a language
    ids = top_k_per_key(few, ["lang"], order, per_language).select("doc_id", "lang")
    picked = learn.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    sample = picked.mapInArrow(_sample_features, "doc_id long, lang string, buckets binary, counts binary").collect()
    languages = sorted({r.lang for r in sample})
    rows = []
    for r in sorted(sample, key=lambda r: (r.doc_id, r.lang, r.buckets)):
        idx, counts = np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)
        if len(idx):
            rows.append((idx, _SCALE * counts * idf[idx] / counts.sum(), languages.index(r.lang)))
    if not rows:
        return LanguageModel([], np.zeros((DIM, 0), dtype=np.float32), 1.0)
    fit, rest = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    w = train_ftrl(fit or rows, len(languages))
    temperature = fit_temperature(np.stack([x @ w[idx] for idx, x, _ in rest]), np.array([c for *_, c in rest])) if fit else 1.0
    return LanguageModel(languages, (_SCALE * idf[:, None] * w).astype(np.float32), temperature)


def predict_language(docs: DataFrame, model: LanguageModel, *extra: str, keep_text: bool = False) -> DataFrame:
    """(doc_id, ``extra`` columns, lang_pred, score) for every whole text; null and letterless texts are ``und`` with score 0.

    With ``keep_text`` the text comes back too, in front of ``lang_pred``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                texts = pc.fill_null(part.column(part.num_columns - 1), "")
                buckets, offsets = gram_buckets(texts)
                letters = np.asarray(pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False), dtype=bool)
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                for i in np.flatnonzero(letters) if model.languages else ():
                    own = buckets[offsets[i] : offsets[i + 1]]
                    p = _softmax(model.weights[own].sum(axis=0, dtype=np.float64) / len(own) / model.temperature)
                    names[i], scores[i] = model.languages[int(p.argmax())], min(float(p.max()), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:last], pa.array(names, pa.string()), pa.array(scores)], names=[*part.schema.names[:last], "lang_pred", "score"]
                )

    given = docs.select("doc_id", *extra, "text")
    last = None if keep_text else -1
    kinds = T.StructType(given.schema.fields[:last]).add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(run, kinds)


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs(doc_id, text, lang)``.

    Learns from the rows that are not held out and predicts all rows from their texts alone. Repeated rows are
    predicted alike; without learning rows every text is ``und``. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict_language(rows, train_language_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
