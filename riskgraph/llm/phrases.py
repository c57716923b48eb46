"""Phrase collocations: counts of padded longest windows, marginalised by ROLLUP, and a cohesion score of the weakest cut.

1. Words are counted for each language. A word of a language is named by a 64-bit hash from here on; the count groups by hash and
   keeps the least and the greatest word of it, so two words with one hash are noticed, and the next seed is taken.
2. No frequent phrase holds a rare word, pair or triple. Bit sets of fixed size tell frequent ones apart: those of the words, then, by
   counting keys of neighbours that may still be frequent, those of pairs and triples. A chance hit only lets a rare one through.
3. Every frequent word opens one window of ``LONGEST`` lead columns, padded where the piece ends or nothing frequent follows. Windows
   are counted, and a ROLLUP over their columns gives every shorter phrase its count as a prefix of longer windows.
4. Cuts, containment and ranks work on the frequent phrases alone, with decimal arithmetic where 64 bits might not do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgraph.llm.scratch import Scratch
from riskgraph.llm.words import chunks, flat_bytes, hash_spans, keys, lowered, mix, word_bounds

LEAST, TOP = 30, 2000
LONGEST = 4
COVER_PERCENT = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Sizes of the bit sets of frequent words, pairs and triples: one and twice eight megabytes, whatever the corpus.
BITS = (1 << 23, 1 << 26, 1 << 26)
#: Neighbours are counted by keys of 40 bits; two with one key are counted together, which only lets them through more easily.
_KEY_SHIFT = 24
_BLOCK_BITS = 1 << 15  # of Spark's bitmap functions
_CHUNK = 1 << 20
_SALTS = 64
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
KEY = ["lang", *_WORDS]

_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_IS_WORD = ~_PIECE_END
_IS_WORD[[0x20, 0x09]] = False
_MIXERS = keys(1201, LONGEST + 2)


def _substitution(seed: int) -> np.ndarray:
    """A permutation of the byte values, so that each seed hashes words anew."""
    return np.argsort(keys(1300 + seed, 256)).astype(np.uint8)


def _words(part: pa.RecordBatch, seed: int):
    """Flat bytes, word bounds, hashes of words in their language (never 0), languages, and whether the next word is in the same piece."""
    flat, starts = flat_bytes(part.column(1))
    flat = lowered(flat)
    first, last, bounds = word_bounds(flat, starts, _IS_WORD)
    langs = pc.dictionary_encode(part.column(0))
    text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    lang = np.asarray(langs.indices).astype(np.int64)[text]
    piece = np.cumsum(_PIECE_END[flat])[first] if len(first) else first
    joined = np.zeros(len(first), dtype=bool)
    joined[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    hashes = hash_spans(_substitution(seed)[flat], first, last)
    if len(hashes):
        hashes = mix(hashes ^ mix(hash_spans(*_all_spans(langs.dictionary)) + np.uint64(7))[lang])
        hashes[hashes == 0] = 1
    return flat, first, last, hashes, lang, langs.dictionary, joined


def _all_spans(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # A leading byte keeps an empty name from being an empty span.
    flat, starts = flat_bytes(pc.binary_join_element_wise("=", names.cast(pa.string()), ""))
    return flat, starts[:-1], starts[1:]


def _grouped(order_key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted row order and where groups of equal columns start in it; a clash of order keys only makes more groups."""
    order = np.argsort(order_key, kind="stable")
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def _word_counter(seed: int):
    """Rows (lang, h, word, n); if two words share a hash, rows with both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                flat, first, last, hashes, lang, names, _ = _words(part, seed)
                if not len(first):
                    continue
                order, heads = _grouped(hashes, [hashes, lang])
                counts = np.diff(np.append(heads, len(order)))
                lead = order[heads]
                same = _equal_spans(flat, first, last, order, np.repeat(lead, counts))
                odd = np.flatnonzero(~same)
                shown = np.concatenate([lead, order[odd]])
                text = flat.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(lang[shown])), pa.array(hashes[shown].view(np.int64)),
                        pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(first[shown].tolist(), last[shown].tolist())], pa.string()),
                        pa.array(np.concatenate([counts, np.zeros(len(odd), np.int64)])),
                    ],
                    names=["lang", "h", "word", "n"],
                )

    return run


def _equal_spans(flat: np.ndarray, first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of words whether their bytes are equal."""
    sizes = (last - first)[a]
    same = sizes == (last - first)[b]
    sizes = np.where(same, sizes, 1)
    heads = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(heads, sizes)
    differs = flat[np.repeat(first[a], sizes) + place] != flat[np.repeat(first[b], sizes) + place]
    return same & ~np.logical_or.reduceat(differs, heads)


def _runs(part: pa.RecordBatch, seed: int, sets: list[bytes]):
    """Hashes, languages, whether each word opens a frequent run of 1, 2 .. words, then keys and validity of runs one word longer."""
    *_, hashes, lang, names, joined = _words(part, seed)
    key, valid, frequent = hashes, np.ones(len(hashes), dtype=bool), []
    for size, packed in enumerate(sets, 1):
        at = (key >> np.uint64(_KEY_SHIFT) & np.uint64(BITS[size - 1] - 1)).astype(np.int64)
        often = valid & (np.frombuffer(packed, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        frequent.append(often)
        valid = often & joined
        valid[:-1] &= often[1:]
        after = np.zeros_like(hashes)
        after[: max(len(hashes) - size, 0)] = hashes[size:]
        key = mix(key * _MIXERS[size] ^ after)
    return hashes, lang, names, frequent, key, valid


def _run_counter(seed: int, sets: list[bytes]):
    """Rows (key, n): runs that are one word longer than the last bit set's and hold nothing rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                *_, key, valid = _runs(part, seed, sets)
                found, n = np.unique(key[valid] >> np.uint64(_KEY_SHIFT), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _window_counter(seed: int, sets: list[bytes]):
    """Rows (lang, w1 .. , n): the padded (0) longest window at each frequent word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                hashes, lang, names, frequent, _, longest = _runs(part, seed, sets)
                at = np.flatnonzero(frequent[0])
                if not len(at):
                    continue
                columns = [hashes[at]]
                for k, opens in enumerate([*frequent[1:], longest], 1):
                    columns.append(np.where(opens[at], hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0)))
                key = lang[at].astype(np.uint64) * _MIXERS[0]
                for c, m in zip(columns, _MIXERS[1:]):
                    key = mix(key ^ c) * m
                order, heads = _grouped(key, [*columns, lang[at]])
                lead = order[heads]
                counts = np.diff(np.append(heads, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang[at][lead])), *[pa.array(c[lead].view(np.int64)) for c in columns], pa.array(counts)],
                    names=[*KEY, "n"],
                )

    return run


def word_table(texts: DataFrame, scratch: Scratch, least: int, seed: int) -> DataFrame:
    """(lang, h, n, word, clash): every word of each language; only words of ``least`` occurrences are spelled out."""
    counted = texts.mapInArrow(_word_counter(seed), "lang string, h long, word string, n long")
    grouped = counted.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("word").alias("lo"), F.max("word").alias("hi"))
    return scratch.keep(
        grouped.select("lang", "h", "n", F.when(F.col("n") >= least, F.col("lo")).alias("word"), (F.col("lo") != F.col("hi")).alias("clash")), "words"
    )


def bit_set(keys_: DataFrame, size: int) -> bytes:
    """The set of ``key`` modulo ``size`` as bits, built in parts of 4 KB by Spark: ``size / 8`` bytes at most reach the driver."""
    number = F.col("key").bitwiseAND(F.lit(size - 1)) + 1
    rows = keys_.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = bytearray(size // 8)
    for r in rows.toLocalIterator():
        at = (r["part"] - 1) * (_BLOCK_BITS // 8)
        out[at : at + _BLOCK_BITS // 8] = r["bits"]
    return bytes(out)


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(lang, w1 .. w4, len, f): all phrases of 1 to 4 words that occur ``least`` times, from counted longest windows.

    ROLLUP sums the windows over ever shorter prefixes; what a prefix that ends in padding counts is dropped.
    """
    summed = windows.rollup(*KEY).agg(F.sum("n").alias("f"), F.grouping_id().alias("_g"))
    size = LONGEST - F.bit_count("_g")
    last = F.element_at(F.array(*_WORDS), size.cast("int"))
    kept = summed.filter((F.col("f") >= least) & (F.col("_g") < (1 << LONGEST) - 1)).filter(last != 0)
    return kept.select("lang", *[F.coalesce(w, F.lit(0)).alias(w) for w in _WORDS], size.cast("int").alias("len"), "f")


def _shifted(start: Column | int, size: Column | int) -> list[Column]:
    """The key words of the part of a phrase that begins at word ``start`` (0-based) and has ``size`` words."""
    words = F.array(*_WORDS)
    start, size = (F.lit(x) if isinstance(x, int) else x for x in (start, size))
    return [F.when(F.lit(k) < size, F.get(words, start + k)).otherwise(F.lit(0).cast("long")) for k in range(LONGEST)]


def weakest_cuts(grams: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, w1 .. w4, len, a, l, r, score) for each phrase of two or more words: its lowest-scoring cut, ties to the first."""
    cuts = grams.filter("len > 1").withColumn("k", F.explode(F.expr("sequence(1, len - 1)")))
    for side, (start, size) in {"_l": (0, F.col("k")), "_r": (F.col("k"), F.col("len") - F.col("k"))}.items():
        cuts = cuts.withColumns({f"{side}{i}": c for i, c in enumerate(_shifted(start, size))})
    for side, name in (("_l", "l"), ("_r", "r")):
        part = grams.select("lang", *[F.col(w).alias(f"{side}{i}") for i, w in enumerate(_WORDS)], F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", *[f"{side}{i}" for i in range(LONGEST)]]).drop(*[f"{side}{i}" for i in range(LONGEST)])
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(f as {wide}) * cast({scale} as decimal(10,0))) div (cast(l as {wide}) + cast(r as {wide}))")
    best = cuts.withColumn("score", score.cast("long")).groupBy(*KEY, "len", F.col("f").alias("a")).agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select(*KEY, "len", "a", "_b.l", "_b.r", "_b.score")


def uncovered(phrases: DataFrame, grams: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """``phrases`` without those that lie inside a longer one of ``percent`` of their occurrences or more."""
    inner = [(s, n, size) for n in range(3, LONGEST + 1) for size in range(2, n) for s in range(n - size + 1)]
    parts = F.filter(
        F.array(*[F.when(F.col("len") == n, F.struct(*[c.alias(w) for c, w in zip(_shifted(s, size), _WORDS)])) for s, n, size in inner]),
        lambda p: p.isNotNull(),
    )
    covers = grams.filter("len > 2").select("lang", "f", F.explode(parts).alias("p")).groupBy("lang", *[F.col(f"p.{w}").alias(w) for w in _WORDS]).agg(F.max("f").alias("_cover"))
    wide = "decimal(20,0)"
    covered = F.expr(f"cast(_cover as {wide}) * 100 >= cast(a as {wide}) * {percent}")
    return phrases.join(covers, KEY, "left").filter(~F.coalesce(covered, F.lit(False))).drop("_cover")


def leading(df: DataFrame, group: str, order: list[Column], top: int, ranked, name: str = "rank", salt: list[str] = KEY) -> DataFrame:
    """The rows ranked ``top`` or better in each group; ``_SALTS`` parts of a group are ranked before the whole one."""
    part = W.partitionBy(group, "_salt").orderBy(*order)
    some = df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(_SALTS))).withColumn("_r", ranked.over(part)).filter(F.col("_r") <= top)
    return some.drop("_salt", "_r").withColumn(name, ranked.over(W.partitionBy(group).orderBy(*order))).filter(F.col(name) <= top)


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the most cohesive phrases of each language of ``docs(lang, text)``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks and into words at blanks and tabs. Counts
    are over all whole texts: ``n`` all words, ``a`` all places of the phrase inside pieces, overlaps included. A null
    language is ``und``; null, empty and blank texts have no words. Repeated rows count again. Ties are decided as the
    order says, so the result is a single one. A language without a phrase has no row. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    seed = 0
    words = word_table(texts, scratch, least, seed)
    while not words.filter("clash").isEmpty():
        scratch.drop(words)
        seed += 1
        words = word_table(texts, scratch, least, seed)
    sets = [bit_set(words.filter(F.col("word").isNotNull()).select(F.shiftrightunsigned("h", _KEY_SHIFT).alias("key")), BITS[0])]
    for size in BITS[1:]:
        runs = texts.mapInArrow(_run_counter(seed, list(sets)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        sets.append(bit_set(runs.filter(F.col("n") >= least), size))
    windows = texts.mapInArrow(_window_counter(seed, list(sets)), ", ".join(["lang string", *[f"{w} long" for w in _WORDS], "n long"]))
    grams = scratch.keep(phrase_counts(windows, least), "grams")
    phrases = uncovered(weakest_cuts(grams), grams)
    by_numbers = [F.col("score").desc(), F.col("a").desc()]
    near_top = leading(phrases, "lang", by_numbers, top, F.rank())
    spelled = words.filter(F.col("word").isNotNull()).select("lang", "h", "word")
    parts = near_top.drop("rank").select("*", F.posexplode(F.filter(F.array(*_WORDS), lambda w: w != 0)).alias("_at", "h"))
    whole = (
        parts.join(spelled, ["lang", "h"]).groupBy(*KEY, "a", "l", "r", "score")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    )
    ranked = leading(whole, "lang", [*by_numbers, F.col("phrase").asc()], top, F.row_number())
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
