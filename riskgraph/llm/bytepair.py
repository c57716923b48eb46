"""Byte-level BPE over Arrow batches: ids, character spans, and the way back to bytes.

A vocabulary is a file of ranks (base64 bytes, rank). Each byte is mapped to a printable character, so that the tokenizers
library can work on strings; the token made by the pair of lowest rank is merged first. All pairs that make up a known token
are merges, in the order of its rank, and a match that is itself a token stays whole, as with a rank table alone.

The tokenizers library cuts texts into matches of the vocabulary's pattern. A pattern of this family never lets a match run from
other characters into white space, so a blank behind anything but white space begins a match: texts fall apart there into units
(about a word each), and a unit is encoded once as long as a Python worker keeps it (``KEPT`` units at most). Very long texts
are worked on in parts of about ``CUT`` characters that end at such a place too. No rows are shuffled.
"""

from __future__ import annotations

import base64
import os
import re
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskgraph.llm.words import chunks

CUT = 1 << 20
#: Units whose ids a Python worker keeps, and the longest unit that is kept.
KEPT, KEPT_CHARS = 1 << 18, 64
_SAFE = re.compile(r"(?<=[!-~])(?= )")
_WIDE = re.compile(r"\s ")
#: Bytes that are shown as the character of the same number; the others follow from 256 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    shown = {b: chr(b) for b in _VISIBLE}
    hidden = iter(range(0x100, 0x200))
    return [shown[b] if b in shown else chr(next(hidden)) for b in range(256)]


@dataclass
class Vocabulary:
    tokenizer: object  # of the tokenizers library
    flat: np.ndarray  # the bytes of all tokens in a row
    starts: np.ndarray  # where each id's bytes start (n + 1 offsets); an unused id has none
    known: np.ndarray  # which ids exist


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file of ranks, loaded once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    names = byte_characters()
    spelled = {token: "".join(names[b] for b in token) for token in ranks}
    ordered = sorted(ranks, key=ranks.get)
    merges = [
        (spelled[token[:k]], spelled[token[k:]])
        for token in ordered for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
    ]
    bpe = models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
    tokenizer = Tokenizer(bpe)
    matches, mapped = pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([matches, mapped])
    back = {c: b for b, c in enumerate(names)}
    sizes, known = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, bool)
    parts = []
    for token in ordered:
        i = tokenizer.token_to_id(spelled[token])
        parts.append(bytes(back[c] for c in tokenizer.id_to_token(i)))
        sizes[i], known[i] = len(parts[-1]), True
    return Vocabulary(tokenizer, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), known)


class _Encoder:
    """Encodes texts; keeps the packed ids (and character spans) of frequent units.

    A unit is a stretch of whole matches. ``after_blank`` holds units by the text behind their leading blank.
    """

    def __init__(self, words: Vocabulary, spans: bool):
        self.words, self.spans = words, spans
        self.plain, self.after_blank, self.places = {}, {}, {}

    def units(self, text: str) -> tuple[list[str], list[str]]:
        """The text as plain units, then units after a blank: a blank behind anything but white space begins a match."""
        if _WIDE.search(text):
            return _SAFE.split(text), []
        first, *others = text.split(" ")
        return [first], others

    def look_up(self, units: set[str], kept: dict[str, bytes], blank: str) -> dict[str, bytes]:
        """Packed ids for each unit; units above ``KEPT_CHARS`` are returned but not kept."""
        if len(kept) > KEPT:
            for u in kept:
                self.places.pop(blank + u, None)
            kept.clear()
        new = [u for u in units if u not in kept]
        encode = self.words.tokenizer.encode_batch if self.spans else self.words.tokenizer.encode_batch_fast
        made = encode([blank + u for u in new], add_special_tokens=False)
        ids = [e.ids for e in made]
        ends = np.cumsum([len(i) for i in ids], dtype=np.int64).tolist()
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        found = {u: packed[4 * a : 4 * b] for u, a, b in zip(new, [0, *ends], ends)}
        if self.spans:
            self.places.update((blank + u, np.array(e.offsets, np.int64).reshape(-1, 2)) for u, e in zip(new, made))
        long = {u: v for u, v in found.items() if len(u) > KEPT_CHARS}
        kept.update(found if not long else {u: v for u, v in found.items() if u not in long})
        return ChainMap(kept, long) if long else kept

    def parts(self, texts: list[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """(text, first character, plain units, units after a blank) of all texts; long texts come in parts."""
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                safe = _SAFE.search(text, at + CUT) if len(text) - at > CUT else None
                end = safe.start() if safe else len(text)
                yield i, at, *self.units(text[at:end])
                at = end

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """Packed ids of each text and, if asked for, its spans as pairs."""
        ids, spans = [[] for _ in texts], [[] for _ in texts]
        held, n = [], 0
        for part in chain(self.parts(texts), [None]):
            if part:
                held.append(part)
                n += len(part[2]) + len(part[3])
            if held and (part is None or n >= KEPT):
                plain = self.look_up(set(chain.from_iterable(p for _, _, p, _ in held)), self.plain, "")
                after = self.look_up(set(chain.from_iterable(b for *_, b in held)), self.after_blank, " ")
                for i, at, first, others in held:
                    ids[i] += map(plain.__getitem__, first)
                    ids[i] += map(after.__getitem__, others)
                    if self.spans:
                        for unit in chain(first, (f" {u}" for u in others)):
                            spans[i].append(self.places[unit] + at)
                            at += len(unit)
                if len(self.places) > 2 * KEPT:
                    self.places = {u: p for u, p in self.places.items() if u in self.plain or u[:1] == " " and u[1:] in self.after_blank}
                held, n = [], 0
        none = np.zeros((0, 2), np.int64)
        return [b"".join(x) for x in ids], [np.concatenate(x) if x else none for x in spans]


def _encoder(path: str, pattern: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary(path, pattern), spans)
        for batch in batches:
            for part in chunks(batch):
                texts = [b"" if t is None else t for t in part.column(1).cast(pa.binary()).to_pylist()]
                ids, places = encoder.encode([t.decode("utf-8", "replace") for t in texts])
                columns = [part.column(0), pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array(ids, pa.binary())]
                if spans:
                    columns += [pa.array([p[:, k] for p in places], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "starts", "ends"][: len(columns)])

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, *, spans: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, starts, ends]): the tokens of each whole text of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit numbers in a row, the form of a flat token file. With ``spans`` the code
    points that each token touches come along; tokens that share a character's bytes have the same span. A null text is an
    empty one, without tokens. Bytes that aren't UTF-8 are read as U+FFFD. Rows are independent: repeated rows and null ids
    stay. Other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids binary" + (", starts array<long>, ends array<long>" if spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoder(path, pattern, spans), schema)


def token_bytes(words: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of all tokens in a row, gathered a million ids at a time; an unknown id is an error."""
    if len(ids) and (ids.max() >= len(words.known) or not words.known[ids].all()):
        raise ValueError("token id outside the vocabulary")
    out = []
    for i in range(0, len(ids), CUT):
        some = ids[i : i + CUT].astype(np.int64)
        sizes = words.starts[some + 1] - words.starts[some]
        heads = np.cumsum(sizes) - sizes
        out.append(words.flat[np.repeat(words.starts[some] - heads, sizes) + np.arange(sizes.sum())].tobytes())
    return b"".join(out)


def cut_ends(data: bytes) -> tuple[int, int]:
    """How many bytes at the start and at the end belong to characters that lie only partly in ``data``."""
    head = 0
    while head < min(3, len(data)) and 0x80 <= data[head] < 0xC0:
        head += 1
    for back in range(1, min(3, len(data) - head) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            size = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2
            return head, back if size > back else 0
        if lead < 0x80:
            break
    return head, 0


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for part in chunks(batch, "ids"):
                data = [token_bytes(words, np.frombuffer(p or b"", "<u4")) for p in part.column(2).to_pylist()]
                cuts = [cut_ends(d) for d in data]
                texts = [d[a : len(d) - b].decode("utf-8", "replace") for d, (a, b) in zip(data, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2), pa.array(data, pa.binary()), pa.array(texts, pa.string()),
                        pa.array([a for a, _ in cuts], pa.int32()), pa.array([b for _, b in cuts], pa.int32()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded", "text", "head", "tail"],
                )

    return run


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, text, head, tail): the way back from ``encoded(doc_id, n_tokens, ids)``.

    ``decoded`` are the bytes of all tokens. A block cut out of a longer row of tokens may begin or end inside a character:
    ``head`` and ``tail`` count such bytes, and ``text`` is what lies between them. Null ``ids`` are no tokens; an id
    outside the vocabulary is an error.
    """
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    return rows.mapInArrow(_decoder(path, pattern), "doc_id long, n_tokens long, ids binary, decoded binary, text string, head int, tail int")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes they decode to."""
    back = decode_ids(encode_texts(docs, path, pattern), path, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
