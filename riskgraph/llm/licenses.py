"""License scans: phrases by Aho-Corasick over whole words, licence expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of widely used licences and their identifiers.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "no rights reserved": "public-domain",
}
TAG = "spdx license identifier"
# How freely a text under a label may be reused; a label is rated by its longest listed prefix.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.9, "cc-by": 0.9, "mpl": 0.6,
    "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "reserved": 0.0,
}
_OTHER = 0.1

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))
_TAG = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:-]+))")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def _automaton():
    trie = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: None}:
        trie.add_word(f" {phrase} ", phrase)
    trie.make_automaton()
    return trie


def to_postfix(expression: str) -> list[str]:
    """The longest valid start of a licence expression in postfix order; [] if none is valid.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; operators are read in either case.
    """
    out, stack, best, operand, at = [], [], [], False, 0
    while m := _TOKEN.match(expression, at):
        bracket, word = m.group(1), m.group(2)
        name = word.lower() if word else bracket
        if name == "(" and not operand:
            stack.append(name)
        elif name == ")" and operand and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        elif name in _STRENGTH and operand:
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[name]:
                out.append(stack.pop())
            stack.append(name)
            operand = False
        elif word and name not in _STRENGTH and not operand:
            out.append(name)
            operand = True
        else:
            break
        if operand and "(" not in stack:
            best = out + stack[::-1]
        at = m.end()
    return best


def freedom(label: str) -> float:
    known = [k for k in FREEDOM if label == k or label.startswith(f"{k}-")]
    return FREEDOM[max(known, key=len)] if known else _OTHER


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of an expression and its freedom: the best choice of ``or``, the strictest part of ``and``."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _STRENGTH:
            stack.append(({token}, freedom(token)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if token == "with":  # an exception belongs to its licence and loosens it a little
            stack.append(({f"{a} with {b}" for a in left for b in right}, min(1.0, l + 0.1)))
        else:
            stack.append((left | right, max(l, r) if token == "or" else min(l, r)))
    return stack[0] if stack else (set(), 1.0)


def scan_text(text: str, trie) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of one text."""
    words = text.encode("utf-8", "replace").translate(_TO_WORDS).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    starts, base, labels, parts, word, at, tagged = [], set(), set(), [], 0, 0, False
    n_base = 0
    for end, phrase in sorted(((e, p) for e, p in trie.iter(line)), key=lambda m: (m[0] - len(m[1]), m[1])):
        begin = end - len(phrase) - 1
        word += line.count(" ", at, begin)
        at = begin
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE:
            n_base += 1
            base.add(BASE[phrase])
            starts.append(word)
        label = NOTICES.get(phrase) or BASE[phrase]
        labels.add(label)
        parts.append(freedom(label))
    for m in _TAG.finditer(text) if tagged else ():
        more, value = evaluate(to_postfix(m.group(1)))
        labels |= more
        parts += [value] if more else []
    return (
        len(words), n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(labels)), min(parts, default=0.0),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """License findings of every whole text of ``docs(doc_id, text)``, one row for each; nothing is shuffled.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters; a phrase is found wherever its
    words stand consecutively, also inside a longer phrase. ``base_labels`` come from the base phrases, ``labels``
    also from notices and from ``SPDX-License-Identifier`` expressions. ``score`` is the freedom of reuse under all
    findings together, 0 without any. Null and empty texts have no words. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _automaton()
        for batch in batches:
            rows = [scan_text(text.as_py() or "", trie) for text in batch.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
