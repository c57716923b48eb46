"""Identifiers: trimming, canonical keys, surrogate keys and canonical hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The characters that count as whitespace at the ends of a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean(value) -> Column:
    """Strip every kind of surrounding whitespace."""
    return F.btrim(_column(value), F.lit(WHITESPACE))


def canonical_key(value, numeric: bool = False) -> Column:
    """Identifier text; empty is NULL. With ``numeric`` an integral number loses its decimals; exponents are text."""
    text = clean(value)
    if numeric:
        text = F.when(text.rlike(r"^-?[0-9]+\.0*$"), F.substring_index(text, ".", 1)).otherwise(text)
    return F.nullif(text, F.lit(""))


def prefixed(prefix: str, *parts) -> Column:
    """``prefix:part:part``; NULL when any part is NULL."""
    pieces: list[Column] = [F.lit(prefix)]
    for part in parts:
        pieces += [F.lit(":"), _column(part).cast("string")]
    return F.concat(*pieces)


def surrogate(prefix: str, text) -> Column:
    """``prefix:`` and the first 24 hex digits of the sha256 of the text."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(_column(text), 256), 1, 24))


def json_list_text(parts: Sequence) -> Column:
    """JSON text of a list of strings with ``", "`` between elements."""
    quoted = [
        F.regexp_extract(F.to_json(F.array(_column(p))), r"(?s)^\[(.*)\]$", 1) for p in parts
    ]
    return F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))


def canonical_hash(fields: dict[str, Column | str]) -> Column:
    """sha256 of the compact JSON object with keys in sorted order."""
    record = F.struct(*[_column(fields[name]).alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def digits_or_null(value) -> Column:
    """Integer when the trimmed text is all digits, otherwise NULL."""
    text = clean(value)
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def sentinel_to_null(value, sentinel: str) -> Column:
    """Digits-only integer with one text value standing for "not known"."""
    return F.when(clean(value) != sentinel, digits_or_null(value))


def decode_label(value, labels: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _column(value)), F.lit(default))
