"""Token hashing vectors and literal phrase spans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.functions.numeric import bind

#: Unicode letters, digits and underscore: a word for the hashing features.
WORD = r"[\p{L}\p{N}_]+"

# The literal risk expressions of the publication rule.
RISK_PHRASES = [
    "断供", "供应中断", "停产", "减产", "破产", "违约", "短缺", "缺货", "制裁", "出口管制", "出口限制",
    "禁运", "裁员", "火灾", "罢工", "供应链中断", "交付延迟", "供应不足", "产能不足", "暂停生产",
    "关闭工厂", "生产中断", "限电", "chip shortage", "supply disruption", "export control", "sanction",
    "bankrupt", "layoff", "production halt",
]


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def word_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(WORD), F.lit(0))


def _hex_digit(digest: Column, position: int) -> Column:
    code = F.ascii(F.substring(digest, position, 1))
    return code - F.when(code >= 97, 87).otherwise(48)


def hash_bucket(digest: Column, dim: int = 64) -> Column:
    """Bucket of a token's sha256 hex digest: its first four bytes, little-endian, modulo ``dim``.

    A ``dim`` dividing 256 depends on the first byte alone.
    """
    if 256 % dim == 0:
        return F.pmod(_hex_digit(digest, 1) * 16 + _hex_digit(digest, 2), F.lit(dim))
    swapped = F.concat(*[F.substring(digest, p, 2) for p in (7, 5, 3, 1)])
    return F.pmod(F.conv(swapped, 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hash_sign(digest: Column) -> Column:
    """+1 when the fifth sha256 byte is odd, otherwise -1."""
    return F.when(_hex_digit(digest, 10).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)


def signed_hash_dense(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Signed token hashing vector of each text as ``ARRAY<DOUBLE>``, divided by max(norm, 1).

    Computed inside the row, so nothing is shuffled and rows that repeat a key stay rows of their own. Every word
    becomes a code, its bucket and above ``dim`` the same for positive words; in the sorted codes, with each code put
    in once more, neighbouring first places differ by the count of a code. A text without words has the zero vector.
    """
    digests = F.transform(F.coalesce(word_tokens(text), F.array().cast("array<string>")), lambda w: F.sha2(w, 256))
    codes = F.transform(digests, lambda d: hash_bucket(d, dim) + F.when(hash_sign(d) == 1, dim).otherwise(0))
    marks = F.sequence(F.lit(0), F.lit(2 * dim))
    places = bind(F.sort_array(F.concat(codes, marks)), lambda own: F.transform(marks, lambda c: F.array_position(own, c)))

    def signed(first: Column) -> Column:
        count = lambda c: F.get(first, c + 1) - F.get(first, c)
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: count(b + dim) - count(b))

    def scaled(raw: Column) -> Column:
        square = F.aggregate(raw, F.lit(0).cast("bigint"), lambda acc, v: acc + v * v)
        return bind(F.greatest(F.sqrt(square.cast("double")), F.lit(1.0)), lambda size: F.transform(raw, lambda v: v / size))

    return df.select(key, bind(bind(places, signed), scaled).alias("vector"))


def signed_hash_sparse(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Non-zero entries ``(key, bucket, value)`` of the same vector."""
    return (
        signed_hash_dense(df, key, text, dim)
        .select(key, F.posexplode_outer("vector").alias("bucket", "value"))  # plain posexplode would filter by a second vector
        .filter(F.col("value") != 0)
    )


def phrase_pattern(phrases: Sequence[str]) -> str:
    """Case-insensitive alternation of literal phrases, in the given order of preference."""
    return "(?iu)" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", p) for p in phrases)


#: Matches whose offsets are added up together; appending to a longer array would copy it once a match.
SPAN_CHUNK = 64


def phrase_spans(df: DataFrame, text: str, phrases: Sequence[str] = RISK_PHRASES) -> DataFrame:
    """One row per literal phrase occurrence: ``phrase, span_start, span_end`` in code points.

    The text is split once and its matches are taken once; offsets are prefix sums of the lengths of the pieces, first over
    chunks of ``SPAN_CHUNK`` matches, then inside each chunk, so that the work stays in proportion to the matches of a text.
    Texts without a match, null and empty ones have no row.
    """
    pattern = phrase_pattern(phrases)
    own = df.columns
    pieces = F.arrays_zip(
        F.split(_column(text), pattern, -1).alias("gap"),
        F.regexp_extract_all(_column(text), F.lit(pattern), F.lit(0)).alias("phrase"),
    )
    matches = F.filter(pieces, lambda piece: piece["phrase"].isNotNull())
    size = lambda piece: F.char_length(piece["gap"]) + F.char_length(piece["phrase"])
    # Each generator hands on values that are computed once, although the next step uses them more than once.
    matched = df.select("*", F.inline(F.array(F.struct(matches.alias("_matches")))))
    firsts = F.sequence(F.lit(1), F.greatest(F.size("_matches"), F.lit(1)), F.lit(SPAN_CHUNK))
    chunked = matched.select(
        *own, F.inline(F.array(F.struct(F.transform(firsts, lambda i: F.slice("_matches", i, SPAN_CHUNK)).alias("_chunks"))))
    )
    sizes = F.transform("_chunks", lambda c: F.aggregate(c, F.lit(0), lambda total, piece: total + size(piece)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    placed = chunked.select(
        *own, F.inline(F.arrays_zip(F.col("_chunks").alias("_chunk"), F.slice(starts, 1, F.size("_chunks")).alias("_chunk_at")))
    )
    start = F.struct(
        F.col("_chunk_at").alias("at"), F.array().cast("array<struct<phrase:string,span_start:int,span_end:int>>").alias("spans")
    )

    def extend(acc, piece):
        begin = acc["at"] + F.char_length(piece["gap"])
        end = begin + F.char_length(piece["phrase"])
        span = F.struct(
            piece["phrase"].alias("phrase"), begin.alias("span_start"), end.alias("span_end")
        )
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    return placed.select(*own, F.inline(F.aggregate("_chunk", start, extend, lambda acc: acc["spans"])))
