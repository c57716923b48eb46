"""Day-resolution date parsing; a value that does not parse is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskgraph.functions.keys import clean


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch_day(value) -> Column:
    """Days since 1970-01-01 of a date or timestamp column."""
    return F.unix_date(F.to_date(_column(value)))


def day_to_date(value) -> Column:
    return F.date_from_unix_date(_column(value).cast("int"))


def day_to_iso(value) -> Column:
    return day_to_date(value).cast("string")


def parse_iso_prefix(value) -> Column:
    """ISO date in the first ten characters."""
    head = F.substring(_column(value).cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def parse_compact(value) -> Column:
    """Strict ``YYYYMMDD`` date; surrounding whitespace ignored."""
    text = clean(value)
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def parse_mixed(value) -> Column:
    """``m/d/Y``, ``m/d/y`` (69-99 means 1969-1999) or ``Y-m-d``, tried in that order."""
    text = clean(value)
    two_digit = F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"),
        F.try_to_date(
            F.concat(
                F.substring_index(text, "/", 2),
                F.when(F.substring_index(text, "/", -1).try_cast("int") >= 69, "/19").otherwise("/20"),
                F.substring_index(text, "/", -1),
            ),
            "M/d/yyyy",
        ),
    )
    return F.coalesce(
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")),
        two_digit,
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")),
    )


def parse_day(value) -> Column:
    """Epoch day from an integer or a canonical ISO date; anything else is NULL."""
    text = clean(value)
    parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("int")).otherwise(F.unix_date(parsed))
