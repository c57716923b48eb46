"""Validation of extracted signal JSON against the document it was extracted from, and document roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.functions.keys import clean

SIGNAL = "struct<entity_id:string,evidence:string,event:variant,category:variant,uncertainty:variant,sentiment:variant,confidence:variant>"


def signal_object(raw: str | Column) -> Column:
    """Text from the first ``{`` to the last ``}``, NULL when there is none."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.nullif(found, F.lit(""))


def _bounded(value: Column, low: float, high: float) -> Column:
    number = F.try_variant_get(value, "$", "double")
    kind = F.schema_of_variant(value)
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(numeric & number.between(low, high), F.lit(False))


def _text(value: Column) -> Column:
    """A JSON string that isn't blank; a number or a list is no text."""
    string = F.schema_of_variant(value) == "STRING"
    return F.coalesce(string & (clean(F.try_variant_get(value, "$", "string")) != ""), F.lit(False))


def validate_signals(
    answers: DataFrame, raw: str = "raw", text: str = "text", entities: str = "entity_ids",
) -> DataFrame:
    """Add ``reason`` (NULL when every signal of the document is valid) and the parsed ``signals``.

    One bad signal rejects its document: unknown entity, evidence that is not a literal part of the
    text, a number outside its bounds, an event or category that is blank or no string.
    """
    body = signal_object(raw)
    parsed = answers.withColumn("_body", body).withColumn("_v", F.try_parse_json("_body")).withColumn(
        "signals",
        F.from_json("_body", f"signals array<{SIGNAL}>")["signals"],
    )
    listed = F.coalesce(
        F.schema_of_variant(F.try_variant_get("_v", "$.signals", "variant")).startswith("ARRAY"), F.lit(False)
    )
    bad = lambda test: F.exists("signals", lambda s: ~F.coalesce(test(s), F.lit(False)))
    reason = (
        F.when(F.col("_v").isNull(), "no_json_object")
        .when(~listed, "signals_not_a_list")
        .when(bad(lambda s: F.array_contains(entities, s["entity_id"])), "entity_not_listed")
        .when(bad(lambda s: (s["evidence"] != "") & F.contains(F.col(text), s["evidence"])), "evidence_not_literal")
        .when(bad(lambda s: _bounded(s["uncertainty"], 0.0, 1.0)), "invalid_uncertainty")
        .when(bad(lambda s: _bounded(s["sentiment"], -1.0, 1.0)), "invalid_sentiment")
        .when(bad(lambda s: _bounded(s["confidence"], 0.0, 1.0)), "invalid_confidence")
        .when(bad(lambda s: _text(s["event"])), "missing_event")
        .when(bad(lambda s: _text(s["category"])), "missing_category")
    )
    return parsed.withColumn("reason", reason).drop("_body", "_v")


def accepted_signals(validated: DataFrame, document: str = "document_id") -> DataFrame:
    """Signals of the accepted documents, one row each, numbers as doubles."""
    return validated.filter(F.col("reason").isNull()).select(document, F.explode("signals").alias("s")).select(
        document, "s.entity_id", *[F.try_variant_get(F.col(f"s.{n}"), "$", "string").alias(n) for n in ("event", "category")], "s.evidence",
        *[F.try_variant_get(F.col(f"s.{n}"), "$", "double").alias(n) for n in ("uncertainty", "sentiment", "confidence")],
    )


def document_rollup(links: DataFrame, entities: DataFrame, year: int | None = None, date: str = "context_date") -> DataFrame:
    """One row per document with its linked entities, sorted by id, optionally of one year only.

    The list of a document is bounded by the entities its text can name; ``chunked_lists`` is the
    form for links without such a bound.
    """
    from riskgraph.operators.joins import lookup_join

    kept = links if year is None else links.filter(F.year(date) == year)
    named = lookup_join(kept.select("doc_id", "entity_id").distinct(), entities.select("entity_id", "name"), ["entity_id"])
    return named.groupBy("doc_id").agg(
        F.count("*").alias("n_entities"),
        F.array_sort(F.collect_list(F.struct(F.col("entity_id").alias("id"), "name"))).alias("entities"),
    )
