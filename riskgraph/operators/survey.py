"""Yearly survey tables: entity and relation upserts, sheet headers and disturbance reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskgraph.functions.dates import parse_mixed
from riskgraph.functions.keys import canonical_key, clean, prefixed
from riskgraph.operators.joins import lookup_join

# Kept columns of each survey table.
SURVEY_FIELDS = {
    "utility": ["Utility ID", "Utility Name", "State", "Entity Type", "Owner of Plants Reported on Form?",
                "Operator of Plants Reported on Form?"],
    "plant": ["Utility ID", "Utility Name", "Plant Code", "Plant Name", "State", "County", "Latitude", "Longitude",
              "NERC Region", "Balancing Authority Code", "Primary Purpose (NAICS Code)", "Sector", "Sector Name"],
    "generator": ["Utility ID", "Utility Name", "Plant Code", "Plant Name", "State", "Generator ID", "Technology",
                  "Prime Mover", "Status", "Nameplate Capacity (MW)", "Summer Capacity (MW)", "Winter Capacity (MW)",
                  "Operating Month", "Operating Year", "Energy Source 1", "Energy Source 2", "Energy Source 3",
                  "Energy Source 4", "Energy Source 5", "Energy Source 6"],
    "ownership": ["Utility ID", "Utility Name", "Plant Code", "Plant Name", "Generator ID", "Owner Name",
                  "Ownership ID", "Percent Owned", "Status"],
}
TABLE_ORDER = ["utility", "plant", "generator", "ownership"]
ENERGY_FIELDS = [f"Energy Source {i}" for i in range(1, 7)]


def upsert_entities(observed: DataFrame, order: Sequence[str], year: str = "year") -> DataFrame:
    """One row per ``entity_id``: type and name of its first observation, first source, latest year.

    The first year is the year of the first observation in ``order``.
    """
    extra = [c for c in observed.columns if c not in {"entity_id", year, *order}]
    first = F.min_by(F.struct(*extra, F.col(year).alias("_y")), F.struct(*order))
    return observed.groupBy("entity_id").agg(first.alias("_f"), F.max(year).alias("last_year")).select(
        "entity_id", *[F.col(f"_f.{c}").alias(c) for c in extra], F.col("_f._y").alias("first_year"), "last_year"
    )


def upsert_relations(
    observed: DataFrame, order: Sequence[str], year: str = "year", attribute: str | None = None,
) -> DataFrame:
    """One row per (head, tail, relation_type) with its year range; rows lacking an endpoint are dropped.

    ``attribute`` becomes a map by year holding the last observation of each year, reduced per year
    before the map is built, so it has one entry per survey year at most. An observation is moved once, to its relation.
    """
    keys = ["head", "tail", "relation_type"]
    usable = observed.filter(F.col("head").isNotNull() & F.col("tail").isNotNull())
    at = F.struct(*order)
    if attribute is None:
        return usable.groupBy(*keys).agg(
            F.min_by(year, at).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("n_observed")
        )
    per_year = usable.repartition(*keys).groupBy(*keys, F.col(year).alias("_y")).agg(
        F.min(at).alias("_first"), F.count("*").alias("_n"),
        F.max_by(attribute, F.when(F.col(attribute).isNotNull(), at)).alias("_a"),
    )
    entries = F.array_sort(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct(F.col("_y").cast("string").alias("k"), F.col("_a").alias("v")))))
    return per_year.groupBy(*keys).agg(
        F.min_by("_y", "_first").alias("first_year"), F.max("_y").alias("last_year"), F.sum("_n").alias("n_observed"),
        F.map_from_entries(entries).alias("observed_attributes"),
    )


def project_fields(
    rows: DataFrame, kind: str, fields: dict[str, list[str]] = SURVEY_FIELDS, at: Sequence[str] = (),
) -> DataFrame:
    """The locator ``at``, then the kept columns of a survey table that exist in this year's layout, in declared order."""
    return rows.select(*at, *[F.col(f"`{c}`") for c in fields[kind] if c in rows.columns])


def unpivot_repeated(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "value") -> DataFrame:
    """Repeated columns as rows; empty values dropped."""
    present = [c for c in columns if c in rows.columns]
    long = rows.select(*keys, F.posexplode(F.array(*[clean(F.col(f"`{c}`").cast("string")) for c in present])).alias("position", name))
    return long.filter(F.coalesce(F.col(name), F.lit("")) != "")


def rows_without_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows that lack their id but hold some other value."""
    others = [F.coalesce(clean(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns if c != key]
    empty_key = F.coalesce(clean(F.col(f"`{key}`").cast("string")), F.lit("")) == ""
    return rows.filter(empty_key & (F.concat(*others) != ""))


def asset_observations(kind: str, rows: DataFrame, prefix: str = "eia", at: Sequence[str] = ("year", "row")) -> tuple[DataFrame, DataFrame]:
    """Entity and relation observations of one survey table.

    ``rows`` has the survey columns as strings plus the locator columns ``at``; missing columns count
    as empty. The keys of a row are derived once and its observations fan out from that row, so the
    table is read once for entities and once for relations. ``_t`` is the table's number and ``_i`` the place of
    the observation in its row, so that a row that names one thing twice has a first and a last name for it.
    """
    have = set(rows.columns)
    col = lambda c: (F.col(f"`{c}`") if c in have else F.lit(None)).cast("string")
    key = lambda c: canonical_key(col(c), numeric=True)
    locate = [*at, F.lit(TABLE_ORDER.index(kind)).alias("_t")]
    derived = F.struct(
        key("Utility ID").alias("u"), key("Plant Code").alias("p"), key("Generator ID").alias("g"), key("State").alias("s"),
        key("Primary Purpose (NAICS Code)").alias("n"), key("Ownership ID").alias("o"),
        *[key(c).alias(f"f{i}") for i, c in enumerate(ENERGY_FIELDS)],
        clean(col("Utility Name")).alias("utility_name"), clean(col("Plant Name")).alias("plant_name"),
        clean(col("Owner Name")).alias("owner_name"), clean(col("Percent Owned")).alias("percent"),
    )
    keyed = rows.select(*locate, F.inline(F.array(derived))).filter(F.col("u").isNotNull())
    utility, plant = prefixed(f"{prefix}:utility", "u"), prefixed(f"{prefix}:plant", "p")
    generator, state = prefixed(f"{prefix}:generator", "p", "g"), prefixed(f"{prefix}:state", "s")
    naics, owner = prefixed(f"{prefix}:naics", "n"), prefixed(f"{prefix}:utility", "o")
    fuels = [f"f{i}" for i, c in enumerate(ENERGY_FIELDS) if c in have]
    none = F.lit(None).cast("string")

    def entity(i, entity_type, name):
        return F.struct(i.alias("entity_id"), F.lit(entity_type).alias("entity_type"), name.alias("name"))

    def relation(head, tail, relation_type, value=none):
        return F.struct(
            head.alias("head"), tail.alias("tail"), F.lit(relation_type).alias("relation_type"), value.alias("attribute")
        )

    # Entity types and relation names of the asset graph.
    entities = [
        entity(utility, "utility_reporting_entity", F.col("utility_name")),
        entity(plant, "plant", F.col("plant_name")),
        entity(generator, "generator", F.col("g")),
        entity(state, "region_state_code", F.col("s")),
    ]
    relations = [
        relation(generator, plant, "LocatedAtPlant"), relation(F.coalesce(plant, utility), state, "LocatedInState")
    ]
    if kind == "plant":
        entities.append(entity(naics, "industry_naics_code", F.col("n")))
        relations += [relation(plant, utility, "ReportedBy"), relation(plant, naics, "PrimaryPurposeNAICS")]
    if kind == "generator":
        # Fuels are entities of the row even when the row names no generator.
        entities += [entity(prefixed(f"{prefix}:fuel", f), "fuel_code", F.col(f)) for f in fuels]
        relations.append(relation(generator, utility, "ReportedBy"))
        relations += [relation(generator, prefixed(f"{prefix}:fuel", f), "UsesEnergySource") for f in fuels]
    if kind == "ownership":
        owned = F.when(generator.isNotNull(), owner)
        entities.append(entity(owned, "utility_reporting_entity", F.col("owner_name")))
        relations.append(relation(owned, generator, "OwnsReportedGenerator", F.col("percent")))
    return (
        keyed.select(*at, "_t", F.posexplode(F.array(*entities)).alias("_i", "_o")).select(*at, "_t", "_i", "_o.*").filter(F.col("entity_id").isNotNull()),
        keyed.select(*at, "_t", F.posexplode(F.array(*relations)).alias("_i", "_o")).select(*at, "_t", "_i", "_o.*").filter(F.col("head").isNotNull() & F.col("tail").isNotNull()),
    )


def asset_graph(tables: dict[str, DataFrame], prefix: str = "eia", at: Sequence[str] = ("year", "row")) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of all survey tables, upserted in (year, table, row, place in the row) order."""
    observed = [asset_observations(kind, rows, prefix, at) for kind, rows in tables.items()]
    order = [at[0], "_t", *at[1:], "_i"]
    entities = reduce(DataFrame.unionByName, [e for e, _ in observed])
    relations = reduce(DataFrame.unionByName, [r for _, r in observed])
    return upsert_entities(entities, order), upsert_relations(relations, order, "year", "attribute")


def sheet_records(cells: DataFrame, marker: str, sheet: Sequence[str] = ("file", "sheet"), search_rows: int = 10) -> DataFrame:
    """Records of raw sheets ``(sheet.., row, cells ARRAY)``: the header is the first row holding ``marker``.

    Only the first ``search_rows`` rows of a sheet can be the header; sheets without one have no
    records. Each record is a map from header text to cell.
    """
    header = cells.filter((F.col("row") < search_rows) & F.array_contains("cells", marker)).groupBy(*sheet).agg(
        F.min(F.struct("row", "cells")).alias("_h")
    )
    trimmed = F.transform("_h.cells", lambda c: clean(F.coalesce(c, F.lit(""))))
    pairs = F.filter(
        F.arrays_zip(trimmed.alias("k"), F.transform("cells", clean).alias("v")),
        lambda p: (F.coalesce(p["k"], F.lit("")) != "") & p["v"].isNotNull(),
    )
    return lookup_join(cells, header, sheet).filter(F.col("row") > F.col("_h.row")).select(
        *sheet, "row", F.map_from_entries(pairs).alias("fields")
    )


def disturbance_events(records: DataFrame, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Kept disturbance reports and warnings.

    A report needs a start date, or criteria / type together with area / region. A kept report without
    a date, and a date outside the file's year, give a warning.
    """
    field = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    dated = records.withColumn("event_date", parse_mixed(field("Date Event Began")))
    described = ((field("Alert Criteria") != "") | (field("Event Type") != "")) & (
        (field("Area Affected") != "") | (field("NERC Region") != "")
    )
    kept = dated.filter(F.col("event_date").isNotNull() | described).withColumn(
        "date_quality",
        F.when(F.col("event_date").isNotNull(), "reported_start_date").otherwise("unknown_reported_start_date"),
    )
    unknown = kept.filter(F.col("event_date").isNull()).withColumn("reason", F.lit("unknown_start_date"))
    outside = kept.filter(F.year("event_date") != F.col(year)).withColumn("reason", F.lit("date_outside_file_year"))
    return kept, unknown.unionByName(outside)


def unpivot_map(rows: DataFrame, keys: Sequence[str], fields: str = "fields") -> DataFrame:
    return rows.select(*keys, F.explode(fields).alias("field", "value"))


def cell_differences(projected: DataFrame, raw: DataFrame, locator: Sequence[str]) -> DataFrame:
    """Projected fields (``fields MAP``) that differ from the raw cell at the same place."""
    a = unpivot_map(projected, locator).withColumnRenamed("value", "projected")
    b = unpivot_map(raw, locator).withColumnRenamed("value", "raw")
    return a.join(b, [*locator, "field"], "left").filter(~F.col("projected").eqNullSafe(F.col("raw")))
