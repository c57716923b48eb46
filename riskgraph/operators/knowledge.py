"""Knowledge-base statements: flattening, facts, closure over collected entities, domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskgraph.functions.keys import clean
from riskgraph.operators.joins import lookup_join
from riskgraph.runtime import durable

# Kept properties and their predicate names.
PROPERTIES = {
    "P31": "instance_of", "P452": "industry", "P17": "country", "P159": "headquarters", "P355": "subsidiary",
    "P127": "owned_by", "P749": "parent_organization", "P1056": "product_or_material_produced",
    "P176": "manufacturer", "P206": "located_in_or_next_to_water", "P131": "located_in_administrative_entity",
    "P276": "location", "P495": "country_of_origin", "P527": "has_part", "P361": "part_of", "P138": "named_after",
    "P137": "operator",
}

# Role given to the object of a property.
OBJECT_ROLES = {
    "P17": "geographic_object", "P159": "geographic_object", "P131": "geographic_object",
    "P276": "geographic_object", "P495": "geographic_object", "P452": "industry",
    "P1056": "product_or_material", "P127": "organization_related", "P355": "organization_related",
    "P749": "organization_related", "P176": "organization_related", "P137": "organization_related",
}


def _pairs(spark: SparkSession, mapping: dict[str, str], names: tuple[str, str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias(names[0]), F.lit(v).alias(names[1])) for k, v in mapping.items()])
    return spark.range(1).select(F.inline(entries))


def property_names(spark: SparkSession, mapping: dict[str, str] = PROPERTIES) -> DataFrame:
    return _pairs(spark, mapping, ("property_id", "predicate"))


def object_roles(spark: SparkSession, mapping: dict[str, str] = OBJECT_ROLES) -> DataFrame:
    return _pairs(spark, mapping, ("property_id", "role"))


def item_target(statement: str | Column) -> Column:
    """Id of the item a statement's JSON points to; NULL for other value types and missing values."""
    v = F.try_parse_json(F.col(statement) if isinstance(statement, str) else statement)
    get = lambda path: F.try_variant_get(v, path, "string")
    return F.when(
        (get("$.mainsnak.snaktype") == "value") & (get("$.mainsnak.datavalue.value.entity-type") == "item"),
        get("$.mainsnak.datavalue.value.id"),
    )


def flatten_statements(entities: DataFrame, claims: str = "claims") -> DataFrame:
    """One row per statement of ``claims MAP<property, ARRAY<statement JSON>>``, in statement order."""
    by_property = entities.select(F.col("qid").alias("subject_qid"), F.explode(claims).alias("property_id", "_s"))
    return by_property.select("subject_qid", "property_id", F.posexplode("_s").alias("seq", "statement")).select(
        "subject_qid", "property_id", "seq", "statement",
        item_target("statement").alias("object_qid"),
        F.get_json_object("statement", "$.id").alias("statement_id"),
        F.coalesce(F.get_json_object("statement", "$.rank"), F.lit("normal")).alias("rank"),
    )


def relation_statements(statements: DataFrame, properties: DataFrame) -> DataFrame:
    """Not deprecated, item-valued statements of the kept properties with their predicate."""
    usable = statements.filter((F.col("rank") != "deprecated") & F.col("object_qid").isNotNull())
    return lookup_join(usable, properties, ["property_id"])


def language_values(field: str | Column) -> Column:
    """``MAP<language, STRUCT<value>>`` to ``MAP<language, value>``."""
    return F.transform_values(F.col(field) if isinstance(field, str) else field, lambda _, v: v["value"])


def resolved_flag(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Add whether the object has a collected record."""
    known = entities.select(F.col("qid").alias("object_qid"), F.lit(True).alias("_k")).distinct()
    return lookup_join(statements, known, ["object_qid"], "left").withColumn(
        "target_record_collected", F.col("_k").isNotNull()
    ).drop("_k")


def uncollected_targets(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("target_record_collected")).groupBy("object_qid").agg(F.count("*").alias("n_facts"))


def unique_facts(statements: DataFrame, keys: Sequence[str] = ("subject_qid", "property_id", "object_qid")) -> DataFrame:
    """Distinct facts with the number and first id of their statements.

    The statement ids of a fact stay in the statement table; ``chunked_lists`` nests them for export.
    """
    return statements.groupBy(*keys).agg(
        F.count("*").alias("n_statements"), F.min("statement_id").alias("first_statement_id")
    )


def tagged_facts(facts: DataFrame, nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Each fact with its ``part``: ``excluded`` (touches an excluded entity), ``closed`` (between kept nodes),
    ``unresolved`` (the object is not collected) or NULL (only the subject is unknown).

    Nodes and excluded entities are one lookup with a flag each, joined once to either end.
    """
    states = nodes.select("qid", F.lit(False).alias("_ban")).unionByName(excluded.select("qid", F.lit(True).alias("_ban")))
    states = states.groupBy("qid").agg(F.max("_ban").alias("_ban"))
    ends = lookup_join(
        lookup_join(facts, states.toDF("subject_qid", "_s"), ["subject_qid"], "left"), states.toDF("object_qid", "_o"), ["object_qid"], "left"
    )
    part = (
        F.when(F.col("_s") | F.col("_o"), "excluded")
        .when(F.col("_o").isNull(), "unresolved")
        .when(F.col("_s").isNotNull(), "closed")
    )
    return ends.withColumn("part", part).select(*facts.columns, "part")


def closed_facts(facts: DataFrame, nodes: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts between kept nodes, facts touching an excluded entity, and facts with an uncollected object."""
    tagged = durable(tagged_facts(facts, nodes, excluded), "facts")
    return tuple(tagged.filter(F.col("part") == p).drop("part") for p in ("closed", "excluded", "unresolved"))


def unknown_outcomes(nodes: DataFrame, node: str = "qid") -> DataFrame:
    """A label row per node saying that its outcome is unknown: label NULL, never 0."""
    return nodes.select(
        node, F.lit(None).cast("int").alias("label"), F.lit(-1).alias("label_code"),
        F.lit("unknown_no_observed_risk_outcome").alias("status"),
    )


def domain_type_counts(nodes: DataFrame, domains: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Nodes per (domain, type); a node counts in each of its domains and absent types show 0."""
    grid = nodes.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain")
    ).select("domain", F.explode(F.array(*[F.lit(t) for t in types])).alias("entity_type"))
    counts = nodes.select(F.explode("domain_candidates").alias("domain"), "entity_type").groupBy(
        "domain", "entity_type"
    ).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["domain", "entity_type"], "left").select(
        "domain", "entity_type", F.coalesce("n", F.lit(0)).alias("n")
    )


def selector_candidates(results: DataFrame, key: str = "item") -> DataFrame:
    """``(qid, domain)`` from selector answers ``(domain, bindings ARRAY<MAP<name, STRUCT<value>>>)``."""
    uri = F.try_element_at(F.col("_b"), F.lit(key))["value"]
    return (
        results.select("domain", F.explode("bindings").alias("_b"))
        .select(F.regexp_extract(uri, r"([^/]+)$", 1).alias("qid"), "domain")
        .filter(F.coalesce(F.col("qid"), F.lit("")) != "")
        .distinct()
    )


#: How a delivered answer's sidecar is named, and the mark of answers that were tried again.
SIDECAR, ATTEMPT = ".provenance", ".attempt"


def read_entities(spark: SparkSession, folder: str, prefixes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entity records of saved answers, gated by their provenance sidecars; later prefixes, then later names win.

    A pair ``<prefix>NAME.json`` / ``<prefix>NAME.provenance.json`` is used when the sidecar reports status 200 and the hash of
    the answer, and the answer is JSON without an error. Names with ``.attempt`` are left out. Returns accepted
    entities ``(qid, record JSON, file)`` and refused files with the reason.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"),
        F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("digest"),
    )
    matching = F.array(*[F.when(F.col("name").startswith(p), F.lit(i)).otherwise(-1) for i, p in enumerate(prefixes)])
    raw = raw.withColumn("prefix", F.array_max(matching)).filter((F.col("prefix") >= 0) & ~F.col("name").contains(ATTEMPT))
    sidecar = F.col("name").endswith(SIDECAR)
    meta = raw.filter(sidecar).select(
        F.substring_index("name", SIDECAR, 1).alias("name"), F.from_json("text", "status int, sha256 string").alias("meta"),
    )
    answers = raw.filter(~sidecar).join(meta, "name", "left")
    parsed = F.try_parse_json("text")
    error = F.get_json_object("text", "$.error")
    reason = (
        F.when(F.col("meta").isNull(), "no_sidecar")
        .when(parsed.isNull(), "not_json")
        .when(F.coalesce(F.col("meta.status") != 200, F.lit(True)), "status")
        .when(error.isNotNull() & ~error.isin("", "false", "0", "{}", "[]"), "error")
        .when(F.coalesce(F.col("meta.sha256") != F.col("digest"), F.lit(True)), "hash")
    )
    gated = answers.withColumn("reason", reason)
    records = gated.filter(F.col("reason").isNull()).select(
        "prefix", "name", F.explode(F.from_json(F.get_json_object("text", "$.entities"), "map<string,string>")).alias("qid", "record")
    ).filter(F.col("qid").startswith("Q") & F.get_json_object("record", "$.missing").isNull())
    accepted = records.groupBy("qid").agg(F.max_by(F.struct("record", "name"), F.struct("prefix", "name")).alias("_r")).select(
        "qid", "_r.record", F.col("_r.name").alias("file")
    )
    return accepted, gated.filter(F.col("reason").isNotNull()).select("name", "reason")


def registry_relations(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manufacturer registry pages: first record per id, repeated ids, and country / vehicle-type relations.

    ``items(page, position, id, name, country, vehicle_types ARRAY<STRUCT<name, is_primary>>)``.
    """
    firsts = items.groupBy("id").agg(
        F.min_by(F.struct("name", "country", "vehicle_types", "page"), F.struct("page", "position")).alias("_r"),
        F.count("*").alias("n_seen"),
    ).select("id", "_r.*", "n_seen")
    country = firsts.filter(F.coalesce(clean("country"), F.lit("")) != "").select(
        "id", F.lit("registered_country").alias("relation"), F.col("country").alias("target"),
        F.lit(None).cast("boolean").alias("is_primary"),
    )
    kinds = firsts.select("id", F.explode("vehicle_types").alias("_v")).select(
        "id", F.lit("makes_vehicle_type").alias("relation"), F.col("_v.name").alias("target"),
        F.col("_v.is_primary").alias("is_primary"),
    )
    return (
        firsts.drop("n_seen"),
        firsts.filter(F.col("n_seen") > 1).select("id", "n_seen"),
        country.unionByName(kinds),
    )


def proof_gaps(steps: DataFrame, keys: Sequence[str] = ("classified_qid", "supported_type")) -> DataFrame:
    """Proof steps ``(keys, step, subject_qid, object_qid)`` that do not start where the previous one ended."""
    previous = steps.select(*keys, (F.col("step") + 1).alias("step"), F.col("object_qid").alias("_before"))
    return steps.filter(F.col("step") > 0).join(previous, [*keys, "step"], "left").filter(
        ~F.coalesce(F.col("_before") == F.col("subject_qid"), F.lit(False))
    ).drop("_before")


def unproven_steps(steps: DataFrame, statements: DataFrame) -> DataFrame:
    """Proof steps whose statement does not exist with that subject, property and object."""
    keys = ["subject_qid", "property_id", "object_qid", "statement_id"]
    return steps.join(statements.select(*keys).distinct(), keys, "left_anti")
