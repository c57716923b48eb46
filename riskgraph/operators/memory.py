"""Vectors of remembered signals: cache lookup, gathering, pooling, scaling and attention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgraph.operators.joins import lookup_join


def vectors_by_text(signals: DataFrame, cache: DataFrame, text: str = "text", vector: str = "embedding",
                    strict: bool = True) -> DataFrame:
    """Attach the cached vector of each signal's exact text.

    The join key is the text hash; the text itself is compared too. Copies of one text may be a large
    share of all signals, which the lookup join keeps out of the shuffle. A text that the cache doesn't hold, or none,
    fails the job that reads the result; without ``strict`` its signals are left out.
    """
    keyed = signals.withColumns({"_h": F.sha2(F.col(text), 256), "_t": F.col(text)})
    stored = cache.select(
        F.sha2(F.col(text), 256).alias("_h"), F.col(text).alias("_t"), F.col(vector), F.lit(True).alias("_found")
    ).dropDuplicates(["_h", "_t"])
    return _found(keyed, stored, ["_h", "_t"], strict, "text missing from cache").drop("_h", "_t")


def _found(rows: DataFrame, lookup: DataFrame, on: Sequence[str], strict: bool, message: str) -> DataFrame:
    """Rows that meet ``lookup(.., _found)``; with ``strict`` a row that meets nothing fails, in the same pass."""
    if not strict:
        return lookup_join(rows, lookup, on).drop("_found")
    met = F.when(F.col("_found").isNotNull(), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return lookup_join(rows, lookup, on, "left").filter(met).drop("_found")


def missing_texts(signals: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct signal texts that the cache does not hold."""
    return signals.select(text).distinct().join(cache.select(text).distinct(), text, "left_anti")


def gather_vectors(memory: DataFrame, vectors: DataFrame, signal: str = "signal_id", strict: bool = True) -> DataFrame:
    """Attach the vector of the signal in each memory slot; absent slots have no row.

    A slot whose signal has no vector fails the job that reads the result; without ``strict`` it is left out.
    """
    return _found(memory, vectors.withColumn("_found", F.lit(True)), [signal], strict, "memory refers to an unknown signal")


def _means(slots: DataFrame, keys: Sequence[str], vector: str, dim: int) -> DataFrame:
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(dim)]
    pooled = slots.groupBy(*keys).agg(*means)
    return pooled.select(*keys, F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("pooled"))


def mean_pool(slots: DataFrame, keys: Sequence[str], vector: str = "vector", dim: int = 64) -> DataFrame:
    """Mean vector of the slots of each key: one aggregate per dimension.

    A key has at most K slots, which lie apart once they have met their vectors. Whole vectors move to the key, as a sum and a
    count for each component would take four times their room and combine hardly any of them.
    """
    return _means(slots.repartition(*keys), keys, vector, dim)


def pool_signals(memory: DataFrame, vectors: DataFrame, signal: str = "signal_id", vector: str = "vector", dim: int = 64,
                 snapshot: str = "snapshot", node: str = "node_id", strict: bool = True) -> DataFrame:
    """Mean vector of the remembered signals of each snapshot and node, as of :func:`mean_pool` over :func:`gather_vectors`.

    A node remembers a signal at several snapshots. They are nested first, in place as memory lies by node, so a vector moves once
    for each node and signal and not once for each slot; snapshots and means are made where the node's vectors lie.
    """
    remembered = memory.groupBy(node, signal).agg(F.collect_list(snapshot).alias("_at"))
    met = gather_vectors(remembered, vectors.select(signal, vector), signal, strict)
    placed = met.select(node, vector, "_at").repartition(node).select(F.explode("_at").alias(snapshot), node, vector)
    return _means(placed, [snapshot, node], vector, dim)


def mean_pool_all(nodes: DataFrame, slots: DataFrame, keys: Sequence[str], vector: str = "vector", dim: int = 64) -> DataFrame:
    """The same for every key of ``nodes``; a key without slots has the zero vector."""
    pooled = mean_pool(slots, keys, vector, dim)
    zero = F.array_repeat(F.lit(0.0), dim)
    return nodes.select(*keys).distinct().join(pooled, list(keys), "left").select(
        *keys, F.coalesce("pooled", zero).alias("pooled")
    )


def fit_scaler(rows: DataFrame, vector: str, dim: int, floor: float = 1e-6) -> DataFrame:
    """One row ``means, scales``: mean and population deviation per dimension, tiny deviations become 1."""
    value = lambda i: F.get(F.col(vector), F.lit(i)).cast("double")
    aggs: list[Column] = []
    for i in range(dim):
        aggs += [F.avg(value(i)).alias(f"_m{i}"), F.stddev_pop(value(i)).alias(f"_s{i}")]
    fitted = rows.agg(*aggs)
    scale = lambda i: F.when(F.col(f"_s{i}") > floor, F.col(f"_s{i}")).otherwise(1.0)
    return fitted.select(
        F.array(*[F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) for i in range(dim)]).alias("means"),
        F.array(*[scale(i) for i in range(dim)]).alias("scales"),
    )


def apply_scaler(rows: DataFrame, scaler: DataFrame, vector: str, name: str | None = None) -> DataFrame:
    """Standardize with a fitted one-row scaler, read as a scalar subquery."""
    fitted = scaler.select(F.struct("means", "scales")).scalar()
    centered = F.zip_with(F.col(vector), F.col("_f.means"), lambda x, m: x.cast("double") - m)
    return rows.withColumn("_f", fitted).withColumn(
        name or vector, F.zip_with(centered, F.col("_f.scales"), lambda x, s: x / s)
    ).drop("_f")


def newest_context(memory: DataFrame, keys: Sequence[str] = ("snapshot", "node_id")) -> DataFrame:
    """Slot, age and confidence of the newest remembered signal; equal ages give the first slot."""
    return memory.groupBy(*keys).agg(
        F.min_by(F.struct("slot", "age_days", "confidence"), F.struct("age_days", "slot")).alias("_n")
    ).select(*keys, "_n.*")


def attention_weights(
    memory: DataFrame,
    keys: Sequence[str] = ("snapshot", "node_id"),
    score: str = "score",
    decay: float = 0.05,
    use_time: bool = True,
) -> DataFrame:
    """Softmax over the slots of a key of ``score - decay * age + confidence``.

    A key has at most K slots, so a window over the key is bounded. A negative age is future evidence
    and fails the job.
    """
    age = F.col("age_days")
    checked = F.when(age < 0, F.raise_error(F.lit("negative signal age: future evidence"))).otherwise(age)
    logit = F.col(score) + F.col("confidence") - (F.lit(decay) * checked if use_time else F.lit(0.0))
    group = W.partitionBy(*keys)
    return (
        memory.withColumn("_l", logit)
        .withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(group)))
        .withColumn("weight", F.col("_e") / F.sum("_e").over(group))
        .drop("_l", "_e")
    )


def attention_pool(weighted: DataFrame, keys: Sequence[str], vector: str = "vector", dim: int = 64) -> DataFrame:
    """Weighted sum of slot vectors per key."""
    sums = [
        F.sum(F.col("weight") * F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(dim)
    ]
    pooled = weighted.groupBy(*keys).agg(*sums)
    return pooled.select(*keys, F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("pooled"))


def random_projection(rows: DataFrame, vector: str, matrix: Sequence[Sequence[float]], name: str = "projected") -> DataFrame:
    """Fixed supplied projection followed by L2 normalization."""
    from riskgraph.functions.numeric import l2_normalize, project

    return rows.withColumn("_p", project(vector, matrix)).withColumn(name, l2_normalize("_p")).drop("_p")


def slots_to_arrays(memory: DataFrame, keys: Sequence[str], k: int, value: str, fill) -> DataFrame:
    """Export form: one array of ``k`` slots per key, unused slots filled."""
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(fill))
    )
    return (
        memory.groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", value))).alias("_m"))
        .select(*keys, padded.alias(value))
    )


def arrays_to_slots(dense: DataFrame, keys: Sequence[str], value: str, fill) -> DataFrame:
    """Import form: one row per used slot of an array column."""
    return dense.select(*keys, F.posexplode(value).alias("slot", value)).filter(F.col(value) != F.lit(fill))
