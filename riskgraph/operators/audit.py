"""Table audits: rules produce violation rows, never silent repairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskgraph.operators.joins import lookup_join
from riskgraph.runtime import durable


class AuditError(ValueError):
    """A rule that must hold was violated."""


def require_empty(violations: DataFrame, message: str, examples: int = 5) -> None:
    """Raise :class:`AuditError` with a few examples unless there are no violations."""
    found = violations.limit(examples).collect()
    if found:
        raise AuditError(f"{message}: {[row.asDict() for row in found]}")


def require_rows(rows: DataFrame, message: str) -> None:
    if rows.isEmpty():
        raise AuditError(message)


def row_violations(rows: DataFrame, rules: dict[str, Column], detail: Column) -> DataFrame:
    """One row ``code, detail`` per rule that is not true for a row (NULL counts as violated)."""
    codes = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()])
    )
    return rows.select(F.explode(codes).alias("code"), detail.cast("string").alias("detail"))


def summarize_violations(violations: DataFrame, examples: int = 5) -> DataFrame:
    """Count per code with its first examples in text order (limited map-side before the shuffle)."""
    counts = violations.groupBy("code").agg(F.count("*").alias("n"))
    first = W.partitionBy("code").orderBy("detail")
    shown = (
        violations.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= examples)
        .groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("examples"))
    )
    return counts.join(shown, "code")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys annotated more than once, told apart into plain duplicates and contradictions."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when(F.min(value) != F.max(value), "conflict").otherwise("duplicate").alias("kind"),
    ).filter(F.col("n") > 1)


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Keys ``missing`` from or ``extra`` in ``actual``, or ``different`` in a value; equal rows are left out."""
    e = expected.select(*keys, F.lit(True).alias("_e"), *[F.col(v).alias(f"_e_{v}") for v in values])
    a = actual.select(*keys, F.lit(True).alias("_a"), *[F.col(v).alias(f"_a_{v}") for v in values])
    joined = e.join(a, list(keys), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_e_{v}").eqNullSafe(F.col(f"_a_{v}"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~same, "different")
    return joined.select(*keys, status.alias("status")).filter(F.col("status").isNotNull())


#: Bits that mark the hashes of unlike groups of keys (32 MB if all rows of them are there), and how many of them one row holds.
MARKS, ROW_MARKS = 1 << 28, 4096


def _marked(names: Sequence[str]) -> list[Column]:
    """Values, each with whether it is null: nulls have hashes of their own."""
    return [part for c in names for part in (F.col(c), F.col(c).isNull())]


def _halves(names: Sequence[str]) -> dict[str, Column]:
    """Two 64-bit hashes of a row in halves of 32 bits; sums of fewer than 2 ** 31 of them are exact 64-bit numbers."""
    hashes = {salt: F.xxhash64(F.lit(salt), *_marked(names)) for salt in (1, 2)}
    return {f"{half}{salt}": c for salt, h in hashes.items() for half, c in (("l", h.bitwiseAND(F.lit(0xFFFFFFFF))), ("u", F.shiftright(h, 32)))}


def fingerprints(rows: DataFrame, keys: Sequence[str], values: Sequence[str] = (), ranges: int = 4096) -> DataFrame:
    """Row count and order-free sums of two row hashes, by halves, for each of ``ranges`` ranges of key hashes, summed map-side.

    Two tables with equal fingerprints of a range hold the same rows there, whatever their order and repetition: the chance of
    an unnoticed difference is about 2 ** -128 a range. Nulls have hashes of their own.
    """
    return rows.groupBy(F.pmod(F.xxhash64(*_marked(keys)), F.lit(ranges)).cast("int").alias("range")).agg(
        F.count("*").alias("n"), *[F.sum(h).alias(name) for name, h in _halves([*keys, *values]).items()]
    )


def _mark(marks: int) -> tuple[Column, Column, Column]:
    """Row, 64-bit word in the row and bit in the word that mark the hash ``_g``."""
    at = F.pmod("_g", F.lit(marks))
    within = F.pmod(at, F.lit(ROW_MARKS))
    return ((at - within) / ROW_MARKS).cast("int"), F.shiftright(within, 6).cast("int"), within.bitwiseAND(F.lit(63)).cast("int")


def _marks(hashes: DataFrame, marks: int) -> DataFrame:
    """The bit set of ``hashes(_g)``: ``_row`` and its words, for rows with a bit that is set."""
    row, word, bit = _mark(marks)
    words = (
        hashes.select(row.alias("_row"), word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"))
        .repartition("_row").groupBy("_row", "_word").agg(F.bit_or("_bit").alias("_bits"))
        .groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_known"))
    )
    every = F.sequence(F.lit(0), F.lit(ROW_MARKS // 64 - 1))
    return words.select("_row", F.transform(every, lambda i: F.coalesce(F.try_element_at("_known", i), F.lit(0).cast("bigint"))).alias("_words"))


def table_differences(
    derived: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str] = (), ranges: int = 4096,
    together: Sequence[str] | None = None, marks: int = MARKS,
) -> DataFrame:
    """Keys whose rows in ``stored`` are not those ``derived`` again, with ``status`` and both numbers of rows.

    ``missing``: not stored; ``extra``: not derived; ``repeated``: another number of rows; ``different``: other values. Null keys
    and values are values; the values of a row are compared by two 64-bit hashes of them. Values must be of types that group.

    Fingerprints of key ranges find the ranges that differ, at most ``ranges`` rows that go to every task; only rows of those ranges
    are shuffled, once, so equal tables cost one scan each. Where a few keys, ``together``, are shared by several rows and unlike rows
    lie in most ranges, name them: the rows of such a group are then summed map-side first, a hash and four numbers of it move, and a
    bit set of ``marks`` bits that goes to every task leaves only the rows of unlike groups to be shuffled with their keys. Rows of a
    group that shares its bit with an unlike one move too and are found equal. Both tables are read twice, or three times with
    ``together``: write them first where they are expensive to derive.
    """
    placing = list(together or keys)
    rest = [c for c in keys if c not in placing]
    group = F.xxhash64(*_marked(placing))
    both = fingerprints(derived, placing, [*rest, *values], ranges).withColumn("_d", F.lit(1)).unionByName(
        fingerprints(stored, placing, [*rest, *values], ranges).withColumn("_d", F.lit(0)))
    sums = [c for c in both.columns if c not in ("range", "_d")]
    unlike = durable(
        both.groupBy("range").agg(
            reduce(or_, [F.min(c) != F.max(c) for c in sums], F.count("*") < 2).alias("unlike")
        ).filter("unlike").select(F.col("range").alias("_range")),
        "ranges",
    )

    def in_ranges(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_range", F.pmod(group, F.lit(ranges)).cast("int")).join(F.broadcast(unlike), "_range", "left_semi")

    if together:
        halves = _halves([*keys, *values])

        def signed(rows: DataFrame, sign: int) -> DataFrame:
            return in_ranges(rows).select(group.alias("_g"), *[(F.lit(sign) * h).alias(name) for name, h in halves.items()])

        groups = signed(derived, 1).unionByName(signed(stored, -1)).groupBy("_g").agg(*[F.sum(h).alias(h) for h in halves])
        marked = durable(_marks(groups.filter(reduce(or_, [F.col(h) != 0 for h in halves])).select("_g"), marks), "unlike")
        row, word, bit = _mark(marks)

        def near(rows: DataFrame) -> DataFrame:
            set_bit = F.getbit(F.get("_words", word), bit) == 1
            return rows.withColumn("_g", group).withColumn("_at", row).join(F.broadcast(marked), (F.col("_at") == F.col("_row")) & set_bit, "left_semi")
    else:
        near = in_ranges

    digest = [F.xxhash64(F.lit(salt), *_marked(values)).alias(f"_h{salt}") for salt in (1, 2)]

    def within(rows: DataFrame, d: int) -> DataFrame:
        return near(rows).select(*keys, *digest).withColumns({"_d": F.lit(d), "_s": F.lit(1 - d)})

    # By key, so that the counts of equal rows and those of their key are taken in one place.
    return (
        within(derived, 1).unionByName(within(stored, 0)).repartition(*keys)
        .groupBy(*keys, "_h1", "_h2").agg(F.sum("_d").alias("_d"), F.sum("_s").alias("_s"))
        .groupBy(*keys).agg(F.sum("_d").alias("n_derived"), F.sum("_s").alias("n_stored"), F.max(F.col("_d") != F.col("_s")).alias("_unlike"))
        .filter("_unlike")
        .withColumn("status", F.when(F.col("n_stored") == 0, "missing").when(F.col("n_derived") == 0, "extra")
                    .when(F.col("n_derived") != F.col("n_stored"), "repeated").otherwise("different"))
        .drop("_unlike")
    )


def expect_counts(actual: DataFrame, expected: DataFrame, key: str = "kind") -> DataFrame:
    """Kinds whose number of rows differs from the specification; unlisted kinds are reported too."""
    return (
        expected.select(key, F.col("n").alias("expected"))
        .join(actual.groupBy(key).agg(F.count("*").alias("actual")), key, "full_outer")
        .select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
        .filter(F.col("expected") != F.col("actual"))
    )


def uncovered(entities: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Entities that no record mentions."""
    return entities.select(key).join(records.select(key).distinct(), key, "left_anti")


def dangling_endpoints(edges: DataFrame, nodes: DataFrame, node: str = "node_id", ends: Sequence[str] = ("src", "dst")) -> DataFrame:
    """Endpoints of edges that are not nodes, with the number of edges that use them."""
    used = edges.select(F.explode(F.array(*ends)).alias(node)).groupBy(node).agg(F.count("*").alias("n_edges"))
    return used.join(nodes.select(node), node, "left_anti")


def ontology_violations(edges: DataFrame, nodes: DataFrame, ontology: DataFrame, node: str = "node_id") -> DataFrame:
    """Relations whose endpoint types do not fit ``ontology(rel, src_type, dst_type)``."""
    from riskgraph.operators.joins import lookup_join

    typed = edges
    for end in ("src", "dst"):
        types = nodes.select(F.col(node).alias(end), F.col("node_type").alias(f"{end}_type"))
        typed = lookup_join(typed, types, [end], "left")
    return lookup_join(typed, ontology, ["rel", "src_type", "dst_type"], "left_anti")


def snapshot_audit(snapshots: DataFrame, labels: DataFrame, memory: DataFrame) -> DataFrame:
    """Dataset rules as ``code, n``: order, leakage between splits, label domain, memory ages.

    Each rule is one aggregate over its table; a code with ``n`` 0 holds.
    """
    codes = []

    def add(frame: DataFrame, code: str, n: Column) -> None:
        codes.append(frame.agg(n.cast("bigint").alias("n")).select(F.lit(code).alias("code"), "n"))

    ranges = snapshots.filter(F.col("split") >= 0).groupBy("split").agg(
        F.min("query_day").alias("q0"), F.max("query_day").alias("q1"), F.max("target_day").alias("t1")
    )
    newer = ranges.select((F.col("split") - 1).alias("split"), F.col("q0").alias("next_q0"))
    steps = ranges.join(newer, "split")
    add(snapshots, "split_domain", F.count_if(~F.coalesce(F.col("split").isin(-1, 0, 1, 2), F.lit(False))))
    add(ranges, "split_coverage", F.lit(3) - F.count("*"))
    add(steps, "split_chronology", F.count_if(F.col("q1") >= F.col("next_q0")))
    add(steps, "split_target_leak", F.count_if(F.col("t1") >= F.col("next_q0")))
    add(snapshots, "forecast_horizon", F.count_if(F.col("target_day") <= F.col("query_day")))
    add(labels, "label_domain", F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1)))
    purged = lookup_join(labels, snapshots.filter(F.col("split") == -1).select("snapshot"), ["snapshot"], "left_semi")
    add(purged, "purged_label", F.count_if(F.col("label").isNotNull()))
    add(memory, "memory_future_leak", F.count_if(F.col("age_days") <= 0))
    add(duplicates(memory, ["snapshot", "node_id", "signal_id"]), "memory_duplicate", F.count("*"))
    out = codes[0]
    for part in codes[1:]:
        out = out.unionByName(part)
    return out


def interval_audit(intervals: DataFrame, snapshots: DataFrame, node: str = "node_id") -> DataFrame:
    """Faults ``(node, first_query_day, code)`` of label intervals against the snapshots that may carry labels.

    ``interval_start`` and ``interval_end``: not a query day of such a snapshot; ``interval_size``: another number of
    snapshots between the ends than stated, or the ends are reversed; ``interval_overlap``: the interval begins before the
    node's previous one is over or right after it, so the two aren't maximal. No cell of the grid is expanded.
    """
    days = snapshots.agg(F.array_sort(F.collect_set("query_day"))).scalar()
    placed = intervals.withColumn("_days", days).withColumns({
        "_a": F.array_position("_days", F.col("first_query_day")), "_b": F.array_position("_days", F.col("last_query_day")),
    }).drop("_days")
    earlier = W.partitionBy(node).orderBy("first_query_day", "last_query_day").rowsBetween(W.unboundedPreceding, -1)
    rules = {
        "interval_start": F.coalesce("_a", F.lit(0)) == 0,
        "interval_end": F.coalesce("_b", F.lit(0)) == 0,
        "interval_size": (F.col("_a") > 0) & (F.col("_b") > 0)
        & (~F.col("n_snapshots").eqNullSafe(F.col("_b") - F.col("_a") + 1) | (F.col("_b") < F.col("_a"))),
        "interval_overlap": (F.col("_a") > 0) & (F.max("_b").over(earlier) >= F.col("_a") - 1),
    }
    codes = F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules.items()])
    return placed.withColumn("_codes", F.array_compact(codes)).select(node, "first_query_day", F.explode("_codes").alias("code"))


def memory_audit(
    memory: DataFrame, signals: DataFrame, snapshots: DataFrame, lookback: int = 30, tolerance: float = 1e-6,
) -> DataFrame:
    """Violations ``code, n`` of memory rows against the signals they refer to."""
    from riskgraph.operators.joins import lookup_join

    source = signals.select(
        "signal_id", F.col("node_id").alias("_node"), F.col("event_day").alias("_day"), F.col("confidence").alias("_conf")
    )
    joined = lookup_join(lookup_join(memory, source, ["signal_id"], "left"),
                         snapshots.select("snapshot", "query_day"), ["snapshot"], "left")
    age = F.col("query_day") - F.col("_day")
    rules = {
        "memory_index_bounds": F.col("_day").isNotNull(),
        "memory_future_leak": F.col("_day").isNull() | (age > 0),
        "memory_lookback": F.col("_day").isNull() | (age <= lookback),
        "memory_entity_link": F.col("_node").isNull() | (F.col("_node") == F.col("node_id")),
        "memory_delta": F.col("_day").isNull() | (F.col("age_days") == age),
        "memory_confidence": F.col("_conf").isNull() | (F.abs(F.col("confidence") - F.col("_conf")) <= tolerance),
    }
    found = row_violations(joined, rules, F.concat_ws("/", "snapshot", "node_id", "signal_id"))
    repeated = duplicates(memory, ["snapshot", "node_id", "signal_id"]).select(
        F.lit("memory_duplicate").alias("code"), F.concat_ws("/", "snapshot", "node_id", "signal_id").alias("detail")
    )
    return found.unionByName(repeated)


def parameter_differences(runs: DataFrame, protocol: DataFrame, run: str = "run") -> DataFrame:
    """Protocol values (``run, config MAP``) that a run's config does not repeat, compared null-safely."""
    expected = protocol.select(run, F.explode("config").alias("key", "expected"))
    actual = runs.select(run, F.explode("config").alias("key", "actual"))
    return expected.join(actual, [run, "key"], "full_outer").filter(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    )


def bound_violations(metrics: DataFrame, keys: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Metric values outside their bounds, not finite, or NULL although their denominator is not empty."""
    v = F.col("value")
    bad = F.when(v.isNull() & (F.col("support") > 0), "missing").when(
        v.isNotNull() & (F.isnan(v) | (v < low) | (v > high)), "out_of_bounds"
    ).when(v.isNotNull() & (F.col("support") == 0), "value_without_support")
    return metrics.select(*keys, "value", "support", bad.alias("problem")).filter(F.col("problem").isNotNull())


def metric_differences(
    recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], relative: float = 1e-12, absolute: float = 1e-12,
) -> DataFrame:
    """Stored metrics that are not what the predictions give: ``keys, metric, recomputed, stored, problem``.

    ``recomputed`` and ``stored`` hold ``(keys, metric, value)``. An undefined (null) metric equals an absent one. ``missing``:
    defined but not stored; ``extra``: stored but not defined; ``repeated``: stored more than once; ``differs``: further apart
    than ``absolute + relative * |stored|``, a NaN included. Null keys are keys; both sides meet in one aggregate.
    """
    on = [*keys, "metric"]
    value = F.col("value").cast("double")
    both = recomputed.select(*on, value.alias("recomputed"), F.lit(None).cast("double").alias("stored"), F.lit(0).alias("_n")).unionByName(
        stored.select(*on, F.lit(None).cast("double").alias("recomputed"), value.alias("stored"), F.lit(1).alias("_n"))
    ).groupBy(*on).agg(F.max("recomputed").alias("recomputed"), F.max("stored").alias("stored"), F.sum("_n").alias("_n"))
    a, b = F.col("recomputed"), F.col("stored")
    close = ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= absolute + relative * F.abs(b)))
    problem = (
        F.when(F.col("_n") > 1, "repeated").when(a.isNotNull() & b.isNull(), "missing").when(a.isNull() & b.isNotNull(), "extra")
        .when(a.isNotNull() & ~close, "differs")
    )
    return both.select(*on, "recomputed", "stored", problem.alias("problem")).filter(F.col("problem").isNotNull())


def signal_text_violations(
    signals: DataFrame, texts: DataFrame, signal: Sequence[str] = ("signal_id",), node: str = "node_id", day: str = "event_day",
) -> DataFrame:
    """Signals whose text is unknown (``signal_text_link``) or of another entity or day (``signal_text_consistency``).

    ``signals(signal.., text_id, node, day)``, ``texts(text_id, node, day)`` with one row a text. Null entities and days are
    equal to null ones only; a signal without a text id has an unknown text.
    """
    known = texts.select("text_id", F.struct(F.col(node).alias("node"), F.col(day).alias("day")).alias("_text"))
    code = F.when(F.col("_text").isNull(), "signal_text_link").when(
        ~(F.col("_text.node").eqNullSafe(F.col(node)) & F.col("_text.day").eqNullSafe(F.col(day))), "signal_text_consistency"
    )
    return lookup_join(signals.select(*signal, "text_id", node, day), known, ["text_id"], "left").select(
        *signal, "text_id", code.alias("code")
    ).filter(F.col("code").isNotNull())


def protocol_coverage(runs: DataFrame, datasets: Sequence[str], modes: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Runs missing from or extra to the declared dataset x mode x seed protocol."""
    grid = (
        runs.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))
        .select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
        .select("*", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    )
    return reconcile(grid, runs.select("dataset", "mode", "seed").distinct(), ["dataset", "mode", "seed"])


def prediction_violations(
    predictions: DataFrame, expected: DataFrame, keys: Sequence[str] = ("snapshot", "node_id"), prob: str = "prob"
) -> DataFrame:
    """Scores that are missing, extra, repeated, not finite, outside [0, 1] or carry another label."""
    from riskgraph.functions.numeric import is_finite

    row_rules = {
        "finite": is_finite(prob),
        "bounds": F.col(prob).isNull() | F.isnan(prob) | F.col(prob).between(0.0, 1.0),
    }
    detail = F.concat_ws("/", *keys)
    found = row_violations(predictions, row_rules, detail)
    rows = reconcile(expected, predictions, keys, ["label"]).select(
        F.concat(F.lit("row_"), F.col("status")).alias("code"), detail.alias("detail")
    )
    again = duplicates(predictions, keys).select(F.lit("row_repeated").alias("code"), detail.alias("detail"))
    return found.unionByName(rows).unionByName(again)
