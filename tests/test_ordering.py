"""Joins and orders under skew, against plain joins and Python."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgraph.operators.joins import attach_group_stats, lookup_join, null_safe_join
from riskgraph.operators.ordering import chunked_lists, dense_index, ordered_position, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    # Key 0 holds half of the rows; one key is NULL.
    data = [(0 if i % 2 else (None if i == 4 else i % 7), i, (i * 37) % 11) for i in range(120)]
    return spark.createDataFrame(data, "k int, i int, v int").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_a_join(spark, skewed, how):
    lookup = spark.createDataFrame([(0, "zero"), (1, "one"), (5, "five"), (9, "nine")], "k int, name string")
    assert rows(lookup_join(skewed, lookup, ["k"], how)) == rows(skewed.join(lookup, ["k"], how))


def test_null_safe_join_meets_null(spark, skewed):
    lookup = spark.createDataFrame([(0, "zero"), (None, "none")], "k int, name string")
    got = rows(null_safe_join(skewed, lookup, ["k"]).select("k", "i", "name"))
    assert got == sorted(((r.k, r.i, "zero" if r.k == 0 else "none") for r in skewed.collect() if r.k in (0, None)), key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1, "hot_rows": 10}, {"broadcast_bytes": -1}])
def test_group_stats_equal_a_window(skewed, options):
    """Null groups, equal rows and map columns give the same rows on both sides of every switch."""
    doubled = skewed.unionByName(skewed).withColumn("m", F.create_map(F.lit("a"), "v"))
    got = attach_group_stats(doubled, ["k"], {"top": F.max("v")}, **options).select("k", "i", "top", F.col("m")["a"].alias("v"))
    data = skewed.collect()
    want = sorted(((r.k, r.i, max(x.v for x in data if x.k == r.k), r.v) for r in data for _ in range(2)), key=repr)
    assert rows(got) == want


@pytest.mark.parametrize("group", [(), ("k",)])
def test_positions_and_totals(skewed, group):
    df = skewed  # with a null group
    data = sorted(df.collect(), key=lambda r: ([(r[g] is not None, r[g]) for g in group], r.v, r.i))
    seen, before, want_pos, want_sum = {}, {}, [], []
    for r in data:
        g = tuple(r[c] for c in group)
        want_pos.append((r.i, seen.get(g, 0)))
        want_sum.append((r.i, before.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
        before[g] = before.get(g, 0) + r.v
    assert rows(ordered_position(df, ["v", "i"], group, partitions=5).select("i", "position")) == sorted(want_pos, key=repr)
    assert rows(running_totals(df, ["v", "i"], {"s": "v"}, group, partitions=5).select("i", "s")) == sorted(want_sum, key=repr)


def test_chunked_lists_keep_everything(skewed):
    got = chunked_lists(skewed.filter("k is not null"), ["k"], ["i"], "i", "items", 7).collect()
    assert max(len(r["items"]) for r in got) == 7
    joined = {}
    for r in sorted(got, key=lambda r: (r["k"], r["chunk"])):
        joined.setdefault(r["k"], []).extend(r["items"])
    want = {}
    for r in sorted(skewed.filter("k is not null").collect(), key=lambda r: r.i):
        want.setdefault(r.k, []).append(r.i)
    assert joined == want


def test_dense_index_follows_sorted_ids(spark):
    ids = [f"n{random.Random(i).randint(0, 40)}" for i in range(60)]
    got = dense_index(spark.createDataFrame([(x,) for x in ids], "node_id string"), "node_id")
    assert rows(got) == [(x, i) for i, x in enumerate(sorted(set(ids)))]


def test_order_breaks_with_null_key_and_both_forms(spark):
    from riskgraph.operators.stats import order_breaks

    data = [(None, 0, 1), (None, 1, 2), (None, 2, 2), ("a", 0, 1), ("a", 1, 3), ("a", 2, 4)]
    df = spark.createDataFrame(data, "k string, seq int, v int")
    assert [tuple(r) for r in order_breaks(df, ["k"], "v").collect()] == [(None, 2, 2)]
    assert sorted((str(r.k), r.seq) for r in order_breaks(df, ["k"], "v", contiguous=True).collect()) == [("None", 2), ("a", 1)]
