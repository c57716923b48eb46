"""Paths, proofs, propagation and cascades against direct walks."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgraph.operators import graph as G
from riskgraph.operators import knowledge as K
from riskgraph.operators import propagate as P


def edge_frame(spark, edges):
    return spark.createDataFrame(
        [(0, i, s, t, float(x)) for i, (s, t, x) in enumerate(edges)], "snapshot int, edge_id int, src int, dst int, intensity double"
    )


def source_frame(spark, *ids):
    return spark.createDataFrame([(0, i) for i in ids], "snapshot int, node_id int")


def walk_beam(edges, source, width, hops, top, min_hops=1):
    beam, out = [(0.0, (source,), ())], []
    for depth in range(1, hops + 1):
        grown = [
            (v + math.log(x), n + (t,), e + (i,))
            for v, n, e in beam for i, (s, t, x) in enumerate(edges) if s == n[-1] and x > 0 and t not in n
        ]
        beam = sorted(grown, key=lambda p: (-p[0], p[1], p[2]))[:width]
        out += beam if depth >= min_hops else []
    return sorted(out, key=lambda p: (-p[0], p[1], p[2]))[:top]


def found(df):
    return [(r.source, tuple(r.nodes), tuple(r.edge_ids)) for r in df.orderBy("source", "rank").collect()]


def test_cycle_is_not_entered(spark):
    edges = [(0, 1, 2), (1, 2, 3), (2, 0, 4), (0, 3, 0.8), (3, 4, 0.9)]
    got = G.beam_search(edge_frame(spark, edges), source_frame(spark, 0), 8, 5, 5).orderBy("rank").first()
    assert got.nodes == [0, 1, 2] and got.score == pytest.approx(6)


def test_weak_targets_and_zero_edges_are_dropped(spark):
    probs = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.1)], "node_id int, prob double")
    got = G.beam_search(edge_frame(spark, [(0, 1, 0), (0, 2, 0.7)]), source_frame(spark, 0), node_prob=probs, min_prob=0.5)
    assert got.count() == 0


def test_bad_intensity_fails(spark):
    with pytest.raises(Exception, match="finite and not negative"):
        G.beam_search(edge_frame(spark, [(0, 1, -1)]), source_frame(spark, 0)).count()
    with pytest.raises(Exception, match="finite and not negative"):  # an edge that no path reaches
        G.beam_search(edge_frame(spark, [(0, 1, 1), (7, 8, float("nan"))]), source_frame(spark, 0)).count()


def test_written_edges_are_checked_and_read_where_they_lie(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(G, "durable", lambda df, label: labels.append(label) or df.localCheckpoint())
    rng = random.Random(5)
    edges = [(rng.randrange(8), rng.randrange(8), rng.random()) for _ in range(40)]
    found = lambda **how: rows(G.beam_search(edge_frame(spark, edges), source_frame(spark, 0, 1), 3, 3, 5, **how))
    want = found()
    assert "usable" in labels
    labels.clear()
    assert found(written=True) == want and want and "usable" not in labels
    with pytest.raises(Exception, match="finite and not negative"):
        G.beam_search(edge_frame(spark, [(0, 1, 1), (7, 8, -1)]), source_frame(spark, 0), written=True)


def test_true_paths_take_written_edges_where_they_lie(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(G, "durable", lambda df, label: labels.append(label) or df.localCheckpoint())
    rng = random.Random(7)
    edges = edge_frame(spark, [(rng.randrange(8), rng.randrange(8), rng.random()) for _ in range(40)])
    edges = edges.withColumn("label", F.when(F.col("edge_id") % 5 > 0, F.col("edge_id") % 2))
    want = rows(G.path_metrics(edges, None, source_frame(spark, 0, 1, 2)))
    labels.clear()
    assert rows(G.path_metrics(edges, None, source_frame(spark, 0, 1, 2), written=True)) == want
    assert not {"labelled", "usable"} & set(labels) and "common" in labels


def test_flow_holds_the_edges_in_numbers(spark, monkeypatch):
    from riskgraph.catalog import base

    stored = []
    monkeypatch.setattr(base, "durable", lambda df, label: stored.append(df.schema) or df)
    d = "/root/testdata/sf0.001"
    order = ["snapshot", "src", "dst", "rel", "qty", "label", "dependency"]
    assert rows(base.edge_flow(spark, d).select(order)) == rows(base.edge_rows(spark, d).select(order))
    assert "string" not in {f.dataType.simpleString() for f in stored[0]}


@pytest.mark.parametrize("seed", [1, 2])
def test_beam_equals_direct_search(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(9), r.randrange(9), round(r.uniform(0.1, 1.5), 3)) for _ in range(70)] + [(0, t, 0.5) for t in range(9)]
    width, hops, top = 3, 4, 6
    got = found(G.beam_search(edge_frame(spark, edges), source_frame(spark, 0, 1, 2, 99), width, hops, top, 2))
    want = [(s, n, e) for s in (0, 1, 2) for _, n, e in walk_beam(edges, s, width, hops, top, 2)]
    assert got == want


@pytest.mark.parametrize("width", [1, 2])
def test_strong_parallel_edges_back_do_not_hide_the_way_on(spark, width):
    back = [(a, b, 2.0) for a in range(5) for b in range(a + 1) for _ in range(3)]  # self-loops and returns, each three times
    edges = back + [(a, a + 1, 0.5) for a in range(5)] + [(a, a + 2, 0.4) for a in range(4)]
    got = found(G.beam_search(edge_frame(spark, edges), source_frame(spark, 0, 3), width, 5, 10))
    assert got == [(s, n, e) for s in (0, 3) for _, n, e in walk_beam(edges, s, width, 5, 10)]


def test_simple_paths_and_unknown_edges(spark):
    edges = [(0, 1, 0.2), (0, 2, 0.99), (1, 3, 0.5), (3, 0, 0.5)]
    df = edge_frame(spark, edges)
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, None), (0, 2, 0)], "snapshot int, edge_id int, label int")
    out = G.path_metrics(df, labels, source_frame(spark, 0), top_k=1).first()
    assert (out.path_precision, out.path_recall, out.path_at_k) == (1.0, 1.0, 1.0)
    all_paths = {tuple(r.nodes) for r in G.simple_paths(df, source_frame(spark, 0), 4).collect()}
    assert all_paths == {(0, 1), (0, 2), (0, 1, 3)}


@pytest.mark.parametrize("seed,hops", [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)])
def test_counted_paths_and_edges_equal_the_listing(spark, seed, hops):
    r = random.Random(seed)
    edges = [(r.randrange(8), r.randrange(8), 1) for _ in range(26)] + [(0, t, 1) for t in range(5)] * 2
    df, starts = edge_frame(spark, edges), source_frame(spark, 0, 3, 3, 99)
    listed = [tuple(p.nodes) for p in G.simple_paths(df, starts, hops).collect()]
    assert len(listed) == len(set(listed))
    assert rows(G.path_counts(df, starts, hops, cap=len(listed))) == [(0, len(listed), False)]
    on_paths = {(0, a, b) for p in listed for a, b in zip(p, p[1:])}
    assert rows(G.edges_on_paths(df, starts, hops)) == sorted(on_paths, key=repr)
    predicted = [(0, 0, [0, 1]), (0, 0, [0, 7, 6]), (0, 3, [3, 0, 2]), (0, 3, [3, 1])]
    confirmed = G.confirmed_paths(spark.createDataFrame(predicted, "snapshot int, source int, nodes array<int>"), df)
    known = {(s, t) for s, t, _ in edges}
    assert {(p.source, tuple(p.nodes)): p.true for p in confirmed.collect()} == {
        (s, tuple(n)): int(all(step in known for step in zip(n, n[1:]))) for _, s, n in predicted}
    leaving = {s for s, t in known if s != t}
    assert {h.source for h in G.source_hits(confirmed, df, starts).collect()} == leaving & {0, 3}


def test_path_through_the_only_entry_is_no_path(spark):
    edges = [(0, 1, 1), (1, 2, 1), (2, 1, 1), (2, 0, 1), (2, 3, 1)]
    assert rows(G.edges_on_paths(edge_frame(spark, edges), source_frame(spark, 0), 4)) == [(0, 0, 1), (0, 1, 2), (0, 2, 3)]
    empty = edge_frame(spark, edges).limit(0)
    assert G.path_counts(empty, source_frame(spark, 0), 4).isEmpty() and G.edges_on_paths(empty, source_frame(spark, 0), 4).isEmpty()


def test_long_subclass_chain_has_no_proof(spark):
    arcs = spark.createDataFrame([(f"Q{i}", f"Q{i + 1}", f"s{i}", 0) for i in range(14)], "child string, parent string, statement_id string, seq int")
    roots = spark.createDataFrame([("firm", "Q14")], "kind string, qid string")
    starts = spark.createDataFrame([("Q0",), ("Q2",), ("Q14",)], "qid string")
    got = {r.start: len(r.proof) for r in G.proof_paths(starts, arcs, roots).collect()}
    assert got == {"Q2": 12, "Q14": 0}


def test_classification_rules(spark):
    arcs = spark.createDataFrame([("QC", "QF", "s1", 0), ("QC", "QP", "s2", 1)], "child string, parent string, statement_id string, seq int")
    roots = spark.createDataFrame([("firm", "QF"), ("product", "QP"), ("fictional", "QX")], "kind string, qid string")
    inst = spark.createDataFrame([("a", "QF"), ("b", "QC"), ("c", "QX"), ("d", "Q?")], "qid string, class_qid string")
    ents = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "QC"]], "qid string")
    got = {r.qid: (r.entity_type, r.type_reason.split("_")[0]) for r in G.classify_entities(ents, inst, arcs, roots).collect()}
    assert got == {"a": ("firm", "official"), "b": ("unclassified", "ambiguous"), "c": ("unclassified", "fictional"),
                   "d": ("unclassified", "no"), "QC": ("product", "official")}


def test_type_evidence_names_every_statement(spark):
    arcs = spark.createDataFrame(
        [("QC", "QD", "s1", 0), ("QC", "QP", "s2", 1), ("QD", "QP", "s3", 0), ("QP", "QC", "s4", 0)],
        "child string, parent string, statement_id string, seq int")
    roots = spark.createDataFrame([("firm", "QD"), ("product", "QP")], "kind string, qid string")
    inst = spark.createDataFrame([("a", "QC", "i1"), ("a", "QP", "i2"), ("b", "Q?", "i3")], "qid string, class_qid string, statement_id string")
    found = G.type_evidence(inst, arcs, roots)
    got = sorted((r.qid, r.kind, [s.statement_id for s in r.proof]) for r in found.collect())
    assert got == [
        ("QC", "product", ["s2"]), ("QD", "product", ["s3"]), ("QP", "product", []),
        ("a", "firm", ["i1", "s1"]), ("a", "firm", ["i2", "s4", "s1"]), ("a", "product", ["i1", "s2"]), ("a", "product", ["i2"]),
    ]
    steps = G.proof_steps(found)
    assert K.proof_gaps(steps, ["classified_qid", "supported_type", "first_statement_id"]).isEmpty()
    saved = steps.filter("statement_id != 's4'").select("subject_qid", "property_id", "object_qid", "statement_id")
    assert [(r.classified_qid, r.step, r.statement_id) for r in K.unproven_steps(steps, saved).collect()] == [("a", 1, "s4")]


def test_transport_identities(spark):
    edges = spark.createDataFrame(
        [(i, s, t, r, b, x) for i, (s, t, r, b, x) in enumerate(
            [(0, 1, 0, 0.1, 900.0), (0, 2, 0, 0.2, -3.0), (0, 3, 1, 0.3, 1.0), (1, 2, 0, 0.4, 2.0), (2, 3, 1, 0.5, 0.0), (3, 4, 0, 0.6, 5.0)])],
        "edge_id int, src int, dst int, rel int, beta double, logit double")
    nodes = spark.createDataFrame([(i, 2.0 + i, 1.0) for i in range(5)], "node_id int, load double, theta double")
    moved = P.transport(edges, nodes).cache()
    sums = moved.groupBy("src", "rel").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    for r in moved.collect():
        assert r.transmitted == pytest.approx((1.0 + r.src) * r.share * (1 - r.beta))
    incoming = {r.node_id: r.incoming for r in P.incoming_load(nodes, moved).collect()}
    assert incoming[0] == 0.0 and sum(incoming.values()) == pytest.approx(sum(r.transmitted for r in moved.collect()))
    prob = nodes.select("node_id", F.lit(0.5).alias("prob"))
    for r in P.edge_intensity(moved, prob).collect():
        assert r.edge_prob == pytest.approx(1 - math.exp(-r.intensity))


def test_softmax_with_hot_source(spark):
    edges = spark.createDataFrame([(i, 0, "r", float(i % 50) * 10) for i in range(200)], "edge_id int, src int, rel string, logit double")
    got = P.group_softmax(edges, broadcast_bytes=-1, hot_rows=10).collect()
    norm = sum(math.exp(r.logit - 490) for r in got)
    assert len(got) == 200 and all(r.share == pytest.approx(math.exp(r.logit - 490) / norm, abs=1e-12) for r in got)


def test_cascade_replay(spark):
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 3, 4)], "edge_id int, src int, dst int")
    shocks = spark.createDataFrame([(0, 0, 0.9), (0, 3, 0.7)], "snapshot int, node_id int, severity double")
    capacity = spark.createDataFrame([(0, n, 0.5) for n in range(5)], "snapshot int, node_id int, capacity double")
    events = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1)], "snapshot int, edge_id int, stage int")
    out = G.replay_cascade(edges, shocks, events, capacity)
    assert rows(out["initial"]) == [(0, 0)] and rows(out["violations"]) == [(0, 2, 1)]
    assert rows(out["node_truth"]) == [(0, 0), (0, 1), (0, 2), (0, 4)]


def test_cascade_records_with_faults(spark):
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "edge_id int, src int, dst int")
    capacity = spark.createDataFrame([(0, n, 0.5) for n in range(3)], "snapshot int, node_id int, capacity double")
    days = spark.createDataFrame([(0, 100)], "snapshot int, query_day int")
    shocks = spark.createDataFrame(
        [(0, 0, 0.9, 101, 0), (0, 0, 0.9, 101, 1), (0, 1, float("nan"), 101, 2), (0, 2, -1.0, None, 3), (0, 9, 0.9, 101, 4),
         (7, 0, 0.9, 101, 5), (0, None, 0.9, 101, 6)],
        "snapshot int, node_id int, severity double, event_day int, seq int")
    events = spark.createDataFrame(
        [(0, 0, 1, 110, 0), (0, 1, 2, 121, 1), (0, 1, 2, 120, 2), (0, 0, 4, 140, 3), (0, 5, 1, 110, 4), (0, 1, None, 120, 5)],
        "snapshot int, edge_id int, stage int, event_day int, seq int")
    got = {(r.record, r.seq, r.reason) for r in G.cascade_record_violations(edges, shocks, events, capacity, days).collect()}
    assert got == {
        ("shock", 1, "duplicate"), ("shock", 2, "severity"), ("shock", 3, "severity"), ("shock", 3, "time"), ("shock", 4, "position"),
        ("shock", 5, "position"), ("shock", 6, "position"), ("event", 1, "time"), ("event", 2, "duplicate"), ("event", 3, "position"),
        ("event", 4, "position"), ("event", 5, "position")}
    out = G.replay_cascade(edges, shocks, events, capacity)
    assert rows(out["initial"]) == [(0, 0)] and rows(out["edge_truth"]) == [(0, 0), (0, 1)] and out["violations"].isEmpty()
    assert rows(out["node_truth"]) == [(0, 0), (0, 1), (0, 2)]


def test_edges_move_once_to_their_target(spark):
    """Edges, the sums of their targets and a join by target share one exchange after the join of lines and orders."""
    from riskgraph.catalog import base

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        edges = base.edges(spark, "/root/testdata/sf0.001")
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 3 and plan.count("Scan parquet") == 2
        whole = edges.groupBy("snapshot", "dst", "rel").agg(F.sum("dependency").alias("d")).filter("abs(d - 1) > 1e-9")
        assert whole.count() == 0 and edges.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
