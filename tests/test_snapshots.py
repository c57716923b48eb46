"""Window boundaries, the end-to-end build and annotation import."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskgraph.functions.dates import day_to_iso, parse_compact, parse_day, parse_mixed
from riskgraph.operators import annotate as N
from riskgraph.operators import audit as A
from riskgraph.operators import temporal as T
from riskgraph.plans import snapshots as P

Q, L, H = 100, 30, 30


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(0, Q, Q + H)], "snapshot int, query_day int, target_day int")


@pytest.mark.parametrize("closed,days", [(False, [Q - 1, Q - L + 1]), (True, [Q - 1, Q - L + 1, Q - L])])
def test_lookback_boundaries(spark, calendar, closed, days):
    s = spark.createDataFrame([(d, "n", d) for d in (Q, Q - 1, Q - L, Q - L + 1, Q - L - 1)], "signal_id int, node_id string, event_day int")
    got = T.lookback_memory(s, calendar, 5, L, closed).orderBy("slot").collect()
    assert [r.event_day for r in got] == days and [r.age_days for r in got] == [Q - d for d in days]


def test_latest_k_with_ties_and_hot_day(spark, calendar):
    s = spark.createDataFrame([(i, "n", Q - 1 - i % 2) for i in range(50)], "signal_id int, node_id string, event_day int")
    got = T.lookback_memory(s, calendar, 3, L).orderBy("slot").collect()
    assert [r.signal_id for r in got] == [48, 46, 44]


def test_horizon_boundaries(spark, calendar):
    flagged = spark.createDataFrame([("a", Q), ("b", Q + H - 1), ("c", Q + H), ("d", Q - 1)], "node_id string, event_day int")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node_id string")
    got = {r.node_id: r.label for r in T.horizon_labels(nodes, flagged, calendar).collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 0, "e": 0}


@pytest.mark.parametrize("seed", range(3))
def test_label_intervals_stand_for_the_grid(spark, seed):
    import random

    rng = random.Random(seed)
    days = sorted(rng.sample(range(100), 12)) if seed else []
    cal = [(s, q, q + rng.choice((1, 5, 20))) for s, q in zip(rng.sample(range(50), len(days)), days)]
    calendar = spark.createDataFrame(cal, "snapshot int, query_day int, target_day int")
    flagged = [(rng.choice("abc"), rng.choice([None, *range(100)])) for _ in range(12)] + [(None, 5)]
    events = spark.createDataFrame(flagged, "node_id string, event_day int")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node_id string")
    want = {(s, n): int(any(m == n and e is not None and q <= e < t for m, e in flagged)) for s, q, t in cal for n in "abcd"}
    runs = T.horizon_intervals(events, calendar)
    assert {(r.snapshot, r.node_id): r.label for r in T.interval_labels(nodes, runs, calendar).collect()} == want
    assert rows(T.interval_positives(runs, calendar)) == sorted((k for k, v in want.items() if v), key=repr)
    counts = {r.snapshot: (r.positive, r.negative) for r in T.interval_label_counts(runs, calendar, 4).collect()}
    assert counts == {s: (sum(want[s, n] for n in "abcd"), sum(1 - want[s, n] for n in "abcd")) for s, _, _ in cal}
    assert A.interval_audit(runs, calendar).count() == 0
    cells = [[want[s, n] for s, _, _ in cal] for n in "abcd"]
    assert runs.count() == sum(v == 1 and (i == 0 or c[i - 1] == 0) for c in cells for i, v in enumerate(c))


def test_query_days_of_labels_are_distinct(spark):
    twice = spark.createDataFrame([(0, 5, 9), (1, 5, 10)], "snapshot int, query_day int, target_day int")
    with pytest.raises(Exception, match="distinct"):
        T.horizon_intervals(spark.createDataFrame([("a", 6)], "node_id string, event_day int"), twice).collect()


def test_faulty_label_intervals(spark, built):
    import dataclasses

    cal = spark.createDataFrame([(i, 10 * i, 10 * i + 5) for i in range(5)], "snapshot int, query_day int, target_day int")
    runs = [("a", 0, 10, 2), ("a", 20, 20, 1), ("b", 5, 10, 1), ("c", 10, 99, 1), ("d", 30, 10, 3), ("e", 0, 20, None), ("f", 0, 0, 1), ("f", 20, 40, 3)]
    got = A.interval_audit(spark.createDataFrame(runs, "node_id string, first_query_day int, last_query_day int, n_snapshots int"), cal)
    assert rows(got) == [("a", 20, "interval_overlap"), ("b", 5, "interval_start"), ("c", 10, "interval_end"), ("d", 30, "interval_size"), ("e", 0, "interval_size")]
    longer = built.label_intervals.withColumn("n_snapshots", F.col("n_snapshots") + 1)
    with pytest.raises(A.AuditError, match="label intervals"):
        P.self_audit(dataclasses.replace(built, label_intervals=longer), all_splits=False)
    got = {r.split: (r.positive, r.negative) for r in P.label_summary(built).collect()}
    known = built.node_labels.join(built.snapshots, "snapshot").groupBy("split").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert got == {-1: (0, 0), **{r.split: (r.p, r.n - r.p) for r in known}}


def test_split_purges_windows_reaching_the_next_boundary(spark):
    cal = spark.createDataFrame([(i, q, q + 30) for i, q in enumerate((0, 10, 39, 40, 69, 70))], "snapshot int, query_day int, target_day int")
    got = [r.split for r in T.split_by_boundaries(cal, 40, 70).orderBy("snapshot").collect()]
    assert got == [0, -1, -1, -1, -1, 2]


def day(text):
    import datetime

    return (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days


@pytest.fixture(scope="module")
def built(spark):
    entities = spark.createDataFrame([("e1", "One", "Company"), ("e2", "Two", "Product"), ("e3", "Late", "Region")], "entity_id string, name string, entity_type string")
    relations = spark.createDataFrame(
        [("x1", "e1", "e2", "Supplies", "2021-05-01"), ("x2", "e1", "e3", "Supplies", "2021-05-01"), ("x3", "e2", "e1", "Holding", "2022-05-01"), ("x4", "e2", "e1", "Holding", None)],
        "edge_id string, src string, dst string, rel string, first_event_date string")
    ctx = [("c1", "d1", "2021-12-20", "plain words", 0), ("c2", "d1", "2022-01-05", "a Layoff and a strike", 10), ("c3", "d1", "2022-01-05", "Layoff again", 12),
           ("c4", "d2", "2021-12-30", "quiet day", 0), ("c5", "d3", "2022-02-01", "制裁 news", 0), ("c6", "d4", "2022-01-20", "wrong date", 0)]
    contexts = spark.createDataFrame(ctx, "context_id string, doc_id string, context_date string, text string, char_start int")
    links = spark.createDataFrame(
        [("e1", "c1", "2021-12-20"), ("e1", "c2", "2022-01-05"), ("e1", "c3", "2022-01-05"), ("e2", "c4", "2021-12-30"), ("e2", "c4", "2021-12-30"),
         ("e2", "c5", "2022-02-01"), ("e3", "c5", "2022-02-01"), ("e2", "c6", "2022-01-21")], "entity_id string, context_id string, context_date string")
    return P.build(entities, relations, contexts, links, day("2022-01-01"), day("2022-02-01"), day("2022-03-01"), day("2022-04-01"))


def test_build_selects_known_nodes_and_edges(built):
    assert [r.node_id for r in built.nodes.orderBy("node_idx").collect()] == ["e1", "e2"]
    assert [r.edge_id for r in built.edges.collect()] == ["x1"]
    assert built.signals.count() == 5


def test_build_memory_labels_and_evidence(built):
    first = built.memory.filter("snapshot = 0")
    assert rows(first.select("node_id", "signal_id", "age_days")) == [("e1", "c1", 12), ("e2", "c4", 2)]
    labels = {(r.snapshot, r.node_id): r.label for r in built.node_labels.collect()}
    assert labels[0, "e1"] == 1 and labels[0, "e2"] == 0
    purged = {r.snapshot for r in built.snapshots.filter("split = -1").collect()}
    assert 1 in purged and not purged & {s for s, _ in labels}
    assert not purged & {r.snapshot for r in built.label_evidence.collect()}
    evidence = built.label_evidence.filter("snapshot = 0 and node_id = 'e1'").collect()
    # Both contexts quote the same span of document d1 once.
    assert [(r.phrase, r.document_start, r.context_id) for r in evidence] == [("Layoff", 12, "c2")]


def test_build_passes_its_audit_and_leaks_are_found(built):
    import dataclasses

    P.self_audit(built, all_splits=False)
    with pytest.raises(A.AuditError, match="split_coverage"):  # no window lies in the short validation period
        P.self_audit(built)
    purged = built.snapshots.filter("split = -1").select("snapshot", F.lit("e1").alias("node_id"), F.lit(0).alias("label"))
    labelled = dataclasses.replace(built, node_labels=built.node_labels.unionByName(purged))
    with pytest.raises(A.AuditError, match="purged_label"):
        P.self_audit(labelled, all_splits=False)

    broken = dataclasses.replace(built, memory=built.memory.withColumn("age_days", F.lit(-1)))
    with pytest.raises(A.AuditError, match="memory_future_leak"):
        P.self_audit(broken, all_splits=False)
    again = dataclasses.replace(built, memory=built.memory.unionByName(built.memory.limit(1)))
    with pytest.raises(A.AuditError, match="memory_duplicate"):
        P.self_audit(again, all_splits=False)
    proofless = dataclasses.replace(built, label_evidence=built.label_evidence.filter("snapshot > 0"))
    with pytest.raises(A.AuditError, match="without evidence"):
        P.self_audit(proofless, all_splits=False)


def test_target_windows_may_not_reach_the_next_split(spark):
    snaps = spark.createDataFrame([(0, 0, 30, 0), (1, 30, 40, 1), (2, 60, 70, 2)], "snapshot int, query_day int, target_day int, split int")
    labels = spark.createDataFrame([(0, "a", 1)], "snapshot int, node_id string, label int")
    memory = spark.createDataFrame([(0, "a", 1, 1)], "snapshot int, node_id string, signal_id int, age_days int")
    got = {r.code: r.n for r in A.snapshot_audit(snaps, labels, memory).collect()}
    assert got["split_target_leak"] == 1 and got["split_chronology"] == 0 and got["split_coverage"] == 0


def test_dates(spark):
    df = spark.createDataFrame(
        [("20180230", "02/30/18", "2018-2-3"), (" 20180228 ", "1/2/69", "17564"), ("2018022", "1/2/68", "2018-02-03")], "a string, b string, c string")
    got = df.select(day_to_iso(F.unix_date(parse_compact("a"))), parse_mixed("b").cast("string"), parse_day("c")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("2018-02-28", "1969-01-02", 17564), (None, "2068-01-02", 17565)]


# --- annotations ------------------------------------------------------------------------------

FIELDS = N.NODE_FIELDS + ["event_date"]
GOOD = dict(query_day="0", target_day="30", label="1", evidence_url="u", evidence_span="s", reviewer="r", verified="1", entity_id="a", event_date="5")


@pytest.fixture(scope="module")
def world(spark):
    snaps = spark.createDataFrame([(0, 0, 30, 0), (1, 40, 70, 1), (2, 80, 110, 2)], "snapshot int, query_day int, target_day int, split int")
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([(0, "a", "b", "Supplies"), (1, "a", "b", "InvestsIn")], "edge_id int, src string, dst string, rel string")
    return snaps, nodes, edges


def node_rows(spark, *rows_):
    return spark.createDataFrame([[r[f] for f in FIELDS] for r in rows_], ", ".join(f"{f} string" for f in FIELDS))


def test_good_annotations(spark, world):
    negative = dict(GOOD, entity_id="b", label="0", event_date="", query_day="1970-01-01", target_day="1970-01-31")
    edge = dict(query_day="0", target_day="30", label="0", evidence_url="u", evidence_span="s", reviewer="r", verified="1", source_id="a", target_id="b", relation_type="InvestsIn")
    edge_rows = spark.createDataFrame([[edge[f] for f in N.EDGE_FIELDS]], ", ".join(f"{f} string" for f in N.EDGE_FIELDS))
    out = N.import_annotations(*world, node_rows(spark, GOOD, negative), edge_rows)
    assert rows(out["node_labels"].select("snapshot", "node_id", "label")) == [(0, "a", 1), (0, "b", 0)]
    assert rows(out["edge_labels"].select("snapshot", "edge_id", "label")) == [(0, 1, 0)]


@pytest.mark.parametrize("change", [
    dict(entity_id="zz"), dict(target_day="31"), dict(event_date="30"), dict(verified="0"), dict(evidence_span=" "), dict(label="-1"),
    dict(event_date=""), dict(query_day="1970-1-1"), dict(label="0"),
])
def test_bad_annotations_are_refused(spark, world, change):
    with pytest.raises(A.AuditError):
        N.import_annotations(*world, node_rows(spark, dict(GOOD, **change)))


def test_conflicts_duplicates_and_empty_submissions(spark, world):
    with pytest.raises(A.AuditError, match="conflict"):
        N.import_annotations(*world, node_rows(spark, GOOD, dict(GOOD, label="0", event_date="")))
    with pytest.raises(A.AuditError, match="duplicate"):
        N.import_annotations(*world, node_rows(spark, GOOD, GOOD))
    with pytest.raises(A.AuditError, match="no reviewed"):
        N.import_annotations(*world, node_rows(spark, GOOD).filter("1 = 0"))


def test_spread_and_first_samples(spark):
    for n in (0, 1, 2, 15, 16, 17, 100, 1001):
        rows_ = spark.createDataFrame([(i, f"g{i % 1}") for i in range(n)], "k long, g string")
        m = min(16, n)
        want = [0] if m == 1 else [n - 1 if i == m - 1 else int(i * ((n - 1) / (m - 1))) for i in range(m)]
        assert sorted(r.k for r in T.spread_sample(rows_, ["k"], 16, ["g"]).collect()) == want
    df = spark.createDataFrame([(i, i % 3 == 0 if i % 5 else None) for i in range(40)], "k long, m boolean")
    got = T.first_and_spread(df, df.m, ["k"], 4).collect()
    others = [i for i in range(40) if not (i % 3 == 0 and i % 5)]
    assert sorted(r.k for r in got if r.marked) == [3, 6, 9, 12] and sorted(r.k for r in got if not r.marked) == [others[int(i * (len(others) - 1) / 3)] for i in range(4)]
