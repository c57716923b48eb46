"""Metrics against direct definitions on small data."""

import math
import random

import pytest
from conftest import rows

from riskgraph import runtime
from riskgraph.operators import metrics as M
from riskgraph.operators import stats as S
from riskgraph.operators.audit import AuditError


def auc(data):
    pairs = [(p, n) for y, p in data if y == 1 for z, n in data if z == 0]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)


def average_precision(data):
    total, out, seen = sum(y for y, _ in data), 0.0, 0.0
    for t in sorted({p for _, p in data}, reverse=True):
        chosen = [y for y, p in data if p >= t]
        recall = sum(chosen) / total
        out += (recall - seen) * sum(chosen) / len(chosen)
        seen = recall
    return out


def f1(data, t, positive=1):
    tp = sum(1 for y, p in data if (p >= t) == (positive == 1) and y == positive)
    wrong = sum(1 for y, p in data if ((p >= t) == (y == 1)) is False)
    return 2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0


def frame(spark, data):
    return spark.createDataFrame([(y, float(p)) for y, p in data], "label int, prob double")


@pytest.fixture(scope="module")
def sample():
    r = random.Random(12)
    return [(int(r.random() < 0.3), round(r.random(), 2)) for _ in range(100)]


def test_binary_metrics(spark, sample):
    unknown = [(None, 0.99), (None, 0.01), (1, float("nan")), (0, float("inf"))]
    got = M.binary_metrics(frame(spark, sample + unknown), threshold=0.4).first()
    assert (got.n_known, got.n_positive) == (100, sum(y for y, _ in sample))
    assert got.auc == pytest.approx(auc(sample)) and got.auprc == pytest.approx(average_precision(sample))
    assert got.positive_f1 == pytest.approx(f1(sample, 0.4))
    assert got.macro_f1 == pytest.approx((f1(sample, 0.4) + f1(sample, 0.4, 0)) / 2)


def test_one_class_and_nothing_known(spark):
    got = M.binary_metrics(frame(spark, [(0, 0.1), (0, 0.9)])).first()
    assert got.auc is None and got.auprc is None and got.positive_f1 == 0.0
    none = M.binary_metrics(frame(spark, [(None, 0.1)])).first()
    assert none.n_known == 0 and none.macro_f1 is None


@pytest.mark.parametrize("objective", ["macro_f1", "positive_f1"])
def test_threshold_equals_brute_force(spark, sample, objective):
    known = sorted(p for _, p in sample)

    def quantile(q):
        h = (len(known) - 1) * q
        lo = math.floor(h)
        hi = min(lo + 1, len(known) - 1)
        return known[lo] + (known[hi] - known[lo]) * (h - lo)

    candidates = {0.05 + i * 0.01 for i in range(91)} | {quantile(i / 100) for i in range(101)} | {0.5}
    value = lambda t: f1(sample, t) if objective == "positive_f1" else (f1(sample, t) + f1(sample, t, 0)) / 2
    best = max((value(t), -abs(t - 0.5), t) for t in candidates)
    got = M.tune_threshold(frame(spark, sample + [(None, 0.5)]), objective).first()
    assert got.threshold == pytest.approx(best[2]) and got.value == pytest.approx(best[0])


def test_threshold_without_labels(spark):
    assert M.tune_threshold(frame(spark, [(None, 0.3)])).first().threshold == 0.5


def test_scope_and_ranking_days(spark):
    labels, probs = [[1, 0, None], [0, 0, None]], [[0.9, 0.2, 0.99], [0.1, 0.2, 0.99]]
    data = [(t, n, labels[t][n], probs[t][n]) for t in range(2) for n in range(3)]
    df = spark.createDataFrame(data, "snapshot int, node_id int, label int, prob double")
    scope = M.scope_metrics(df, 0.5).first()
    assert (scope.jaccard, scope.jaccard_n_positive_days, scope.jaccard_empty_union_days) == (1.0, 1, 1)
    ranking = M.ranking_metrics(df, 1).first()
    assert (ranking.n_days, ranking.n_positive_days, ranking.precision_at_k, ranking.ndcg_at_k) == (2, 1, 0.5, 0.5)


def test_hinge_equals_all_pairs(spark):
    r = random.Random(3)
    data = [("a", r.choice([0, 1, None]), round(r.uniform(-1, 1), 1)) for _ in range(60)]
    df = spark.createDataFrame(data, "g string, label int, score double")
    pairs = [max(0.0, 0.2 - p + n) for _, y, p in data if y == 1 for _, z, n in data if z == 0]
    assert M.pairwise_hinge(df, ["g"]).first().hinge == pytest.approx(sum(pairs) / len(pairs))


def test_alignment_equals_dense_form(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(7, 3))
    df = spark.createDataFrame(
        [(0, i, a[i].tolist(), b[i].tolist()) for i in range(7)] + [(1, 0, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])],
        "snapshot int, node_id int, short array<double>, long array<double>",
    )
    sim = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T / 0.1
    want = float(np.mean(np.log(np.exp(sim).sum(axis=1)) - np.diagonal(sim)))
    got = {r.snapshot: r.alignment_loss for r in M.alignment_loss(df, block=3).collect()}
    assert got[0] == pytest.approx(want) and got[1] == 0.0


def test_alignment_sends_a_vector_once_for_many_nodes(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(700, 2)), rng.normal(size=(700, 2))
    df = spark.createDataFrame([(0, i, a[i].tolist(), b[i].tolist()) for i in range(700)], "snapshot int, node_id int, short array<double>, long array<double>")
    sent = []
    stored = runtime.durable
    try:
        runtime.durable = lambda rows, label: sent.append((label, kept := stored(rows, label))) or kept
        got = M.alignment_loss(df).first().alignment_loss
    finally:
        runtime.durable = stored
    sim = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T / 0.1
    assert got == pytest.approx(float(np.mean(np.log(np.exp(sim).sum(axis=1)) - np.diagonal(sim))))
    assert [t.count() for label, t in sent if label == "blocks"] == [1]


def runs(spark, second_hash="h"):
    data = [("A", "full", 1, "h", 0.2, None), ("A", "full", 2, second_hash, 0.4, None), ("A", "text", 1, "h", 0.1, 3.0)]
    return spark.createDataFrame(data, "dataset string, mode string, seed int, dataset_sha256 string, auprc double, runtime double")


def test_run_statistics(spark):
    got = {(r.mode, r.metric): r for r in S.aggregate_runs(runs(spark), ["auprc", "runtime"]).collect()}
    assert got["full", "auprc"].mean == pytest.approx(0.3) and got["full", "auprc"].std == pytest.approx(math.sqrt(0.02))
    assert got["full", "runtime"].n == 0 and got["text", "auprc"].std is None
    paired = S.paired_differences(runs(spark), ["auprc"]).first()
    assert paired.n == 1 and paired.mean == pytest.approx(0.1)
    with pytest.raises(AuditError):
        S.aggregate_runs(runs(spark, "other"), ["auprc"])


def test_selected_epoch_and_stop(spark):
    scores = [0.1, 0.3, 0.301, 0.29, 0.5, 0.4]
    df = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, epoch int, score double")
    assert rows(S.select_epoch(df, ["run"], min_delta=0.01)) == [("r", 5, 0.5, None, 6)]
    assert rows(S.select_epoch(df, ["run"], min_delta=0.01, patience=2)) == [("r", 2, 0.3, 4, 6)]


def test_stored_metrics_against_recomputed_ones(spark):
    from riskgraph.operators.audit import metric_differences

    nan = float("nan")
    recomputed = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", None), ("a", "z", 0.5), ("b", "x", nan), (None, "x", 2.0), ("c", "x", float("inf"))], "run string, metric string, value double")
    stored = spark.createDataFrame(
        [("a", "x", 1.0 + 1e-13), ("a", "y", None), ("b", "x", nan), (None, "x", 2.1), ("d", "x", 0.0), ("c", "x", float("inf")), ("e", "x", None), ("e", "x", None)],
        "run string, metric string, value double")
    got = {(r.run, r.metric, r.problem) for r in metric_differences(recomputed, stored, ["run"]).collect()}
    assert got == {("a", "z", "missing"), ("b", "x", "differs"), (None, "x", "differs"), ("d", "x", "extra"), ("e", "x", "repeated")}


def test_signals_against_their_texts(spark):
    from riskgraph.operators.audit import signal_text_violations

    texts = spark.createDataFrame([(1, 7, 10), (2, None, 10)], "text_id int, node_id int, event_day int")
    cited = spark.createDataFrame(
        [(1, 1, 7, 10), (2, 1, 8, 10), (3, 1, 7, 11), (4, 2, None, 10), (5, 3, 7, 10), (6, None, 7, 10), (7, 1, None, 10)],
        "signal_id int, text_id int, node_id int, event_day int")
    got = {(r.signal_id, r.code.split("_")[-1]) for r in signal_text_violations(cited, texts).collect()}
    assert got == {(2, "consistency"), (3, "consistency"), (5, "link"), (6, "link"), (7, "consistency")}


def test_summary_over_seeds_needs_all_of_them(spark):
    from riskgraph.operators.metrics import stratified_summary

    df = spark.createDataFrame([("s", 1, 0.1), ("s", 2, 0.3), ("t", 1, 0.1), ("t", 2, None), ("u", 1, None)], "stratum string, seed int, difference double")
    got = {r.stratum: (r.available_seeds, r.valid_seeds, r.n_valid_pairs, r.mean_difference, r.status) for r in stratified_summary(df, ["stratum"], 2).collect()}
    assert got == {"s": ("1;2", "1;2", 2, 0.2, "complete"), "t": ("1;2", "1", 1, None, "partial"), "u": ("1", "", 0, None, "NA")}


def test_tables_derived_again(spark):
    from riskgraph.operators.audit import fingerprints, table_differences

    shape = "k string, m int, v double"
    derived = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, None), (None, 1, 3.0), ("c", None, 4.0), ("d", 1, 5.0), ("e", 1, 6.0)], shape)
    stored = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), ("b", 1, 0.5), (None, 1, 3.0), ("c", None, 4.0), ("e", 1, 6.0), ("e", 1, 6.0), (None, None, 0.0)], shape)
    for ranges in (1, 2, 4096):
        got = {(r.k, r.m, r.n_derived, r.n_stored, r.status) for r in table_differences(derived, stored, ["k", "m"], ["v"], ranges).collect()}
        assert got == {("b", 1, 1, 1, "different"), ("d", 1, 1, 0, "missing"), ("e", 1, 1, 2, "repeated"), (None, None, 0, 1, "extra")}
    assert table_differences(derived, derived.orderBy("v"), ["k", "m"], ["v"]).isEmpty()
    assert table_differences(derived.limit(0), stored.limit(0), ["k", "m"], ["v"]).isEmpty()
    assert table_differences(derived.limit(0), stored, ["k", "m"]).count() == 6
    assert fingerprints(derived, ["k", "m"], ["v"], 1).first().n == 7
