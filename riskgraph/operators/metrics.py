"""Unknown-aware classification, threshold, ranking and loss metrics.

A label is 1, 0 or NULL (unknown). Unknown labels and non-finite scores never count. Rows are first
reduced to one row per distinct score; everything that needs an order works on that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.functions.numeric import clamp, is_finite
from riskgraph.operators.joins import lookup_join, null_safe_join
from riskgraph.operators.ordering import ordered_position, running_totals


def known(scores: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    return scores.filter(F.col(label).isNotNull() & is_finite(prob))


def score_counts(scores: DataFrame, group: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Positives and rows per distinct score."""
    return known(scores, label, prob).groupBy(*group, (F.col(prob).cast("double") + 0.0).alias("prob")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(_ratio(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def binary_metrics(
    scores: DataFrame,
    group: Sequence[str] = (),
    threshold: float | Column = 0.5,
    label: str = "label",
    prob: str = "prob",
) -> DataFrame:
    """Counts, ROC AUC (ties share a rank), average precision and F1 at a threshold, per group.

    AUC is NULL with one class, average precision without positives, F1 without known labels; a group
    with only unknown labels still has its row.
    """
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    counted = score_counts(scores, group, label, prob)
    ranked = running_totals(counted, [F.col("prob").desc()], {"pos_above": "pos", "n_above": "n"}, group)
    pos, n = F.col("pos"), F.col("n")
    neg = n - pos
    hit = F.col("prob") >= cut
    sums = ranked.groupBy(*group).agg(
        F.sum(n).alias("n_known"),
        F.sum(pos).alias("n_positive"),
        F.sum(neg * (F.col("pos_above") + pos / 2.0)).alias("_u"),
        F.sum(pos * (F.col("pos_above") + pos) / (F.col("n_above") + n)).alias("_a"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("_fp"),
    )
    if group:
        sums = null_safe_join(scores.select(*group).distinct(), sums, list(group), "left")
    n_known = F.coalesce("n_known", F.lit(0))
    n_pos = F.coalesce("n_positive", F.lit(0))
    n_neg = n_known - n_pos
    tp, fp = F.col("_tp"), F.col("_fp")
    positive_f1 = _f1(tp, fp, n_pos - tp)
    negative_f1 = _f1(n_neg - fp, n_pos - tp, fp)
    any_known = n_known > 0
    return sums.select(
        *group,
        n_known.alias("n_known"),
        n_pos.alias("n_positive"),
        F.when((n_pos > 0) & (n_neg > 0), F.col("_u") / (n_pos * n_neg)).alias("auc"),
        F.when(n_pos > 0, F.col("_a") / n_pos).alias("auprc"),
        F.when(any_known, (positive_f1 + negative_f1) / 2).alias("macro_f1"),
        F.when(any_known, positive_f1).alias("positive_f1"),
    )


def threshold_candidates(counted: DataFrame, total: Column) -> DataFrame:
    """Distinct candidate thresholds: a fixed grid, 0.5 and 101 quantiles of the known scores.

    Quantiles interpolate linearly between exact order statistics, which are read from the running
    counts instead of a percentile aggregate holding all scores.
    """
    ranked = running_totals(counted, ["prob"], {"n_below": "n"}).withColumn("_t", total)
    steps = F.sequence(F.lit(0), F.lit(100))
    spots = F.transform(
        steps,
        lambda i: F.struct(
            i.alias("q"),
            F.floor((F.col("_t") - 1) * (i / 100.0)).alias("lo"),
            ((F.col("_t") - 1) * (i / 100.0)).alias("h"),
        ),
    )
    first, last = F.col("n_below"), F.col("n_below") + F.col("n")
    inside = lambda at: (at >= first) & (at < last)
    relevant = F.filter(spots, lambda s: inside(s["lo"]) | inside(F.least(s["lo"] + 1, F.col("_t") - 1)))
    picked = ranked.select("prob", "n_below", "n", "_t", F.explode(relevant).alias("s"))
    upper = F.least(F.col("s.lo") + 1, F.col("_t") - 1)
    low = F.max(F.when(inside(F.col("s.lo")), F.col("prob")))
    high = F.max(F.when(inside(upper), F.col("prob")))
    quantiles = picked.groupBy("s.q").agg(
        low.alias("a"), high.alias("b"), F.max(F.col("s.h") - F.col("s.lo")).alias("w")
    ).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("t"))
    spark = counted.sparkSession
    grid = spark.range(91).select((F.lit(0.05) + F.col("id") * F.lit(0.01)).alias("t"))
    return quantiles.unionByName(grid).unionByName(spark.range(1).select(F.lit(0.5).alias("t"))).distinct()


def tune_threshold(
    scores: DataFrame, objective: str = "macro_f1", label: str = "label", prob: str = "prob"
) -> DataFrame:
    """One row ``threshold, value``: the candidate with the best F1, ties to the nearest 0.5, then larger.

    Without known labels the threshold is 0.5 and the value NULL.
    """
    if objective not in ("macro_f1", "positive_f1"):
        raise ValueError("objective must be macro_f1 or positive_f1")
    from riskgraph.runtime import durable

    counted = durable(score_counts(scores, (), label, prob), "scores")
    totals = counted.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("p")))
    candidates = durable(threshold_candidates(counted, counted.agg(F.sum("n")).scalar()), "candidates")
    cuts = candidates.agg(F.array_sort(F.collect_list("t"))).scalar()
    reached = counted.withColumn("_c", cuts).select(
        F.size(F.filter("_c", lambda t: t <= F.col("prob"))).alias("reached"), "pos", "n"
    )
    hist = reached.groupBy("reached").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    at = (
        hist.agg(F.collect_list(F.struct("reached", "pos", "n")).alias("h"))
        .withColumn("c", cuts)
        .select("h", F.posexplode("c").alias("i", "t"))
    )
    above = lambda field: F.aggregate(
        F.filter("h", lambda b: b["reached"] > F.col("i")), F.lit(0).cast("bigint"), lambda acc, b: acc + b[field]
    )
    swept = at.select("t", above("pos").alias("tp"), above("n").alias("pred")).withColumn("_t", totals.scalar())
    fp = F.col("pred") - F.col("tp")
    fn = F.col("_t.p") - F.col("tp")
    tn = F.col("_t.n") - F.col("_t.p") - fp
    positive = _f1(F.col("tp"), fp, fn)
    value = positive if objective == "positive_f1" else (positive + _f1(tn, fn, fp)) / 2
    best = swept.filter(F.col("_t.n") > 0).withColumn("v", value).agg(
        F.max(F.struct(F.col("v"), (-F.abs(F.col("t") - 0.5)).alias("near"), F.col("t"))).alias("m")
    )
    return best.select(F.coalesce("m.t", F.lit(0.5)).alias("threshold"), F.col("m.v").alias("value"))


def ranking_by_day(
    scores: DataFrame,
    k: int | None = None,
    day: str = "snapshot",
    node: str = "node_id",
    label: str = "label",
    prob: str = "prob",
    n_nodes: int | Column | None = None,
) -> DataFrame:
    """Precision, recall, NDCG and Jaccard of the ``k`` best-scored known nodes of each day.

    ``k`` defaults to ``min(N, max(5, ceil(N / 10)))`` with ``N`` all nodes of the table. Days without
    known labels have no row.
    """
    if k is None:
        total = n_nodes if n_nodes is not None else scores.select(node).distinct().agg(F.count("*")).scalar()
        total = total if isinstance(total, Column) else F.lit(total)
        limit = F.least(total, F.greatest(F.lit(5), F.ceil(total * 0.1))).cast("bigint")
    else:
        limit = F.lit(int(k)).cast("bigint")
    rows = known(scores, label, prob).select(day, node, label, (-F.col(prob).cast("double")).alias("_s"))
    placed = ordered_position(rows, ["_s", node], [day], "_pos").withColumn("_k", limit)
    inside = F.col("_pos") < F.col("_k")
    gain = F.col(label) / F.log2(F.col("_pos") + 2.0)
    ideal = F.when(inside, 1.0 / F.log2(F.col("_pos") + 2.0))
    per_day = placed.groupBy(day).agg(
        F.max("_k").alias("_k"),
        F.count("*").alias("_n"),
        F.sum(F.col(label).cast("bigint")).alias("n_positive"),
        F.coalesce(F.sum(F.when(inside, F.col(label).cast("bigint"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias("_dcg"),
    )
    # The ideal gain is the sum over the first min(n_positive, k) positions of the same day.
    best = (
        lookup_join(placed.select(day, "_pos", "_k"), per_day.select(day, "n_positive"), [day])
        .filter(F.col("_pos") < F.least("_k", "n_positive"))
        .groupBy(day)
        .agg(F.sum(1.0 / F.log2(F.col("_pos") + 2.0)).alias("_ideal"))
    )
    kk = F.least("_k", "_n")
    zero = F.lit(0.0)
    return per_day.join(best, day, "left").select(
        day,
        F.col("_k").alias("k"),
        "n_positive",
        "hits",
        (F.col("hits") / kk).alias("precision_at_k"),
        F.coalesce(_ratio(F.col("hits"), F.col("n_positive")), zero).alias("recall_at_k"),
        F.coalesce(_ratio(F.col("_dcg"), F.col("_ideal")), zero).alias("ndcg_at_k"),
        F.coalesce(_ratio(F.col("hits"), kk + F.col("n_positive") - F.col("hits")), zero).alias("jaccard_at_k"),
    )


def ranking_metrics(scores: DataFrame, k: int | None = None, **options) -> DataFrame:
    """Averages of :func:`ranking_by_day` over the days with known labels; days without positives count as 0."""
    return ranking_by_day(scores, k, **options).agg(
        F.count("*").alias("n_days"),
        F.count_if(F.col("n_positive") > 0).alias("n_positive_days"),
        *[F.avg(c).alias(c) for c in ("precision_at_k", "recall_at_k", "ndcg_at_k", "jaccard_at_k")],
    )


def scope_by_day(
    scores: DataFrame, threshold: float | Column = 0.5, day: str = "snapshot",
    label: str = "label", prob: str = "prob",
) -> DataFrame:
    """Jaccard of the thresholded set and the known positives per day; two empty sets give 1."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = known(scores, label, prob).withColumn("_hit", F.col(prob) >= cut)
    truth = F.col(label) == 1
    counts = rows.groupBy(day).agg(
        F.count_if(truth | F.col("_hit")).alias("n_union"),
        F.count_if(truth & F.col("_hit")).alias("n_both"),
        F.count_if(truth).alias("n_positive"),
    )
    return counts.withColumn("jaccard", F.coalesce(_ratio(F.col("n_both"), F.col("n_union")), F.lit(1.0)))


def scope_metrics(scores: DataFrame, threshold: float | Column = 0.5, **options) -> DataFrame:
    return scope_by_day(scores, threshold, **options).agg(
        F.avg("jaccard").alias("jaccard"),
        F.avg(F.when(F.col("n_positive") > 0, F.col("jaccard"))).alias("jaccard_positive_days"),
        F.count("*").alias("jaccard_n_days"),
        F.count_if(F.col("n_positive") > 0).alias("jaccard_n_positive_days"),
        F.count_if(F.col("n_union") == 0).alias("jaccard_empty_union_days"),
    )


def class_weight(scores: DataFrame, group: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Negatives over positives, clipped to [0.02, 50]."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return scores.groupBy(*group).agg(pos.alias("positive"), neg.alias("negative")).withColumn(
        "pos_weight", clamp(F.col("negative") / F.greatest("positive", F.lit(1)), 0.02, 50.0)
    )


def node_log_loss(scores: DataFrame, group: Sequence[str] = (), pos_weight: float | Column = 1.0,
                  label: str = "label", logit: str = "logit") -> DataFrame:
    """Mean binary cross-entropy of logits over known labels, positives weighted."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    x = F.col(logit)
    loss = F.when(F.col(label) == 1, weight * soft(-x)).otherwise(soft(x))
    return scores.filter(F.col(label).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n_known"), F.avg(loss).alias("log_loss")
    )


def probability_log_loss(scores: DataFrame, group: Sequence[str] = (), label: str = "label", prob: str = "prob",
                         eps: float = 1e-7) -> DataFrame:
    """Mean binary cross-entropy of probabilities clamped to [eps, 1 - eps]."""
    p = clamp(prob, eps, 1.0 - eps)
    loss = F.when(F.col(label) == 1, -F.ln(p)).otherwise(-F.ln(1.0 - p))
    return scores.filter(F.col(label).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n_known"), F.avg(loss).alias("log_loss")
    )


def pairwise_hinge(scores: DataFrame, group: Sequence[str], margin: float = 0.2,
                   label: str = "label", score: str = "score") -> DataFrame:
    """Mean of ``max(0, margin - p + n)`` over all positive and negative pairs of each group.

    Pairs are never formed: with positives placed at ``p - margin`` on one axis with the negatives,
    each positive needs only the number and sum of the negatives above it, a running total.
    """
    kept = scores.filter(F.col(label).isNotNull())
    at = F.when(F.col(label) == 1, F.col(score) - F.lit(float(margin))).otherwise(F.col(score)) + 0.0
    axis = kept.groupBy(*group, at.alias("_x")).agg(
        F.count_if(F.col(label) == 1).alias("_p"),
        F.count_if(F.col(label) == 0).alias("_n"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, F.col(score))), F.lit(0.0)).alias("_s"),
    )
    swept = running_totals(axis, [F.col("_x").desc()], {"_n_above": "_n", "_s_above": "_s"}, group)
    sums = swept.groupBy(*group).agg(
        F.sum(F.col("_p") * (F.col("_s_above") - F.col("_n_above") * F.col("_x"))).alias("_h"),
        F.sum("_p").alias("n_positive"),
        F.sum("_n").alias("n_negative"),
    )
    pairs = F.col("n_positive") * F.col("n_negative")
    return sums.select(
        *group, "n_positive", "n_negative",
        F.coalesce(_ratio(F.col("_h"), pairs.cast("double")), F.lit(0.0)).alias("hinge"),
    )


def path_log_score(steps: DataFrame, path: Sequence[str], intensity: str = "intensity", floor: float = 1e-12) -> DataFrame:
    """Number of edges and sum of their log intensities of each path, intensities floored."""
    return steps.groupBy(*path).agg(F.count("*").alias("n_edges"), F.sum(F.ln(F.greatest(F.col(intensity), F.lit(floor)))).alias("log_score"))


def alignment_loss(
    pairs: DataFrame, day: str = "snapshot", node: str = "node_id", short: str = "short", long: str = "long",
    temperature: float = 0.1, block: int = 4096,
) -> DataFrame:
    """Cosine contrastive loss of each day: ``logsumexp_j(sim(i, j) / T) - sim(i, i) / T``, averaged over nodes.

    Every node is compared with all nodes of its day. Nodes are numbered into blocks of ``block``; one task multiplies one block's
    ``short`` vectors with another's ``long`` ones, 256 rows at a time, and returns the state (maximum, sum of exponentials
    scaled by it) of each node, so pairs exist only inside a matrix product. The states of a node, one for each block of its
    day, are merged in one aggregate. A vector is sent once for each ``block`` nodes of its day: the multiplications grow with
    the square of a day, what is moved only by ``nodes / block``. Days with fewer than two nodes have loss 0.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    from riskgraph.functions.numeric import l2_normalize
    from riskgraph.runtime import durable

    unit = pairs.select(day, node, l2_normalize(short).alias("_a"), l2_normalize(long).alias("_b"))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    placed = ordered_position(unit.withColumn("_own", dot / F.lit(float(temperature))), [node], [day], "_pos").withColumn(
        "_blk", F.floor(F.col("_pos") / block).cast("int")
    )
    rows = placed.groupBy(day, "_blk").agg(F.collect_list(F.struct(F.col(node).alias("n"), "_own", "_a", "_b")).alias("_rows"))
    stored = durable(
        rows.select(day, "_blk", *[F.col(f"_rows.{c}").alias(c) for c in ("n", "_own", "_a", "_b")]), "blocks"
    )
    last = stored.groupBy(day).agg(F.max("_blk").alias("_last"))
    left = stored.drop("_b").join(last, day).withColumn("_j", F.explode(F.sequence(F.lit(0), "_last"))).drop("_blk", "_last")
    right = stored.select(day, F.col("_blk").alias("_j"), "_b")

    def states(batches):
        import numpy as np
        import pyarrow as pa

        def matrix(vectors):
            return vectors.values.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors.values), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                nodes, own = batch.column("n")[i].values, batch.column("_own")[i].values
                a, b = matrix(batch.column("_a")[i]), matrix(batch.column("_b")[i])
                top, mass = np.empty(len(a)), np.empty(len(a))
                for at in range(0, len(a), 256):
                    strip = slice(at, at + 256)
                    sim = a[strip] @ b.T / temperature
                    top[strip] = sim.max(axis=1)
                    mass[strip] = np.exp(sim - top[strip, None]).sum(axis=1)
                days = batch.column(day).take(pa.array(np.full(len(nodes), i)))
                yield pa.RecordBatch.from_arrays(
                    [days, nodes, own, pa.array(top), pa.array(mass), pa.array(np.full(len(nodes), len(b), np.int64))],
                    names=[day, node, "own", "top", "mass", "width"],
                )

    types = {c: pairs.schema[c].dataType.simpleString() for c in (day, node)}
    parts = left.join(right, [day, "_j"]).select(day, "n", "_own", "_a", "_b").mapInArrow(
        states, f"`{day}` {types[day]}, `{node}` {types[node]}, own double, top double, mass double, width bigint"
    )
    merged = parts.groupBy(day, node).agg(
        F.max("top").alias("_top"), F.collect_list(F.struct("top", "mass")).alias("_states"), F.max("own").alias("_own"), F.sum("width").alias("_n")
    )
    scaled = F.aggregate("_states", F.lit(0.0), lambda acc, s: acc + s["mass"] * F.exp(s["top"] - F.col("_top")))
    per_node = merged.withColumn("_lse", F.col("_top") + F.ln(scaled))
    return per_node.groupBy(day).agg(
        F.count("*").alias("n_nodes"),
        F.avg(F.when(F.col("_n") < 2, 0.0).otherwise(F.col("_lse") - F.col("_own"))).alias("alignment_loss"),
    )


def label_counts(labels: DataFrame, snapshots: DataFrame, n_nodes: Column | int, label: str = "label") -> DataFrame:
    """Snapshots, positives, negatives and unknown cells per split; unknown cells have no label row."""
    total = n_nodes if isinstance(n_nodes, Column) else F.lit(n_nodes)
    frame = snapshots.groupBy("split").agg(F.count("*").alias("snapshots"))
    known_counts = (
        lookup_join(labels, snapshots.select("snapshot", "split"), ["snapshot"])
        .groupBy("split")
        .agg(F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))
    )
    pos, neg = F.coalesce("positive", F.lit(0)), F.coalesce("negative", F.lit(0))
    return frame.join(known_counts, "split", "left").select(
        "split", "snapshots", pos.alias("positive"), neg.alias("negative"),
        (F.col("snapshots") * total - pos - neg).alias("unknown"),
    )


def stratified_difference(
    rows: DataFrame, keys: Sequence[str], first: str, second: str, minimum: int = 30, label: str = "label",
) -> DataFrame:
    """Average precision of two methods on the same rows per stratum, with a reason where it is undefined."""
    a = binary_metrics(rows.select(*keys, label, F.col(first).alias("prob")), keys, label=label)
    b = binary_metrics(rows.select(*keys, label, F.col(second).alias("prob")), keys, label=label)
    both = a.select(*keys, F.col("n_known").alias("n"), "n_positive", F.col("auprc").alias("_a")).join(
        b.select(*keys, F.col("auprc").alias("_b")), list(keys)
    )
    negatives = F.col("n") - F.col("n_positive")
    reason = F.when(F.col("n") < minimum, F.lit(f"support_below_{minimum}")).when(
        (F.col("n_positive") < 2) | (negatives < 2), "fewer_than_two_positives_or_negatives"
    )
    ok = reason.isNull()
    return both.select(
        *keys, "n", "n_positive", negatives.alias("n_negative"),
        F.when(ok, F.col("_a")).alias("first_auprc"), F.when(ok, F.col("_b")).alias("second_auprc"),
        F.when(ok, F.col("_a") - F.col("_b")).alias("difference"), reason.alias("na_reason"),
    )


def stratified_summary(differences: DataFrame, keys: Sequence[str], n_seeds: int, seed: str = "seed") -> DataFrame:
    """Mean and sample deviation of the differences per stratum, only where every one of ``n_seeds`` seeds is valid.

    Lists the seeds that have a row and those whose difference is defined, in order; there are as many as runs. A single
    seed has no deviation.
    """
    valid = F.count("difference")
    complete = (valid == n_seeds) & (F.count_distinct(seed) == n_seeds)
    listed = lambda value: F.array_join(F.array_sort(F.collect_set(value)), ";")
    return differences.groupBy(*keys).agg(
        listed(F.col(seed).cast("string")).alias("available_seeds"),
        listed(F.when(F.col("difference").isNotNull(), F.col(seed)).cast("string")).alias("valid_seeds"),
        valid.alias("n_valid_pairs"),
        F.when(complete, F.avg("difference")).alias("mean_difference"),
        F.when(complete, F.stddev_samp("difference")).alias("sd_difference"),
        F.when(complete, "complete").when(valid == 0, "NA").otherwise("partial").alias("status"),
    )


def in_degree(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    counts = edges.groupBy(F.col("dst").alias(node)).agg(F.count("*").alias("in_degree"))
    return nodes.select(node).join(counts, node, "left").select(
        node, F.coalesce("in_degree", F.lit(0)).alias("in_degree")
    )
