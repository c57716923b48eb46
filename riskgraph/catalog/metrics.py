"""Evaluation of node-time scores and documents, run statistics and training histories."""

from pyspark.sql import functions as F

from riskgraph.catalog.base import (
    calendar, cte, doc_scores, memory, node_labels, query, r6, scores, signals, table, using,
)
from riskgraph.catalog.temporal import month_split
from riskgraph.functions.numeric import age_stratum, confidence_stratum, degree_stratum, display_mean_sd
from riskgraph.operators import metrics as M
from riskgraph.operators import stats as S
from riskgraph.operators.audit import metric_differences
from riskgraph.operators.memory import newest_context
from riskgraph.operators.ordering import running_totals
from riskgraph.runtime import durable

# Rank-sum AUC with midranks, AP over distinct thresholds, F1 at 0.5; {g} is the group, {t} the rows.
_BINARY = """
  SELECT {g}, sum(n) AS n_known, sum(pos) AS n_positive,
    CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0
         THEN round(sum((n - pos) * (above_p + pos / 2.0)) / (sum(pos) * sum(n - pos)), 6) END AS auc,
    CASE WHEN sum(pos) > 0 THEN round(sum(pos * (above_p + pos) / (above_n + n)) / sum(pos), 6) END AS auprc,
    round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1,
    round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS positive_f1
  FROM (SELECT *, sum(CASE WHEN prob >= 0.5 THEN pos ELSE 0 END) OVER w AS tp,
               sum(CASE WHEN prob >= 0.5 THEN n - pos ELSE 0 END) OVER w AS fp,
               sum(CASE WHEN prob < 0.5 THEN pos ELSE 0 END) OVER w AS fn,
               sum(CASE WHEN prob < 0.5 THEN n - pos ELSE 0 END) OVER w AS tn
        FROM (SELECT *, coalesce(sum(pos) OVER a, 0) AS above_p, coalesce(sum(n) OVER a, 0) AS above_n
              FROM (SELECT {g}, prob, sum(label) AS pos, count(*) AS n FROM {t} WHERE label IS NOT NULL GROUP BY {g}, prob)
              WINDOW a AS (PARTITION BY {g} ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WINDOW w AS (PARTITION BY {g}))
  GROUP BY {g}, tp, fp, fn, tn"""


def binary_sql(group, rows):
    inner = _BINARY.format(g=group, t=rows)
    return f"SELECT {group}, CAST(n_known AS BIGINT) AS n_known, CAST(n_positive AS BIGINT) AS n_positive, auc, auprc, macro_f1, positive_f1 FROM ({inner})"


def rounded(df, *columns):
    return df.select(*[r6(c) if c in columns else F.col(c) for c in df.columns])


_BINARY_COLUMNS = ("auc", "auprc", "macro_f1", "positive_f1")


@query(using("scores", select=binary_sql("snapshot", "scores") + """
  UNION ALL SELECT snapshot, 0, 0, NULL, NULL, NULL, NULL FROM scores GROUP BY snapshot HAVING count(label) = 0"""))
def binary_metrics_by_snapshot(spark, d):
    return rounded(M.binary_metrics(scores(spark, d), ["snapshot"]), *_BINARY_COLUMNS)


@query(using("doc_scores", select=binary_sql("lang", "doc_scores")))
def binary_metrics_by_language(spark, d):
    return rounded(M.binary_metrics(doc_scores(spark, d), ["lang"]), *_BINARY_COLUMNS)


# Every English document is of an unknown group here: a null group is a group.
@query(using("doc_scores", select=binary_sql("lang", "(SELECT * REPLACE (nullif(lang, 'en') AS lang) FROM doc_scores)")))
def binary_metrics_with_null_group(spark, d):
    unnamed = doc_scores(spark, d).withColumn("lang", F.nullif("lang", F.lit("en")))
    return rounded(M.binary_metrics(unnamed, ["lang"]), *_BINARY_COLUMNS)


@query(using("scores", select=binary_sql("one", "(SELECT 1 AS one, * FROM scores)").replace("SELECT one, ", "SELECT ", 1)))
def binary_metrics_overall(spark, d):
    return rounded(M.binary_metrics(scores(spark, d)), *_BINARY_COLUMNS)


@query(using("scores", select="""
  SELECT prob, CAST(sum(n) OVER w AS BIGINT) AS n_at_least, CAST(sum(pos) OVER w AS BIGINT) AS positive_at_least FROM (
    SELECT prob, count(*) AS n, sum(label) AS pos FROM scores WHERE label IS NOT NULL GROUP BY prob)
  WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)"""))
def cumulative_score_counts(spark, d):
    counted = M.score_counts(scores(spark, d))
    totals = running_totals(counted, [F.col("prob").desc()], {"a": "n", "b": "pos"})
    return totals.select(
        "prob", (F.col("a") + F.col("n")).alias("n_at_least"), (F.col("b") + F.col("pos")).alias("positive_at_least")
    )


_SWEEP = """
  SELECT round(arg_max(t, (v, -abs(t - 0.5), t)), 6) AS threshold, round(max(v), 6) AS value FROM (
    SELECT t, {v} AS v FROM (
      SELECT t, count(*) FILTER (prob >= t AND label = 1) AS tp, count(*) FILTER (prob >= t AND label = 0) AS fp,
             count(*) FILTER (prob < t AND label = 1) AS fn, count(*) FILTER (prob < t AND label = 0) AS tn
      FROM known, (SELECT DISTINCT t FROM (
             SELECT 0.05::DOUBLE + i * 0.01::DOUBLE AS t FROM range(91) r(i) UNION ALL SELECT 0.5::DOUBLE
             UNION ALL SELECT unnest((SELECT quantile_cont(prob, list_transform(range(101), lambda i: i / 100.0)) FROM known))))
      GROUP BY t))"""
_F1P = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_F1N = "coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)"
cte("known", "SELECT label, prob FROM doc_scores WHERE label IS NOT NULL", "doc_scores")


@query(using("known", select=_SWEEP.format(v=f"({_F1P} + {_F1N}) / 2")))
def threshold_sweep_macro(spark, d):
    return rounded(M.tune_threshold(doc_scores(spark, d)), "threshold", "value")


@query(using("known", select=_SWEEP.format(v=_F1P)))
def threshold_sweep_positive(spark, d):
    return rounded(M.tune_threshold(doc_scores(spark, d), "positive_f1"), "threshold", "value")


cte("ranked_day", """
  SELECT snapshot, k, CAST(sum(label) AS BIGINT) AS n_positive,
         CAST(coalesce(sum(label) FILTER (pos < k), 0) AS BIGINT) AS hits, count(*) AS n,
         coalesce(sum(label / log2(pos + 2.0)) FILTER (pos < k), 0) AS dcg
  FROM (SELECT snapshot, label, row_number() OVER (PARTITION BY snapshot ORDER BY prob DESC, node_id) - 1 AS pos,
               CAST(least(nn, greatest(5, ceil(nn * 0.1))) AS BIGINT) AS k
        FROM scores, (SELECT count(DISTINCT node_id) AS nn FROM scores) WHERE label IS NOT NULL)
  GROUP BY snapshot, k""", "scores")
_RANKING = """
  SELECT snapshot, k, n_positive, hits, hits / least(k, n) AS precision_at_k,
         coalesce(hits / nullif(n_positive, 0), 0.0) AS recall_at_k,
         coalesce(dcg / nullif((SELECT sum(1.0 / log2(i + 2.0)) FROM range(least(k, n_positive)) r(i)), 0), 0.0) AS ndcg_at_k,
         coalesce(hits / nullif(least(k, n) + n_positive - hits, 0), 0.0) AS jaccard_at_k
  FROM ranked_day"""
_AT_K = ("precision_at_k", "recall_at_k", "ndcg_at_k", "jaccard_at_k")


@query(using("ranked_day", select=f"""
  SELECT snapshot, k, n_positive, hits, {", ".join(f"round({c}, 6) AS {c}" for c in _AT_K)} FROM ({_RANKING})"""))
def ranking_by_day(spark, d):
    return rounded(M.ranking_by_day(durable(scores(spark, d), "scores")), *_AT_K)


@query(using("ranked_day", select=f"""
  SELECT count(*) AS n_days, count(*) FILTER (n_positive > 0) AS n_positive_days,
         {", ".join(f"round(avg({c}), 6) AS {c}" for c in _AT_K)} FROM ({_RANKING})"""))
def ranking_summary(spark, d):
    return rounded(M.ranking_metrics(durable(scores(spark, d), "scores")), *_AT_K)


_SCOPE = """
  SELECT snapshot, count(*) FILTER (label = 1 OR prob >= 0.6) AS n_union, count(*) FILTER (label = 1 AND prob >= 0.6) AS n_both,
         count(*) FILTER (label = 1) AS n_positive,
         coalesce(count(*) FILTER (label = 1 AND prob >= 0.6) / nullif(count(*) FILTER (label = 1 OR prob >= 0.6), 0), 1.0) AS jaccard
  FROM scores WHERE label IS NOT NULL GROUP BY snapshot"""


@query(using("scores", select=f"SELECT * REPLACE (round(jaccard, 6) AS jaccard) FROM ({_SCOPE})"))
def scope_by_day(spark, d):
    return rounded(M.scope_by_day(scores(spark, d), 0.6), "jaccard")


@query(using("scores", select=f"""
  SELECT round(avg(jaccard), 6) AS jaccard, round(avg(jaccard) FILTER (n_positive > 0), 6) AS jaccard_positive_days,
         count(*) AS jaccard_n_days, count(*) FILTER (n_positive > 0) AS jaccard_n_positive_days,
         count(*) FILTER (n_union = 0) AS jaccard_empty_union_days FROM ({_SCOPE})"""))
def scope_summary(spark, d):
    return rounded(M.scope_metrics(scores(spark, d), 0.6), "jaccard", "jaccard_positive_days")


@query(using("doc_scores", select="""
  SELECT lang, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative,
         round(greatest(least(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 50.0), 0.02), 6) AS pos_weight
  FROM doc_scores GROUP BY lang"""))
def class_weights(spark, d):
    return rounded(M.class_weight(doc_scores(spark, d), ["lang"]), "pos_weight")


@query(using("doc_scores", select="""
  SELECT lang, count(*) AS n_known,
         round(avg(CASE WHEN label = 1 THEN 2.5 * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) ELSE greatest(x, 0) + ln(1 + exp(-abs(x))) END), 6) AS log_loss
  FROM (SELECT lang, label, ln(prob / (1 - prob)) AS x FROM doc_scores) WHERE label IS NOT NULL GROUP BY lang"""))
def weighted_log_loss(spark, d):
    logits = doc_scores(spark, d).withColumn("logit", F.ln(F.col("prob") / (1 - F.col("prob"))))
    return rounded(M.node_log_loss(logits, ["lang"], 2.5), "log_loss")


@query(using("doc_scores", select="""
  SELECT source, count(*) AS n_known,
         round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss
  FROM (SELECT source, label, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM doc_scores) WHERE label IS NOT NULL GROUP BY source"""))
def clamped_log_loss(spark, d):
    return rounded(M.probability_log_loss(doc_scores(spark, d), ["source"]), "log_loss")


@query(using("doc_scores", select="""
  SELECT lang, count(*) FILTER (p.label = 1) AS n_positive_pairs, round(avg(greatest(0.2 - p.prob + n.prob, 0)), 6) AS hinge
  FROM doc_scores p JOIN doc_scores n USING (lang) WHERE p.label = 1 AND n.label = 0 GROUP BY lang"""))
def pairwise_hinge_loss(spark, d):
    out = M.pairwise_hinge(doc_scores(spark, d), ["lang"], 0.2, score="prob")
    return out.filter(F.col("n_positive") * F.col("n_negative") > 0).select(
        "lang", (F.col("n_positive") * F.col("n_negative")).alias("n_positive_pairs"), r6("hinge")
    )


# Vectors of one label aligned with the vector of the next id, as two memories of the same node.
@query("""
  WITH pairs AS (
    SELECT a.label AS snapshot, a.vec_id AS node_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS s,
           list_transform(b.embedding, lambda x: x::DOUBLE) AS l
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  sims AS (
    SELECT a.snapshot, a.node_id AS i, b.node_id AS j, list_cosine_similarity(a.s, b.l) / 0.1 AS x
    FROM pairs a JOIN pairs b USING (snapshot)),
  per_node AS (
    SELECT snapshot, i, m + ln(sum(exp(x - m))) - max(x) FILTER (i = j) AS loss
    FROM (SELECT *, max(x) OVER (PARTITION BY snapshot, i) AS m FROM sims) GROUP BY snapshot, i, m)
  SELECT snapshot, count(*) AS n_nodes, round(avg(CASE WHEN n < 2 THEN 0 ELSE loss END), 6) AS alignment_loss
  FROM per_node JOIN (SELECT snapshot, count(*) AS n FROM pairs GROUP BY snapshot) USING (snapshot) GROUP BY snapshot""")
def alignment_by_label(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("long"))
    pairs = e.join(nxt, "vec_id").select(
        F.col("label").alias("snapshot"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("short"), "long"
    )
    return rounded(M.alignment_loss(pairs), "alignment_loss")


cte("event_months", """
  SELECT snapshot, query_day, target_day, CASE WHEN snapshot < 12 THEN 0 WHEN snapshot < 15 THEN -1 WHEN snapshot < 20 THEN 1 ELSE 2 END AS split FROM calendar""", "calendar")


def event_split(spark, d):
    s = F.col("snapshot")
    return calendar(spark, d).withColumn(
        "split", F.when(s < 12, 0).when(s < 15, -1).when(s < 20, 1).otherwise(2)
    )


@query(using("event_months", "scores", select="""
  SELECT split, count(DISTINCT snapshot) AS snapshots, count(*) FILTER (label = 1) AS positive,
         count(*) FILTER (label = 0) AS negative, count(*) FILTER (label IS NULL) AS unknown
  FROM event_months JOIN scores USING (snapshot) GROUP BY split"""))
def label_counts_by_split(spark, d):
    s = scores(spark, d)
    n = s.select("node_id").distinct().agg(F.count("*")).scalar()
    return M.label_counts(s.filter(F.col("label").isNotNull()), event_split(spark, d), n)


_AP = """(SELECT sum(pos * (above_p + pos) / (above_n + n)) / nullif(sum(pos), 0) FROM (
    SELECT pos, n, coalesce(sum(pos) OVER a, 0) AS above_p, coalesce(sum(n) OVER a, 0) AS above_n FROM (
      SELECT {p} AS p, sum(label) AS pos, count(*) AS n FROM doc_scores x
      WHERE label IS NOT NULL AND x.lang = g.lang AND x.toxic = g.toxic GROUP BY {p})
    WINDOW a AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


cte("ap_differences", f"""
  SELECT lang, toxic, n, n_positive, n - n_positive AS n_negative, CASE WHEN reason IS NULL THEN a END AS a, CASE WHEN reason IS NULL THEN b END AS b, reason
  FROM (SELECT *, CASE WHEN n < 30 THEN 'support_below_30' WHEN n_positive < 2 OR n - n_positive < 2
                       THEN 'fewer_than_two_positives_or_negatives' END AS reason,
               {_AP.format(p="prob")} AS a, {_AP.format(p="other_prob")} AS b
        FROM (SELECT lang, toxic, count(label) AS n, CAST(sum(label) AS BIGINT) AS n_positive FROM doc_scores
              WHERE label IS NOT NULL AND toxic IS NOT NULL GROUP BY lang, toxic) g)""", "doc_scores")


@query(using("ap_differences", select="""
  SELECT lang, toxic, n, n_positive, n_negative, round(a, 6) AS first_auprc, round(b, 6) AS second_auprc,
         round(a - b, 6) AS difference, reason AS na_reason FROM ap_differences"""))
def stratified_ap_difference(spark, d):
    rows = doc_scores(spark, d).filter(F.col("toxic").isNotNull() & F.col("label").isNotNull())
    out = M.stratified_difference(rows, ["lang", "toxic"], "prob", "other_prob", 30)
    return rounded(out, "first_auprc", "second_auprc", "difference")


# The toxic mark takes the place of the seed: a language needs both for its summary.
@query(using("ap_differences", select="""
  SELECT lang, string_agg(toxic, ';' ORDER BY toxic) AS available_seeds, coalesce(string_agg(toxic, ';' ORDER BY toxic) FILTER (a IS NOT NULL), '') AS valid_seeds,
         count(a) AS n_valid_pairs, round(CASE WHEN count(a) = 2 THEN avg(a - b) END, 6) AS mean_difference,
         round(CASE WHEN count(a) = 2 THEN stddev_samp(a - b) END, 6) AS sd_difference,
         CASE WHEN count(a) = 2 THEN 'complete' WHEN count(a) = 0 THEN 'NA' ELSE 'partial' END AS status
  FROM ap_differences GROUP BY lang"""))
def stratified_ap_summary(spark, d):
    rows = doc_scores(spark, d).filter(F.col("toxic").isNotNull() & F.col("label").isNotNull())
    out = M.stratified_difference(rows, ["lang", "toxic"], "prob", "other_prob", 30)
    return rounded(M.stratified_summary(out, ["lang"], 2, "toxic"), "mean_difference", "sd_difference")


@query(using("memory", select="""
  SELECT CASE WHEN age_days <= 7 THEN '1-7' WHEN age_days <= 14 THEN '8-14' WHEN age_days <= 30 THEN '15-30' ELSE '>30' END AS age_bin,
         CASE WHEN abs(confidence - 0.55) <= 0.05 THEN '0.55' WHEN abs(confidence - 0.8) <= 0.05 THEN '0.8'
              WHEN abs(confidence - 0.9) <= 0.05 THEN '0.9' ELSE 'other' END AS confidence_bin, slot, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, node_id ORDER BY age_days, slot) AS r FROM memory) WHERE r = 1
  GROUP BY ALL"""))
def newest_context_strata(spark, d):
    newest = newest_context(memory(spark, d))
    return newest.groupBy(
        age_stratum("age_days").alias("age_bin"), confidence_stratum("confidence", tol=0.05).alias("confidence_bin"), "slot"
    ).agg(F.count("*").alias("n"))


@query(using("nodes", "static_edges", select="""
  SELECT node_id, in_degree, CASE WHEN in_degree = 0 THEN '0' WHEN in_degree <= 2 THEN '1-2' WHEN in_degree <= 5 THEN '3-5' ELSE '>5' END AS degree_bin
  FROM (SELECT n.node_id, count(e.dst) AS in_degree FROM nodes n LEFT JOIN static_edges e ON e.dst = n.node_id GROUP BY n.node_id)"""))
def in_degree_strata(spark, d):
    from riskgraph.catalog.base import nodes, static_edges

    return M.in_degree(nodes(spark, d), static_edges(spark, d)).withColumn("degree_bin", degree_stratum("in_degree"))


# Runs: a language is a dataset, a source a seed; two methods report their mean score.
cte("runs", """
  SELECT lang AS dataset, mode, source AS seed, lang AS dataset_sha256, value, size FROM (
    SELECT lang, source, 'full' AS mode, avg(prob) AS value, count(*)::DOUBLE AS size FROM doc_scores GROUP BY lang, source
    UNION ALL SELECT lang, source, 'text', avg(other_prob), count(*)::DOUBLE FROM doc_scores GROUP BY lang, source)""", "doc_scores")


def runs(spark, d):
    by = doc_scores(spark, d).groupBy("lang", "source")
    full = by.agg(F.avg("prob").alias("value"), F.count("*").cast("double").alias("size")).withColumn("mode", F.lit("full"))
    text = by.agg(F.avg("other_prob").alias("value"), F.count("*").cast("double").alias("size")).withColumn("mode", F.lit("text"))
    return full.unionByName(text).select(
        F.col("lang").alias("dataset"), "mode", F.col("source").alias("seed"), F.col("lang").alias("dataset_sha256"), "value", "size"
    )


_STATS = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max"


@query(using("runs", select=f"""
  SELECT dataset, mode, metric, {_STATS} FROM (
    SELECT dataset, mode, 'value' AS metric, value AS v FROM runs UNION ALL SELECT dataset, mode, 'size', size FROM runs)
  GROUP BY dataset, mode, metric"""))
def seed_statistics(spark, d):
    return rounded(S.aggregate_runs(runs(spark, d), ["value", "size"]), "mean", "std", "min", "max")


@query(using("runs", select=f"""
  SELECT a.dataset, b.mode AS comparator, 'value' AS metric, {_STATS.replace("(v)", "(a.value - b.value)")}
  FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed AND a.mode = 'full' AND b.mode = 'text'
  GROUP BY a.dataset, b.mode"""))
def paired_mode_differences(spark, d):
    return rounded(S.paired_differences(runs(spark, d), ["value"]), "mean", "std", "min", "max")


@query(using("runs", select="""
  SELECT seed, min(dataset_sha256) AS lowest_hash, max(dataset_sha256) AS highest_hash FROM runs
  GROUP BY seed HAVING min(dataset_sha256) <> max(dataset_sha256)"""))
def mixed_provenance_groups(spark, d):
    return S.mixed_provenance(runs(spark, d), ["seed"])


@query(using("runs", select="""
  SELECT dataset, mode, CASE WHEN count(*) = 1 THEN printf('%.4f (n=1)', avg(value))
                             ELSE printf('%.4f ± %.4f', avg(value), stddev_samp(value)) END AS shown
  FROM runs GROUP BY dataset, mode"""))
def displayed_statistics(spark, d):
    stats = S.aggregate_runs(runs(spark, d), ["value"])
    return stats.select("dataset", "mode", display_mean_sd("mean", "std").alias("shown"))


@query(using("doc_scores", select="""
  SELECT a.node_id, a.lang, a.prob AS first_prob, b.other_prob AS second_prob
  FROM doc_scores a JOIN doc_scores b USING (node_id) WHERE a.label IS NOT NULL"""))
def paired_method_rows(spark, d):
    s = doc_scores(spark, d).filter(F.col("label").isNotNull())
    return S.paired_rows(
        s.select("node_id", "lang", "prob"), s.select("node_id", F.col("other_prob").alias("prob")), ["node_id"]
    )


# Training histories: a user's daily mean value is its epoch score.
cte("epochs", """
  SELECT node_id AS run, CAST(row_number() OVER (PARTITION BY node_id ORDER BY event_day) AS INTEGER) AS epoch, s AS score
  FROM (SELECT node_id, event_day, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS s FROM signals GROUP BY ALL)""", "signals")


def epochs(spark, d):
    from pyspark.sql import Window as W

    daily = signals(spark, d).groupBy("node_id", "event_day").agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0).alias("score")
    )
    return daily.select(
        F.col("node_id").alias("run"),
        F.row_number().over(W.partitionBy("node_id").orderBy("event_day")).alias("epoch"), "score",
    )


cte("walk", """
  SELECT * FROM (WITH RECURSIVE fold AS (
    SELECT run, epoch, score AS best, epoch AS at, 0 AS stale, CAST(NULL AS INTEGER) AS stop FROM epochs WHERE epoch = 1
    UNION ALL
    SELECT e.run, e.epoch,
      CASE WHEN f.stop IS NULL AND e.score > f.best + 5.0 THEN e.score ELSE f.best END,
      CASE WHEN f.stop IS NULL AND e.score > f.best + 5.0 THEN e.epoch ELSE f.at END,
      CASE WHEN f.stop IS NOT NULL THEN f.stale WHEN e.score > f.best + 5.0 THEN 0 ELSE f.stale + 1 END,
      CASE WHEN f.stop IS NULL AND e.score <= f.best + 5.0 AND f.stale + 1 >= 4 THEN e.epoch ELSE f.stop END
    FROM fold f JOIN epochs e ON e.run = f.run AND e.epoch = f.epoch + 1)
  SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1)""", "epochs")


@query(using("walk", select="""
  SELECT run, "at" AS best_epoch, best AS best_score, stop AS stop_epoch, epoch AS epochs_run FROM walk"""))
def selected_epochs(spark, d):
    return S.select_epoch(epochs(spark, d), ["run"], min_delta=5.0, patience=4)


@query(using("walk", "epochs", select="""
  SELECT e.run, e.epoch, e.score, e.epoch = w.at AS selected FROM epochs e JOIN walk w ON w.run = e.run"""))
def flattened_histories(spark, d):
    return S.flatten_history(epochs(spark, d), ["run"], min_delta=5.0, patience=4)


# Four candidates of each supplier: two hidden sizes with two learning rates.
@query("""
  SELECT grp, score, hidden, lr FROM (
    SELECT l_suppkey AS grp, l_linenumber % 2 AS hidden, l_orderkey % 2 AS lr, max(l_quantity) AS score FROM lineitem GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, hidden, lr) = 1""")
def validation_winner(spark, d):
    rows = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_linenumber", "l_orderkey").groupBy(
        F.col("l_suppkey").alias("grp"), (F.col("l_linenumber") % 2).alias("hidden"), (F.col("l_orderkey") % 2).alias("lr")
    ).agg(F.max("l_quantity").alias("score"))
    return S.choose_candidate(durable(rows, "candidates"), ["grp"], 4)


@query(using("signals", select="""
  SELECT node_id, seq, event_day FROM (
    SELECT node_id, signal_id AS seq, event_day, lag(event_day) OVER (PARTITION BY node_id ORDER BY signal_id) AS p FROM signals)
  WHERE event_day <= p"""))
def order_breaks(spark, d):
    rows = signals(spark, d).select("node_id", F.col("signal_id").alias("seq"), "event_day")
    return S.order_breaks(rows, ["node_id"], "event_day")


@query("""
  SELECT event_type, min(event_id) AS first_row, arg_min(props, event_id) AS first_value,
         max(event_id) AS last_row, arg_max(props, event_id) AS last_value FROM events GROUP BY event_type""")
def boundary_rows(spark, d):
    return S.boundary_rows(table(spark, d, "events", "event_type", "event_id", "props"), ["event_type"], "event_id", "props")


@query("""
  SELECT l_linestatus, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_ids, min(l_orderkey) AS lowest, max(l_orderkey) AS highest,
         min(l_orderkey) = 0 AND max(l_orderkey) = sum(c) - 1 AND count(*) = sum(c) AS continuous
  FROM (SELECT l_linestatus, l_orderkey, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_linestatus
  UNION ALL
  SELECT 'orders', count(*), count(DISTINCT o_orderkey), min(o_orderkey), max(o_orderkey),
         min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) FROM orders""")
def sequence_ids(spark, d):
    lines = S.sequence_gaps(table(spark, d, "lineitem", "l_linestatus", "l_orderkey"), "l_orderkey", ["l_linestatus"])
    orders = S.sequence_gaps(table(spark, d, "orders", "o_orderkey"), "o_orderkey")
    return lines.unionByName(orders.withColumn("l_linestatus", F.lit("orders")))


@query(using("month_split", select="""
  SELECT split, count(*) AS snapshots, min(query_day) AS first_day, max(target_day) AS last_target FROM month_split GROUP BY split"""))
def split_summary(spark, d):
    return month_split(spark, d).groupBy("split").agg(
        F.count("*").alias("snapshots"), F.min("query_day").alias("first_day"), F.max("target_day").alias("last_target")
    )


# A stored report of each language: counts by plain aggregates with a planted fault, one metric nobody recomputes, no ranking metric.
@query(using("doc_scores", select=f"""
  SELECT m.lang, p.metric, p.problem FROM ({binary_sql("lang", "doc_scores")}) m CROSS JOIN LATERAL (
    SELECT 'n_positive' AS metric, 'differs' AS problem WHERE n_known % 2 = 0
    UNION ALL SELECT 'auc', 'missing' WHERE auc IS NOT NULL
    UNION ALL SELECT 'n_rows', 'extra'
    UNION ALL SELECT 'n_known', 'repeated' WHERE n_positive % 3 = 0) p"""))
def recomputed_metric_differences(spark, d):
    scored = doc_scores(spark, d)
    metrics = M.binary_metrics(scored, ["lang"])
    recomputed = metrics.select("lang", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("n_known", "n_positive", "auc")])))
    counts = scored.groupBy("lang").agg(F.count("label").alias("n_known"), F.sum("label").alias("n_positive"), F.count("*").alias("n_rows"))
    known, positive = F.col("n_known"), F.col("n_positive")
    held = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    stored = counts.filter(known > 0).select("lang", F.inline(F.array_compact(F.array(
        held("n_known", known), F.when(positive % 3 == 0, held("n_known", known)),
        held("n_positive", positive + F.when(known % 2 == 0, 1).otherwise(0)), held("n_rows", F.col("n_rows"))))))
    return metric_differences(recomputed, stored, ["lang"]).select("lang", "metric", "problem")
