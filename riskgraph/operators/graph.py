"""Frontier expansion, proof paths, beam search and exact path enumeration as bounded rounds of joins.

Each round is written to the shared folder before the next one starts, so a plan never holds more
than one round and a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.functions.numeric import is_finite, saturating_exp
from riskgraph.operators.joins import attach_group_stats, lookup_join
from riskgraph.operators.ordering import ordered_position, top_k_per_key
from riskgraph.runtime import durable


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _checked_intensity() -> Column:
    value = F.col("intensity").cast("double")
    return F.when(
        is_finite("intensity") & (value >= 0), value
    ).otherwise(F.raise_error(F.lit("edge intensity must be finite and not negative")).cast("double"))


def scored_adjacency(
    edges: DataFrame,
    node_prob: DataFrame | None = None,
    min_prob: float = 0.0,
    keys: Sequence[str] = ("snapshot",),
) -> DataFrame:
    """Usable edges ``(keys, tail, dst, edge_id, w)`` with ``w`` the log intensity.

    Zero intensity and targets below ``min_prob`` are dropped (``node_prob`` may be per key or fixed);
    a negative or non-finite intensity fails the job.
    """
    usable = edges.select(*keys, F.col("src").alias("tail"), "dst", "edge_id", _checked_intensity().alias("_x")).filter(
        F.col("_x") > 0
    )
    if node_prob is not None:
        shared = [k for k in keys if k in node_prob.columns]
        targets = node_prob.select(*shared, F.col("node_id").alias("dst"), F.col("prob").alias("_p"))
        usable = lookup_join(usable, targets, [*shared, "dst"]).filter(F.col("_p") >= min_prob)
    return usable.select(*keys, "tail", "dst", "edge_id", F.ln("_x").alias("w"))


def beam_search(
    edges: DataFrame,
    sources: DataFrame,
    beam_width: int = 10,
    max_hops: int = 4,
    top_k: int = 5,
    min_hops: int = 1,
    node_prob: DataFrame | None = None,
    min_prob: float = 0.0,
    keys: Sequence[str] = ("snapshot",),
    written: bool = False,
) -> DataFrame:
    """Best cycle-free paths from each source by the product of edge intensities.

    ``edges(keys, edge_id, src, dst, intensity)``, ``sources(keys, node_id)``. Every depth keeps the
    ``beam_width`` best partial paths of a source; depths from ``min_hops`` compete for ``top_k``.
    Order is (score descending, node sequence, edge ids); parallel edges stay apart.

    Edges are checked and written once and never sorted as a whole; edges that are ``written`` already are checked in a pass over
    their intensity and read again by every hop instead of being written a second time. A hop first keeps the edges that leave the tails of its
    beam, a semi-join that turns into a map-side filter while the beam is small. A path of ``d`` nodes can use at most
    ``beam_width`` of its tail's edges and rules out at most ``d`` targets with ``beam_width`` useful parallel edges each, so
    ``beam_width * (1 + d)`` edges per tail decide the hop; the rest goes map-side, and a hub meets its paths with so many.
    """
    if min(beam_width, max_hops, top_k, min_hops) < 1 or min_hops > max_hops:
        raise ValueError("invalid beam width, hop count or top_k")
    usable = scored_adjacency(edges, node_prob, min_prob, keys)
    if written:
        edges.agg(F.max(_checked_intensity())).collect()
    else:
        usable = durable(usable, "usable")

    def leaving(beam: DataFrame, depth: int) -> DataFrame:
        near = lookup_join(usable, beam.select(*keys, "tail").distinct(), [*keys, "tail"], "left_semi")
        parallel = top_k_per_key(near, [*keys, "tail", "dst"], [F.col("w").desc(), F.col("edge_id")], beam_width, "_r").drop("_r")
        order = [F.col("w").desc(), F.col("dst"), F.col("edge_id")]
        return top_k_per_key(parallel, [*keys, "tail"], order, beam_width * (1 + depth), "_r").drop("_r")

    edge_type = edges.schema["edge_id"].dataType.simpleString()
    beam = sources.select(
        *keys,
        F.col("node_id").alias("source"),
        F.col("node_id").alias("tail"),
        F.array("node_id").alias("nodes"),
        F.array().cast(f"array<{edge_type}>").alias("edge_ids"),
        F.lit(0.0).alias("log_score"),
    ).distinct()
    best = [F.col("log_score").desc(), F.col("nodes"), F.col("edge_ids")]
    levels = []
    for depth in range(1, max_hops + 1):
        grown = (
            lookup_join(beam, leaving(beam, depth), [*keys, "tail"])
            .filter(~F.array_contains("nodes", F.col("dst")))
            .select(
                *keys, "source", F.col("dst").alias("tail"),
                F.array_append("nodes", F.col("dst")).alias("nodes"),
                F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"),
                (F.col("log_score") + F.col("w")).alias("log_score"),
            )
        )
        beam = durable(top_k_per_key(grown, [*keys, "source"], best, beam_width, "_r").drop("_r"), "beam")
        if depth >= min_hops:
            levels.append(beam)
        if beam.isEmpty():
            break
    if not levels:
        levels = [beam]
    ranked = top_k_per_key(_union(levels).drop("tail"), [*keys, "source"], best, top_k)
    return ranked.withColumn("score", saturating_exp("log_score"))


def _true_steps(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct steps ``(keys, src, dst)`` between different nodes, written once."""
    return durable(edges.select(*keys, "src", "dst").filter(F.col("src") != F.col("dst")).distinct(), "steps")


def _walk_paths(steps: DataFrame, sources: DataFrame, max_hops: int, keys: Sequence[str]) -> DataFrame:
    arcs = steps.withColumnRenamed("src", "tail")
    level = sources.select(
        *keys, F.col("node_id").alias("source"), F.col("node_id").alias("tail"), F.array("node_id").alias("nodes")
    ).distinct()
    levels = []
    for _ in range(max_hops):
        level = durable(
            lookup_join(level, arcs, [*keys, "tail"])
            .filter(~F.array_contains("nodes", F.col("dst")))
            .select(*keys, "source", F.col("dst").alias("tail"), F.array_append("nodes", F.col("dst")).alias("nodes")),
            "paths",
        )
        levels.append(level)
        if level.isEmpty():
            break
    return _union(levels).drop("tail")


def simple_paths(
    edges: DataFrame, sources: DataFrame, max_hops: int = 4, keys: Sequence[str] = ("snapshot",),
) -> DataFrame:
    """All cycle-free node sequences (every prefix included) from the sources over ``edges(keys, src, dst)``.

    The listing is as long as there are paths; :func:`path_counts` and :func:`edges_on_paths` do without it.
    """
    return _walk_paths(_true_steps(edges, keys), sources, max_hops, keys)


def _node_subsets(nodes: Column, largest: int) -> Column:
    """All subsets of an array of up to about ten different nodes with at most ``largest`` members, each in order."""
    ordered = F.array_sort(nodes)
    masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(nodes)).cast("int") - 1)
    subsets = F.transform(masks, lambda m: F.filter(ordered, lambda _, i: F.getbit(m, i) == 1))
    return F.filter(subsets, lambda x: F.size(x) <= largest)


def path_counts(
    edges: DataFrame, sources: DataFrame, max_hops: int = 4, cap: int = 10_000, keys: Sequence[str] = ("snapshot",),
) -> DataFrame:
    """Number ``n_paths`` of the paths :func:`simple_paths` would list, per key with at least one, without listing them.

    Paths of more than half of ``max_hops`` are pairs of halves that meet in a node and share no other. Disjoint pairs follow
    by inclusion and exclusion: first halves are counted by (meeting node, subset of their earlier nodes), second halves by
    (start, subset of their later nodes), and the counts of equal subsets are multiplied with the sign of the subset's size.
    Only halves are enumerated, so the work grows with the degree to the power of half of the hops. ``over_cap`` tells where
    a listing limited to ``cap`` would have been cut. Repeated edges and sources count once; loops and null ends never.
    """
    return _count_paths(_true_steps(edges, keys), sources, max_hops, list(keys)).withColumn("over_cap", F.col("n_paths") > cap)


def _count_paths(steps: DataFrame, sources: DataFrame, max_hops: int, keys: list[str]) -> DataFrame:
    near = (max_hops + 1) // 2
    far = max_hops - near
    first = _walk_paths(steps, sources, near, keys)
    counted = first.groupBy(*keys).agg(F.count("*").alias("n"))
    if far:
        halves = (
            first.filter(F.size("nodes") == near + 1)
            .select(*keys, F.element_at("nodes", -1).alias("meet"), F.explode(_node_subsets(F.slice("nodes", 1, near), far)).alias("shared"))
            .groupBy(*keys, "meet", "shared").agg(F.count("*").alias("before"))
        )
        halves = durable(halves, "halves")
        meetings = halves.select(*keys, F.col("meet").alias("node_id")).distinct()
        rest = (
            _walk_paths(steps, meetings, far, keys)
            .select(*keys, F.col("source").alias("meet"), F.explode(_node_subsets(F.slice("nodes", 2, far), far)).alias("shared"))
            .groupBy(*keys, "meet", "shared").agg(F.count("*").alias("after"))
        )
        sign = F.when(F.size("shared") % 2 == 0, 1).otherwise(-1)
        pairs = halves.join(rest, [*keys, "meet", "shared"]).groupBy(*keys).agg(F.sum(sign * F.col("before") * F.col("after")).alias("n"))
        counted = counted.unionByName(pairs)
    return counted.groupBy(*keys).agg(F.sum("n").alias("n_paths"))


def edges_on_paths(
    edges: DataFrame, sources: DataFrame, max_hops: int = 4, keys: Sequence[str] = ("snapshot",),
) -> DataFrame:
    """Edges ``(keys, src, dst)`` that lie on at least one cycle-free path of up to ``max_hops`` from a source.

    Such a path through ``src -> dst`` exists exactly when some walk of less than ``max_hops`` steps reaches ``src`` without
    meeting ``dst``. Every round keeps one row a node: the at most ``max_hops`` nodes that all walks to it have in common,
    the node itself included, which is the intersection over its predecessors. No path is listed.
    """
    return _edges_on_paths(_true_steps(edges, keys), sources, max_hops, list(keys))


def _edges_on_paths(steps: DataFrame, sources: DataFrame, max_hops: int, keys: list[str]) -> DataFrame:
    starts = sources.select(*keys, F.col("node_id").alias("src")).distinct()
    common = starts.withColumn("must", F.array("src"))
    for _ in range(max_hops - 1):
        walked = lookup_join(common, steps, [*keys, "src"]).select(*keys, F.col("dst").alias("src"), "must")
        votes = durable(
            walked.join(starts, [*keys, "src"], "left_anti")
            .select(*keys, "src", F.explode(F.concat(F.array(F.lit(None)), "must")).alias("met"))
            .groupBy(*keys, "src", "met").agg(F.count("*").alias("n")),
            "votes",
        )
        ways = votes.filter(F.col("met").isNull()).select(*keys, "src", F.col("n").alias("ways"))
        agreed = (
            votes.filter(F.col("met").isNotNull()).join(ways, [*keys, "src"]).filter(F.col("n") == F.col("ways"))
            .groupBy(*keys, "src").agg(F.collect_list("met").alias("agreed"))
        )
        shared = F.array_compact(F.array_union(F.array("src"), F.coalesce("agreed", F.array("src"))))
        # Written, as the planner would take the nodes reached for many and move all steps to them.
        common = durable(ways.join(agreed, [*keys, "src"], "left").select(*keys, "src", shared.alias("must")).unionByName(
            starts.withColumn("must", F.array("src"))
        ), "common")
    return lookup_join(steps, common, [*keys, "src"]).filter(~F.array_contains("must", F.col("dst"))).select(*keys, "src", "dst")


def _path_steps(paths: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("nodes") - 1),
        lambda i: F.struct(F.get("nodes", i - 1).alias("src"), F.get("nodes", i).alias("dst")),
    )
    return paths.select(*columns, F.inline(pairs))


def confirmed_paths(predicted: DataFrame, edges: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """Predicted paths ``(keys, source, nodes)`` with ``true`` 1 if each of their steps is one of ``edges(keys, src, dst)``."""
    on, step = [*keys, "source", "nodes"], [*keys, "src", "dst"]
    taken = durable(_path_steps(predicted.select(*on).distinct(), on), "taken")
    steps = lookup_join(edges.select(*step), taken.select(*step).distinct(), step, "left_semi").distinct().withColumn("_known", F.lit(1))
    return (
        lookup_join(taken, steps, step, "left")
        .groupBy(*on).agg(F.min(F.coalesce("_known", F.lit(0))).alias("true"))
    )


def path_metrics_by_day(
    confirmed: DataFrame, edges: DataFrame, sources: DataFrame, days: DataFrame, max_hops: int = 4, keys: Sequence[str] = ("snapshot",),
) -> DataFrame:
    """Path and edge precision / recall of :func:`confirmed_paths` against the true ``edges``, per day of ``days``.

    True paths are counted, true edges found by common nodes; neither lists a path.
    """
    keys, true_steps = list(keys), _true_steps(edges, keys)
    paths = confirmed.groupBy(*keys).agg(F.count("*").alias("n_pred"), F.sum("true").alias("n_match"))
    truth = _count_paths(true_steps, sources, max_hops, keys).withColumnRenamed("n_paths", "n_true")
    on_truth = _edges_on_paths(true_steps, sources, max_hops, keys).select(*keys, "src", "dst", F.lit(0).alias("p"), F.lit(1).alias("t"))
    on_paths = _path_steps(confirmed, keys).withColumns({"p": F.lit(1), "t": F.lit(0)})
    steps = (
        on_truth.unionByName(on_paths).groupBy(*keys, "src", "dst").agg(F.max("p").alias("p"), F.max("t").alias("t"))
        .groupBy(*keys).agg(F.sum("p").alias("e_pred"), F.sum("t").alias("e_true"), F.sum(F.col("p") * F.col("t")).alias("e_match"))
    )
    zero = F.lit(0.0)
    share = lambda top, bottom: F.coalesce(F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)), zero)
    per_day = days.select(*keys).distinct()
    for found in (paths, truth, steps):
        per_day = per_day.join(found, keys, "left")
    per_day = per_day.fillna(0, ["n_pred", "n_true", "n_match", "e_pred", "e_true", "e_match"])
    scored = per_day.select(
        *keys, "n_pred", "n_true", "n_match",
        share("n_match", "n_pred").alias("path_precision"), share("n_match", "n_true").alias("path_recall"),
        share("e_match", "e_pred").alias("path_edge_precision"), share("e_match", "e_true").alias("path_edge_recall"),
    )
    both = F.col("path_precision") + F.col("path_recall")
    return scored.withColumn(
        "path_f1", F.when(both > 0, 2 * F.col("path_precision") * F.col("path_recall") / both).otherwise(0.0)
    )


def source_hits(confirmed: DataFrame, edges: DataFrame, sources: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """Per source with at least one true path, which is one true edge to another node: whether a predicted path is true."""
    on = [*keys, "source"]
    leaving = edges.filter(F.col("src") != F.col("dst")).select(*keys, F.col("src").alias("source"))
    starts = sources.select(*keys, F.col("node_id").alias("source")).distinct()
    evaluable = lookup_join(leaving, starts, on, "left_semi").distinct()
    matched = confirmed.groupBy(*on).agg(F.max("true").alias("_h"))
    return evaluable.join(matched, on, "left").select(*on, F.coalesce("_h", F.lit(0)).alias("hit"))


def path_metrics(
    edges: DataFrame, labels: DataFrame | None, sources: DataFrame, beam_width: int = 10, max_hops: int = 4, top_k: int = 5,
    written: bool = False,
) -> DataFrame:
    """Averaged path metrics on the labelled subgraph: unknown edges count neither as truth nor as error.

    ``edges(snapshot, edge_id, src, dst, intensity)``, ``labels(snapshot, edge_id, label)``,
    ``sources(snapshot, node_id)``. Without ``labels`` the edges hold ``label`` themselves; if such edges are ``written``
    already, they are read where they lie and not written again.
    """
    outcome = edges if labels is None else edges.join(labels, ["snapshot", "edge_id"])
    labelled = outcome.filter(F.col("label").isNotNull())
    written = written and labels is None
    if not written:
        labelled = durable(labelled, "labelled")
    starts = durable(sources.join(labelled.select("snapshot").distinct(), "snapshot", "left_semi"), "starts")
    days = starts.select("snapshot").distinct()
    true_edges = labelled.filter(F.col("label") == 1)
    predicted = beam_search(labelled, starts, beam_width, max_hops, top_k, written=written)
    confirmed = durable(confirmed_paths(predicted, true_edges), "confirmed")
    by_day = path_metrics_by_day(confirmed, true_edges, starts, days, max_hops).agg(
        F.count("*").alias("n_days"),
        *[F.avg(c).alias(c) for c in ("path_precision", "path_recall", "path_f1", "path_edge_precision", "path_edge_recall")],
    )
    hits = source_hits(confirmed, true_edges, starts).agg(
        F.struct(F.sum("hit").alias("hits"), F.count("*").alias("n")).alias("h")
    )
    h = hits.scalar()
    return by_day.withColumn("_h", h).select(
        "*",
        F.coalesce("_h.hits", F.lit(0)).alias("path_at_k_hits"),
        F.col("_h.n").alias("path_at_k_evaluable_sources"),
        F.when(F.col("_h.n") > 0, F.col("_h.hits") / F.col("_h.n")).alias("path_at_k"),
    ).drop("_h")


def reachability(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """Nodes reachable from each ``source`` with their hop distance (0 for the source itself)."""
    steps = durable(edges.select(F.col("src").alias("node_id"), "dst").distinct(), "steps")
    seen = durable(
        sources.select("source").distinct().select("source", F.col("source").alias("node_id"), F.lit(0).alias("hop")),
        "reach",
    )
    frontier = seen
    for hop in range(1, max_hops + 1):
        grown = (
            lookup_join(frontier.select("source", "node_id"), steps, ["node_id"])
            .select("source", F.col("dst").alias("node_id"))
            .distinct()
            .join(seen, ["source", "node_id"], "left_anti")
        )
        frontier = durable(grown.withColumn("hop", F.lit(hop)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def level_positions(reached: DataFrame) -> DataFrame:
    """Vertical position of each node inside its hop level, centred on 0, first node on top."""
    placed = ordered_position(reached, ["node_id"], ["source", "hop"], "_pos")
    sized = attach_group_stats(placed, ["source", "hop"], {"_n": F.count("*")})
    return sized.withColumn("position", (F.col("_n") - 1) / 2 - F.col("_pos")).drop("_pos", "_n")


def expand_taxonomy(
    seeds: DataFrame, subclass: DataFrame, roots: DataFrame, entities: DataFrame, depth_limit: int,
) -> DataFrame:
    """Classes met by following ``subclass(child, parent)`` from the seeds and roots, with the first depth.

    Roots are not expanded further. ``status`` is ``expanded``, ``root``, ``missing`` (no record) or
    ``beyond_limit``.
    """
    stop = roots.select("qid").distinct()
    arcs = durable(
        subclass.select(F.col("child").alias("qid"), "parent").distinct().join(stop, "qid", "left_anti"),
        "arcs",
    )
    frontier = durable(seeds.select("qid").unionByName(stop).distinct().withColumn("depth", F.lit(0)), "class")
    seen = frontier
    for depth in range(1, depth_limit + 2):
        grown = (
            lookup_join(frontier, arcs, ["qid"]).select(F.col("parent").alias("qid")).distinct()
            .join(seen, "qid", "left_anti")
        )
        frontier = durable(grown.withColumn("depth", F.lit(depth)), "class")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    known = entities.select("qid").distinct().withColumn("_k", F.lit(True))
    flagged = seen.join(known, "qid", "left").join(stop.withColumn("_r", F.lit(True)), "qid", "left")
    status = (
        F.when(F.col("depth") > depth_limit, "beyond_limit")
        .when(F.col("_k").isNull(), "missing")
        .when(F.col("_r"), "root")
        .otherwise("expanded")
    )
    return flagged.select("qid", "depth", status.alias("status"))


def class_proofs(subclass: DataFrame, roots: DataFrame, max_depth: int = 12) -> DataFrame:
    """``(qid, kind, proof)``: the shortest subclass chain of every class to a root of each kind it reaches.

    ``subclass(child, parent, statement_id, seq)`` with ``seq`` the order of statements of a child;
    ``roots(kind, qid)``. A root has an empty proof of its own kind. Of equally short chains the first in statement
    order is taken. The walk goes from the roots down: the rest of a best chain is the best chain of the parent,
    so one chain for each (class, kind) is all that is kept, and every class is extended once.
    """
    arcs = durable(
        subclass.select("child", F.col("parent").alias("qid"), "statement_id", F.col("seq").cast("int").alias("seq")), "arcs"
    )
    step_type = "array<struct<subject_qid:string,property_id:string,object_qid:string,statement_id:string>>"
    frontier = durable(
        roots.select("qid", "kind").distinct().select(
            "qid", "kind", F.array().cast(step_type).alias("proof"), F.array().cast("array<int>").alias("ord")
        ),
        "proof",
    )
    seen = frontier
    for _ in range(max_depth):
        step = F.struct(
            F.col("child").alias("subject_qid"), F.lit("P279").alias("property_id"), F.col("qid").alias("object_qid"), "statement_id"
        )
        chain = F.struct(F.concat(F.array("seq"), "ord").alias("ord"), F.concat(F.array(step), "proof").alias("proof"))
        grown = lookup_join(arcs, frontier, ["qid"]).groupBy(F.col("child").alias("qid"), "kind").agg(F.min(chain).alias("_p"))
        fresh = grown.join(seen.select("qid", "kind"), ["qid", "kind"], "left_anti")
        frontier = durable(fresh.select("qid", "kind", "_p.proof", "_p.ord"), "proof")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.drop("ord")


def proof_paths(starts: DataFrame, subclass: DataFrame, roots: DataFrame, max_depth: int = 12) -> DataFrame:
    """``(start, kind, proof)`` of the classes in ``starts(qid)`` by :func:`class_proofs`."""
    wanted = starts.select(F.col("qid").alias("start")).distinct()
    return wanted.join(class_proofs(subclass, roots, max_depth).withColumnRenamed("qid", "start"), "start")


# Kinds that a class itself may have.
CLASS_KINDS = ("product", "material", "industry", "fictional")


def type_evidence(
    instance_of: DataFrame, subclass: DataFrame, roots: DataFrame, max_depth: int = 12, class_kinds: Sequence[str] = CLASS_KINDS,
    proofs: DataFrame | None = None,
) -> DataFrame:
    """``(qid, kind, proof)``: every chain of saved statements that gives an entity a kind.

    One row for each instance statement ``instance_of(qid, class_qid, statement_id)`` whose class reaches the kind, beginning
    with that statement, and one for a class that reaches a kind of ``class_kinds`` through its own subclass chain.
    """
    found = class_proofs(subclass, roots, max_depth) if proofs is None else proofs
    first = F.struct(
        F.col("_entity").alias("subject_qid"), F.lit("P31").alias("property_id"), F.col("qid").alias("object_qid"), F.col("_statement").alias("statement_id")
    )
    given = instance_of.select(F.col("qid").alias("_entity"), F.col("class_qid").alias("qid"), F.col("statement_id").alias("_statement"))
    by_instance = lookup_join(given, found, ["qid"]).select(
        F.col("_entity").alias("qid"), "kind", F.concat(F.array(first), "proof").alias("proof")
    )
    by_class = found.filter(F.col("kind").isin(*class_kinds)).join(
        subclass.select(F.col("child").alias("qid")).distinct(), "qid", "left_semi"
    )
    return by_instance.unionByName(by_class.select("qid", "kind", "proof"))


def proof_steps(evidence: DataFrame) -> DataFrame:
    """Every step of every proof with the entity, the kind, the proof's own first statement and the step number."""
    return evidence.select(
        F.col("qid").alias("classified_qid"), F.col("kind").alias("supported_type"),
        F.get("proof", F.lit(0))["statement_id"].alias("first_statement_id"), F.posexplode("proof").alias("step", "_s"),
    ).select("classified_qid", "supported_type", "first_statement_id", "step", "_s.*")


def classify_entities(
    entities: DataFrame, instance_of: DataFrame, subclass: DataFrame, roots: DataFrame, max_depth: int = 12,
    class_kinds: Sequence[str] = CLASS_KINDS,
) -> DataFrame:
    """Type of each entity from saved instance / subclass statements only.

    One supported kind gives the type, several are ambiguous, a fictional class excludes the entity.
    Classes themselves may be products, materials or industries through their own subclass chain.
    """
    proofs = class_proofs(subclass, roots, max_depth).select("qid", "kind")
    by_instance = lookup_join(
        instance_of.select(F.col("qid").alias("_entity"), F.col("class_qid").alias("qid")), proofs, ["qid"]
    ).select(F.col("_entity").alias("qid"), "kind")
    classes = subclass.select(F.col("child").alias("qid")).distinct()
    by_class = proofs.filter(F.col("kind").isin(*class_kinds)).join(classes, "qid", "left_semi")
    kinds = by_instance.unionByName(by_class).groupBy("qid").agg(F.array_sort(F.collect_set("kind")).alias("_k"))
    merged = entities.select("qid").distinct().join(kinds, "qid", "left").join(
        classes.withColumn("_c", F.lit(True)), "qid", "left"
    )
    found = F.coalesce("_k", F.array().cast("array<string>"))
    usable = F.array_remove(found, "fictional")
    fictional = F.array_contains(found, "fictional")
    # Type, form and reason names.
    return merged.select(
        "qid",
        F.when(~fictional & (F.size(usable) == 1), F.get(usable, F.lit(0))).otherwise("unclassified").alias("entity_type"),
        usable.alias("type_candidates"),
        F.when(fictional, "fictional_or_hypothetical_class_evidence")
        .when(F.size(usable) == 1, "official_instance_or_subclass_evidence")
        .when(F.size(usable) > 1, "ambiguous_overlapping_type_evidence")
        .otherwise("no_supported_five_type_path_within_taxonomy_budget").alias("type_reason"),
        F.when(F.col("_c"), "class_or_category").otherwise("instance_or_unspecified").alias("entity_form"),
        fictional.alias("fictional_or_hypothetical"),
    )


def spread_one_hop(statements: DataFrame, domains: DataFrame, roles: DataFrame) -> DataFrame:
    """Domains and roles of each entity after one simultaneous hop from statement subjects to objects.

    ``statements(subject_qid, property_id, object_qid)``, ``domains(qid, domain)``,
    ``roles(property_id, role)``. Returns ``qid, attribute, value`` without repetition.
    """
    hop = statements.select(F.col("subject_qid").alias("qid"), "object_qid", "property_id")
    moved = lookup_join(hop.select("qid", "object_qid").distinct(), domains, ["qid"]).select(
        F.col("object_qid").alias("qid"), F.lit("domain").alias("attribute"), F.col("domain").alias("value")
    )
    named = lookup_join(hop, roles, ["property_id"]).select(
        F.col("object_qid").alias("qid"), F.lit("role").alias("attribute"), F.col("role").alias("value")
    )
    own = domains.select("qid", F.lit("domain").alias("attribute"), F.col("domain").alias("value"))
    return own.unionByName(moved).unionByName(named).distinct()


def cascade_record_violations(
    edges: DataFrame, shocks: DataFrame, events: DataFrame, capacity: DataFrame, days: DataFrame, stages: int = 3,
    stage_days: int = 10, shock_days: int = 1,
) -> DataFrame:
    """Shock and event records that break a rule of their own: ``record, snapshot, item, seq, reason``.

    As :func:`replay_cascade`, with ``event_day`` and the record number ``seq`` in ``shocks`` and ``events``, and
    ``days(snapshot, query_day)``. ``position``: unknown snapshot, node or edge, or a stage that doesn't exist; such a record is
    not judged further. ``duplicate``: a later record of the same place, by ``seq``. ``time``: not ``shock_days`` after the
    query day or not ``stage_days`` times the stage after it. ``severity``: missing, negative or not finite. A record may
    break several rules; nulls break the rule they stand in. A place with very many records is judged without gathering them.
    """
    calendar = days.select("snapshot", F.col("query_day").alias("_q"))

    def judged(rows: DataFrame, record: str, key: str, known: DataFrame, on: list[str], placed: Column, due: Column, others: list[Column]):
        found = lookup_join(lookup_join(rows, calendar, ["snapshot"], "left"), known.withColumn("_known", F.lit(True)), on, "left")
        right = F.coalesce(F.col("_known") & F.col("_q").isNotNull() & placed, F.lit(False))
        shown = ["snapshot", F.col(key).cast("string").alias("item"), "seq"]
        lost = found.filter(~right).select(F.lit(record).alias("record"), *shown, F.lit("position").alias("reason"))
        first = attach_group_stats(found.filter(right), ["snapshot", key], {"_first": F.min("seq")})
        reasons = F.array(
            F.when(F.col("seq") > F.col("_first"), "duplicate"),
            F.when(~F.col("event_day").eqNullSafe(due), "time"),
            *others,
        )
        return lost.unionByName(
            first.select(F.lit(record).alias("record"), *shown, F.explode(F.array_compact(reasons)).alias("reason"))
        )

    bad_severity = F.when(~F.coalesce(is_finite("severity") & (F.col("severity") >= 0), F.lit(False)), "severity")
    return judged(
        shocks.select("snapshot", "node_id", "severity", "event_day", "seq"), "shock", "node_id",
        capacity.select("snapshot", "node_id"), ["snapshot", "node_id"], F.lit(True), F.col("_q") + shock_days, [bad_severity],
    ).unionByName(judged(
        events.select("snapshot", "edge_id", "stage", "event_day", "seq"), "event", "edge_id",
        edges.select("edge_id"), ["edge_id"], F.col("stage").between(1, stages), F.col("_q") + F.col("stage") * stage_days, [],
    ))


def replay_cascade(
    edges: DataFrame, shocks: DataFrame, events: DataFrame, capacity: DataFrame, margin: float = 0.25, stages: int = 3,
) -> dict[str, DataFrame]:
    """Re-derive failures from shock and propagation records.

    ``shocks(snapshot, node_id, severity)``, ``events(snapshot, edge_id, stage)``,
    ``capacity(snapshot, node_id, capacity)`` (mean capacity). A node fails first when its severity
    exceeds capacity plus ``margin``. An event is causal when its source failed in the stage before
    and its target had not failed yet. Severities that are missing, negative or not finite fail no node; events of other
    stages and of unknown edges are left out (:func:`cascade_record_violations` names them). Returns the tables ``initial``,
    ``violations``, ``node_truth`` and ``edge_truth``.
    """
    initial = durable(
        lookup_join(shocks, capacity, ["snapshot", "node_id"])
        .filter(is_finite("severity") & (F.col("severity") >= 0) & (F.col("severity") > F.col("capacity") + margin))
        .select("snapshot", "node_id").distinct(),
        "initial",
    )
    staged = events.select("snapshot", "edge_id", "stage").filter(F.col("stage").between(1, stages))
    located = durable(lookup_join(staged, edges.select("edge_id", "src", "dst"), ["edge_id"]), "events")
    frontier, failed, violations = initial, initial, []
    for stage in range(1, stages + 1):
        now = located.filter(F.col("stage") == stage)
        from_frontier = now.join(
            frontier.select("snapshot", F.col("node_id").alias("src"), F.lit(True).alias("_s")), ["snapshot", "src"], "left"
        )
        checked = from_frontier.join(
            failed.select("snapshot", F.col("node_id").alias("dst"), F.lit(True).alias("_f")), ["snapshot", "dst"], "left"
        )
        violations.append(
            checked.filter(F.col("_s").isNull() | F.col("_f").isNotNull()).select("snapshot", "edge_id", "stage")
        )
        frontier = durable(now.select("snapshot", F.col("dst").alias("node_id")).distinct(), "failed")
        failed = durable(failed.unionByName(frontier).distinct(), "failed")
    return {
        "initial": initial,
        "violations": _union(violations),
        "node_truth": initial.unionByName(located.select("snapshot", F.col("dst").alias("node_id"))).distinct(),
        "edge_truth": located.select("snapshot", "edge_id").distinct(),
    }
