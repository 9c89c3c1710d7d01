"""The session graph: segments and speakers as nodes, labels spread from sure segments to their neighbours.

Edges are rows of a table, never a matrix. A session's speakers ("anchors") and its sure segments ("seeds") hold their label; what they give to a segment
is worked out once. Each round is then one join of the other segments' scores with the edges between them and one sum by (session, segment, speaker),
written to the shared folder; a session leaves the rounds as soon as its scores move by no more than the tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parlance.operators.bank import nearest_neighbours, top_rows
from parlance.operators.sequences import numbered
from parlance.tables import drop, materialize

#: Sessions that are told to all tasks by a broadcast.
BROADCAST_SESSIONS = 1_000_000


@dataclass(frozen=True)
class SessionGraph:
    """Weights and bars of the graph; pairs holds values for single pairs of speakers, by pair key and field."""

    # fixed values: the defaults users know
    candidate_top_k: int = 3
    candidate_floor: float = 0.20
    knn: int = 8
    min_similarity: float = 0.25
    anchor_weight: float = 1.0
    temporal_weight: float = 0.35
    temporal_tau_seconds: float = 0.75
    temporal_max_gap_seconds: float = 2.0
    same_raw_label_weight: float = 0.25
    same_top1_weight: float = 0.10
    alpha: float = 0.85
    max_iters: int = 30
    tolerance: float = 1e-4
    strong_seed_score: float = 0.60
    strong_seed_margin: float = 0.12
    override_min_confidence: float = 0.55
    override_min_margin: float = 0.12
    override_min_delta: float = 0.03
    pairs: dict[str, dict[str, float]] = field(default_factory=dict)

    def of_pair(self, name: str, pair: str = "pair") -> Column:
        """The field's value for a column of pair keys; the pairs are a configuration, so they travel with the plan."""
        own = [x for key, fields in sorted(self.pairs.items()) if name in fields for x in (F.lit(key), F.lit(float(fields[name])))]
        return F.coalesce(F.create_map(*own)[F.col(pair)], F.lit(float(getattr(self, name)))) if own else F.lit(float(getattr(self, name)))


def evidence(segments: DataFrame, candidates: DataFrame, threshold: float, margin: float, classifier_margin: float, graph: SessionGraph) -> DataFrame:
    """session, seg_idx, start, end, speaker_raw, local_speaker (null unless accepted), score, margin, pair of the two best, seed.

    segments: session, seg_idx, start, end, speaker_raw, overlap_heavy, was_split; candidates: session, seg_idx, rank, speaker, score.
    """
    from parlance.functions.text import pair_key

    first = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    top = candidates.where("rank <= 2").groupBy("session", "seg_idx").agg(first("speaker", 1).alias("top1"), first("speaker", 2).alias("top2"), first("score", 1).alias("score"), F.coalesce(first("score", 2), F.lit(0.0)).alias("second"))
    both = segments.join(top, ["session", "seg_idx"], "left").withColumn("margin", F.col("score") - F.col("second"))
    taken = F.coalesce((F.col("score") >= threshold) & (F.col("margin") >= max(margin, 0.0)), F.lit(False))
    sure = (F.col("end") - F.col("start") >= 0.75) & (F.col("score") >= max(threshold + 0.05, graph.strong_seed_score)) & (F.col("margin") >= max(classifier_margin, graph.strong_seed_margin))
    return both.select(
        "session", "seg_idx", "start", "end", "speaker_raw",
        F.when(taken, F.col("top1")).alias("local_speaker"), "score", "margin",
        pair_key(F.col("top1"), F.col("top2")).alias("pair"),
        (taken & F.coalesce(sure, F.lit(False)) & ~F.coalesce("overlap_heavy", F.lit(False)) & ~F.coalesce("was_split", F.lit(False))).alias("seed"),
    )


def anchors(candidates: DataFrame, graph: SessionGraph) -> DataFrame:
    """session, node, label, w: each segment's pull to its best candidates' speakers."""
    w = F.least(F.lit(1.0), (F.col("score") - graph.candidate_floor) / max(1.0 - graph.candidate_floor, 1e-6)) * graph.anchor_weight
    rows = candidates.where((F.col("rank") <= graph.candidate_top_k) & (F.col("score") > graph.candidate_floor) & (F.trim("speaker") != ""))
    return rows.groupBy("session", F.col("seg_idx").alias("node"), F.col("speaker").alias("label")).agg(F.max(w).alias("w")).where("w > 0")


def adjacent_edges(known: DataFrame, graph: SessionGraph) -> DataFrame:
    """session, src, dst, w between segments that follow each other: closeness in time, the same raw label, the same unsure best speaker; the largest counts.

    Neighbours meet by their place, which is counted in parts, so a session of any length is many tasks.
    """
    fields = ["start", "end", "speaker_raw", "local_speaker", "pair", "seed"]
    line = materialize(numbered(known.select("session", "seg_idx", *fields), ["session"], ["seg_idx"]), "places")
    right = line.select("session", (F.col("_i") - 1).alias("_i"), F.col("seg_idx").alias("dst"), *[F.col(c).alias(f"r_{c}") for c in fields])
    both = line.join(right, ["session", "_i"])
    gap = F.greatest(F.col("r_start") - F.col("end"), F.col("start") - F.col("r_end"), F.lit(0.0))
    near = F.when(gap <= graph.temporal_max_gap_seconds, graph.temporal_weight * F.exp(-gap / max(graph.temporal_tau_seconds, 1e-6)))
    # a pair's own value can only raise a bonus
    bonus = lambda name: F.greatest(F.lit(float(getattr(graph, name))), graph.of_pair(name, "pair"), graph.of_pair(name, "r_pair"))
    raw = F.when((F.coalesce("speaker_raw", F.lit("")) != "") & (F.col("speaker_raw") == F.col("r_speaker_raw")), bonus("same_raw_label_weight"))
    top = F.when(~F.col("seed") & ~F.col("r_seed") & (F.col("local_speaker") == F.col("r_local_speaker")), bonus("same_top1_weight"))
    return both.select("session", F.col("seg_idx").alias("src"), "dst", F.greatest(near, raw, top).alias("w")).where("w > 0")


def session_edges(known: DataFrame, vectors: DataFrame, graph: SessionGraph) -> DataFrame:
    """session, src, dst, w, both ways: neighbours by vector and by place, joined by the larger weight. vectors: session, seg_idx, embedding."""
    side = adjacent_edges(known, graph)
    both = nearest_neighbours(vectors, graph.knn, graph.min_similarity).unionByName(side).unionByName(side.select("session", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("session", "src", "dst").agg(F.max("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, pulls: DataFrame | None = None, alpha: float = 0.85, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """session, node, label, score of every node and label that some seed or anchor reaches: F = alpha S F + (1 - alpha) Y, S row-normalised, seeds and anchors held.

    edges: session, src, dst, w, both ways; seeds: session, node, label; pulls (anchors()): session, node, label, w.
    """
    nodes = ["session", "node"]
    edges, seeds = materialize(edges, "edges"), materialize(seeds.select(*nodes, "label").distinct(), "seeds")
    held = seeds.select(*nodes)
    out = edges.select("session", F.col("src").alias("node"), "w")
    if pulls is not None:
        pulls = materialize(pulls, "pulls")
        out = out.unionByName(pulls.select(*nodes, "w"))
    total = out.groupBy(*nodes).agg(F.sum("w").alias("total")).where("total > 0").join(held, nodes, "left_anti")
    share = edges.withColumnRenamed("src", "node").join(total, nodes).select(*nodes, "dst", (alpha * F.col("w") / F.col("total")).alias("p"))
    share = materialize(share, "shares")
    target = ["session", "dst"]
    free = materialize(share.join(held.withColumnRenamed("node", "dst"), target, "left_anti"), "free")
    given = share.join(seeds.withColumnRenamed("node", "dst"), target).select(*nodes, "label", "p")
    if pulls is not None:
        given = given.unionByName(pulls.join(total, nodes).select(*nodes, "label", (alpha * F.col("w") / F.col("total")).alias("p")))
    key, moved = [*nodes, "label"], F.max(F.abs(F.col("score") - F.col("was")))
    base = materialize(given.groupBy(*key).agg(F.sum("p").alias("score")), "base")
    state, most = base.withColumn("was", F.lit(0.0)), base.agg(F.max("score")).first()[0] or 0.0
    ended, few = [], base.select("session").distinct().count() <= BROADCAST_SESSIONS
    for _ in range(rounds - 1):
        if most <= tolerance:
            break
        still = state.groupBy("session").agg(moved.alias("moved")).where(F.col("moved") > tolerance).select("session")
        still = F.broadcast(still) if few else still
        ended.append(state.join(still, "session", "left_anti"))
        going = state.join(still, "session", "left_semi")
        flow = free.join(going.select("session", F.col("node").alias("dst"), "label", "score"), target).select(*key, (F.col("p") * F.col("score")).alias("score"), F.lit(0.0).alias("was"))
        rest = base.join(still, "session", "left_semi").select(*key, "score", F.lit(0.0).alias("was"))
        old = going.select(*key, F.lit(0.0).alias("score"), F.col("score").alias("was"))
        seen = Observation()
        after = flow.unionByName(rest).unionByName(old).groupBy(*key).agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
        state = materialize(after.observe(seen, moved.alias("moved")), "scores")
        most = seen.get["moved"] or 0.0
    found = state
    for part in ended:
        found = found.unionByName(part)
    found = found.select(*key, "score").unionByName(seeds.select(*key, F.lit(1.0).alias("score")))
    done = materialize(found, "propagated")
    for t in (edges, share, free):
        drop(t)
    return done


def best_labels(scores: DataFrame, top: int = 3) -> DataFrame:
    """session, node, label, score, margin, candidates: each node's best label, the first by name on ties; a missing second counts 0."""
    rank = F.row_number().over(Window.partitionBy("session", "node").orderBy(F.desc("score"), "label"))
    ranked = scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= max(top, 2))
    first = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))), lambda x: F.struct(x["label"].alias("speaker"), x["score"].alias("score")))
    out = ranked.groupBy("session", "node").agg(first("label", 1).alias("label"), first("score", 1).alias("score"), F.coalesce(first("score", 2), F.lit(0.0)).alias("second"), F.slice(listed, 1, top).alias("candidates"))
    return out.select("session", "node", "label", "score", (F.col("score") - F.col("second")).alias("margin"), "second", "candidates")


def strongest(edges: DataFrame, k: int = 3) -> DataFrame:
    """session, node, neighbours: the k strongest neighbours of each node, the smaller on ties."""
    near = top_rows(edges, ["session", "src"], [F.desc("w"), F.col("dst")], k, "dst")
    return near.groupBy("session", F.col("src").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dst", "w"))), lambda x: F.struct(x["dst"].alias("node"), x["w"].alias("w"))).alias("neighbours"))


def session_graph(known: DataFrame, candidates: DataFrame, vectors: DataFrame, graph: SessionGraph) -> DataFrame:
    """session, node, label, score, margin, second, candidates, neighbours of every segment that some label reaches. known: of evidence()."""
    known = materialize(known, "evidence")
    edges = materialize(session_edges(known, vectors, graph), "session-edges")
    some = candidates.where(F.col("rank") <= graph.candidate_top_k).select("session", F.col("speaker").alias("local_speaker")).distinct()
    seeds = known.where("seed").join(some, ["session", "local_speaker"], "left_semi").select("session", F.col("seg_idx").alias("node"), F.col("local_speaker").alias("label"))
    scores = propagate(edges, seeds, anchors(candidates, graph), graph.alpha, max(graph.max_iters, 1), graph.tolerance)
    best = best_labels(scores, max(graph.candidate_top_k, 1))
    return best.join(strongest(edges), ["session", "node"], "left")


def overridden(local: DataFrame, found: DataFrame, graph: SessionGraph) -> DataFrame:
    """local (session, seg_idx, speaker, score, seed, pair) with graph_label, graph_score, graph_margin, final speaker and overridden.

    A segment that isn't a seed takes the graph's label if that is sure enough for its pair, and, where the segment has a speaker, better by the pair's gain.
    """
    g = found.select("session", F.col("node").alias("seg_idx"), F.col("label").alias("graph_label"), F.col("score").alias("graph_score"), F.col("margin").alias("graph_margin"))
    both = local.join(g, ["session", "seg_idx"], "left")
    unknown = F.lower(F.coalesce(F.trim("speaker"), F.lit(""))).isin("", "unknown")
    sure = (F.col("graph_score") >= graph.of_pair("override_min_confidence")) & (F.col("graph_margin") >= graph.of_pair("override_min_margin"))
    better = unknown | (F.col("graph_score") >= F.coalesce("score", F.lit(0.0)) + graph.of_pair("override_min_delta"))
    take = F.coalesce(~F.col("seed") & sure & better, F.lit(False))
    return both.withColumns({"final": F.when(take, F.col("graph_label")).otherwise(F.col("speaker")), "overridden": take})
