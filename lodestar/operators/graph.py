"""Iterative operators: PageRank, bounded breadth-first search, greedy first-seen deduplication.

Each round is joins and group-bys; lineage is cut with a table in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.store import cut


def pagerank(edges: DataFrame, rounds: int = 30, damping: float = 0.85, tolerance: float = 1e-9, cut_every: int = 5) -> DataFrame:
    """node, rank: edges once each, dangling mass spread over all nodes, ends when the L1 change is small.

    The dangling sum and the change are one number a round; nothing else reaches the driver.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(out, F.col("node") == out["src"], "left").select("node", "degree"), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "degree", F.lit(1.0 / n).alias("rank"))
    for k in range(1, rounds + 1):
        dangling = ranks.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        push = edges.join(ranks, edges["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("sent"))
        base = (1 - damping) / n + damping * dangling / n
        new = ranks.join(push, ranks["node"] == push["dst"], "left").select("node", "degree", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("sent", F.lit(0.0))).alias("rank"))
        if k % cut_every == 0 or k == rounds:
            new = cut(new, "ranks")
            moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            ranks = new.drop("old")
            if moved < tolerance:
                break
        else:
            ranks = new.drop("old")
    return ranks.select("node", "rank")


def blend_authority(items: DataFrame, ranks: DataFrame) -> DataFrame:
    """items(node, authority) with half of each node's max-normalised rank; nodes outside the graph keep theirs."""
    top = ranks.agg(F.max("rank")).first()[0] or 1.0
    joined = items.join(ranks, "node", "left")
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.col("authority") + 0.5 * F.col("rank") / top))
    return joined.select("node", F.when(F.col("rank").isNull(), F.col("authority")).otherwise(mixed).alias("authority"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """node, depth: nodes within `depth` steps of the seeds, each at its first depth."""
    seen = cut(seeds.select("node", F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen


def first_seen(ids: DataFrame, near: DataFrame, rounds: int = 1000) -> DataFrame:
    """Ids that a scan in id order keeps, dropping each that is near an earlier kept one.

    Fixpoint of: keep an open id without an open or kept smaller neighbour, drop those near a kept smaller one.
    `near` has pairs (a, b) with a < b. Rounds follow the longest chain of decisions.
    """
    near = cut(near.select("a", "b"), "near")
    kept = ids.join(near.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    open_ids = cut(near.select(F.col("b").alias("id")).distinct(), "open")
    kept = cut(kept.select("id"), "kept")
    for _ in range(rounds):
        if not open_ids.limit(1).count():
            return kept
        dropped = near.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        rest = open_ids.join(dropped, "id", "left_anti")
        blocked = near.join(rest.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = cut(rest.join(blocked, "id", "left_anti"), "new")
        kept = kept.unionByName(new)
        open_ids = cut(rest.join(new, "id", "left_anti"), "open")
    raise RuntimeError(f"undecided after {rounds} rounds")
