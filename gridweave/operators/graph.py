"""Closures, levels, components and orders of edge tables by iterated joins.

Each round is one job over the new frontier, cut at the shared checkpoint folder; visited
vertices stay in DataFrames and only counts reach the driver. Rounds go on until nothing
changes; a depth limit is given by the caller where a limit is meant.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frontiers of a closure that are kept apart before they are written as one table.
KEPT_FRONTIERS = 12


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``. Where it is unset a folder of this machine will do only if all
    of Spark runs in one process; elsewhere that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not shared:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridweave-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reach(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches, at its least depth; cycles end.

    ``starts`` has ``start`` and ``node``, ``edges`` has ``src`` and ``dst``."""
    frontier = cut(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)))
    parts, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        for part in parts:
            nxt = nxt.join(part.select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut(nxt.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > KEPT_FRONTIERS:
            parts = [cut(union(parts))]
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node is connected with.

    Labels take the least label of their neighbours, then jump to their label's label."""
    both = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), F.col("l").alias("component")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nxt = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        nxt = cut(nxt)
        jump = nxt.select(F.col("node").alias("j_node"), F.col("c").alias("j"))
        new = cut(nxt.join(jump, F.col("c") == F.col("j_node"), "left").select("node", F.coalesce("j", "c").alias("component"), "old"))
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label


def _peel(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers of nodes without predecessors, taken off one after another, and the edges that are
    left: none, or those of cycles and of what hangs on them."""
    left = cut(edges)
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    layers, depth = [], 0
    while not nodes.isEmpty():
        free = cut(nodes.join(left.select("dst").distinct(), F.col("node") == F.col("dst"), "left_anti"))
        if free.isEmpty():
            break
        layers.append(free.withColumn("level", F.lit(depth)))
        depth += 1
        nodes = cut(nodes.join(free, "node", "left_anti"))
        left = cut(left.join(free, F.col("src") == F.col("node"), "left_anti"))
        if len(layers) > KEPT_FRONTIERS:
            layers = [cut(union(layers))]
    return layers, left


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def back_edges(edges: DataFrame) -> DataFrame:
    """Edges into the smallest node of a cycle from that cycle, for each group of cycles that no
    other one leads to. ``edges`` has no node without a predecessor."""
    core = cut(_flip(_peel(_flip(edges))[1]))  # what only hangs on cycles is gone, too
    # The least node that leads to a node, by at least one edge; on a cycle's smallest it is itself.
    least = cut(core.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("least")))
    while True:
        near = core.join(least, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("least").alias("near"))
        nxt = cut(least.join(near, F.col("node") == F.col("dst"), "left").select("node", F.least("least", "near").alias("least"), F.col("least").alias("old")))
        least = nxt.select("node", "least")
        if nxt.where("least <> old").isEmpty():
            break
    first = least.where("least = node").select(F.col("node").alias("start"), "node")
    own = cut(reach(first, core).select("start", F.col("node").alias("from_node")))
    return core.join(own, (F.col("dst") == F.col("start")) & (F.col("src") == F.col("from_node")), "left_semi")


def depth_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without predecessors. Each cycle is opened at
    the edges into its smallest node, those of first cycles first; loops are left out."""
    kept = cut(edges.select("src", "dst").where("src <> dst").distinct())
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    while True:
        layers, left = _peel(kept)
        if left.isEmpty():
            break
        back = cut(back_edges(left))
        kept = cut(kept.join(back.select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst")), (F.col("src") == F.col("b_src")) & (F.col("dst") == F.col("b_dst")), "left_anti"))
        if kept.isEmpty():
            break
    seen = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    placed = union([*layers, alone.where("false").withColumn("level", F.lit(0))]) if layers else seen.where("false").withColumn("level", F.lit(0))
    return seen.join(placed.withColumnRenamed("node", "p_node"), F.col("node") == F.col("p_node"), "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
