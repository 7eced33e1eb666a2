"""Walks over graphs of any size for many starts at once: least and longest distances, shortest paths.

A walk goes level by level. A level is one join of the last level with the edges, reduced to distinct nodes for each key, so
its rows are bounded by keys times nodes whatever the number of paths, and a walk ends when a level is empty: nothing limits
its length. Levels are stored in the shared folder; the driver learns of each only whether it holds a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.storage import Levels


class CyclicGraph(ValueError):
    """Longest chains were asked of a graph with a cycle."""


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).filter("_src IS NOT NULL AND _dst IS NOT NULL").distinct()


def _stepped(front: DataFrame, arcs: DataFrame, keys: list[str]) -> DataFrame:
    return front.join(arcs, front.node == arcs._src).select(*keys, F.col("_dst").alias("node")).distinct()


def reached(starts: DataFrame, edges: DataFrame, keys: list[str], barred: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    """(keys, node, depth): every node that starts (keys, node) reach over edges (src, dst), at its least number of steps.

    A start itself has depth 0. Nodes barred, or not inside, are neither reached nor walked through; starts may be. Both are
    (some of the keys, node). Cycles end by themselves, as a node is met once. Rows with a null node or key reach nothing.
    """
    arcs, levels = _edges(edges), Levels(starts.sparkSession, "walk")
    there = starts.select(*keys, "node").dropna().distinct()
    depth = 0
    while levels.add(depth, there):
        new = _stepped(levels.at(depth), arcs, keys)
        if barred is not None:
            new = new.join(barred, barred.columns, "left_anti")
        if inside is not None:
            new = new.join(inside, inside.columns, "left_semi")
        there, depth = new.join(levels.all().drop("level"), [*keys, "node"], "left_anti"), depth + 1
    return levels.all().withColumnRenamed("level", "depth")


def farthest(starts: DataFrame, edges: DataFrame, keys: list[str], inside: DataFrame) -> DataFrame:
    """(keys, node, depth): the most steps of a chain from a start (keys, node) to a node, all of it but the start inside.

    inside is (some of the keys, node). Nodes that no chain reaches are not listed; a start has depth 0 unless a chain comes
    to it. A level holds the ends of all chains of one length. A chain longer than there are nodes has met one twice: then
    CyclicGraph is raised.
    """
    arcs, levels = _edges(edges), Levels(starts.sparkSession, "chains")
    most = arcs.select("_src").union(arcs.select("_dst")).distinct().count()
    there = starts.select(*keys, "node").dropna().distinct()
    depth = 0
    while levels.add(depth, there):
        if depth > most:
            raise CyclicGraph("the edges hold a cycle, so chains have no end")
        there, depth = _stepped(levels.at(depth), arcs, keys).join(inside, inside.columns, "left_semi"), depth + 1
    return levels.all().groupBy(*keys, "node").agg(F.max("level").alias("depth"))


def shortest_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, goal, path): for each pair (start, goal) the shortest way over undirected edges (src, dst), as an array of nodes.

    Of several the first in the order of its nodes' names. A pair of equal ends has a path of one node, if the node is in
    the graph; pairs without a way have no row. Distances are searched once from each distinct goal, and every node's next
    step towards a goal is the smallest of those one step nearer; paths are read off by following it.
    """
    pairs = pairs.select("start", "goal").dropna().distinct()
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    nodes = both.select(F.col("src").alias("node")).distinct()
    goals = pairs.select("goal").distinct().withColumn("node", F.col("goal")).join(nodes, "node", "left_semi")
    near = reached(goals, both, ["goal"])
    closer = near.select("goal", F.col("node").alias("dst"), (F.col("depth") + 1).alias("depth"))
    step = near.join(both.withColumnRenamed("src", "node"), "node").join(closer, ["goal", "dst", "depth"]).groupBy("goal", "node").agg(F.min("dst").alias("next"))
    levels = Levels(pairs.sparkSession, "paths")
    there = pairs.join(near.select("goal", F.col("node").alias("start")), ["goal", "start"], "left_semi").select("start", "goal", F.col("start").alias("node"))
    at = 0
    while levels.add(at, there):
        there, at = levels.at(at).filter("node <> goal").join(step, ["goal", "node"]).select("start", "goal", F.col("next").alias("node")), at + 1
    return levels.all().groupBy("start", "goal").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "node"))), lambda x: x["node"]).alias("path"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): for each of nodes (node, ordinal) the smallest ordinal reachable over undirected edges (a, b) of nodes.

    Minimum labels spread along the edges and then jump along their own labels, so long chains shorten by half each round;
    rounds end when no label falls. Each round is stored.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links, rounds = Levels(nodes.sparkSession, "links"), Levels(nodes.sparkSession, "labels")
    named = nodes.select("node", "ordinal")
    links.add(0, both.join(named.select(F.col("node").alias("a"), F.col("ordinal").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("ordinal").alias("y")), "b").select("x", "y"))
    rounds.add(0, named.select(F.col("ordinal").alias("x"), F.col("ordinal").alias("label"), F.lit(True).alias("fell")))
    at = 0
    while True:
        old = rounds.at(at).select("x", "label")
        near = links.at(0).join(old.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        mid = old.join(near, "x", "left").select("x", F.least("label", "near").alias("mid"), F.col("label").alias("was"))
        top = mid.select(F.col("x").alias("mid"), F.col("mid").alias("top"))
        rounds.add(at + 1, mid.join(top, "mid").select("x", F.least("mid", "top").alias("label"), (F.least("mid", "top") < F.col("was")).alias("fell")))
        at += 1
        if rounds.at(at).filter("fell").isEmpty():
            return named.join(rounds.at(at).select(F.col("x").alias("ordinal"), F.col("label").alias("root")), "ordinal").select("node", "root")
