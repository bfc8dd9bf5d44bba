"""Graph operators by rounds of joins; frontiers and labels stay tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoweave.shared import written


def linked(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b) of longs: label is the smallest node reachable; nodes without links have no row.

    Alternates large-star and small-star steps: each ties the neighbours of a node to the smallest of them. The
    minima are partial aggregates and the join back is one that Spark can split, so a node with very many links is
    no task of its own. Rounds grow with the logarithm of a component's diameter; each is a table in the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    known = None
    while True:
        # large star: larger neighbours of a node go to the smallest around it
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "stars")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == known:
            break
        known = seen
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def cycles(steps: DataFrame) -> DataFrame:
    """(node, label): the least node of each cycle, for steps (id, next) that make nothing but cycles.

    Each round doubles the way that a node looks ahead, so a cycle of n nodes takes log n joins.
    """
    ahead = written(steps.select(F.col("id").alias("node"), F.col("next").alias("far"), F.col("id").alias("label")), "cycles")
    while True:
        there = ahead.select(F.col("node").alias("far"), F.col("far").alias("farther"), F.col("label").alias("other"))
        ahead = written(ahead.join(there, "far").select("node", F.col("farther").alias("far"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("changed")), "cycles")
        if not ahead.where("changed").limit(1).count():
            return ahead.select("node", "label")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label): the least node of each node's component; nodes (v), edges (a, b) in either direction.

    Nodes without edges are components of their own; ends of edges that are no nodes tie nodes all the same. Repeated
    nodes and edges count once.
    """
    labels = written(linked(edges), "labels")
    return nodes.select("v").distinct().join(labels.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def hops(start: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(v, hops): the least number of edges (a, b), one way, from any of start (v).

    Nodes that can't be reached have no row; without start nodes there are none. Repeated edges change nothing.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")  # each round reads them
    seen = written(start.select("v").distinct().withColumn("hops", F.lit(0)), "hops")
    frontier, n = seen, 0
    while most is None or n < most:
        n += 1
        step = frontier.join(edges, frontier["v"] == edges["a"]).select(F.col("b").alias("v")).distinct()
        frontier = written(step.join(seen, "v", "left_anti").withColumn("hops", F.lit(n)), "hops")
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
        if n % 16 == 0:  # a plan of few files
            seen = written(seen, "hops")
    return seen


def route_costs(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, cost, via): the cheapest way from any of start (v) over edges (a, b, cost >= 0), and the node before on it.

    Only nodes that got cheaper go on to the next round. via is the least node at a tie, -1 at the start. Nodes that can't be
    reached have no row; of repeated edges the cheapest counts; null costs lead nowhere.
    """
    edges = written(edges.select("a", "b", "cost"), "edges")  # each round reads them
    best = written(start.select("v", F.lit(0.0).alias("cost"), F.lit(-1).cast("long").alias("via")).distinct(), "costs")
    open_ = best
    while True:
        tried = open_.join(edges.withColumnRenamed("cost", "w"), F.col("v") == F.col("a")).select(F.col("b").alias("v"), (F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("via"))
        least = tried.groupBy("v").agg(F.min(F.struct("cost", "via")).alias("n"))
        both = best.join(least, "v", "full")
        new = F.struct(F.col("cost"), F.col("via"))
        cheaper = F.col("cost").isNull() | (F.col("n") < new)
        merged = written(both.select("v", F.when(F.col("n").isNotNull() & cheaper, F.col("n")).otherwise(new).alias("s"), (F.col("n").isNotNull() & cheaper).alias("fresh")), "costs")
        best = merged.select("v", "s.cost", "s.via")
        open_ = merged.where("fresh").select("v", "s.cost", "s.via")
        if not open_.limit(1).count():
            return best


def coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, colour): the least colours, from 0, so that no edge (a, b) joins two nodes (v) of one; the same on each run.

    In a round those nodes choose whose hash is greater than that of all neighbours without a colour, so neighbours never
    choose together; the number of rounds grows with the logarithm of the number of nodes. A node has at most as many colours
    before it as neighbours. Edges count in both directions; loops and ends that are no nodes are not looked at.
    """
    nodes = nodes.select("v").where("v is not null").distinct()
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both.join(nodes.withColumnRenamed("v", "a"), "a", "left_semi").join(nodes.withColumnRenamed("v", "b"), "b", "left_semi"), "edges")
    state = written(nodes.withColumn("colour", F.lit(None).cast("int")), "colours")
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while True:
        around = both.join(state.select(F.col("v").alias("b"), "colour"), "b")
        seen = around.groupBy(F.col("a").alias("v")).agg(F.max(F.when(F.col("colour").isNull(), rank("b"))).alias("open"), F.collect_set("colour").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(F.coalesce("used", F.array().cast("array<int>")))), F.coalesce("used", F.array().cast("array<int>"))))
        mine = F.col("open").isNull() | (rank("v") > F.col("open"))
        state = written(state.join(seen, "v", "left").select("v", F.when(F.col("colour").isNotNull(), F.col("colour")).when(mine, free).alias("colour")), "colours")
        if not state.where("colour is null").limit(1).count():
            return state


def two_hop_neighbours(edges: DataFrame) -> DataFrame:
    """(a, c): nodes two edges away that are neither the node itself nor a neighbour; repeated edges count once."""
    e = edges.select("a", "b").distinct()
    far = e.select("a", F.col("b").alias("m")).join(e.select(F.col("a").alias("m"), F.col("b").alias("c")), "m").where("a <> c").select("a", "c").distinct()
    return far.join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti")


def reached_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label): the least node from which v can be reached over edges (a, b), one way; its own number if none is less.

    This is what floods from the lowest number on give, each taking what earlier ones left. A round takes the least label
    before a node and then that label's own, so chains shorten by halves; edges from or to no node are not looked at.
    """
    nodes = written(nodes.select("v").distinct(), "nodes")
    edges = written(edges.select("a", "b").distinct().join(nodes.withColumnRenamed("v", "a"), "a", "left_semi").join(nodes.withColumnRenamed("v", "b"), "b", "left_semi"), "edges")
    labels = written(nodes.select("v", F.col("v").alias("label")), "labels")
    while True:
        before = edges.join(labels.select(F.col("v").alias("a"), "label"), "a").groupBy(F.col("b").alias("v")).agg(F.min("label").alias("m"))
        low = labels.join(before, "v", "left").select("v", "label", F.least("label", "m").alias("low"))
        up = labels.select(F.col("v").alias("low"), F.col("label").alias("up"))
        new = written(low.join(up, "low").select("v", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("changed")), "labels")
        labels = new.select("v", "label")
        if not new.where("changed").limit(1).count():
            return labels
