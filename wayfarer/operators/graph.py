"""Street graph operators: contraction, components, pruning, chains, walks."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.geo import haversine
from wayfarer.functions.scalars import PEDESTRIAN_HIGHWAYS
from wayfarer.functions.session import cut

#: Edges of a graph that goes to every executor for walks; larger graphs are relaxed by joins.
BROADCAST_EDGES = 8_000_000
#: Nodes under which a component is dropped.
LEAST_NODES = 50


def pedestrian_ways(ways: DataFrame) -> DataFrame:
    """Ways a pedestrian may use: by highway tag, with two nodes or more."""
    return ways.filter(F.col("tags")["highway"].isin(*PEDESTRIAN_HIGHWAYS) & (F.size("refs") >= 2))


def node_usage(ways: DataFrame) -> DataFrame:
    """node_id, usage: 2 for each end of a way, 1 for each inner place; nodes of 2 or more are kept by contraction."""
    at = ways.select(F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node_id"))
    weight = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1), 2).otherwise(1)
    return at.groupBy("node_id").agg(F.sum(weight).alias("usage"))


def contract(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, dist: ways cut at crossings and ends, with the metres along them; nodes without a place are bridged."""
    places = ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    kept = node_usage(ways).filter("usage >= 2").select("node_id", F.lit(True).alias("kept"))
    rows = places.join(kept, "node_id", "left")
    own = Window.partitionBy("way_id").orderBy("pos")
    step = F.coalesce(haversine(F.lag("lat").over(own), F.lag("lon").over(own), F.col("lat"), F.col("lon")), F.lit(0.0))
    rows = rows.withColumn("step", step).withColumn("along", F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.filter("kept")
    pairs = ends.withColumn("u", F.lag("node_id").over(own)).withColumn("dist", F.col("along") - F.lag("along").over(own)).filter("u is not null and u <> node_id")
    return shortest_parallel(pairs.select("u", F.col("node_id").alias("v"), "dist"))


def shortest_parallel(edges: DataFrame, weight: str = "dist") -> DataFrame:
    """One row for each unordered pair, the shorter end first, with the least weight; no loops."""
    return edges.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(weight).alias(weight))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *rest).union(edges.select(F.col("v"), F.col("u"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame, weight: str = "w") -> DataFrame:
    """node_id, neighbours: sorted (v, weight) of each node."""
    return both_ways(edges).groupBy(F.col("u").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("v", weight))).alias("neighbours"))


def star_components(edges: DataFrame) -> DataFrame:
    """node_id, component: the least node reachable from each node of an edge, by alternating large and small stars.

    A round joins every node's larger neighbours, then its smaller ones, to the least of them; rounds grow with the
    logarithm of the longest path. No neighbourhood is gathered: there are only minima and joins.
    """
    now, links = None, cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = both_ways(links)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(large.join(least, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        total = tuple(links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first())
        if total == now:
            break
        now = total
    found = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node_id")
    return found.unionByName(found.select(F.col("component").alias("node_id"), "component").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node_id, component: the least node reachable from each node of an edge.

    Nodes with one edge are taken off first, as what they hang on tells their component: where most nodes do so, the
    rounds of ``star_components`` have the few others alone. The least node may be one that was taken off.
    """
    links = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    single = cut(degrees(links).filter("degree = 1").select("node_id"))
    mark = lambda df, end: df.join(single.select(F.col("node_id").alias(end), F.lit(True).alias(f"{end}_one")), end, "left")
    one = F.col("u_one").isNotNull()  # of two nodes with one edge, the greater hangs on the other
    anchor = F.when(one, F.col("v")).when(F.col("v_one").isNotNull(), F.col("u"))
    marked = cut(mark(mark(links, "u"), "v").select("u", "v", anchor.alias("anchor"), F.when(one, F.col("u")).otherwise(F.col("v")).alias("leaf")))
    leaves = marked.filter("anchor is not null").select("leaf", "anchor")
    roots = star_components(marked.filter("anchor is null").select("u", "v"))
    low = leaves.groupBy(F.col("anchor").alias("node_id")).agg(F.min("leaf").alias("low"))
    inner = cut(roots.join(low, "node_id", "full").select("node_id", F.coalesce("component", "node_id").alias("root"), F.least("node_id", "low").alias("low")))
    least = inner.groupBy("root").agg(F.min("low").alias("component"))
    inner = cut(inner.join(least, "root").select("node_id", "component"))
    outer = leaves.join(inner.withColumnRenamed("node_id", "anchor"), "anchor").select(F.col("leaf").alias("node_id"), "component")
    return inner.unionByName(outer)


def drop_small(edges: DataFrame, least: int = LEAST_NODES) -> DataFrame:
    """Edges of components with at least so many nodes."""
    of = components(edges)
    large = of.groupBy("component").agg(F.count("*").alias("nodes")).filter(F.col("nodes") >= least).select("component")
    return edges.join(of.join(large, "component", "left_semi").select(F.col("node_id").alias("u")), "u", "left_semi")


def reachable(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Edges of components that hold a stop's node."""
    of = components(edges)
    served = of.join(stops.select("node_id"), "node_id", "left_semi").select("component").distinct()
    return edges.join(of.join(served, "component", "left_semi").select(F.col("node_id").alias("u")), "u", "left_semi")


#: Layers of leaves that are taken off before chains are contracted.
RAKES = 4


def _raked(links: DataFrame, stops: DataFrame) -> DataFrame:
    """Links none of whose ends has it alone, but for stops."""
    leaves = cut(degrees(links).filter("degree = 1").join(stops.select("node_id"), "node_id", "left_anti").select("node_id"))
    kept = links.join(leaves.select(F.col("node_id").alias("u")), "u", "left_anti").join(leaves.select(F.col("node_id").alias("v")), "v", "left_anti")
    return cut(kept.select("link", "u", "v"))


def _contracted(links: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with each chain of nodes with two links, none of them a stop, as one; link, into: which one a chain's links became)."""
    inner = cut(degrees(links).filter("degree = 2").join(stops.select("node_id"), "node_id", "left_anti").select("node_id"))
    mark = lambda df, end: df.join(inner.select(F.col("node_id").alias(end), F.lit(True).alias(f"{end}_in")), end, "left")
    marked = mark(mark(links, "u"), "v").select("link", "u", "v", F.coalesce("u_in", F.lit(False)).alias("u_in"), F.coalesce("v_in", F.lit(False)).alias("v_in")).filter("u_in or v_in")
    marked = cut(marked)
    chain = star_components(marked.filter("u_in and v_in").select("u", "v"))
    of = cut(inner.join(chain, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("chain")))
    member = marked.select("link", "u_in", F.when(F.col("u_in"), F.col("u")).otherwise(F.col("v")).alias("node_id"), F.when(F.col("u_in") & F.col("v_in"), F.lit(None)).when(F.col("u_in"), F.col("v")).otherwise(F.col("u")).alias("anchor")).join(of, "node_id")
    made = member.groupBy("chain").agg(F.min("link").alias("into"), F.min("anchor").alias("u"), F.max("anchor").alias("v"), F.count("anchor").alias("ends")).filter("ends = 2")  # a ring has none and stays
    into = cut(member.join(made, "chain").select("link", "into", "u", "v"))
    kept = links.join(into.select("link"), "link", "left_anti").select("link", "u", "v")
    return cut(kept.unionByName(into.select(F.col("into").alias("link"), "u", "v").distinct())), into.select("link", "into")


def prune_leaves(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Edges without dead ends: nodes with one edge that are no stop go, again and again.

    A few layers are taken off, then each chain of nodes with two links becomes one link, which goes as one when an end of it
    does: so a dead end takes about the logarithm of its length in rounds, however it branches. At last the edges whose link is left stay.
    """
    edges = cut(edges.withColumn("link", F.monotonically_increasing_id()))
    links, of, before = edges.select("link", "u", "v"), None, edges.count()
    for layer in itertools.count(1):
        links = _raked(links, stops)
        if (now := links.count()) == before:
            break
        before = now
        if layer % RAKES == 0 and now:
            links, into = _contracted(links, stops)
            own = edges.select("link", F.col("link").alias("at")) if of is None else of
            of = cut(own.join(into.select(F.col("link").alias("at"), "into"), "at", "left").select("link", F.coalesce("into", "at").alias("at")))
            before = links.count()
    stays = links.select("link") if of is None else of.join(links.select(F.col("link").alias("at")), "at", "left_semi").select("link")
    return edges.join(stays, "link", "left_semi").drop("link")


def collapse_chains(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """u, v, dist: chains of nodes with two edges that are no stop as one edge of their length; loops go, the shortest of parallel edges stays; until stable."""
    edges = cut(shortest_parallel(edges))
    while True:
        inner = cut(degrees(edges).filter("degree = 2").join(stops.select("node_id"), "node_id", "left_anti").select("node_id"))
        mark = lambda df, end: df.join(inner.select(F.col("node_id").alias(end), F.lit(True).alias(f"{end}_in")), end, "left")
        marked = mark(mark(edges, "u"), "v").select("u", "v", "dist", F.coalesce("u_in", F.lit(False)).alias("u_in"), F.coalesce("v_in", F.lit(False)).alias("v_in"))
        between = marked.filter("u_in and v_in")
        chain = star_components(between.select("u", "v"))
        of = inner.join(chain, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("chain"))
        ends = marked.filter("u_in <> v_in").select(F.when(F.col("u_in"), F.col("u")).otherwise(F.col("v")).alias("node_id"), F.when(F.col("u_in"), F.col("v")).otherwise(F.col("u")).alias("anchor"), "dist").join(of, "node_id")
        inside = between.join(of.withColumnRenamed("node_id", "u"), "u").groupBy("chain").agg(F.sum("dist").alias("inside"))
        made = ends.groupBy("chain").agg(F.min("anchor").alias("u"), F.max("anchor").alias("v"), F.sum("dist").alias("ends"), F.count("*").alias("n")).filter("n = 2")
        made = made.join(inside, "chain", "left").select("chain", "u", "v", (F.col("ends") + F.coalesce("inside", F.lit(0))).alias("dist"))
        # rings without an end stay as they are
        gone = of.join(made.select("chain"), "chain", "left_semi").select("node_id")
        kept = edges.join(gone.select(F.col("node_id").alias("u")), "u", "left_anti").join(gone.select(F.col("node_id").alias("v")), "v", "left_anti").select("u", "v", "dist")
        new = cut(shortest_parallel(kept.unionByName(made.select("u", "v", "dist"))))
        if not gone.limit(1).count():
            return new
        edges = new


def walk_times(edges: DataFrame, sources: DataFrame, budget: int) -> DataFrame:
    """source, node_id, w: least walking seconds from every source within the budget, the source itself at 0.

    A city's graph is bounded: up to BROADCAST_EDGES it goes to the executors as arrays and every task searches for its own
    sources. A larger one is relaxed by joins, a round for each edge of the longest path.
    """
    sources = sources.select("source").distinct()
    if edges.count() > BROADCAST_EDGES:
        return relaxed_walks(edges, sources, budget)
    arcs = both_ways(edges.select("u", "v", F.col("w").cast("int").alias("w"))).toArrow()
    u, v, w = (arcs.column(k).to_numpy() for k in range(3))
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(flat[: len(u)], kind="stable")
    offsets = np.searchsorted(flat[: len(u)][order], np.arange(len(names) + 1))
    shared = edges.sparkSession.sparkContext.broadcast((names, offsets, flat[len(u) :][order], w[order]))

    def search(batches):
        names, offsets, heads, weights = shared.value
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for source in batch.column(0).to_pylist():
                at = int(np.searchsorted(names, source)) if len(names) else 0
                if at >= len(names) or names[at] != source:
                    out.append((source, source, 0))
                    continue
                done: dict[int, int] = {}
                heap = [(0, at)]
                while heap:
                    d, x = heapq.heappop(heap)
                    if x in done:
                        continue
                    done[x] = d
                    for k in range(offsets[x], offsets[x + 1]):
                        y, e = int(heads[k]), d + int(weights[k])
                        if e <= budget and y not in done:
                            heapq.heappush(heap, (e, y))
                out += [(source, int(names[x]), d) for x, d in done.items()]
            s, n, t = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.int32())], ["source", "node_id", "w"])

    return sources.select(F.col("source").cast("long")).mapInArrow(search, "source long, node_id long, w int")


def relaxed_walks(edges: DataFrame, sources: DataFrame, budget: int) -> DataFrame:
    """As ``walk_times``, by joins: only nodes that a round improved go on."""
    arcs = cut(both_ways(edges.select("u", "v", "w")))
    best = cut(sources.select(F.col("source").cast("long").alias("source"), F.col("source").cast("long").alias("node_id"), F.lit(0).alias("w")))
    new = best
    while new.limit(1).count():
        steps = new.join(arcs.select(F.col("u").alias("node_id"), F.col("v").alias("to"), F.col("w").alias("step")), "node_id")
        steps = steps.select("source", F.col("to").alias("node_id"), (F.col("w") + F.col("step")).alias("w")).filter(F.col("w") <= budget).groupBy("source", "node_id").agg(F.min("w").alias("w"))
        known = best.withColumnRenamed("w", "known")
        new = cut(steps.join(known, ["source", "node_id"], "left").filter(F.col("known").isNull() | (F.col("w") < F.col("known"))).drop("known"))
        best = cut(best.join(new.select("source", "node_id"), ["source", "node_id"], "left_anti").unionByName(new))
    return best.select("source", "node_id", F.col("w").cast("int").alias("w"))


def walk_tree(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """source, node_id, parent: the least neighbour through which a node's walk is as short as it is; null at the source."""
    arcs = both_ways(edges.select("u", "v", F.col("w").alias("step"))).select(F.col("u").alias("parent"), F.col("v").alias("node_id"), "step")
    at = walks.select("source", F.col("node_id").alias("parent"), F.col("w").alias("before"))
    tight = at.join(arcs, "parent").join(walks, ["source", "node_id"]).filter(F.col("before") + F.col("step") == F.col("w")).groupBy("source", "node_id").agg(F.min("parent").alias("parent"))
    return walks.select("source", "node_id").join(tight, ["source", "node_id"], "left")
