"""Interaction graphs: undirected ``a, b, confidence`` edges.

Iterative operators store every round in the shared folder and stop when nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.plans.storage import stored


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions, self loops out, the best confidence of repeated edges."""
    both = edges.select("a", "b", "confidence").union(edges.select("b", "a", "confidence"))
    return both.where("a <> b").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))


def interactions(raw: DataFrame, protein: DataFrame, least: float = 0.7, limit: int = 100) -> DataFrame:
    """The other end of each edge of the proteins, score / 1000, best ``limit`` each.

    ``raw(from_id, to_id, score)``, ``protein(id)``.
    """
    both = raw.select(F.col("from_id").alias("id"), F.col("to_id").alias("partner"), (F.col("score") / 1000).alias("confidence")).union(raw.select("to_id", "from_id", F.col("score") / 1000))
    near = both.where((F.col("confidence") >= least) & (F.col("id") != F.col("partner"))).join(protein.select("id"), "id", "left_semi")
    best = near.groupBy("id", "partner").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("confidence"), "partner"))).where(F.col("rank") <= limit)


def confidence_bands(edges: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return edges.agg(F.count(F.lit(1)).alias("total"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """``source, node, depth``: hops from each of the ``seeds(source)``, up to ``depth``."""
    near = stored(symmetric(edges).select("a", "b"), "graph-edges")
    seen = frontier = stored(seeds.select("source", F.col("source").alias("node"), F.lit(0).alias("depth")).distinct(), "graph-bfs")
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        step = frontier.join(near, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        frontier = stored(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(hop)), "graph-bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def grow(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Nodes (least depth, seed flag) within ``depth`` of the seeds, and the edges among them."""
    kept = edges.where(F.col("confidence") >= least)
    nodes = bfs(kept, seeds, depth).groupBy("node").agg(F.min("depth").alias("depth")).withColumn("is_seed", F.col("depth") == 0)
    return nodes, induced(kept, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(node)``."""
    n = nodes.select(F.col("node").alias("a")).distinct()
    return edges.join(n, "a", "left_semi").join(n.withColumnRenamed("a", "b"), "b", "left_semi")


def subnetwork(edges: DataFrame, proteins: DataFrame, include_neighbours: bool = False) -> DataFrame:
    nodes = proteins.select(F.col("id").alias("node"))
    if include_neighbours:
        nodes = nodes.union(symmetric(edges).join(nodes, F.col("a") == F.col("node"), "left_semi").select("b")).distinct()
    return induced(edges, nodes)


def common_interactors(edges: DataFrame, proteins: DataFrame) -> DataFrame:
    """Nodes outside the list that touch two or more of its proteins."""
    wanted = proteins.select(F.col("id").alias("a")).distinct()
    near = symmetric(edges).join(wanted, "a", "left_semi").join(wanted.withColumnRenamed("a", "b"), "b", "left_anti")
    return near.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("a")).alias("proteins")).where("n > 1")


def bridges(edges: DataFrame, proteins: DataFrame) -> DataFrame:
    """Middle nodes of length-2 paths between listed proteins that are not adjacent."""
    both = symmetric(edges)
    wanted = proteins.select(F.col("id").alias("a")).distinct()
    near = both.join(wanted, "a", "left_semi").select("a", "b")
    pairs = near.select(F.col("a").alias("source"), F.col("b").alias("node")).join(near.select(F.col("a").alias("target"), F.col("b").alias("node")), "node").where("source < target")
    outside = pairs.join(wanted.withColumnRenamed("a", "node"), "node", "left_anti")
    return outside.join(both.select(F.col("a").alias("source"), F.col("b").alias("target")), ["source", "target"], "left_anti")


def shortest_paths(edges: DataFrame, pairs: DataFrame, weighted: bool = False, hops: int | None = None) -> DataFrame:
    """``source, target, cost, path`` of requested pairs; nothing for pairs without a path (of ``hops`` steps at most).

    The cost of a step is 1, or 1 - confidence + 0.001. Relaxation rounds carry a node's cost
    and the node before it, not its path. A source whose targets are all reached bounds its
    rounds by the dearest of them, and stops when no node is cheaper. Paths are then walked
    back from the targets alone. Of equal costs the smaller node before wins. ``hops`` goes
    with unweighted paths only, where a node's first cost is its last.
    """
    if weighted and hops is not None:
        raise ValueError("hops limits unweighted paths only")
    pairs = stored(pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "graph-pairs")
    near = symmetric(edges).select("a", "b", (F.lit(1.0) if not weighted else 1.001 - F.col("confidence")).alias("w"))
    near = stored(near, "graph-edges")
    nodes = near.select(F.col("a").alias("source")).distinct()
    begin = pairs.select("source").distinct().join(nodes, "source", "left_semi")
    best = frontier = stored(begin.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("previous")), "graph-paths")
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        reached = pairs.join(best.select("source", F.col("node").alias("target"), "cost"), ["source", "target"], "left")
        bounds = reached.groupBy("source").agg(F.when(F.count("cost") == F.count(F.lit(1)), F.max("cost")).alias("bound"))  # NULL: some target is not reached
        open_ = frontier.join(bounds, "source").where("bound IS NULL OR cost < bound").drop("bound")
        step = open_.join(near, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("previous"))
        merged = best.withColumn("_new", F.lit(False)).unionByName(step.withColumn("_new", F.lit(True)))
        least = merged.groupBy("source", "node").agg(F.min(F.struct("cost", "previous", "_new")).alias("m"), F.min(F.when(~F.col("_new"), F.col("cost"))).alias("_old"))
        moved = F.col("_old").isNull() | (F.col("m.cost") < F.col("_old"))  # a new node before it at the same cost moves nothing
        merged = stored(least.select("source", "node", "m.cost", "m.previous", moved.alias("_new")), "graph-paths")
        frontier, best = merged.where("_new").drop("_new"), merged.drop("_new")
        if frontier.isEmpty():
            break
    back = best.select("source", F.col("node").alias("at"), "previous")
    walks = pairs.join(best.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", "cost", F.array("target").alias("path"), F.col("target").alias("at"))
    done, walks = None, stored(walks, "graph-walks")
    while True:
        ended = walks.where("at = source").drop("at")
        done = ended if done is None else done.unionByName(ended)
        left = walks.where("at <> source").join(back, ["source", "at"])
        walks = stored(left.select("source", "target", "cost", F.concat(F.array("previous"), "path").alias("path"), F.col("previous").alias("at")), "graph-walks")
        if walks.isEmpty():
            return done


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node reaches."""
    near = stored(symmetric(edges).select("a", "b"), "graph-edges")
    labels = stored(near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "graph-labels")
    while True:
        best = near.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(best, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        new = step.join(jump, "component", "left").select("node", F.coalesce("_far", "component").alias("component"), "_old")
        labels = stored(new.withColumn("moved", F.col("component") != F.col("_old")).drop("_old"), "graph-labels")
        if labels.where("moved").isEmpty():
            return labels.drop("moved")


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles a < b < c, each once.

    Edges point from the end with fewer neighbours (ties by name), so that a hub has few
    edges out of it and makes few wedges.
    """
    both = symmetric(edges).select("a", "b")
    n = both.groupBy(F.col("a").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    sized = both.where("a < b").join(n.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    out = sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("q"))
    wedge = out.join(out.select("p", F.col("q").alias("r")), "p").where("q < r")
    closed = wedge.join(both.select(F.col("a").alias("q"), F.col("b").alias("r")), ["q", "r"])
    at = F.sort_array(F.array("p", "q", "r"))
    return closed.select(at[0].alias("a"), at[1].alias("b"), at[2].alias("c"))


def cliques(edges: DataFrame, k: int = 3) -> DataFrame:
    """All k-cliques as sorted arrays, with a flag for those that no node extends."""
    both = symmetric(edges).select("a", "b")
    found = both.where("a < b").select(F.array("a", "b").alias("members"))
    ends = both.where("a < b")
    for _ in range(k - 2):
        last = F.element_at("members", -1)
        longer = found.join(ends, last == F.col("a")).select("members", F.col("b").alias("_next"))
        for at in range(1, found_size(found)):
            edge = both.select(F.col("a").alias("_x"), F.col("b").alias("_y"))
            longer = longer.join(edge, (F.element_at("members", at) == F.col("_x")) & (F.col("_next") == F.col("_y")), "left_semi")
        found = longer.select(F.concat("members", F.array("_next")).alias("members")).withMetadata("members", {"size": found_size(found) + 1})
    reach = found.select("members", F.explode("members").alias("m")).join(both, F.col("m") == F.col("a")).groupBy("members", "b").count()
    extended = reach.where(F.col("count") == k).select("members").distinct()
    return found.join(extended.withColumn("_extended", F.lit(True)), "members", "left").select("members", F.col("_extended").isNull().alias("maximal"))


def found_size(found: DataFrame) -> int:
    return found.schema["members"].metadata.get("size", 2)


def _power(edges: DataFrame, damping: float | None, rounds: int, tolerance: float) -> DataFrame:
    near = stored(symmetric(edges).select("a", "b"), "graph-edges")
    degree = stored(near.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "graph-degree")
    n = degree.count()
    ranks = degree.select(F.col("a").alias("node"), F.lit(1.0 / n if n else 0.0).alias("rank"))
    for _ in range(rounds):
        if damping is None:  # eigenvector: sums, then length one; the own value keeps bipartite graphs from swinging
            sums = near.join(ranks, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("rank").alias("s"))
            new = ranks.join(sums, F.col("node") == F.col("a")).select("node", (F.col("s") + F.col("rank")).alias("x"), F.col("rank").alias("_old"))
            new = stored(new, "graph-ranks")
            length = (new.agg(F.sum(F.col("x") ** 2)).first()[0] or 1.0) ** 0.5
            new = new.select("node", (F.col("x") / length).alias("rank"), "_old")
        else:
            given = ranks.join(degree, F.col("node") == F.col("a")).select("node", (F.col("rank") / F.col("d")).alias("share"))
            sums = near.join(given, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("share").alias("s"))
            new = ranks.join(sums, F.col("node") == F.col("a")).select("node", (F.lit((1 - damping) / n) + damping * F.col("s")).alias("rank"), F.col("rank").alias("_old"))
        new = stored(new, "graph-ranks")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] or 0.0
        ranks = new.select("node", "rank")
        if moved < tolerance:
            break
    return ranks


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    return _power(edges, damping, rounds, tolerance)


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    return _power(edges, None, rounds, tolerance)


def distance_sums(edges: DataFrame, sources: DataFrame, words: int = 16, at_once: int = 16) -> DataFrame:
    """``source, total, reached``: the sum of hops from each of ``sources(source)`` to the nodes that it reaches, and their number with itself.

    Sources walk together, 64 * ``words`` in a batch: a node's row holds, as bits, which of
    a batch have come to it, and a round merges its neighbours' bits. ``at_once`` batches go
    in one walk, so that a round holds so many rows a node.
    """
    near = stored(symmetric(edges).select("a", "b"), "graph-edges")
    size, wanted = 64 * words, sources.select("source").where("source IS NOT NULL").distinct()
    buckets = F.lit(max(1, -(-wanted.count() // (size - size // 4))))  # so that few overflow into a batch of their own
    slot = F.row_number().over(W.partitionBy("bucket").orderBy("source")) - 1
    placed = wanted.withColumn("bucket", F.pmod(F.xxhash64("source"), buckets)).withColumn("slot", slot)
    placed = stored(placed.select("source", F.concat_ws("-", "bucket", F.floor(F.col("slot") / size)).alias("batch"), (F.col("slot") % size).alias("slot")), "sums-sources")
    walk = F.pmod(F.xxhash64("batch"), F.lit(max(1, -(-placed.select("batch").distinct().count() // at_once)))).alias("walk")
    placed = stored(placed.select("source", "batch", "slot", walk), "sums-sources")
    names = range(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            bits = np.unpackbits(np.column_stack([batch.column(f"n{i}").to_numpy() for i in names]).view(np.uint8), axis=1, bitorder="little")
            of = np.array(batch.column("batch").to_pylist(), object)
            for b in set(of):
                sums[b] = sums.get(b, 0) + bits[of == b].sum(axis=0, dtype=np.int64)
        for b, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["batch", "slot", "n"])

    parts = []
    for (turn,) in sorted(placed.select("walk").distinct().collect()):
        own = [F.when(F.floor(F.col("slot") / 64) == i, F.expr("shiftleft(1L, slot % 64)")).otherwise(F.lit(0)).cast("long") for i in names]
        begin = placed.where(F.col("walk") == turn).select("batch", F.col("source").alias("node"), *[w.alias(f"n{i}") for i, w in zip(names, own, strict=True)])
        begin = begin.groupBy("batch", "node").agg(*[F.bit_or(f"n{i}").alias(f"n{i}") for i in names])
        state, hop = stored(begin.select("*", *[F.col(f"n{i}").alias(f"s{i}") for i in names]), "sums-state"), 0
        while True:
            hop += 1
            frontier = state.where(" OR ".join(f"n{i} <> 0" for i in names)).select("batch", "node", *[f"n{i}" for i in names])
            step = frontier.join(near, F.col("node") == F.col("a")).groupBy("batch", F.col("b").alias("node")).agg(*[F.bit_or(f"n{i}").alias(f"w{i}") for i in names])
            new, seen = (lambda i: F.coalesce(f"w{i}", F.lit(0).cast("long"))), (lambda i: F.coalesce(f"s{i}", F.lit(0).cast("long")))
            both = state.select("batch", "node", *[f"s{i}" for i in names]).join(step, ["batch", "node"], "full")
            state = stored(both.select("batch", "node", *[new(i).bitwiseAND(F.bitwise_not(seen(i))).alias(f"n{i}") for i in names], *[seen(i).bitwiseOR(new(i)).alias(f"s{i}") for i in names]), "sums-state")
            found = state.where(" OR ".join(f"n{i} <> 0" for i in names)).select("batch", *[f"n{i}" for i in names]).mapInArrow(count, "batch string, slot int, n long")
            found = stored(found.groupBy("batch", "slot").agg(F.sum("n").alias("n")).withColumn("hop", F.lit(hop)), "sums-found")
            if found.isEmpty():
                break
            parts.append(found)
    if not parts:
        return placed.select("source", F.lit(0).cast("long").alias("total"), F.lit(1).cast("long").alias("reached"))
    sums = reduce(DataFrame.unionByName, parts).groupBy("batch", "slot").agg(F.sum(F.col("hop") * F.col("n")).alias("total"), (F.sum("n") + 1).alias("reached"))
    return placed.join(sums, ["batch", "slot"], "left").select("source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("reached", F.lit(1)).alias("reached"))


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Closeness of ``sources(source)`` in their component, scaled by its share of all nodes."""
    n = symmetric(edges).select("a").distinct().count()
    sums = distance_sums(edges, sources)
    near = F.col("reached") - 1
    return sums.select(F.col("source").alias("node"), F.when(F.col("total") > 0, near / F.col("total") * near / F.lit(max(1, n - 1))).otherwise(0.0).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Path counts through each node from the given sources, level by level and back.

    Exact (each pair counted in both directions, then halved) if all nodes are sources.
    """
    near = stored(symmetric(edges).select("a", "b"), "graph-edges")
    depth = stored(bfs(edges, sources), "graph-depth")
    levels = depth.agg(F.max("depth")).first()[0] or 0
    sigma = stored(depth.where("depth = 0").select("source", "node", F.lit(1.0).alias("sigma"), "depth"), "graph-sigma")
    all_sigma = sigma
    for level in range(1, levels + 1):
        step = sigma.join(near, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.sum("sigma").alias("sigma"))
        sigma = stored(step.join(depth.where(F.col("depth") == level), ["source", "node"]), "graph-sigma")
        all_sigma = all_sigma.unionByName(sigma)
    delta = all_sigma.where(F.col("depth") == levels).select("source", "node", "sigma", F.lit(0.0).alias("delta"))
    out = delta.select("source", "node", "delta")
    for level in range(levels - 1, -1, -1):
        share = delta.select("source", F.col("node").alias("_w"), ((1 + F.col("delta")) / F.col("sigma")).alias("share")).join(near, F.col("_w") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.sum("share").alias("share"))
        here = all_sigma.where(F.col("depth") == level).join(share, ["source", "node"], "left")
        delta = stored(here.select("source", "node", "sigma", F.coalesce(F.col("sigma") * F.col("share"), F.lit(0.0)).alias("delta")), "graph-delta")
        out = out.unionByName(delta.select("source", "node", "delta"))
    return out.where("source <> node").groupBy("node").agg((F.sum("delta") / 2).alias("betweenness"))


def key_proteins(edges: DataFrame, n: int = 10) -> DataFrame:
    """Top n nodes by each centrality; closeness and betweenness from all nodes."""
    nodes = symmetric(edges).select(F.col("a").alias("source")).distinct()
    parts = [degrees(edges).select("node", F.lit("degree").alias("metric"), F.col("degree").cast("double").alias("value"))]
    parts += [f(edges).select("node", F.lit(name).alias("metric"), F.col("rank").alias("value")) for name, f in (("pagerank", pagerank), ("eigenvector", eigenvector))]
    parts += [f(edges, nodes).select("node", F.lit(name).alias("metric"), F.col(name).alias("value")) for name, f in (("closeness", closeness), ("betweenness", betweenness))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("rank", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("value"), "node"))).where(F.col("rank") <= n)


def network_metrics(edges: DataFrame, paths: bool = True) -> DataFrame:
    """One row: size, density, components, clustering, degrees; path figures of the largest component."""
    both = stored(symmetric(edges), "graph-both")
    d = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    size = d.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("d") / 2).cast("long").alias("n_edges"), F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"), F.min("d").alias("min_degree"))
    comps = stored(components(edges), "graph-comps")
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"))
    corners = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("t"))
    local = d.join(corners, "a", "left").select(F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c"))
    out = size.crossJoin(parts).crossJoin(local.agg(F.avg("c").alias("clustering")))  # single rows
    out = out.withColumn("density", F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)).withColumn("largest_share", F.col("largest") / F.col("n_nodes"))
    if paths:
        largest = sizes.orderBy(F.desc("size"), "component").limit(1).select("component")
        members = comps.join(largest, "component", "left_semi").select(F.col("node").alias("source"))
        hops = bfs(edges, members).where("depth > 0").agg(F.avg("depth").alias("mean_path"), F.max("depth").alias("diameter"))
        out = out.crossJoin(hops)
    return out


def modules(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Modules by label spreading: each node takes the label of most weight around it, ties to the smaller."""
    near = stored(symmetric(edges), "graph-edges")
    labels = stored(near.groupBy(F.col("a").alias("node")).agg(F.min("a").alias("module")), "graph-modules")
    for turn in range(rounds):
        votes = near.join(labels.select(F.col("node").alias("b"), "module"), "b").groupBy(F.col("a").alias("node"), "module").agg(F.sum("confidence").alias("w"))
        best = votes.groupBy("node").agg(F.min_by("module", F.struct(-F.col("w"), F.col("module"))).alias("_best"))
        move = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0  # half of the nodes, another one each round, so that two don't swap for ever
        step = labels.join(best, "node").select("node", F.when(move, F.col("_best")).otherwise(F.col("module")).alias("module"), (F.col("_best") != F.col("module")).alias("unsettled"))
        step = stored(step, "graph-modules")
        labels = step.drop("unsettled")
        if step.where("unsettled").isEmpty():
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    near = symmetric(edges)
    total = near.agg(F.sum("confidence").alias("m2"))
    inside = near.join(labels.select(F.col("node").alias("a"), F.col("module").alias("ma")), "a").join(labels.select(F.col("node").alias("b"), F.col("module").alias("mb")), "b")
    within = inside.groupBy(F.col("ma").alias("module")).agg(F.sum(F.when(F.col("ma") == F.col("mb"), F.col("confidence")).otherwise(0.0)).alias("own"), F.sum("confidence").alias("all"))
    return within.crossJoin(F.broadcast(total)).agg(F.sum(F.col("own") / F.col("m2") - (F.col("all") / F.col("m2")) ** 2).alias("modularity"))


def spectral_clusters(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """Power-iteration clusters; node names are numbered for it and joined back."""
    from pyspark.ml.clustering import PowerIterationClustering

    near = symmetric(edges).where("a < b")
    names = stored(near.select("a").union(near.select("b")).distinct().select(F.col("a").alias("node"), F.xxhash64("a").alias("id")), "graph-names")
    numbered = near.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"), F.col("confidence").cast("double").alias("weight"))
    found = PowerIterationClustering(k=k, maxIter=rounds, weightCol="weight", initMode="degree").assignClusters(numbered)
    return found.join(names, "id").select("node", "cluster")
