"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.shared import Scratch, few


def mapped(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of ``labels(node, comp)`` in place of ``column``, where it has one."""
    labels = labels.select(F.col("node").alias(column), F.col("comp").alias("_to"))
    return rows.join(labels, column, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)


def components(edges: DataFrame, name: str = "components", scratch: Scratch | None = None, known: DataFrame | None = None) -> DataFrame:
    """``edges(a, b)`` of longs to ``node, comp``: comp is the smallest node it reaches.

    ``known`` is the result for other edges, from which it goes on. A round takes every node
    that is left to its smallest neighbour, if that is smaller, and from there to the end of
    that chain, three times as far a step; the edges that still join two nodes are those of
    the next round. All is stored in the shared folder, so lineage stays short and a lost
    executor costs one step. Two rounds at least halve the nodes that are left, steps grow
    with the logarithm of the longest chain. No edges: no rows but the known.
    """
    stored = (scratch or Scratch(edges.sparkSession, "components")).stored
    left, before, steps = edges.select("a", "b"), None if known is None else few(known), []
    while True:
        last = steps[-1] if steps else before
        if last is not None:
            left = mapped(mapped(left, "a", last), "b", last)
        left = stored(left.where("a <> b"), f"{name}-edges")
        if left.isEmpty():
            break
        both = left.union(left.select("b", "a"))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")), f"{name}-nearest")
        moved = True
        while moved:
            near = few(step)
            ahead = mapped(mapped(step, "comp", near).withColumn("next", F.col("comp")), "next", near)
            ahead = stored(ahead.select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), f"{name}-step")
            step, moved = ahead.select("node", "comp"), not ahead.where("moved").isEmpty()
        steps.append(few(step))
    if not steps:
        return known if known is not None else left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = steps[0].select("node", F.col("node").alias("comp"))
    if known is not None:
        labels = known.select("node", "comp").union(labels.join(before, "node", "left_anti"))
    for step in steps:
        labels = mapped(labels, "comp", step)
    return stored(labels, f"{name}-labels")
