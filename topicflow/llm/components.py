"""Connected components of an edge table by the large-star and small-star rounds.

Each round is two aggregates over the edges and a written table, so lineage stays short
and a lost executor costs one re-read.  No component is ever gathered in one task: a
node's list of neighbours is only reduced to its smallest member, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on ``(a, b)``, a > b."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = sides.join(least, "u")
    if large:
        moved = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)``: every node of ``edges(a, b)`` with the smallest node it reaches."""
    now = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    while True:
        new = scratch.save(_star(_star(now, True), False), "stars")
        # done when every node points straight at a node that points nowhere
        last = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        done = not last.take(1)
        scratch.forget(now)
        now = new
        if done:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return scratch.save(
        roots.select(F.col("a").alias("node"), "component").union(
            now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        ),
        "components",
    )
