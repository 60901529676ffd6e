"""Matching the topics of consecutive slices and chaining the matches into tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.functions.assignment import assign, auction
from topicflow.scratch import Scratch, broadcast_checked

TINY = 1e-16
#: Largest cost matrix that one task solves whole: 2,000 topics on either side, 32 MB.
DENSE_CELLS = 4_000_000
MATCH = "slice_id int, src_topic int, tgt_topic int"


def topic_cosine(topic_word: DataFrame) -> DataFrame:
    """``(slice_id, src_topic, tgt_topic, similarity)`` of every topic of slice t with
    every topic of slice t+1.

    A sparse product: cells meet on (slice pair, term) and are summed map-side to
    at most K x K values per task.  Pairs without a common term get 0.
    """
    a = topic_word.select(
        (F.col("slice_id") + 1).alias("next"), F.col("topic_id").alias("src_topic"), "term_id", "p"
    )
    b = topic_word.select(
        F.col("slice_id").alias("next"),
        F.col("topic_id").alias("tgt_topic"),
        "term_id",
        F.col("p").alias("q"),
    )
    dots = (
        a.join(b, ["next", "term_id"])
        .groupBy("next", "src_topic", "tgt_topic")
        .agg(F.sum(F.col("p") * F.col("q")).alias("dot"))
    )
    norms = topic_word.groupBy("slice_id", "topic_id").agg(
        (F.sqrt(F.sum(F.col("p") * F.col("p"))) + TINY).alias("norm")
    )
    src = norms.select(
        (F.col("slice_id") + 1).alias("next"),
        F.col("topic_id").alias("src_topic"),
        F.col("norm").alias("src_norm"),
    )
    tgt = norms.select(
        F.col("slice_id").alias("next"),
        F.col("topic_id").alias("tgt_topic"),
        F.col("norm").alias("tgt_norm"),
    )
    grid = src.join(tgt, "next").join(dots, ["next", "src_topic", "tgt_topic"], "left")
    similarity = F.coalesce("dot", F.lit(0.0)) / (F.col("src_norm") * F.col("tgt_norm"))
    return grid.select(
        (F.col("next") - 1).alias("slice_id"), "src_topic", "tgt_topic", similarity.alias("similarity")
    )


def topic_cost(cosine: DataFrame) -> DataFrame:
    return cosine.select(
        "slice_id", "src_topic", "tgt_topic", (1.0 - F.col("similarity")).alias("cost")
    )


def topic_assignment(cost: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Cheapest one-to-one match per slice pair: ``(slice_id, src_topic, tgt_topic)``.

    Slice pairs are independent and run in parallel, one task per matrix of at most ``DENSE_CELLS`` cells; larger ones
    stay in long form (``large_assignment``).
    """
    scratch = scratch or Scratch(cost.sparkSession, "assignment")
    cost = scratch.save(cost.select("slice_id", "src_topic", "tgt_topic", "cost"), "cost")
    sizes = scratch.save(cost.groupBy("slice_id").agg((F.count(F.lit(1)) > DENSE_CELLS).alias("large")), "sizes")
    if not sizes.filter("large").take(1):
        return _dense_assignment(cost)
    marked = cost.join(broadcast_checked(sizes), "slice_id")
    small = _dense_assignment(marked.filter("not large").drop("large"))
    return small.unionByName(large_assignment(marked.filter("large").drop("large"), scratch))


def _dense_assignment(cost: DataFrame) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="src_topic", columns="tgt_topic", values="cost")
        chosen = assign(grid.to_numpy(dtype=np.float64))
        return pd.DataFrame(
            {
                "slice_id": pdf["slice_id"].iloc[0],
                "src_topic": grid.index.to_numpy(),
                "tgt_topic": grid.columns.to_numpy()[chosen],
            }
        )

    return cost.groupBy("slice_id").applyInPandas(solve, MATCH)


def _solve_known(known: pd.DataFrame) -> pd.DataFrame:
    """An auction over the cells known so far: each source's target, what it pays with the target's price, and the price."""
    sources, at = np.unique(known["src_topic"], return_inverse=True)
    targets, to = np.unique(known["tgt_topic"], return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, to, c = at[order], to[order], known["cost"].to_numpy()[order] - known["low"].iloc[0]
    first = np.searchsorted(at, np.arange(sources.size + 1))
    cost = np.full((sources.size, int(np.diff(first).max())), np.inf)
    target = np.zeros(cost.shape, np.int64)
    place = np.arange(at.size) - first[at]
    cost[at, place], target[at, place] = c, to
    chosen, price = auction(cost, target, targets.size, float(known["least"].iloc[0]))
    mine = np.where(target == chosen[:, None], cost, np.inf).min(axis=1)
    return pd.DataFrame(
        {
            "slice_id": known["slice_id"].iloc[0],
            "src_topic": sources,
            "tgt_topic": targets[chosen],
            "paid": mine + price[chosen],
            "price": price[chosen],
        }
    )


def large_assignment(cost: DataFrame, scratch: Scratch, first: int = 16, more: int = 8) -> DataFrame:
    """Matches of square matrices too large for a task, from long rows.

    A task only ever holds the few cheapest cells of every source and target, and one match by rank, so that a
    complete match is among them.  An auction over them gives matches and prices, and one distributed pass holds these
    against all cells: a cell that is cheaper, with its target's price, than what its source pays joins the
    known ones, the cheapest ``more`` of a source each round.  When there is none, the match is the cheapest of the
    whole matrix (to 10^-9 of the range of its costs).  ``cost`` should be a saved table.
    """
    shape = cost.groupBy("slice_id").agg(
        F.min("cost").alias("low"), (F.max("cost") - F.min("cost")).alias("span"),
        F.count_distinct("src_topic").alias("n"), F.count_distinct("tgt_topic").alias("m"), F.count(F.lit(1)).alias("cells"),
    )
    shape = scratch.save(shape, "shape")
    if shape.filter("n <> m or cells <> n * m").take(1):
        raise ValueError("a large assignment needs as many targets as sources, and the cost of every pair")

    def nth(key: str, *order: str) -> Column:
        return F.row_number().over(Window.partitionBy("slice_id", key).orderBy(*order))

    by_source = cost.withColumn("nth", nth("src_topic", "cost", "tgt_topic")).filter(F.col("nth") <= first)
    by_target = cost.withColumn("nth", nth("tgt_topic", "cost", "src_topic")).filter(F.col("nth") <= more)
    # one row per topic
    ranks = [
        cost.select("slice_id", c).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("slice_id").orderBy(c)))
        for c in ("src_topic", "tgt_topic")
    ]
    by_rank = cost.join(broadcast_checked(scratch.save(ranks[0].join(ranks[1], ["slice_id", "nth"]), "ranks")), ["slice_id", "src_topic", "tgt_topic"])
    columns = ["slice_id", "src_topic", "tgt_topic", "cost"]
    known = scratch.save(by_source.unionByName(by_target).select(columns).unionByName(by_rank.select(columns)).distinct(), "known")
    # the auction's last step, and how much cheaper a cell must be to count
    step = F.greatest(F.col("span"), F.lit(1e-300)) * 1e-9 / F.col("n")
    limits = F.broadcast(shape.select("slice_id", "low", step.alias("least")))
    while True:
        found = known.join(limits, "slice_id").groupBy("slice_id").applyInPandas(_solve_known, f"{MATCH}, paid double, price double")
        found = scratch.save(found, "found")
        paid = broadcast_checked(found.select("slice_id", "src_topic", "paid"))
        price = broadcast_checked(found.select("slice_id", "tgt_topic", "price"))
        total = F.col("cost") - F.col("low") + F.col("price")
        cheaper = (
            cost.join(limits, "slice_id").join(paid, ["slice_id", "src_topic"]).join(price, ["slice_id", "tgt_topic"])
            .withColumn("total", total).filter(F.col("total") < F.col("paid") - 2 * F.col("least"))
            .join(known.select("slice_id", "src_topic", "tgt_topic"), ["slice_id", "src_topic", "tgt_topic"], "left_anti")
            .withColumn("nth", nth("src_topic", "total", "tgt_topic")).filter(F.col("nth") <= more)
        )
        new = scratch.save(cheaper.select(columns), "new")
        if not new.take(1):
            return found.select("slice_id", "src_topic", "tgt_topic")
        known = scratch.save(known.unionByName(new), "known")


def topic_tracks(match: DataFrame, first: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(slice_id, track_id, topic_id)``: which topic carries track k in each slice.

    Slice pairs were matched independently; their permutations are composed by
    doubling, log2(slices) equi-joins over slices x topics rows, instead of one
    slice after the other.  ``first`` holds the topics of slice 0.
    """
    scratch = scratch or Scratch(match.sparkSession, "tracks")
    hops = match.select(
        F.col("slice_id").alias("start"),
        (F.col("slice_id") + 1).alias("slice_id"),
        "src_topic",
        "tgt_topic",
    )
    hops = scratch.save(hops, "hops")
    while hops.filter(F.col("start") > 0).take(1):
        earlier = hops.select(
            F.col("start").alias("from"),
            F.col("slice_id").alias("start"),
            F.col("src_topic").alias("from_topic"),
            F.col("tgt_topic").alias("src_topic"),
        )
        joined = hops.join(earlier, ["start", "src_topic"]).select(
            F.col("from").alias("start"), "slice_id", F.col("from_topic").alias("src_topic"), "tgt_topic"
        )
        hops = scratch.save(hops.filter(F.col("start") == 0).unionByName(joined), "hops")
    start = first.select(F.lit(0).alias("slice_id"), F.col("topic_id").alias("track_id"), "topic_id")
    later = hops.select(
        "slice_id", F.col("src_topic").alias("track_id"), F.col("tgt_topic").alias("topic_id")
    )
    return start.unionByName(later)


def aligned_topic_word(topic_word: DataFrame, tracks: DataFrame) -> DataFrame:
    """Topics renumbered by track: ``(slice_id, track_id, term_id, p)``."""
    return topic_word.join(broadcast_checked(tracks), ["slice_id", "topic_id"]).select(
        "slice_id", "track_id", "term_id", "p"
    )


def assignment_log(tracks: DataFrame) -> DataFrame:
    """One row per slice: the topics in track order, as a run log shows them."""
    pairs = F.sort_array(F.collect_list(F.struct("track_id", "topic_id")))
    return tracks.groupBy("slice_id").agg(
        F.transform(pairs, lambda e: e["topic_id"]).alias("assignment")
    )
