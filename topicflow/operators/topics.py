"""Topic-word tables ``(slice_id, topic_id, term_id, p)`` in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOPIC = ("slice_id", "topic_id")


def normalise_rows(weights: DataFrame, weight_col: str = "lam") -> DataFrame:
    """Weights per (slice, topic, term) -> probabilities that sum to 1 per topic."""
    # partial sums and a join by topic: the cells themselves are not shuffled for the totals
    total = weights.groupBy(*TOPIC).agg(F.sum(weight_col).alias("_total"))
    return weights.join(total, list(TOPIC)).select(*TOPIC, "term_id", (F.col(weight_col) / F.col("_total")).alias("p"))


def labelled_topics(packed: DataFrame, label: str) -> DataFrame:
    """Empirical topics of a labelled corpus: P(term | slice, label).

    ``topic_id`` must already be a column of ``packed`` named by ``label``.
    """
    cells = packed.select(
        "slice_id",
        F.col(label).alias("topic_id"),
        F.explode_outer(F.arrays_zip("terms", "cnts")).alias("e"),
    )
    counts = (
        cells.filter(F.col("e").isNotNull())
        .groupBy("slice_id", "topic_id", F.col("e.terms").alias("term_id"))
        .agg(F.sum("e.cnts").alias("lam"))
    )
    return normalise_rows(counts)


def top_words(topic_word: DataFrame, top_n: int = 10) -> DataFrame:
    """The ``top_n`` heaviest terms per topic with their rank; ties go to the larger term id."""
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    order = Window.partitionBy(*TOPIC).orderBy(F.desc("p"), F.desc("term_id"))
    ranked = topic_word.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top_n).select(*TOPIC, "rank", "term_id", "p")


def check_top_n(top: DataFrame, top_n: int) -> None:
    """Every topic must have ``top_n`` terms to rank."""
    short = top.groupBy(*TOPIC).count().filter(F.col("count") < top_n).take(1)
    if short:
        raise ValueError(f"top_n={top_n} exceeds the number of terms of a topic")
