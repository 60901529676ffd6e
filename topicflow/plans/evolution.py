"""The whole experiment: corpus -> slices -> topics -> tracks -> one row of metrics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.functions.text import ENGLISH_STOP_WORDS
from topicflow.operators import alignment, lda, metrics, slicing, topics, vocabulary
from topicflow.scratch import Scratch
from topicflow.sources.corpus import write_result_csv


@dataclass(frozen=True)
class Config:
    n_slices: int = 5
    n_topics: int = 10
    max_features: int = 2000
    max_iter: int = 50
    random_state: int = 0
    top_n: int = 10
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS
    order_cols: Sequence[str] = ("doc_id",)
    # slices by tumbling time windows of this column in place of ``n_slices`` runs of rows
    time_col: str | None = None
    time_width: str = "30 days"

    def check(self) -> None:
        if self.n_slices < 1:
            raise ValueError(f"n_slices={self.n_slices}: at least 1 slice is needed")
        for name in ("n_topics", "max_features", "max_iter", "top_n"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


@dataclass
class Evolution:
    """Saved tables of one run and its result row."""

    vocab: DataFrame
    packed: DataFrame
    model: lda.LdaModel
    topic_word: DataFrame
    top_words: DataFrame
    tracks: DataFrame
    aligned: DataFrame
    slice_metrics: DataFrame
    drift: DataFrame
    alignment: DataFrame
    result: DataFrame
    scratch: Scratch

    def close(self) -> None:
        """Delete the run's intermediate tables; collect or write what you need first."""
        self.scratch.drop()


def run(spark: SparkSession, corpus: DataFrame, cfg: Config = Config(), output_csv: str | None = None) -> Evolution:
    """Run on ``corpus(doc_id, text, ...order or time columns)``.

    The text is read and tokenised once, and never shuffled; everything after works on
    saved term counts.
    """
    cfg.check()
    scratch = Scratch(spark, "run")
    ordered = [cfg.time_col] if cfg.time_col else cfg.order_cols
    keep = [c for c in ("doc_id", "text", *ordered) if c in corpus.columns]
    corpus = corpus.select(*dict.fromkeys(keep))
    corpus = scratch.save(vocabulary.count_documents(corpus), "counted")
    vocab = scratch.save(vocabulary.fit_vocabulary(corpus, cfg.max_features, cfg.stop_words), "vocab")
    n_terms = vocabulary.check_vocabulary(vocab)
    if cfg.top_n > n_terms:
        raise ValueError(f"top_n={cfg.top_n} exceeds the vocabulary of {n_terms} terms")
    if cfg.time_col:
        sliced = slicing.slice_by_time(corpus, cfg.time_col, cfg.time_width, scratch)
    else:
        sliced = slicing.slice_by_position(corpus, cfg.n_slices, cfg.order_cols, scratch=scratch)
    packed = scratch.save(
        vocabulary.pack_documents(sliced.select("doc_id", "slice_id", "counted"), vocab, n_terms), "packed"
    )
    scratch.forget(corpus)
    sizes = scratch.save(slicing.slice_sizes(packed), "sizes")
    if cfg.time_col:
        cfg = replace(cfg, n_slices=sizes.count())

    model = lda.fit_lda(
        packed, n_terms, cfg.n_topics, cfg.max_iter, cfg.random_state, cfg.n_slices, scratch
    )
    topic_word = scratch.save(topics.normalise_rows(model.long()), "topic-word")
    top = scratch.save(topics.top_words(topic_word, cfg.top_n), "top")

    cosine = scratch.save(alignment.topic_cosine(topic_word), "cosine")
    match = alignment.topic_assignment(alignment.topic_cost(cosine))
    first = topic_word.filter("slice_id = 0").select("topic_id").distinct()
    tracks = scratch.save(alignment.topic_tracks(match, first, scratch), "tracks")
    aligned = scratch.save(alignment.aligned_topic_word(topic_word, tracks), "aligned")

    patterns = scratch.save(metrics.top_word_patterns(packed, top), "patterns")
    slice_metrics = scratch.save(
        metrics.topic_coherence(metrics.npmi(top, patterns, sizes), sizes)
        .join(metrics.topic_diversity(top), "slice_id")
        .join(lda.perplexity(packed, model), "slice_id"),
        "slice-metrics",
    )
    drift = scratch.save(metrics.topic_drift(aligned), "drift")
    best = scratch.save(metrics.topic_alignment(cosine), "alignment")
    result = scratch.save(summarise(spark, cfg, slice_metrics, drift, best), "result")
    if output_csv:
        write_result_csv(result, output_csv)
    return Evolution(
        vocab, packed, model, topic_word, top, tracks, aligned, slice_metrics, drift, best, result, scratch
    )


def summarise(spark, cfg: Config, slice_metrics: DataFrame, drift: DataFrame, best: DataFrame) -> DataFrame:
    """The result row: three parameters and five averages (alignment is NULL for one slice)."""
    means = slice_metrics.agg(
        F.avg("coherence").alias("avg_coherence"),
        F.avg("diversity").alias("avg_diversity"),
        F.avg("perplexity").alias("avg_perplexity"),
    )
    smooth = metrics.evolution_smoothness(drift).scalar()
    return means.select(
        F.lit(cfg.n_slices).alias("n_slices"),
        F.lit(cfg.n_topics).alias("n_topics"),
        F.lit(cfg.max_features).alias("max_features"),
        "avg_coherence",
        "avg_diversity",
        smooth.alias("evolution_smoothness"),
        best.agg(F.avg("alignment")).scalar().alias("avg_alignment"),
        "avg_perplexity",
    )


def report(result: DataFrame) -> DataFrame:
    """The result row as text for a log: four decimals, two for perplexity."""
    shown = {
        "Average Topic Coherence (TC)": ("avg_coherence", 4),
        "Average Topic Diversity (TD)": ("avg_diversity", 4),
        "Evolution Smoothness (ES)": ("evolution_smoothness", 4),
        "Average Topic Alignment (TA)": ("avg_alignment", 4),
        "Average Perplexity (PPL)": ("avg_perplexity", 2),
    }
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.format_number(column, digits).alias("value"))
            for name, (column, digits) in shown.items()
        ]
    )
    return result.select(F.inline(lines))
