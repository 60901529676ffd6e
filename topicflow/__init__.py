"""Topic evolution over time-ordered text corpora, on Spark DataFrames."""

from topicflow.plans.evolution import Config, Evolution, report, run

__all__ = ["Config", "Evolution", "report", "run"]
