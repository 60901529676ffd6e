"""Arrow batches of fewer rows while tables of long texts are written."""

from topicflow.batches import ROWS, small_batches

__all__ = ["ROWS", "small_batches"]
