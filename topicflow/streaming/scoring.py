"""Scoring new documents with a fitted vocabulary and model.

Packing and inference are stateless, row-wise stages, so the same function serves
batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from topicflow.operators.lda import LdaModel, infer_topics
from topicflow.operators.vocabulary import pack_documents


def score_documents(corpus: DataFrame, vocab: DataFrame, model: LdaModel) -> DataFrame:
    """``(slice_id, doc_id, topics)`` for ``corpus(slice_id, doc_id, text)``, batch or stream, whatever the size
    of the vocabulary and the model: both are shared with the tasks in tables of bounded size."""
    return infer_topics(pack_documents(corpus, vocab), model)
