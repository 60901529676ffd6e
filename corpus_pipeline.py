"""From raw documents to packed training sequences: four filters and a packer, stage by stage.

Texts stay where they are read; only those that a stage changes, and ids, are shuffled.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm import bloom
from topicflow.llm.language_id import fit_languages, predict_languages
from topicflow.llm.line_dedup import dedup_lines
from topicflow.llm.near_dedup import near_duplicates
from topicflow.llm.packing import pack
from topicflow.llm.substring_dedup import shortened
from topicflow.scratch import Scratch
from topicflow.session import ship_package

#: Lead in weighted loss under which the language is ambiguous and the document goes; small, so that short clean texts stay.
AMBIGUOUS = 0.005


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def _apart(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents certainly not among ``ids(doc_id)``, and the others.  The filter is bounded, and broadcast."""
    bits = bloom.filter_bits(ids.count())
    pages = scratch.save(bloom.build(ids.select(F.xxhash64("doc_id").alias("k")), "k", bits), "ids")
    looked = bloom.probe(docs, F.xxhash64("doc_id"), pages, bits, "__hit")
    return looked.filter("not __hit").drop("__hit"), looked.filter("__hit").drop("__hit")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or whose language is ambiguous.  Two thirds of the ids may be learned from."""
    ship_package(spark)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0))
    model = fit_languages(docs.filter(fold != 1), "doc_id", "text", "lang")
    judged = predict_languages(docs, model, out=("__lang", "__score", "__unsure"), margin=AMBIGUOUS)
    return judged.filter("__lang <> 'und' and not __unsure").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document of which no line is left goes too."""
    ship_package(spark)
    done = dedup_lines(docs, n_lines="__n", n_removed="__gone").filter("__gone = 0 or __gone < __n")
    return _with_text(done, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on five-word shingles of similarity 0.8 stays, the smallest id."""
    ship_package(spark)
    scratch = Scratch(spark, "near-stage")
    gone = scratch.save(near_duplicates(docs, shingle=5, percent=80).filter("not kept").select("doc_id"), "gone")
    rest, maybe = _apart(docs, gone, scratch)
    return rest.union(maybe.join(gone, "doc_id", "left_anti").select(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows of an earlier document go; a document of which no word is left goes too.

    A text that loses nothing keeps its white space; in others the words are joined by one space.
    """
    ship_package(spark)
    scratch = Scratch(spark, "substring-stage")
    cut = scratch.save(shortened(docs).select("doc_id", "n_words", "n_removed", "kept_text"), "cut")
    rest, maybe = _apart(docs, cut.select("doc_id"), scratch)
    joined = maybe.join(cut, "doc_id", "left").filter("n_removed is null or n_removed < n_words")
    text = F.coalesce("kept_text", "text")
    changed = joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))
    return rest.union(_with_text(changed, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row per piece."""
    ship_package(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Language ID, tokens and hashes cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.forget(*before)
        before = [docs]
    return docs
