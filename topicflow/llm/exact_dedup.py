"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass one hashes each text and notes which bits of a filter are hit by two rows or more
(bits are counted by partial sums; texts do not move).  Pass two looks both bits of every
row up in the bitmaps, which are broadcast and of bounded size: rows with a bit hit once
are certainly unique and pass straight through, and only the others shuffle, to an exact
aggregate on the full SHA-256 and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.llm import bloom
from topicflow.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bloom.MAX_BITS
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Of equal normalised texts the row with the largest id stays.  Null text equals empty text.
    A null id is smaller than any other; rows that repeat an id and a text are each returned
    and share ``kept``.  Other columns are not read, so their names cannot clash.  An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    hashed = scratch.save(
        docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")), "hashes"
    )
    bits = bloom.filter_bits(hashed.count(), max_bits)
    first, second = (F.conv(F.substring("sha", start, 15), 16, 10).cast("long") for start in (1, 17))
    hits = hashed.select(F.explode(F.array(first, second)).alias("key")).select(
        F.col("key").bitwiseAND(F.lit(bits - 1)).alias("at")
    )
    repeated = hits.groupBy("at").count().filter("count > 1")
    pages = scratch.save(bloom.build(repeated, "at", bits), "pages")
    looked = bloom.probe(bloom.probe(hashed, first, pages, bits, "hit1"), second, pages, bits, "hit2")
    maybe = looked.filter("hit1 and hit2").select("id", "sha")
    single = looked.filter("not (hit1 and hit2)").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    groups = maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    judged = maybe.join(groups, "sha").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"
    )
    return single.unionByName(judged).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )
