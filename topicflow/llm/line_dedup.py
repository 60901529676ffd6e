"""Line dedup on overlapping windows of three consecutive lines.

Each window is hashed to 128 bits where its text lies.  One aggregate on half of the hash
finds windows that may repeat, a bounded Bloom filter keeps the rest from shuffling again,
and an exact aggregate finds each repeated window's first occurrence (document id, then
line).  Later occurrences go: the lines they cover are merged per document.  Only texts
that lose lines are shuffled, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm import bloom
from topicflow.scratch import Scratch

WINDOW = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, at, w1, w2)``: every window of three lines with its hash; none in shorter texts."""
    lines = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(text_col, F.lit("")), "\n", -1).alias("l"))
    hashed = lines.filter(F.size("l") >= WINDOW).select(
        "id", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"))).alias("h")
    )
    part = lambda name, k: F.expr(f"transform(slice(h, {k + 1}, size(h) - {WINDOW - 1}), x -> x.{name})")
    columns = [part(name, k) for name in "ab" for k in range(WINDOW)]
    rows = hashed.select("id", F.posexplode(F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(columns)))).alias("at", "z"))
    return rows.select("id", "at", F.xxhash64("z.c0", "z.c1", "z.c2").alias("w1"), F.xxhash64("z.c3", "z.c4", "z.c5").alias("w2"))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``(id, at)``: windows of which an equal one stands earlier, in a smaller id or above in the same text."""
    windows = scratch.save(_windows(docs, id_col, text_col), "windows")
    twice = scratch.save(windows.groupBy("w1").count().filter("count > 1").select("w1"), "twice")
    bits = bloom.filter_bits(twice.count())
    pages = scratch.save(bloom.build(twice, "w1", bits), "pages")
    maybe = bloom.probe(windows, F.col("w1"), pages, bits, "hit").filter("hit").drop("hit")
    order = F.struct("id", "at")
    first = maybe.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1").drop("n")
    later = scratch.save(maybe.join(first, ["w1", "w2"]).filter(order > F.col("first")).select("id", "at"), "later")
    scratch.forget(windows, twice)
    return later


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with the text's repeated lines removed, and two counts of lines added.

    Lines end at ``\\n`` and are compared as they are, blank ones too.  A text of fewer than
    three lines (null and empty ones included) has no window and stays as it is; null stays null.
    Ids must be unique and not null; a null id takes part as an id smaller than all others,
    but its text stays unchanged.  Every other column is carried along.  ``n_lines`` and
    ``n_removed`` name the count columns, should ``docs`` have columns of these names.
    """
    clash = {n_lines, n_removed} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; name the counts otherwise")
    scratch = Scratch(docs.sparkSession, "lines")
    later = repeated_windows(docs, id_col, text_col, scratch)
    known, starts, hit, split, gone, kept = bloom.free_names(docs, "of", "starts", "hit", "split", "gone", "kept")
    cut = later.filter("id is not null").groupBy(F.col("id").alias(known)).agg(F.collect_set("at").alias(starts))
    cut = scratch.save(cut, "cut")
    bits = bloom.filter_bits(cut.count())
    pages = scratch.save(bloom.build(cut.select(F.xxhash64(known).alias("k")), "k", bits), "cut-pages")
    looked = bloom.probe(docs, F.xxhash64(id_col), pages, bits, hit)
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)
    same = looked.filter(~F.col(hit)).select(
        *docs.columns, F.size(lines).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_removed)
    )
    joined = looked.filter(F.col(hit)).join(cut, F.col(id_col) == F.col(known), "left").withColumn(split, lines)
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (WINDOW - 1)))))
    marked = joined.withColumn(gone, F.coalesce(covered, F.array().cast("array<int>"))).withColumn(
        kept,
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone)), lambda i: F.get(split, i)),
    )
    text = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    changed = marked.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.size(split).cast("long").alias(n_lines),
        F.size(gone).cast("long").alias(n_removed),
    )
    return same.unionByName(changed)
