"""Cutting an ordered corpus into consecutive time slices.

Slicing by position only needs the few documents on the slice borders.  They are
found on the order keys alone; the text is then assigned by comparing keys, so it
is never sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.scratch import Scratch, broadcast_checked


def _ranges(df: DataFrame, order_cols: Sequence[str], scratch: Scratch) -> tuple[DataFrame, list]:
    """``df`` range-partitioned on ``order_cols`` and written with its range number,
    and the row count per range.  Written first: sampling may place the bounds
    elsewhere in a second evaluation."""
    ranged = df.repartitionByRange(*order_cols).withColumn("_range", F.spark_partition_id())
    saved = scratch.save(ranged, "ranges")
    counts = saved.groupBy("_range").count().orderBy("_range").collect()
    return saved, counts


def check_unique(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise ``ValueError`` unless ``columns`` name each row: no NULL, no repeat.  Only these columns are shuffled."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    bad = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | missing)
    found = bad.take(1)
    if found:
        raise ValueError(f"{tuple(columns)} must be unique and not NULL; found {found[0].asDict()}")


def rows_at(
    df: DataFrame, order_cols: Sequence[str], fractions=None, positions=None, scratch: Scratch | None = None
) -> tuple[int, list[Row]]:
    """Row count, and the order keys at given 0-based positions of the sorted table.

    ``fractions`` is a function of the row count that returns the positions.  The
    order must be total.  Only the ranges that hold a wanted position are sorted.
    """
    scratch = scratch or Scratch(df.sparkSession, "order")
    saved, counts = _ranges(df.select(*order_cols), order_cols, scratch)
    total = sum(r["count"] for r in counts)
    wanted = sorted(set(positions if fractions is None else fractions(total)))
    if not wanted:
        return total, []
    if wanted[0] < 0 or wanted[-1] >= total:
        raise ValueError(f"position outside 0..{total - 1}")
    local, start = [], 0
    for r in counts:
        local += [(r["_range"], p - start) for p in wanted if start <= p < start + r["count"]]
        start += r["count"]
    ranges = sorted({r for r, _ in local})
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols)) - 1
    hit = F.struct("_range", "_rank").isin([F.struct(F.lit(r), F.lit(p)) for r, p in local])
    found = (
        saved.filter(F.col("_range").isin(ranges))
        .withColumn("_rank", rank)
        .filter(hit)
        .orderBy(*order_cols)
        .select(*order_cols)
        .collect()
    )
    return total, found


def with_position(df: DataFrame, order_cols: Sequence[str], scratch: Scratch | None = None) -> DataFrame:
    """Add ``pos``, the 0-based global position: ranges, counts per range, offsets.

    There is no single-partition window; each range numbers its own rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "position")
    saved, counts = _ranges(df, order_cols, scratch)
    offsets, start = [], 0
    for r in counts:
        offsets.append((r["_range"], start))
        start += r["count"]
    table = df.sparkSession.createDataFrame(offsets, "_range int, _offset long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols)) - 1
    # one row per range, so the broadcast is bounded by the partition count
    return (
        saved.withColumn("_rank", rank)
        .join(F.broadcast(table), "_range")
        .withColumn("pos", F.col("_rank") + F.col("_offset"))
        .drop("_range", "_rank", "_offset")
    )


# borders compared one by one in generated code; more are searched in an array
CHAINED_BORDERS = 64


def _slice_number(order_cols: Sequence[str], types: dict, cuts: list[Row]) -> Column:
    """How many borders are at or before the row's key, in lexicographic order (NULLs first)."""
    key = F.struct(*[F.col(c) for c in order_cols])
    bounds = [F.struct(*[F.lit(cut[c]).cast(types[c]).alias(c) for c in order_cols]) for cut in cuts]
    if len(bounds) > CHAINED_BORDERS:
        return F.size(F.filter(F.array(*bounds), lambda bound: key >= bound))
    number = F.lit(0)
    for i, bound in enumerate(bounds, start=1):
        number = F.when(key >= bound, F.lit(i)).otherwise(number)
    return number


def slice_by_position(
    df: DataFrame,
    n_slices: int,
    order_cols: Sequence[str] = ("doc_id",),
    tie_break: str = "doc_id",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add ``slice_id``: ``n_slices`` runs of ``N div n_slices`` rows, the last takes the rest.

    ``tie_break`` must be unique and not NULL, or borders could not be told from their neighbours.
    """
    if n_slices < 1:
        raise ValueError(f"n_slices={n_slices}: at least 1 slice is needed")
    order = list(order_cols) + ([tie_break] if tie_break not in order_cols else [])
    if n_slices == 1:
        if not df.take(1):
            raise ValueError("0 documents cannot fill 1 slice")
        return df.withColumn("slice_id", F.lit(0))

    check_unique(df, [tie_break])

    def borders(total: int) -> list[int]:
        if total < n_slices:
            raise ValueError(f"{total} documents cannot fill {n_slices} slices")
        return [i * (total // n_slices) for i in range(1, n_slices)]

    _, cuts = rows_at(df, order, fractions=borders, scratch=scratch)
    types = {c: df.schema[c].dataType for c in order}
    return df.withColumn("slice_id", _slice_number(order, types, cuts).cast("int"))


def slice_by_time(
    df: DataFrame, ts_col: str, width: str, scratch: Scratch | None = None
) -> DataFrame:
    """Add ``slice_id``: the rank of the row's tumbling time window among non-empty windows.

    Distinct windows, one row each, are numbered range by range, never in one task; saved, their counted number
    decides on the broadcast.  Documents are not shuffled for it.  Rows without a time are in no window: an error.
    """
    scratch = scratch or Scratch(df.sparkSession, "windows")
    start = F.window(ts_col, width)["start"]
    if df.filter(F.col(ts_col).isNull()).take(1):
        raise ValueError(f"{ts_col} is NULL in some rows, which belong to no slice")
    spans = df.select(start.alias("_w")).distinct()
    numbered = with_position(spans, ["_w"], scratch)
    ranked = scratch.save(numbered.select("_w", F.col("pos").cast("int").alias("slice_id")), "windows")
    return df.withColumn("_w", start).join(broadcast_checked(ranked), "_w").drop("_w")


def slice_sizes(sliced: DataFrame) -> DataFrame:
    """``(slice_id, n_docs)`` from the corpus, so that documents without terms count."""
    return sliced.groupBy("slice_id").agg(F.count(F.lit(1)).alias("n_docs"))
