"""Reading ordered corpora, cleaning mail text, writing the result row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.functions.text import QUOTE_PATTERN, RULE_LINE_PATTERN
from topicflow.scratch import Scratch, broadcast_checked


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_col: str | None = "doc_id",
    text_col: str | None = None,
    keep: Sequence[str] = (),
    scratch: Scratch | None = None,
    **options,
) -> DataFrame:
    """Any Spark source as ``(doc_id, text, *keep)``; only those columns are read.

    ``id_col=None`` is for a corpus whose order is that of its files: ``doc_id`` then is the row's position (see
    ``in_file_order``).  The text column is ``text``, or ``value`` for ``fmt="text"``, which gives one document per
    line, or per file with ``wholetext``.
    """
    text_col = text_col or ("value" if fmt == "text" else "text")
    df = spark.read.format(fmt).options(**options).load(path)
    missing = {text_col, *keep, *([id_col] if id_col else [])} - set(df.columns)
    if missing:
        raise ValueError(f"columns not in {path}: {sorted(missing)}")
    extra = [c for c in keep if c not in (id_col, text_col)]
    if id_col is None:
        if "doc_id" in extra:
            raise ValueError("doc_id names the position; leave it out of the columns to keep")
        df, id_col = in_file_order(df, [text_col, *extra], "doc_id", scratch), "doc_id"
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra
    )


def in_file_order(df: DataFrame, columns: Sequence[str], pos: str = "pos", scratch: Scratch | None = None) -> DataFrame:
    """``columns`` of a file source plus ``pos``: 0-based, files by path, rows as they stand in their file.

    Formats that number their rows (Parquet) are counted by that number alone, and the place of a file is added where
    its rows are read: the columns are neither shuffled nor written.  Other formats are read once into a saved
    table, since a row's place in its split is known while it is read only.  One row per file or split is sorted.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "file-order")
    meta = df.metadataColumn("_metadata")
    numbered = "row_index" in df.select(meta.alias("m")).schema["m"].dataType.fieldNames()
    if numbered:
        rows = df.select(*columns, meta["file_path"].alias("_part"), meta["row_index"].alias("_at"))
        part, first = ["_part"], F.lit(0).cast("long")
    else:
        rows = df.select(
            *columns, meta["file_path"].alias("_part"), meta["file_block_start"].alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
        )
        # a split is read by one task from its first row to its last, so its numbers are consecutive
        rows = scratch.save(rows, "rows")
        part, first = ["_part", "_block"], F.min("_at")
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    sizes = scratch.save(sizes, "sizes")
    before = F.sum("_n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1))
    offset = (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset")
    places = scratch.save(sizes.select(*part, offset), "places")
    placed = rows.join(broadcast_checked(places), part)
    return placed.select(*columns, (F.col("_at") + F.col("_offset")).alias(pos))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_header(text: Column) -> Column:
    """Keep what follows the first blank line; nothing if there is none."""
    cut = F.instr(text, "\n\n")
    return F.when(cut > 0, F.substr(text, cut + 2)).otherwise(F.lit(""))


def strip_footer(text: Column) -> Column:
    """Drop the last line that is blank or only dashes, and all after it."""
    lines = F.split(_strip(text), "\n")
    flags = F.transform(lines, lambda line: line.rlike(RULE_LINE_PATTERN))
    from_end = F.array_position(F.reverse(flags), F.lit(True))
    cut = F.size(lines) - from_end
    return F.when(
        (from_end > 0) & (cut > 0), F.array_join(F.slice(lines, 1, cut.cast("int")), "\n")
    ).otherwise(text)


def strip_quotes(text: Column) -> Column:
    """Drop quoted lines and the lines that announce them."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(QUOTE_PATTERN))
    return F.array_join(kept, "\n")


def strip_mail(df: DataFrame, parts: Sequence[str] = ("headers", "footers", "quotes")) -> DataFrame:
    """Remove the named parts of mail-like text, always in the order header, footer, quotes.

    Each step is its own projection, so a long text is not re-split by the next one.
    """
    unknown = set(parts) - {"headers", "footers", "quotes"}
    if unknown:
        raise ValueError(f"unknown mail parts: {sorted(unknown)}")
    steps = {"headers": strip_header, "footers": strip_footer, "quotes": strip_quotes}
    for part, step in steps.items():
        if part in parts:
            df = df.withColumn("text", step(F.col("text")))
    return df


def write_result_csv(row: DataFrame, path: str) -> None:
    """Header plus the one summary row, in the row's column order.  A folder that exists is an error, never replaced."""
    row.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
