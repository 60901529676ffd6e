"""Text expressions, all evaluated in the JVM.

Everything here works on one row at a time, so counting the words of a document
needs no shuffle: its tokens are sorted inside the row and run lengths are read
off the sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# A token is a run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Lines that introduce or carry quoted mail text.
QUOTE_PATTERN = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"

# A footer separator: a line that is blank or made of dashes only.
RULE_LINE_PATTERN = r"^\s*-*\s*$"

# Spark's own default English stop words (StopWordsRemover), frozen here so that
# plans and checks agree without a session.
ENGLISH_STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
    they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
    wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would""".split()
)
# ---------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def with_run_lengths(df: DataFrame, array_col: str, out: str, value: str) -> DataFrame:
    """Add ``out = array<struct<value, cnt>>``: the distinct values of ``array_col`` and their counts.

    Three projections, because an expression used inside a lambda is evaluated
    once per element unless it is already a column.
    """
    ordered, starts = F.col("_ordered"), F.col("_starts")

    def start(x: Column, i: Column) -> Column:
        return F.when((i == 0) | (x != F.get(ordered, i - 1)), i)

    def run(begin: Column, end: Column) -> Column:
        return F.struct(
            F.get(ordered, begin).alias(value), (end - begin).cast("long").alias("cnt")
        )

    # a run ends where the next one starts, the last at the end of the array
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ordered)))
    return (
        df.withColumn("_ordered", F.sort_array(array_col))
        .withColumn("_starts", F.filter(F.transform(ordered, start), lambda i: i.isNotNull()))
        .withColumn(out, F.when(F.size(ordered) > 0, F.zip_with(starts, ends, run)))
        .drop("_ordered", "_starts")
    )
