"""The order of rows: a hidden column POS of unique numbers, dense from 0 where a frame is called dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POS = "__pos"
#: Rows of one block of positions; a task numbers one block at a time.
BLOCK = 1_000_000
#: Files up to which their offsets are sent to every task: about 20 MB.
SENT_FILES = 100_000


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POS]


def with_row_index(df: DataFrame) -> DataFrame:
    """df, as read from Parquet files, with dense positions in the order of file paths and of rows within files.

    Positions are the row numbers that the scan itself gives, so filters and columns still reach it. With several files a
    second scan reads their numbers of rows, from the footers alone.
    """
    files = df.inputFiles()
    if len(files) == 1:
        return df.withColumn(POS, F.col("_metadata.row_index"))
    counts = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"))
    offsets = F.broadcast(offsets) if len(files) <= SENT_FILES else offsets
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return at.join(offsets, "__file").withColumn(POS, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def with_scan_order(df: DataFrame) -> DataFrame:
    """df, as read from text files, with dense positions in the order of file paths and of rows within files.

    The first pass counts rows by file split, a table as long as the list of splits; no row is shuffled.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = at.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("__file", "__start", (before - F.col("__first")).alias("__shift"))
    return at.join(offsets, ["__file", "__start"]).withColumn(POS, F.col("__id") + F.col("__shift")).drop("__file", "__start", "__id", "__shift")


def numbered(ranges: DataFrame) -> DataFrame:
    """A written table with a column __id of monotonically increasing ids, with dense positions in its place."""
    part = F.shiftright("__id", 33)
    counts = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    within = F.col("__id").bitwiseAND((1 << 33) - 1)
    return ranges.withColumn("__part", part).join(offsets, "__part").withColumn(POS, F.col("__before") + within).drop("__part", "__before", "__id")


def with_order_of(df: DataFrame, *columns: str) -> DataFrame:
    """df with positions by a unique key: dense ranks, found by a global sort in ranges and not in one task. Written when called."""
    from weftline.storage import materialised

    return numbered(materialised(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__id", F.monotonically_increasing_id())))


def densified(df: DataFrame, *before: str) -> DataFrame:
    """df with its positions, unique but with gaps, replaced by dense ones in the same order; columns before come first in the order.

    Rows are numbered within blocks of positions; the blocks' offsets are a table of one row for each block. df is read twice,
    so what is costly to make is written first.
    """
    marked = df.withColumn("__block", F.floor(F.col(POS) / BLOCK))
    keys = [*before, "__block"]
    counts = marked.groupBy(*keys).agg(F.count("*").alias("__n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = marked.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(POS)) - 1)
    return ranked.join(offsets, keys).withColumn(POS, (F.col("__before") + F.col("__rank")).cast("bigint")).drop("__block", "__before", "__rank")
