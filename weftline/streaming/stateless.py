"""Steps on streams: what works row by row runs as it is, what needs an order or a count refuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weftline.models import Model, with_model
from weftline.position import POS


def require_batch(df: DataFrame, operator: str) -> DataFrame:
    """df, or ValueError for a stream: it has no positions, so no take, sort, shard, splits, zip or reverse."""
    if df.isStreaming:
        raise ValueError(f"{operator}() needs an order of all rows; a stream has none.")
    return df


def stream(df: DataFrame, *transforms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The transforms of rows in a chain, for streams and batches alike."""
    for t in transforms:
        df = t(df)
        if df.isStreaming and POS in df.columns:
            raise ValueError("A transform numbered the rows of a stream.")
    return df


def deduplicated(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows delivered again within the watermark once."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, *by: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows in each window of event time, late ones up to the watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, window, slide) if slide else F.window(time, window), *by).agg(F.count("*").alias("n"))


def generated(df: DataFrame, column: str, out: str, model: Model) -> DataFrame:
    """A model's output on a stream: batches are those of each trigger."""
    return with_model(df, column, out, model)


def to_table(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """The stream written to a Parquet folder, each micro-batch through a batch transform if one is given.

    Without a transform the file sink commits each micro-batch exactly once; with one, a folder for each batch id is
    overwritten, so a batch that is tried again replaces itself.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    if each is None:
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda batch, i: each(batch).write.mode("overwrite").parquet(f"{path}/batch_id={i}")).start()
