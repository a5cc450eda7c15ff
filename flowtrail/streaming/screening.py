"""Screening of a live message stream. Stateless, so no watermark is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from flowtrail.operators.screening import screen
from flowtrail.session import scratch_path


def screen_stream(messages: DataFrame, out: str, text: str = "text", checkpoint: str | None = None) -> StreamingQuery:
    """Write every message with its verdict to a parquet folder, exactly once."""
    return (
        screen(messages, text)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(messages.sparkSession, "screen-stream"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
