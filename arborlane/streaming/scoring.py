"""Scoring streams: a fitted model is a stateless expression, so a stream is scored as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, model, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write ``model.transform(stream)`` as Parquet at ``path``; exactly once over restarts, by the checkpoint folder."""
    if not stream.isStreaming:
        raise ValueError("stream must come from readStream")
    writer = model.transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
