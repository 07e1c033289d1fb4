"""Batch scoring applied to a stream: a stateless transform with a file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.training import Fitted, batch_predict


def score_stream(fitted: Fitted, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score arriving vectors once each and append them to a Parquet table."""
    return (
        batch_predict(fitted, stream).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
