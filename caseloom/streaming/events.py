"""Progress events as streams: latest status per record, token runs.

What a batch changes is appended in a folder of its own, so the cost of a batch is
that of its events, and a repeated batch overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.responses import RESET, TOKEN, assemble_token_stream
from ..operators.status import current_status


def _append(stream: DataFrame, mode: str, store: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_status(events: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follow the latest status of every record.

    The state holds one status per record; a batch appends the records it changed.
    """
    return _append(current_status(events), "update", store, checkpoint, available_now)


def streamed_status(spark: SparkSession, store: str) -> DataFrame:
    """The latest status of every record, as :func:`current_status` gives it."""
    changes = spark.read.parquet(store)
    # events with equal times are told apart by the batch that brought the later one
    last = F.max(F.struct("ts", "batch", "analysis_status")).alias("_last")
    return changes.groupBy("record_id").agg(last).select("record_id", "_last.analysis_status", "_last.ts")


def stream_tokens(events: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep tokens and run starts of every record as they come. No task holds a text."""
    kept = events.filter(F.col("status").isin(RESET, TOKEN)).select("record_id", "seq", "status", "token_text")
    return _append(kept, "append", store, checkpoint, available_now)


def streamed_text(spark: SparkSession, store: str, span: int = 1024) -> DataFrame:
    """Current text of every record, as :func:`assemble_token_stream` gives it."""
    return assemble_token_stream(spark.read.parquet(store).drop("batch"), span=span)
