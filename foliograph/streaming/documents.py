"""A stream of document files through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def run_batches(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``operator`` to each micro-batch and append to a table; a batch that is replayed overwrites itself."""
    def step(batch: DataFrame, epoch: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind, for streams and tables alike; late rows beyond the watermark are dropped in streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).count()
