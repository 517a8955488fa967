"""Usage of judges over event time, as a stream and as a batch of the same plan; micro-batch scoring of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = "ts double, backend string, model string, prompt_chars bigint, num_messages bigint, usage map<string,string>"


def calls(log: DataFrame) -> DataFrame:
    """Log rows with event time and token counts; values that aren't whole numbers (nested objects) count as null."""
    tokens = lambda k: F.col("usage")[k].try_cast("bigint")
    return log.select(
        F.timestamp_seconds("ts").alias("at"), "backend", "model", "prompt_chars", "num_messages",
        tokens("prompt_tokens").alias("prompt_tokens"), tokens("completion_tokens").alias("completion_tokens"), tokens("total_tokens").alias("total_tokens"),
    )


def distinct_calls(rows: DataFrame) -> DataFrame:
    """Without repeated records. In a stream the watermark bounds the state."""
    keys = ["at", "backend", "model", "prompt_chars", "num_messages", "prompt_tokens", "completion_tokens", "total_tokens"]
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def windowed(log: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Calls and tokens by model and window of event time."""
    rows = calls(log)
    if rows.isStreaming:
        rows = rows.withWatermark("at", lateness)
    sums = distinct_calls(rows).groupBy(F.window("at", window), "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("prompt_chars").alias("prompt_chars"),
    )
    return sums.select(F.col("window.start").alias("start"), "model", "calls", "prompt_tokens", "completion_tokens", "prompt_chars")


def usage_stream(spark: SparkSession, path: str, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """The windowed usage of a folder of parquet files as they arrive."""
    return windowed(spark.readStream.schema(SCHEMA).parquet(path), window, lateness)


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score requests micro-batch by micro-batch with the batch function; a batch that is run again replaces its own output."""

    def each(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health(query: StreamingQuery) -> dict[str, object]:
    """State of a scoring stream: whether it runs, its last batch and that batch's rows, and its error if it failed."""
    last, failed = query.lastProgress, query.exception()
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "error": str(failed) if failed else None}
