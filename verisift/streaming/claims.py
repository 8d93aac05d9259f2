"""Claims that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from verisift.config import LoopSettings, ModelSettings
from verisift.plans.loop import verify
from verisift.sources.models import Generator
from verisift.sources.search import Searcher, TableSearch


def verify_stream(
    claims: DataFrame,
    settings: LoopSettings,
    search: TableSearch | Searcher,
    out: str,
    model: ModelSettings | Generator | None = None,
) -> DataStreamWriter:
    """A writer that verifies each micro-batch of a stream (claim_id, claim) and writes it to its own
    folder under ``out``: a batch that runs again overwrites its first try, so results stand there once.
    Set trigger and checkpointLocation and start it."""

    def one_batch(batch: DataFrame, number: int) -> None:
        verify(batch, settings, search, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return claims.select("claim_id", "claim").writeStream.foreachBatch(one_batch)


def usage_by_window(calls: DataFrame, lateness: str = "10 days", width: str = "1 day") -> DataFrame:
    """Token totals of a stream of model calls (called_at, input_tokens, output_tokens, call_id) per window;
    calls delivered again within ``lateness`` count once."""
    from pyspark.sql import functions as F

    once = calls.withWatermark("called_at", lateness).dropDuplicatesWithinWatermark(["call_id"])
    return once.groupBy(F.window("called_at", width).alias("window")).agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.count("*").alias("calls"),
    )
