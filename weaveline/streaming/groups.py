"""Streaming decisions over whole S1 groups.

Group context, one owner and set selection need complete groups, so a stream of scored pairs is
decided batch by batch, each batch holding whole groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from weaveline.operators.decide import expected_f


def decide_stream(scored: DataFrame, path: str, checkpoint: str):
    """Append the selection of every micro-batch of scored pairs to Parquet at path; batch ids make replays harmless."""

    def write(batch: DataFrame, number: int) -> None:
        expected_f(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
