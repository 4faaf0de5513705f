"""Append-only records as a stream: an addition around the batch operators of operators.audit, which it uses unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import audit

LOGIN_SCHEMA = "name string, stamp string, ip string, wrong boolean"


def login_stream(spark: SparkSession, path: str, flag_kind: str = "rich_text") -> DataFrame:
    """Login attempts from the JSON files that appear in a folder, with their payloads."""
    return audit.login_records(spark.readStream.schema(LOGIN_SCHEMA).json(path), flag_kind)


def append(stream: DataFrame, path: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends the stream to a table, each batch once even if it is repeated; also gets every batch, for sinks of its own."""
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if also is not None:
            also(df, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
