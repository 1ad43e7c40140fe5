"""Migration telemetry as append-only JSON files: written in the driver, read as a batch or tailed as a stream."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files

SCHEMA = "merge_id long, ts double, level string, payload string"


class Events:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.listeners = spark, Files(spark, root), []
        self.path = f"{root.rstrip('/')}/events"

    def emit(self, merge_id: int, payload: dict, level: str = "info") -> None:
        row = {"merge_id": merge_id, "ts": time.time(), "level": level, "payload": json.dumps(payload, sort_keys=True, default=str)}
        self.files.create(f"events/{time.time_ns()}-{uuid.uuid4().hex[:8]}.json", json.dumps(row))
        for tell in self.listeners:
            tell(row)

    def history(self, merge_id: int | None = None) -> DataFrame:
        if not self.files.names("events"):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).json(self.path)
        return (rows if merge_id is None else rows.where(F.col("merge_id") == merge_id)).orderBy("ts")

    def stream(self, merge_id: int | None = None) -> DataFrame:
        """History first, then what follows, as new files come in."""
        rows = self.spark.readStream.schema(SCHEMA).json(self.path)
        return rows if merge_id is None else rows.where(F.col("merge_id") == merge_id)


def tail(events: DataFrame, table: str, checkpoint: str):
    """Appends a stream of events to a table, as far as there is something to read."""
    return events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
