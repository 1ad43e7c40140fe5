"""Change sync: rows written while a column is being rewritten get their new value on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the last change."""
    newest = Window.partitionBy(*map(quoted, key)).orderBy(*[F.desc(quoted(c)) for c in order])
    return changes.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def apply(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with the changed rows in place of those with their key; changes hold a key once."""
    return base.join(changes.select(*map(quoted, key)), key, "left_anti").unionByName(changes.select(*map(quoted, base.columns)))


def synced(changes: DataFrame, column: str, value: Column) -> DataFrame:
    return changes.withColumn(column, value)


def follow(changes: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], column: str, value: Column):
    """Keeps path/<batch>.. up to date with a stream of changes: each micro-batch, its last change of each key, with the new
    value, is written under the batch's number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        synced(latest(batch, key, order), column, value).write.mode("overwrite").parquet(f"{path}/change={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
