"""Running a stream to its end, for bounded inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigloom import shared


def stream_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream over a bounded input gives, as a table in the shared folder.

    Each micro-batch is written under its number, so one that runs again replaces itself. Returns when the
    input is used up, however long that takes; a failed stream raises.
    """
    spark = stream.sparkSession
    path = f"{shared.folder(spark)}/drained-{uuid.uuid4().hex}"
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        batches.append(number)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/{n}" for n in wanted])
