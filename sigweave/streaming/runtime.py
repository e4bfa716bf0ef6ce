"""Where streams keep their state and their output, and how they are drained."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigweave.session import shared_folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Hand every available micro-batch to ``write``, then stop."""
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
