"""Resumable ingestion as a stream: new files of a folder are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from echotrail.sources.sinks import append_new


def ingest(spark: SparkSession, source: str, schema: StructType, key: str, target: str,
           checkpoint: str, max_files: int = 1000) -> DataFrame:
    """Process everything new in the folder, then stop.

    The stream's checkpoint remembers finished files.  A batch that is replayed after
    a failure meets its own rows in the target and adds nothing.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .parquet(source))

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch, key, target)

    query = (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(target)
