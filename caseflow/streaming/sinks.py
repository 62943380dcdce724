"""Running a stream to the end of its present input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from caseflow.sources.shared import fresh_path


def read_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet file or folder ``path`` as a stream; it is given as a pattern, as a stream's plain path must be a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs ``stream`` over all input present, appends its rows to a Parquet table in the shared folder and reads that table.

    Offsets and state are in the shared folder as well, so that a lost executor costs only the tasks it had.
    """
    spark = stream.sparkSession
    root = fresh_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
