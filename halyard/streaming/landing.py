"""What a stream gives, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from halyard.sources.scratch import folder


def stream_of(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of a Parquet table, whether one file or a folder of them, as a stream."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path + "*")  # a pattern, since a stream reads no single file


def landed(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for the input that is there now, with `batch`, the number of the batch that gave it.

    Each batch has a folder of its own, so that a batch which is repeated after a failure replaces itself.
    """
    spark, path = stream.sparkSession, folder(stream.sparkSession, name)
    out = f"{path}/out"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # no batch, no folder
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", out).parquet(out)
