"""Loading a folder of CSV files as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow_csv(spark: SparkSession, folder: str, target: str, schema: T.StructType, *, checkpoint: str, separator: str = ",", null: str = "NULL", once: bool = False) -> StreamingQuery:
    """Append every new file of ``folder`` to the Parquet table at ``target``, exactly once.

    once: take what is there and stop, instead of waiting for more.
    """
    rows = spark.readStream.schema(schema).csv(folder, sep=separator, nullValue=null, header=False, mode="FAILFAST")
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
