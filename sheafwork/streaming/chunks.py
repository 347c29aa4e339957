"""Encoding a stream: each micro-batch is encoded on its own and appended to a branch store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sheafwork.options import EncodeOptions
from sheafwork.plans.encoding import CHUNK_BITS, TASK_BITS, encode


def store_stream(stream: DataFrame, path: str, order_by: list[str], options: EncodeOptions = EncodeOptions()) -> DataStreamWriter:
    """A writer that appends branches to the store at `path`, one folder for each micro-batch, which a batch that is run again replaces."""

    def append(batch: DataFrame, number: int) -> None:
        if number >> (63 - CHUNK_BITS - TASK_BITS):
            raise ValueError("too many batches for one store")
        branches = encode(batch, order_by, options).withColumn("chunk_id", F.col("chunk_id") + F.lit(number << (CHUNK_BITS + TASK_BITS)))
        branches.write.partitionBy("field").mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(append)
