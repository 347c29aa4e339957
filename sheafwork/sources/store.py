"""The branch store: encoded branches as Parquet, partitioned by field, so that a reader's projection reads its fields' files alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sheafwork.names import canonical
from sheafwork.options import DecodeOptions, EncodeOptions
from sheafwork.plans.encoding import decode, encode


def new_store(spark: SparkSession, name: str) -> str:
    """A path for a store that all nodes share: below spark.checkpoint.dir, or on a single machine in a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        shared = f"file://{tempfile.mkdtemp(prefix='sheafwork-')}"
    return f"{shared.rstrip('/')}/store-{name}-{uuid.uuid4().hex}"


def write_store(df: DataFrame, path: str, order_by: list[str], options: EncodeOptions = EncodeOptions(), mode: str = "error") -> None:
    encode(df, order_by, options).write.partitionBy("field").mode(mode).parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All branches, without a schema of the reader's."""
    found = spark.read.parquet(path)
    return found.withColumn("field", found["field"].cast("string"))


def read_store(spark: SparkSession, path: str, schema: T.StructType, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Rows under the reader's schema; only the partitions of its fields are listed and read."""
    found = spark.read.parquet(path)
    return decode(found.filter(found["field"].isin([canonical(f.name) for f in schema.fields])), schema, options)
