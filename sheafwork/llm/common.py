"""What the operators share: the shared work folder, written tables, Arrow helpers, and word and shingle rules."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; one of our own where that is unset and there is one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        shared = getattr(work_dir, "own", None)
        if shared is None:
            shared = work_dir.own = "file://" + tempfile.mkdtemp(prefix="sheafwork-")
    return f"{shared.rstrip('/')}/sheafwork-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and any executor can read it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; results that aren't written yet can't be computed after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many parts a shuffle that we deal out ourselves gets: what the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def id_key(c: str = "doc_id") -> Column:
    """Text of an id, as the checks of folds hash it."""
    return F.col(c).cast("string")


def id_kind(docs: DataFrame, id_col: str) -> str:
    """Identifiers are whole numbers or else text."""
    return "long" if isinstance(docs.schema[id_col].dataType, T.IntegralType) else "string"


def arrow_id(kind: str) -> pa.DataType:
    return pa.int64() if kind == "long" else pa.string()


def training_rows(labels: DataFrame, label_cols: list[str], sample_rows: int) -> DataFrame:
    """Different pairs of id and labels outside the held-out fold, about sample_rows of them at most, chosen by a hash of the identifier.

    Their number is bounded whatever the table's size, and however often an identifier comes, so that they can be sent to the documents.
    """
    known = labels.select(F.col("doc_id").alias("id"), *[F.col(c).cast("int").alias(c) for c in label_cols]).filter(" and ".join(f"{c} in (0, 1)" for c in label_cols)).filter(fold() != 0).distinct()
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("id"), 34) < int((1 << 30) * sample_rows / n))
    return known


def one_of_each(featured: DataFrame, keys: list[str]) -> DataFrame:
    """One row of features x for each of the keys, the smallest, so that no more rows than labelled ones are collected."""
    return featured.groupBy(*keys).agg(F.min("x").alias("x"))


def fold(id_col: str = "id") -> Column:
    """Remainder by which rows are held out: 0."""
    return F.crc32(F.coalesce(id_key(id_col), F.lit("")).cast("binary")) % 5
