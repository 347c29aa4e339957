"""Size reports over a table of encoded branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_by_path(branches: DataFrame) -> DataFrame:
    """Bytes, values and types of each path, largest first."""
    return branches.groupBy("path").agg(F.sum("byte_size").alias("bytes"), F.sum("n_values").alias("n_values"), F.array_join(F.array_sort(F.collect_set("types")), ", ").alias("types")).orderBy(F.desc("bytes"), "path")


def size_by_encoding(branches: DataFrame) -> DataFrame:
    """Branches and bytes of each encoding, largest first."""
    return branches.groupBy("encoding").agg(F.count(F.lit(1)).alias("branches"), F.sum("byte_size").alias("bytes")).orderBy(F.desc("bytes"), "encoding")


def size_totals(branches: DataFrame, stored_bytes: int | None = None) -> DataFrame:
    """Bytes accounted for by branches, the rest, and the total, which is what is stored if that is given."""
    total = F.col("accounted") if stored_bytes is None else F.lit(stored_bytes).cast("long")
    return branches.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("accounted")).select("accounted", (total - F.col("accounted")).alias("other"), total.alias("total"))


def size_breakdown(branches: DataFrame, stored_bytes: int | None = None) -> str:
    """The three reports as text. Their rows are as many as paths and encodings, whatever the data's size."""
    paths = [f"{r.bytes:>14} {r.path} ({r.types})" for r in size_by_path(branches).collect()]
    encodings = [f"{r.bytes:>14} {r.encoding} ({r.branches} branches)" for r in size_by_encoding(branches).collect()]
    whole = size_totals(branches, stored_bytes).first()
    return "\n".join(["by path", *paths, "by encoding", *encodings, "totals", f"{whole.accounted:>14} accounted", f"{whole.other:>14} other", f"{whole.total:>14} total"])
