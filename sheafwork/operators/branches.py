"""Operators on a logical branch: a DataFrame with chunk_id, pos and value. All windows are within a chunk, so a chunk is the most that a task must order.

Every operator is JVM-side: window functions, aggregates and generators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions.columns import signed32, unzigzag32, wrap32, zigzag32

CHUNK_ROWS = 4096


def branch(df: DataFrame, key: str, value: Column | str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A column in the order of a unique integer key, chunked by the key."""
    return df.select(F.floor(F.col(key) / chunk_rows).cast("long").alias("chunk_id"), F.col(key).cast("long").alias("pos"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def ordered() -> Window:
    return Window.partitionBy("chunk_id").orderBy("pos")


def before(*order: str, over: str = "chunk_id") -> Window:
    return Window.partitionBy(over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def rle(b: DataFrame) -> DataFrame:
    """Runs: chunk_id, run, start (place of its first value in the chunk), extra (its length less one), value."""
    w = ordered()
    place = F.row_number().over(w) - 1
    new = F.when(F.lag("value").over(w).eqNullSafe(F.col("value")) & (place > 0), 0).otherwise(1)
    marked = b.select("chunk_id", "pos", "value", place.alias("place"), new.alias("new"))
    numbered = marked.withColumn("run", F.sum("new").over(w) - 1)
    return numbered.groupBy("chunk_id", "run").agg(F.min("place").alias("start"), (F.count(F.lit(1)) - 1).alias("extra"), F.first("value", ignorenulls=True).alias("value"))


def undo_rle(runs: DataFrame) -> DataFrame:
    """chunk_id, place, value."""
    return runs.select("chunk_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("extra").cast("int"))).alias("place"), "value")


def pack_bools(b: DataFrame) -> DataFrame:
    """Bytes of eight values each, the first in the lowest bit: chunk_id, byte_index, byte."""
    placed = b.withColumn("place", F.row_number().over(ordered()) - 1)
    bit = F.col("value").cast("int") * F.pow(F.lit(2), F.col("place") % 8).cast("int")
    return placed.groupBy("chunk_id", F.floor(F.col("place") / 8).cast("long").alias("byte_index")).agg(F.sum(bit).cast("int").alias("byte"))


def unpack_bools(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """chunk_id, place, value; sizes: chunk_id, n. Padding beyond a chunk's size is left out."""
    bits = packed.select("chunk_id", "byte", F.col("byte_index"), F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("bit"))
    values = bits.select("chunk_id", (F.col("byte_index") * 8 + F.col("bit")).alias("place"), (F.floor(F.col("byte") / F.pow(F.lit(2), F.col("bit"))) % 2 == 1).alias("value"))
    return values.join(sizes, "chunk_id").filter("place < n").drop("n")


def dictionary(b: DataFrame) -> DataFrame:
    """Different values of a chunk with codes in order of appearance: chunk_id, code, value."""
    first = b.groupBy("chunk_id", "value").agg(F.min("pos").alias("first"))
    return first.select("chunk_id", (F.row_number().over(Window.partitionBy("chunk_id").orderBy("first")) - 1).alias("code"), "value")


def dictionary_codes(b: DataFrame) -> DataFrame:
    """chunk_id, pos, code. A value's first place and the codes come from windows, so that no join is needed."""
    first = b.withColumn("first", F.min("pos").over(Window.partitionBy("chunk_id", "value")))
    return first.select("chunk_id", "pos", (F.dense_rank().over(Window.partitionBy("chunk_id").orderBy("first")) - 1).alias("code"))


def undo_dictionary(codes: DataFrame, values: DataFrame) -> DataFrame:
    return codes.join(values, ["chunk_id", "code"]).select("chunk_id", "pos", "value")


def delta_zigzag(b: DataFrame) -> DataFrame:
    """Differences modulo 2^32 as zigzagged 32-bit numbers; a chunk's first value is a difference to 0."""
    d = F.col("value") - F.coalesce(F.lag("value").over(ordered()), F.lit(0))
    return b.select("chunk_id", "pos", zigzag32(signed32(d.cast("long"))).alias("value"))


def undo_delta_zigzag(b: DataFrame) -> DataFrame:
    total = F.sum("step").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("step", unzigzag32("value")).select("chunk_id", "pos", wrap32(total).alias("value"))


def plain_delta(b: DataFrame) -> DataFrame:
    """Differences modulo 2^32; a chunk's first value is itself."""
    return b.select("chunk_id", "pos", wrap32((F.col("value") - F.coalesce(F.lag("value").over(ordered()), F.lit(0))).cast("long")).alias("value"))


def undo_plain_delta(b: DataFrame) -> DataFrame:
    return b.select("chunk_id", "pos", wrap32(F.sum("value").over(ordered().rowsBetween(Window.unboundedPreceding, 0))).alias("value"))


def xor_bits(b: DataFrame) -> DataFrame:
    """XOR of each value's bits (longs) with the value before; a chunk's first value is itself."""
    return b.select("chunk_id", "pos", F.col("value").bitwiseXOR(F.coalesce(F.lag("value").over(ordered()), F.lit(0).cast("long"))).alias("value"))


def text_offsets(b: DataFrame) -> DataFrame:
    """Place of each text's first byte in the chunk's concatenated text, and its bytes: chunk_id, pos, start, size."""
    size = F.octet_length("value").cast("long")
    return b.withColumn("size", size).select("chunk_id", "pos", F.coalesce(F.sum("size").over(before("pos")), F.lit(0)).alias("start"), "size")


def nullable_flags(b: DataFrame) -> DataFrame:
    return b.select("chunk_id", "pos", F.col("value").isNotNull().alias("present"))


def nullable_values(b: DataFrame) -> DataFrame:
    """The values that are there, numbered in order."""
    kept = b.filter(F.col("value").isNotNull())
    return kept.select("chunk_id", (F.row_number().over(ordered()) - 1).alias("place"), "value")


def undo_nullable(flags: DataFrame, values: DataFrame) -> DataFrame:
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("present"), F.sum(F.col("present").cast("int")).over(w) - 1).cast("int")
    return flags.withColumn("place", at).join(values, ["chunk_id", "place"], "left").select("chunk_id", "pos", "value")


def list_lengths(b: DataFrame) -> DataFrame:
    return b.select("chunk_id", "pos", F.size("value").alias("length"))


def list_values(b: DataFrame) -> DataFrame:
    """Elements of all lists: chunk_id, pos, index, value."""
    return b.select("chunk_id", "pos", F.posexplode("value").alias("index", "value"))


def undo_list(lengths: DataFrame, values: DataFrame) -> DataFrame:
    """Lists from their elements; a list's own elements are gathered, and empty lists come back from their lengths."""
    gathered = values.groupBy("chunk_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "value"))), lambda x: x["value"]).alias("value"))
    return lengths.join(gathered, ["chunk_id", "pos"], "left").select("chunk_id", "pos", F.when(F.col("length") == 0, F.array()).otherwise(F.col("value")).alias("value"))


def fixed_length(lengths: DataFrame) -> DataFrame:
    """Whether all lists of a chunk are equally long: chunk_id, fixed, length."""
    found = lengths.groupBy("chunk_id").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    return found.select("chunk_id", (F.col("low") == F.col("high")).alias("fixed"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("length"))


def map_entries(b: DataFrame) -> DataFrame:
    """Entries of all maps in order of their keys: chunk_id, pos, index, key, value."""
    entries = F.array_sort(F.map_entries("value"))
    return b.select("chunk_id", "pos", F.posexplode(entries).alias("index", "e")).select("chunk_id", "pos", "index", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def undo_map(entries: DataFrame) -> DataFrame:
    """A key that comes twice is an error."""
    return entries.groupBy("chunk_id", "pos").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("index", "key", "value"))), lambda x: F.struct(x["key"], x["value"]))).alias("value"))


def union_tags(b: DataFrame, tag: str = "tag") -> DataFrame:
    """Codes of variants by first appearance in the chunk: chunk_id, code, tag, n. Variants that don't appear have none."""
    found = b.groupBy("chunk_id", tag).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.select("chunk_id", (F.row_number().over(Window.partitionBy("chunk_id").orderBy("first")) - 1).alias("code"), tag, "n")


def variant(b: DataFrame, name: str, tag: str = "tag") -> DataFrame:
    """One variant's branch."""
    return b.filter(F.col(tag) == name).select("chunk_id", "pos", "value")


def union_values(b: DataFrame, tag: str = "tag") -> DataFrame:
    """Codes and values of all variants in one pass: chunk_id, pos, code, value. A null tag is a variant too."""
    first = b.withColumn("first", F.min("pos").over(Window.partitionBy("chunk_id", tag)))
    return first.select("chunk_id", "pos", (F.dense_rank().over(Window.partitionBy("chunk_id").orderBy("first")) - 1).alias("code"), "value")


def undo_union(values: DataFrame, tags: DataFrame) -> DataFrame:
    """Values with their codes and the chunks' tags (see union_tags) as one branch with tags."""
    return values.join(tags.select("chunk_id", "code", "tag"), ["chunk_id", "code"]).select("chunk_id", "pos", "tag", "value")
